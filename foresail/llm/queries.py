"""The registered queries of this package and the SQL that checks them.

Each query applies its operator to its whole table, with production parameters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from foresail.llm import (
    alignment,
    decontaminate,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    html_text,
    language,
    near_dedup,
    pieces,
    quality,
    secrets,
    token_counts,
    toxicity,
)
from foresail.llm.common import documents

VOCABULARY = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_language_id(spark, sf_dir):
    return language.language_id(documents(spark, sf_dir))


def op2_secret_scan(spark, sf_dir):
    return secrets.secret_scan(documents(spark, sf_dir))


def op3_sentencepiece(spark, sf_dir):
    vocabulary = pieces.vocabulary(public_tokenizers.path(VOCABULARY))
    out = pieces.round_trips(documents(spark, sf_dir), vocabulary)
    return out.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op4_minhash_near_dedup(spark, sf_dir):
    out = near_dedup.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_benchmark_decontamination(spark, sf_dir):
    out = decontaminate.contamination(
        documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")
    )
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality_classifier(spark, sf_dir):
    out = quality.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_html_extraction(spark, sf_dir):
    return html_text.main_text(documents(spark, sf_dir, "pages"))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(documents(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark, sf_dir):
    byte_level, pieces_file = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(VOCABULARY)
    return alignment.alignment(documents(spark, sf_dir), byte_level, pieces_file)


def op13_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(documents(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_secret_scan,
        op3_sentencepiece,
        op4_minhash_near_dedup,
        op5_exact_dedup,
        op6_token_counts,
        op7_toxicity,
        op8_benchmark_decontamination,
        op9_quality_classifier,
        op10_html_extraction,
        op11_hard_negatives,
        op12_tokenizer_alignment,
        op13_embedding_near_dedup,
    )
}
ORACLES = {
    "op4_minhash_near_dedup": near_dedup.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op8_benchmark_decontamination": decontaminate.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_embedding_near_dedup": embedding_dedup.SQL,
}
