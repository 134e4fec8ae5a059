"""The corpus pipeline: documents in, encoded training texts out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and gives it, reread, to the next stage. All stages but the
last return the columns of their input. A stage works on every row that its predecessor
kept; null and empty texts, repeated rows, empty tables and further columns are handled
as the operators state.
"""

from __future__ import annotations

import public_tokenizers

from foresail.llm import decontaminate, exact_dedup, near_dedup, pieces, quality
from foresail.llm.common import documents, written
from foresail.llm.queries import VOCABULARY


def keep_good(spark, docs, sf_dir):
    """Without documents that the quality classifier rejects; it is trained on the
    labelled ones among ``docs``."""
    return quality.drop_poor(docs, documents(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return near_dedup.drop_near(docs)


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """doc_id, ids, n_tokens, round_trip of every document left."""
    return pieces.round_trips(docs, pieces.vocabulary(public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

# A trained classifier and Viterbi paths have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
