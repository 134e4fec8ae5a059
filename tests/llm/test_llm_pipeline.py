"""The pipeline against a plain rerun of its stages without Spark."""

from __future__ import annotations

import re
import zlib

import duckdb
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from foresail.llm import pieces, quality
from foresail.llm.training import labelled_sample
from test_llm_dedup import brute_components

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chosen = quality.training_labels(labels, "quality", 4, 2)
    known = labelled_sample(docs, chosen, quality.PER_LABEL, quality.TRAIN_BYTES)
    assert all(zlib.crc32(str(d).encode()) % 4 != 2 for d, _, _ in known)
    net = quality.train(known)
    scores = quality.scores(net, pa.array([t for _, t in rows]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]

    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d, t))
    rows = sorted((d, t) for g in groups.values() for _, d, t in [min(g)])
    kept = {r[0] for r in brute_components([(d, t, None) for d, t in rows]) if r[3]}
    rows = [r for r in rows if r[0] in kept]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))

    grams = set()
    for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall():
        w = words(t)
        n = min(13, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    clean = []
    for d, t in rows:
        w, hit = words(t), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((d, t))
    held = pieces.Pieces(pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    want = {d: held.encode(t).tolist() for d, t in clean}
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == want
    assert out.where("not round_trip").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]
