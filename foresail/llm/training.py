"""Bounded labelled samples for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 8


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, max_bytes: int) -> list:
    """Rows (doc_id, text, label) of at most ``per_label`` documents of every label, in
    order of doc_id, for the driver to learn from.

    ``docs`` has doc_id and text, ``labels`` doc_id and label; null labels and ids are
    left out, and so are ids without a text of at most ``max_bytes``, which alone are
    learned from; only ids and lengths are looked at for that. Of an id with several texts
    one is taken. Ids are dealt to SPREAD * per_label slots a label by a hash; the least of
    each slot is found by aggregation, so a task passes on a bounded number of rows and
    no sort sees more than the slots. Of these the least ``per_label`` hashes are taken,
    the same at every run. The sample is bounded by per_label * labels * max_bytes;
    callers limit the labels.
    """
    short = docs.where(F.octet_length("text") <= max_bytes)
    known = labels.where("doc_id is not null and label is not null")
    known = known.join(short.select("doc_id"), "doc_id", "left_semi")
    pick = F.xxhash64("doc_id", F.lit(7))
    slots = known.groupBy("label", F.pmod(pick, F.lit(SPREAD * per_label)).alias("slot"))
    slots = slots.agg(F.min(F.struct(pick.alias("pick"), "doc_id")).alias("least"))
    order = Window.partitionBy("label").orderBy("least.pick", "least.doc_id")
    chosen = slots.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_label)
    chosen = chosen.select(F.col("least.doc_id").alias("doc_id"), "label")
    # one text of an id that has several, and one row of those that repeat
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    rows = rows.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return sorted(rows.select("doc_id", "text", "label").collect(), key=lambda r: (r[0], r[1], r[2]))
