"""Operator 5: exact duplicates by progressive refinement, DataFrame functions only.

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is
deleted. Rows are refined by length, then by a hash of the first characters, then by
the full digest; a row leaves with its result as soon as it is alone in its group, so
only rows that survive both cheap keys are shuffled by digest.

Defined results: a null text counts as empty, and empty texts are equal to each other.
Of equal texts the row with most code points in its original text stays, then the
smallest id; a null id comes after all others. Rows that repeat both the id and the
text of the staying row are the same document and are kept with it. An empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresail.llm.common import fresh, written

SPACES = " \t\n\x0b\x0c\r"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    start = F.coalesce(text, F.lit(""))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, start)


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def refined(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``company``: whether another row has the same keys. Counts are
    combined before the shuffle, and groups of one row take no part in the join."""
    groups = rows.groupBy(*keys).count().where(F.col("count") > 1)
    groups = groups.select(*keys, F.lit(True).alias("company"))
    return rows.join(groups, list(keys), "left").withColumn("company", F.coalesce("company", F.lit(False)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(F.coalesce(text, F.lit(""))).alias("n_points"),
        normalised(text).alias("norm"),
    ).select(
        "doc_id",
        "n_points",
        F.char_length("norm").alias("n_norm"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    rows = written(rows, "exact-keys")
    by_length = refined(rows, "n_norm")
    alone = by_length.where(~F.col("company"))
    by_prefix = written(refined(by_length.where("company").drop("company"), "n_norm", "prefix"), "exact-refined")
    survivors = by_prefix.where("company")
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id")))
    groups = survivors.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    # rows that left early are their own groups and are not shuffled by digest
    alone = alone.unionByName(by_prefix.where(~F.col("company")))
    own = alone.select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).alias("group_size"))
    out = survivors.join(groups, "text_sha256").select("doc_id", "text_sha256", "keep_id", "group_size").unionByName(own)
    return out.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that an equal text replaces."""
    did, sha = fresh(docs, "dropped_id"), fresh(docs, "dropped_sha")
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias(did), F.col("text_sha256").alias(sha)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(did)) & (digest(F.col(text_col)) == F.col(sha))
    return docs.join(gone, same, "left_anti")


SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
  from documents)
select doc_id,
       first_value(doc_id) over (partition by h order by n desc, doc_id
         rows between unbounded preceding and unbounded following) as keep_id,
       count(*) over (partition by h) as group_size,
       doc_id = first_value(doc_id) over (partition by h order by n desc, doc_id
         rows between unbounded preceding and unbounded following) as kept,
       h as text_sha256
from d
"""
