"""Operator 8: benchmark decontamination, DataFrame functions only.

Texts are lower-cased in A-Z; words are runs of digits, letters a-z and code points
from 0x80 on. A window is ``n`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window. Every word of a document that lies inside an
occurrence of a window is hit.

Document windows become 64-bit keys and are matched against the distinct benchmark
windows, which are broadcast once their counted number is within ``broadcast_windows``
and shuffled beyond that. A match is verified by a second digest of the window's words,
made with another function, so only positions travel and never texts.

Defined results: a null or empty text has no words, no hits and is clean; items without
words are ignored; items with the same words count each; a benchmark without windows
leaves every document clean. Rows that repeat id and text get the same result each; an
id that comes with several texts gets one result per text. Other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresail.llm.common import fresh, written

WINDOW = 13
# Largest number of windows to broadcast; at 24 bytes each about 100 MB once hashed.
BROADCAST_WINDOWS = 2_000_000
# What separates words, once A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z only. In pure ASCII ``lower`` does just that, and faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


def words(text: Column) -> Column:
    return F.filter(
        F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != F.lit("")
    )


def keys_at(array: str, start: Column, length: int) -> Column:
    """Two independent keys of the window: one to match on, one to verify with."""
    part = F.slice(F.col(array), start, length)
    return F.struct(
        F.xxhash64(part).alias("key"), F.hash(part).alias("check"), F.lit(length).alias("len")
    )


def windows(array: str, length: int) -> Column:
    last = F.size(array) - F.lit(length - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts, lambda i: F.struct(i.alias("pos"), keys_at(array, i, length).alias("w"))
    )


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """key, check, len, item_id: the distinct windows of every item."""
    items = benchmark.select(
        F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    whole = F.struct(
        F.xxhash64("words").alias("key"), F.hash("words").alias("check"), F.size("words").alias("len")
    )
    of_item = F.when(F.size("words") < n, F.array(whole)).otherwise(
        F.transform(windows("words", n), lambda x: x["w"])
    )
    return items.select("item_id", F.explode(of_item).alias("w")).select("item_id", "w.*").distinct()


def covered(spans: Column) -> Column:
    """Words in the union of the spans, an array of (pos, len)."""
    def add(acc, s):
        end = s["pos"] + s["len"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"])))
            .cast("long").alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and spans: the hit windows as (first word counted from 1, words)."""
    items = written(item_windows(benchmark, item_col, item_text_col, n), "benchmark-windows")
    distinct = items.select("key", "check", "len").distinct()
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # n at most
    small = distinct.count() <= broadcast_windows

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.xxhash64(F.col(id_col).isNull(), F.col(text_col)).alias("row"),
        F.col(id_col).alias("doc_id"),
        words(F.col(text_col)).alias("words"),
    )
    counted = rows.select("id", "row", "doc_id", F.size("words").cast("long").alias("n_words"))
    result = ("n_hit", "spans", "item_ids")
    if lengths:
        parts = [windows("words", k) for k in lengths]
        found = rows.select(
            "id", "row", F.explode(F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]).alias("x")
        ).select("id", "row", "x.pos", "x.w.*")
        hits = found.join(F.broadcast(distinct) if small else distinct, ["key", "check", "len"])
        hits = written(hits.distinct(), "window-hits")
        spans = hits.groupBy("id", "row").agg(F.collect_set(F.struct("pos", "len")).alias("spans"))
        spans = spans.withColumn("n_hit", covered(F.col("spans")))
        # a document's windows first, then their items: both sides of the join are distinct
        per_doc = hits.select("id", "row", "key", "check", "len").distinct()
        per_doc = per_doc.join(F.broadcast(items) if small and _few(items, broadcast_windows) else items, ["key", "check", "len"])
        per_doc = per_doc.select("id", "row", "item_id").distinct()
        per_doc = per_doc.groupBy("id", "row").agg(F.collect_set("item_id").alias("item_ids"))
        out = counted.join(spans.join(per_doc, ["id", "row"]), ["id", "row"], "left")
    else:
        out = counted.select(
            "*",
            F.lit(None).cast("long").alias("n_hit"),
            F.lit(None).cast("array<struct<pos:int,len:int>>").alias("spans"),
            F.lit(None).cast("array<string>").alias("item_ids"),
        )
    none = {"n_hit": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<pos:int,len:int>>"),
            "item_ids": F.array().cast("array<string>")}
    out = out.withColumns({c: F.coalesce(c, none[c]) for c in result})
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.array_sort("spans").alias("spans"),
        "row",
    )


def _few(items: DataFrame, most: int) -> bool:
    return items.count() <= most


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, without contaminated documents."""
    gone = contamination(docs, benchmark, id_col, text_col, **options).where("contaminated")
    did, row = fresh(docs, "gone_id"), fresh(docs, "gone_row")
    gone = gone.select(F.col("doc_id").alias(did), F.col("row").alias(row)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(did)) & (
        F.xxhash64(F.col(id_col).isNull(), F.col(text_col)) == F.col(row)
    )
    return docs.join(gone, same, "left_anti")


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, text: the words outside every hit window, in order, one blank between
    them; a document without hits keeps its text as it is. ``found`` is the result of
    ``contamination``."""
    hit = found.where("n_hit > 0").select("doc_id", "row", "spans").distinct()
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col).isNull(), F.col(text_col)).alias("row"),
    ).alias("d")
    joined = rows.join(
        hit.alias("h"),
        F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.row") == F.col("h.row")),
        "left",
    )
    inside = F.array_distinct(
        F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))
    )
    kept = F.array_except(F.sequence(F.lit(1), F.size(words(F.col("d.text")))), inside)
    cleaned = F.array_join(
        F.transform(kept, lambda i: F.element_at(words(F.col("d.text")), i)), " "
    )
    return joined.select(
        "d.doc_id", F.when(F.col("spans").isNull(), F.col("d.text")).otherwise(cleaned).alias("text")
    )


SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
bw as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bwin as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as g
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from bw where len(w) > 0)),
lens as (select distinct n from bwin),
dwin as (
  select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lens where len(w) >= n)),
hits as (select d.doc_id, d.i, d.n, b.item_id from dwin d join bwin b on d.n = b.n and d.g = b.g),
pos as (select doc_id, count(distinct p) as n_hit
        from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as s
        from (select distinct doc_id, item_id from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
       coalesce(n_items, 0) as n_items, coalesce(s, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join pos using (doc_id) left join its using (doc_id)
"""
