"""Operator 4: near duplicates by min-max hashing.

A-Z is lower-cased, words are runs of other characters than ``[\\x20\\x09-\\x0D]``, a
document's set holds its distinct 5-word shingles (fewer words: the whole sequence as
one). Documents with 100 * intersection >= 75 * union are linked and links are closed
to components.

* Every permutation gives two values of the signature, its minimum and its maximum, so
  a signature of 160 values takes 80 hash evaluations a shingle. Two permutations make
  a band of four values; two sets of similarity 0.75 share none of the 40 bands with a
  probability of 3e-7.
* Documents with equal sets are one node from then on, however many there are.
* Nodes of one bucket are compared with one of them, never all with all. In a bucket
  whose nodes are then in several components they are compared with a second one, the
  nearest to the first. What is left is compared across components inside the join, a
  pair only in the first of its common buckets: sizes, the triangle inequality of the
  Jaccard distance, a sketch of 2048 bits and then sets of shortened hashes leave links
  and the closest misses, which alone become rows. The sketch passes over a link of
  similarity 0.75 with a chance of 1e-9.
* Links are confirmed on the full sets of hashed shingles; components come from
  alternating large-star and small-star steps over tables.

Defined results: a null or empty text, or one of separators only, has an empty set and
is a component by itself. Rows that repeat an id and a text share one node. The smallest
id of a component is kept; null ids are ignored in that unless a component has no
other. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm import textnum
from foresail.llm.common import bounded_batches, fresh, written

WORDS = 5
PERMUTATIONS = 80
BAND = 2  # permutations a band, of two values each
LIKE = 75  # percent
SEED = 4
SKETCH = 1024  # permutations of a node's sketch: one bit of each minimum and maximum
SKETCH_CELLS = 1 << 16  # hashes of several permutations worked on at once
# Bits of two sketches that may differ: at the least similarity of a link an eighth is
# expected; 6.3 standard deviations more are passed by all but 1 of a thousand million.
SKETCH_OFF = int(2 * SKETCH / 8 + 6.3 * (2 * SKETCH * 7 / 64) ** 0.5)


SEPARATOR = textnum.table(" \t\n\x0b\x0c\r")
FOLDED = textnum.lower_ascii()
SIGNED = "doc_id {id}, text_key long, n_shingles long, node binary, bands array<long>"
SETS = "node binary, shingles array<long>, sketch array<long>"


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct hashed shingles of a sequence of hashed words, in order of value."""
    if not len(words):
        return words
    k = min(WORDS, len(words))
    count = len(words) - k + 1
    out = np.full(count, k, np.uint64)
    for i in range(k):
        out = textnum.mixed(out * np.uint64(textnum.BASE) + words[i : i + count])
    return np.unique(out)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 63, size=(2, PERMUTATIONS), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, permutations, 2): minimum and maximum under each permutation."""
    out = np.empty((len(starts), PERMUTATIONS, 2), np.uint64)
    for k, (a, b) in enumerate(zip(*permutations(), strict=True)):
        moved = values * a + b
        out[:, k, 0] = np.minimum.reduceat(moved, starts)
        out[:, k, 1] = np.maximum.reduceat(moved, starts)
    return out


@lru_cache(1)
def sketch_permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    draw = rng.integers(0, 1 << 31, size=(2, SKETCH), dtype=np.uint32)
    return (draw[0] * np.uint32(2) + np.uint32(1))[:, None], draw[1][:, None]


def sketch(values: np.ndarray) -> np.ndarray:
    """One bit of the minimum and of the maximum under each of SKETCH permutations."""
    a, b = sketch_permutations()
    short = (values >> np.uint64(32)).astype(np.uint32)
    ends = np.empty((SKETCH, 2), np.uint32)
    step = max(1, SKETCH_CELLS // len(short))
    for k in range(0, SKETCH, step):
        moved = short * a[k : k + step]
        moved += b[k : k + step]
        ends[k : k + step, 0] = moved.min(axis=1)
        ends[k : k + step, 1] = moved.max(axis=1)
    ends = (ends ^ (ends >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return np.packbits((ends >> np.uint32(31)).astype(bool)).view(np.int64)


def bands(signature: np.ndarray) -> np.ndarray:
    """One key a band, which also holds the band's number."""
    n = len(signature)
    parts = signature.reshape(n, PERMUTATIONS // BAND, 2 * BAND)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        key = textnum.mixed(key * np.uint64(textnum.BASE) + parts[:, :, i])
    return key.view(np.int64)


def similarity(signature_a: np.ndarray, signature_b: np.ndarray) -> float:
    """Estimated Jaccard similarity: unbiased, as the mean over all minima and maxima."""
    return float((signature_a == signature_b).mean())


def sets_of(column: pa.Array):
    """Per group of rows: its range and the list of its rows' shingle sets."""
    raw, offsets = textnum.bytes_of(column)
    for lo, hi in textnum.row_groups(offsets):
        part = offsets[lo : hi + 1]
        hashes, rows = textnum.hashed_words(
            raw[part[0] : part[-1]], part - part[0], SEPARATOR, FOLDED
        )
        ends = np.searchsorted(rows, np.arange(hi - lo + 1), "left")
        yield lo, hi, [shingles(hashes[ends[i] : ends[i + 1]]) for i in range(hi - lo)]


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _signed(batches):
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, sets in sets_of(batch.column(1)):
            sizes = np.array([len(s) for s in sets], np.int64)
            keys: list = [[]] * len(sets)
            nodes: list = [None] * len(sets)
            full = np.flatnonzero(sizes)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                values = np.concatenate([sets[i] for i in full])
                for i, row in zip(full, bands(signatures(values, starts)), strict=True):
                    keys[i] = row
                    nodes[i] = digest(sets[i])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    batch.column(2).slice(lo, hi - lo),
                    pa.array(sizes),
                    pa.array(nodes, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "node", "bands"],
            )


def _node_sets(batches):
    for batch in batches:
        for lo, hi, sets in sets_of(batch.column(1)):
            nodes = batch.column(0).slice(lo, hi - lo)
            own = [i for i, s in enumerate(sets) if digest(s) == nodes[i].as_py()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([nodes[i].as_py() for i in own], pa.binary()),
                    pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64())),
                    pa.array([sketch(sets[i]) for i in own], pa.list_(pa.int64())),
                ],
                ["node", "shingles", "sketch"],
            )


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the smallest node reached."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = written(pairs.where("u != v").distinct(), f"{name}-0")
    state, step = None, 0
    while True:
        # large star: larger neighbours move to the smallest neighbour
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: smaller neighbours, and the node itself, move to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        step += 1
        pairs = written(small.where("u != v").distinct(), f"{name}-{step}")
        now = pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select("v", "v").distinct().toDF("node", "root"))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_both, n_any: sizes of intersection and union of the two nodes' sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.distinct().join(right, "b").join(left, "a")
    both = both.select(
        "a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("n_both"),
        (F.size("set_a") + F.size("set_b")).alias("n_sum"),
    )
    return both.select("a", "b", "n_both", (F.col("n_sum") - F.col("n_both")).alias("n_any"))


def linked(tested: DataFrame) -> DataFrame:
    return tested.where(100 * F.col("n_both") >= LIKE * F.col("n_any")).select("a", "b")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    pairs = pairs.where(F.col(x) != F.col(y))
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, with their roots, of the buckets whose nodes are in several components."""
    rows = rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return rows.join(ends.where("lo != hi").select("key"), "key", "left_semi")


def node_links(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """node, root for the nodes that share a bucket (``members``: key, node)."""
    first = members.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("pivot"))
    tested = written(compared(_ordered(members.join(first, "key"), "pivot", "node"), sets), "compared")
    if tested.isEmpty():
        return None
    labels = components(linked(tested), "components")

    # distance of every node to the first one of its bucket, by which the second is chosen:
    # among edited copies of a text, the nearest to any of them is the least edited one
    far = 1 - F.col("n_both") / F.col("n_any")
    far = tested.select("a", "b", far.alias("far"))
    far = far.union(far.select("b", "a", "far")).toDF("pivot", "node", "far")
    rows = members.join(first, "key").join(far, ["pivot", "node"], "left")
    rows = written(
        rows.select("key", "node", (F.col("node") != F.col("pivot")).alias("other"),
                    F.coalesce("far", F.lit(0.0)).alias("far")),
        "distances",
    )
    left = _open(rows, labels)
    second = left.where("other").groupBy("key").agg(
        F.min_by("node", F.struct("far", "node")).alias("pivot")
    )
    pairs = left.join(second, "key").join(labels.toDF("pivot", "pivot_root"), "pivot", "left")
    pairs = pairs.where(F.coalesce("pivot_root", "pivot") != F.col("root"))
    pairs = _ordered(pairs, "pivot", "node").distinct().join(tested, ["a", "b"], "left_anti")
    labels = _merged(labels, written(linked(compared(pairs, sets)), "links-second"))
    pairs = _rest(_open(rows, labels), sets).distinct()
    return _merged(labels, written(linked(compared(pairs, sets)), "links-rest"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after more links (a, b): only roots are run through."""
    if links.isEmpty():
        return labels
    ends = links.select("a").union(links.select("b")).distinct().toDF("node")
    labels = labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("root")))
    labels = written(labels, "labels")
    roots = links.join(labels.toDF("a", "root_a"), "a").join(labels.toDF("b", "root_b"), "b")
    roots = components(roots.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "components")
    over = labels.join(roots.toDF("root", "over"), "root", "left")
    return written(over.select("node", F.coalesce("over", "root").alias("root")), "labels")


def _rest(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's nodes in different components that may be linked: their
    sizes, distances to the bucket's first node and sketches allow it, and last the upper
    halves of their shingles' hashes, half the room of the sets; coincidences among these
    are allowed for. A pair is looked at in the first of its common buckets."""
    halves = F.transform("shingles", lambda v: F.shiftright(v, 32).cast("int"))
    more = sets.select("node", F.size("shingles").alias("n"), "sketch", halves.alias("halves"))
    keys = rows.groupBy("node").agg(F.collect_set("key").alias("keys"))
    rows = rows.select("key", "node", "root", "far").join(keys, "node").join(more, "node")
    largest = rows.groupBy("key", "root").count()
    largest = largest.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    few = rows.join(largest, "key").where("root != main").drop("main")
    few = few.select(
        "key", *[F.col(c).alias(f"x_{c}") for c in ("root", "far", "n", "sketch", "keys", "halves")],
        F.col("node").alias("x"),
    )
    words = range(2 * SKETCH // 64)
    other = [F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("x_sketch", F.lit(i)))) for i in words]
    # n * n / 2**33 coincidences are expected; so many more have a chance of 1e-8 at most
    slack = 3 + F.ceil(F.pow(F.least("n", "x_n"), 2) / 2**29)
    both = F.least(F.size(F.array_intersect("halves", "x_halves")) + slack, "n", "x_n")
    near = (
        (F.col("root") != F.col("x_root"))
        & (F.abs(F.col("far") - F.col("x_far")) <= (100 - LIKE) / 100 + 1e-9)
        & (100 * F.least("n", "x_n") >= LIKE * F.greatest("n", "x_n"))
        & (reduce(add, other) <= SKETCH_OFF)
        & (F.array_min(F.array_intersect("keys", "x_keys")) == F.col("key"))
        & (100 * both >= LIKE * (F.col("n") + F.col("x_n") - both))
    )
    return _ordered(few.join(rows, "key").where(near), "x", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, node (the digest
    of the document's set; null for an empty one), text_key (the hash of its text)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
    )
    kind = texts.schema["doc_id"].dataType.simpleString()
    signed = written(texts.mapInArrow(_signed, SIGNED.format(id=kind)), "signed")

    nodes = signed.where("n_shingles > 0").groupBy("node").agg(F.first("bands").alias("bands"))
    members = nodes.select("node", F.explode("bands").alias("key"))
    many = members.groupBy("key").count().where("count > 1").select("key")
    members = written(members.join(many, "key", "left_semi"), "bucket-members")

    # sets of the nodes that share a bucket, from one of the texts that have the set
    wanted = members.select("node").distinct()
    one = signed.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("one"))
    one = one.join(wanted, "node", "left_semi")
    one = one.select("node", F.col("one.doc_id").alias("node_id"), F.col("one.text_key").alias("key"))
    source = texts.join(
        one, F.col("doc_id").eqNullSafe(F.col("node_id")) & (F.col("text_key") == F.col("key"))
    )
    sets = source.select("node", "text").mapInArrow(_node_sets, SETS)
    # rows that repeat id and text bring their set again
    sets = written(sets.dropDuplicates(["node"]), "node-sets")

    roots = node_links(members, sets)
    first = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    if roots is not None:
        rooted = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
        first = rooted.join(lowest, "root").select("node", "component_id")
    else:
        first = first.toDF("node", "component_id")
    out = signed.join(first, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "node",
        "text_key",
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns: one document of each component stays."""
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("kept"))
    did, key = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    gone = gone.select(F.col("doc_id").alias(did), F.col("text_key").alias(key)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(did)) & (F.xxhash64(F.col(text_col)) == F.col(key))
    return docs.join(gone, same, "left_anti")


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
g as materialized (select doc_id, md5(string_agg(g, chr(10) order by g)) as h from s group by doc_id),
rep as materialized (select h, min(doc_id) as a from g group by h),
sr as (select s.doc_id, s.g from s join rep on s.doc_id = rep.a),
p as materialized (
  select x.doc_id as a, y.doc_id as b, count(*) as c
  from sr x join sr y on x.g = y.g and x.doc_id < y.doc_id group by all),
links as materialized (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * c >= 75 * (na.n + nb.n - c)),
e as materialized (select a, b from links union all select b, a from links),
reach as (select a as root, a as id from rep union select r.root, e.b from reach r join e on e.a = r.id),
comp as (select id, min(root) as component_id from reach group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id,
       d.doc_id = coalesce(component_id, d.doc_id) as kept
from documents d left join n using (doc_id) left join g using (doc_id)
left join rep using (h) left join comp on comp.id = rep.a
"""
