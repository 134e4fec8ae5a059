"""Operator 11: hard negatives by a multiway hyperplane tree with range tables.

Vectors become integers, floor(256 * x). The score of a row and an anchor is their inner
product. With R the greatest norm of all rows, a row x becomes the point (x, sqrt(R^2 -
|x|^2)) and an anchor q the point (q, 0): then d^2 = |q|^2 + R^2 - 2 q.x, so a window of
scores is an annulus of distances around the anchor, and the tree works in a metric.

* The tree's root is split by Spark: PIVOTS rows (least hashes) are split points, a row
  belongs to the nearest. Each split point keeps the least and greatest distance to the
  rows of every part, itself included. An anchor goes only to parts that these ranges and
  its annulus leave.
* A part is dealt to shards of SHARD rows at most on average, so a crowd of equal rows
  is split too. A shard is one tree: every inner node has SPLITS split points with ranges
  to all sibling subtrees, leaves hold LEAF rows or rows that no split separates.
* Leaves are exact: scores are integer products (float64 below 2^53, Python integers
  beyond). Only what a range proves empty is left out.
* Search 1: the best rows of an anchor's label, first in its own part, then with the
  score of the last one as bound in the other parts. Search 2: for all windows of an
  anchor at once, the best rows of other labels.

Anchors meet shards in blocks of ANCHORS, as rows of a cogroup; results of a shard are a
few rows for each anchor, ranked over the shards by a window.

Defined results: rows with a null label, a null or empty vector, null or non-finite
components (multiplied by 256 too), or a null id take no part. Vectors of different length are never compared.
Rows that repeat an id count each, but never as positives of an anchor with that id.
A window of a negative positive score is empty. Scores beyond 64 bits are returned as the
nearest such integer. Ties go by id. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresail.llm.common import written
from foresail.llm.vectors import finite, matrix, numbers

SCALE = 256
ANCHOR, NOISED = 50, 7  # ids divisible by these
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
PIVOTS = 16
SHARD = 32_768
ANCHORS = 16_384
SPLITS, LEAF = 8, 96
DEPTH = 100  # a node this deep is a leaf: splits that only peel off single rows end
FAR = 1 << 62  # beyond every score of the windows

LIMITS = (-(1 << 63), (1 << 63) - 1)
SHARDS = "part int, salt int, tree binary"
FOUND = "anchor long, win int, id long, score long"


def distances(queries: np.ndarray, lift: np.ndarray, points: np.ndarray, point_lift: np.ndarray) -> np.ndarray:
    """Distances of (query, lift) to (point, lift)."""
    square = (queries**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * queries @ points.T
    square += lift[:, None] ** 2 + point_lift[None, :] ** 2 - 2 * lift[:, None] * point_lift[None, :]
    return np.sqrt(np.maximum(square, 0))


def lifted(points: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (points**2).sum(1), 0))


def left_by_ranges(d, inner, outer, lo, hi, slack):
    """(queries, parts): parts that may hold a row at a distance of inner to outer.

    ``d``: distances to the split points; ``lo``, ``hi``: (split points, parts) ranges.
    """
    outer, inner = outer[:, None, None] + slack, inner[:, None, None] - slack
    d = d[:, :, None]
    # the last: all rows are nearer than ``inner``; a distance that overflows proves nothing
    return ~((d - outer > hi) | (d + outer < lo) | (d + hi < inner)).any(1)


class Tree:
    """A shard's tree. Nodes: (split points, lo, hi, children) or an array of rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, top: float):
        order = np.argsort(ids, kind="stable")  # rows of a leaf are in order of id
        self.x, self.ids, self.labels, self.top = x[order], ids[order], labels[order], top
        self.lift = lifted(self.x, top)
        self.most = float(np.abs(self.x).max(initial=0))
        self.slack = 1e-6 * (1 + np.sqrt(top))
        self.root = self._node(np.arange(len(self.x)))

    def _node(self, rows: np.ndarray, depth: int = 0):
        if len(rows) <= LEAF or depth == DEPTH:
            return rows
        split = self._split_points(rows)
        d = self._between(rows, split)
        part = d.argmin(1)
        groups = [rows[part == j] for j in range(len(split))]
        if max(map(len, groups)) == len(rows):
            return rows
        lo = np.stack([d[part == j].min(0) if len(g) else np.full(len(split), np.inf) for j, g in enumerate(groups)], 1)
        hi = np.stack([d[part == j].max(0) if len(g) else np.full(len(split), -np.inf) for j, g in enumerate(groups)], 1)
        return split, lo, hi, [self._node(g, depth + 1) for g in groups]

    def _between(self, rows, split):
        return distances(self.x[rows], self.lift[rows], self.x[split], self.lift[split])

    def _split_points(self, rows: np.ndarray) -> np.ndarray:
        """Rows far from one another among a few spread over the node."""
        some = rows[np.linspace(0, len(rows) - 1, min(len(rows), 20 * SPLITS)).astype(int)]
        picked = [some[0]]
        far = self._between(some, some[:1])[:, 0]
        while len(picked) < SPLITS and far.max() > 0:
            nxt = some[far.argmax()]
            picked.append(nxt)
            far = np.minimum(far, self._between(some, np.array([nxt]))[:, 0])
        return np.array(picked)

    def products(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if float(np.abs(queries).max(initial=0)) * self.most * queries.shape[1] < 2**53:
            return queries @ self.x[rows].T
        whole = [[int(v) for v in x] for x in self.x[rows]]
        out = np.empty((len(queries), len(rows)), object)
        for i, q in enumerate(queries):
            q = [int(v) for v in q]
            out[i] = [sum(a * b for a, b in zip(q, x)) for x in whole]
        return out

    def search(self, queries: Queries) -> None:
        self._visit(self.root, np.arange(len(queries)), queries)

    def _visit(self, node, active: np.ndarray, queries: Queries) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for lo in range(0, len(node), 4096):
                rows = node[lo : lo + 4096]
                queries.offer(active, self.products(queries.x[active], rows), self.ids[rows], self.labels[rows])
            return
        split, lo, hi, children = node
        d = distances(queries.x[active], np.zeros(len(active)), self.x[split], self.lift[split])
        # nearest subtrees first: their rows tighten the bounds for the rest
        for j in np.argsort(d.mean(0)):
            if np.isfinite(lo[0, j]):
                inner, outer = queries.annuli(active, self.top)
                left = left_by_ranges(d, inner, outer, lo, hi, self.slack)[:, j]
                self._visit(children[j], active[left], queries)


class Queries:
    """Anchors with windows of scores; the best ``k`` rows found for each window."""

    def __init__(self, keys, x, ids, labels, lo, hi, k: int, same: bool):
        self.keys, self.x, self.ids, self.labels = keys, x, ids, labels
        self.lo, self.hi, self.k, self.same = lo, hi, k, same
        self.best = {}  # (query, window): heap of (score, -id)
        self.square = (x**2).sum(1)
        # a window may still take rows with this score or more
        self.least = lo.astype(np.float64)

    def __len__(self):
        return len(self.keys)

    def annuli(self, active, top):
        """Least and greatest distance of the rows that may still count."""
        high, low = self.hi[active].max(1).astype(float), self.least[active].min(1)
        at = self.square[active] + top
        return np.sqrt(np.maximum(at - 2 * high, 0)), np.sqrt(np.maximum(at - 2 * low, 0))

    def offer(self, active, scores, ids, labels) -> None:
        alike = labels[None, :] == self.labels[active][:, None]
        fits = (alike & (ids[None, :] != self.ids[active][:, None])) if self.same else ~alike
        for w in range(self.lo.shape[1]):
            lo, hi = self.lo[active, w][:, None], self.hi[active, w][:, None]
            good = fits & (scores >= lo) & (scores <= hi) & (scores >= self.least[active, w][:, None])
            for r in np.flatnonzero(good.any(1)):
                at = np.flatnonzero(good[r])
                # rows are in order of id, and a stable sort leaves ties so
                at = at[np.argsort(-scores[r, at], kind="stable")[: self.k]]
                key = (active[r], w)
                heap = self.best.setdefault(key, [])
                for i in at.tolist():
                    item = (int(scores[r, i]), -int(ids[i]))
                    if len(heap) < self.k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                if len(heap) == self.k:
                    self.least[key] = max(self.least[key], float(heap[0][0]))

    def found(self) -> pa.Table:
        rows = [
            (self.keys[q], w, -neg, min(max(score, LIMITS[0]), LIMITS[1]))
            for (q, w), heap in self.best.items()
            for score, neg in heap
        ]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.Table.from_arrays(arrays, ["anchor", "win", "id", "score"])


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """key, id, label, x, dim of the rows that take part; written, so keys stay."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"),
    ).where("id is not null and label is not null")
    rows = rows.where(finite(F.col("x")))
    noised = F.when(F.col("id") % NOISED == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # the floor of a double as a double, also beyond 64 bits
    floor = lambda v: F.rint(v) - F.when(F.rint(v) > v, 1.0).otherwise(0.0)
    whole = F.transform("x", lambda v: floor(v * SCALE))
    rows = rows.select("id", noised.alias("label"), whole.alias("x")).where(finite(F.col("x")))
    return written(
        rows.withColumns({"key": F.monotonically_increasing_id(), "dim": F.size("x")}), "negatives-rows"
    )


def pivots_of(rows: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """By length of vector: PIVOTS split points and the greatest squared norm. Bounded by
    the number of lengths."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("key"), "key")
    first = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= PIVOTS)
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    tops = {r[0]: r[1] for r in rows.groupBy("dim").agg(F.max(square).alias("top")).collect()}
    points: dict[int, list] = {}
    for r in first.select("dim", "at", "x").orderBy("dim", "at").collect():
        points.setdefault(r.dim, []).append(r.x)
    # split points that repeat would only leave empty parts
    return {d: (np.unique(np.array(p), axis=0), tops[d]) for d, p in points.items()}


def parted(rows: DataFrame, pivots) -> DataFrame:
    """Rows with part: the nearest split point, counted on over the lengths."""
    first = _first_parts(pivots)

    def assigned(batches):
        for batch in batches:
            dims = numbers(batch.column(batch.schema.names.index("dim")))
            x = batch.column(batch.schema.names.index("x"))
            part = np.zeros(len(batch), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points, top = pivots[int(dim)]
                own = matrix(x.take(pa.array(at)))
                d = distances(own, lifted(own, top), points, lifted(points, top))
                part[at] = first[int(dim)] + d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    return rows.mapInArrow(assigned, "id long, label long, x array<double>, key long, dim int, part int")


def _first_parts(pivots) -> dict[int, int]:
    first, at = {}, 0
    for dim in sorted(pivots):
        first[dim], at = at, at + len(pivots[dim][0])
    return first


def ranges_of(rows: DataFrame, pivots) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: least and greatest distance of every split point to every part, from
    one aggregation over all rows, combined in the tasks first."""
    first = _first_parts(pivots)

    def partial(batches):
        lo = {d: np.full((len(p), len(p)), np.inf) for d, (p, _) in pivots.items()}
        hi = {d: np.full((len(p), len(p)), -np.inf) for d, (p, _) in pivots.items()}
        for batch in batches:
            dims, parts = numbers(batch.column(1)), numbers(batch.column(2))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                points, top = pivots[dim]
                own = matrix(batch.column(0).take(pa.array(at)))
                d = distances(own, lifted(own, top), points, lifted(points, top))
                np.minimum.at(lo[dim].T, parts[at] - first[dim], d)
                np.maximum.at(hi[dim].T, parts[at] - first[dim], d)
        for dim in pivots:
            r, c = np.nonzero(np.isfinite(lo[dim]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(r), dim), pa.int32()), pa.array(r, pa.int32()), pa.array(c, pa.int32()),
                 pa.array(lo[dim][r, c]), pa.array(hi[dim][r, c])],
                ["dim", "point", "part", "lo", "hi"],
            )

    out = {d: (np.full((len(p),) * 2, np.inf), np.full((len(p),) * 2, -np.inf)) for d, (p, _) in pivots.items()}
    found = rows.select("x", "dim", "part").mapInArrow(partial, "dim int, point int, part int, lo double, hi double")
    for r in found.groupBy("dim", "point", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        out[r.dim][0][r.point, r.part] = r.lo
        out[r.dim][1][r.point, r.part] = r.hi
    return out


def _routed(pivots, ranges, own_part: bool | None):
    """Function of mapInArrow: anchors with the parts that they have to look at."""
    first = _first_parts(pivots)

    def routed(batches):
        for batch in batches:
            names = batch.schema.names
            dims, home = numbers(batch.column(names.index("dim"))), numbers(batch.column(names.index("part")))
            x = batch.column(names.index("x"))
            rows, parts = [], []
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                points, top = pivots[dim]
                q = matrix(x.take(pa.array(at)))
                lo, hi = (matrix(batch.column(names.index(c)).take(pa.array(at)), np.int64) for c in ("lo", "hi"))
                there = Queries(at, q, at, at, lo, hi, 1, True)
                inner, outer = there.annuli(np.arange(len(at)), top)
                d = distances(q, np.zeros(len(q)), points, lifted(points, top))
                slack = 1e-6 * (1 + np.sqrt(top))
                left = left_by_ranges(d, inner, outer, *ranges[dim], slack)
                left &= np.isfinite(ranges[dim][0][0])[None, :]
                own = home[at][:, None] == first[dim] + np.arange(len(points))[None, :]
                left = own if own_part else left & ~own if own_part is False else left
                r, c = np.nonzero(left)
                rows.append(at[r])
                parts.append(first[dim] + c)
            rows, parts = np.concatenate(rows), np.concatenate(parts)
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(parts, pa.int32())], [*names, "go"])

    return routed


def _grown(tops: dict[int, float]):
    def grown(keys, table):
        x = matrix(table["x"])
        tree = Tree(x, numbers(table["id"]), numbers(table["label"]), tops[x.shape[1]])
        return pa.table({"part": pa.array([keys[0].as_py()], pa.int32()),
                         "salt": pa.array([keys[1].as_py()], pa.int32()), "tree": [pickle.dumps(tree, 5)]})

    return grown


def _searched(k: int, same: bool):
    def searched(keys, anchors, trees):
        if not trees.num_rows or not anchors.num_rows:
            return Queries([], np.zeros((0, 1)), *[np.zeros(0)] * 2, *[np.zeros((0, 1), np.int64)] * 2, k, same).found()
        tree = pickle.loads(trees["tree"][0].as_py())
        anchors = anchors.combine_chunks()
        queries = Queries(
            numbers(anchors["key"]).tolist(), matrix(anchors["x"]), numbers(anchors["id"]), numbers(anchors["label"]),
            matrix(anchors["lo"], np.int64), matrix(anchors["hi"], np.int64), k, same,
        )
        tree.search(queries)
        return queries.found()

    return searched


class Index:
    """The two-level tree over all rows: ranges of the root, shards as a written table."""

    def __init__(self, rows: DataFrame):
        self.pivots = pivots_of(rows)
        self.rows = written(parted(rows, self.pivots), "negatives-parted")
        self.ranges = ranges_of(self.rows, self.pivots)
        salts = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SHARD)).cast("int")
        self.parts = self.rows.groupBy("part").agg(salts.alias("salts"))
        dealt = self.rows.join(self.parts, "part")
        dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("key"), "salts").cast("int"))
        grown = dealt.select("part", "salt", "id", "label", "x").groupBy("part", "salt")
        grown = grown.applyInArrow(_grown({d: top for d, (_, top) in self.pivots.items()}), SHARDS)
        self.shards = written(grown, "negatives-shards")

    def search(self, anchors: DataFrame, k: int, same: bool, own_part: bool | None = None) -> DataFrame:
        """anchor, win, id, score: the best ``k`` of each shard for every window of the
        anchors (key, id, label, x, dim, part and lo, hi: windows of scores)."""
        names = ["key", "id", "label", "x", "dim", "part", "lo", "hi"]
        kinds = "key long, id long, label long, x array<double>, dim int, part int, lo array<long>, hi array<long>"
        anchors = anchors.select(*names)
        blocks = -(-max(1, anchors.count()) // ANCHORS)
        go = anchors.mapInArrow(_routed(self.pivots, self.ranges, own_part), f"{kinds}, go int")
        go = go.drop("part").withColumnRenamed("go", "part").join(self.parts, "part")
        go = go.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        go = go.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        trees = self.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        by = ["part", "salt", "block"]
        trees = trees.join(go.select(*by).distinct(), by, "left_semi")
        trees = trees.toDF(*trees.columns)
        return go.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(_searched(k, same), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    index = Index(prepared(vectors, id_col, vector_col, label_col))
    anchors = index.rows.where(F.col("id") % ANCHOR == 0)
    all_scores = {"lo": F.array(F.lit(-FAR)), "hi": F.array(F.lit(FAR))}

    own = written(index.search(anchors.withColumns(all_scores), POSITIVES, True, True), "positives-own")
    # with enough rows at home, others have to be as good as the last of these
    bound = _best(own, POSITIVES).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    others = anchors.join(bound.withColumnRenamed("anchor", "key"), "key", "left")
    enough = F.when(F.col("n") == POSITIVES, F.col("least")).otherwise(F.lit(-FAR))
    others = others.withColumns({"lo": F.array(enough), "hi": F.array(F.lit(FAR))})
    found = own.union(index.search(others, POSITIVES, True, False))
    positives = written(_best(found, POSITIVES), "positives")

    hundred = F.lit(100).cast("decimal(38,0)")
    score = F.col("score").cast("decimal(38,0)")
    low = F.ceil(score * LOW / hundred).cast("long")
    high = F.floor(score * HIGH / hundred).cast("long")
    windows = positives.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", low.alias("lo"), high.alias("hi")))).alias("w")
    )
    # every anchor has POSITIVES windows; those without a positive are empty
    padded = [(F.get("w.lo", F.lit(i)), F.get("w.hi", F.lit(i))) for i in range(POSITIVES)]
    windows = windows.select(
        F.col("anchor").alias("key"),
        F.array(*[F.coalesce(lo, F.lit(FAR)) for lo, _ in padded]).alias("lo"),
        F.array(*[F.coalesce(hi, F.lit(-FAR)) for _, hi in padded]).alias("hi"),
    )
    negatives = _best(index.search(anchors.join(windows, "key"), NEGATIVES, False), NEGATIVES)
    out = negatives.select(
        "anchor", (F.col("win") + 1).alias("at"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    ).join(
        positives.select("anchor", F.col("rank").alias("at"), F.col("id").alias("positive_id"),
                         F.col("score").alias("positive_score")),
        ["anchor", "at"],
    ).join(anchors.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
with v as materialized (
  select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(cast(x as double) * 256)) as x
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.k as ak, a.vec_id as anchor_id, a.label = b.label as alike, b.vec_id,
         cast(list_dot_product(a.x, b.x) as bigint) as score
  from v a join v b on len(a.x) = len(b.x) where a.vec_id % 50 = 0),
p as (select *, row_number() over (partition by ak order by score desc, vec_id) as pos
      from s where alike and vec_id <> anchor_id qualify pos <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id,
             s.score as negative_score,
             row_number() over (partition by p.ak, p.pos order by s.score desc, s.vec_id) as rank
      from p join s on s.ak = p.ak and not s.alike
       and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
      qualify rank <= 3)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n
"""
