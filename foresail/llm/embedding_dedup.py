"""Operator 13: near duplicates of vectors by navigable small-world graphs per shard.

Vectors are linked where their cosine is LIKE or more, in double precision.

* Equal vectors are one node, counted as often as they occur; a node's rows are all
  linked with one another.
* Nodes are dealt to shards by a hash of their number, so a crowd of near copies is
  spread evenly; a shard builds one graph (``graph.py``) and is one row from then on.
* Every node queries every shard: a task takes two shards and searches the nodes of each
  in the graph of the other, so a link found from either end counts at both. Found pairs
  are bits of a matrix of the two shards; they never become rows.
* A beam that holds nothing but links is widened without limit: the search goes on over
  the graph from the links found until no neighbour is one. The width to start with is
  doubled until an audit finds AUDIT of the links of sampled nodes and of probes, which
  are nodes turned away to a cosine of just LIKE; a width of a quarter of the shard
  is an exhaustive comparison instead.
* Similarities in single precision decide where rounding cannot matter; pairs closer to
  the limit are computed in double precision.
* A task returns, for every node with a link, its number of links and one edge to the
  least node that it reaches within the task; components are the union of these.

The work is (rows x shards) searches. A shard holds SHARD nodes at most on average, so a
task needs the two matrices, the graphs and 134 MB of bits, whatever the table's size;
comparisons and pairs are looked at FLAGS at a time. A shard travels as rows of PIECE nodes
each, and its vectors in single precision where that holds them exactly, so that the JVM
neither keeps nor sorts rows of many megabytes.

Defined results: a vector that is null, empty, zero, holds null or non-finite components,
or has a squared norm that doubles cannot hold links with nothing and is a component by itself; vectors of different length
are never linked. Rows with a null id are linked as others are; a component's id is its
smallest id, null only if it has no other. Rows that repeat an id count each, and every
input row gives one row. An empty table gives an empty result; labels and other columns
are ignored. No result depends on the order of equal rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm.graph import BATCH, LINKS, Graph, built
from foresail.llm.near_dedup import components
from foresail.llm.common import written
from foresail.llm.vectors import finite, matrix, numbers, shard_count

LIKE = 0.9
SHARD = 32_768
LEAST_SHARDS, WORTH = 4, 1024
WIDTH = 48
AUDIT, AUDITED = 0.99, 256
ROUNDING = 2e-5  # more than 64 to 4096 products in single precision can be off
TASKS = 20_000  # partitions at most; more pairs of shards share them
EDGES = 1 << 20  # pairs looked at together when components are closed
FLAGS = 1 << 22  # comparisons, and flags of pairs, held at once
PIECE = 2048  # nodes of a shard that are one row

SHARDS = "dim int, shard int, piece int, nodes binary, weights binary, single boolean, vectors binary, links array<binary>"
FOUND = "node long, n_links long, root long"


def shard_rows(keys, table):
    """The rows of a shard: its nodes in order of level and the neighbour tables."""
    table = table.sort_by("node")
    exact = matrix(table["vector"])
    unit = (exact / np.linalg.norm(exact, axis=1)[:, None]).astype(np.float32)
    order, layers = built(unit, seed=keys[1].as_py())
    nodes, weights, exact = numbers(table["node"])[order], numbers(table["weight"])[order], exact[order]
    with np.errstate(over="ignore"):
        narrow = exact.astype(np.float32)
    single = bool((narrow == exact).all())
    vectors = narrow if single else exact
    layers = [layer.astype(np.int32) for layer in layers]
    parts = [slice(at, at + PIECE) for at in range(0, len(nodes), PIECE)]
    return pa.table({
        "dim": pa.array([keys[0].as_py()] * len(parts), pa.int32()),
        "shard": pa.array([keys[1].as_py()] * len(parts), pa.int32()),
        "piece": pa.array(range(len(parts)), pa.int32()),
        "nodes": pa.array([nodes[p].tobytes() for p in parts], pa.binary()),
        "weights": pa.array([weights[p].tobytes() for p in parts], pa.binary()),
        "single": pa.array([single] * len(parts), pa.bool_()),
        "vectors": pa.array([vectors[p].tobytes() for p in parts], pa.binary()),
        "links": pa.array([[layer[p].tobytes() for layer in layers] for p in parts], pa.list_(pa.binary())),
    })


class Shard:
    def __init__(self, table: pa.Table):
        rows = table.sort_by("piece").to_pylist()
        joined_up = lambda parts, kind: np.frombuffer(b"".join(parts), kind)
        self.nodes = joined_up((r["nodes"] for r in rows), np.int64)
        self.weights = joined_up((r["weights"] for r in rows), np.int64)
        kind = np.float32 if rows[0]["single"] else np.float64
        vectors = joined_up((r["vectors"] for r in rows), kind).reshape(len(self.nodes), -1)
        self.exact = vectors.astype(np.float64)
        self.norm = np.linalg.norm(self.exact, axis=1)
        unit = (self.exact / self.norm[:, None]).astype(np.float32)
        layers = []
        for level in range(len(rows[0]["links"])):
            flat = joined_up((r["links"][level] for r in rows), np.int32)
            layers.append(flat.reshape(-1, LINKS if level else 2 * LINKS).astype(np.int64))
        self.graph = Graph(unit, layers)

    def __len__(self):
        return len(self.nodes)


def near(queries: np.ndarray, exact: np.ndarray, shard: Shard, width: int):
    """(query, node) of the links that a search of ``width`` finds, in parts and any order."""
    for q, v in _likely(queries, shard.graph, width):
        sims = np.empty(len(q), np.float64)
        for lo in range(0, len(q), EDGES):
            part = slice(lo, lo + EDGES)
            sims[part] = np.einsum("ij,ij->i", queries[q[part]], shard.graph.x[v[part]])
        close = np.abs(sims - LIKE) <= ROUNDING
        a, b = exact[q[close]], shard.exact[v[close]]
        sims[close] = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * shard.norm[v[close]])
        linked = sims >= LIKE
        yield q[linked], v[linked]


def _likely(queries, graph, width):
    """Pairs that are links, or too close to the limit to tell in single precision."""
    least = LIKE - ROUNDING
    if 4 * width >= len(graph.x):
        for q, v in _compared(queries, graph, np.arange(len(graph.x)), least):
            yield q, v
        return
    nodes, sims = graph.search(queries, width)
    r, c = np.nonzero(sims >= least)
    v = nodes[r, c]
    wide = np.flatnonzero(sims[:, -1] >= least)
    inside = np.isin(r, wide)
    yield r[~inside], v[~inside]
    if len(wide):
        for q, more in _widened(queries[wide], graph, np.unique(v[inside]), least):
            yield wide[q], more


def _compared(queries, graph, nodes, least):
    """Likely links between the queries and ``nodes``, FLAGS comparisons at a time."""
    step = max(1, FLAGS // max(1, len(queries)))
    for lo in range(0, len(nodes), step):
        part = nodes[lo : lo + step]
        q, v = np.nonzero(queries @ graph.x[part].T >= least)
        yield q, part[v]


def _widened(queries, graph, start, least):
    """All links of the queries that can be reached from ``start`` over links."""
    known = np.zeros(len(graph.x), bool)
    known[start] = True
    frontier = start
    while len(frontier):
        hit = np.zeros(len(graph.x), bool)
        for q, v in _compared(queries, graph, frontier, least):
            hit[v] = True
            yield q, v
        near_by = graph.layers[0][hit].ravel()
        near_by = np.unique(near_by[near_by >= 0])
        frontier = near_by[~known[near_by]]
        known[frontier] = True


def audited_width(source: Shard, target: Shard, seed: int) -> int:
    """The least width, doubled from WIDTH, whose searches pass the audit."""
    rng = np.random.default_rng(seed)
    sample = rng.permutation(len(source))[:AUDITED]
    queries, exact = source.graph.x[sample], source.exact[sample]
    aim = rng.permutation(len(target))[:AUDITED]
    x = target.exact[aim] / target.norm[aim][:, None]
    probes = x
    if x.shape[1] > 1:
        turn = rng.normal(size=x.shape)
        turn -= (turn * x).sum(1)[:, None] * x
        turn /= np.linalg.norm(turn, axis=1)[:, None]
        probes = (LIKE + 1e-9) * x + np.sqrt(1 - (LIKE + 1e-9) ** 2) * turn
    links_at = lambda width: sum(len(q) for q, _ in near(queries, exact, target, width))
    true, width = links_at(len(target)), WIDTH
    while 4 * width < len(target):
        links = links_at(width)
        hit = np.zeros(len(aim), bool)
        for q, v in near(probes.astype(np.float32), probes, target, width):
            hit[q[aim[q] == v]] = True
        hits = hit.sum()
        if links >= AUDIT * true and hits >= AUDIT * len(aim):
            break
        width *= 2
    return width


def _by_rows(r, columns):
    """(rows, each pair's place among them, pairs) of as many rows as FLAGS flags have room for."""
    used, back = np.unique(r, return_inverse=True)
    step = max(1, FLAGS // max(1, columns))
    for lo in range(0, len(used), step):
        own = slice(None) if len(used) <= step else np.flatnonzero((back >= lo) & (back < lo + step))
        yield used[lo : lo + step], back[own] - lo, own


class Bits:
    """Found pairs (row, column); untouched pages of the zeroed matrix cost nothing."""

    def __init__(self, rows: int, columns: int):
        self.columns = columns
        self.bits = np.zeros((rows, (columns + 7) // 8), np.uint8)

    def add_rows(self, at: int, n: int, r, c) -> None:
        """Pairs of the rows from ``at``, which need not be in order."""
        for used, back, own in _by_rows(r, self.columns):
            flags = np.zeros((len(used), self.columns), bool)
            flags[back, c[own]] = True
            self.bits[at + used] |= np.packbits(flags, axis=1)

    def add_columns(self, at: int, n: int, r, c) -> None:
        """Pairs of the columns from ``at``, a multiple of 8; ``c`` counts from there."""
        for used, back, own in _by_rows(r, n):
            flags = np.zeros((len(used), n), bool)
            flags[back, c[own]] = True
            packed = np.packbits(flags, axis=1)
            self.bits[used, at // 8 : at // 8 + packed.shape[1]] |= packed

    def chunks(self):
        """(rows, columns) of the pairs, in order of rows: of as many rows as FLAGS flags
        have room for, and about EDGES pairs."""
        step = max(1, FLAGS // max(1, self.columns))
        for at in range(0, len(self.bits), step):
            touched = at + np.flatnonzero(self.bits[at : at + step].any(1))
            counts = np.bitwise_count(self.bits[touched]).sum(1, dtype=np.int64)
            parts = np.cumsum(counts) // EDGES
            for part in np.split(touched, np.flatnonzero(np.diff(parts)) + 1):
                if len(part):
                    r, c = np.nonzero(np.unpackbits(self.bits[part], axis=1, count=self.columns))
                    yield part[r], c


def _found(source: Shard, target: Shard, bits: Bits, seed: int, by_row: bool) -> None:
    width = audited_width(source, target, seed)
    for at in range(0, len(source), BATCH):
        part = slice(at, min(at + BATCH, len(source)))
        for q, v in near(source.graph.x[part], source.exact[part], target, width):
            if by_row:
                bits.add_rows(at, part.stop - at, q, v)
            else:
                bits.add_columns(at, part.stop - at, v, q)


def joined(left: Shard, right: Shard, same: bool, seed: int):
    """(node, n_links, root) arrays of the links between two shards."""
    bits = Bits(len(right), len(left))
    _found(left, right, bits, seed, by_row=False)
    _found(right, left, bits, seed + 1, by_row=True)
    offset = 0 if same else len(left)
    links = np.zeros(offset + len(right), np.int64)
    label = np.arange(len(links))
    for r, c in bits.chunks():
        if same:
            r, c = r[r != c], c[r != c]
        np.add.at(links, offset + r, left.weights[c])
        if not same:
            np.add.at(links, c, right.weights[r])
        _closed(label, offset + r, c)
    if same:
        links += left.weights - 1
    while (label != label[label]).any():
        label = label[label]
    nodes = left.nodes if same else np.concatenate([left.nodes, right.nodes])
    some = links > 0
    # one least node for each set of nodes that are connected here
    least = np.full(len(links), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    return nodes[some], links[some], least[label][some]


def _closed(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a`` and ``b``; ``label`` leads to a set's least member."""
    while len(a):
        la, lb = label[a], label[b]
        while True:
            ra, rb = label[la], label[lb]
            if (ra == la).all() and (rb == lb).all():
                break
            la, lb = ra, rb
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))


def _pair(keys, lefts, rights):
    a, b = keys[1].as_py(), keys[2].as_py()
    right = Shard(rights)
    left = right if a == b else Shard(lefts)
    nodes, links, roots = joined(left, right, a == b, 2 * (a * 100_003 + b))
    return pa.table({"node": nodes, "n_links": links, "root": roots})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    sound = finite(F.col("vector")) & (square > 0) & (square < float("inf"))
    rows = rows.withColumn("vector", F.when(sound, F.col("vector")))
    # adding 0.0 makes -0.0 the same value
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    key = F.struct(F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(13), "vector").alias("h2"))
    rows = written(rows.withColumn("vector_key", F.when(F.col("vector").isNotNull(), key)), "vectors-keyed")

    nodes = rows.where("vector is not null").groupBy("vector_key").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"), F.first("vector").alias("vector")
    )
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")})
    nodes = written(nodes, "vector-nodes")

    sizes = nodes.groupBy("dim").agg(shard_count(F.count(F.lit(1)), SHARD, LEAST_SHARDS, WORTH).alias("shards"))
    # a task for about every shard and pair of shards: their rows are few, their work is not
    count = sizes.agg(F.sum("shards"), F.sum(F.col("shards") * (F.col("shards") + 1) / 2)).first()
    shard_tasks, pair_tasks = (min(TASKS, int(2 * (n or 0)) + 1) for n in count)
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int"))
    dealt = dealt.select("dim", "shard", "node", "weight", "vector")
    shards = dealt.repartition(shard_tasks, "dim", "shard").groupBy("dim", "shard")
    # rows of shards are heavy and their numbers few: joins by number must not shuffle the rows
    shards = written(shards.applyInArrow(shard_rows, SHARDS), "vector-shards").join(F.broadcast(sizes), "dim")
    present = shards.select("dim", "shard").distinct()

    lefts = shards.withColumns({"a": F.col("shard"), "b": F.explode(F.sequence("shard", F.col("shards") - 1))})
    rights = shards.withColumns({"b": F.col("shard"), "a": F.explode(F.sequence(F.lit(0), "shard"))})
    # a shard may be empty, and then has no row; the pairs of the others remain
    lefts = lefts.where("shard < b")  # a shard meets itself with its right rows alone
    lefts = lefts.join(F.broadcast(present.select("dim", F.col("shard").alias("b"))), ["dim", "b"], "left_semi")
    rights = rights.join(F.broadcast(present.select("dim", F.col("shard").alias("a"))), ["dim", "a"], "left_semi")
    rights = rights.toDF(*rights.columns)  # columns of their own: both sides are one table
    by = ["dim", "a", "b"]
    lefts, rights = (side.repartition(pair_tasks, *by).groupBy(*by) for side in (lefts, rights))
    found = lefts.cogroup(rights).applyInArrow(_pair, FOUND)
    found = written(found, "vector-links")

    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b")
    out = nodes.join(links, "node", "left")
    if edges.isEmpty():
        out = out.withColumn("component", F.col("least_id"))
    else:
        out = out.join(components(edges, "vector-components"), "node", "left")
        out = out.withColumn("root", F.coalesce("root", "node"))
        lowest = out.groupBy("root").agg(F.min("least_id").alias("component"))
        out = out.join(lowest, "root")
    out = rows.drop("vector").join(out.select("vector_key", "n_links", "component"), "vector_key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


SQL = """
with recursive v as materialized (
  select vec_id, cast(embedding as double[]) as x from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as materialized (select vec_id, x, sqrt(list_dot_product(x, x)) as n from v),
links as materialized (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
reach as (select vec_id as root, vec_id as id from embeddings
          union select r.root, l.b from reach r join links l on l.a = r.id),
comp as (select id, min(root) as component_id from reach group by id),
cnt as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n_links, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join comp on comp.id = e.vec_id left join cnt on cnt.a = e.vec_id
"""
