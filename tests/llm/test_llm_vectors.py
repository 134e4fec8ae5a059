"""Operators 11 and 13 against brute force, their graph and tree, and odd rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foresail.llm import embedding_dedup as dedup
from foresail.llm import graph
from foresail.llm import hard_negatives as hard

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def crowd(n: int, d: int, seed: int = 0) -> np.ndarray:
    """Random vectors, a third of them near copies of one, some pairs close by."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0] + 0.15 * rng.normal(size=(n // 3, d))
    x[n // 3 : n // 3 + 40] = x[-40:] + 0.3 * rng.normal(size=(40, d))
    return x.astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def cosine_links(x: np.ndarray):
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    like = x @ x.T / (norm[:, None] * norm[None, :]) >= 0.9
    np.fill_diagonal(like, False)
    least = np.arange(len(x))
    while True:
        new = np.minimum(least, np.where(like, least[None, :], len(x)).min(1))
        if (new == least).all():
            return like.sum(1), least
        least = new


def test_graph_finds_neighbours():
    x = crowd(4000, 32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, layers = graph.built(x, 1)
    assert sorted(order) == list(range(len(x)))
    nodes, sims = graph.Graph(x[order], layers).search(x[:500], 64)
    best = (x[:500] @ x[order].T).argsort(1)[:, ::-1][:, :10]
    hits = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nodes, best, strict=True)])
    assert hits >= 0.9
    assert (np.diff(sims, axis=1) <= 0).all()


def test_near_vectors_of_several_shards(spark):
    x = crowd(6000, 24, 3)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    out = dedup.near_vectors(frame(spark, rows)).orderBy("vec_id").toPandas()
    links, least = cosine_links(x)
    assert out.n_links.sum() >= 0.99 * links.sum()
    assert (out.n_links.to_numpy() <= links).all()
    assert np.mean(out.component_id.to_numpy() == least) >= 0.99
    assert (out.kept == (out.vec_id == out.component_id)).all()


def test_near_vectors_of_odd_rows(spark):
    rows = [
        (9, [1.0, 0.0], 1),
        (3, [2.0, 0.0], 1),  # the same direction
        (3, [2.0, 0.0], 2),  # a repeated row
        (None, [1.0, 0.01], 0),
        (7, None, 1),
        (8, [], 1),
        (1, [0.0, -0.0], 1),
        (2, [float("nan"), 1.0], 1),
        (4, [None, 1.0], 1),
        (5, [1.0, 0.0, 0.0], 1),  # of another length
        (6, [0.0, 1.0], None),
        (None, [0.0, -1.0], 1),
    ]
    out = dedup.near_vectors(frame(spark, rows).withColumn("node", F.lit("x")).withColumn("shard", F.lit(1)))
    got = sorted(map(tuple, out.collect()), key=str)
    alone = [(i, 0, i, True) for i in (7, 8, 1, 2, 4, 5, 6, None)]
    joined = [(9, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False)]
    assert got == sorted(alone + joined, key=str)
    assert dedup.near_vectors(frame(spark, [])).collect() == []
    empty = dedup.near_vectors(frame(spark, [(1, None, 1)]))
    assert [tuple(r) for r in empty.collect()] == [(1, 0, 1, True)]


def shard_of(x: np.ndarray, number: int = 0):
    table = pa.table({"node": np.arange(len(x)), "weight": np.ones(len(x), np.int64), "vector": list(x)})
    return dedup.shard_rows((pa.scalar(x.shape[1]), pa.scalar(number)), table)


def test_flags_of_pairs_are_looked_at_in_bounded_parts(monkeypatch):
    """Rows with one pair each are not spread out to flags all at once."""
    monkeypatch.setattr(dedup, "FLAGS", 1 << 16, raising=False)
    n, unpack, flags = 2048, np.unpackbits, []
    bits = dedup.Bits(n, n)
    at = np.arange(n)
    bits.add_rows(0, n, at, at[::-1])

    def counted(*args, **more):
        out = unpack(*args, **more)
        flags.append(out.size)
        return out

    monkeypatch.setattr(dedup.np, "unpackbits", counted)
    found = [np.stack(part) for part in bits.chunks()]
    assert max(flags) <= 1 << 16
    assert (np.concatenate(found, axis=1) == [at, at[::-1]]).all()


@pytest.mark.parametrize("width", [8, 1000])
def test_links_of_a_crowd_come_in_bounded_parts(monkeypatch, width):
    monkeypatch.setattr(dedup, "FLAGS", 1 << 14)
    x = crowd(1500, 8, 5).astype(np.float64)
    shard = dedup.Shard(shard_of(x))
    parts = list(dedup.near(shard.graph.x, shard.exact, shard, width))
    assert max(len(q) for q, _ in parts) <= 1 << 14
    found = {(a, b) for q, v in parts for a, b in zip(q.tolist(), v.tolist(), strict=True)}
    links, _ = cosine_links(x)
    assert len(found) == sum(len(q) for q, _ in parts) >= 0.99 * (links.sum() + len(x))


@pytest.mark.parametrize("factor", [1.0, 1 / 3])
def test_a_shard_travels_in_pieces(factor):
    """No row holds more than a piece, and vectors come back exactly, also those that
    single precision cannot hold."""
    x = crowd(5000, 16, 2).astype(np.float64) * factor
    rows = shard_of(x)
    assert rows.num_rows == -(-len(x) // dedup.PIECE) and rows["single"][0].as_py() == (factor == 1.0)
    shard = dedup.Shard(rows.take(list(range(rows.num_rows))[::-1]))
    assert (shard.exact == x[shard.nodes]).all() and (shard.weights == 1).all()
    order, layers = graph.built((x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32), 0)
    assert (shard.nodes == order).all()
    assert all((a == b).all() for a, b in zip(shard.graph.layers, layers, strict=True))


def test_near_vectors_agree_with_sql(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(crowd(300, 8, 5))] + [(300, [0.0] * 8, 1)]
    df = frame(spark, rows)
    con = duckdb.connect()
    table = df.toPandas()
    con.register("embeddings", table)
    want = sorted(con.execute(dedup.SQL).fetchall())
    assert sorted(map(tuple, dedup.near_vectors(df).collect())) == want


@pytest.fixture
def negatives(spark):
    def run(rows):
        df = frame(spark, rows)
        con = duckdb.connect()
        con.register("embeddings", df.toPandas())
        con.execute("create or replace table t as select vec_id::bigint as vec_id, embedding, label::int as label from embeddings")
        want = con.execute(hard.SQL.replace("from embeddings", "from t")).fetchall()
        got = [tuple(r) for r in hard.hard_negatives(df).collect()]
        return sorted(got), sorted(want)

    return run


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_agree_with_sql(negatives, monkeypatch, seed):
    monkeypatch.setattr(hard, "SHARD", 300)
    monkeypatch.setattr(hard, "ANCHORS", 8)
    x = crowd(1200, 12, seed) / 3
    labels = np.random.default_rng(seed).integers(0, 4, len(x))
    got, want = negatives([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))])
    assert len(want) > 50 and got == want


def test_hard_negatives_with_ties_and_repeated_rows(negatives):
    few = [[0.5, 0.25], [0.25, 0.25], [0.5, 0.125], [-0.5, 0.0]]
    rows = [(i, few[i % 4], i % 3) for i in range(200)] * 2
    rows = [r for r in rows if r[0] % 50 or r[0] == 100]
    got, want = negatives(rows)
    assert want and got == want


def test_hard_negatives_of_odd_rows(spark, negatives):
    good = [(i, [0.1 * (i % 7), 0.3], i % 2) for i in range(60)]
    odd = [
        (100, None, 1), (150, [], 1), (200, [None, 1.0], 1), (250, [float("inf"), 1.0], 1),
        (300, [1.0, 1.0], None), (350, [1.0, 1.0, 1.0], 1), (400, [1e30, 1.0], 1), (401, [1e30, -1e30], 1),
        (402, [7e29, 1.0], 0),
    ]
    got = sorted(map(tuple, hard.hard_negatives(frame(spark, good + odd)).collect()))
    assert {r[0] for r in got} <= {0, 50, 400}
    plain, want = negatives(good)
    assert plain == want and plain
    null_id = frame(spark, good + [(None, [0.3, 0.3], 1)])
    assert sorted(map(tuple, hard.hard_negatives(null_id).collect())) == plain
    assert hard.hard_negatives(frame(spark, [])).collect() == []
    assert hard.hard_negatives(frame(spark, [(1, None, 1)])).collect() == []


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 200
    x = np.floor(np.repeat(centres, 200, 0) + rng.normal(size=(4000, 16)) * 5)
    ids, labels = np.arange(4000), np.repeat(np.arange(20), 200)
    top = float((x**2).sum(1).max())
    tree = hard.Tree(x, ids, labels, top)
    seen = []
    offer = hard.Queries.offer

    class Counting(hard.Queries):
        def offer(self, active, scores, ids, labels):
            seen.append(scores.size)
            offer(self, active, scores, ids, labels)

    q = x[:8]
    scores = q @ x.T
    lo = np.full((8, 1), 1).astype(np.int64)
    hi = (scores.max(1, keepdims=True) * 0.6).astype(np.int64)
    queries = Counting(list(range(8)), q, ids[:8], labels[:8], lo, hi, 3, False)
    tree.search(queries)
    assert sum(seen) < 0.7 * scores.size
    for i in range(8):
        fits = (labels != labels[i]) & (scores[i] >= 1) & (scores[i] <= hi[i, 0])
        best = sorted(((-s, r) for s, r in zip(scores[i][fits], ids[fits])))[:3]
        assert sorted((-s, -r) for s, r in queries.best.get((i, 0), [])) == [(a, b) for a, b in best]
