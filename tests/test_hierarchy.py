"""Reconciliation on a three-level tree."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
from foresail.operators import checks as dq
from foresail.operators import hierarchy as hi
from foresail.session import stored

TREE = {"company": ["store_1", "store_2"], "store_1": ["sku_1", "sku_2"], "store_2": ["sku_3"]}
WEIGHTS = {"store_1": 0.6, "store_2": 0.4, "sku_1": 0.25, "sku_2": 0.75, "sku_3": 1.0}
NODES = ["company", "store_1", "store_2", "sku_1", "sku_2", "sku_3"]
LEAVES = ["sku_1", "sku_2", "sku_3"]


def level(node):
    return "company" if node == "company" else node.split("_")[0]


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame(
        [(n, level(n), ["company", "store", "sku"].index(level(n))) for n in NODES],
        "node_id string, level_name string, level_position int",
    )
    edges = spark.createDataFrame(
        [(p, c, WEIGHTS[c]) for p, cs in TREE.items() for c in cs],
        "parent_node_id string, child_node_id string, allocation_weight double",
    )
    return nodes, edges


def solve(spark, graph, values, method, **kw):
    fc = spark.createDataFrame([("g", n, float(v)) for n, v in values.items()], "g string, node_id string, v double")
    rows = hi.reconcile(fc, *graph, method, ["g"], ["v"], **kw).collect()
    return {r.node_id: r.v for r in rows}


def test_bottom_up(spark, graph):
    got = solve(spark, graph, dict(zip(NODES, (0, 0, 0, 10, 30, 20))), "bottom_up")
    assert got == {"company": 60, "store_1": 40, "store_2": 20, "sku_1": 10, "sku_2": 30, "sku_3": 20}


def test_top_down(spark, graph):
    got = solve(spark, graph, dict(zip(NODES, (100, 0, 0, 0, 0, 0))), "top_down")
    assert got == pytest.approx({"company": 100, "store_1": 60, "store_2": 40, "sku_1": 15, "sku_2": 45, "sku_3": 40})


def test_middle_out(spark, graph):
    got = solve(spark, graph, dict(zip(NODES, (0, 80, 20, 0, 0, 0))), "middle_out", middle_level="store")
    assert got == pytest.approx({"company": 100, "store_1": 80, "store_2": 20, "sku_1": 20, "sku_2": 60, "sku_3": 20})


@pytest.mark.parametrize("variances", [None, dict(zip(NODES, (9.0, 4.0, 2.0, 1.0, 3.0, 0.5)))])
def test_mint_is_the_least_squares_projection(spark, graph, variances):
    base = dict(zip(NODES, (75.0, 50.0, 30.0, 10.0, 30.0, 20.0)))
    frame = None
    if variances:
        frame = spark.createDataFrame(list(variances.items()), "node_id string, variance double")
    got = solve(spark, graph, base, "mint", variances=frame)

    def below(n):
        return {n} if n not in TREE else set().union(*(below(c) for c in TREE[n]))

    s = np.array([[float(leaf in below(n)) for leaf in LEAVES] for n in NODES])
    w = np.diag([1 / (variances or dict.fromkeys(NODES, 1.0))[n] for n in NODES])
    y = np.array([base[n] for n in NODES])
    want = s @ np.linalg.solve(s.T @ w @ s, s.T @ w @ y)
    assert [got[n] for n in NODES] == pytest.approx(list(want))


def test_two_parents_and_cycles_are_rejected(spark, graph):
    nodes, edges = graph
    extra = spark.createDataFrame([("store_2", "sku_1", 1.0)], edges.schema)
    with pytest.raises(ValueError, match="one parent"):
        hi.validate_graph(nodes, edges.union(extra))
    loop = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], edges.schema)
    more = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], nodes.schema)
    with pytest.raises(ValueError, match="unreachable"):
        hi.validate_graph(nodes.union(more), edges.union(loop))


def test_missing_nodes_and_crossed_quantiles_fail(spark, graph):
    with pytest.raises(ValueError, match="missing hierarchy nodes"):
        solve(spark, graph, dict(zip(NODES[1:], (0, 0, 1, 2, 3))), "bottom_up")
    fc = spark.createDataFrame([("g", n, 5.0, 1.0) for n in NODES], "g string, node_id string, lo double, hi double")
    with pytest.raises(Exception, match="crossed quantiles"):
        hi.reconcile(fc, *graph, "bottom_up", ["g"], ["lo", "hi"]).collect()


def test_expansion_needs_every_leaf(spark, graph):
    nodes, edges = graph
    keyed = nodes.selectExpr("*", """concat('{"k":"', node_id, '"}') as node_key_json""")
    pred = spark.createDataFrame([(n, "g", 1.0, n) for n in LEAVES], "k string, g string, prediction double, prediction_id string")
    got = {r.node_id: r.prediction for r in hi.expand_leaves(pred, keyed, edges, ["k"], ["g"]).collect()}
    assert got["company"] == 3 and got["store_1"] == 2
    with pytest.raises(ValueError, match="no eligible prediction"):
        hi.expand_leaves(pred.filter("k <> 'sku_3'"), keyed, edges, ["k"], ["g"])
    assert hi.coherence_violations(
        hi.expand_leaves(pred, keyed, edges, ["k"], ["g"]), edges, ["g"], "prediction"
    ).isEmpty()


def test_deep_tree_with_one_level_name(spark):
    """Depth is that of the edges: 40 below the root, a side branch on each node."""
    names = [f"n{i}" for i in range(41)]
    links = [(names[i], names[i + 1], 3.0) for i in range(40)] + [(names[i], f"side{i}", 1.0) for i in range(40)]
    ids = names + [f"side{i}" for i in range(40)]
    nodes = spark.createDataFrame([(n, "node") for n in ids], "node_id string, level_name string")
    edges = spark.createDataFrame(links, "parent_node_id string, child_node_id string, allocation_weight double")
    assert {r.node_id: r.depth for r in hi.depths(nodes, edges).collect()} == (
        {n: i for i, n in enumerate(names)} | {f"side{i}": i + 1 for i in range(40)}
    )
    assert hi.graph_violations(nodes, edges).isEmpty()
    paths = hi.leaf_closure(nodes, edges)
    assert paths.filter("node_id = 'n0'").count() == 41
    weight = {r.leaf_id: r.path_weight for r in paths.filter("node_id = 'n0'").collect()}
    assert weight["n40"] == pytest.approx(0.75**40) and weight["side39"] == pytest.approx(0.75**39 * 0.25)
    base = dict.fromkeys(ids, 1.0)
    up = solve(spark, (nodes, edges), base, "bottom_up")
    assert [up[n] for n in names] == [41 - i for i in range(41)]
    down = solve(spark, (nodes, edges), base, "top_down")
    assert down["n40"] == pytest.approx(0.75**40) and sum(down[n] for n in weight) == pytest.approx(1.0)


def test_a_cycle_ends_the_walks(spark):
    nodes = spark.createDataFrame([(n, "x") for n in "rabc"], "node_id string, level_name string")
    edges = spark.createDataFrame(
        [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a")], "parent_node_id string, child_node_id string"
    )
    assert {r.node_id: r.depth for r in hi.depths(nodes, edges).collect()} == {"r": 0, "a": 1, "b": 2, "c": 3}
    with pytest.raises(ValueError, match="own ancestor"):
        hi.closure(nodes, edges)


def test_reconciliation_plans_are_short(spark):
    for name in ("hi6_bottom_up", "hi7_top_down"):
        text = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert text.count("Scan ") < 40


@pytest.mark.parametrize("method", ["bottom_up", "top_down", "middle_out", "mint"])
def test_rows_of_leaves_are_not_shuffled(spark, graph, method):
    """Reconciled without the checks, only the sums of inner nodes go through an exchange."""
    fc = spark.createDataFrame([("g", n, 1.0) for n in NODES], "g string, node_id string, v double")
    out = hi.reconcile(stored(fc), *graph, method, ["g"], ["v"], middle_level="store", check=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [node_id" not in plan
    assert plan.count("Exchange hashpartitioning(g#") <= 3
    assert out.count() == len(NODES)


def test_distinct_texts_with_shared_hashes(spark):
    rows = spark.createDataFrame([(v,) for v in ["a", "b", "b", None, "c", "c", "c"]], "v string")
    assert dq.distinct_texts(rows, "v", "n").first().n == 3
    assert dq.distinct_texts(rows.filter("v = 'a' or v is null"), "v", "n").first().n == 1
    assert dq.distinct_texts(rows.limit(0), "v", "n").first().n == 0
