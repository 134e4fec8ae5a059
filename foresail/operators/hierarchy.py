"""Forecast hierarchies: validation, expansion and coherent reconciliation.

A hierarchy is two frames, nodes and single-parent edges. All groups (origin,
target, horizon) are reconciled in one plan. Upward sums go through the closure
(ancestor, leaf), whose aggregation combines on the map side, so a root over all
leaves does not funnel rows into one task; AQE splits the joins below it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresail.contracts import HierarchySpec
from foresail.functions.expr import (
    any_of,
    canonical_json,
    fingerprint,
    require,
    require_columns,
    stable_id,
)
from foresail.session import stored

GROUPS = ("forecast_origin", "target_date", "horizon")
VALUES = ("prediction_p10", "prediction_p50", "prediction_p90")
VARIANCE_FLOOR = 1e-12


def build_hierarchy(
    entities: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], name: str, version: str
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from distinct entities.

    ``levels`` goes from the root down: (level name, columns that key it). A
    node id is the level name and its key values; the root has no key.
    """
    def node_id(level: str, keys: Sequence[str]) -> Column:
        if not keys:
            return F.lit(f"{level}:all")
        return F.concat(F.lit(f"{level}:"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))

    tag = [F.lit(name).alias("hierarchy_name"), F.lit(version).alias("hierarchy_version")]
    nodes = edges = None
    for position, (level, keys) in enumerate(levels):
        members = entities.select(*keys).distinct() if keys else entities.limit(1).select()
        rows = members.select(
            *tag,
            node_id(level, keys).alias("node_id"),
            F.lit(level).alias("level_name"),
            F.lit(position).alias("level_position"),
            (canonical_json(list(keys)) if keys else F.lit("{}")).alias("node_key_json"),
        )
        nodes = rows if nodes is None else nodes.unionByName(rows)
        if position:
            above, above_keys = levels[position - 1]
            links = entities.select(*dict.fromkeys([*keys, *above_keys])).distinct().select(
                *tag,
                node_id(above, above_keys).alias("parent_node_id"),
                node_id(level, keys).alias("child_node_id"),
                F.lit(None).cast("double").alias("allocation_weight"),
            )
            edges = links if edges is None else edges.unionByName(links)
    return nodes, edges


def merge_hierarchy(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Insert nodes and edges that a hierarchy version does not have yet."""
    from foresail.sources.writers import insert_once

    node_key = stable_id(["hierarchy_name", "hierarchy_version", "node_id"])
    edge_key = stable_id(["hierarchy_name", "hierarchy_version", "parent_node_id", "child_node_id"])
    return {
        "nodes": insert_once(nodes.withColumn("node_key", node_key), f"{path}/nodes", "node_key"),
        "edges": insert_once(edges.withColumn("edge_key", edge_key), f"{path}/edges", "edge_key"),
    }


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rule violations of a hierarchy, one row each; empty means valid.

    Checks ids, endpoints, self edges and single parents by grouping, and
    reachability by walking down from the roots level by level: a node never
    reached sits on or under a cycle.
    """
    require_columns(nodes, ["node_id", "level_name"], "nodes")
    require_columns(edges, ["parent_node_id", "child_node_id"], "edges")
    nodes, edges = stored(nodes), stored(edges)
    ids = nodes.select("node_id")

    def rows(df: DataFrame, rule: str, node: str = "node_id") -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.col(node).cast("string").alias("node_id"))

    repeated = nodes.groupBy("node_id").count().filter("count > 1 or node_id is null")
    ends = edges.select(F.explode(F.array("parent_node_id", "child_node_id")).alias("node_id")).distinct()
    unknown = ends.join(ids, "node_id", "left_anti")
    selfish = edges.filter(F.col("parent_node_id") == F.col("child_node_id"))
    parents = edges.groupBy("child_node_id").count().filter("count > 1")
    reached = reachable(nodes, edges)
    lost = ids.join(reached, "node_id", "left_anti")
    return (
        rows(repeated, "node_id must be non-null and unique")
        .unionByName(rows(unknown, "edges reference unknown nodes"))
        .unionByName(rows(selfish, "edges cannot be self-referential", "child_node_id"))
        .unionByName(rows(parents, "every child must have exactly one parent", "child_node_id"))
        .unionByName(rows(lost, "node is unreachable from any root"))
    )


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    children = edges.select(F.col("child_node_id").alias("node_id"))
    return nodes.select("node_id").join(children, "node_id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parents = edges.select(F.col("parent_node_id").alias("node_id"))
    return nodes.select("node_id").join(parents, "node_id", "left_anti")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, depth of every node on some path from a root; roots have depth 0.

    The frontier of nodes first met goes down one edge at a time until it is empty, so
    depth is that of the edges, whatever the levels are called, and a cycle ends the walk.
    """
    links = stored(edges.select(F.col("parent_node_id").alias("node_id"), "child_node_id").distinct())
    frontier = stored(roots(nodes, edges).distinct().withColumn("depth", F.lit(0)))
    reached, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        below = frontier.join(links, "node_id").select(F.col("child_node_id").alias("node_id")).distinct()
        below = below.join(reached.select("node_id"), "node_id", "left_anti")
        frontier = stored(below.withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(frontier)
    return reached


def reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on some path from a root."""
    return depths(nodes, edges).select("node_id")


def validate_graph(nodes: DataFrame, edges: DataFrame) -> None:
    found = graph_violations(nodes, edges).limit(5).collect()
    if found:
        raise ValueError("invalid hierarchy: " + "; ".join(f"{r.rule} ({r.node_id})" for r in found))
    if roots(nodes, edges).isEmpty():
        raise ValueError("invalid hierarchy: no root")


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ancestor, node, distance, path_weight) over every path, node itself at 0.

    Each step joins the pairs' top end to its parent until no pair has one: one hash join
    a step, written, so later steps and readers do not repeat it. A pair of a node with
    itself would go round for ever and is an error.
    """
    weights = stored(child_weights(edges))
    own = nodes.select(
        F.col("node_id").alias("ancestor"),
        "node_id",
        F.lit(0).alias("distance"),
        F.lit(1.0).alias("path_weight"),
    )
    top = own
    out = own
    step = 0
    while True:
        step += 1
        up = top.join(weights, F.col("ancestor") == F.col("child_node_id")).select(
            F.col("parent_node_id").alias("ancestor"),
            "node_id",
            F.lit(step).alias("distance"),
            (F.col("path_weight") * F.col("weight")).alias("path_weight"),
        )
        top = stored(up)
        pairs, loops = top.agg(F.count(F.lit(1)), F.count_if(F.col("ancestor") == F.col("node_id"))).first()
        if loops:
            raise ValueError("invalid hierarchy: a node is its own ancestor")
        if not pairs:
            return out
        out = out.unionByName(top)


def leaf_closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, leaf, path_weight): the summing matrix in long form."""
    nodes, edges = stored(nodes), stored(edges)
    return _leaf_paths(closure(nodes, edges), nodes, edges)


def _leaf_paths(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return paths.join(leaves(nodes, edges), "node_id", "left_semi").select(
        F.col("ancestor").alias("node_id"), F.col("node_id").alias("leaf_id"), "path_weight"
    )


def child_weights(edges: DataFrame) -> DataFrame:
    """Share of each child in its parent; all equal where none is positive.

    Sums per parent by aggregation and joins them back, rather than windowing a
    parent's children, which may be a third of all nodes.
    """
    if "allocation_weight" in edges.columns:
        raw = F.greatest(F.coalesce(F.col("allocation_weight").cast("double"), F.lit(1.0)), F.lit(0.0))
    else:
        raw = F.lit(1.0)
    links = edges.select("parent_node_id", "child_node_id", raw.alias("_w"))
    totals = links.groupBy("parent_node_id").agg(F.sum("_w").alias("_total"), F.count("_w").alias("_n"))
    share = F.when(F.col("_total") == 0, 1 / F.col("_n")).otherwise(F.try_divide("_w", "_total"))
    return links.join(totals, "parent_node_id").select(
        "parent_node_id", "child_node_id", share.alias("weight")
    )


def expand_leaves(
    pred: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    leaf_keys: Sequence[str],
    groups: Sequence[str],
    check: bool = True,
) -> DataFrame:
    """Leaf predictions plus summed base forecasts of every ancestor.

    The id of an ancestor row digests its source ids independently of order.
    """
    nodes, edges = stored(nodes), stored(edges)
    parsed = nodes.join(leaves(nodes, edges), "node_id", "left_semi").select(
        "node_id", *[F.get_json_object("node_key_json", f"$.{k}").alias(f"_key_{k}") for k in leaf_keys]
    )
    on = [F.col(k).cast("string") == F.col(f"_key_{k}") for k in leaf_keys]
    mapped = pred.join(parsed, on, "left").drop(*[f"_key_{k}" for k in leaf_keys])
    if check:
        require(mapped, {"prediction has no hierarchy leaf": F.col("node_id").isNull()}, "leaf expansion")
        per_leaf = mapped.groupBy(*groups, "node_id").count()
        if not per_leaf.filter("count > 1").isEmpty():
            raise ValueError("leaf prediction groups must contain one row per hierarchy node")
        expected = leaves(nodes, edges).count()
        if not per_leaf.groupBy(*groups).count().filter(F.col("count") < expected).isEmpty():
            raise ValueError("hierarchy leaves have no eligible prediction rows")
    paths = leaf_closure(nodes, edges).filter(F.col("node_id") != F.col("leaf_id"))
    above = (
        mapped.select(*groups, F.col("node_id").alias("leaf_id"), "prediction", "prediction_id")
        .join(paths, "leaf_id")
        .groupBy(*groups, "node_id")
        .agg(F.sum("prediction").alias("prediction"), fingerprint("prediction_id").alias("_sources"))
    )
    identity = {g: F.col(g).cast("string") for g in groups} | {
        "node_id": F.col("node_id"),
        "sources": F.col("_sources"),
    }
    above = above.withColumn("prediction_id", stable_id(identity))
    columns = [*groups, "node_id", "prediction", "prediction_id"]
    return mapped.select(*columns).unionByName(above.select(*columns))


def _with_sums(at_leaves: DataFrame, fc: DataFrame, nodes, edges, groups, new) -> DataFrame:
    """Leaf rows as they are, and all other rows of ``fc`` with the sums over their leaves."""
    paths = leaf_closure(nodes, edges).filter(F.col("node_id") != F.col("leaf_id"))
    sums = (
        at_leaves.select(*groups, F.col("node_id").alias("leaf_id"), *new)
        .join(paths, "leaf_id")
        .groupBy(*groups, "node_id")
        .agg(*[F.sum(n).alias(n) for n in new])
    )
    inner = fc.join(leaves(nodes, edges), "node_id", "left_anti").join(sums, [*groups, "node_id"])
    return at_leaves.unionByName(inner.select(*at_leaves.columns))


def _bottom_up(fc: DataFrame, nodes, edges, groups, values) -> DataFrame:
    own = {f"_new_{v}": F.col(v) for v in values}
    at_leaves = fc.dropna(subset=groups).join(leaves(nodes, edges), "node_id", "left_semi").withColumns(own)
    return _with_sums(at_leaves, fc, nodes, edges, groups, list(own))


def _descended(fc: DataFrame, anchors: DataFrame, edges: DataFrame, groups, values) -> DataFrame:
    """Rows of the anchors and of all their descendants, with the anchor values passed down
    by weight, a level at a time.

    Every row knows its parent and meets the parent's value on (group, parent). Only the
    rows of a level that have children themselves are written and go on; the leaves, nearly
    all rows, are read when the result is.
    """
    weights = stored(child_weights(edges))
    inner = stored(weights.select(F.col("parent_node_id").alias("node_id")).distinct())
    new = [f"_new_{v}" for v in values]
    own = {f"_new_{v}": F.col(v).cast("double") for v in values}
    columns = [*fc.columns, *new]
    rows = fc.join(weights.withColumnRenamed("child_node_id", "node_id"), "node_id")
    level = fc.dropna(subset=groups).join(anchors.select("node_id").distinct(), "node_id", "left_semi").withColumns(own)
    out = None
    while True:
        ends = level.join(inner, "node_id", "left_anti").select(*columns)
        further = stored(level.join(inner, "node_id", "left_semi").select(*columns))
        out = ends.unionByName(further) if out is None else out.unionByName(ends).unionByName(further)
        if further.isEmpty():
            return out
        above = further.select(*groups, F.col("node_id").alias("parent_node_id"), *new)
        below = rows.join(above, [*groups, "parent_node_id"])
        level = below.withColumns({n: F.col(n) * F.col("weight") for n in new})


def _middle_out(fc, nodes, edges, groups, values, middle_level) -> DataFrame:
    anchors = nodes.filter(F.col("level_name") == middle_level).select("node_id")
    down = _descended(fc, anchors, edges, groups, values)
    covered = stored(down.select("node_id").distinct())
    ends = leaves(nodes, edges)
    # leaves outside every anchor keep their own base value, as do sums over them
    own = fc.dropna(subset=groups).withColumns({f"_new_{v}": F.col(v) for v in values}).join(
        ends, "node_id", "left_semi"
    ).join(covered, "node_id", "left_anti")
    at_leaves = down.join(ends, "node_id", "left_semi").unionByName(own)
    return _with_sums(at_leaves, fc, nodes, edges, groups, [f"_new_{v}" for v in values])


def _mint(fc, nodes, edges, groups, values, variances) -> DataFrame:
    """Least-squares projection with diagonal variances, exact for a tree.

    Upward, each node combines its own forecast with the sum of its children by
    inverse variance; downward, the parent's correction is shared out by the
    children's variances. One join per level and direction, no dense matrix.
    """
    links = edges.select("parent_node_id", "child_node_id")
    rank = stored(depths(nodes, edges).withColumnRenamed("depth", "_depth"))
    depth = rank.agg(F.max("_depth")).first()[0] or 0
    if variances is None:
        spread = F.lit(1.0)
        work = fc
    else:
        work = fc.join(variances.select("node_id", F.col("variance").alias("_var0")), "node_id", "left")
        spread = F.greatest(F.coalesce(F.col("_var0"), F.lit(1.0)), F.lit(VARIANCE_FLOOR))
    work = work.dropna(subset=groups).select(*fc.columns, spread.alias("_var")).join(rank, "node_id")
    # Upward, leaves first. Levels above the last are small and written: they are read
    # again on the way down. The last one is the forecasts as they came.
    ups: dict[int, DataFrame] = {}
    nothing = F.lit(None).cast("double")
    for level in range(depth, -1, -1):
        here = work.filter(F.col("_depth") == level)
        if level == depth:
            blended = {f"_up_{v}": F.col(v) for v in values} | {"_up_var": F.col("_var"), "_child_var": nothing}
            current = here.withColumns(blended | {f"_child_{v}": nothing for v in values})
        else:
            summed = (
                ups[level + 1]
                .join(links, F.col("node_id") == F.col("child_node_id"))
                .groupBy(*groups, F.col("parent_node_id").alias("_parent"))
                .agg(
                    F.sum("_up_var").alias("_child_var"),
                    *[F.sum(f"_up_{v}").alias(f"_child_{v}") for v in values],
                )
                .withColumnRenamed("_parent", "node_id")
            )
            gain = F.col("_child_var") / (F.col("_var") + F.col("_child_var"))
            blended = {
                f"_up_{v}": F.coalesce(
                    F.col(f"_child_{v}") + gain * (F.col(v) - F.col(f"_child_{v}")), F.col(v)
                )
                for v in values
            }
            blended["_up_var"] = F.coalesce(F.col("_var") * gain, F.col("_var"))
            current = here.join(summed, [*groups, "node_id"], "left").withColumns(blended)
        kept = [f"{p}{x}" for p in ("_up_", "_child_") for x in ("var", *values)]
        current = current.select(*fc.columns, *kept)
        ups[level] = current if level == depth else stored(current)
    # Downward: the parent's correction, shared out by variance.
    settled = ups[0].withColumns({f"_new_{v}": F.col(f"_up_{v}") for v in values})
    out, above = settled, settled
    for level in range(1, depth + 1):
        parent = above.select(
            *groups,
            F.col("node_id").alias("parent_node_id"),
            F.col("_child_var").alias("_total_var"),
            *[(F.col(f"_new_{v}") - F.col(f"_child_{v}")).alias(f"_gap_{v}") for v in values],
        )
        child = ups[level].join(links, F.col("node_id") == F.col("child_node_id")).drop("child_node_id")
        moved = child.join(parent, [*groups, "parent_node_id"]).withColumns(
            {
                f"_new_{v}": F.col(f"_up_{v}") + F.col(f"_gap_{v}") * F.col("_up_var") / F.col("_total_var")
                for v in values
            }
        )
        moved = moved.select(*settled.columns)
        above = moved if level == depth else stored(moved)
        out = out.unionByName(above)
    return out.select(*fc.columns, *[f"_new_{v}" for v in values])


def reconcile(
    fc: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    method: str,
    groups: Sequence[str] = GROUPS,
    values: Sequence[str] = VALUES,
    middle_level: str | None = None,
    variances: DataFrame | None = None,
    check: bool = True,
) -> DataFrame:
    """Coherent forecasts for every group and value; base values stay alongside."""
    groups, values = list(groups), list(values)
    require_columns(fc, ["node_id", *groups, *values], "forecasts")
    nodes, edges = stored(nodes), stored(edges)  # small, and read in every step
    if check:
        validate_graph(nodes, edges)
        _require_complete(fc, nodes, groups)
    if method == "bottom_up":
        new = _bottom_up(fc, nodes, edges, groups, values)
    elif method == "top_down":
        new = _descended(fc, roots(nodes, edges), edges, groups, values)
    elif method == "middle_out":
        if not middle_level:
            raise ValueError("middle_out requires a middle level")
        if check and nodes.filter(F.col("level_name") == middle_level).isEmpty():
            raise ValueError(f"middle level {middle_level!r} has no hierarchy nodes")
        new = _middle_out(fc, nodes, edges, groups, values, middle_level)
    elif method == "mint":
        new = _mint(fc, nodes, edges, groups, values, variances)
    else:
        raise ValueError(f"unsupported reconciliation method: {method!r}")
    joined = new.withColumnsRenamed({v: f"base_{v}" for v in values}).withColumnsRenamed(
        {f"_new_{v}": v for v in values}
    )
    if check and len(values) > 1:
        falls = [F.col(b) < F.col(a) for a, b in zip(values, values[1:])]
        crossed = F.coalesce(any_of(falls), F.lit(False))
        # checked inside the plan: a bad row fails the job before it commits
        stop = F.raise_error(F.lit("reconciliation produced crossed quantiles"))
        joined = joined.withColumns({v: F.when(crossed, stop).otherwise(F.col(v)) for v in values})
    return joined.withColumn("reconciliation_method", F.lit(method))


def _require_complete(fc: DataFrame, nodes: DataFrame, groups: Sequence[str]) -> None:
    known = fc.join(nodes.select("node_id"), "node_id", "left_semi")
    expected = nodes.count()
    sizes = known.groupBy(*groups).agg(F.count("node_id").alias("n"), F.count_distinct("node_id").alias("d"))
    require(
        sizes,
        {
            "forecast groups must contain one row per hierarchy node": F.col("n") != F.col("d"),
            "base forecasts are missing hierarchy nodes": F.col("d") < expected,
        },
        "reconciliation",
    )


def coherence_violations(
    fc: DataFrame,
    edges: DataFrame,
    groups: Sequence[str] = GROUPS,
    value: str = "prediction_p50",
    tol: float = 0.01,
) -> DataFrame:
    """Parents that differ from the sum of their children beyond ``tol``."""
    groups = list(groups)
    links = edges.select("parent_node_id", F.col("child_node_id").alias("node_id"))
    children = (
        fc.select(*groups, "node_id", F.col(value).cast("double").alias("_v"))
        .join(links, "node_id")
        .groupBy(*groups, "parent_node_id")
        .agg(F.sum("_v").alias("_children"))
    )
    # the parents' rows alone are joined: leaves are nearly all rows
    inner = stored(edges.select(F.col("parent_node_id").alias("node_id")).distinct())
    parent = fc.join(inner, "node_id", "left_semi")
    parent = parent.select(*groups, F.col("node_id").alias("parent_node_id"), F.col(value).cast("double").alias("_p"))
    gap = F.col("_p") - F.col("_children")
    return (
        parent.join(children, [*groups, "parent_node_id"])
        .select(*groups, "parent_node_id", gap.alias("difference"))
        .filter(F.abs("difference") > tol)
    )


def reconciliation_records(
    fc: DataFrame, spec: HierarchySpec, forecast_run_id: str, at: Column
) -> tuple[DataFrame, DataFrame]:
    """Deterministic run row and output rows of a reconciliation."""
    from foresail.contracts import _hash

    run_id = _hash({"forecast_run_id": forecast_run_id, "hierarchy": spec.hash, "method": spec.method})
    identity = {n: F.col(n).cast("string") for n in ("node_id", *GROUPS)} | {
        "reconciliation_run_id": F.lit(run_id)
    }
    outputs = fc.withColumns(
        {
            "reconciliation_run_id": F.lit(run_id),
            "reconciliation_output_id": stable_id(identity),
            "forecast_run_id": F.lit(forecast_run_id),
            "hierarchy_name": F.lit(spec.name),
            "hierarchy_version": F.lit(spec.version),
            "created_at": at,
        }
    )
    run = outputs.groupBy(
        "reconciliation_run_id", "forecast_run_id", "hierarchy_name", "hierarchy_version", "reconciliation_method"
    ).agg(F.count(F.lit(1)).alias("input_row_count")).withColumns(
        {
            "output_row_count": F.col("input_row_count"),
            "tolerance_abs": F.lit(spec.tolerance_abs),
            "run_status": F.lit("completed"),
            "violation_count": F.lit(0),
            "started_at": at,
        }
    )
    return run, outputs


def hierarchy_nodes_report(nodes: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per node: level, parent, average base and reconciled median, delta."""
    links = edges.select(F.col("child_node_id").alias("node_id"), F.col("parent_node_id").alias("parent_id"))
    values = outputs.groupBy("node_id").agg(
        F.avg("base_prediction_p50").alias("base_p50"), F.avg("prediction_p50").alias("reconciled_p50")
    )
    return (
        nodes.select("node_id", "level_name", "level_position", "node_key_json")
        .join(links, "node_id", "left")
        .join(values, "node_id", "left")
        .withColumn("delta", F.col("reconciled_p50") - F.col("base_p50"))
    )


def hierarchy_report(
    nodes: DataFrame, edges: DataFrame, outputs: DataFrame, tol: float = 0.01
) -> DataFrame:
    """Five gates over a reconciled hierarchy, one row each."""
    nodes, edges = stored(nodes), stored(edges)
    root = nodes.agg(F.min("level_position")).first()[0]
    parents = edges.groupBy(F.col("child_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_parents"))
    below = nodes.filter(F.col("level_position") > F.lit(root))
    one_parent = below.join(parents, "node_id", "left").agg(
        F.count_if(F.coalesce("_parents", F.lit(0)) != 1).alias("violation_count")
    )
    ids = nodes.select("node_id")
    cyclic = ids.join(reachable(nodes, edges), "node_id", "left_anti").agg(
        F.count(F.lit(1)).alias("violation_count")
    )
    coherent = coherence_violations(outputs, edges, tol=tol).agg(F.count(F.lit(1)).alias("violation_count"))
    p10, p50, p90 = (F.col(v) for v in VALUES)
    missing = p10.isNull() | p50.isNull() | p90.isNull()
    quantiles = outputs.agg(
        F.count_if(missing).alias("m"), F.count_if(~((p10 <= p50) & (p50 <= p90))).alias("u")
    )
    gates = [
        ("Exactly one parent", one_parent),
        ("Acyclic hierarchy", cyclic),
        ("Coherent child totals", coherent),
        ("All quantiles reconciled", quantiles.select(F.col("m").alias("violation_count"))),
        ("Ordered quantiles", quantiles.select(F.col("u").alias("violation_count"))),
    ]
    out = None
    for name, df in gates:
        row = df.select(
            F.lit(name).alias("gate"),
            (F.col("violation_count") == 0).alias("passed"),
            "violation_count",
        )
        out = row if out is None else out.unionByName(row)
    return out
