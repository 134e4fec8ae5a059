"""Data-quality checks: each returns the rows that violate it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.contracts import HierarchySpec
from foresail.functions.expr import any_of
from foresail.operators import hierarchy as hi
from foresail.operators.ledger import STATUS_TRANSITIONS, transition_allowed
from foresail.session import stored

PARTITION = ["target", "grain", "horizon", "segment_key_json", "metric_policy"]


def check_one_champion(champions: DataFrame) -> DataFrame:
    return (
        champions.filter("is_champion")
        .groupBy(*PARTITION)
        .agg(F.count(F.lit(1)).alias("champion_count"))
        .filter("champion_count > 1")
    )


def check_company_sales(train: DataFrame, company: DataFrame, tol: float = 0.001) -> DataFrame:
    """Company features of the train period against staged sums."""
    staged = train.groupBy("date").agg(F.sum("sales").alias("sales_company_staged"))
    built = company.filter("data_split_source = 'train'").select(
        "date", F.col("sales_company_l1d").alias("sales_company_int")
    )
    gap = F.abs(F.col("sales_company_staged") - F.col("sales_company_int")) > tol
    left, right = staged.withColumn("_s", F.lit(True)), built.withColumn("_i", F.lit(True))
    return (
        left.join(right, "date", "full_outer")
        .filter(F.col("_s").isNull() | F.col("_i").isNull() | gap)
        .drop("_s", "_i")
    )


def check_partition_key(board: DataFrame) -> DataFrame:
    """Comparable keys that stand for more than one semantic tuple."""
    return (
        board.select("comparable_partition_key", *PARTITION)
        .distinct()
        .groupBy("comparable_partition_key")
        .agg(F.count(F.lit(1)).alias("tuple_count"))
        .filter("tuple_count > 1")
    )


def check_spine(spine: DataFrame) -> DataFrame:
    """Dates missing between the first and last date of a spine."""
    expected = spine.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).filter("lo is not null").select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")
    )
    return expected.join(spine.select("date"), "date", "left_anti")


def check_target_date(outputs: DataFrame) -> DataFrame:
    expected = F.date_add(F.to_date("forecast_origin"), F.col("horizon").cast("int"))
    return outputs.filter(F.col("contract_enforced") & (F.col("target_date") != expected))


def check_registered_runs(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    return outputs.filter("contract_enforced").join(runs.select("forecast_run_id"), "forecast_run_id", "left_anti")


def check_registered_contracts(runs: DataFrame, contracts: DataFrame) -> DataFrame:
    keys = ["forecast_contract_name", "forecast_contract_hash"]
    return runs.join(contracts.select(*keys), keys, "left_anti")


def check_transitions(history: DataFrame) -> DataFrame:
    allowed = transition_allowed(F.col("previous_status"), F.col("new_status"), STATUS_TRANSITIONS)
    return history.filter(~allowed)


def check_accuracy_drift(rolling: DataFrame, tolerance: float = 0.25, train_scale: float = 1.0) -> DataFrame:
    """Rolling WAPE beyond the training-time WAPE by more than the tolerance.

    ``train_scale`` brings a training WAPE in percent (100) to a ratio.
    """
    limit = F.col("train_test_wape") / train_scale * (1 + tolerance)
    return rolling.filter(F.col("train_test_wape").isNotNull() & (F.col("wape_7d") > limit))


def check_fact_count(fact: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    parts = train.select(F.lit(1).alias("_x")).unionByName(test.select(F.lit(1).alias("_x")))
    total = parts.agg(F.count(F.lit(1)).alias("parts_count"))
    counted = fact.agg(F.count(F.lit(1)).alias("fct_count"))
    return counted.join(total, F.lit(True)).filter("fct_count <> parts_count")


def check_split_boundary(train: DataFrame, test: DataFrame, days: int = 16) -> DataFrame:
    """Test must start the day after train and span ``days`` dates."""
    a = train.agg(F.max("date").alias("max_train_date"))
    b = test.agg(F.min("date").alias("min_test_date"), F.count_distinct("date").alias("test_day_count"))
    wrong = (F.col("min_test_date") != F.date_add("max_train_date", 1)) | (F.col("test_day_count") != days)
    return a.join(b, F.lit(True)).filter(wrong)


# --- generic checks ---------------------------------------------------------------------
def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def check_accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))


def check_relationship(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def check_range(df: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    outside = []
    if lo is not None:
        outside.append(F.col(column) < F.lit(lo))
    if hi is not None:
        outside.append(F.col(column) > F.lit(hi))
    return df.filter(any_of(outside))


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(any_of([F.col(c).isNull() for c in columns]))


# --- acceptance reports --------------------------------------------------------------------
LINEAGE = (
    "forecast_origin",
    "target_date",
    "model_run_id",
    "model_id",
    "feature_version",
    "code_sha",
    "data_cutoff",
    "forecast_contract_hash",
    "forecast_status",
    "forecast_strategy",
    "calibration_method",
    "calibration_run_id",
    "reconciliation_method",
)


def publication_report(outputs: DataFrame, pubs: DataFrame, approvals: DataFrame, horizon: int = 7) -> DataFrame:
    """Acceptance counts of every run: outputs, lineage, quantiles, publications."""
    run = "forecast_run_id"
    wrong = (F.col("horizon") != horizon) | (
        F.date_diff("target_date", F.to_date("forecast_origin")) != horizon
    )
    unlinked = ~F.coalesce("contract_enforced", F.lit(False)) | any_of([F.col(c).isNull() for c in LINEAGE])
    crossed = (F.col("prediction_p10") > F.col("prediction_p50")) | (
        F.col("prediction_p50") > F.col("prediction_p90")
    )
    rows = outputs.groupBy(run).agg(
        F.count(F.lit(1)).alias("output_count"),
        F.count_distinct("entity_key_json").alias("entity_count"),
        F.count_if(wrong).alias("invalid_horizon_count"),
        F.count_if(unlinked).alias("missing_lineage_count"),
        F.count_if(crossed).alias("invalid_quantile_count"),
    )
    ids = ["approval_id", "forecast_output_id", run]
    found = approvals.select(*ids).withColumn("_a", F.col("approval_id"))
    lifecycle = pubs.join(found, ids, "left").groupBy(run).agg(
        F.count_distinct("_a").alias("approval_count"),
        F.count_distinct("publication_id").alias("publication_count"),
        F.count_if(F.col("delivery_status").isNull()).alias("missing_delivery_status_count"),
    )
    counts = [c for c in lifecycle.columns if c != run]
    return rows.join(lifecycle, run, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def distinct_texts(df: DataFrame, column: str, name: str) -> DataFrame:
    """Exact number of distinct values, NULLs aside, in one row.

    Rows are first counted by an 8-byte hash, which is all that is shuffled of them. A hash
    of one row is one value; only the rows of the other hashes are compared as texts.
    """
    known = df.select(column, F.xxhash64(column).alias("_hash")).filter(F.col(column).isNotNull())
    sizes = known.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.count_if(F.col("_n") == 1).alias("alone"), F.count_if(F.col("_n") > 1).alias("shared")).first()
    if not total.shared:
        return df.sparkSession.range(1).select(F.lit(total.alone).alias(name))
    several = stored(sizes.filter("_n > 1").select("_hash"))
    shared = known.join(several, "_hash", "left_semi").agg(F.count_distinct(column).alias("_shared"))
    return shared.select((F.lit(total.alone) + F.col("_shared")).alias(name))


def hierarchy_acceptance(
    outputs: DataFrame, nodes: DataFrame, edges: DataFrame, records: DataFrame, spec: HierarchySpec
) -> DataFrame:
    """One-row acceptance report of a reconciled, published hierarchy."""
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    ids = nodes.select("node_id")
    ends = hi.leaves(nodes, edges)
    present = outputs.select("node_id").distinct()
    parents = edges.groupBy("child_node_id").agg(F.count(F.lit(1)).alias("n"))
    p10, p50, p90 = (F.col(v) for v in hi.VALUES)
    lineage = ("hierarchy_version", "reconciliation_method", "reconciliation_run_id")
    facts = outputs.agg(
        F.count(F.lit(1)).alias("output_row_count"),
        F.count_if(any_of([p10.isNull(), p50.isNull(), p90.isNull()])).alias("missing_quantile_row_count"),
        F.count_if((p10 > p50) | (p50 > p90)).alias("invalid_quantile_order_count"),
        F.count_if(any_of([F.col(c).isNull() for c in lineage])).alias("missing_reconciliation_lineage_count"),
        F.count_if(
            (F.col("hierarchy_version") != spec.version) | (F.col("reconciliation_method") != spec.method)
        ).alias("invalid_reconciliation_lineage_count"),
    )
    link, count = "forecast_output_id", "linked_forecast_output_id_count"
    if records.sameSemantics(outputs):  # one relation: every known id is linked
        links = distinct_texts(outputs, link, count)
    else:
        linked = records.select(link).filter(F.col(link).isNotNull()).distinct()
        links = total(outputs.select(link).distinct().join(linked, link, "left_semi"), count)
    parts = [
        facts,
        total(nodes, "node_count"),
        total(edges, "edge_count"),
        total(hi.roots(nodes, edges), "root_count"),
        total(ends, "leaf_count"),
        total(parents.filter("n = 1"), "children_with_exactly_one_parent"),
        total(present.join(ids, "node_id", "left_anti"), "orphan_forecast_node_count"),
        total(ends.join(present, "node_id", "left_anti"), "missing_eligible_leaf_count"),
        total(records, "reconciliation_output_record_count"),
        distinct_texts(records, "reconciliation_output_id", "distinct_reconciliation_output_id_count"),
        links,
    ]
    for v in hi.VALUES:
        broken = hi.coherence_violations(outputs, edges, value=v, tol=spec.tolerance_abs)
        parts.append(total(broken, f"{v}_coherence_violations"))
    report = parts[0]
    for part in parts[1:]:
        report = report.join(F.broadcast(part), F.lit(True))
    return report


def violated(df: DataFrame, name: str) -> DataFrame:
    """Check name and number of violating rows, for a summary of many checks."""
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


