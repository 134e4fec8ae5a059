"""Canonical demand, eligibility and the frozen candidate population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresail.contracts import ForecastContract
from foresail.functions.expr import (
    all_of,
    blank,
    canonical_json,
    fingerprint,
    require,
    require_columns,
    require_unique,
    safe_divide,
    stable_id,
)

REASONS = (
    "store_closed",
    "product_inactive",
    "outside_assortment",
    "stockout",
    "no_observed_history",
    "insufficient_history",
)
SAMPLE_SIZE = 100


def demand_daily(fact: DataFrame) -> DataFrame:
    """Store-day demand. Without inventory data observed sales stand in for
    unconstrained demand and the availability fields take their defaults."""
    day = fact.groupBy("date", "store_nbr").agg(
        F.max("data_split_source").alias("data_split_source"),
        F.sum("sales").alias("observed_sales_units"),
        F.coalesce(F.bool_or(F.col("on_promotion") == 1), F.lit(False)).alias("promotion_planned"),
    )
    money, flag = F.lit(None).cast("decimal(38,9)"), F.lit(None).cast("boolean")
    return day.select(
        "date",
        "store_nbr",
        "data_split_source",
        "observed_sales_units",
        F.col("observed_sales_units").alias("unconstrained_demand_units"),
        F.lit("observed_sales_only").alias("demand_policy"),
        "promotion_planned",
        money.alias("unit_price"),
        F.lit(False).alias("has_inventory_data"),
        money.alias("on_hand_units"),
        flag.alias("is_stockout"),
        flag.alias("is_demand_censored"),
        F.lit(True).alias("assortment_active"),
        F.lit(True).alias("store_open"),
        F.lit(True).alias("product_active"),
        F.lit("availability_not_provided").alias("availability_status"),
    )


def eligibility(
    demand: DataFrame, min_days: int = 28, policy: str = "observed_sales_only"
) -> DataFrame:
    """Per store and day: enough observed history and open for business?

    The running count is ordered inside one store, whose rows are one per day.
    """
    store = Window.partitionBy("store_nbr")
    running = store.orderBy(F.unix_date("date")).rowsBetween(Window.unboundedPreceding, 0)
    observed = F.col("observed_sales_units").isNotNull()
    history = demand.withColumns(
        {
            "first_observed_date": F.min(F.when(observed, F.col("date"))).over(store),
            "observed_history_days": F.count_if(observed).over(running),
        }
    )
    stockout = F.col("is_stockout") if policy == "exclude_stockout_days" else F.lit(False)
    reason = (
        F.when(~F.col("store_open"), "store_closed")
        .when(~F.col("product_active"), "product_inactive")
        .when(~F.col("assortment_active"), "outside_assortment")
        .when(stockout, "stockout")
        .when(F.col("first_observed_date").isNull(), "no_observed_history")
        .when(F.col("observed_history_days") < min_days, "insufficient_history")
    )
    return history.select(
        canonical_json({"store_id": F.col("store_nbr").cast("string")}).alias("entity_key_json"),
        "date",
        "store_nbr",
        reason.isNull().alias("is_eligible"),
        reason.alias("ineligibility_reason"),
        "assortment_active",
        "store_open",
        "product_active",
        (F.col("observed_history_days") >= min_days).alias("has_required_history"),
        "observed_history_days",
        "first_observed_date",
        "has_inventory_data",
        "is_stockout",
        F.lit(policy).alias("demand_policy"),
        "observed_sales_units",
        "unconstrained_demand_units",
        "promotion_planned",
        "unit_price",
        "data_split_source",
    )


def eligibility_summary(elig: DataFrame) -> DataFrame:
    """Counts by reason per date and policy with a sample of the exclusions.

    The sample is the first hundred excluded keys. Rows are ranked below the
    limit before they are collected, so one list never exceeds a hundred; the
    rank itself is a limited one, which Spark prunes before the shuffle.
    """
    groups = ["date", "demand_policy"]
    first = Window.partitionBy(*groups).orderBy("entity_key_json")
    sample = (
        elig.filter(~F.col("is_eligible"))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= SAMPLE_SIZE)
        .groupBy(*groups)
        .agg(F.array_sort(F.collect_list(F.struct("entity_key_json", "ineligibility_reason"))).alias("_s"))
    )
    counts = elig.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("candidate_entity_count"),
        F.count_if("is_eligible").alias("eligible_entity_count"),
        F.count_if(~F.col("is_eligible")).alias("excluded_entity_count"),
        *[F.count_if(F.col("ineligibility_reason") == r).alias(f"{r}_count") for r in REASONS],
    )
    return counts.join(sample, groups, "left").select(
        F.col("date").alias("eligibility_date"),
        "demand_policy",
        "candidate_entity_count",
        "eligible_entity_count",
        "excluded_entity_count",
        safe_divide("eligible_entity_count", "candidate_entity_count").alias("eligibility_ratio"),
        *[f"{r}_count" for r in REASONS],
        F.to_json("_s").alias("exclusion_sample_json"),
    )


SUMMARY_COLUMNS = [
    "demand_policy",
    "candidate_entity_count",
    "eligible_entity_count",
    "excluded_entity_count",
    "eligibility_ratio",
    *[f"{r}_count" for r in REASONS],
    "exclusion_sample_json",
]


def run_eligibility(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """Eligibility evidence of every run, with what is missing named."""
    evidence = summary.select(F.col("eligibility_date").alias("_day"), *SUMMARY_COLUMNS)
    status = (
        F.when(F.col("eligibility_snapshot_id").isNull(), "missing_snapshot_id")
        .when(F.col("_day").isNull(), "missing_eligibility_summary")
        .otherwise("complete")
    )
    return runs.join(evidence, F.to_date("forecast_origin") == F.col("_day"), "left").select(
        "forecast_run_id",
        "forecast_contract_name",
        "forecast_origin",
        "eligibility_snapshot_id",
        *SUMMARY_COLUMNS,
        status.alias("eligibility_evidence_status"),
    )


def candidate_key(dims: Sequence[str], date: str = "date", horizon: str = "forecast_horizon") -> Column:
    """Canonical key of one (entity, target date, horizon) candidate."""
    entity = F.struct(*[F.col(d).alias(d) for d in sorted(dims)])
    target = F.date_add(F.to_date(date), F.col(horizon).cast("int"))
    return F.to_json(
        F.struct(
            entity.alias("entity"),
            F.col(horizon).cast("int").alias("horizon"),
            target.cast("string").alias("target_date"),
        ),
        {"ignoreNullFields": "false"},
    )


def snapshot(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row: digest and size of a frozen population, whatever its order.

    Row digests are summed rather than sorted and joined, so the population is
    never collected anywhere.
    """
    require_columns(rows, [*dims, "date", "forecast_horizon"], "eligibility snapshot")
    return rows.agg(
        fingerprint(candidate_key(dims)).alias("eligibility_snapshot_id"),
        F.count(F.lit(1)).alias("population"),
    )


def snapshot_id(rows: DataFrame, dims: Sequence[str]) -> str:
    return snapshot(rows, dims).first()["eligibility_snapshot_id"]


def eligibility_decisions(
    rows: DataFrame, c: ForecastContract, run_id: Column | str, snapshot: Column | str, decided_at: Column
) -> DataFrame:
    """Append-only decision per candidate; exclusions must say why."""
    dims = list(c.dimensions)
    work = rows if "is_eligible" in rows.columns else rows.withColumn("is_eligible", F.lit(True))
    for name, value in (("ineligibility_reason", None), ("has_exception", False)):
        if name not in work.columns:
            work = work.withColumn(name, F.lit(value).cast("string" if value is None else "boolean"))
    require(
        work,
        {
            "candidate without an explicit decision": F.col("is_eligible").isNull(),
            "excluded candidate without a reason": ~F.col("is_eligible") & blank("ineligibility_reason"),
        },
        "eligibility decisions",
    )
    require_unique(work, [*dims, "date", "forecast_horizon"], "eligibility candidates")
    return decision_rows(work, c, run_id, snapshot, decided_at)


def decision_rows(work, c: ForecastContract, run_id, snapshot, decided_at) -> DataFrame:
    key = candidate_key(c.dimensions)
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    shot = F.lit(snapshot) if isinstance(snapshot, str) else snapshot
    return work.select(
        stable_id({"candidate_key": key, "forecast_run_id": run}).alias("eligibility_decision_id"),
        run.alias("forecast_run_id"),
        shot.alias("eligibility_snapshot_id"),
        F.lit(c.name).alias("forecast_contract_name"),
        F.lit(c.hash).alias("forecast_contract_hash"),
        F.col("date").alias("forecast_origin"),
        canonical_json(list(c.dimensions)).alias("entity_key_json"),
        F.date_add(F.to_date("date"), F.col("forecast_horizon").cast("int")).alias("target_date"),
        F.col("forecast_horizon").alias("horizon"),
        "is_eligible",
        F.when(~F.col("is_eligible"), F.col("ineligibility_reason")).alias("ineligibility_reason"),
        F.coalesce("has_exception", F.lit(False)).alias("has_exception"),
        decided_at.alias("decided_at"),
    )


def population_diff(scored: DataFrame, eligible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only; an empty result means an exact match."""
    keys = list(keys)
    left = scored.select(*keys).withColumn("_scored", F.lit(True))
    right = eligible.select(*keys).withColumn("_eligible", F.lit(True))
    return (
        left.join(right, keys, "full_outer")
        .filter(~all_of([F.col("_scored").isNotNull(), F.col("_eligible").isNotNull()]))
        .select(
            *keys,
            F.when(F.col("_scored").isNull(), "not_scored").otherwise("not_eligible").alias("mismatch"),
        )
    )
