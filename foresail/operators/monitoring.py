"""Health marts over data, runs, publications, deliveries, costs and accuracy.

Every mart takes its evaluation instant as a parameter; nothing reads the clock.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresail.functions.expr import (
    any_of,
    blank,
    require,
    safe_divide,
    stable_id,
)
from foresail.operators.ledger import latest_by


@dataclass(frozen=True)
class DriftMetric:
    name: str
    kind: str = "demand"
    column: str | None = None


def _constant(value, kind: str) -> Column:
    return F.lit(value).cast(kind)


def data_drift(
    df: DataFrame,
    metrics: Sequence[DriftMetric],
    window: int = 28,
    min_obs: int = 30,
    max_smd: float = 0.5,
    date: str = "date",
    source_model: str = "panel",
) -> DataFrame:
    """Latest window against the one before it, for all metrics in one pass.

    The latest date of each metric comes from a first aggregate (a handful of
    numbers); the metrics of a row are then unpivoted and summarised together,
    instead of scanning the table once per metric.
    """
    if not metrics:
        return _drift_row(df, min_obs, max_smd)
    value = {m.name: F.expr(f"try_cast({m.column or m.name} as double)") for m in metrics}
    latest = df.agg(
        *[F.max(F.when(F.col(m.column or m.name).isNotNull(), F.col(date))).alias(m.name) for m in metrics]
    ).first()
    entries = [
        F.struct(
            F.lit(m.name).alias("metric_name"),
            F.lit(m.kind).alias("metric_type"),
            F.lit(latest[m.name]).cast("date").alias("_latest"),
            F.col(m.column or m.name).isNotNull().alias("_present"),
            value[m.name].alias("_v"),
        )
        for m in metrics
    ]
    known = [d for d in latest if d is not None]
    rows = df
    if known:
        # a literal lower bound: only two windows of the history are read
        import datetime as dt

        rows = df.filter(F.col(date) > F.lit(min(known) - dt.timedelta(days=2 * window)))
    long = rows.select(F.col(date).alias("_d"), F.inline(F.array(*entries))).filter("_present")
    age = F.date_diff("_latest", "_d")
    recent, before = (age >= 0) & (age < window), (age >= window) & (age < 2 * window)
    part = lambda c: F.when(c, F.col("_v"))
    summary = long.groupBy("metric_name", "metric_type", "_latest").agg(
        F.count_if(recent).alias("recent_observation_count"),
        F.count_if(before).alias("reference_observation_count"),
        F.avg(part(recent)).alias("recent_mean"),
        F.avg(part(before)).alias("reference_mean"),
        F.stddev_pop(part(recent)).alias("recent_stddev"),
        F.stddev_pop(part(before)).alias("reference_stddev"),
    )
    # a metric with no value at all still reports one row
    names = df.sparkSession.createDataFrame(
        [(m.name, m.kind) for m in metrics], "metric_name string, metric_type string"
    )
    summary = names.join(summary, ["metric_name", "metric_type"], "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit(0)) for n in ("recent_observation_count", "reference_observation_count")}
    )
    pooled = F.sqrt((F.pow("recent_stddev", F.lit(2)) + F.pow("reference_stddev", F.lit(2))) / 2)
    gap = F.abs(F.col("recent_mean") - F.col("reference_mean"))
    smd = safe_divide(gap, pooled)
    few = (F.col("recent_observation_count") < min_obs) | (F.col("reference_observation_count") < min_obs)
    shifted = (pooled == 0) & (F.col("recent_mean") != F.col("reference_mean"))
    status = (
        F.when(few, "insufficient_observations")
        .when(shifted, "drifted")
        .when(smd > max_smd, "drifted")
        .otherwise("healthy")
    )
    day = F.col("_latest")
    return summary.select(
        F.lit(source_model).alias("source_model"),
        "metric_name",
        "metric_type",
        F.date_sub(day, window - 1).alias("recent_window_start_date"),
        day.alias("recent_window_end_date"),
        F.date_sub(day, 2 * window - 1).alias("reference_window_start_date"),
        F.date_sub(day, window).alias("reference_window_end_date"),
        "recent_observation_count",
        "reference_observation_count",
        "recent_mean",
        "reference_mean",
        "recent_stddev",
        "reference_stddev",
        smd.alias("standardized_mean_difference"),
        F.lit(min_obs).alias("minimum_observation_count"),
        F.lit(float(max_smd)).alias("maximum_standardized_mean_difference"),
        status.alias("drift_status"),
        (status == "drifted").alias("is_alerting"),
    )


def _drift_row(df: DataFrame, min_obs: int, max_smd: float) -> DataFrame:
    spec = {
        "source_model": "string", "metric_name": "string", "metric_type": "string",
        "recent_window_start_date": "date", "recent_window_end_date": "date",
        "reference_window_start_date": "date", "reference_window_end_date": "date",
    }
    numbers = ["recent_mean", "reference_mean", "recent_stddev", "reference_stddev", "standardized_mean_difference"]
    return df.sparkSession.range(1).select(
        *[_constant(None, k).alias(n) for n, k in spec.items()],
        F.lit(0).cast("long").alias("recent_observation_count"),
        F.lit(0).cast("long").alias("reference_observation_count"),
        *[_constant(None, "double").alias(n) for n in numbers],
        F.lit(min_obs).alias("minimum_observation_count"),
        F.lit(float(max_smd)).alias("maximum_standardized_mean_difference"),
        F.lit("not_configured").alias("drift_status"),
        F.lit(True).alias("is_alerting"),
    )


@dataclass(frozen=True)
class CompletenessSpec:
    model: str
    entity: str
    required: tuple[str, ...]
    date: str = "date"


def feature_completeness(
    df: DataFrame, spec: CompletenessSpec | None, min_ratio: float = 0.99, min_entities: float = 0.95
) -> DataFrame:
    """Missing cells on the latest date and entity coverage against the date before.

    The two dates are found first and become a literal filter, so only their
    rows (two partitions) are scanned.
    """
    limits = [
        F.lit(float(min_ratio)).alias("minimum_completeness_ratio"),
        F.lit(float(min_entities)).alias("minimum_entity_coverage_ratio"),
    ]
    if spec is None:
        counts = ["row_count", "entity_count", "previous_entity_count", "missing_required_value_count",
                  "required_feature_count"]
        return df.sparkSession.range(1).select(
            _constant(None, "string").alias("feature_model"),
            _constant(None, "date").alias("feature_date"),
            *[F.lit(0).cast("long").alias(c) for c in counts],
            _constant(None, "double").alias("completeness_ratio"),
            _constant(None, "double").alias("entity_coverage_ratio"),
            *limits,
            F.lit("not_configured").alias("feature_completeness_status"),
            F.lit(True).alias("is_alerting"),
        )
    dated = df.filter(F.col(spec.date).isNotNull())
    newest = [r[0] for r in dated.select(spec.date).distinct().orderBy(F.desc(spec.date)).limit(2).collect()]
    width = len(spec.required)
    missing = sum((F.count_if(F.col(c).isNull()) for c in spec.required[1:]), F.count_if(F.col(spec.required[0]).isNull()))
    per_day = dated.filter(F.col(spec.date).isin(newest)).groupBy(spec.date).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(spec.entity).alias("entity_count"),
        missing.alias("missing_required_value_count"),
    )
    at = lambda i: F.lit(newest[i] if len(newest) > i else None).cast("date")
    latest = per_day.filter(F.col(spec.date) == at(0))
    previous = per_day.filter(F.col(spec.date) == at(1)).select(F.col("entity_count").alias("_previous"))
    cells = F.col("row_count") * width
    complete = safe_divide(cells - F.col("missing_required_value_count"), cells)
    before = F.coalesce("_previous", "entity_count")
    coverage = safe_divide("entity_count", before)
    status = (
        F.when(F.col("row_count") == 0, "missing_rows")
        .when(complete < min_ratio, "missing_required_values")
        .when(coverage < min_entities, "entity_coverage_low")
        .otherwise("healthy")
    )
    return latest.join(previous, F.lit(True), "left").select(
        F.lit(spec.model).alias("feature_model"),
        F.col(spec.date).alias("feature_date"),
        "row_count",
        "entity_count",
        before.alias("previous_entity_count"),
        "missing_required_value_count",
        F.lit(width).cast("long").alias("required_feature_count"),
        complete.alias("completeness_ratio"),
        coverage.alias("entity_coverage_ratio"),
        *limits,
        status.alias("feature_completeness_status"),
        (status != "healthy").alias("is_alerting"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    return latest_by(
        runs, ["forecast_contract_name"], [F.desc("started_at"), F.desc("forecast_run_id")]
    )


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def prediction_coverage(runs: DataFrame, outputs: DataFrame, min_ratio: float = 0.98) -> DataFrame:
    """Distinct outputs of each contract's latest run over its declared rows.

    Outputs of other runs are dropped by the join before they are counted.
    """
    newest = latest_runs(runs).select(
        "forecast_run_id",
        "forecast_contract_name",
        "forecast_origin",
        F.col("row_count").alias("expected_output_count"),
    )
    made = outputs.join(newest.select("forecast_run_id"), "forecast_run_id", "left_semi").groupBy("forecast_run_id").agg(
        F.count(F.lit(1)).alias("predicted_output_count"),
        F.count_distinct("forecast_output_id").alias("distinct_output_count"),
        F.count_distinct("horizon").alias("horizon_count"),
        F.count_if(F.col("prediction_p50").isNull()).alias("missing_point_forecast_count"),
    )
    counts = ["predicted_output_count", "distinct_output_count", "horizon_count", "missing_point_forecast_count"]
    joined = newest.join(made, "forecast_run_id", "left").withColumns({c: _zero(c) for c in counts})
    ratio = safe_divide("distinct_output_count", "expected_output_count")
    expected = F.col("expected_output_count")
    status = (
        F.when(expected.isNull() | (expected <= 0), "invalid_scope")
        .when(F.col("missing_point_forecast_count") > 0, "missing_predictions")
        .when(ratio < min_ratio, "below_threshold")
        .otherwise("healthy")
    )
    return joined.withColumns(
        {
            "coverage_ratio": ratio,
            "minimum_coverage_ratio": F.lit(float(min_ratio)),
            "coverage_status": status,
            "is_alerting": status != "healthy",
        }
    )


def pipeline_health(
    runs: DataFrame, stages: DataFrame, checks: DataFrame, outputs: DataFrame, elig: DataFrame
) -> DataFrame:
    """Latest run per contract with stage, gate, output and eligibility evidence.

    Each ledger is cut down to the latest runs, then aggregated once per run.
    """
    newest = latest_runs(runs)
    ids = newest.select("forecast_run_id")
    run = "forecast_run_id"
    per = lambda df: df.join(ids, run, "left_semi").groupBy(run)
    s = per(stages).agg(
        F.count(F.lit(1)).alias("stage_count"),
        F.count_if(F.col("stage_status") != "completed").alias("unsuccessful_stage_count"),
        F.max("stage_position").alias("maximum_stage_position"),
    )
    blocking = F.col("severity") == "blocking"
    c = per(checks).agg(
        F.count_if(blocking).alias("blocking_check_count"),
        F.count_if(blocking & ~F.col("passed")).alias("failed_blocking_check_count"),
    )
    o = per(outputs).agg(
        F.count(F.lit(1)).alias("persisted_output_count"),
        F.count_distinct("forecast_output_id").alias("distinct_output_count"),
        F.count_distinct("horizon").alias("horizon_count"),
        F.count_if(
            any_of([F.col(f"prediction_{q}").isNull() for q in ("p10", "p50", "p90")])
        ).alias("missing_quantile_count"),
    )
    e = per(elig).agg(
        F.count(F.lit(1)).alias("persisted_candidate_count"),
        F.count_if("is_eligible").alias("persisted_eligible_count"),
        F.count_if(~F.col("is_eligible")).alias("persisted_excluded_count"),
        F.count_if("has_exception").alias("persisted_exception_count"),
        F.count_if(~F.col("is_eligible") & blank("ineligibility_reason")).alias("unexplained_exclusion_count"),
        F.count_distinct("eligibility_snapshot_id").alias("_snapshots"),
        F.min("eligibility_snapshot_id").alias("_snapshot"),
    )
    joined = newest
    for part in (s, c, o, e):
        joined = joined.join(part, run, "left")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    col = F.col
    status = (
        F.when(~col("run_status").isin("succeeded", "draft"), "failed")
        .when(n("unsuccessful_stage_count") > 0, "failed")
        .when(n("failed_blocking_check_count") > 0, "gates_failed")
        .when(n("persisted_candidate_count") == 0, "missing_eligibility_evidence")
        .when(
            (col("_snapshots") != 1) | (col("_snapshot") != col("eligibility_snapshot_id")),
            "eligibility_snapshot_mismatch",
        )
        .when(n("unexplained_exclusion_count") > 0, "unexplained_exclusions")
        .when(
            (col("candidate_count") != col("persisted_candidate_count"))
            | (col("eligible_count") != col("persisted_eligible_count"))
            | (col("excluded_count") != col("persisted_excluded_count"))
            | (col("exception_count") != col("persisted_exception_count"))
            | (
                col("persisted_candidate_count")
                != col("persisted_eligible_count") + col("persisted_excluded_count")
            ),
            "eligibility_accounting_mismatch",
        )
        .when(n("persisted_output_count") == 0, "missing_outputs")
        .when(col("persisted_output_count") != col("distinct_output_count"), "duplicate_outputs")
        .when(col("row_count") != col("persisted_output_count"), "cardinality_mismatch")
        .when(col("persisted_eligible_count") != col("persisted_output_count"), "eligible_prediction_mismatch")
        .when(n("missing_quantile_count") > 0, "missing_quantiles")
        .otherwise("healthy")
    )
    counted = [x for part in (s, c, o, e) for x in part.columns if x != run and not x.startswith("_")]
    return (
        joined.withColumn("health_status", status)
        .withColumns({x: _zero(x) for x in counted})
        .drop("_snapshots", "_snapshot")
    )


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes elapsed, truncated toward zero."""
    seconds = F.unix_timestamp(later) - F.unix_timestamp(earlier)
    return (F.signum(seconds) * F.floor(F.abs(seconds) / 60)).cast("long")


def publication_freshness(
    runs: DataFrame,
    pbr: DataFrame,
    ingestion: DataFrame,
    at: Column,
    threshold: int = 1440,
    contracts: Sequence[str] | None = None,
) -> DataFrame:
    """Age of each contract's latest publication; a static demo never alerts."""
    scope = runs if not contracts else runs.filter(F.col("forecast_contract_name").isin(*contracts))
    newest = latest_runs(scope).select(
        "forecast_contract_name", F.col("forecast_run_id").alias("latest_forecast_run_id"), "forecast_origin"
    )
    published = pbr.groupBy("forecast_contract_name").agg(
        F.max("published_at").alias("latest_published_at"),
        F.count_distinct("publication_id").alias("publication_count"),
        F.count_if(~F.col("delivery_status").isin("delivered", "published")).alias("unconfirmed_delivery_count"),
    )
    mode = ingestion.agg(
        F.when(
            (F.count(F.lit(1)) > 0) & (F.count_if(F.col("data_mode") == "continuous") == 0), "static_demo"
        ).otherwise("continuous").alias("data_mode")
    )
    joined = (
        newest.join(published, "forecast_contract_name", "left")
        .join(F.broadcast(mode), F.lit(True))
        .withColumns(
            {
                "publication_count": _zero("publication_count"),
                "unconfirmed_delivery_count": _zero("unconfirmed_delivery_count"),
                "evaluated_at": at,
                "threshold_minutes": F.lit(threshold),
                "publication_age_minutes": minutes_between(at, F.col("latest_published_at")),
            }
        )
    )
    status = (
        F.when(F.col("data_mode") == "static_demo", "static_demo")
        .when(F.col("latest_published_at").isNull(), "missing")
        .when(F.col("publication_age_minutes") > threshold, "stale")
        .otherwise("fresh")
    )
    return joined.withColumns(
        {"freshness_status": status, "is_alerting": status.isin("missing", "stale")}
    )


def realized_calibration(
    outputs: DataFrame,
    demand: DataFrame,
    at: Column,
    window: int = 28,
    min_actuals: int = 30,
    min_coverage: float = 0.8,
    max_bias: float = 0.1,
    entity_key: str = "store_id",
) -> DataFrame:
    """Coverage, median bias and width of matured forecasts per contract and horizon."""
    last = F.to_date(at)
    store = F.expr(f"try_cast(get_json_object(entity_key_json, '$.{entity_key}') as long)")
    matured = outputs.filter(F.col("target_date").between(F.date_sub(last, window - 1), last)).select(
        "forecast_contract_name",
        "horizon",
        "target_date",
        store.alias("_store"),
        "prediction_p10",
        "prediction_p50",
        "prediction_p90",
    ).filter(F.col("_store").isNotNull())
    actuals = demand.select(
        F.col("date").alias("target_date"),
        F.col("store_nbr").alias("_store"),
        F.col("observed_sales_units").cast("double").alias("actual"),
    )
    joined = matured.join(actuals, ["target_date", "_store"], "left")
    actual = F.col("actual")
    error = F.when(actual.isNotNull(), F.col("prediction_p50") - actual)
    inside = F.coalesce(actual.between(F.col("prediction_p10"), F.col("prediction_p90")), F.lit(False))
    summary = joined.groupBy("forecast_contract_name", "horizon").agg(
        F.count(F.lit(1)).alias("matured_forecast_count"),
        F.count(actual).alias("realized_actual_count"),
        safe_divide(F.count(actual), F.count(F.lit(1))).alias("realized_actual_ratio"),
        safe_divide(F.count_if(inside), F.count(actual)).alias("interval_coverage_ratio"),
        F.percentile_approx(error, 0.5, 100000).alias("median_bias"),
        F.avg(actual).alias("_mean"),
        F.avg(F.when(actual.isNotNull(), F.col("prediction_p90") - F.col("prediction_p10"))).alias("mean_interval_width"),
    ).withColumn("normalized_median_bias", safe_divide("median_bias", "_mean"))
    bias = F.col("normalized_median_bias")
    status = (
        F.when(F.col("realized_actual_count") < min_actuals, "insufficient_actuals")
        .when(F.col("interval_coverage_ratio") < min_coverage, "under_coverage")
        .when(bias.isNull() & (F.abs("median_bias") > 0), "material_bias")
        .when(F.abs(bias) > max_bias, "material_bias")
        .otherwise("healthy")
    )
    return summary.drop("_mean").withColumns(
        {
            "window_start_date": F.date_sub(last, window - 1),
            "window_end_date": last,
            "minimum_actual_count": F.lit(min_actuals),
            "minimum_coverage_ratio": F.lit(float(min_coverage)),
            "maximum_absolute_bias_ratio": F.lit(float(max_bias)),
            "calibration_status": status,
            "is_alerting": status.isin("under_coverage", "material_bias"),
        }
    )


def source_health(ingestion: DataFrame, at: Column) -> DataFrame:
    """Latest ingestion per source against its freshness deadline."""
    newest = latest_by(ingestion, ["source_name"], [F.desc("finished_at"), F.desc("ingestion_run_id")])
    hours = (F.col("expected_interval_hours") + F.col("allowed_lateness_hours")).cast("int")
    deadline = F.col("finished_at") + F.make_interval(hours=hours)
    late = F.col("evaluated_at") > F.col("freshness_deadline")
    failed, static = F.col("status") != "succeeded", F.col("data_mode") == "static_demo"
    return newest.withColumns({"evaluated_at": at, "freshness_deadline": deadline}).withColumns(
        {
            "health_status": F.when(failed, "failed").when(static, "healthy_static").when(late, "stale").otherwise("healthy"),
            "is_alerting": F.when(failed, True).when((F.col("data_mode") == "continuous") & late, True).otherwise(False),
            "health_reason": F.when(failed, F.concat(F.lit("latest_ingestion_"), "status"))
            .when(static, "static_dataset_freshness_not_applicable")
            .when(late, "expected_ingestion_window_missed")
            .otherwise("within_window"),
        }
    )


def ingestion_row(batch: DataFrame) -> DataFrame:
    """Ingestion evidence with checks and a stable identity."""
    done = F.col("status") == "succeeded"
    require(
        batch,
        {
            "status outside its domain": ~F.col("status").isin("succeeded", "failed", "partial"),
            "finished before it started": F.col("finished_at") < F.col("started_at"),
            "negative counts": (F.col("ingested_row_count") < 0) | (F.col("table_count") < 0),
            "success without a watermark": done & F.col("source_watermark").isNull(),
        },
        "ingestion evidence",
    )
    identity = ["source_name", "source_policy_hash", "started_at", "finished_at", "source_watermark", "status"]
    return batch.withColumn(
        "ingestion_run_id", stable_id({n: F.col(n).cast("string") for n in identity})
    )


def delivery_health(dc: DataFrame, at: Column, max_pending: int = 120) -> DataFrame:
    """Latest version per contract and destination; pending too long is overdue."""
    newest = latest_by(
        dc,
        ["forecast_contract_name", "destination"],
        [F.desc("publication_version"), F.desc("published_at"), F.desc("forecast_run_id")],
    )
    age = minutes_between(at, F.col("delivery_status_at"))
    overdue = (F.col("delivery_status") == "pending") & (age > max_pending)
    return newest.withColumns(
        {
            "evaluated_at": at,
            "status_age_minutes": age,
            "delivery_health_status": F.when(F.col("delivery_status") == "delivered", "healthy")
            .when(overdue, "overdue")
            .otherwise(F.col("delivery_status")),
            "is_alerting": F.coalesce(
                F.col("delivery_status").isin("failed", "abandoned") | overdue, F.lit(False)
            ),
        }
    )


# Cost columns by service name pattern.


def pipeline_cost(
    runs: DataFrame,
    events: DataFrame,
    max_run: float = 25.0,
    max_per_thousand: float = 2.0,
    anomaly: float = 2.0,
    min_history: int = 3,
    services: Mapping[str, str] | None = None,
) -> DataFrame:
    """Cost per run against budgets and the contract's own history.

    ``services`` names cost columns and the pattern of the services they add up.
    Unattributed costs are reported by event.
    """
    services = services or {}
    labels = ["forecast_contract_name", "forecast_run_id", "stage_name", "environment"]
    missing = sum((blank(c).cast("int") for c in labels[1:]), blank(labels[0]).cast("int"))
    scope = F.coalesce(
        F.when(~blank("forecast_run_id"), F.trim("forecast_run_id")),
        F.concat(F.lit("unattributed:"), F.col("cost_event_id").cast("string")),
    )
    amount = F.col("amount_usd")
    no_money = F.lit(0).cast("decimal(38,9)")
    aggregated = events.withColumns({"cost_scope_key": scope, "_missing": missing}).groupBy("cost_scope_key").agg(
        F.max("forecast_run_id").alias("forecast_run_id"),
        F.max("forecast_contract_name").alias("_contract"),
        F.max("model_run_id").alias("model_run_id"),
        F.max("environment").alias("environment"),
        F.min("usage_start_at").alias("usage_start_at"),
        F.count(F.lit(1)).alias("cost_event_count"),
        F.count_distinct("service_name").alias("service_count"),
        F.count_distinct("stage_name").alias("stage_count"),
        F.sum(amount).alias("total_cost_usd"),
        *[
            F.sum(F.when(F.lower("service_name").like(p), amount).otherwise(no_money)).alias(f"{n}_cost_usd")
            for n, p in services.items()
        ],
        F.sum(F.coalesce("bytes_processed", F.lit(0))).alias("bytes_processed"),
        F.sum(F.coalesce("slot_ms", F.lit(0))).alias("slot_ms"),
        F.sum("_missing").alias("missing_required_label_count"),
    )
    r = runs.select(
        "forecast_run_id",
        F.col("forecast_contract_name").alias("_run_contract"),
        F.col("started_at").alias("forecast_started_at"),
        F.col("row_count").alias("output_row_count"),
    )
    attributed = (
        aggregated.join(r, "forecast_run_id", "left")
        .withColumns(
            {
                "forecast_contract_name": F.coalesce("_contract", "_run_contract"),
                "cost_per_thousand_rows_usd": safe_divide(
                    F.col("total_cost_usd").cast("double") * 1000, "output_row_count"
                ),
                "_exact": F.col("total_cost_usd"),
                "total_cost_usd": F.col("total_cost_usd").cast("double"),
                **{f"{n}_cost_usd": F.col(f"{n}_cost_usd").cast("double") for n in services},
            }
        )
        .drop("_contract", "_run_contract")
    )
    known = F.col("forecast_run_id").isNotNull() & F.col("forecast_contract_name").isNotNull()
    # the newest run of each contract against all others: sums less its own cost, no window
    # over a contract's whole history
    started = F.col("forecast_started_at")
    age = F.struct(started.isNotNull(), started, "forecast_run_id", "cost_scope_key")
    own, others = F.col("_last._exact"), F.col("_n") - 1
    newest = attributed.filter(known).groupBy("forecast_contract_name").agg(
        F.max_by(F.struct(*attributed.columns), age).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("_exact").alias("_sum"),
    )
    average = F.when(others > 0, (F.col("_sum") - own).cast("double") / others)
    monitored = newest.select(
        *[F.col(f"_last.{c}").alias(c) for c in attributed.columns],
        others.alias("historical_run_count"),
        average.alias("historical_average_run_cost_usd"),
    ).unionByName(
        attributed.filter(~known).withColumns(
            {
                "historical_run_count": F.lit(0).cast("long"),
                "historical_average_run_cost_usd": F.lit(None).cast("double"),
            }
        )
    ).drop("_exact")
    limits = {
        "maximum_run_cost_usd": F.lit(float(max_run)),
        "maximum_cost_per_thousand_rows_usd": F.lit(float(max_per_thousand)),
        "cost_anomaly_multiplier": F.lit(float(anomaly)),
        "minimum_historical_run_count": F.lit(min_history),
    }
    enough = F.col("historical_run_count") >= min_history
    status = (
        F.when(F.col("missing_required_label_count") > 0, "missing_required_labels")
        .when(F.col("total_cost_usd") > max_run, "over_run_budget")
        .when(F.col("cost_per_thousand_rows_usd") > max_per_thousand, "over_unit_budget")
        .when(
            enough & (F.col("total_cost_usd") > F.col("historical_average_run_cost_usd") * anomaly), "cost_anomaly"
        )
        .when(~enough, "insufficient_history")
        .otherwise("healthy")
    )
    available = monitored.withColumns(limits | {"cost_status": status}).withColumn(
        "is_alerting", ~F.col("cost_status").isin("healthy", "insufficient_history")
    )
    # an empty ledger still reports one row that does not alert
    zero = {"cost_event_count", "service_count", "stage_count", "bytes_processed", "slot_ms",
            "missing_required_label_count", "historical_run_count"}
    kinds = dict(available.dtypes)
    empty = events.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").withColumns(
        {c: F.lit(0 if c in zero else None).cast(kinds[c]) for c in available.columns}
        | limits
        | {
            "cost_scope_key": F.lit("platform"),
            "cost_status": F.lit("cost_data_unavailable"),
            "is_alerting": F.lit(False),
        }
    )
    return available.unionByName(empty.select(*available.columns))


def cost_events(raw: DataFrame) -> DataFrame:
    """Normalised USD cost events; anything unusable rejects the batch."""
    amount = F.expr("try_cast(amount_usd as decimal(38,9))")
    usage = F.expr("try_cast(usage_amount as decimal(38,9))")
    needed = ["service_name", "cost_type", "source_system", "source_event_id"]
    require(
        raw,
        {
            "required text is empty": any_of([blank(F.col(n).cast("string")) for n in needed]),
            "window ends before it starts": F.col("usage_end_at") < F.col("usage_start_at"),
            "amount must be finite and nonnegative": amount.isNull() | (amount < 0),
            "usage must be finite and nonnegative": F.col("usage_amount").isNotNull() & (usage.isNull() | (usage < 0)),
            "bytes and slot time must be nonnegative": (F.col("bytes_processed") < 0) | (F.col("slot_ms") < 0),
        },
        "cost events",
    )
    return raw.withColumns(
        {
            "amount_usd": amount,
            "usage_amount": usage,
            "currency": F.lit("USD"),
            "cost_event_id": stable_id(
                {n: F.col(n).cast("string") for n in ("source_system", "source_event_id")}
            ),
        }
    )


def fva_backtest(metrics: DataFrame, benchmarks: Mapping[str, str]) -> DataFrame:
    """Candidates against the grain's benchmark on the same population."""
    keys = ["backtest_run_id", "forecast_origin", "horizon", "segment_key_json"]
    wanted = F.lit(None).cast("string")
    for grain, name in benchmarks.items():
        wanted = F.when(F.col("grain") == grain, name).otherwise(wanted)
    measured = ["eligible_count", "prediction_count", "wape", "mae", "bias", "prediction_completeness"]
    benchmark = metrics.filter(F.col("baseline_name") == wanted).select(
        *keys,
        F.col("metric_id").alias("_benchmark_id"),
        F.col("baseline_name").alias("benchmark_name"),
        *[F.col(m).alias(f"benchmark_{m}") for m in measured],
    )
    candidate = metrics.withColumnsRenamed({m: f"candidate_{m}" for m in measured} | {"baseline_name": "candidate_name"})
    joined = candidate.join(benchmark, keys, "left").filter(
        F.col("candidate_name") != F.coalesce("benchmark_name", F.lit(""))
    )
    b, c = (lambda n: F.col(f"benchmark_{n}")), (lambda n: F.col(f"candidate_{n}"))
    status = (
        F.when(F.col("_benchmark_id").isNull(), "missing_benchmark")
        .when(
            (b("eligible_count") != c("eligible_count")) | (b("prediction_count") != c("prediction_count")),
            "population_mismatch",
        )
        .when(any_of([f(m).isNull() for m in ("wape", "mae") for f in (b, c)]), "missing_metrics")
        .otherwise("comparable")
    )
    same = F.col("comparison_status") == "comparable"
    # the verdict follows from the points that are published
    points = F.round(b("wape") - c("wape"), 12)
    return joined.withColumn("comparison_status", status).drop("_benchmark_id").withColumns(
        {
            "is_ml_candidate": F.col("candidate_name") == F.col("model_config_name"),
            "wape_fva_points": F.when(same, points),
            "wape_fva_ratio": F.when(same, F.round(safe_divide(b("wape") - c("wape"), b("wape")), 12)),
            "mae_fva": F.when(same, F.round(b("mae") - c("mae"), 12)),
            "fva_status": F.when(
                same,
                F.when(points > 0, "value_added")
                .when(points < 0, "value_destroyed")
                .otherwise("neutral"),
            ),
        }
    )


def fva_operations(
    pubs: DataFrame,
    outputs: DataFrame,
    approvals: DataFrame,
    overrides: DataFrame,
    demand: DataFrame,
    entity_key: str = "store_nbr",
) -> DataFrame:
    """Statistical, planner-adjusted and published WAPE by planner and reason."""
    ids = ["forecast_output_id", "forecast_run_id"]
    store = F.expr(f"try_cast(get_json_object(entity_key_json, '$.{entity_key}') as long)")
    o = outputs.select(
        *ids,
        "forecast_contract_name",
        "forecast_contract_hash",
        "grain",
        "horizon",
        "target_date",
        store.alias("_store"),
        F.col("prediction_p50").alias("_statistical"),
    )
    a = approvals.select("approval_id", *ids, F.col("decided_by").alias("planner"), "override_id")
    v = overrides.select("override_id", *ids, F.col("reason_code").alias("_reason"), "override_value")
    d = demand.select(
        F.col("date").alias("target_date"), F.col("store_nbr").alias("_store"),
        F.col("unconstrained_demand_units").alias("_actual"),
    )
    rows = (
        pubs.select("approval_id", *ids, "publication_version", "destination", "published_value")
        .join(o, ids)
        .join(a, ["approval_id", *ids])
        .join(v, ["override_id", *ids], "left")
        .join(d, ["target_date", "_store"], "left")
    )
    actual = F.col("_actual")
    total = F.sum(F.abs(actual))
    miss = lambda c: safe_divide(F.sum(F.abs(actual - c)), total)
    groups = [
        "forecast_run_id",
        "forecast_contract_name",
        "forecast_contract_hash",
        "publication_version",
        "destination",
        "grain",
        "horizon",
        "planner",
        "reason_code",
    ]
    summary = rows.withColumn("reason_code", F.coalesce("_reason", F.lit("no_override"))).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("forecast_count"),
        F.count(actual).alias("actual_count"),
        miss(F.col("_statistical")).alias("statistical_wape"),
        miss(F.coalesce("override_value", "_statistical")).alias("planner_adjusted_wape"),
        miss(F.col("published_value")).alias("published_wape"),
    )
    whole = F.col("actual_count") == F.col("forecast_count")
    s, p, q = F.col("statistical_wape"), F.col("planner_adjusted_wape"), F.col("published_wape")
    return summary.withColumns(
        {
            "actual_coverage": safe_divide("actual_count", "forecast_count"),
            "comparison_status": F.when(F.col("actual_count") == 0, "awaiting_actuals")
            .when(~whole, "incomplete_actuals")
            .when(s.isNull() | p.isNull() | q.isNull(), "undefined_metric")
            .otherwise("comparable"),
            "planner_wape_fva_points": F.when(whole, s - p),
            "publication_wape_fva_points": F.when(whole, p - q),
            "total_wape_fva_points": F.when(whole, s - q),
        }
    )


def accuracy_daily(pred: DataFrame) -> DataFrame:
    """Live accuracy per configuration, model run and forecast date."""
    error = F.col("prediction") - F.col("actual")
    return (
        pred.filter(F.col("actual").isNotNull() & F.col("forecast_date").isNotNull())
        .groupBy("config_name", "model_family", "model_type", "model_run_id", "forecast_date")
        .agg(
            F.count(F.lit(1)).alias("n_predictions"),
            F.avg(F.abs(error)).alias("mae"),
            safe_divide(F.sum(F.abs(error)), F.sum(F.abs("actual"))).alias("wape"),
            F.avg(error).alias("bias"),
        )
    )


def accuracy_rolling(daily: DataFrame, perf: DataFrame) -> DataFrame:
    """Trailing 7 and 28 rows of accuracy beside the training-time test metrics.

    Rows with one forecast date are ordered by model run, so that the frame is
    deterministic when a configuration has several runs.
    """
    config = Window.partitionBy("config_name").orderBy("forecast_date", "model_run_id")
    last = lambda n: config.rowsBetween(-(n - 1), 0)
    test = perf.filter(F.col("metric_set") == "test").select(
        "model_run_id", F.col("mae").alias("train_test_mae"), F.col("wape").alias("train_test_wape")
    )
    rolled = daily.withColumns(
        {f"{m}_{n}d": F.avg(m).over(last(n)) for n in (7, 28) for m in ("mae", "wape")}
    )
    return rolled.join(test, "model_run_id", "left")


@dataclass(frozen=True)
class AlertPolicy:
    name: str
    signal: str
    severity: str
    destination: str


# Signal -> (status column, statuses that do not alert, key columns).
SIGNALS = {
    "publication_freshness": ("freshness_status", ("fresh",), ("forecast_contract_name",)),
    "prediction_coverage": ("coverage_status", ("healthy",), ("forecast_contract_name",)),
    "feature_completeness": ("feature_completeness_status", ("healthy",), ("feature_model",)),
    "pipeline_health": ("health_status", ("healthy", "healthy_static"), ("forecast_contract_name",)),
    "source_health": ("health_status", ("healthy", "healthy_static"), ("source_name",)),
    "delivery_health": ("delivery_health_status", ("healthy",), ("forecast_contract_name",)),
    "realized_calibration": ("calibration_status", ("healthy", "insufficient_actuals"), ("forecast_contract_name",)),
    "data_drift": ("drift_status", ("healthy", "insufficient_observations"), ("source_model", "metric_name")),
    "pipeline_cost": (
        "cost_status",
        ("healthy", "insufficient_history", "cost_data_unavailable"),
        ("cost_scope_key",),
    ),
}
SEVERITIES = ("info", "ticket", "page")


def alerts(
    marts: Mapping[str, DataFrame],
    policies: Sequence[AlertPolicy],
    at: Column,
    minimum_severity: str = "info",
    trust_mart: bool = False,
) -> DataFrame:
    """Alert events from the marts' statuses, one per unhealthy row and policy.

    With ``trust_mart`` the mart's own flag decides instead of the status list
    (they differ for static demos and pending deliveries).
    """
    kept = [p for p in policies if SEVERITIES.index(p.severity) >= SEVERITIES.index(minimum_severity)]
    out = None
    for p in kept:
        if p.signal not in marts:
            continue
        status_column, calm, keys = SIGNALS[p.signal]
        mart = marts[p.signal]
        status = F.coalesce(F.col(status_column), F.lit("missing"))
        unhealthy = F.col("is_alerting") if trust_mart and "is_alerting" in mart.columns else ~status.isin(*calm)
        fallback = "unknown" if len(keys) > 1 else "platform"
        key = F.concat_ws(":", *[F.coalesce(F.col(k), F.lit(fallback)) for k in keys])
        rows = mart.filter(unhealthy).select(
            F.lit(p.name).alias("policy_name"),
            F.lit(p.signal).alias("signal"),
            F.lit(p.severity).alias("severity"),
            F.lit(p.destination).alias("destination"),
            key.alias("resource_key"),
            status.alias("reason"),
            at.alias("observed_at"),
            F.to_json(F.struct("*")).alias("details"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no policy matches the given marts")
    return out
