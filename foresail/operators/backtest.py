"""Rolling-origin backtests: plan, baselines, scales and actuals.

The panel has one row per entity and date. Origins and horizons are a handful
of contract literals, so the plan is a small dimension. Two shapes carry all
baselines: values at a fixed date (actual, last week, last year) come from one
hash join on the date against the plan's lookup dates; values that summarise a
training window come from the entity's ordered history, an array no longer than
the calendar. Each shuffles the panel once, by entity.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresail.contracts import BacktestContract
from foresail.functions.expr import canonical_json, require_columns, require_unique, stable_id
from foresail.operators.intermittent import croston_sba, tsb

HISTORY_BASELINES = {"last_observation", "moving_average", "croston_sba", "tsb", "croston_sba_tsb"}


def origins(start: dt.date, end: dt.date, step: int) -> list[dt.date]:
    """Origins from ``start`` to ``end`` inclusive, every ``step`` days."""
    if step < 1 or end < start:
        raise ValueError("origins need a positive step and an ordered range")
    return [start + dt.timedelta(days=i) for i in range(0, (end - start).days + 1, step)]


def plan(spark: SparkSession, c: BacktestContract) -> DataFrame:
    """Origin x horizon rows with their target dates."""
    rows = [(o, h) for o in c.origins for h in c.horizons]
    frame = spark.createDataFrame(rows, "forecast_origin date, horizon int")
    return frame.withColumn("target_date", F.date_add("forecast_origin", F.col("horizon")))


def validate_panel(df: DataFrame, keys: Sequence[str], date: str, required: Sequence[str] = ()) -> DataFrame:
    require_columns(df, [*keys, date, *required], "backtest input")
    require_unique(df, [*keys, date], "backtest input")
    return df


def _lookups(plan: DataFrame) -> DataFrame:
    """Dates whose values the plan needs: the target, a week and a year before
    it, the latter two only where they are known at the origin."""
    target = F.col("target_date")
    week, year = F.date_sub(target, 7), F.add_months(target, -12)
    known = lambda d: F.when(d <= F.col("forecast_origin"), d)
    roles = F.array(
        F.struct(F.lit("actual").alias("role"), target.alias("lookup_date")),
        F.struct(F.lit("week").alias("role"), known(week).alias("lookup_date")),
        F.struct(F.lit("year").alias("role"), known(year).alias("lookup_date")),
    )
    return (
        plan.select("forecast_origin", "horizon", F.inline(roles))
        .filter(F.col("lookup_date").isNotNull())
    )


def dated_values(plan: DataFrame, panel: DataFrame, c: BacktestContract) -> DataFrame:
    """Actual, last week's and last year's value per entity, origin and horizon.

    The lookup table has three rows per plan row, so Spark broadcasts it and
    only matching panel rows are shuffled, already partly aggregated.
    """
    keys = list(c.entity_columns)
    values = panel.select(*keys, F.col(c.date_column).alias("lookup_date"), F.col(c.actual_column).alias("_y"))
    at = lambda role: F.max(F.when(F.col("role") == role, F.col("_y").cast("double")))
    return (
        values.filter(F.col("_y").isNotNull())
        .join(_lookups(plan), "lookup_date")
        .groupBy(*keys, "forecast_origin", "horizon")
        .agg(
            at("actual").alias("actual"),
            at("week").alias("seasonal_naive_7d"),
            at("year").alias("same_period_last_year"),
        )
    )


def attach_actuals(plan: DataFrame, panel: DataFrame, c: BacktestContract) -> DataFrame:
    """Every entity x plan row with the actual at its target date, NULL if none."""
    grid = entity_grid(plan, panel, c)
    keys = [*c.entity_columns, "forecast_origin", "horizon"]
    return grid.join(dated_values(plan, panel, c).select(*keys, "actual"), keys, "left")


def entity_grid(plan: DataFrame, panel: DataFrame, c: BacktestContract) -> DataFrame:
    """The entity universe spread over the plan's literals (no cross join).

    An entity's segment is its value on the earliest panel date.
    """
    keys = list(c.entity_columns)
    segments = [F.min_by(s, c.date_column).alias(s) for s in c.segment_columns]
    entities = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *segments).drop("_n")
    steps = F.array(
        *[
            F.struct(F.lit(o).alias("forecast_origin"), F.lit(h).alias("horizon"))
            for o in c.origins
            for h in c.horizons
        ]
    )
    return entities.select("*", F.inline(steps)).withColumn(
        "target_date", F.date_add("forecast_origin", F.col("horizon"))
    )


def windowed_history(panel: DataFrame, c: BacktestContract) -> DataFrame:
    """Per entity and origin the ordered observed values of its train window.

    One shuffle by entity. The array holds at most one value per calendar day
    of the windows, because the panel is unique by entity and date.
    """
    lo = min(c.origins) - dt.timedelta(days=c.train_window_days)
    inside = F.col(c.date_column).between(F.lit(lo), F.lit(max(c.origins)))
    points = F.struct(F.col(c.date_column).alias("d"), F.col(c.actual_column).cast("double").alias("y"))
    series = (
        panel.filter(inside & F.col(c.actual_column).isNotNull())
        .groupBy(*c.entity_columns)
        .agg(F.array_sort(F.collect_list(points)).alias("_points"))
    )
    spread = series.withColumn("forecast_origin", F.explode(F.array(*[F.lit(o) for o in c.origins])))
    origin = F.col("forecast_origin")
    in_window = F.filter(
        "_points", lambda p: (p["d"] <= origin) & (p["d"] > F.date_sub(origin, c.train_window_days))
    )
    return spread.select(
        *c.entity_columns, "forecast_origin", F.transform(in_window, lambda p: p["y"]).alias("observed")
    )


def history_baselines(history: DataFrame, c: BacktestContract) -> DataFrame:
    """Last observation, moving average and intermittent-demand rates."""
    y = F.col("observed")
    tail = F.slice(y, F.greatest(F.size(y) - c.moving_average_window + 1, F.lit(1)), c.moving_average_window)
    total = F.aggregate(tail, F.lit(0.0), lambda a, v: a + v)
    demand = F.transform(y, lambda v: F.greatest(v, F.lit(0.0)))
    rows = history.filter(F.size(y) > 0).withColumns(
        {
            "last_observation": F.element_at(y, -1),
            "moving_average": total / F.size(tail),
            "croston_sba": croston_sba(demand),
            "tsb": tsb(demand),
        }
    )
    return rows.withColumn("croston_sba_tsb", (F.col("croston_sba") + F.col("tsb")) / 2)


def scale_columns() -> dict[str, Column]:
    """Mean absolute and mean squared step between consecutive observations."""
    y = F.col("observed")
    steps = F.zip_with(F.slice(y, 2, F.greatest(F.size(y), F.lit(1))), y, lambda b, a: b - a)
    steps = F.filter(steps, lambda v: v.isNotNull())
    mean = lambda f: F.try_divide(F.aggregate(steps, F.lit(0.0), f), F.size(steps))
    positive = lambda v: F.when(v > 0, v)
    return {
        "mase_scale": positive(mean(lambda a, v: a + F.abs(v))),
        "rmsse_scale": positive(mean(lambda a, v: a + v * v)),
    }


def scale_denominators(panel: DataFrame, c: BacktestContract) -> DataFrame:
    """MASE and RMSSE denominators per entity and origin; zero becomes NULL."""
    scaled = windowed_history(panel, c).withColumns(scale_columns())
    return scaled.drop("observed")


def baseline(name: str, panel: DataFrame, c: BacktestContract) -> DataFrame:
    """One baseline on the whole plan: entity, origin, horizon, prediction."""
    spark = panel.sparkSession
    grid = entity_grid(plan(spark, c), panel, c)
    if name == "zero_demand":
        return grid.withColumn("prediction", F.lit(0.0))
    if name in HISTORY_BASELINES:
        values = history_baselines(windowed_history(panel, c), c)
        keys = [*c.entity_columns, "forecast_origin"]
    elif name in ("seasonal_naive_7d", "same_period_last_year"):
        values = dated_values(plan(spark, c), panel, c)
        keys = [*c.entity_columns, "forecast_origin", "horizon"]
    else:
        raise ValueError(f"no scorer for baseline {name!r}")
    return grid.join(values.select(*keys, F.col(name).alias("prediction")), keys, "left")


def panel_fingerprint(panel: DataFrame, c: BacktestContract) -> Column:
    from foresail.functions.expr import fingerprint

    used = sorted({c.date_column, c.actual_column, *c.entity_columns, *c.segment_columns})
    return fingerprint(canonical_json({u: F.col(u).cast("string") for u in used}))


def score_baselines(panel: DataFrame, c: BacktestContract, run_id: Column | str | None = None) -> DataFrame:
    """Every configured baseline at every origin, horizon and entity.

    The run id defaults to a digest of contract and input. Rows carry the
    scaled-error denominators of their entity and origin.
    """
    spark = panel.sparkSession
    keys = list(c.entity_columns)
    steps = plan(spark, c)
    if run_id is None:
        digest = panel.agg(panel_fingerprint(panel, c).alias("f")).first()["f"]
        run_id = stable_run_id(c, digest)
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    history = history_baselines(windowed_history(panel, c), c).withColumns(scale_columns())
    wide = (
        entity_grid(steps, panel, c)
        .join(dated_values(steps, panel, c), [*keys, "forecast_origin", "horizon"], "left")
        .join(history.drop("observed"), [*keys, "forecast_origin"], "left")
    )
    entries = [
        F.struct(
            F.lit(b).alias("baseline_name"),
            (F.lit(0.0) if b == "zero_demand" else F.col(b)).alias("prediction"),
        )
        for b in c.baselines
    ]
    rows = wide.select(
        run.alias("backtest_run_id"),
        "forecast_origin",
        "target_date",
        "horizon",
        canonical_json(keys).alias("entity_key_json"),
        (canonical_json(list(c.segment_columns)) if c.segment_columns else F.lit("{}")).alias("segment_key_json"),
        *keys,
        "actual",
        "mase_scale",
        "rmsse_scale",
        F.inline(F.array(*entries)),
    )
    identity = {
        n: F.col(n).cast("string")
        for n in (
            "backtest_run_id",
            "forecast_origin",
            "target_date",
            "horizon",
            "entity_key_json",
            "segment_key_json",
            "baseline_name",
        )
    }
    return rows.withColumns(
        {
            "prediction_id": stable_id(identity),
            "backtest_contract_name": F.lit(c.name),
            "backtest_contract_hash": F.lit(c.hash),
            "data_cutoff": F.col("forecast_origin"),
        }
    )


def stable_run_id(c: BacktestContract, digest: str) -> str:
    from foresail.contracts import _hash

    return _hash({"backtest_contract_hash": c.hash, "input": digest})


def backtest_run(pred: DataFrame, metrics: DataFrame, c: BacktestContract, created_at: Column) -> DataFrame:
    """One run row with prediction and metric counts and the metric policy."""
    policy = F.to_json(
        F.struct(
            F.lit("rolling_origin").alias("evaluation_protocol"),
            F.lit(c.primary_metric).alias("primary_metric"),
        )
    )
    made = pred.groupBy("backtest_run_id").agg(F.count(F.lit(1)).alias("prediction_count"))
    measured = metrics.groupBy("backtest_run_id").agg(F.count(F.lit(1)).alias("metric_count"))
    text = lambda v: F.lit(v).cast("string")
    return made.join(measured, "backtest_run_id", "left").select(
        "backtest_run_id",
        F.lit(c.name).alias("backtest_contract_name"),
        F.lit(c.hash).alias("backtest_contract_hash"),
        text(c.model_config_name).alias("model_config_name"),
        text(c.model_family).alias("model_family"),
        text(c.model_type).alias("model_type"),
        F.lit(c.target).alias("target"),
        F.lit(c.grain).alias("grain"),
        policy.alias("metric_policy_json"),
        F.lit(min(c.origins)).alias("origin_start"),
        F.lit(max(c.origins)).alias("origin_end"),
        "prediction_count",
        F.coalesce("metric_count", F.lit(0)).alias("metric_count"),
        F.lit("completed").alias("status"),
        created_at.alias("created_at"),
    )


def persist_backtest(pred: DataFrame, metrics: DataFrame, run: DataFrame, path: str) -> dict[str, int]:
    """Predictions and metrics first, the run row last, each insert-once."""
    from foresail.sources.writers import insert_once

    return {
        "predictions": insert_once(pred, f"{path}/backtest_predictions", "prediction_id"),
        "metrics": insert_once(metrics, f"{path}/backtest_metrics", "metric_id"),
        "runs": insert_once(run, f"{path}/backtest_runs", "backtest_run_id"),
    }
