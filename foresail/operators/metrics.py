"""Point, probabilistic and holdout accuracy as conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresail.functions.expr import require, safe_divide, stable_id
from foresail.functions.ranks import exact_median

QUANTILES = ((0.1, "prediction_p10"), (0.5, "prediction_p50"), (0.9, "prediction_p90"))
NOMINAL_COVERAGE = 0.8
EPSILON = 1e-10


def point_aggregates() -> list[Column]:
    """Counts, WAPE, MAE, bias, completeness, MASE and RMSSE of a group."""
    actual, prediction = F.col("actual").cast("double"), F.col("prediction").cast("double")
    eligible = actual.isNotNull()
    complete = eligible & prediction.isNotNull()
    error = F.when(complete, prediction - actual)
    mase = F.when(complete & (F.col("mase_scale") > 0), F.abs(prediction - actual) / F.col("mase_scale"))
    rmsse = F.when(
        complete & (F.col("rmsse_scale") > 0), F.pow(prediction - actual, 2) / F.col("rmsse_scale")
    )
    return [
        F.count_if(eligible).alias("eligible_count"),
        F.count_if(complete).alias("prediction_count"),
        safe_divide(F.sum(F.abs(error)), F.sum(F.when(complete, F.abs(actual)))).alias("wape"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(mase).alias("mase"),
        F.sqrt(F.avg(rmsse)).alias("rmsse"),
        F.avg(error).alias("bias"),
        safe_divide(F.count_if(complete), F.count_if(eligible)).alias("prediction_completeness"),
    ]


def probabilistic_aggregates() -> list[Column]:
    """Mean pinball loss, central coverage, width and calibration error."""
    actual = F.col("actual").cast("double")
    valid = actual.isNotNull()
    for _, name in QUANTILES:
        valid = valid & F.col(name).isNotNull()
    losses = [
        F.greatest(q * (actual - F.col(n)), (q - 1) * (actual - F.col(n))) for q, n in QUANTILES
    ]
    inside = F.when(valid, actual.between(F.col("prediction_p10"), F.col("prediction_p90")).cast("double"))
    return [
        F.avg(F.when(valid, sum(losses[1:], losses[0]) / len(losses))).alias("pinball_loss"),
        F.avg(inside).alias("interval_coverage"),
        F.avg(F.when(valid, F.col("prediction_p90") - F.col("prediction_p10"))).alias("interval_width"),
        F.abs(F.avg(inside) - NOMINAL_COVERAGE).alias("calibration_error"),
    ]


def _with_scales(pred: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast("double") for n in ("mase_scale", "rmsse_scale") if n not in pred.columns}
    return pred.withColumns(missing) if missing else pred


def point_metrics(pred: DataFrame, groups: Sequence[str]) -> DataFrame:
    return _with_scales(pred).groupBy(*groups).agg(*point_aggregates())


def require_ordered_quantiles(pred: DataFrame, what: str) -> None:
    p10, p50, p90 = (F.col(n) for _, n in QUANTILES)
    require(pred, {"crossed quantiles": (p10 > p50) | (p50 > p90)}, what)


def prob_metrics(pred: DataFrame, groups: Sequence[str], check: bool = True) -> DataFrame:
    """Probabilistic metrics; crossed quantiles reject the input."""
    if check:
        require_ordered_quantiles(pred, "probabilistic metrics")
    return pred.groupBy(*groups).agg(*probabilistic_aggregates())


def metrics_by_segment(pred: DataFrame, segments: bool = True) -> DataFrame:
    """Metrics per run, origin, horizon and baseline: over all entities (``{}``)
    and, in the same pass, per segment (two grouping sets)."""
    base = ["backtest_run_id", "forecast_origin", "horizon", "baseline_name"]
    quantiles = all(n in pred.columns for _, n in QUANTILES)
    measures = point_aggregates() + (probabilistic_aggregates() if quantiles else [])
    rows = _with_scales(pred)
    if not segments:
        return rows.groupBy(*base).agg(*measures).withColumn("segment_key_json", F.lit("{}"))
    cols = [F.col(b) for b in base]
    segment = F.col("segment_key_json")
    grouped = rows.groupingSets([cols, [*cols, segment]], *cols, segment).agg(
        F.grouping("segment_key_json").alias("_overall"), *measures
    )
    return grouped.withColumn(
        "segment_key_json", F.when(F.col("_overall") == 1, "{}").otherwise(segment)
    ).drop("_overall")


def with_metric_ids(metrics: DataFrame) -> DataFrame:
    """Identity of a metric row: its scope (values may be recomputed)."""
    scope = ["backtest_run_id", "forecast_origin", "horizon", "baseline_name", "segment_key_json"]
    return metrics.withColumn("metric_id", stable_id({n: F.col(n).cast("string") for n in scope}))


def holdout_metrics(df: DataFrame, y: str, yhat: str, groups: Sequence[str] = ()) -> DataFrame:
    """Regression metrics of a scored holdout, percentages where so named.

    The median absolute error is an exact order statistic, found without
    sorting a group in one task.
    """
    rows = df.select(*groups, F.col(y).cast("double").alias("_y"), F.col(yhat).cast("double").alias("_p"))
    rows = rows.dropna(subset=["_y", "_p"]).withColumn("_ae", F.abs(F.col("_y") - F.col("_p")))
    a, p, ae = F.col("_y"), F.col("_p"), F.col("_ae")
    total = F.var_pop(a) * F.count(a)
    summary = rows.groupBy(*groups).agg(
        F.avg(p).alias("mean_pred"),
        F.avg(a).alias("mean_actual"),
        F.avg(ae).alias("mae"),
        F.sqrt(F.avg(ae * ae)).alias("rmse"),
        F.avg(ae * ae).alias("mse"),
        (1 - F.try_divide(F.sum(ae * ae), total)).alias("r2"),
        (F.avg(ae / F.abs(a + EPSILON)) * 100).alias("mape"),
        (F.sum(ae) / (F.sum(F.abs(a)) + EPSILON) * 100).alias("wape"),
        (F.avg(2 * ae / (F.abs(a) + F.abs(p) + EPSILON)) * 100).alias("smape"),
        F.avg(p - a).alias("bias"),
    )
    median = exact_median(rows, groups, "_ae", "median_ae")
    if groups:
        return summary.join(median, list(groups), "left")
    return summary.join(median, F.lit(True), "left")


def level_metrics(rows: DataFrame, level: str = "level_name", horizon: str = "horizon") -> DataFrame:
    """MAE and WAPE of base and reconciled medians by level and horizon."""
    valid = rows.dropna(subset=["actual", "base_prediction_p50", "prediction_p50"])
    actual = F.col("actual").cast("double")
    base = F.abs(actual - F.col("base_prediction_p50"))
    reconciled = F.abs(actual - F.col("prediction_p50"))
    wide = valid.groupBy(level, horizon).agg(
        F.avg(base).alias("base_mae"),
        F.avg(reconciled).alias("reconciled_mae"),
        safe_divide(F.sum(base), F.sum(F.abs(actual))).alias("base_wape"),
        safe_divide(F.sum(reconciled), F.sum(F.abs(actual))).alias("reconciled_wape"),
        F.count(F.lit(1)).alias("observation_count"),
    )
    entries = [
        F.struct(
            F.lit(m).alias("metric_name"),
            F.col(f"base_{m}").alias("base_metric_value"),
            F.col(f"reconciled_{m}").alias("reconciled_metric_value"),
        )
        for m in ("mae", "wape")
    ]
    return wide.select(level, horizon, "observation_count", F.inline(F.array(*entries))).withColumn(
        "metric_delta", F.col("reconciled_metric_value") - F.col("base_metric_value")
    )
