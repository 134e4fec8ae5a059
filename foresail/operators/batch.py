"""A scored batch through its five stages to a validated draft run.

Stages only add columns to the same rows, so one table carries them all. It is
written once to the checkpoint folder; counts, digests and gates of every stage
then come from a single aggregate over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresail.contracts import ForecastContract, HierarchySpec, RunPins
from foresail.functions.expr import canonical_json, fingerprint, require_unique, stable_id
from foresail.operators import calibration as ca
from foresail.operators import demand as de
from foresail.operators import hierarchy as hi
from foresail.operators import ledger as le
from foresail.operators import routing as cl
from foresail.session import checkpointed
from foresail.sources.writers import insert_once

STAGES = ("score", "route", "calibrate", "reconcile", "validate")


@dataclass(frozen=True)
class Hierarchy:
    spec: HierarchySpec
    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class BatchResult:
    forecast_run_id: str
    rows: DataFrame
    stages: DataFrame
    checks: DataFrame
    decisions: DataFrame


def run_batch(
    pred: DataFrame,
    calib: DataFrame,
    elig: DataFrame,
    c: ForecastContract,
    pins: RunPins,
    completed_at: Column,
    hierarchy: Hierarchy | None = None,
    min_residuals: int = 20,
) -> BatchResult:
    """Score, route, calibrate, reconcile and validate one origin's forecasts."""
    dims = list(c.dimensions)
    keys = [*dims, "date", "forecast_horizon"]
    origins = pred.select("date").distinct().limit(2).collect()
    if len(origins) != 1:
        raise ValueError("one run must contain exactly one forecast origin")
    require_unique(pred, keys, "predictions")
    eligible = elig.filter("is_eligible") if "is_eligible" in elig.columns else elig
    mismatch = de.population_diff(pred, eligible, keys)
    if not mismatch.isEmpty():
        raise ValueError("scored rows must exactly match the frozen eligible population")
    snapshot = de.snapshot_id(eligible, dims)
    if pins.eligibility_snapshot_id is not None and snapshot != pins.eligibility_snapshot_id:
        raise ValueError("eligible rows do not match the pinned eligibility snapshot")
    run = le.run_id(c, origins[0]["date"], pins)
    decisions = de.eligibility_decisions(elig, c, run, snapshot, completed_at)

    scored = pred.withColumns(
        {"entity_key_json": canonical_json(dims), "score_prediction": F.col("prediction"), "predict_run_id": F.lit(run)}
    )
    routed = cl.route_batch(scored, calib)
    calibrated = ca.calibrate_by_horizon(routed, calib, c.quantiles, min_residuals).withColumns(
        {
            "calibration_method": F.lit("symmetric_split_conformal"),
            "calibration_run_id": stable_id({"run": F.lit(run), "stage": F.lit("calibrate")}),
        }
    )
    values = list(hi.VALUES)
    if c.reconciliation_policy == "none":
        reconciled = calibrated.withColumns(
            {f"base_{v}": F.col(v) for v in values}
            | {
                "hierarchy_version": F.lit(None).cast("string"),
                "reconciliation_method": F.lit("none"),
                "reconciliation_run_id": F.lit(None).cast("string"),
            }
        )
    else:
        if hierarchy is None or hierarchy.spec.method != c.reconciliation_policy:
            raise ValueError("hierarchical publication needs the contract's hierarchy method")
        groups = ["date", "forecast_horizon"]
        reconciled = hi.reconcile(
            calibrated, hierarchy.nodes, hierarchy.edges, hierarchy.spec.method, groups, values,
            hierarchy.spec.middle_level,
        ).withColumns(
            {
                "hierarchy_version": F.lit(hierarchy.spec.version),
                "reconciliation_run_id": stable_id({"run": F.lit(run), "hierarchy": F.lit(hierarchy.spec.hash)}),
            }
        )
    wide = checkpointed(ca.attach_intervals(reconciled))
    if hierarchy is not None and c.reconciliation_policy != "none":
        for v in values:
            broken = hi.coherence_violations(
                wide, hierarchy.edges, ["date", "forecast_horizon"], v, hierarchy.spec.tolerance_abs
            )
            if not broken.isEmpty():
                raise ValueError(f"reconciliation coherence failed for {v}")
    cutoff = F.lit(pins.data_cutoff).cast("timestamp")
    rows = le.forecast_rows(wide, c, pins.feature_version, pins.code_sha, cutoff)
    le.validate_batch(rows, c)
    checks = gates(rows, decisions, run, snapshot, pins, completed_at)
    failed = [r.check_name for r in checks.filter(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"blocking publication gates failed: {', '.join(failed)}")
    return BatchResult(run, rows, stage_rows(wide, dims, run, completed_at), checks, decisions)


def stage_rows(wide: DataFrame, dims: list[str], run: str, at: Column) -> DataFrame:
    """One row per stage: counts and order-independent digests in and out."""
    keys = [*dims, "date", "forecast_horizon"]
    added = {
        "score": ["score_prediction"],
        "route": ["forecast_strategy", "fallback_reason", "confidence_flag"],
        "calibrate": [f"base_{v}" for v in hi.VALUES],
        "reconcile": list(hi.VALUES),
        "validate": ["predict_run_id"],
    }
    seen = list(keys)
    digests = []
    for stage in STAGES:
        seen = seen + added[stage]
        text = canonical_json({n: F.col(n).cast("string") for n in seen})
        digests.append(fingerprint(text).alias(f"_{stage}"))
    facts = wide.agg(F.count(F.lit(1)).alias("_rows"), *digests)
    entries = []
    for i, stage in enumerate(STAGES):
        before = F.col(f"_{STAGES[i - 1]}") if i else stable_id({"run": F.lit(run), "stage": F.lit("input")})
        entries.append(
            F.struct(
                F.lit(stage).alias("stage_name"),
                F.lit(i + 1).alias("stage_position"),
                before.alias("input_fingerprint"),
                F.col(f"_{stage}").alias("output_fingerprint"),
                F.col("_rows").alias("input_row_count"),
                F.col("_rows").alias("output_row_count"),
            )
        )
    out = facts.select(F.inline(F.array(*entries))).withColumns(
        {"forecast_run_id": F.lit(run), "stage_status": F.lit("completed"), "started_at": at, "finished_at": at}
    )
    return out.withColumn("stage_run_id", stable_id(["forecast_run_id", "stage_name"]))


def gates(
    rows: DataFrame, decisions: DataFrame, run: str, snapshot: str, pins: RunPins, at: Column
) -> DataFrame:
    """Blocking gates of a batch as check rows, from two aggregates."""
    p10, p50, p90 = (F.col(v) for v in hi.VALUES)
    facts = rows.agg(
        F.count(F.lit(1)).alias("predicted"),
        F.count_if(~F.coalesce((p10 <= p50) & (p50 <= p90), F.lit(False))).alias("unordered"),
        F.min("forecast_origin").alias("origin"),
    )
    population = decisions.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("is_eligible").alias("eligible"),
        F.count_if(~F.col("is_eligible")).alias("excluded"),
    )
    pinned = pins.eligibility_snapshot_id or snapshot
    number = lambda v: v.cast("double")
    none = F.lit(None).cast("double")
    cutoff = F.lit(pins.data_cutoff).cast("timestamp")
    named = [
        ("eligibility_snapshot_match", F.lit(snapshot == pinned), none, none),
        (
            "eligibility_population_accounting",
            (F.col("candidates") == F.col("eligible") + F.col("excluded")) & (F.col("predicted") == F.col("eligible")),
            number(F.col("predicted")),
            number(F.col("eligible")),
        ),
        (
            "prediction_completeness",
            F.col("predicted") == F.col("eligible"),
            F.try_divide(number(F.col("predicted")), F.col("eligible")),
            F.lit(1.0),
        ),
        ("quantile_ordering", F.col("unordered") == 0, number(F.col("unordered")), F.lit(0.0)),
        ("point_in_time_cutoff", cutoff <= F.col("origin"), none, none),
    ]
    entries = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
            observed.alias("observed_value"),
            threshold.alias("threshold_value"),
        )
        for name, passed, observed, threshold in named
    ]
    out = facts.join(population, F.lit(True)).select(F.inline(F.array(*entries))).withColumns(
        {"forecast_run_id": F.lit(run), "severity": F.lit("blocking"), "checked_at": at}
    )
    return out.withColumn("validation_check_id", stable_id(["forecast_run_id", "check_name"]))


def run_row(result: BatchResult, c: ForecastContract, pins: RunPins, at: Column) -> DataFrame:
    """The visible run row, with its population accounting."""
    counted = result.rows.agg(F.count(F.lit(1)).alias("row_count"), F.min("forecast_origin").alias("forecast_origin"))
    population = result.decisions.agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if("is_eligible").alias("eligible_count"),
        F.count_if(~F.col("is_eligible")).alias("excluded_count"),
        F.count_if("has_exception").alias("exception_count"),
        F.min("eligibility_snapshot_id").alias("eligibility_snapshot_id"),
    )
    return counted.join(population, F.lit(True)).withColumns(
        {
            "forecast_run_id": F.lit(result.forecast_run_id),
            "forecast_contract_name": F.lit(c.name),
            "forecast_contract_hash": F.lit(c.hash),
            "run_status": F.lit("draft"),
            "feature_availability_hash": F.lit(pins.feature_availability_hash),
            "model_run_id": F.lit(pins.model_run_id),
            "started_at": at,
            "finished_at": at,
        }
    )


def persist_run(result: BatchResult, c: ForecastContract, pins: RunPins, path: str, at: Column) -> dict[str, int]:
    """Evidence and outputs first; the run row that makes them visible last."""
    counts = {
        "eligibility_decisions": insert_once(
            result.decisions, f"{path}/eligibility_decisions", "eligibility_decision_id"
        ),
        "stage_runs": insert_once(result.stages, f"{path}/stage_runs", "stage_run_id"),
        "validation_checks": insert_once(result.checks, f"{path}/validation_checks", "validation_check_id"),
        "outputs": insert_once(result.rows, f"{path}/outputs", "forecast_output_id"),
    }
    counts["runs"] = insert_once(run_row(result, c, pins, at), f"{path}/runs", "forecast_run_id")
    return counts


