"""Append-only forecast ledgers: canonical rows, approvals, publications, delivery.

Builders return DataFrames with identities a retry reproduces; guards run as one
aggregate over the batch before anything is written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foresail.contracts import ForecastContract, RunPins, _hash
from foresail.functions.expr import (
    any_of,
    blank,
    canonical_json,
    require,
    require_columns,
    require_unique,
    stable_id,
)

# Allowed transitions, None meaning "no earlier status".
STATUS_TRANSITIONS = {
    None: ("draft", "failed"),
    "draft": ("approved", "superseded", "failed"),
    "approved": ("published", "superseded", "failed"),
    "published": ("superseded",),
    "superseded": (),
    "failed": (),
}
DELIVERY_TRANSITIONS = {
    None: ("pending",),
    "pending": ("delivered", "failed", "abandoned"),
    "failed": ("pending", "abandoned"),
    "delivered": (),
    "abandoned": (),
}
DELIVERY_ACTIONS = {
    "start": "pending",
    "confirm": "delivered",
    "fail": "failed",
    "abandon": "abandoned",
    "retry": "pending",
}
PUBLICATION_EVENTS = ("forecast.published", "forecast.revised", "forecast.rolled_back")
CONFIDENCE_FLAGS = ("high", "medium", "low")


def transition_allowed(previous: Column, new: Column, table: Mapping) -> Column:
    """Null-safe lookup in a transition table of a few literals."""
    pairs = [
        previous.eqNullSafe(F.lit(before)) & (new == after) for before, afters in table.items() for after in afters
    ]
    return F.coalesce(any_of(pairs), F.lit(False))


def _require_text(**values: str) -> None:
    empty = sorted(name for name, value in values.items() if not value)
    if empty:
        raise ValueError(f"required: {', '.join(empty)}")


# --- canonical rows ----------------------------------------------------------------
def run_id(c: ForecastContract, origin: object, pins: RunPins) -> str:
    """Retry-stable identity of all material run inputs."""
    return _hash(
        {
            "forecast_contract_hash": c.hash,
            "forecast_origin": str(origin),
            "champion_candidate_id": pins.champion_candidate_id,
            "model_run_id": pins.model_run_id,
            "feature_version": pins.feature_version,
            "feature_availability_hash": pins.feature_availability_hash,
            "data_cutoff": str(pins.data_cutoff),
            "data_cutoff_set": pins.source_cutoff_json,
            "eligibility_snapshot_id": pins.eligibility_snapshot_id,
            "code_sha": pins.code_sha,
        }
    )


def _optional(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def forecast_rows(
    pred: DataFrame,
    c: ForecastContract,
    feature_version: str,
    code_sha: str,
    data_cutoff: Column,
    status: str = "draft",
    check: bool = True,
) -> DataFrame:
    """Standard prediction rows as canonical output rows of one run."""
    if status not in STATUS_TRANSITIONS:
        raise ValueError(f"invalid forecast status {status!r}")
    _require_text(feature_version=feature_version, code_sha=code_sha)
    provenance = ["model_id", "config_name", "model_type", "model_artifact_uri"]
    require_columns(
        pred,
        [*c.dimensions, *provenance, "date", "forecast_horizon", "predict_run_id", "prediction", "prediction_id"],
        "prediction rows",
    )
    none = F.lit(None).cast("string")
    horizon = F.col("forecast_horizon").cast("int")
    source_date = F.to_date("date")
    explicit = F.to_date(_optional(pred, "forecast_date", none))
    target = F.coalesce(explicit, F.date_add(source_date, horizon))
    work = pred.withColumns(
        {
            "horizon": horizon,
            "target_date": target,
            "forecast_origin": F.date_sub(target, horizon).cast("timestamp"),
            "forecast_strategy": _optional(pred, "forecast_strategy", F.lit("entity_model")),
            "fallback_reason": _optional(pred, "fallback_reason", none),
            "confidence_flag": _optional(pred, "confidence_flag", F.lit("high")),
        }
    )
    if check:
        require(
            work,
            {
                "horizon missing": F.col("horizon").isNull(),
                "horizon outside the contract": ~F.col("horizon").isin(list(c.horizons)),
                "origin or target date missing": F.col("target_date").isNull(),
                "provenance is incomplete": any_of([blank(p) for p in provenance]),
                "dimension value is null": any_of([F.col(d).isNull() for d in c.dimensions]),
                "strategy missing": blank("forecast_strategy"),
                "confidence outside its domain": F.col("confidence_flag").isNull()
                | ~F.col("confidence_flag").isin(list(CONFIDENCE_FLAGS)),
                "run id missing": F.col("predict_run_id").isNull(),
            },
            "canonical rows",
        )
        if work.agg(F.count_distinct("predict_run_id")).first()[0] > 1:
            raise ValueError("canonical rows must belong to exactly one run")
    identity = {
        "forecast_run_id": F.col("predict_run_id"),
        "entity_key_json": canonical_json(list(c.dimensions)),
        "target_date": F.col("target_date").cast("string"),
        "horizon": F.col("horizon"),
        "contract_hash": F.lit(c.hash),
    }
    number, text = F.lit(None).cast("double"), none
    return work.select(
        stable_id(identity).alias("forecast_output_id"),
        F.col("prediction_id").alias("source_prediction_id"),
        F.col("predict_run_id").alias("forecast_run_id"),
        F.lit(c.name).alias("forecast_contract_name"),
        F.lit(c.hash).alias("forecast_contract_hash"),
        F.lit(True).alias("contract_enforced"),
        "forecast_origin",
        "target_date",
        "horizon",
        F.lit(",".join(c.dimensions)).alias("grain"),
        canonical_json(list(c.dimensions)).alias("entity_key_json"),
        F.lit(c.target).alias("target"),
        F.lit(c.target_unit).alias("target_unit"),
        _optional(pred, "prediction_lower", number).alias("prediction_p10"),
        F.col("prediction").alias("prediction_p50"),
        _optional(pred, "prediction_upper", number).alias("prediction_p90"),
        "forecast_strategy",
        "fallback_reason",
        "confidence_flag",
        _optional(pred, "calibration_method", text).alias("calibration_method"),
        _optional(pred, "calibration_run_id", text).alias("calibration_run_id"),
        _optional(pred, "hierarchy_version", text).alias("hierarchy_version"),
        _optional(pred, "reconciliation_method", F.lit("none")).alias("reconciliation_method"),
        _optional(pred, "reconciliation_run_id", text).alias("reconciliation_run_id"),
        F.col("prediction").alias("statistical_forecast"),
        number.alias("planner_override"),
        number.alias("approved_forecast"),
        number.alias("published_forecast"),
        F.lit(status).alias("forecast_status"),
        _optional(pred, "model_run_id", text).alias("model_run_id"),
        "model_id",
        "config_name",
        _optional(pred, "model_family", text).alias("model_family"),
        "model_type",
        F.lit(feature_version).alias("feature_version"),
        F.lit(code_sha).alias("code_sha"),
        data_cutoff.alias("data_cutoff"),
        "model_artifact_uri",
        _optional(pred, "run_at", F.lit(None).cast("timestamp")).alias("created_at"),
    )


BATCH_REQUIRED = (
    "forecast_output_id",
    "forecast_run_id",
    "forecast_contract_hash",
    "entity_key_json",
    "target_date",
    "horizon",
    "prediction_p10",
    "prediction_p50",
    "prediction_p90",
    "forecast_strategy",
    "confidence_flag",
    "calibration_method",
    "calibration_run_id",
    "reconciliation_method",
    "feature_version",
    "code_sha",
    "data_cutoff",
)


def incomplete_entities(rows: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ("entity_key_json",)) -> DataFrame:
    """Entities whose set of horizons is not exactly the contract's."""
    expected = sorted(horizons)
    known = F.col("horizon").isin(expected)
    return (
        rows.groupBy(*keys)
        .agg(
            F.count_distinct(F.when(known, F.col("horizon"))).alias("known_horizons"),
            F.count_if(~known).alias("foreign_rows"),
        )
        .filter((F.col("known_horizons") != len(expected)) | (F.col("foreign_rows") > 0))
    )


def batch_report(rows: DataFrame, c: ForecastContract) -> DataFrame:
    """One row of violation counts for a publication batch; all zero passes."""
    require_columns(rows, BATCH_REQUIRED, "publication rows")
    needed = [n for n in BATCH_REQUIRED if n != "reconciliation_method"]
    if c.reconciliation_policy == "none":
        lineage = F.coalesce("reconciliation_method", F.lit("none")) != "none"
    else:
        lineage = any_of(
            [F.col(n).isNull() for n in ("hierarchy_version", "reconciliation_method", "reconciliation_run_id")]
        )
    p10, p50, p90 = F.col("prediction_p10"), F.col("prediction_p50"), F.col("prediction_p90")
    facts = rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("forecast_run_id").alias("run_count"),
        F.count_if(F.col("forecast_contract_hash") != c.hash).alias("foreign_contract_count"),
        F.count_if(any_of([F.col(n).isNull() for n in needed])).alias("null_lineage_count"),
        F.count_if((p10 > p50) | (p50 > p90)).alias("crossed_quantile_count"),
        F.count_if(lineage).alias("reconciliation_lineage_count"),
    )
    repeated = rows.groupBy("forecast_output_id").count().filter("count > 1").agg(
        F.count(F.lit(1)).alias("duplicate_id_count")
    )
    partial = incomplete_entities(rows, c.horizons).agg(F.count(F.lit(1)).alias("incomplete_entity_count"))
    return facts.join(repeated, F.lit(True)).join(partial, F.lit(True))


def validate_batch(rows: DataFrame, c: ForecastContract) -> None:
    """Fail closed unless the batch is complete, calibrated and reconciled."""
    r = batch_report(rows, c).first().asDict()
    if r.pop("row_count") == 0:
        raise ValueError("publication batch cannot be empty")
    if r.pop("run_count") != 1:
        raise ValueError("publication batch must contain exactly one forecast run")
    broken = {k: v for k, v in r.items() if v}
    if broken:
        raise ValueError(f"publication batch rejected: {broken}")


def status_events(
    rows: DataFrame,
    previous: Column,
    changed_at: Column,
    changed_by: str,
    reason_code: str | None = None,
    check: bool = True,
) -> DataFrame:
    """Lifecycle event per output; an invalid transition rejects the batch."""
    _require_text(changed_by=changed_by)
    moved = rows.withColumns({"previous_status": previous, "new_status": F.col("forecast_status")})
    if check:
        allowed = transition_allowed(F.col("previous_status"), F.col("new_status"), STATUS_TRANSITIONS)
        require(moved, {"invalid status transition": ~allowed}, "status events")
    identity = ["forecast_output_id", "forecast_run_id", "previous_status", "new_status"]
    return moved.select(
        stable_id(identity).alias("status_event_id"),
        *identity,
        changed_at.alias("changed_at"),
        F.lit(changed_by).alias("changed_by"),
        F.lit(reason_code).cast("string").alias("reason_code"),
    )


def override(
    rows: DataFrame,
    value: Column,
    reason_code: Column,
    comment: Column,
    actor: Column,
    idempotency_key: Column,
    at: Column,
) -> DataFrame:
    """Planner adjustments; the canonical rows stay as they are."""
    made = rows.withColumns(
        {
            "override_value": value.cast("double"),
            "reason_code": reason_code,
            "comment": comment,
            "overridden_by": actor,
            "idempotency_key": idempotency_key,
        }
    )
    require(
        made,
        {
            "override value must be nonnegative": F.col("override_value").isNull() | (F.col("override_value") < 0),
            "reason, comment, actor and key are required": any_of(
                [blank(n) for n in ("reason_code", "comment", "overridden_by", "idempotency_key")]
            ),
        },
        "overrides",
    )
    return made.select(
        stable_id(["idempotency_key", "forecast_output_id", "override_value"]).alias("override_id"),
        "idempotency_key",
        "forecast_output_id",
        "forecast_run_id",
        "override_value",
        "reason_code",
        "comment",
        at.alias("overridden_at"),
        "overridden_by",
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest row per key; Spark prunes to one row per key before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def newest_overrides(overrides: DataFrame) -> DataFrame:
    return latest_by(
        overrides, ["forecast_output_id"], [F.desc("overridden_at"), F.desc("override_id")]
    )


def approve(
    rows: DataFrame, overrides: DataFrame | None, actor: str, key: str, reason_code: str, comment: str, at: Column
) -> DataFrame:
    """Approve every output at its newest override, or its median."""
    _require_text(actor=actor, idempotency_key=key, reason_code=reason_code, comment=comment)
    base = rows.select("forecast_output_id", "forecast_run_id", "prediction_p50")
    if overrides is None:
        chosen = base.withColumns(
            {"override_id": F.lit(None).cast("string"), "override_value": F.lit(None).cast("double")}
        )
    else:
        picked = newest_overrides(overrides).select("forecast_output_id", "override_id", "override_value")
        chosen = base.join(picked, "forecast_output_id", "left")
    value = F.coalesce("override_value", F.col("prediction_p50").cast("double"))
    return chosen.select(
        stable_id(
            {
                "idempotency_key": F.lit(key),
                "forecast_output_id": F.col("forecast_output_id"),
                "override_id": F.col("override_id"),
            }
        ).alias("approval_id"),
        F.lit(key).alias("idempotency_key"),
        "forecast_output_id",
        "forecast_run_id",
        "override_id",
        F.lit("approved").alias("decision"),
        value.alias("approved_value"),
        F.lit(reason_code).alias("reason_code"),
        F.lit(comment).alias("comment"),
        at.alias("decided_at"),
        F.lit(actor).alias("decided_by"),
    )


def publish(
    rows: DataFrame,
    approvals: DataFrame,
    version: int,
    destination: str,
    actor: str,
    key: str,
    at: Column,
    check: bool = True,
) -> DataFrame:
    """Publish one complete, explicit approval set."""
    if version < 1:
        raise ValueError("publication version must be positive")
    _require_text(actor=actor, destination=destination, idempotency_key=key)
    outputs = rows.select("forecast_output_id", "forecast_run_id")
    decided = approvals.select("forecast_output_id", "approval_id", "decision", "approved_value")
    if check:
        require_unique(decided, ["forecast_output_id"], "approvals")
        both = outputs.withColumn("_o", F.lit(True)).join(
            decided.withColumn("_a", F.lit(True)), "forecast_output_id", "full_outer"
        )
        facts = require(
            both,
            {
                "approval set must match the complete run": F.col("_o").isNull() | F.col("_a").isNull(),
                "only approved decisions with values are published": (F.col("decision") != "approved")
                | F.col("approved_value").isNull(),
            },
            "publication",
        )
        if facts["rows"] == 0:
            raise ValueError("publication: no outputs")
    return outputs.join(decided, "forecast_output_id").select(
        stable_id(
            {
                "idempotency_key": F.lit(key),
                "forecast_output_id": F.col("forecast_output_id"),
                "publication_version": F.lit(version),
                "destination": F.lit(destination),
            }
        ).alias("publication_id"),
        F.lit(key).alias("idempotency_key"),
        "forecast_output_id",
        "forecast_run_id",
        "approval_id",
        F.lit(version).alias("publication_version"),
        F.col("approved_value").cast("double").alias("published_value"),
        F.lit(destination).alias("destination"),
        F.lit("pending").alias("delivery_status"),
        F.lit(None).cast("string").alias("delivery_reference"),
        at.alias("published_at"),
        F.lit(actor).alias("published_by"),
    )


def auto_publish(
    rows: DataFrame, version: int, destination: str, actor: str, key: str, at: Column, check: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Approvals and publications straight from the medians."""
    reason, comment = "automatic_quality_gates_passed", "Approved by scheduled publication flow"
    approvals = approve(rows, None, actor, key, reason, comment, at)
    return approvals, publish(rows, approvals, version, destination, actor, key, at, check)


def _revisions(prior, replacement, revision_type, actor, key, reason_code, comment, at) -> DataFrame:
    new = replacement.select("forecast_output_id", F.col("publication_id").alias("replacement_publication_id"))
    old = prior.select(
        "forecast_output_id", "forecast_run_id", F.col("publication_id").alias("prior_publication_id")
    )
    return old.join(new, "forecast_output_id").select(
        stable_id(
            {
                "idempotency_key": F.lit(key),
                "prior_publication_id": F.col("prior_publication_id"),
                "replacement_publication_id": F.col("replacement_publication_id"),
            }
        ).alias("revision_id"),
        F.lit(key).alias("idempotency_key"),
        "forecast_output_id",
        "forecast_run_id",
        "prior_publication_id",
        "replacement_publication_id",
        F.lit(revision_type).alias("revision_type"),
        F.lit(reason_code).alias("reason_code"),
        F.lit(comment).alias("comment"),
        at.alias("revised_at"),
        F.lit(actor).alias("revised_by"),
    )


def rollback(
    prior: DataFrame, version: int, actor: str, key: str, reason_code: str, comment: str, at: Column, check: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Republish prior values as a higher version, with revision lineage."""
    head = prior.agg(F.max("publication_version"), F.min("destination")).first()
    if head[0] is None:
        raise ValueError("rollback needs prior publications")
    if version <= head[0]:
        raise ValueError("new version must exceed the prior publication version")
    rows = prior.select(
        "forecast_output_id", "forecast_run_id", F.col("published_value").alias("prediction_p50")
    )
    approvals = approve(rows, None, actor, key, reason_code, comment, at)
    replacement = publish(rows, approvals, version, head[1], actor, key, at, check)
    lineage = _revisions(prior, replacement, "rollback", actor, key, reason_code, comment, at)
    return approvals, replacement, lineage


def supersede(
    prior: DataFrame, replacement: DataFrame, actor: str, key: str, reason_code: str, comment: str, at: Column
) -> DataFrame:
    """Link two complete versions of the same outputs one to one."""
    ids = ["forecast_output_id"]
    require_unique(prior, ids, "prior version")
    require_unique(replacement, ids, "replacement version")
    both = prior.select(*ids).withColumn("_p", F.lit(True)).join(
        replacement.select(*ids).withColumn("_r", F.lit(True)), ids, "full_outer"
    )
    require(
        both,
        {"versions must cover the same outputs": F.col("_p").isNull() | F.col("_r").isNull()},
        "revision",
    )
    return _revisions(prior, replacement, "supersede", actor, key, reason_code, comment, at)


def check_version(existing: DataFrame, version: int, key: str, expected_rows: int | None = None) -> str:
    """``new`` for a version to write, ``retry`` for one already complete."""
    same = F.col("publication_version") == version
    facts = existing.agg(
        F.max("publication_version").alias("top"),
        F.count_if(same).alias("rows"),
        F.count_if(same & (F.col("idempotency_key") != key)).alias("foreign"),
    ).first()
    if facts["foreign"]:
        raise ValueError("publication version already exists with a different idempotency key")
    if facts["rows"]:
        if expected_rows is not None and facts["rows"] != expected_rows:
            raise ValueError("persisted publication retry is incomplete")
        return "retry"
    if facts["top"] is not None and version <= facts["top"]:
        raise ValueError("publication version must exceed all earlier versions")
    return "new"


def publication_event(
    publications: DataFrame, outputs: DataFrame, event_type: str, actor: str, prior_version: int | None = None
) -> DataFrame:
    """One event per complete published version."""
    if event_type not in PUBLICATION_EVENTS:
        raise ValueError(f"event type must be one of {PUBLICATION_EVENTS}")
    _require_text(actor=actor)
    scope = outputs.select("forecast_output_id", "forecast_contract_name", "forecast_contract_hash")
    versions = publications.join(scope, "forecast_output_id").groupBy(
        "forecast_run_id",
        "forecast_contract_name",
        "forecast_contract_hash",
        "publication_version",
        "destination",
        "idempotency_key",
    ).agg(F.count(F.lit(1)).alias("row_count"), F.max("published_at").alias("occurred_at"))
    kinded = versions.withColumn("event_type", F.lit(event_type))
    identity = ["idempotency_key", "event_type", "forecast_run_id", "publication_version", "destination"]
    payload = {
        n: F.col(n)
        for n in (
            "event_type",
            "forecast_run_id",
            "forecast_contract_name",
            "forecast_contract_hash",
            "publication_version",
            "destination",
            "row_count",
        )
    }
    if prior_version is not None:
        payload["prior_version"] = F.lit(prior_version)
    return kinded.withColumns(
        {
            "publication_event_id": stable_id(identity),
            "occurred_by": F.lit(actor),
            "payload_json": canonical_json(payload),
        }
    )


def delivery_event(
    scopes: DataFrame,
    events: DataFrame,
    action: str,
    actor: str,
    key: str,
    at: Column,
    reference: str | None = None,
    error_code: str | None = None,
    error_message: str | None = None,
    check: bool = True,
) -> DataFrame:
    """Next delivery event of every (run, version, destination) in ``scopes``.

    The prior state is the latest event of the scope; ``start`` and ``retry``
    open a new attempt. With ``check=False`` scopes whose state does not allow
    the action are left out instead of rejecting the batch.
    """
    if action not in DELIVERY_ACTIONS:
        raise ValueError(f"action must be one of {sorted(DELIVERY_ACTIONS)}")
    status = DELIVERY_ACTIONS[action]
    _require_text(actor=actor, idempotency_key=key)
    if status == "delivered" and not reference:
        raise ValueError("delivered events require a reference")
    if status == "failed" and not error_message:
        raise ValueError("failed events require an error message")
    keys = ["forecast_run_id", "publication_version", "destination"]
    prior = latest_by(events, keys, [F.desc("occurred_at"), F.desc("delivery_event_id")]).select(
        *keys, F.col("delivery_status").alias("prior_status"), F.col("delivery_attempt").alias("prior_attempt")
    )
    known = scopes.select(*keys).join(prior, keys, "left")
    allowed = transition_allowed(F.col("prior_status"), F.lit(status), DELIVERY_TRANSITIONS)
    if check:
        require(known, {f"invalid delivery transition to {status}": ~allowed}, "delivery")
    else:
        known = known.filter(allowed)
    opened = 1 if action in ("start", "retry") else 0
    made = known.withColumns(
        {
            "delivery_status": F.lit(status),
            "delivery_attempt": F.coalesce("prior_attempt", F.lit(0)) + opened,
            "idempotency_key": F.lit(key),
        }
    )
    identity = ["idempotency_key", *keys, "delivery_status", "delivery_attempt"]
    text = lambda v: F.lit(v).cast("string")
    return made.select(
        stable_id(identity).alias("delivery_event_id"),
        *identity,
        text(reference).alias("delivery_reference"),
        text(error_code).alias("error_code"),
        text(error_message).alias("error_message"),
        at.alias("occurred_at"),
        F.lit(actor).alias("occurred_by"),
    )


def delivery_ready(publications: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per published version: is it complete and free of duplicates?"""
    keys = ["forecast_run_id", "publication_version", "destination"]
    expected = outputs.groupBy("forecast_run_id").agg(F.count(F.lit(1)).alias("expected_output_count"))
    made = publications.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("publication_count"),
        F.count_distinct("publication_id").alias("distinct_publication_count"),
    )
    n = F.col("publication_count")
    ready = (n >= 1) & (n == F.col("distinct_publication_count")) & (n == F.col("expected_output_count"))
    return (
        made.join(expected, "forecast_run_id", "left")
        .withColumn("expected_output_count", F.coalesce("expected_output_count", F.lit(0)))
        .withColumn("is_ready", F.coalesce(ready, F.lit(False)))
    )


# --- typed projections ----------------------------------------------------------------
# Ledger name -> its identity column.
LEDGER_IDS = {
    "approvals": "approval_id",
    "contracts": "forecast_contract_hash",
    "cost_events": "cost_event_id",
    "delivery_events": "delivery_event_id",
    "eligibility_decisions": "eligibility_decision_id",
    "exceptions": "exception_id",
    "overrides": "override_id",
    "stage_runs": "stage_run_id",
    "publication_events": "publication_event_id",
    "publications": "publication_id",
    "revisions": "revision_id",
    "runs": "forecast_run_id",
    "classifications": "classification_id",
    "status_history": "status_event_id",
    "validation_checks": "validation_check_id",
    "lifecycle_events": "lifecycle_event_id",
    "promotion_checks": "promotion_check_id",
    "ingestion_runs": "ingestion_run_id",
    "job_runs": "job_run_id",
    "explain": "explanation_id",
    "metadata": "model_run_id",
    "performance": "model_run_id",
    "predictions": "prediction_id",
    "backtest_predictions": "prediction_id",
    "backtest_metrics": "metric_id",
    "backtest_runs": "backtest_run_id",
}

# Column names and types of the ledgers that other systems read.
LEDGER_SCHEMAS = {
    "overrides": "override_id string not null, idempotency_key string, forecast_output_id string not null, "
    "forecast_run_id string, override_value double not null, reason_code string, comment string, "
    "overridden_at timestamp, overridden_by string",
    "approvals": "approval_id string not null, idempotency_key string, forecast_output_id string not null, "
    "forecast_run_id string, override_id string, decision string not null, approved_value double, reason_code string, "
    "comment string, decided_at timestamp, decided_by string",
    "publications": "publication_id string not null, idempotency_key string, forecast_output_id string not null, "
    "forecast_run_id string, approval_id string, publication_version int not null, published_value double, "
    "destination string, delivery_status string, delivery_reference string, published_at timestamp, published_by string",
    "revisions": "revision_id string not null, prior_publication_id string, replacement_publication_id string, "
    "revision_type string not null, reason_code string, revised_at timestamp, revised_by string",
    "delivery_events": "delivery_event_id string not null, forecast_run_id string, publication_version int, "
    "destination string, delivery_status string not null, delivery_attempt int, delivery_reference string, "
    "error_code string, error_message string, occurred_at timestamp, occurred_by string",
    "backtest_runs": "backtest_run_id string not null, backtest_contract_name string, backtest_contract_hash string, "
    "model_config_name string, model_family string, model_type string, target string, grain string, "
    "metric_policy_json string, origin_start date, origin_end date, prediction_count long, status string, "
    "created_at timestamp",
    "backtest_metrics": "metric_id string not null, backtest_run_id string not null, backtest_contract_name string, "
    "backtest_contract_hash string, forecast_origin date, horizon int, baseline_name string, segment_key_json string, "
    "eligible_count long, prediction_count long, wape double, mae double, mase double, rmsse double, bias double, "
    "prediction_completeness double, interval_coverage double, created_at timestamp",
    "backtest_predictions": "prediction_id string not null, backtest_run_id string not null, "
    "backtest_contract_name string, backtest_contract_hash string, forecast_origin date, target_date date, horizon int, "
    "store_nbr long, region string, baseline_name string, actual double, prediction double, prediction_p10 double, "
    "prediction_p50 double, prediction_p90 double, feature_availability_hash string",
}


def typed(df: DataFrame, schema: StructType | str, extras: str = "drop") -> DataFrame:
    """A ledger's columns in the types of a declared schema.

    A value that does not fit its type, or a NULL where the schema has none, fails the
    read. ``extras`` is the rule for columns that the schema does not name, as a writer of
    a later version may add them: "drop", "keep" (after the declared ones) or "refuse".
    """
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    require_columns(df, kinds.fieldNames(), "ledger")
    names = {n.lower() for n in kinds.fieldNames()}
    added = [c for c in df.columns if c.lower() not in names]
    if extras not in ("drop", "keep", "refuse"):
        raise ValueError("extras must be drop, keep or refuse")
    if added and extras == "refuse":
        raise ValueError(f"ledger has undeclared columns: {added}")

    def column(f) -> Column:
        value, kind = F.col(f.name), f.dataType.simpleString()
        read = F.expr(f"try_cast(`{f.name}` as {kind})")
        bad = F.raise_error(F.concat(F.lit(f"ledger column {f.name} is not {kind}: "), value.cast("string")))
        out = F.when(value.isNotNull() & read.isNull(), bad).otherwise(read)
        if not f.nullable:
            out = F.when(value.isNull(), F.raise_error(F.lit(f"ledger column {f.name} is null"))).otherwise(out)
        return out.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in kinds], *(added if extras == "keep" else ()))


def ledger(spark: SparkSession, path: str, name: str, partition_filter: Column | None = None,
           schema: StructType | str | None = None, extras: str = "drop") -> DataFrame:
    """A ledger relation; the identity column must be there. It is read in the types of
    ``schema``, or of its declared one; a ledger without either keeps those stored."""
    if name not in LEDGER_IDS:
        raise ValueError(f"unknown ledger {name!r}")
    df = spark.read.parquet(f"{path}/{name}")
    require_columns(df, [LEDGER_IDS[name]], f"ledger {name}")
    kept = df if partition_filter is None else df.filter(partition_filter)
    schema = schema or LEDGER_SCHEMAS.get(name)
    return kept if schema is None else typed(kept, schema, extras)
