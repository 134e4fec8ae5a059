"""Published, draft and audit views over the forecast ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.operators.ledger import latest_by

VISIBLE = ("draft", "approved", "published")
OUTPUT_KEYS = ["forecast_output_id", "forecast_run_id"]


def published_by_run(pubs: DataFrame, outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every published row with its output and the run's feature lineage."""
    p = pubs.select(
        *OUTPUT_KEYS,
        "publication_id",
        "publication_version",
        "destination",
        "delivery_status",
        "published_value",
        "published_at",
        "published_by",
    )
    r = runs.select("forecast_run_id", "feature_availability_hash")
    return p.join(outputs.drop("published_forecast"), OUTPUT_KEYS).join(r, "forecast_run_id")


def published_current(pbr: DataFrame) -> DataFrame:
    """Newest publication per contract, entity, target, horizon, destination."""
    return latest_by(
        pbr,
        ["forecast_contract_name", "entity_key_json", "target_date", "horizon", "destination"],
        [F.desc("published_at"), F.desc("publication_version"), F.desc("publication_id")],
    )


def visible_drafts(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    keys = ["forecast_run_id", "forecast_contract_name", "forecast_contract_hash"]
    shown = runs.filter(F.col("run_status").isin(*VISIBLE)).select(*keys)
    return outputs.filter(F.col("forecast_status").isin(*VISIBLE)).join(shown, keys)


def override_audit(overrides: DataFrame, outputs: DataFrame, approvals: DataFrame) -> DataFrame:
    """Each override with the forecast it changed and any decision on it."""
    o = outputs.select(
        *OUTPUT_KEYS,
        "forecast_contract_name",
        "forecast_contract_hash",
        "entity_key_json",
        "forecast_origin",
        "target_date",
        "horizon",
        F.col("prediction_p50").alias("statistical_forecast"),
    )
    a = approvals.select(
        "override_id", *OUTPUT_KEYS, "approval_id", "decision", "approved_value", "decided_at", "decided_by"
    )
    return overrides.join(o, OUTPUT_KEYS).join(a, ["override_id", *OUTPUT_KEYS], "left")


def publication_audit(
    pubs: DataFrame, outputs: DataFrame, approvals: DataFrame, revisions: DataFrame
) -> DataFrame:
    """Publications with decisions and the revisions that touch them on either end.

    "Prior or replacement id" is a join on either of two keys. Each revision is
    listed under both of its ends, which makes it one equality join; a revision
    of a publication by itself is listed once.
    """
    r = revisions.select(
        "revision_id",
        "prior_publication_id",
        "replacement_publication_id",
        "revision_type",
        F.col("reason_code").alias("revision_reason_code"),
        "revised_at",
        "revised_by",
        F.explode(F.array_distinct(F.array("prior_publication_id", "replacement_publication_id"))).alias(
            "publication_id"
        ),
    )
    a = approvals.select("approval_id", *OUTPUT_KEYS, "override_id", "decided_at", "decided_by")
    o = outputs.select(*OUTPUT_KEYS, "forecast_contract_name", "forecast_contract_hash")
    return (
        pubs.join(o, OUTPUT_KEYS)
        .join(a, ["approval_id", *OUTPUT_KEYS])
        .join(r, "publication_id", "left")
    )


def event_audit(events: DataFrame) -> DataFrame:
    return events


def delivery_current(pbr: DataFrame, events: DataFrame) -> DataFrame:
    """Published versions with their latest delivery event; pending by default."""
    keys = ["forecast_run_id", "publication_version", "destination"]
    versions = pbr.groupBy(
        "forecast_run_id",
        "forecast_contract_name",
        "forecast_contract_hash",
        "publication_version",
        "destination",
    ).agg(F.count(F.lit(1)).alias("publication_row_count"), F.min("published_at").alias("published_at"))
    latest = latest_by(events, keys, [F.desc("occurred_at"), F.desc("delivery_event_id")])
    return versions.join(latest, keys, "left").select(
        *keys,
        "forecast_contract_name",
        "forecast_contract_hash",
        "publication_row_count",
        "published_at",
        "delivery_event_id",
        F.coalesce("delivery_status", F.lit("pending")).alias("delivery_status"),
        F.coalesce("delivery_attempt", F.lit(1)).alias("delivery_attempt"),
        "delivery_reference",
        "error_code",
        "error_message",
        F.coalesce("occurred_at", "published_at").alias("delivery_status_at"),
        "occurred_by",
        F.when(F.col("delivery_event_id").isNull(), "publication_default")
        .otherwise("delivery_event")
        .alias("status_source"),
    )
