"""Queries over ledgers (FP), lifecycle (LC) and ledger staging (ST10-ST13)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from foresail.contracts import ForecastContract, PromotionGates
from foresail.operators import ledger as le
from foresail.operators import lifecycle as lc
from foresail.operators import models as ml
from foresail.operators import publication as pu
from foresail.operators import staging as st
from foresail.plans.registry import Source, query
from foresail.plans.relations import MIRRORS
from foresail.session import work_root
from foresail.sources import writers


def sha(**fields: str) -> str:
    """Checking-engine text of a stable id over named SQL expressions."""
    body = ", ".join(f"'{k}': {fields[k]}" for k in sorted(fields))
    return f"sha256(to_json({{{body}}})::varchar)"


# --- staging of ledgers --------------------------------------------------------------
@query(
    "st10_stage_backtest",
    "metric_id model_config_name target grain primary_metric forecast_origin:d horizon:i baseline_name wape:f",
    "select * from staged_metrics",
)
def stage_backtest(s: Source):
    return st.stage_backtest(s.rel("bt_metric_ledger"), s.rel("bt_run_ledger"))


@query(
    "st11_stage_candidates",
    "candidate_id model_scope_key model_config_name",
    """select *, '{"grain":"' || json_extract_string(model_scope_json, '$.grain') || '","target":"demand"}'
              as model_scope_key from candidate_ledger""",
)
def stage_candidates(s: Source):
    return st.stage_candidates(s.rel("candidate_ledger"))


@query(
    "st12_stage_outputs",
    "forecast_output_id contract_enforced:b",
    "select forecast_output_id, coalesce(contract_enforced, false) as contract_enforced from outputs",
)
def stage_outputs(s: Source):
    return st.stage_outputs(s.rel("outputs"))


@query(
    "st13_ledger_projection",
    "forecast_output_id forecast_run_id forecast_contract_name forecast_contract_hash contract_enforced:b "
    "forecast_origin:t target_date:d horizon:i grain entity_key_json prediction_p10:f prediction_p50:f "
    "prediction_p90:f confidence_flag forecast_strategy statistical_forecast:f planner_override:f "
    "published_forecast:f forecast_status model_run_id model_id config_name model_family feature_version code_sha "
    "data_cutoff:t calibration_method calibration_run_id reconciliation_method",
    "select * from outputs",
)
def projection(s: Source):
    # the ledger as it would arrive from a text export, with the schema it was declared with
    raw = s.rel("outputs")
    return le.typed(raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]), raw.schema)


LEDGER_RELATIONS = {n: n for n in ("overrides", "approvals", "publications", "revisions", "delivery_events")} | {
    "backtest_runs": "bt_run_ledger", "backtest_metrics": "bt_metric_ledger", "backtest_predictions": "bt_pred_ledger",
}
KINDS = {"string": "s", "int": "i", "long": "i", "double": "f", "date": "d", "timestamp": "t", "boolean": "b"}


def _declared(name: str, relation: str) -> None:
    """A ledger stored as text by another writer, with a column of a later version."""
    fields = [f.split()[:2] for f in le.LEDGER_SCHEMAS[name].split(", ")]
    spec = " ".join(f"{column}:{KINDS[kind]}" for column, kind in fields)

    @query(f"st13_{name}", f"{spec} later_column", f"select *, 'v2' as later_column from {relation}")
    def read(s: Source):
        raw = s.rel(relation)
        path = f"{work_root(s.spark)}/foresail-text-{uuid.uuid4().hex}"
        text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns], F.lit("v2").alias("later_column"))
        text.write.parquet(f"{path}/{name}")
        return le.ledger(s.spark, path, name, extras="keep")


for _name, _relation in LEDGER_RELATIONS.items():
    _declared(_name, _relation)


# --- canonical rows and operations -------------------------------------------------------
CONTRACT = ForecastContract("store_demand", ("store_nbr",), tuple(range(1, 8)))


def predictions(s: Source):
    text = lambda v: F.lit(v)
    return s.rel("outputs_raw").select(
        "store_nbr",
        F.col("origin").alias("date"),
        F.col("horizon").alias("forecast_horizon"),
        text("run").alias("predict_run_id"),
        F.md5(F.concat_ws("|", "store_nbr", "target_date")).alias("prediction_id"),
        text("m1").alias("model_id"),
        text("mr1").alias("model_run_id"),
        text("store_gbt").alias("config_name"),
        text("gbt").alias("model_type"),
        text("models/m1").alias("model_artifact_uri"),
        F.col("p50").alias("prediction"),
        (F.col("p50") * 0.5).alias("prediction_lower"),
        (F.col("p50") * 1.5).alias("prediction_upper"),
        text("split_conformal").alias("calibration_method"),
        text("cal1").alias("calibration_run_id"),
        F.col("origin").cast("timestamp").alias("run_at"),
    )


def canonical(s: Source):
    return le.forecast_rows(predictions(s), CONTRACT, "v1", "abc", F.col("date").cast("timestamp"))


MIRRORS["canonical_rows"] = f"""
select {sha(contract_hash=f"'{CONTRACT.hash}'", entity_key_json="to_json({'store_nbr': store_nbr})::varchar",
            forecast_run_id="'run'", horizon="horizon", target_date="cast(target_date as varchar)")}
         as forecast_output_id, md5(store_nbr || '|' || target_date) as source_prediction_id, store_nbr, target_date,
       horizon, origin as forecast_origin, p50 * 0.5 as prediction_p10, p50 as prediction_p50, p50 * 1.5 as prediction_p90,
       to_json({{'store_nbr': store_nbr}})::varchar as entity_key_json, 'draft' as forecast_status
from outputs_raw"""


@query(
    "fp1_forecast_rows",
    "forecast_output_id source_prediction_id entity_key_json forecast_origin:d target_date:d horizon:i "
    "prediction_p10:f prediction_p50:f prediction_p90:f forecast_status",
    "select * from canonical_rows",
)
def forecast_rows(s: Source):
    return canonical(s)


@query(
    "fp6_publication_batch_report",
    "row_count:i run_count:i foreign_contract_count:i null_lineage_count:i crossed_quantile_count:i "
    "duplicate_id_count:i incomplete_entity_count:i reconciliation_lineage_count:i",
    """select count(*) as row_count, 1 as run_count, 0 as foreign_contract_count, 0 as null_lineage_count,
              0 as crossed_quantile_count, 0 as duplicate_id_count, 0 as reconciliation_lineage_count,
              (select count(*) from (select store_nbr from canonical_rows group by 1
                                     having count(distinct horizon) <> 7)) as incomplete_entity_count
       from canonical_rows""",
)
def batch_report(s: Source):
    return le.batch_report(canonical(s), CONTRACT)


@query(
    "fp9_status_events",
    "forecast_output_id previous_status new_status",
    "select forecast_output_id, cast(null as varchar) as previous_status, 'draft' as new_status from outputs",
)
def status_events(s: Source):
    rows = s.rel("outputs").withColumn("forecast_status", F.lit("draft"))
    return le.status_events(rows, F.lit(None).cast("string"), F.col("forecast_origin"), "job")


@query(
    "fp10_overrides",
    "forecast_output_id override_value:f reason_code overridden_by",
    """select forecast_output_id, prediction_p50 * 1.2 as override_value, 'promotion' as reason_code,
              'planner_' || horizon as overridden_by from outputs where horizon >= 5""",
)
def overrides(s: Source):
    rows = s.rel("outputs").filter("horizon >= 5")
    return le.override(
        rows,
        F.col("prediction_p50") * 1.2,
        F.lit("promotion"),
        F.lit("seen"),
        F.concat(F.lit("planner_"), F.col("horizon").cast("string")),
        F.lit("key"),
        F.col("forecast_origin"),
    )


APPROVED_SPEC = "forecast_output_id override_id decision approved_value:f decided_by"
MIRRORS["approved_all"] = f"""
select {sha(idempotency_key="'k1'", forecast_output_id="o.forecast_output_id", override_id="v.override_id")} as approval_id,
       o.forecast_output_id, o.forecast_run_id, v.override_id, 'approved' as decision,
       coalesce(v.override_value, o.prediction_p50) as approved_value, 'planner' as decided_by
from outputs o left join (select * from (select * from overrides union all
   select override_id || '2', idempotency_key, forecast_output_id, forecast_run_id, override_value + 5, reason_code, comment,
          overridden_at + interval 1 hour, overridden_by from overrides where reason_code = 'promotion')
   qualify row_number() over (partition by forecast_output_id order by overridden_at desc, override_id desc) = 1) v
  on v.forecast_output_id = o.forecast_output_id"""


def two_rounds(s: Source):
    first = s.rel("overrides")
    second = first.filter("reason_code = 'promotion'").withColumns(
        {
            "override_id": F.concat("override_id", F.lit("2")),
            "override_value": F.col("override_value") + 5,
            "overridden_at": F.col("overridden_at") + F.expr("interval 1 hour"),
        }
    )
    return first.unionByName(second)


def approvals_of(s: Source):
    at = F.lit(s.train_end).cast("timestamp")
    return le.approve(s.rel("outputs"), two_rounds(s), "planner", "k1", "weekly", "ok", at)


@query("fp11_approve", f"approval_id {APPROVED_SPEC}", "select * from approved_all")
def approve(s: Source):
    return approvals_of(s)


PUBLISHED_SPEC = "publication_id forecast_output_id approval_id publication_version:i published_value:f delivery_status"


def _published_sql(key: str, version: int, approvals: str) -> str:
    pid = sha(
        idempotency_key=f"'{key}'", forecast_output_id="forecast_output_id", publication_version=str(version),
        destination="'warehouse'",
    )
    return f"""select {pid} as publication_id, forecast_output_id, approval_id, {version} as publication_version,
      approved_value as published_value, 'pending' as delivery_status from {approvals}"""


@query("fp12_publish", PUBLISHED_SPEC, _published_sql("k1", 1, "approved_all"))
def publish(s: Source):
    at = F.lit(s.train_end).cast("timestamp")
    return le.publish(s.rel("outputs"), approvals_of(s), 1, "warehouse", "planner", "k1", at)


MIRRORS["auto_approved"] = f"""
select {sha(idempotency_key="'k2'", forecast_output_id="forecast_output_id", override_id="cast(null as varchar)")} as approval_id,
       forecast_output_id, prediction_p50 as approved_value from outputs"""


@query("fp13_auto_publish", PUBLISHED_SPEC, _published_sql("k2", 1, "auto_approved"))
def auto_publish(s: Source):
    at = F.lit(s.train_end).cast("timestamp")
    return le.auto_publish(s.rel("outputs"), 1, "warehouse", "job", "k2", at)[1]


def first_version(s: Source):
    return s.rel("publications").filter("publication_version = 1")


@query(
    "fp14_rollback",
    "forecast_output_id prior_publication_id replacement_publication_id revision_type",
    f"""select forecast_output_id, publication_id as prior_publication_id, 'rollback' as revision_type,
          {sha(idempotency_key="'k3'", forecast_output_id="forecast_output_id", publication_version="9",
               destination="'warehouse'")} as replacement_publication_id
        from publications where publication_version = 1""",
)
def rollback(s: Source):
    at = F.lit(s.train_end).cast("timestamp")
    return le.rollback(first_version(s), 9, "planner", "k3", "bad_feed", "restore", at)[2]


@query(
    "fp15_supersede",
    "forecast_output_id prior_publication_id replacement_publication_id revision_type",
    """select a.forecast_output_id, a.publication_id as prior_publication_id,
              b.publication_id as replacement_publication_id, 'supersede' as revision_type
       from publications a join publications b using (forecast_output_id)
       where a.publication_version = 1 and b.publication_version = 2""",
)
def supersede(s: Source):
    at = F.lit(s.train_end).cast("timestamp")
    second = s.rel("publications").filter("publication_version = 2")
    prior = first_version(s).join(second.select("forecast_output_id"), "forecast_output_id", "left_semi")
    return le.supersede(prior, second, "planner", "k4", "correction", "fix", at)


@query(
    "fp17_publication_events",
    "forecast_run_id forecast_contract_name publication_version:i destination row_count:i event_type occurred_at:t",
    """select p.forecast_run_id, o.forecast_contract_name, p.publication_version, p.destination, count(*) as row_count,
              'forecast.published' as event_type, max(p.published_at) as occurred_at
       from publications p join outputs o using (forecast_output_id)
       group by p.forecast_run_id, o.forecast_contract_name, p.publication_version, p.destination, p.idempotency_key""",
)
def publication_events(s: Source):
    return le.publication_event(s.rel("publications"), s.rel("outputs"), "forecast.published", "job")


@query(
    "fp18_delivery_retry",
    "forecast_run_id publication_version:i destination delivery_status delivery_attempt:i",
    """select forecast_run_id, publication_version, destination, 'pending' as delivery_status,
              delivery_attempt + 1 as delivery_attempt
       from (select * from delivery_events qualify row_number() over (
               partition by forecast_run_id, publication_version, destination
               order by occurred_at desc, delivery_event_id desc) = 1) where delivery_status = 'failed'
       union all
       select distinct forecast_run_id, publication_version, destination, 'pending', 1 from publications p
       where not exists (select 1 from delivery_events e where e.forecast_run_id = p.forecast_run_id
                         and e.publication_version = p.publication_version)""",
)
def delivery_retry(s: Source):
    scopes = s.rel("publications").select("forecast_run_id", "publication_version", "destination").distinct()
    at = F.lit(s.train_end).cast("timestamp")
    return le.delivery_event(scopes, s.rel("delivery_events"), "retry", "job", "k5", at, check=False)


@query(
    "fp19_delivery_ready",
    "forecast_run_id publication_version:i publication_count:i expected_output_count:i is_ready:b",
    """select p.forecast_run_id, p.publication_version, count(*) as publication_count,
              max(o.n) as expected_output_count, count(*) = max(o.n) as is_ready
       from publications p join (select forecast_run_id, count(*) as n from outputs group by 1) o using (forecast_run_id)
       group by 1, 2""",
)
def delivery_ready(s: Source):
    return le.delivery_ready(s.rel("publications"), s.rel("outputs"))


@query(
    "fp16_version_state",
    "forecast_run_id top_version:i next_version:i",
    """select forecast_run_id, max(publication_version) as top_version, max(publication_version) + 1 as next_version
       from publications group by 1""",
)
def version_state(s: Source):
    top = F.max("publication_version")
    return s.rel("publications").groupBy("forecast_run_id").agg(
        top.alias("top_version"), (top + 1).alias("next_version")
    )


# --- views -----------------------------------------------------------------------------------
def pbr(s: Source):
    return pu.published_by_run(s.rel("publications"), s.rel("outputs"), s.rel("runs"))


PBR_SPEC = (
    "publication_id publication_version:i destination published_value:f published_at:t feature_availability_hash "
    "forecast_output_id forecast_contract_name entity_key_json target_date:d horizon:i prediction_p50:f"
)


@query("fp20_published_by_run", PBR_SPEC, "select * from pbr")
def published_by_run(s: Source):
    return pbr(s)


@query(
    "fp21_published_current",
    PBR_SPEC,
    """select * from pbr qualify row_number() over (
         partition by forecast_contract_name, entity_key_json, target_date, horizon, destination
         order by published_at desc, publication_version desc, publication_id desc) = 1""",
)
def published_current(s: Source):
    return pu.published_current(pbr(s))


@query(
    "fp22_visible_drafts",
    "forecast_output_id forecast_run_id forecast_status target_date:d prediction_p50:f",
    """select o.* from outputs o join runs r using (forecast_run_id, forecast_contract_name, forecast_contract_hash)
       where r.run_status in ('draft', 'approved', 'published')
         and o.forecast_status in ('draft', 'approved', 'published')""",
)
def visible_drafts(s: Source):
    return pu.visible_drafts(s.rel("outputs"), s.rel("runs"))


@query(
    "fp23_override_audit",
    "override_id override_value:f reason_code forecast_contract_name target_date:d statistical_forecast:f "
    "approval_id decision approved_value:f",
    """select v.*, o.forecast_contract_name, o.target_date, o.prediction_p50 as statistical_forecast, a.approval_id,
              a.decision, a.approved_value
       from overrides v join outputs o using (forecast_output_id, forecast_run_id)
       left join approvals a on a.override_id = v.override_id""",
)
def override_audit(s: Source):
    return pu.override_audit(s.rel("overrides"), s.rel("outputs"), s.rel("approvals"))


@query(
    "fp24_publication_audit",
    "publication_id publication_version:i approval_id override_id decided_by revision_id prior_publication_id "
    "replacement_publication_id revision_type",
    """select p.publication_id, p.publication_version, p.approval_id, a.override_id, a.decided_by, r.* exclude (either_id)
       from publications p join approvals a using (approval_id)
       left join (select *, prior_publication_id as either_id from revisions
                  union all select *, replacement_publication_id from revisions
                  where replacement_publication_id <> prior_publication_id) r on p.publication_id = r.either_id""",
)
def publication_audit(s: Source):
    return pu.publication_audit(s.rel("publications"), s.rel("outputs"), s.rel("approvals"), s.rel("revisions"))


@query(
    "fp25_event_audit",
    "delivery_event_id forecast_run_id delivery_status occurred_at:t",
    "select * from delivery_events",
)
def event_audit(s: Source):
    return pu.event_audit(s.rel("delivery_events"))


def delivery(s: Source):
    return pu.delivery_current(pbr(s), s.rel("delivery_events"))


@query(
    "fp26_delivery_current",
    "forecast_run_id forecast_contract_name publication_version:i destination publication_row_count:i published_at:t "
    "delivery_event_id delivery_status delivery_attempt:i error_code delivery_status_at:t status_source",
    "select * from delivery_now",
)
def delivery_current(s: Source):
    return delivery(s)


# --- lifecycle ----------------------------------------------------------------------------------
@query(
    "lc1_evaluate_candidate",
    "backtest_run_id check_name observed_value:f threshold_value:f passed:b",
    """with facts as (select m.backtest_run_id, avg(m.wape) as w, avg(m.prediction_completeness) as c, avg(m.bias) as b,
           any_value(x.best) as best, any_value(y.a) as a
         from bt_metric_ledger m
         join (select backtest_run_id, min(w) as best from (select backtest_run_id, baseline_name, avg(wape) as w
                 from bt_metric_ledger where baseline_name <> 'gbt_store' group by 1, 2) group by 1) x using (backtest_run_id)
         join (select backtest_run_id, avg(abs(actual)) as a from bt_pred_ledger where baseline_name = 'gbt_store'
                 and actual is not null and prediction is not null group by 1) y using (backtest_run_id)
         where m.baseline_name = 'gbt_store' group by 1)
       select backtest_run_id, 'baseline_improvement' as check_name, (best - w) / best as observed_value,
              0.05 as threshold_value, (best - w) / best >= 0.05 as passed from facts
       union all select backtest_run_id, 'absolute_bias', abs(b) / a, 0.01, abs(b) / a <= 0.01 from facts
       union all select backtest_run_id, 'prediction_completeness', c, 0.999, c >= 0.999 from facts
       union all select backtest_run_id, 'reproducible_artifact', 0.0, 1.0, false from facts""",
)
def evaluate_candidate(s: Source):
    gates = PromotionGates(0.05, 0.01, 0.999, True)
    return lc.evaluate_candidate(s.rel("bt_metric_ledger"), s.rel("bt_pred_ledger"), "gbt_store", gates, False)


@query(
    "lc2_promotion_events",
    "candidate_id event_type from_state to_state reason",
    """select distinct 'cand-' || user_id as candidate_id, 'promoted' as event_type,
              case when bool_and(value < 480) over (partition by user_id) then 'candidate' else 'rejected' end as from_state,
              'champion' as to_state, 'waived' as reason from events""",
)
def promotion_events(s: Source):
    checks = s.table("events").select(
        F.concat(F.lit("cand-"), F.col("user_id").cast("string")).alias("candidate_id"),
        (F.col("value") < 480).alias("passed"),
    )
    none = checks.select("candidate_id", F.lit(None).cast("string").alias("champion_id")).distinct()
    return lc.promote(checks, none, "actor", F.lit("2024-01-31").cast("timestamp"), waiver="waived")


MIRRORS["staged_candidates"] = """
select *, '{"grain":"' || json_extract_string(model_scope_json, '$.grain') || '","target":"demand"}' as model_scope_key
from candidate_ledger"""
MIRRORS["lifecycle_now"] = """
select c.candidate_id, c.model_scope_key, c.model_config_name, coalesce(e.state, c.initial_state) as lifecycle_state,
       e.lifecycle_event_id as latest_lifecycle_event_id, e.kind as latest_event_type, e.reason as latest_event_reason,
       e.occurred_at as latest_event_at
from staged_candidates c left join (
  select * from (
    select candidate_id, lifecycle_event_id, event_type as kind, to_state as state, reason, occurred_at, 1 as pr
    from lifecycle_events
    union all
    select replaces_candidate_id, lifecycle_event_id, 'replaced', 'retired', 'Replaced by candidate ' || candidate_id,
           occurred_at, 2 from lifecycle_events where replaces_candidate_id is not null and to_state = 'champion')
  qualify row_number() over (partition by candidate_id order by occurred_at desc, pr desc, lifecycle_event_id desc) = 1
) e using (candidate_id)"""
LC_SPEC = (
    "candidate_id model_scope_key model_config_name lifecycle_state latest_lifecycle_event_id latest_event_type "
    "latest_event_reason latest_event_at:t"
)


def current(s: Source):
    return lc.lifecycle_current(st.stage_candidates(s.rel("candidate_ledger")), s.rel("lifecycle_events"))


@query("lc3_lifecycle_current", LC_SPEC, "select * from lifecycle_now")
def lifecycle(s: Source):
    return current(s)


@query(
    "lc4_current_champions",
    LC_SPEC,
    """select * from lifecycle_now where lifecycle_state = 'champion' qualify row_number() over (
         partition by model_scope_key order by latest_event_at desc, latest_lifecycle_event_id desc) = 1""",
)
def champions_now(s: Source):
    return lc.current_champions(current(s))


@query(
    "lc5_champion_lookup",
    "model_scope_key candidate_id model_config_name lifecycle_event_id",
    """select c.model_scope_key, c.candidate_id, c.model_config_name, e.lifecycle_event_id
       from lifecycle_events e join staged_candidates c using (candidate_id)
       where e.event_type in ('promoted', 'rolled_back') and e.to_state = 'champion'
       qualify row_number() over (partition by c.model_scope_key
         order by e.occurred_at desc, e.lifecycle_event_id desc) = 1""",
)
def champion_lookup(s: Source):
    return lc.champion_events(st.stage_candidates(s.rel("candidate_ledger")), s.rel("lifecycle_events"))


BOARD_SPEC = (
    "platform config_name model_run_id model_family model_type target grain horizon:i segment_key_json primary_metric "
    "metric_policy run_at:t mae:f rmse:f r2:f wape:f mase:f rmsse:f bias:f prediction_completeness:f "
    "comparable_partition_key"
)
# the first part from the rules that build the holdout ledger out of the parts, the second from
# the predictions themselves: per origin first, then with each origin's share of the rows
MIRRORS["board_holdout"] = """
select p_type in ('PROMO', 'SMALL') as store, p_type, p_brand, if(p_type = 'ECONOMY', max(p_size), min(p_size)) as h,
       max(p_retailprice) as top, min(p_retailprice) as low, count(*)::double - 20 as bias
from part where p_type not in ('LARGE', 'MEDIUM') group by p_type, p_brand"""
MIRRORS["board_origins"] = """
select p.*, p.eligible / sum(p.eligible) over w as e, case when mase is not null then p.predicted end
         / sum(case when mase is not null then p.predicted end) over w as m, p.predicted / sum(p.predicted) over w as r
from (select backtest_run_id, region, baseline_name, forecast_origin, horizon, count(actual) as eligible,
             count(prediction) as predicted, avg(abs(actual - prediction)) as mae,
             if(horizon = 7, null, avg(abs(actual - prediction)) / 10) as mase,
             sum(abs(actual - prediction)) / nullif(sum(abs(actual)), 0) as wape,
             sqrt(avg(power(actual - prediction, 2))) / 10 as rmsse, -avg(actual - prediction) as bias,
             max(target_date) as seen from bt_pred_ledger
      group by backtest_run_id, region, baseline_name, forecast_origin, horizon) p
window w as (partition by backtest_run_id, baseline_name, horizon)"""
MIRRORS["board_rows"] = """
select if(p_type = 'ECONOMY', 'sales_n' || h || 'd_model', 'store_h' || h || '_gbt') as config_name,
       'run-' || p_brand || '-' || p_type as model_run_id, if(store, 'store_daily', lower(p_type)) as model_family,
       'gbt' as model_type, if(store, 'store-day', lower(p_type)) as grain, h::bigint as horizon,
       if(store, 'wape', 'mae') as primary_metric, 'holdout' as protocol, timestamp '2024-01-01 01:00:00' as run_at,
       top / 100 as mae, top / 50 as rmse, 0.5::double as r2, low / 30 as wape, null::double as mase, null::double as rmsse,
       bias, null::double as prediction_completeness from board_holdout
union all
select baseline_name, backtest_run_id, if(baseline_name = 'gbt_store', 'store_daily', 'baseline'),
       if(baseline_name = 'gbt_store', 'gbt', 'baseline'), 'store-day', horizon::bigint, 'wape', 'rolling_origin',
       max(seen)::timestamp, sum(mae * e), null, null, sum(wape * e), sum(mase * m), sum(rmsse * r), sum(bias * e),
       sum(predicted) / sum(eligible)
from board_origins where region <> 'ASIA' group by baseline_name, backtest_run_id, horizon
union all
select 'naive_' || region, null, 'trees', 'BOOSTED', 'region-day', 1, 'mae', 'holdout', max(date)::timestamp,
       avg(abs(p - a)), sqrt(avg(pow(p - a, 2))), 1 - sum(pow(p - a, 2)) / nullif(var_pop(a) * count(*), 0),
       sum(abs(p - a)) / sum(a), null, null, null, null
from (select region, date, sum(prediction) as p, sum(actual) as a from recent_naive group by region, date) group by region"""
MIRRORS["board"] = """
select *, sha256(concat_ws('|', target, grain, horizon, segment_key_json, metric_policy)) as comparable_partition_key
from (select *, if(grain = 'region-day', 'sql', 'jobs') as platform, 'demand_units' as target, '{}' as segment_key_json,
        format('{{"evaluation_protocol":"{}","primary_metric":"{}"}}', protocol, primary_metric) as metric_policy
      from board_rows)"""


def recent_evaluations(s: Source):
    """The naive forecast of every region, evaluated over the last week by day."""
    last = s.rel("cutoff").first()["last_date"]
    pred = s.rel("naive_day").filter(F.col("prediction").isNotNull() & (F.col("date") >= F.lit(last - dt.timedelta(days=7))))
    name = F.concat(F.lit("naive_"), "region").alias("model_name")
    days = pred.groupBy(name, "date").agg(F.sum("prediction").alias("prediction"), F.sum("actual").alias("actual"))
    wape = ml.recent_wape(days.withColumn("run_date", F.lit(last)), days)
    shown = F.max("date").cast("timestamp").alias("evaluated_at")
    seen = days.groupBy("model_name").agg(shown)
    return ml.evaluate_recent(days, last).join(wape, ["model_name", "run_date"], "left").join(seen, "model_name")


def board(s: Source):
    metrics = st.stage_backtest(s.rel("bt_metric_ledger"), s.rel("bt_run_ledger"))
    target = "demand_units"
    return lc.leaderboard(
        [
            lc.holdout_scores(s.rel("performance"), "jobs", target),
            lc.backtest_scores(metrics, "jobs"),
            lc.recent_scores(recent_evaluations(s), "sql", target, "trees", "BOOSTED", "region-day"),
        ]
    )


@query("lc6_leaderboard", BOARD_SPEC, "select * from board")
def leaderboard(s: Source):
    return board(s)


MIRRORS["champion_board"] = """
select *, row_number() over (partition by target, grain, horizon, segment_key_json, metric_policy
  order by primary_metric_value asc nulls last, platform, config_name) = 1 as is_champion
from (select *, case primary_metric when 'wape' then wape when 'mae' then mae when 'mase' then mase else rmsse end
        as primary_metric_value from board
      qualify row_number() over (partition by target, grain, horizon, segment_key_json, metric_policy, platform,
        config_name order by run_at desc, model_run_id desc) = 1)"""


@query(
    "lc7_champions",
    "platform config_name model_run_id target grain horizon:i metric_policy primary_metric_value:f is_champion:b",
    "select * from champion_board",
)
def champions(s: Source):
    return lc.champions(board(s))


@query(
    "io10_merge_rows",
    "forecast_output_id override_value:f reason_code",
    """select coalesce(b.forecast_output_id, a.forecast_output_id) as forecast_output_id,
              coalesce(b.override_value, a.override_value) as override_value,
              coalesce(b.reason_code, a.reason_code) as reason_code
       from overrides a full join (select forecast_output_id, override_value + 1 as override_value,
              cast(null as varchar) as reason_code from overrides where reason_code = 'promotion'
              union all select forecast_output_id, 0.0, 'none' from outputs where confidence_flag = 'medium') b
         on a.forecast_output_id = b.forecast_output_id""",
)
def merge_rows(s: Source):
    old = s.rel("overrides").select("forecast_output_id", "override_value", "reason_code")
    changed = old.filter("reason_code = 'promotion'").select(
        "forecast_output_id",
        (F.col("override_value") + 1).alias("override_value"),
        F.lit(None).cast("string").alias("reason_code"),
    )
    added = s.rel("outputs").filter("confidence_flag = 'medium'").select(
        "forecast_output_id", F.lit(0.0).alias("override_value"), F.lit("none").alias("reason_code")
    )
    return writers.merge_rows(old, changed.unionByName(added), "forecast_output_id")
