"""Queries over monitoring (MO), read models (RM), checks (DQ) and splits (FE15-FE20)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foresail.operators import checks as dq
from foresail.operators import demand as de
from foresail.operators import features as fe
from foresail.operators import hierarchy as hi
from foresail.operators import monitoring as mo
from foresail.operators import readmodels as rm
from foresail.operators import splits as sp
from foresail.operators import staging as st
from foresail.plans.hierarchy_queries import GROUPS, SPEC, graph, reconciled
from foresail.plans.ledger_queries import board, delivery, pbr
from foresail.plans.registry import Source, query
from foresail.plans.relations import MIRRORS, SHARED
from foresail.session import stored


def noon(s: Source, days: int = 0):
    return F.lit(dt.datetime.combine(s.train_end, dt.time(12)) + dt.timedelta(days=days))


NOON = "(select cast(train_end as timestamp) + interval 12 hour from cutoff)"


# --- monitoring -------------------------------------------------------------------
def _drift_sql(name: str, expr: str, kind: str) -> str:
    return f"""select '{name}' as metric_name, '{kind}' as metric_type, latest - 27 as recent_window_start_date,
      latest as recent_window_end_date, n1 as recent_observation_count, n0 as reference_observation_count,
      m1 as recent_mean, m0 as reference_mean, abs(m1 - m0) / nullif(sqrt((s1 * s1 + s0 * s0) / 2), 0)
        as standardized_mean_difference,
      case when n1 < 30 or n0 < 30 then 'insufficient_observations'
           when abs(m1 - m0) / nullif(sqrt((s1 * s1 + s0 * s0) / 2), 0) > 0.05 then 'drifted' else 'healthy' end as drift_status
    from (select latest, count(*) filter (d > latest - 28) as n1, avg(v) filter (d > latest - 28) as m1,
                 stddev_pop(v) filter (d > latest - 28) as s1, count(*) filter (d <= latest - 28 and d > latest - 56) as n0,
                 avg(v) filter (d <= latest - 28 and d > latest - 56) as m0,
                 stddev_pop(v) filter (d <= latest - 28 and d > latest - 56) as s0
          from (select *, max(d) over () as latest from (select date as d, {expr} as v from agg_store) where v is not null)
          group by latest)"""


@query(
    "mo1_data_drift",
    "metric_name metric_type recent_window_start_date:d recent_window_end_date:d recent_observation_count:i "
    "reference_observation_count:i recent_mean:f reference_mean:f standardized_mean_difference:f drift_status",
    " union all ".join(
        [_drift_sql("sales_store", "sales_store", "demand"), _drift_sql("products_store", "products_store", "feature")]
    ),
)
def data_drift(s: Source):
    daily = fe.daily_agg(s.fact, "store")
    wanted = [mo.DriftMetric("sales_store"), mo.DriftMetric("products_store", "feature")]
    return mo.data_drift(daily, wanted, max_smd=0.05)


@query(
    "mo2_feature_completeness",
    "feature_date:d row_count:i entity_count:i previous_entity_count:i missing_required_value_count:i "
    "completeness_ratio:f entity_coverage_ratio:f feature_completeness_status is_alerting:b",
    """select *, case when completeness_ratio < 0.99 then 'missing_required_values'
                      when entity_coverage_ratio < 0.95 then 'entity_coverage_low' else 'healthy' end
                as feature_completeness_status,
              completeness_ratio < 0.99 or entity_coverage_ratio < 0.95 as is_alerting
       from (select l.date as feature_date, l.n as row_count, l.e as entity_count, p.e as previous_entity_count,
               l.m as missing_required_value_count, (l.n * 2 - l.m) / (l.n * 2) as completeness_ratio,
               l.e / p.e as entity_coverage_ratio
             from (select date, count(*) as n, count(distinct store_nbr) as e,
                     count(*) filter (sales_store is null) + count(*) filter (products_store is null) as m,
                     row_number() over (order by date desc) as k from agg_store group by date) l
             join (select date, count(distinct store_nbr) as e, row_number() over (order by date desc) as k
                   from agg_store group by date) p on l.k = 1 and p.k = 2)""",
)
def completeness(s: Source):
    spec = mo.CompletenessSpec("store_daily", "store_nbr", ("sales_store", "products_store"))
    return mo.feature_completeness(fe.daily_agg(s.fact, "store"), spec)


@query(
    "mo3_prediction_coverage",
    "forecast_run_id forecast_contract_name expected_output_count:i predicted_output_count:i distinct_output_count:i "
    "horizon_count:i coverage_ratio:f coverage_status is_alerting:b",
    """select *, coverage_ratio < 0.98 as is_alerting,
              case when coverage_ratio < 0.98 then 'below_threshold' else 'healthy' end as coverage_status
       from (select r.forecast_run_id, r.forecast_contract_name, r.row_count as expected_output_count,
               count(o.forecast_output_id) as predicted_output_count,
               count(distinct o.forecast_output_id) as distinct_output_count, count(distinct o.horizon) as horizon_count,
               count(distinct o.forecast_output_id) / r.row_count as coverage_ratio
             from latest_run r left join outputs o using (forecast_run_id) group by 1, 2, 3)""",
)
def coverage(s: Source):
    return mo.prediction_coverage(s.rel("runs"), s.rel("outputs"))


HEALTH_SQL = """
select r.forecast_run_id, r.forecast_contract_name, r.started_at, s.n as stage_count, s.bad as unsuccessful_stage_count,
  c.bad as failed_blocking_check_count, o.n as persisted_output_count, o.mq as missing_quantile_count,
  e.n as persisted_candidate_count, e.un as unexplained_exclusion_count,
  case when r.run_status not in ('succeeded', 'draft') then 'failed' when s.bad > 0 then 'failed'
       when c.bad > 0 then 'gates_failed' when e.snap <> r.eligibility_snapshot_id then 'eligibility_snapshot_mismatch'
       when e.un > 0 then 'unexplained_exclusions'
       when r.candidate_count <> e.n or r.eligible_count <> e.el or r.excluded_count <> e.ex or r.exception_count <> e.xc
         then 'eligibility_accounting_mismatch'
       when r.row_count <> o.n then 'cardinality_mismatch' when o.mq > 0 then 'missing_quantiles' else 'healthy' end
    as health_status
from {runs} r
join (select forecast_run_id, count(*) as n, count(*) filter (stage_status <> 'completed') as bad from stage_runs group by 1) s
  using (forecast_run_id)
join (select forecast_run_id, count(*) filter (severity = 'blocking' and not passed) as bad from check_runs group by 1) c
  using (forecast_run_id)
join (select forecast_run_id, count(*) as n, count(*) filter (prediction_p10 is null) as mq from outputs group by 1) o
  using (forecast_run_id)
join (select forecast_run_id, count(*) as n, count(*) filter (is_eligible) as el, count(*) filter (not is_eligible) as ex,
        count(*) filter (has_exception) as xc, count(*) filter (not is_eligible and trim(ineligibility_reason) = '') as un,
        min(eligibility_snapshot_id) as snap from decision_ledger group by 1) e using (forecast_run_id)"""
HEALTH_SPEC = (
    "forecast_run_id forecast_contract_name stage_count:i unsuccessful_stage_count:i failed_blocking_check_count:i "
    "persisted_output_count:i missing_quantile_count:i persisted_candidate_count:i unexplained_exclusion_count:i "
    "health_status"
)


def health(s: Source, by_month: bool = False):
    runs = s.rel("runs")
    if by_month:
        # one contract per region and month, so that many runs are the latest of theirs
        month = F.date_format("forecast_origin", "yyyy-MM")
        runs = runs.withColumn("forecast_contract_name", F.concat_ws("_", "forecast_contract_name", month))
    return mo.pipeline_health(
        runs, s.rel("stage_runs"), s.rel("check_runs"), s.rel("outputs"), s.rel("decision_ledger")
    )


MIRRORS["run_by_month"] = """
select * replace (forecast_contract_name || '_' || strftime(forecast_origin, '%Y-%m') as forecast_contract_name) from runs
qualify row_number() over (partition by forecast_contract_name || '_' || strftime(forecast_origin, '%Y-%m')
  order by started_at desc, forecast_run_id desc) = 1"""
MIRRORS["health_month"] = HEALTH_SQL.format(runs="run_by_month")


@query("mo4_run_health", HEALTH_SPEC, "select * from health_month")
def run_health(s: Source):
    return health(s, by_month=True)


@query(
    "mo5_publication_freshness",
    "forecast_contract_name latest_forecast_run_id latest_published_at:t publication_count:i "
    "unconfirmed_delivery_count:i publication_age_minutes:i data_mode freshness_status is_alerting:b",
    f"""select r.forecast_contract_name, r.forecast_run_id as latest_forecast_run_id, p.at as latest_published_at,
          p.n as publication_count, p.un as unconfirmed_delivery_count, 'continuous' as data_mode,
          date_diff('second', p.at, {NOON}) // 60 as publication_age_minutes,
          case when date_diff('second', p.at, {NOON}) // 60 > 1440 then 'stale' else 'fresh' end as freshness_status,
          date_diff('second', p.at, {NOON}) // 60 > 1440 as is_alerting
        from latest_run r left join (select forecast_contract_name, max(published_at) as at,
          count(distinct publication_id) as n, count(*) filter (delivery_status not in ('delivered', 'published')) as un
          from pbr group by 1) p using (forecast_contract_name)""",
)
def freshness(s: Source):
    return mo.publication_freshness(s.rel("runs"), pbr(s), s.rel("ingestion"), noon(s, 0))


@query(
    "mo6_realized_calibration",
    "forecast_contract_name horizon:i matured_forecast_count:i realized_actual_count:i realized_actual_ratio:f "
    "interval_coverage_ratio:f median_bias:f normalized_median_bias:f mean_interval_width:f calibration_status",
    """select *, case when realized_actual_count < 30 then 'insufficient_actuals'
                      when interval_coverage_ratio < 0.8 then 'under_coverage'
                      when abs(normalized_median_bias) > 0.1 then 'material_bias' else 'healthy' end as calibration_status
       from (select o.forecast_contract_name, o.horizon, count(*) as matured_forecast_count,
               count(d.observed_sales_units) as realized_actual_count,
               count(d.observed_sales_units) / count(*) as realized_actual_ratio,
               count(*) filter (d.observed_sales_units between o.prediction_p10 and o.prediction_p90)
                 / nullif(count(d.observed_sales_units), 0) as interval_coverage_ratio,
               quantile_disc(o.prediction_p50 - d.observed_sales_units, 0.5) as median_bias,
               quantile_disc(o.prediction_p50 - d.observed_sales_units, 0.5) / nullif(avg(d.observed_sales_units), 0)
                 as normalized_median_bias,
               avg(case when d.observed_sales_units is not null then o.prediction_p90 - o.prediction_p10 end)
                 as mean_interval_width
             from outputs o left join demand_day d on d.date = o.target_date
               and '{"store_nbr":' || d.store_nbr || '}' = o.entity_key_json
             where o.target_date between (select train_end - 27 from cutoff) and (select train_end from cutoff)
             group by 1, 2)""",
)
def calibration(s: Source):
    return mo.realized_calibration(
        s.rel("outputs"), de.demand_daily(s.fact), F.lit(s.train_end), entity_key="store_nbr"
    )


AT = "timestamp '2024-01-31 00:00:00'"


@query(
    "mo7_source_health",
    "ingestion_run_id source_name status data_mode finished_at:t freshness_deadline:t health_status is_alerting:b "
    "health_reason",
    f"""select *, finished_at + interval 30 hour as freshness_deadline,
          case when status <> 'succeeded' then 'failed' when data_mode = 'static_demo' then 'healthy_static'
               when {AT} > finished_at + interval 30 hour then 'stale' else 'healthy' end as health_status,
          status <> 'succeeded' or (data_mode = 'continuous' and {AT} > finished_at + interval 30 hour) as is_alerting,
          case when status <> 'succeeded' then 'latest_ingestion_' || status
               when data_mode = 'static_demo' then 'static_dataset_freshness_not_applicable'
               when {AT} > finished_at + interval 30 hour then 'expected_ingestion_window_missed' else 'within_window' end
            as health_reason
        from ingestion qualify row_number() over (partition by source_name
          order by finished_at desc, ingestion_run_id desc) = 1""",
)
def sources(s: Source):
    return mo.source_health(s.rel("ingestion"), F.lit(dt.datetime(2024, 1, 31)))


@query(
    "mo8_ingestion_rows",
    "ingestion_run_id source_name status finished_at:t ingested_row_count:i",
    """select sha256(to_json({'finished_at': strftime(finished_at, '%Y-%m-%d'), 'source_name': source_name,
                'source_policy_hash': 'p1', 'source_watermark': strftime(finished_at, '%Y-%m-%d'),
                'started_at': strftime(finished_at, '%Y-%m-%d'), 'status': status})::varchar) as ingestion_run_id,
              source_name, status, cast(finished_at as date) as finished_at, n as ingested_row_count
       from (select source_name, status, cast(finished_at as date) as finished_at, count(*) as n from ingestion
             group by 1, 2, 3)""",
)
def ingestion_rows(s: Source):
    day = F.to_date("finished_at")
    batch = s.rel("ingestion").groupBy("source_name", "status", day.alias("finished_at")).agg(
        F.count(F.lit(1)).alias("ingested_row_count")
    )
    return mo.ingestion_row(
        batch.withColumns(
            {
                "started_at": F.col("finished_at"),
                "source_watermark": F.col("finished_at"),
                "source_policy_hash": F.lit("p1"),
                "table_count": F.lit(1),
            }
        )
    )


@query(
    "mo9_delivery_health",
    "forecast_contract_name destination publication_version:i delivery_status status_age_minutes:i "
    "delivery_health_status is_alerting:b",
    f"""select *, age as status_age_minutes,
          case when delivery_status = 'delivered' then 'healthy' when delivery_status = 'pending' and age > 120 then 'overdue'
               else delivery_status end as delivery_health_status,
          delivery_status in ('failed', 'abandoned') or (delivery_status = 'pending' and age > 120) as is_alerting
        from (select *, date_diff('second', delivery_status_at, {NOON}) // 60 as age from delivery_now
              qualify row_number() over (partition by forecast_contract_name, destination
                order by publication_version desc, published_at desc, forecast_run_id desc) = 1)""",
)
def delivery_health(s: Source):
    return mo.delivery_health(delivery(s), noon(s))


COST_SPEC = (
    "cost_scope_key forecast_run_id forecast_contract_name cost_event_count:i service_count:i total_cost_usd:f "
    "bigquery_cost_usd:f vertex_cost_usd:f missing_required_label_count:i cost_per_thousand_rows_usd:f "
    "historical_run_count:i historical_average_run_cost_usd:f cost_status is_alerting:b"
)
# from the rules that build the fixture: events of a user are its run's costs, every 97th has
# no run and stands alone, every 89th no contract, users in elevens no stage
MIRRORS["run_cost"] = """
select if(alone is null, 'run-' || u, 'unattributed:' || alone) as cost_scope_key, if(alone is null, 'run-' || u, ' ')
         as forecast_run_id, if(alone is null or labelled > 0, 'contract-' || u % 7, null) as forecast_contract_name,
       n as cost_event_count, (clicks > 0)::int + (views > 0)::int + (n > clicks + views)::int as service_count,
       total as exact, total::double as total_cost_usd, coalesce(click_usd, 0)::double as bigquery_cost_usd,
       coalesce(view_usd, 0)::double as vertex_cost_usd,
       n - labelled + if(u % 11 = 0, n, 0) + if(alone is null, 0, n) as missing_required_label_count,
       if(alone is null, began, null) as started_at, if(alone is null, total::double * 25 / seen, null) as cost_per_thousand_rows_usd
from (select user_id as u, if(event_id % 97 = 0, event_id, null) as alone, count(*) as n,
             count(*) filter (event_id % 89 <> 0) as labelled, count(*) filter (event_type = 'click') as clicks,
             count(*) filter (event_type = 'view') as views, sum(usd) as total,
             sum(usd) filter (event_type = 'click') as click_usd, sum(usd) filter (event_type = 'view') as view_usd
      from (select *, value::decimal(18, 2) as usd from events) group by 1, 2)
join (select user_id as u, min(ts) as began, count(*) as seen from events group by 1) using (u)"""
# the newest run of a contract against the mean of the rest
MIRRORS["run_cost_rest"] = """
select forecast_contract_name as c, count(*) - 1 as rest, sum(exact) as all_usd,
       max(row(started_at is not null, coalesce(started_at, timestamp '1970-01-01'), forecast_run_id, cost_scope_key)) as newest
from run_cost where forecast_contract_name is not null group by 1"""


@query(
    "mo10_run_cost",
    COST_SPEC,
    """select *, list_contains(['healthy', 'insufficient_history'], cost_status) = false as is_alerting from (
         select *, (['missing_required_labels', 'over_run_budget', 'over_unit_budget', 'cost_anomaly',
                     'insufficient_history', 'healthy'])[list_position([missing_required_label_count > 0,
                     total_cost_usd > 20000, coalesce(cost_per_thousand_rows_usd > 1500, false), historical_run_count >= 3 and
                     total_cost_usd > 1.1 * historical_average_run_cost_usd, historical_run_count < 3, true], true)] as cost_status
         from (select r.*, coalesce(rest, 0) as historical_run_count,
                      if(rest > 0, (all_usd - exact)::double / rest, null) as historical_average_run_cost_usd
               from run_cost r left join run_cost_rest h on c = forecast_contract_name
               where c is null or cost_scope_key = newest[4]))""",
)
def run_cost(s: Source):
    return mo.pipeline_cost(
        s.rel("cost_runs"), s.rel("cost_raw"), max_run=20000, max_per_thousand=1500, anomaly=1.1,
        services={"bigquery": "%bigquery%", "vertex": "%vertex%"},
    )


@query(
    "mo11_cost_events",
    "cost_event_id service_name amount_usd:f currency bytes_processed:i",
    """select sha256(to_json({'source_event_id': cost_event_id, 'source_system': 'billing'})::varchar) as cost_event_id,
              service_name, amount_usd, 'USD' as currency, bytes_processed from cost_raw""",
)
def cost_events(s: Source):
    raw = s.rel("cost_raw").withColumnRenamed("cost_event_id", "source_event_id").withColumns(
        {
            "source_system": F.lit("billing"),
            "usage_end_at": F.col("usage_start_at") + F.expr("interval 1 hour"),
            "usage_amount": F.lit(None).cast("double"),
        }
    )
    return mo.cost_events(raw)


@query(
    "mo12_fva_backtest",
    "backtest_run_id forecast_origin:d horizon:i candidate_name benchmark_name comparison_status wape_fva_points:f "
    "mae_fva:f fva_status is_ml_candidate:b",
    """select c.backtest_run_id, c.forecast_origin, c.horizon, c.baseline_name as candidate_name,
         b.baseline_name as benchmark_name, c.baseline_name = c.model_config_name as is_ml_candidate, st as comparison_status,
         case when st = 'comparable' then b.wape - c.wape end as wape_fva_points,
         case when st = 'comparable' then b.mae - c.mae end as mae_fva,
         case when st = 'comparable' then case sign(round(b.wape - c.wape, 12)) when 1 then 'value_added'
              when -1 then 'value_destroyed' else 'neutral' end end as fva_status
       from staged_metrics c left join (select * from staged_metrics where baseline_name = 'seasonal_naive_7d') b
         on b.backtest_run_id = c.backtest_run_id and b.forecast_origin = c.forecast_origin and b.horizon = c.horizon
       cross join lateral (select case when b.metric_id is null then 'missing_benchmark'
         when b.eligible_count <> c.eligible_count or b.prediction_count <> c.prediction_count then 'population_mismatch'
         when b.wape is null or c.wape is null then 'missing_metrics' else 'comparable' end as st)
       where c.baseline_name <> coalesce(b.baseline_name, '')""",
)
def fva_backtest(s: Source):
    metrics = st.stage_backtest(s.rel("bt_metric_ledger"), s.rel("bt_run_ledger"))
    return mo.fva_backtest(metrics, {"store-day": "seasonal_naive_7d"})


def fva(s: Source):
    return mo.fva_operations(
        s.rel("publications"), s.rel("outputs"), s.rel("approvals"), s.rel("overrides"), de.demand_daily(s.fact)
    )


@query(
    "mo13_fva_operations",
    "forecast_run_id publication_version:i horizon:i planner reason_code forecast_count:i actual_count:i "
    "statistical_wape:f9 planner_adjusted_wape:f9 published_wape:f9 comparison_status total_wape_fva_points:f9",
    "select * from fva_ops",
)
def fva_operations(s: Source):
    return fva(s)


MIRRORS["live_daily"] = """
select config_name, model_run_id, forecast_date, count(*) as n_predictions, avg(abs(actual - prediction)) as mae,
       sum(abs(actual - prediction)) / nullif(sum(abs(actual)), 0) as wape, avg(prediction - actual) as bias
from live_pred where actual is not null group by 1, 2, 3"""
MIRRORS["live_rolling"] = """
select d.*, avg(d.mae) over w7 as mae_7d, avg(d.wape) over w7 as wape_7d, avg(d.wape) over w28 as wape_28d,
       p.wape as train_test_wape
from live_daily d left join live_perf p using (model_run_id)
window w7 as (partition by config_name order by forecast_date rows between 6 preceding and current row),
       w28 as (partition by config_name order by forecast_date rows between 27 preceding and current row)"""


@query(
    "mo14_accuracy_daily",
    "config_name model_run_id forecast_date:d n_predictions:i mae:f wape:f9 bias:f",
    "select * from live_daily",
)
def accuracy_daily(s: Source):
    return mo.accuracy_daily(s.rel("live_pred"))


ROLLING_SPEC = "config_name forecast_date:d mae_7d:f9 wape_7d:f9 wape_28d:f9 train_test_wape:f9"


def rolling(s: Source):
    return mo.accuracy_rolling(mo.accuracy_daily(s.rel("live_pred")), s.rel("live_perf"))


@query("mo15_accuracy_rolling", ROLLING_SPEC, "select * from live_rolling")
def accuracy_rolling(s: Source):
    return rolling(s)


POLICIES = (
    mo.AlertPolicy("forecast_unhealthy", "pipeline_health", "page", "ops"),
    mo.AlertPolicy("source_unhealthy", "source_health", "ticket", "ops"),
)


@query(
    "mo16_alerts",
    "policy_name signal severity resource_key reason",
    f"""select 'forecast_unhealthy' as policy_name, 'pipeline_health' as signal, 'page' as severity,
               forecast_contract_name as resource_key, health_status as reason from health_month where health_status <> 'healthy'
        union all
        select 'source_unhealthy', 'source_health', 'ticket', source_name,
          case when status <> 'succeeded' then 'failed' else 'stale' end
        from (select * from ingestion qualify row_number() over (partition by source_name
                order by finished_at desc, ingestion_run_id desc) = 1)
        where status <> 'succeeded' or (data_mode <> 'static_demo' and {AT} > finished_at + interval 30 hour)""",
)
def alerts(s: Source):
    at = F.lit(dt.datetime(2024, 1, 31))
    marts = {"pipeline_health": health(s, True), "source_health": mo.source_health(s.rel("ingestion"), at)}
    return mo.alerts(marts, POLICIES, at)


# --- read models -------------------------------------------------------------------
@query(
    "rm1_operations_snapshot",
    "forecast_run_id origin:d status model_name output_count:i override_count:i approval_count:i publication_version:i "
    "delivery_status fva_status updated_at:t",
    """select r.forecast_run_id, r.forecast_origin as origin,
         case when r.run_status in ('draft', 'approved', 'published', 'superseded', 'failed') then r.run_status
              when r.error_message is not null then 'failed' else 'draft' end as status, o.m as model_name,
         o.n as output_count, coalesce(v.n, 0) as override_count, coalesce(a.n, 0) as approval_count,
         p.v as publication_version, coalesce(d.delivery_status, 'not_published') as delivery_status,
         coalesce(f.comparison_status, 'awaiting_actuals') as fva_status,
         coalesce(d.delivery_status_at, p.at, r.finished_at, r.started_at) as updated_at
       from runs r join (select forecast_run_id, count(*) as n, max(config_name) as m from outputs group by 1) o using (forecast_run_id)
       left join (select forecast_run_id, count(distinct override_id) as n from overrides group by 1) v using (forecast_run_id)
       left join (select forecast_run_id, count(distinct approval_id) as n from approvals group by 1) a using (forecast_run_id)
       left join (select forecast_run_id, max(publication_version) as v, max(published_at) as at from publications group by 1) p
         using (forecast_run_id)
       left join (select * from delivery_now qualify row_number() over (partition by forecast_run_id
                    order by publication_version desc, delivery_status_at desc) = 1) d
         on d.forecast_run_id = r.forecast_run_id and d.publication_version = p.v
       left join (select * from fva_ops qualify row_number() over (partition by forecast_run_id
                    order by publication_version desc, horizon desc, planner desc, reason_code desc) = 1) f
         on f.forecast_run_id = r.forecast_run_id""",
)
def snapshot(s: Source):
    return rm.operations_snapshot(
        s.rel("runs"), s.rel("outputs"), s.rel("overrides"), s.rel("approvals"), s.rel("publications"), delivery(s), fva(s)
    )


@query(
    "rm1_worst_outputs",
    "forecast_run_id forecast_output_id position:i current_value:f exception_state",
    """select *, prediction_p50 as current_value,
         case confidence_flag when 'low' then 'blocked' when 'medium' then 'watch' else 'clear' end as exception_state
       from (select *, row_number() over (partition by forecast_run_id order by
               case confidence_flag when 'low' then 1 when 'medium' then 2 else 3 end, target_date, forecast_output_id)
               as position from outputs)""",
)
def worst(s: Source):
    return rm.worst_outputs(s.rel("outputs"), s.rel("runs"))


def busiest_entity(s: Source):
    """The contract's most published entity, chosen from the data."""
    row = pbr(s).groupBy("entity_key_json").count().orderBy(F.desc("count"), "entity_key_json").first()
    return row["entity_key_json"]


MIRRORS["busiest"] = """
select entity_key_json from pbr group by 1 order by count(*) desc, entity_key_json limit 1"""


@query(
    "rm2_forecast_series",
    "publication_id target_date:d horizon:i prediction_p50:f actual:f exception_state",
    """select p.*, d.observed_sales_units as actual,
         case p.confidence_flag when 'low' then 'blocked' when 'medium' then 'watch' else 'clear' end as exception_state
       from (select * from pbr where entity_key_json = (select entity_key_json from busiest)
               and (target_date, horizon, publication_id) > (date '1996-06-30', 3, '8')
             order by target_date, horizon, publication_id limit 50) p
       left join demand_day d on d.date = p.target_date and '{"store_nbr":' || d.store_nbr || '}' = p.entity_key_json""",
)
def series(s: Source):
    return rm.forecast_series(
        pbr(s), de.demand_daily(s.fact), {"entity_key_json": busiest_entity(s)}, 50, (dt.date(1996, 6, 30), 3, "8")
    )


@query(
    "rm3_published_page",
    "publication_id entity_key_json target_date:d horizon:i published_value:f",
    """select * from pbr where (forecast_run_id, publication_version) = (select (forecast_run_id, publication_version)
         from delivery_now where delivery_status = 'delivered'
         order by published_at desc, publication_version desc, forecast_run_id desc limit 1)
         and horizon in (1, 2, 3, 4, 5) order by entity_key_json, target_date, horizon, publication_id limit 20""",
)
def page(s: Source):
    newest = [F.desc("published_at"), F.desc("publication_version"), F.desc("forecast_run_id")]
    row = rm.scope(delivery(s), destination="warehouse").orderBy(*newest).first()
    return rm.published_page(pbr(s), row and row.asDict(), {"horizon": [1, 2, 3, 4, 5]}, 20)


@query(
    "rm4_current_scope",
    "forecast_contract_name forecast_run_id publication_version:i publication_row_count:i",
    """select * from delivery_now where delivery_status = 'delivered' qualify row_number() over (
         partition by forecast_contract_name
         order by published_at desc, publication_version desc, forecast_run_id desc) = 1""",
)
def scope(s: Source):
    return rm.scope(delivery(s), destination="warehouse")


MIRRORS["delivered_rows"] = """
select p.* from pbr p join (select forecast_run_id, publication_version, destination from delivery_now
  where delivery_status = 'delivered') using (forecast_run_id, publication_version, destination)"""


@query(
    "rm5_explorer_options",
    "kind id label",
    """select distinct 'run' as kind, forecast_run_id as id, strftime(forecast_origin, '%Y-%m-%d') as label from delivered_rows
       union all select distinct 'horizon', cast(horizon as varchar), cast(horizon as varchar) from delivered_rows
       union all select distinct 'entity', entity_key_json, grain from delivered_rows
       union all select 'model', model_id, max(config_name) from delivered_rows group by model_id""",
)
def options(s: Source):
    return rm.explorer_options(pbr(s), delivery(s))


MIRRORS["experiment"] = """
select r.backtest_run_id || ':' || m.baseline_name as experiment_run_id, m.*, r.created_at as run_created_at,
  case when m.baseline_name = r.model_config_name then r.model_family else 'baseline' end as display_model_family,
  coalesce(f.h, 'contract:' || substr(r.backtest_contract_hash, 1, 12)) as feature_version,
  case when lower(r.status) in ('completed', 'succeeded', 'success') then 'completed' else 'failed' end as status
from bt_run_ledger r join bt_metric_ledger m using (backtest_run_id)
left join (select backtest_run_id, baseline_name, min(feature_availability_hash) as h from bt_pred_ledger group by 1, 2) f
  on f.backtest_run_id = r.backtest_run_id and f.baseline_name = m.baseline_name
where r.metric_policy_json is not null"""


def experiment_rows(s: Source):
    return rm.experiments(s.rel("bt_run_ledger"), s.rel("bt_metric_ledger"), s.rel("bt_pred_ledger"))


@query(
    "rm6_experiments",
    "experiment_run_id display_model_family feature_version status forecast_origin:d horizon:i wape:f9 bias:f9",
    "select * from experiment",
)
def experiments(s: Source):
    return experiment_rows(s)


def _summary_sql(kind: str, dims: str, group: str) -> str:
    return f"""select experiment_run_id, '{kind}' as breakdown, {dims},
      sum(wape * eligible_count) / sum(eligible_count) filter (wape is not null) * 100 as wape,
      sum(bias * eligible_count) filter (bias is not null) / sum(eligible_count) filter (bias is not null) as bias,
      sum(interval_coverage * eligible_count) / sum(eligible_count) as coverage
      from experiment group by experiment_run_id{group}
      having sum(bias) is not null and sum(wape) is not null"""


@query(
    "rm7_experiment_summary",
    "experiment_run_id breakdown horizon:i segment_key_json forecast_origin:d wape:f bias:f coverage:f",
    " union all ".join(
        [
            _summary_sql("overall", "null as horizon, null as segment_key_json, null as forecast_origin", ""),
            _summary_sql("horizon", "horizon, null, null", ", horizon"),
            _summary_sql("segment", "null, segment_key_json, null", ", segment_key_json"),
            _summary_sql("origin", "null, null, forecast_origin", ", forecast_origin"),
        ]
    ),
)
def summary(s: Source):
    return rm.experiment_summary(experiment_rows(s))


@query(
    "rm8_paired_bootstrap",
    "experiment_run_id reference_run_id delta_wape_pp:f ci_lower:f ci_upper:f p_value:f conclusion",
    """with w as (select experiment_run_id as run, run_created_at, forecast_origin as o,
                 sum(wape * eligible_count) / sum(eligible_count) * 100 as wape
               from experiment where status = 'completed' group by all having sum(wape) is not null),
       d as (select a.run, b.run as ref, list(a.wape - b.wape order by a.o) as d from w a join w b on a.o = b.o
             where b.run = (select arg_min(run, row(run_created_at, run)) from w) and a.run <> b.run
             group by 1, 2 having count(*) >= 2),
       m as (select run, ref, k, avg(d[1 + ('0x' || left(md5(concat_ws('|', '17', run, ref, k, i)), 8))::bigint % len(d)]) as m
             from (select *, unnest(range(1, len(d) + 1)) as i from (select *, unnest(range(1, 2001)) as k from d))
             group by run, ref, k),
       q as (select run, ref, list(m order by m, k) as s, count(*) filter (m >= 0) as up, count(*) filter (m <= 0) as down
             from m group by 1, 2)
       select d.run as experiment_run_id, d.ref as reference_run_id, round(list_avg(d), 3) as delta_wape_pp,
              round(s[50], 3) as ci_lower, round(s[1951], 3) as ci_upper,
              round(least(1.0, if(list_avg(d) < 0, up, down) / 1000), 4) as p_value,
              if(s[1951] < 0, 'meaningful', if(s[50] > 0, 'worse', 'inconclusive')) as conclusion
       from d join q using (run, ref)""",
)
def bootstrap(s: Source):
    done = experiment_rows(s).filter("status = 'completed'")
    per_origin = done.groupBy("experiment_run_id", "run_created_at", "forecast_origin").agg(
        (F.sum(F.col("wape") * F.col("eligible_count")) / F.sum("eligible_count") * 100).alias("wape")
    )
    return rm.paired_bootstrap(per_origin.filter("wape is not null"))


@query(
    "rm9_recent_runs",
    "forecast_run_id health_status n_stages:i n_checks:i first_stage last_check_passed:b",
    """select h.forecast_run_id, h.health_status, 5 as n_stages, 5 as n_checks, 'score' as first_stage,
         (select passed from check_runs c where c.forecast_run_id = h.forecast_run_id and c.check_name = 'gate_validate')
           as last_check_passed
       from health_month h""",
)
def recent_runs(s: Source):
    shown = rm.pipeline_runs(health(s, True), s.rel("stage_runs"), s.rel("check_runs"))
    return shown.select(
        "forecast_run_id",
        "health_status",
        F.size("stages").alias("n_stages"),
        F.size("checks").alias("n_checks"),
        F.element_at("stages", 1)["stage_name"].alias("first_stage"),
        F.element_at("checks", -1)["passed"].alias("last_check_passed"),
    )


# --- data quality -------------------------------------------------------------------
@query("dq1_one_champion", "target grain horizon:i champion_count:i", """
    select target, grain, horizon, count(*) as champion_count from champion_board where primary_metric_value < 5
    group by target, grain, horizon, segment_key_json, metric_policy having count(*) > 1""")
def one_champion(s: Source):
    from foresail.operators import lifecycle as lc

    # every candidate below a threshold marked as champion, so that partitions break the rule
    marked = lc.champions(board(s)).withColumn("is_champion", F.col("primary_metric_value") < 5)
    return dq.check_one_champion(marked)


@query(
    "dq2_company_sales",
    "date:d sales_company_staged:f sales_company_int:f",
    """select s.date, s.v as sales_company_staged, c.sales_company as sales_company_int
       from (select date, sum(sales) as v from stage_train where on_promotion = 0 group by 1) s
       full join (select * from agg_company where data_split_source = 'train') c on c.date = s.date
       where s.date is null or c.date is null or abs(s.v - c.sales_company) > 0.001""",
)
def company_sales(s: Source):
    # staged sums without promotions disagree on every promoted day
    company = fe.last_sum(fe.daily_agg(s.fact, "company"), [], "date", "sales_company")
    return dq.check_company_sales(s.train.filter("on_promotion = 0"), company)


@query("dq3_partition_key", "comparable_partition_key tuple_count:i", """
    select substr(comparable_partition_key, 1, 1) as comparable_partition_key,
           count(distinct (target, grain, horizon, segment_key_json, metric_policy)) as tuple_count
    from board group by 1 having count(distinct (target, grain, horizon, segment_key_json, metric_policy)) > 1""")
def partition_key(s: Source):
    # one hex digit of the key cannot tell the partitions apart
    short = F.substring("comparable_partition_key", 1, 1)
    return dq.check_partition_key(board(s).withColumn("comparable_partition_key", short))


@query("dq4_spine_gaps", "date:d", """
    select d.date from (select unnest(generate_series((select min(date) from raw_oil), (select max(date) from raw_oil),
      interval 1 day))::date as date) d where d.date not in (select date from raw_oil)""")
def spine_gaps(s: Source):
    return dq.check_spine(s.rel("raw_oil"))


@query(
    "dq5_target_date",
    "prediction_id target_date:d horizon:i",
    "select * from bt_pred_ledger where target_date <> forecast_origin + horizon",
)
def target_date(s: Source):
    return dq.check_target_date(s.rel("bt_pred_ledger").withColumn("contract_enforced", F.lit(True)))


@query(
    "dq6_registered_runs",
    "forecast_output_id forecast_run_id",
    """select * from outputs where contract_enforced
       and forecast_run_id not in (select forecast_run_id from runs where run_status <> 'failed')""",
)
def registered_runs(s: Source):
    return dq.check_registered_runs(s.rel("outputs"), s.rel("runs").filter("run_status <> 'failed'"))


@query(
    "dq7_registered_contracts",
    "forecast_run_id forecast_contract_name",
    """select * from runs r where not exists (select 1 from contracts c where
         c.forecast_contract_name = r.forecast_contract_name and c.forecast_contract_hash = r.forecast_contract_hash)""",
)
def registered_contracts(s: Source):
    return dq.check_registered_contracts(s.rel("runs"), s.rel("contracts"))


@query(
    "dq8_status_transitions",
    "status_event_id previous_status new_status",
    """select * from status_history where not (
         (previous_status is null and new_status in ('draft', 'failed'))
         or (previous_status = 'draft' and new_status in ('approved', 'superseded', 'failed'))
         or (previous_status = 'approved' and new_status in ('published', 'superseded', 'failed'))
         or (previous_status = 'published' and new_status = 'superseded'))""",
)
def transitions(s: Source):
    return dq.check_transitions(s.rel("status_history"))


@query("dq9_accuracy_drift", ROLLING_SPEC, "select * from live_rolling where wape_7d > train_test_wape * 1.25")
def accuracy_drift(s: Source):
    return dq.check_accuracy_drift(rolling(s))


@query("dq10_fact_count", "fct_count:i parts_count:i", """
    select * from (select (select count(*) from sales_fact) as fct_count,
      (select count(*) from stage_train) + (select count(*) from raw_test) as parts_count) where fct_count <> parts_count""")
def fact_count(s: Source):
    # against the undensified test rows the counts must differ
    return dq.check_fact_count(s.fact, s.train, s.rel("raw_test"))


@query("dq11_split_boundary", "max_train_date:d min_test_date:d test_day_count:i", """
    select (select max(date) from raw_train) as max_train_date, (select min(date) from raw_test) as min_test_date,
      (select count(distinct date) from raw_test) as test_day_count""")
def split_boundary(s: Source):
    # fifteen days are expected of a sixteen-day test set
    return dq.check_split_boundary(s.rel("raw_train"), s.rel("raw_test"), days=15)


@query("dq12_generic_checks", "check violations:i", """
    select 'unique' as "check", count(*) as violations from (select date, store_nbr, item_nbr from sales_raw
      group by 1, 2, 3 having count(*) > 1)
    union all select 'accepted', count(*) from raw_holidays where type not in ('Holiday', 'Event')
    union all select 'relationship', count(*) from sales_raw where store_nbr not in (select store_nbr from raw_stores where type = 'A')
    union all select 'range', count(*) from sales_raw where unit_sales < 2 or unit_sales > 45
    union all select 'not_null', count(*) from bt_pred_ledger where feature_availability_hash is null or prediction is null""")
def generic(s: Source):
    raw = s.rel("sales_raw")
    stores = s.rel("raw_stores").filter("type = 'A'")
    parts = {
        "unique": dq.check_unique(raw, ["date", "store_nbr", "item_nbr"]),
        "accepted": dq.check_accepted(s.rel("raw_holidays"), "type", ["Holiday", "Event"]),
        "relationship": dq.check_relationship(raw, "store_nbr", stores, "store_nbr"),
        "range": dq.check_range(raw, "unit_sales", 2, 45),
        "not_null": dq.check_not_null(s.rel("bt_pred_ledger"), ["feature_availability_hash", "prediction"]),
    }
    out = None
    for name, df in parts.items():
        row = dq.violated(df, name)
        out = row if out is None else out.unionByName(row)
    return out


@query("dq_unaltered_relations", "check n_checked:i violations:i", """
    select 'dq1 one champion' as "check", count(*) filter (is_champion) as n_checked, 0 as violations from champion_board
    union all select 'dq2 company sales', count(distinct date), 0 from stage_train
    union all select 'dq3 partition key', count(*), 0 from board
    union all select 'dq6 registered runs', count(*), count(*) filter (contract_enforced and forecast_run_id not in
      (select forecast_run_id from runs)) from outputs
    union all select 'dq10 fact count', count(*), 0 from sales_fact
    union all select 'dq11 split boundary', count(distinct date), (count(distinct date) <> 16 or min(date) <>
      (select max(date) + 1 from raw_train))::int from raw_test
    union all select 'dq12 relationship', count(*), 0 from sales_raw
    union all select 'dq12 accepted', count(*), count(*) filter (confidence_flag not in ('low', 'medium', 'high')) from outputs
    union all select 'dq12 unique', count(*), count(*) - count(distinct forecast_output_id) from outputs
    union all select 'dq12 not_null', count(*), count(*) filter (forecast_run_id is null) from outputs""")
def unaltered(s: Source):
    """The rules of the checks above on the relations as they are, whole. Those that several
    rules read, or a rule and its count, are made once."""
    from foresail.operators import lifecycle as lc

    scores, raw = stored(board(s)), s.rel("sales_raw")
    best = stored(lc.champions(scores))
    outputs = stored(s.rel("outputs").select("forecast_output_id", "forecast_run_id", "contract_enforced", "confidence_flag"))
    fact = stored(s.fact.select("date", "data_split_source", "sales"))
    company = fe.last_sum(fe.daily_agg(fact, "company"), [], "date", "sales_company")
    checks = {
        "dq1 one champion": (best.filter("is_champion"), dq.check_one_champion(best)),
        "dq2 company sales": (s.train.select("date").distinct(), dq.check_company_sales(s.train, company)),
        "dq3 partition key": (scores, dq.check_partition_key(scores)),
        "dq6 registered runs": (outputs, dq.check_registered_runs(outputs, s.rel("runs"))),
        "dq10 fact count": (fact, dq.check_fact_count(fact, s.train, s.test)),
        "dq11 split boundary": (
            s.rel("raw_test").select("date").distinct(), dq.check_split_boundary(s.rel("raw_train"), s.rel("raw_test"))
        ),
        "dq12 relationship": (raw, dq.check_relationship(raw, "store_nbr", s.rel("raw_stores"), "store_nbr")),
        "dq12 accepted": (outputs, dq.check_accepted(outputs, "confidence_flag", ["low", "medium", "high"])),
        "dq12 unique": (outputs, dq.check_unique(outputs, ["forecast_output_id"])),
        "dq12 not_null": (outputs, dq.check_not_null(outputs, ["forecast_run_id"])),
    }
    out = None
    for name, (checked, found) in checks.items():
        each = [df.select(F.lit(c).alias("kind")) for df, c in ((checked, "n"), (found, "v"))]
        row = each[0].unionByName(each[1]).agg(
            F.lit(name).alias("check"), F.count_if(F.col("kind") == "n").alias("n_checked"),
            F.count_if(F.col("kind") == "v").alias("violations"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "dq13_publication_report",
    "forecast_run_id output_count:i entity_count:i invalid_horizon_count:i missing_lineage_count:i "
    "invalid_quantile_count:i approval_count:i publication_count:i missing_delivery_status_count:i",
    """select o.*, coalesce(p.a, 0) as approval_count, coalesce(p.n, 0) as publication_count,
              0 as missing_delivery_status_count
       from (select forecast_run_id, count(*) as output_count, count(distinct entity_key_json) as entity_count,
               count(*) filter (horizon <> 7 or target_date - cast(forecast_origin as date) <> 7) as invalid_horizon_count,
               count(*) filter (contract_enforced is null) as missing_lineage_count,
               count(*) filter (prediction_p10 > prediction_p50 or prediction_p50 > prediction_p90) as invalid_quantile_count
             from outputs group by 1) o
       left join (select forecast_run_id, count(distinct approval_id) as a, count(distinct publication_id) as n
                  from publications group by 1) p using (forecast_run_id)""",
)
def publication_report(s: Source):
    return dq.publication_report(s.rel("outputs"), s.rel("publications"), s.rel("approvals"))


@query(
    "dq14_hierarchy_acceptance",
    "output_row_count:i node_count:i edge_count:i root_count:i leaf_count:i children_with_exactly_one_parent:i "
    "orphan_forecast_node_count:i missing_eligible_leaf_count:i missing_quantile_row_count:i "
    "reconciliation_output_record_count:i distinct_reconciliation_output_id_count:i linked_forecast_output_id_count:i "
    "prediction_p50_coherence_violations:i",
    """select count(*) as output_row_count, (select count(*) from h_nodes) as node_count,
         (select count(*) from h_edges) as edge_count, 1 as root_count, (select count(*) from entities) as leaf_count,
         (select count(*) from h_edges) as children_with_exactly_one_parent, 0 as orphan_forecast_node_count,
         0 as missing_eligible_leaf_count, 0 as missing_quantile_row_count, count(*) as reconciliation_output_record_count,
         count(*) as distinct_reconciliation_output_id_count, count(*) as linked_forecast_output_id_count,
         0 as prediction_p50_coherence_violations from node_fc""",
)
def acceptance(s: Source):
    at = F.lit(s.train_end).cast("timestamp")
    _, records = hi.reconciliation_records(reconciled(s, "bottom_up"), SPEC, "run", at)
    # an accepted run is read from its ledger, which the stored relation stands for
    records = stored(records.withColumn("forecast_output_id", F.md5(F.concat_ws("|", "node_id", *GROUPS))))
    return dq.hierarchy_acceptance(records, *graph(s), records, SPEC)


# --- matrices, splits, point in time ---------------------------------------------------------
SHARED["feature_rows"] = """
select date, store_nbr, region, sales, promoted,
       lag(sales) over (partition by store_nbr order by date) as sales_store_l1d,
       avg(sales) over (partition by store_nbr order by date rows between 7 preceding and 1 preceding) as avg_sales_store_l7d,
       cast(null as double) as empty_feature
from store_day"""


@query(
    "fe15_feature_matrix",
    "date:d sales_store_l1d:f avg_sales_store_l7d:f region_ASIA:i region_MIDDLE_EAST:i sales:f",
    """select date, sales_store_l1d, avg_sales_store_l7d, (region = 'ASIA')::int as "region_ASIA",
              (region = 'MIDDLE EAST')::int as "region_MIDDLE_EAST", sales
       from feature_rows where sales_store_l1d is not null and avg_sales_store_l7d is not null""",
)
def matrix(s: Source):
    return sp.feature_matrix(
        s.rel("feature_rows"), "sales", excluded=["store_nbr", "promoted"], categorical=["region"], date="date"
    )[0]


@query(
    "fe16_align_features",
    "date:d store_nbr:i sales_store_l1d:f unseen_feature:f",
    """select date, store_nbr, coalesce(sales_store_l1d, 0) as sales_store_l1d, 0.0 as unseen_feature from feature_rows""",
)
def aligned(s: Source):
    return sp.align_features(s.rel("feature_rows"), ["sales_store_l1d", "unseen_feature"], ["date", "store_nbr"])


PARTS_SPEC = "part n_rows:i first_date:d last_date:d units:f"


def parts(train, held):
    both = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum("sales").alias("units"),
    )


def _parts_sql(source: str) -> str:
    return f"""select part, count(*) as n_rows, min(date) as first_date, max(date) as last_date, sum(sales) as units
               from ({source}) group by part"""


TIE = "cast(cast('0x' || substr(md5(cast(store_nbr as varchar)), 1, 15) as bigint) as double)"


@query(
    "fe17_chrono_split",
    PARTS_SPEC,
    _parts_sql(
        f"""select *, case when k <= cast(floor(n * 0.8) as bigint) then 'train' else 'test' end as part
            from (select *, row_number() over (order by date, {TIE}) as k, count(*) over () as n from store_day)"""
    ),
)
def chrono(s: Source):
    return parts(*sp.chrono_split(s.rel("store_day"), 0.2, "date", ["store_nbr"]))


@query(
    "fe17_chrono_split_purged",
    PARTS_SPEC,
    _parts_sql(
        """select s.*, case when s.date < b - 7 then 'train' when s.date >= b then 'test' end as part
           from store_day s cross join (select date as b from store_day order by date
             offset (select cast(floor(count(*) * 0.8) as bigint) from store_day) limit 1)
           where s.date < b - 7 or s.date >= b"""
    ),
)
def chrono_purged(s: Source):
    return parts(*sp.chrono_split(s.rel("store_day"), 0.2, "date", purge_days=7))


@query(
    "fe18_date_split",
    PARTS_SPEC,
    _parts_sql(
        """select s.*, case when date < c then 'train' else 'test' end as part from store_day s
           cross join (select distinct date as c from store_day order by 1
             offset (select cast(floor(count(distinct date) * 0.8) as bigint) from store_day) limit 1)"""
    ),
)
def by_date(s: Source):
    return parts(*sp.date_split(s.rel("store_day"), "date", 0.2))


@query(
    "fe19_entity_split",
    PARTS_SPEC,
    _parts_sql(
        """select *, case when k <= floor(n * 0.8) then 'train' else 'test' end as part
           from (select *, row_number() over (partition by store_nbr order by date) as k,
                   count(*) over (partition by store_nbr) as n from store_day)"""
    ),
)
def by_entity(s: Source):
    return parts(*sp.entity_split(s.rel("store_day"), ["store_nbr"], "date", 0.2))


@query(
    "fe20_cutoff_report",
    "source source_cutoff:t null_count:i late_count:i",
    """select 'promotion_plan_updated_at' as source, max(t) as source_cutoff, count(*) filter (t is null) as null_count,
              count(*) filter (t > cast(date as timestamp)) as late_count
       from (select date, case when promoted = 0 then cast(date - 1 as timestamp)
                               when sales > 40 then cast(date + 2 as timestamp) end as t from store_day)
       union all select 'date', cast(max(date) as timestamp), 0, 0 from store_day""",
)
def cutoffs(s: Source):
    plan = F.when(F.col("promoted") == 0, F.date_sub("date", 1)).when(F.col("sales") > 40, F.date_add("date", 2))
    rows = s.rel("store_day").withColumn("promotion_plan_updated_at", plan.cast("timestamp"))
    return sp.cutoff_report(rows, ["promotion_plan_updated_at"], F.col("date"), "date")


