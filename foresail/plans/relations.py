"""Relations derived from the given tables.

``SHARED`` texts are plain SQL that Spark and the checking engine both run: they
shape the given tables into the retail and ledger schemas the operators expect,
so every registered query grows with those tables. ``MIRRORS`` restate operator
results in the checking engine's SQL, for oracles that build on them.
"""

from __future__ import annotations

SHARED: dict[str, str] = {}
MIRRORS: dict[str, str] = {}

# --- raw retail tables -------------------------------------------------------
SHARED["sales_raw"] = """
select cast(l_shipdate as date) as date, l_suppkey as store_nbr, l_partkey as item_nbr,
       l_quantity as unit_sales, l_orderkey as order_key,
       case when l_discount >= 0.09 then 'True' else 'False' end as onpromotion
from lineitem"""
SHARED["cutoff"] = "select max(date) - 16 as train_end, max(date) as last_date from sales_raw"
SHARED["raw_train"] = """
select date, store_nbr, item_nbr, unit_sales, onpromotion from sales_raw
where date <= (select train_end from cutoff)"""
SHARED["raw_test"] = """
select date, store_nbr, item_nbr, onpromotion from sales_raw
where date > (select train_end from cutoff)"""
SHARED["raw_items"] = "select p_partkey as item_nbr, p_type as family, p_size as class from part"
SHARED["raw_stores"] = """
select s_suppkey as store_nbr, n_name as city, r_name as state,
       case when s_acctbal >= 0 then 'A' else 'B' end as type, n_nationkey as cluster
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
SHARED["raw_transactions"] = """
select date, store_nbr, count(distinct order_key) as transactions
from sales_raw group by date, store_nbr"""
SHARED["raw_oil"] = """
select cast(o_orderdate as date) as date, max(o_totalprice) as dcoilwtico
from orders group by cast(o_orderdate as date)"""
SHARED["raw_holidays"] = """
select cast(o_orderdate as date) as date,
       case o_orderstatus when 'O' then 'National' when 'F' then 'Regional' else 'Local' end as locale,
       case substr(o_orderpriority, 1, 1) when '1' then 'Holiday' when '2' then 'Event'
            when '3' then 'Additional' when '4' then 'Bridge' else 'Transfer' end as type,
       case o_orderstatus when 'F' then r_name else n_name end as locale_name,
       o_orderpriority as description, o_orderstatus = 'P' as transferred
from orders join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

# --- panel -------------------------------------------------------------------
SHARED["store_day"] = """
select s.date, s.store_nbr, max(st.state) as region, max(st.city) as city,
       sum(s.unit_sales) as sales,
       max(case when s.onpromotion = 'True' then 1 else 0 end) as promoted
from sales_raw s join raw_stores st on s.store_nbr = st.store_nbr
group by s.date, s.store_nbr"""

MIRRORS["stage_train"] = """
select md5(cast(t.date as varchar) || '-' || t.store_nbr || '-' || t.item_nbr) as id, t.date, t.store_nbr,
       t.item_nbr as product_id, i.family as product_family, t.unit_sales as sales,
       case lower(t.onpromotion) when 'true' then 1 else 0 end as on_promotion
from raw_train t join raw_items i on t.item_nbr = i.item_nbr"""
MIRRORS["spine"] = """
select cast(d as date) as date from (select unnest(generate_series(
  (select min(date) from raw_train), (select max(date) from raw_test), interval 1 day)) as d)"""
MIRRORS["stage_test"] = """
select md5(cast(d.date as varchar) || '-' || p.store_nbr || '-' || p.item_nbr) as id, d.date, p.store_nbr,
       p.item_nbr as product_id, i.family as product_family,
       case lower(t.onpromotion) when 'true' then 1 else 0 end as on_promotion
from (select date from spine where date between (select min(date) from raw_test)
      and (select max(date) from raw_test)) d
cross join (select distinct store_nbr, item_nbr from raw_test) p
left join raw_test t on d.date = t.date and p.store_nbr = t.store_nbr and p.item_nbr = t.item_nbr
left join raw_items i on p.item_nbr = i.item_nbr"""
MIRRORS["sales_fact"] = """
select id, date, store_nbr, product_id, product_family, sales, on_promotion, 'train' as data_split_source
from stage_train union all
select id, date, store_nbr, product_id, product_family, cast(null as double), on_promotion, 'test'
from stage_test"""
MIRRORS["agg_company"] = """
select date, max(data_split_source) as data_split_source, sum(sales) as sales_company
from sales_fact group by date"""
MIRRORS["agg_store"] = """
select date, store_nbr, max(data_split_source) as data_split_source, sum(sales) as sales_store,
       count(distinct product_id) as products_store, count(distinct product_family) as product_families_store,
       sum(case when on_promotion = 1 then sales else 0 end) as sales_store_on_promotion,
       count(distinct case when on_promotion = 1 then product_id end) as products_store_on_promotion,
       count(distinct case when on_promotion = 1 then product_family end) as product_families_store_on_promotion
from sales_fact group by date, store_nbr"""
MIRRORS["agg_store_product"] = """
select date, store_nbr, product_id, max(data_split_source) as data_split_source,
       sum(sales) as sales_store_product,
       sum(case when on_promotion = 1 then sales else 0 end) as sales_store_product_on_promotion
from sales_fact group by date, store_nbr, product_id"""
MIRRORS["agg_store_family"] = """
select date, store_nbr, product_family, max(data_split_source) as data_split_source,
       sum(sales) as sales_store_family, count(distinct product_id) as products_store_family,
       sum(case when on_promotion = 1 then sales else 0 end) as sales_store_family_on_promotion,
       count(distinct case when on_promotion = 1 then product_id end) as products_store_family_on_promotion
from sales_fact group by date, store_nbr, product_family"""


def calendar_sql(date: str = "date") -> str:
    return f"""extract(day from {date}) as day_of_month, extract(dow from {date}) + 1 as day_of_week,
  cast(strftime({date}, '%U') as integer) as iso_week_of_year, extract(month from {date}) as month,
  extract(quarter from {date}) as quarter, extract(year from {date}) as year,
  cast(ceil(extract(day from {date}) / 7.0) as integer) as week_of_month,
  extract(isoyear from {date}) as iso_year, extract(week from {date}) as iso_week,
  strftime({date}, '%A') as day_name, strftime({date}, '%B') as month_name"""


CALENDAR_SPEC = (
    "day_of_month:i day_of_week:i iso_week_of_year:i month:i quarter:i year:i week_of_month:i "
    "iso_year:i iso_week:i day_name month_name"
)

# --- forecast ledgers ------------------------------------------------------------
# One contract per region; a run per contract and origin; an output per store and
# target day, whose median is the store's previous sales.
SHARED["outputs_raw"] = """
select region, city, store_nbr, date as target_date, sales as actual,
       cast(extract(day from date) % 7 + 1 as int) as horizon,
       date - cast(extract(day from date) % 7 + 1 as int) as origin,
       coalesce(lag(sales) over (partition by store_nbr order by date), 10.0) as p50
from store_day"""
SHARED["outputs"] = """
select md5(region || '|' || cast(origin as string) || '|' || cast(store_nbr as string) || '|' || cast(target_date as string)) as forecast_output_id,
       md5(region || '|' || cast(origin as string)) as forecast_run_id,
       'demand_' || lower(region) as forecast_contract_name,
       md5('contract-' || region) as forecast_contract_hash,
       case when store_nbr % 10 = 9 then null else true end as contract_enforced,
       cast(origin as timestamp) as forecast_origin, target_date, horizon, 'store-day' as grain,
       '{"store_nbr":' || cast(store_nbr as string) || '}' as entity_key_json,
       case when p50 = 13 then null else p50 * 0.5 end as prediction_p10, p50 as prediction_p50,
       p50 * 1.5 as prediction_p90,
       case store_nbr % 5 when 0 then 'low' when 1 then 'medium' else 'high' end as confidence_flag,
       'global_model' as forecast_strategy, p50 as statistical_forecast,
       cast(null as double) as planner_override, cast(null as double) as published_forecast,
       case extract(day from origin) % 6 when 0 then 'failed' when 1 then 'approved' when 2 then 'published'
            else 'draft' end as forecast_status,
       'model-' || region as model_run_id, 'gbt-' || region as model_id,
       'store_h' || cast(horizon as string) || '_gbt' as config_name, 'gbt' as model_family,
       'v1' as feature_version, 'code-' || cast(extract(year from origin) as string) as code_sha,
       cast(origin as timestamp) as data_cutoff, 'split_conformal' as calibration_method,
       md5('cal' || region) as calibration_run_id, 'none' as reconciliation_method
from outputs_raw"""
SHARED["runs"] = """
select forecast_run_id, forecast_contract_name,
       case when extract(year from max(forecast_origin)) = 2001 then md5('retired' || forecast_contract_name)
            else max(forecast_contract_hash) end as forecast_contract_hash,
       max(forecast_origin) as forecast_origin,
       case extract(doy from max(forecast_origin)) % 8 when 0 then 'failed' when 1 then 'approved'
            when 2 then 'published' when 3 then 'succeeded' else 'draft' end as run_status,
       case when extract(doy from max(forecast_origin)) % 8 = 0 then 'boom' end as error_message,
       max(forecast_origin) + interval 6 hours as started_at,
       max(forecast_origin) + interval 7 hours as finished_at,
       count(*) + (case when extract(day from max(forecast_origin)) % 10 = 0 then 1 else 0 end) as row_count,
       case when extract(doy from max(forecast_origin)) % 9 = 0 then null
            else md5('snap' || forecast_run_id) end as eligibility_snapshot_id,
       count(*) + 1 as candidate_count, count(*) as eligible_count, 1 as excluded_count,
       case when extract(day from max(forecast_origin)) % 3 = 0 then null else 1 end as exception_count,
       'feat-' || max(model_run_id) as feature_availability_hash,
       max(config_name) as config_name, max(model_id) as model_id
from outputs group by forecast_run_id, forecast_contract_name"""
SHARED["contracts"] = """
select distinct forecast_contract_name, forecast_contract_hash from outputs"""
SHARED["decision_ledger"] = """
select forecast_run_id, md5('snap' || forecast_run_id) as eligibility_snapshot_id, true as is_eligible,
       cast(null as string) as ineligibility_reason, false as has_exception from outputs
union all
select forecast_run_id, md5('snap' || forecast_run_id), false,
       case when row_count % 2 = 0 then ' ' else 'insufficient_history' end, true from runs"""
SHARED["stage_names"] = """
select 1 as stage_position, 'score' as stage_name union all select 2, 'route' union all select 3, 'calibrate'
union all select 4, 'reconcile' union all select 5, 'validate'"""
SHARED["stage_runs"] = """
select forecast_run_id, stage_name, stage_position,
       case when run_status = 'succeeded' and stage_position = 4 then 'failed' else 'completed' end as stage_status
from runs cross join stage_names"""
SHARED["check_runs"] = """
select forecast_run_id, 'gate_' || stage_name as check_name,
       case when stage_position = 5 then 'warning' else 'blocking' end as severity,
       not (run_status = 'draft' and extract(day from forecast_origin) % 7 = 0 and stage_position = 2) as passed,
       started_at as checked_at
from runs cross join stage_names"""
SHARED["overrides"] = """
select md5('ov' || forecast_output_id) as override_id, 'key-' || forecast_run_id as idempotency_key,
       forecast_output_id, forecast_run_id, prediction_p50 * 1.1 as override_value,
       case when horizon > 3 then 'promotion' else 'local_event' end as reason_code, 'seen' as comment,
       forecast_origin + interval 8 hours as overridden_at, 'planner_' || confidence_flag as overridden_by
from outputs where confidence_flag = 'low'"""
SHARED["approvals"] = """
select md5('ap' || o.forecast_output_id) as approval_id, 'key-' || o.forecast_run_id as idempotency_key,
       o.forecast_output_id, o.forecast_run_id, v.override_id, 'approved' as decision,
       coalesce(v.override_value, o.prediction_p50) as approved_value, 'weekly' as reason_code, 'ok' as comment,
       o.forecast_origin + interval 9 hours as decided_at, 'planner_' || cast(o.horizon as string) as decided_by
from outputs o left join overrides v on o.forecast_output_id = v.forecast_output_id
where o.forecast_status in ('approved', 'published')"""
SHARED["publications"] = """
select md5('pub1' || a.approval_id) as publication_id, a.idempotency_key, a.forecast_output_id, a.forecast_run_id,
       a.approval_id, 1 as publication_version, a.approved_value as published_value, 'warehouse' as destination,
       case when o.horizon = 3 then 'pending' else 'delivered' end as delivery_status,
       cast(null as string) as delivery_reference, o.forecast_origin + interval 10 hours as published_at,
       a.decided_by as published_by
from approvals a join outputs o on a.forecast_output_id = o.forecast_output_id
where o.forecast_status = 'published'
union all
select md5('pub2' || a.approval_id), a.idempotency_key || '-2', a.forecast_output_id, a.forecast_run_id, a.approval_id,
       2, a.approved_value + 1, 'warehouse', 'delivered', cast(null as string),
       o.forecast_origin + interval 12 hours, a.decided_by
from approvals a join outputs o on a.forecast_output_id = o.forecast_output_id
where o.forecast_status = 'published' and extract(month from o.forecast_origin) % 2 = 0"""
SHARED["revisions"] = """
select md5('rev' || approval_id) as revision_id, md5('pub1' || approval_id) as prior_publication_id,
       publication_id as replacement_publication_id, 'supersede' as revision_type, 'correction' as reason_code,
       published_at as revised_at, published_by as revised_by
from publications where publication_version = 2"""
SHARED["delivery_events"] = """
select md5('de1' || forecast_run_id || cast(publication_version as string)) as delivery_event_id, forecast_run_id,
       publication_version, destination, 'pending' as delivery_status, 1 as delivery_attempt,
       cast(null as string) as delivery_reference, cast(null as string) as error_code,
       cast(null as string) as error_message, max(published_at) + interval 1 hours as occurred_at,
       'job' as occurred_by
from publications group by forecast_run_id, publication_version, destination having max(published_value) > 20
union all
select md5('de2' || forecast_run_id || cast(publication_version as string)), forecast_run_id, publication_version,
       destination, case when min(published_value) < 5 then 'failed' else 'delivered' end, 1,
       'ref-' || forecast_run_id, case when min(published_value) < 5 then 'timeout' end,
       case when min(published_value) < 5 then 'no answer' end, max(published_at) + interval 2 hours, 'job'
from publications group by forecast_run_id, publication_version, destination having max(published_value) > 30"""
SHARED["status_history"] = """
select md5('s0' || forecast_output_id) as status_event_id, forecast_output_id, cast(null as string) as previous_status,
       'draft' as new_status from outputs
union all
select md5('s1' || forecast_output_id), forecast_output_id, 'draft',
       case when forecast_status = 'draft' then 'published' else forecast_status end from outputs"""

# --- models, costs and ingestion ---------------------------------------------------
SHARED["bt_long"] = """
select region, store_nbr, date, sales as actual, 'seasonal_naive_7d' as baseline_name,
       lag(sales, 2) over (partition by store_nbr order by date) as prediction from store_day
union all
select region, store_nbr, date, sales, 'last_observation',
       lag(sales) over (partition by store_nbr order by date) from store_day
union all
select region, store_nbr, date, sales, 'gbt_store',
       avg(sales) over (partition by store_nbr order by date rows between 3 preceding and 1 preceding) from store_day"""
SHARED["bt_pred_ledger"] = """
select md5(region || baseline_name || cast(store_nbr as string) || cast(date as string)) as prediction_id,
       md5('bt' || region) as backtest_run_id, 'backtest_' || lower(region) as backtest_contract_name,
       md5('btc' || region) as backtest_contract_hash,
       date - cast(extract(day from date) as int) as forecast_origin, date as target_date,
       cast(extract(day from date) % 3 * 7 + 7 as int) as horizon, store_nbr, region, baseline_name, actual, prediction,
       prediction * 0.6 as prediction_p10, prediction as prediction_p50, prediction * 1.5 as prediction_p90,
       case when baseline_name = 'gbt_store' then 'feat-' || region end as feature_availability_hash
from bt_long"""
SHARED["bt_metric_ledger"] = """
select md5(backtest_run_id || baseline_name || cast(forecast_origin as string) || cast(horizon as string)) as metric_id,
       backtest_run_id, backtest_contract_name, backtest_contract_hash, forecast_origin, horizon, baseline_name,
       '{}' as segment_key_json, count(actual) as eligible_count, count(prediction) as prediction_count,
       cast(sum(cast(abs(prediction - actual) as decimal(30,9))) as double) / nullif(cast(sum(cast(abs(actual) as decimal(30,9))) as double), 0) as wape,
       cast(sum(cast(abs(prediction - actual) as decimal(30,9))) as double) / count(prediction - actual) as mae,
       case when horizon = 7 then null
            else cast(sum(cast(abs(prediction - actual) as decimal(30,9))) as double) / count(prediction - actual) / 10.0 end as mase,
       sqrt(avg((prediction - actual) * (prediction - actual))) / 10.0 as rmsse,
       avg(prediction - actual) as bias, cast(count(prediction) as double) / count(actual) as prediction_completeness,
       avg(cast(case when actual between prediction_p10 and prediction_p90 then 1 else 0 end as double)) as interval_coverage,
       cast(max(target_date) as timestamp) as created_at
from bt_pred_ledger
group by backtest_run_id, backtest_contract_name, backtest_contract_hash, forecast_origin, horizon, baseline_name"""
SHARED["bt_run_ledger"] = """
select backtest_run_id, backtest_contract_name, backtest_contract_hash, 'gbt_store' as model_config_name,
       'store_daily' as model_family, 'gbt' as model_type, 'demand_units' as target, 'store-day' as grain,
       case when max(region) = 'ASIA' then cast(null as string)
            else '{"evaluation_protocol":"rolling_origin","primary_metric":"wape"}' end as metric_policy_json,
       min(forecast_origin) as origin_start, max(forecast_origin) as origin_end, count(*) as prediction_count,
       case when max(region) = 'EUROPE' then 'failed' else 'completed' end as status,
       cast(min(target_date) as timestamp) as created_at
from bt_pred_ledger group by backtest_run_id, backtest_contract_name, backtest_contract_hash"""
SHARED["performance"] = """
select 'run-' || p_brand || '-' || p_type as model_run_id,
       case when p_type = 'ECONOMY' then 'sales_n' || cast(max(p_size) as string) || 'd_model'
            when p_type = 'LARGE' then 'plain_model' else 'store_h' || cast(min(p_size) as string) || '_gbt' end as config_name,
       case when p_type in ('PROMO', 'SMALL') then 'store_daily' else lower(p_type) end as model_family, 'gbt' as model_type,
       case when p_type = 'MEDIUM' then 'train' else 'test' end as metric_set,
       timestamp '2024-01-01 00:00:00' + interval 1 hours as run_at,
       max(p_retailprice) / 100.0 as mae, max(p_retailprice) / 50.0 as rmse, 0.5 as r2,
       min(p_retailprice) / 30.0 as wape, cast(count(*) as double) - 20.0 as bias
from part group by p_brand, p_type"""
SHARED["live_pred"] = """
select 'store_h' || cast(horizon as string) || '_' || region as config_name, 'store_daily' as model_family,
       'gbt' as model_type, 'model-' || region as model_run_id, target_date as forecast_date, store_nbr,
       case when actual = 7 then null else actual end as actual, p50 as prediction
from outputs_raw"""
SHARED["live_perf"] = """
select 'model-' || region as model_run_id, 'test' as metric_set, avg(sales) as mae, 0.2 + 0.1 * count(distinct city) as wape
from store_day group by region"""
SHARED["candidate_ledger"] = """
select distinct 'cand-' || cast(user_id as string) as candidate_id,
       '{"target":"demand","grain":"g' || cast(user_id % 10 as string) || '"}' as model_scope_json,
       'cfg-' || cast(user_id as string) as model_config_name, 'candidate' as initial_state
from events"""
SHARED["lifecycle_events"] = """
select 'ev-' || cast(event_id as string) as lifecycle_event_id, 'cand-' || cast(user_id as string) as candidate_id,
       case event_type when 'purchase' then 'promoted' when 'signup' then 'rolled_back' else 'evaluated' end as event_type,
       case when event_type in ('purchase', 'signup') then 'champion' when event_type = 'error' then 'rejected'
            else 'candidate' end as to_state,
       case when event_type = 'purchase' and value > 50 then 'cand-' || cast(cast(floor(value) as bigint) % 40 as string) end
         as replaces_candidate_id,
       'r-' || event_type as reason, 'actor' as actor, ts as occurred_at
from events"""
SHARED["cost_runs"] = """
select 'run-' || cast(user_id as string) as forecast_run_id, 'contract-' || cast(user_id % 7 as string) as forecast_contract_name,
       min(ts) as started_at, count(*) * 40 as row_count
from events group by user_id"""
SHARED["cost_raw"] = """
select cast(event_id as string) as cost_event_id,
       case when event_id % 97 = 0 then ' ' else 'run-' || cast(user_id as string) end as forecast_run_id,
       case when event_id % 89 = 0 then null else 'contract-' || cast(user_id % 7 as string) end as forecast_contract_name,
       'model-' || cast(user_id as string) as model_run_id, case when user_id % 11 = 0 then null else event_type end as stage_name,
       'prod' as environment, case event_type when 'click' then 'BigQuery' when 'view' then 'Vertex AI' else 'Storage' end
         as service_name, 'usage' as cost_type, cast(value as decimal(18, 2)) as amount_usd,
       cast(floor(value * 100) as bigint) as bytes_processed, cast(case when event_type = 'view' then 5 end as bigint) as slot_ms,
       ts as usage_start_at
from events"""
SHARED["ingestion"] = """
select 'ing-' || cast(event_id as string) as ingestion_run_id, 'source-' || cast(user_id as string) as source_name,
       case event_type when 'error' then 'failed' when 'click' then 'partial' else 'succeeded' end as status,
       case when user_id % 3 = 0 then 'static_demo' else 'continuous' end as data_mode, ts as finished_at,
       24 as expected_interval_hours, 6 as allowed_lateness_hours
from events"""

MIRRORS["pbr"] = """
select p.publication_id, p.publication_version, p.destination, p.delivery_status, p.published_value, p.published_at,
       p.published_by, r.feature_availability_hash, o.* exclude (published_forecast)
from publications p join outputs o using (forecast_output_id, forecast_run_id) join runs r using (forecast_run_id)"""
MIRRORS["delivery_now"] = """
select p.*, e.delivery_event_id, coalesce(e.delivery_status, 'pending') as delivery_status,
       coalesce(e.delivery_attempt, 1) as delivery_attempt, e.error_code,
       coalesce(e.occurred_at, p.published_at) as delivery_status_at,
       case when e.delivery_event_id is null then 'publication_default' else 'delivery_event' end as status_source
from (select forecast_run_id, forecast_contract_name, forecast_contract_hash, publication_version, destination,
             count(*) as publication_row_count, min(published_at) as published_at from pbr group by 1, 2, 3, 4, 5) p
left join (select * from delivery_events qualify row_number() over (
             partition by forecast_run_id, publication_version, destination
             order by occurred_at desc, delivery_event_id desc) = 1) e
  using (forecast_run_id, publication_version, destination)"""
MIRRORS["staged_metrics"] = """
select m.*, r.model_config_name, r.model_family, r.model_type, r.target, r.grain, r.metric_policy_json,
       json_extract_string(r.metric_policy_json, '$.primary_metric') as primary_metric
from bt_metric_ledger m join (select * from bt_run_ledger where metric_policy_json is not null) r
  using (backtest_run_id, backtest_contract_name, backtest_contract_hash)"""
MIRRORS["latest_run"] = """
select * from runs qualify row_number() over (partition by forecast_contract_name
  order by started_at desc, forecast_run_id desc) = 1"""
# one line per published version of an output, from the rules the ledgers above are built by:
# low confidence is overridden by a tenth more, the second version adds one
MIRRORS["fva_lines"] = """
select o.forecast_run_id, o.forecast_contract_name, version as publication_version, o.grain, o.horizon,
       'planner_' || o.horizon as planner,
       case when o.confidence_flag <> 'low' then 'no_override' when o.horizon > 3 then 'promotion'
            else 'local_event' end as reason_code, d.observed_sales_units as sold, o.prediction_p50 as plain,
       case when o.confidence_flag = 'low' then o.prediction_p50 * 1.1 else o.prediction_p50 end as planned
from outputs o join (select unnest([1, 2]) as version) on version = 1 or extract(month from o.forecast_origin) % 2 = 0
left join demand_day d on d.date = o.target_date and o.entity_key_json = '{"store_nbr":' || d.store_nbr || '}'
where o.forecast_status = 'published'"""
MIRRORS["fva_sums"] = """
select forecast_run_id, forecast_contract_name, publication_version, grain, horizon, planner, reason_code,
       count(*) as lines, count(sold) as known, nullif(sum(abs(sold)), 0) as size, sum(abs(plain - sold)) as off_plain,
       sum(abs(planned - sold)) as off_planned, sum(abs(planned + publication_version - 1 - sold)) as off_published
from fva_lines group by all"""
MIRRORS["fva_ops"] = """
select * exclude (lines, known, size, off_plain, off_planned, off_published), 'warehouse' as destination,
       lines as forecast_count, known as actual_count, off_plain / size as statistical_wape,
       off_planned / size as planner_adjusted_wape, off_published / size as published_wape,
       case known when 0 then 'awaiting_actuals' when lines then if(size is null, 'undefined_metric', 'comparable')
            else 'incomplete_actuals' end as comparison_status,
       if(known = lines, off_plain / size - off_published / size, null) as total_wape_fva_points
from fva_sums"""
