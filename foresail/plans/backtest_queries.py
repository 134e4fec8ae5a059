"""Queries over demand (DE), backtesting (BT), calibration (CA), routing (CL)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foresail.contracts import BASELINES, BacktestContract, RoutingPolicy, StrategyAvailability
from foresail.functions.expr import canonical_json
from foresail.operators import backtest as bt
from foresail.operators import calibration as ca
from foresail.operators import demand as de
from foresail.operators import metrics as me
from foresail.operators import routing as cl
from foresail.plans.registry import Source, query
from foresail.plans.relations import MIRRORS, SHARED
from foresail.session import stored

HORIZONS = (1, 7, 14)

MIRRORS["dense_panel"] = """
select st.store_nbr, st.state as region, sp.date,
       case when sp.date <= (select train_end from cutoff) then coalesce(d.sales, 0.0) end as sales
from raw_stores st cross join (select unnest(generate_series((select min(date) from sales_raw),
  (select max(date) from sales_raw), interval 1 day))::date as date) sp
left join store_day d on d.date = sp.date and d.store_nbr = st.store_nbr"""
MIRRORS["demand_day"] = """
select date, store_nbr, max(data_split_source) as data_split_source, sum(sales) as observed_sales_units,
       max(on_promotion) = 1 as promotion_planned
from sales_fact group by date, store_nbr"""
MIRRORS["elig"] = """
select to_json({'store_id': cast(store_nbr as varchar)})::varchar as entity_key_json, date, store_nbr,
       case when first_observed_date is null then 'no_observed_history'
            when observed_history_days < 28 then 'insufficient_history' end as ineligibility_reason,
       observed_history_days, first_observed_date, observed_sales_units, promotion_planned, data_split_source
from (select *, min(case when observed_sales_units is not null then date end) over (partition by store_nbr)
               as first_observed_date,
             count(observed_sales_units) over (partition by store_nbr order by date
               rows between unbounded preceding and current row) as observed_history_days
      from demand_day)"""
MIRRORS["elig_summary"] = """
select date as eligibility_date, 'observed_sales_only' as demand_policy, count(*) as candidate_entity_count,
  count(*) filter (ineligibility_reason is null) as eligible_entity_count,
  count(*) filter (ineligibility_reason is not null) as excluded_entity_count,
  (count(*) filter (ineligibility_reason is null)) / count(*) as eligibility_ratio,
  count(*) filter (ineligibility_reason = 'no_observed_history') as no_observed_history_count,
  count(*) filter (ineligibility_reason = 'insufficient_history') as insufficient_history_count,
  to_json((list({'entity_key_json': entity_key_json, 'ineligibility_reason': ineligibility_reason}
     order by entity_key_json) filter (ineligibility_reason is not null))[1:100])::varchar as exclusion_sample_json
from elig group by date"""

# a frozen candidate population: every store on the last sixty days
SHARED["candidates"] = """
select store_nbr, date, cast(extract(day from date) % 7 + 1 as int) as forecast_horizon,
       sales >= 20 as is_eligible,
       case when sales < 20 then 'low_volume' end as ineligibility_reason, promoted = 1 as has_exception
from store_day"""


@query(
    "de1_demand_daily",
    "date:d store_nbr:i data_split_source observed_sales_units:f promotion_planned:b",
    "select * from demand_day",
)
def demand_daily(s: Source):
    return de.demand_daily(s.fact)


@query(
    "de2_eligibility",
    "entity_key_json date:d store_nbr:i is_eligible:b ineligibility_reason observed_history_days:i "
    "first_observed_date:d observed_sales_units:f promotion_planned:b data_split_source",
    "select *, ineligibility_reason is null as is_eligible from elig",
)
def eligibility(s: Source):
    return de.eligibility(de.demand_daily(s.fact))


@query(
    "de3_eligibility_summary",
    "eligibility_date:d demand_policy candidate_entity_count:i eligible_entity_count:i excluded_entity_count:i "
    "eligibility_ratio:f no_observed_history_count:i insufficient_history_count:i exclusion_sample_json",
    "select * from elig_summary",
)
def eligibility_summary(s: Source):
    return de.eligibility_summary(de.eligibility(de.demand_daily(s.fact)))


@query(
    "de4_run_eligibility",
    "forecast_run_id forecast_contract_name forecast_origin:d candidate_entity_count:i eligible_entity_count:i "
    "eligibility_ratio:f eligibility_evidence_status",
    """select r.forecast_run_id, r.forecast_contract_name, r.forecast_origin, e.candidate_entity_count,
              e.eligible_entity_count, e.eligibility_ratio,
              case when r.eligibility_snapshot_id is null then 'missing_snapshot_id'
                   when e.eligibility_date is null then 'missing_eligibility_summary' else 'complete'
              end as eligibility_evidence_status
       from runs r left join elig_summary e on cast(r.forecast_origin as date) = e.eligibility_date""",
)
def run_eligibility(s: Source):
    summary = de.eligibility_summary(de.eligibility(de.demand_daily(s.fact)))
    return de.run_eligibility(s.rel("runs"), summary)


def fingerprint_sql(text: str, source: str) -> str:
    words = ", ".join(
        f"sum(cast('0x' || substr(h, {1 + 15 * i}, 15) as bigint))::varchar" for i in range(4)
    )
    return f"""select sha256(concat_ws('-', count(*)::varchar, {words})) as digest, count(*) as population
               from (select sha256({text}) as h from {source})"""


CANDIDATE_KEY_SQL = """to_json({'entity': {'store_nbr': store_nbr}, 'horizon': forecast_horizon,
  'target_date': cast(date + forecast_horizon as varchar)})::varchar"""


@query("de5_snapshot_id", "eligibility_snapshot_id population:i", f"""
    select digest as eligibility_snapshot_id, population from ({fingerprint_sql(CANDIDATE_KEY_SQL, "candidates")})""")
def snapshot_id(s: Source):
    return de.snapshot(s.rel("candidates"), ["store_nbr"])


@query(
    "de6_eligibility_decisions",
    "eligibility_decision_id entity_key_json forecast_origin:d target_date:d horizon:i is_eligible:b "
    "ineligibility_reason has_exception:b",
    f"""select sha256(to_json({{'candidate_key': {CANDIDATE_KEY_SQL}, 'forecast_run_id': 'run'}})::varchar)
                 as eligibility_decision_id,
              to_json({{'store_nbr': store_nbr}})::varchar as entity_key_json, date as forecast_origin,
              date + forecast_horizon as target_date, forecast_horizon as horizon, is_eligible,
              ineligibility_reason, has_exception
       from candidates""",
)
def decisions(s: Source):
    from foresail.contracts import ForecastContract

    c = ForecastContract("store_demand", ("store_nbr",), tuple(range(1, 8)))
    at = F.col("date").cast("timestamp")
    return de.eligibility_decisions(s.rel("candidates"), c, "run", "snapshot", at)


@query(
    "de7_population_diff",
    "store_nbr:i date:d mismatch",
    """select coalesce(a.store_nbr, b.store_nbr) as store_nbr, coalesce(a.date, b.date) as date,
              case when a.date is null then 'not_scored' else 'not_eligible' end as mismatch
       from (select store_nbr, date from store_day where promoted = 0) a
       full join (select store_nbr, date from candidates where is_eligible) b
         on a.store_nbr = b.store_nbr and a.date = b.date
       where a.date is null or b.date is null""",
)
def population_diff(s: Source):
    scored = s.rel("store_day").filter("promoted = 0")
    return de.population_diff(scored, s.rel("candidates").filter("is_eligible"), ["store_nbr", "date"])


# --- backtesting ---------------------------------------------------------------
MIRRORS["bt_plan"] = f"""
select train_end - 14 - 28 * k as forecast_origin, h as horizon, train_end - 14 - 28 * k + h as target_date
from cutoff, (select unnest([0, 1, 2, 3])::integer as k), (select unnest({list(HORIZONS)})::integer as h)"""
MIRRORS["bt_origin"] = "select distinct forecast_origin from bt_plan"
MIRRORS["bt_grid"] = """
select s.store_nbr, s.region, p.* from (select store_nbr, max(region) as region from dense_panel group by 1) s
cross join bt_plan p"""
MIRRORS["bt_observed"] = """
select d.store_nbr, o.forecast_origin, d.date, d.sales as y,
       row_number() over (partition by d.store_nbr, o.forecast_origin order by d.date) as rn,
       row_number() over (partition by d.store_nbr, o.forecast_origin order by d.date desc) as back
from dense_panel d join bt_origin o on d.date <= o.forecast_origin and d.date > o.forecast_origin - 90
where d.sales is not null"""
MIRRORS["bt_first"] = "select store_nbr, forecast_origin, min(rn) as f from bt_observed where y > 0 group by 1, 2"
MIRRORS["bt_fold"] = """
select b.store_nbr, b.forecast_origin, b.rn, b.y as size, cast(f.f as double) as gap, 1.0::double as elapsed,
       b.y as tsize, 1.0 / f.f as prob
from bt_observed b join bt_first f on b.store_nbr = f.store_nbr and b.forecast_origin = f.forecast_origin
  and b.rn = f.f
union all
select b.store_nbr, b.forecast_origin, b.rn,
       case when b.y > 0 then r.size + 0.1::double * (b.y - r.size) else r.size end,
       case when b.y > 0 then r.gap + 0.1::double * (r.elapsed - r.gap) else r.gap end,
       case when b.y > 0 then 1.0 else r.elapsed + 1.0 end,
       case when b.y > 0 then r.tsize + 0.1::double * (b.y - r.tsize) else r.tsize end,
       r.prob + 0.1::double * ((case when b.y > 0 then 1.0 else 0.0 end)::double - r.prob)
from bt_fold r join bt_observed b on b.store_nbr = r.store_nbr and b.forecast_origin = r.forecast_origin
  and b.rn = r.rn + 1"""
MIRRORS["bt_rates"] = """
select store_nbr, forecast_origin, arg_max(0.95::double * size / gap, rn) as sba, arg_max(prob * tsize, rn) as tsb
from bt_fold group by 1, 2"""
MIRRORS["bt_window"] = """
select o.store_nbr, o.forecast_origin, max(case when back = 1 then y end) as last_y,
       avg(case when back <= 7 then y end) as moving, max(coalesce(r.sba, 0)) as sba, max(coalesce(r.tsb, 0)) as tsb
from bt_observed o left join bt_rates r using (store_nbr, forecast_origin) group by 1, 2"""
MIRRORS["bt_scales"] = """
select store_nbr, forecast_origin, nullif(avg(abs(d)), 0) as mase_scale, nullif(avg(d * d), 0) as rmsse_scale
from (select store_nbr, forecast_origin, y - lag(y) over (partition by store_nbr, forecast_origin order by date) as d
      from bt_observed) group by 1, 2"""
MIRRORS["bt_wide"] = """
select g.*, a.sales as actual, w.last_y as last_observation, w.moving as moving_average, w.sba as croston_sba,
       w.tsb as tsb, (w.sba + w.tsb) / 2 as croston_sba_tsb,
       case when g.target_date - 7 <= g.forecast_origin then wk.sales end as seasonal_naive_7d,
       yr.sales as same_period_last_year, 0.0 as zero_demand, sc.mase_scale, sc.rmsse_scale
from bt_grid g
left join dense_panel a on a.store_nbr = g.store_nbr and a.date = g.target_date
left join dense_panel wk on wk.store_nbr = g.store_nbr and wk.date = g.target_date - 7
left join dense_panel yr on yr.store_nbr = g.store_nbr and yr.date = cast(g.target_date - interval 1 year as date)
left join bt_window w on w.store_nbr = g.store_nbr and w.forecast_origin = g.forecast_origin
left join bt_scales sc on sc.store_nbr = g.store_nbr and sc.forecast_origin = g.forecast_origin"""
MIRRORS["bt_scored"] = "\nunion all\n".join(
    f"""select store_nbr, region, forecast_origin, horizon, target_date, '{b}' as baseline_name, actual,
               cast({b} as double) as prediction, mase_scale, rmsse_scale from bt_wide"""
    for b in BASELINES
)
POINT_SQL = """count(actual) as eligible_count,
  count(*) filter (actual is not null and prediction is not null) as prediction_count,
  sum(abs(prediction - actual)) / nullif(sum(case when prediction is not null then abs(actual) end), 0) as wape,
  avg(abs(prediction - actual)) as mae,
  avg(case when mase_scale > 0 then abs(prediction - actual) / mase_scale end) as mase,
  sqrt(avg(case when rmsse_scale > 0 then pow(prediction - actual, 2) / rmsse_scale end)) as rmsse,
  avg(prediction - actual) as bias,
  count(*) filter (actual is not null and prediction is not null) / nullif(count(actual), 0)
    as prediction_completeness"""
POINT_SPEC = "eligible_count:i prediction_count:i wape:f mae:f mase:f rmsse:f bias:f prediction_completeness:f"


def contract(s: Source) -> BacktestContract:
    last = s.train_end - dt.timedelta(days=14)
    return BacktestContract(
        name="store_demand",
        origins=tuple(bt.origins(last - dt.timedelta(days=84), last, 28)),
        horizons=HORIZONS,
        entity_columns=("store_nbr",),
        segment_columns=("region",),
        actual_column="sales",
    )


def scored(s: Source):
    return bt.score_baselines(s.panel, contract(s), run_id="run")


PLAN_SPEC = "forecast_origin:d horizon:i target_date:d"


@query("bt1_origins", "forecast_origin:d", "select * from bt_origin")
def origin_list(s: Source):
    return bt.plan(s.spark, contract(s)).select("forecast_origin").distinct().join(
        s.rel("store_day").select(F.max("date").alias("last")), F.col("forecast_origin") <= F.col("last")
    )


@query(
    "bt2_plan",
    f"store_nbr:i region {PLAN_SPEC}",
    "select store_nbr, region, forecast_origin, horizon, target_date from bt_grid",
)
def plan(s: Source):
    return bt.entity_grid(bt.plan(s.spark, contract(s)), s.panel, contract(s))


@query(
    "bt3_panel_duplicates",
    "date:d store_nbr:i item_nbr:i n_rows:i",
    "select date, store_nbr, item_nbr, count(*) as n_rows from sales_raw group by 1, 2, 3 having count(*) > 1",
)
def duplicates(s: Source):
    keys = ["date", "store_nbr", "item_nbr"]
    return s.rel("sales_raw").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


@query("bt4_attach_actuals", f"store_nbr:i {PLAN_SPEC} actual:f", "select * from bt_wide")
def actuals(s: Source):
    return bt.attach_actuals(bt.plan(s.spark, contract(s)), s.panel, contract(s))


def _register_baseline(number: int, name: str) -> None:
    @query(
        f"bt{number}_{name}",
        f"store_nbr:i {PLAN_SPEC} prediction:f",
        f"select *, {name} as prediction from bt_wide",
    )
    def one(s: Source):
        return bt.baseline(name, s.panel, contract(s))


for _i, _name in enumerate(BASELINES):
    _register_baseline(5 + _i, _name)


@query(
    "bt13_score_baselines",
    f"store_nbr:i {PLAN_SPEC} baseline_name segment_key_json actual:f prediction:f mase_scale:f rmsse_scale:f",
    "select *, to_json({'region': region})::varchar as segment_key_json from bt_scored",
)
def score(s: Source):
    return scored(s)


@query(
    "bt15_scale_denominators",
    "store_nbr:i forecast_origin:d mase_scale:f rmsse_scale:f",
    "select * from bt_scales",
)
def scales(s: Source):
    return bt.scale_denominators(s.panel, contract(s))


@query(
    "bt16_point_metrics",
    f"baseline_name horizon:i {POINT_SPEC}",
    f"select baseline_name, horizon, {POINT_SQL} from bt_scored group by 1, 2",
)
def point(s: Source):
    return me.point_metrics(scored(s), ["baseline_name", "horizon"])


@query(
    "bt18_metrics_by_segment",
    f"forecast_origin:d horizon:i baseline_name segment_key_json {POINT_SPEC}",
    f"""select forecast_origin, horizon, baseline_name, '{{}}' as segment_key_json, {POINT_SQL}
        from bt_scored group by 1, 2, 3
        union all
        select forecast_origin, horizon, baseline_name, to_json({{'region': region}})::varchar, {POINT_SQL}
        from bt_scored group by forecast_origin, horizon, baseline_name, region""",
)
def by_segment(s: Source):
    return me.metrics_by_segment(scored(s))


@query(
    "bt19_backtest_run",
    "target grain metric_policy_json origin_start:d origin_end:d prediction_count:i metric_count:i status",
    """select 'demand_units' as target, 'store-day' as grain,
              '{"evaluation_protocol":"rolling_origin","primary_metric":"wape"}' as metric_policy_json,
              min(forecast_origin) as origin_start, max(forecast_origin) as origin_end,
              count(*) as prediction_count,
              count(distinct (forecast_origin, horizon, baseline_name))
                + count(distinct (forecast_origin, horizon, baseline_name, region)) as metric_count,
              'completed' as status from bt_scored""",
)
def run_row(s: Source):
    pred = scored(s)
    at = F.lit(s.train_end).cast("timestamp")
    return bt.backtest_run(pred, me.metrics_by_segment(pred), contract(s), at)


# --- holdout metrics -----------------------------------------------------------
SHARED["naive_day"] = """
select date, store_nbr, region, sales as actual,
       lag(sales) over (partition by store_nbr order by date) as prediction
from store_day"""
HOLDOUT_SPEC = (
    "region mean_pred:f mean_actual:f mae:f rmse:f mse:f r2:f mape:f wape:f smape:f bias:f median_ae:f"
)
HOLDOUT_SQL = """avg(prediction) as mean_pred, avg(actual) as mean_actual, avg(abs(actual - prediction)) as mae,
  sqrt(avg(pow(actual - prediction, 2))) as rmse, avg(pow(actual - prediction, 2)) as mse,
  1 - sum(pow(actual - prediction, 2)) / (var_pop(actual) * count(*)) as r2,
  avg(abs((actual - prediction) / (actual + 1e-10))) * 100 as mape,
  sum(abs(actual - prediction)) / (sum(abs(actual)) + 1e-10) * 100 as wape,
  avg(2 * abs(actual - prediction) / (abs(actual) + abs(prediction) + 1e-10)) * 100 as smape,
  avg(prediction - actual) as bias, quantile_cont(abs(actual - prediction), 0.5) as median_ae"""


@query(
    "bt21_holdout_metrics",
    HOLDOUT_SPEC,
    f"select region, {HOLDOUT_SQL} from naive_day where prediction is not null group by region",
)
def holdout(s: Source):
    return me.holdout_metrics(s.rel("naive_day"), "actual", "prediction", ["region"])


# --- calibration ---------------------------------------------------------------
MIRRORS["ca_rows"] = """
select *, abs(actual - prediction) as r from bt_scored
where baseline_name in ('moving_average', 'seasonal_naive_7d') and actual is not null and prediction is not null"""
MIRRORS["ca_ranked"] = """
select horizon, r, row_number() over (partition by horizon order by r) as k,
       row_number() over (order by r) as kp, count(*) over (partition by horizon) as n, count(*) over () as np
from ca_rows"""


def _rank_sql(n: str) -> str:
    upper = f"least(((({n}) + 1) * 8 + 9) // 10, {n})"
    return f"(({upper}) * (({n}) - 1) + ({n}) - 1) // ({n}) + 1"


MIRRORS["ca_radius"] = f"select horizon, r as radius, n from ca_ranked where k = {_rank_sql('n')}"
MIRRORS["ca_pooled"] = f"select r as radius, np as n from ca_ranked where kp = {_rank_sql('np')}"


def residual_rows(s: Source):
    return scored(s).filter(F.col("baseline_name").isin("moving_average", "seasonal_naive_7d"))


@query(
    "ca1_conformal_radius",
    "horizon:i residual_count:i radius:f",
    "select horizon, n as residual_count, radius from ca_radius",
)
def radius(s: Source):
    return ca.conformal_radius(ca.residuals(residual_rows(s), ["horizon"]), [0.8], ["horizon"])


CA_SPEC = "store_nbr:i forecast_origin:d horizon:i prediction_p10:f prediction_p50:f prediction_p90:f"


def _calibrated_sql(radius: str, source: str) -> str:
    return f"""select b.store_nbr, b.forecast_origin, b.horizon, b.actual, greatest(b.tsb - {radius}, 0.0) as prediction_p10,
      greatest(b.tsb, 0.0) as prediction_p50, greatest(b.tsb + {radius}, 0.0) as prediction_p90
      from bt_wide b {source}"""


MIRRORS["ca_pool_fc"] = _calibrated_sql("p.radius", "cross join ca_pooled p")
MIRRORS["ca_horizon_fc"] = _calibrated_sql(
    "coalesce(h.radius, p.radius)", "cross join ca_pooled p left join ca_radius h on h.horizon = b.horizon and h.n >= 20"
)


def points(s: Source):
    keep = ["store_nbr", "forecast_origin", "horizon", "actual"]
    return scored(s).filter("baseline_name = 'tsb'").select(*keep, "prediction")


@query("ca2_calibrate", CA_SPEC, "select * from ca_pool_fc")
def calibrate(s: Source):
    return ca.calibrate(points(s), ca.residuals(residual_rows(s), []))


def horizon_calibrated(s: Source):
    """Points and residuals come from one scoring, which is read three times."""
    keep = ["store_nbr", "forecast_origin", "horizon", "actual", "prediction"]
    rows = scored(s).select("baseline_name", *keep)
    rows = stored(rows.filter(F.col("baseline_name").isin("tsb", "moving_average", "seasonal_naive_7d")))
    point = rows.filter("baseline_name = 'tsb'").select(*keep)
    return ca.calibrate_by_horizon(point, rows.filter("baseline_name <> 'tsb'"), horizon="horizon")


@query("ca3_calibrate_by_horizon", CA_SPEC, "select * from ca_horizon_fc")
def calibrate_horizon(s: Source):
    return horizon_calibrated(s)


@query(
    "ca4_attach_intervals",
    "store_nbr:i forecast_origin:d horizon:i prediction_lower:f prediction:f prediction_upper:f",
    """select *, prediction_p10 as prediction_lower, prediction_p50 as prediction,
              prediction_p90 as prediction_upper from ca_horizon_fc""",
)
def intervals(s: Source):
    return ca.attach_intervals(horizon_calibrated(s))


@query(
    "bt17_probabilistic_metrics",
    "horizon:i pinball_loss:f interval_coverage:f interval_width:f calibration_error:f",
    """select horizon, avg((greatest(0.1 * (actual - prediction_p10), -0.9 * (actual - prediction_p10))
                + greatest(0.5 * (actual - prediction_p50), -0.5 * (actual - prediction_p50))
                + greatest(0.9 * (actual - prediction_p90), -0.1 * (actual - prediction_p90))) / 3) as pinball_loss,
              avg((actual between prediction_p10 and prediction_p90)::double) as interval_coverage,
              avg(prediction_p90 - prediction_p10) as interval_width,
              abs(avg((actual between prediction_p10 and prediction_p90)::double) - 0.8) as calibration_error
       from ca_horizon_fc where actual is not null group by horizon""",
)
def probabilistic(s: Source):
    return me.prob_metrics(horizon_calibrated(s), ["horizon"])


# --- routing -------------------------------------------------------------------
MIRRORS["cl_profile"] = """
select *, to_json({'product_id': product_id, 'store_nbr': store_nbr})::varchar as entity_key_json,
  history_length / nullif(nonzero_observation_count, 0) as average_demand_interval,
  history_length < 6 or nonzero_observation_count < 2 as is_cold_start,
  nonzero_observation_count = 0 or history_length / nullif(nonzero_observation_count, 0) >= 1.32 as is_intermittent
from (select store_nbr, product_id, count(*) as history_length,
        count(*) filter (demand > 0) as nonzero_observation_count,
        coalesce(var_pop(case when demand > 0 then demand end)
          / pow(avg(case when demand > 0 then demand end), 2), 0) as coefficient_of_variation_squared
      from (select store_nbr, product_id, coalesce(sales, 0) as demand from sales_fact) group by 1, 2)"""
CL_SPEC = (
    "entity_key_json history_length:i nonzero_observation_count:i average_demand_interval:f "
    "coefficient_of_variation_squared:f9 is_intermittent:b is_cold_start:b"
)
POLICY = RoutingPolicy(minimum_history=6, minimum_nonzero_observations=2)


def profiles(s: Source):
    return cl.classify_series(s.fact, ["store_nbr", "product_id"], "sales", POLICY)


@query(
    "cl1_classify_series",
    f"{CL_SPEC} recommended_strategy",
    """select *, case when is_cold_start then 'global_model' when is_intermittent then 'intermittent_rate_baseline'
              else 'entity_model' end as recommended_strategy from cl_profile""",
)
def classify(s: Source):
    return profiles(s)


ROUTED_SPEC = "entity_key_json forecast_strategy fallback_reason confidence_flag"
REASON_SQL = "case when is_cold_start then 'cold_start' when is_intermittent then 'intermittent_demand' end"


@query(
    "cl2_choose_strategy",
    ROUTED_SPEC,
    f"""select entity_key_json,
          case when not is_cold_start and not is_intermittent then 'entity_model'
               when is_intermittent then 'intermittent_rate_baseline' else 'seasonal_baseline' end as forecast_strategy,
          {REASON_SQL} as fallback_reason,
          case when not is_cold_start and not is_intermittent then 'high' else 'low' end as confidence_flag
        from cl_profile""",
)
def choose(s: Source):
    available = StrategyAvailability(global_model=False, aggregate_allocation=False)
    return cl.choose_strategy(profiles(s), available)


ORDERS = {
    "cold_start": ["aggregate_allocation", "global_model"],
    "intermittent": ["intermittent_rate_baseline", "global_model"],
}


@query(
    "cl3_route_by_contract",
    ROUTED_SPEC,
    """select entity_key_json,
         case when is_cold_start then 'global_model' when is_intermittent then 'intermittent_rate_baseline'
              else 'global_model' end as forecast_strategy,
         case when is_cold_start then 'cold_start' when is_intermittent then 'intermittent_demand'
              else 'entity_model_unavailable' end as fallback_reason,
         case when is_cold_start then 'medium' when is_intermittent then 'low' else 'medium' end as confidence_flag
       from cl_profile""",
)
def route(s: Source):
    orders = cl.order_table(
        ORDERS,
        allowed=["global_model", "intermittent_rate_baseline", "business_default"],
        available=["global_model", "intermittent_rate_baseline", "aggregate_allocation"],
    )
    return cl.route(profiles(s), orders)


@query(
    "cl4_classification_rows",
    f"classification_id forecast_contract_name {CL_SPEC}",
    f"""select sha256(to_json({{'entity_key_json': entity_key_json, 'forecast_contract_hash': 'contract-hash',
              'forecast_origin': (select cast(train_end as varchar) from cutoff),
              'routing_policy_hash': '{POLICY.hash}'}})::varchar) as classification_id,
              'store_demand' as forecast_contract_name, * from cl_profile""",
)
def classification(s: Source):
    origin = F.lit(s.train_end)
    return cl.classification_rows(
        profiles(s), "store_demand", "contract-hash", origin, origin.cast("timestamp"), POLICY
    )


MIRRORS["cl_batch"] = """
select d.store_nbr, to_json({'store_nbr': d.store_nbr})::varchar as entity_key_json, date
from store_day d where date > (select train_end from cutoff)"""


@query(
    "cl5_route_batch",
    f"store_nbr:i date:d {ROUTED_SPEC}",
    """select b.store_nbr, b.date, b.entity_key_json, 'global_model' as forecast_strategy,
         case when p.n is null then 'no_routing_history' when p.n < 28 or p.nz < 3 then 'cold_start'
              when p.nz = 0 or p.n / nullif(p.nz, 0) >= 1.32 then 'intermittent_demand' end as fallback_reason,
         case when p.n >= 28 and p.nz >= 3 and p.n / p.nz < 1.32 then 'high' else 'medium' end as confidence_flag
       from cl_batch b left join (select store_nbr, count(actual) as n, count(*) filter (actual > 20) as nz
         from (select store_nbr, case when sales > 20 then sales else 0 end as actual from store_day
               where date <= (select train_end from cutoff) and city <> 'NATION_3') group by 1) p
         on p.store_nbr = b.store_nbr""",
)
def batch(s: Source):
    day = s.rel("store_day").withColumn("entity_key_json", canonical_json(["store_nbr"]))
    cut = F.lit(s.train_end)
    history = day.filter((F.col("date") <= cut) & (F.col("city") != "NATION_3")).select(
        "entity_key_json", F.when(F.col("sales") > 20, F.col("sales")).otherwise(0.0).alias("actual")
    )
    return cl.route_batch(day.filter(F.col("date") > cut), history)


@query(
    "cl6_with_strategy",
    "store_nbr:i date:d forecast_strategy fallback_reason confidence_flag",
    """select store_nbr, date, 'seasonal_baseline' as forecast_strategy, 'cold_start' as fallback_reason,
              'low' as confidence_flag from store_day""",
)
def decision(s: Source):
    return cl.with_strategy(s.rel("store_day"), "seasonal_baseline", "cold_start", "low")
