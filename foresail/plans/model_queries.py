"""Queries over models (ML), model backtests (BT14, BT20), staged batches (FP4-FP7),
bounded reads, writers (IO) and streams (SS)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foresail.contracts import BacktestContract, ForecastContract, HierarchySpec, RunPins
from foresail.operators import batch as ba
from foresail.operators import hierarchy as hi
from foresail.operators import models as ml
from foresail.operators import splits as sp
from foresail.plans.backtest_queries import contract, residual_rows
from foresail.plans.registry import Source, query, spread
from foresail.plans.relations import MIRRORS, SHARED
from foresail.session import checkpointed, stored, work_root
from foresail.sources import history, tables, writers
from foresail.streaming import events as se

FEATURES = ["sales_store_l1d", "avg_sales_store_l7d", "month"]
HORIZONS = range(1, 8)
TARGETS = {h: f"sales_n{h}d" for h in HORIZONS}
TRIALS = 27

# Results of fits and the panel they share, written once for a session and folder.
_written: dict[tuple, object] = {}


def once(s: Source, name: str, make):
    key = (s.spark.sparkContext.applicationId, s.sf_dir, name)
    if key not in _written:
        made = make()
        _written[key] = stored(made) if isinstance(made, DataFrame) else made
    return _written[key]


def _panel(s: Source):
    """Every store and day, zero where nothing sold; labels lie whole days ahead."""
    day = s.rel("store_day").select("date", "store_nbr", "sales")
    lo, hi = day.agg(F.min("date"), F.max("date")).first()
    days = F.sequence(F.lit(lo), F.lit(hi), F.expr("interval 1 day"))
    grid = s.rel("raw_stores").repartition(spread(s.spark)).select("store_nbr", F.explode(days).alias("date"))
    dense = grid.join(day, ["date", "store_nbr"], "left").withColumn("sales", F.coalesce("sales", F.lit(0.0)))
    w = Window.partitionBy("store_nbr").orderBy("date")
    ahead = ml.direct_targets(dense, ["store_nbr"], "date", "sales", HORIZONS)
    return ahead.withColumns(
        {
            "sales_store_l1d": F.lag("sales").over(w),
            "avg_sales_store_l7d": F.avg("sales").over(w.rowsBetween(-7, -1)),
            "month": F.month("date").cast("double"),
        }
    ).dropna(subset=["sales_store_l1d"])


def rows(s: Source):
    return once(s, "panel", lambda: _panel(s))


# The same panel; the first day of each store has no features.
MIRRORS["model_days"] = """
select store_nbr, cast(d as date) as date from raw_stores, (select unnest(generate_series(
  (select min(date) from store_day), (select max(date) from store_day), interval 1 day)) as d)"""
MIRRORS["model_panel"] = """
select d.store_nbr, d.date, coalesce(s.sales, 0.0) as sales from model_days d
left join store_day s on s.store_nbr = d.store_nbr and s.date = d.date"""
MIRRORS["model_rows"] = """
select *, lag(sales) over w as sales_store_l1d,
       avg(sales) over (partition by store_nbr order by date rows between 7 preceding and 1 preceding) as avg_sales_store_l7d,
       lead(sales, 7) over w as sales_n7d
from model_panel window w as (partition by store_nbr order by date) qualify sales_store_l1d is not null"""


def scratch(name: str) -> str:
    """A path of its own in the session's work folder."""
    root = work_root(SparkSession.getActiveSession())
    return f"{root}/foresail-{name}-{uuid.uuid4().hex}/table"


SCORED = "store_nbr:i date:d prediction:f"
METRICS = "mae:f rmse:f wape:f r2:f bias:f median_ae:f metric_set"
POPULATION = "n_rows:i n_keys:i n_missing:i first_date:d last_date:d"


def population(predictions, keys, by=()):
    """Rows, distinct keys and rows without a prediction of a scored relation.

    The last key is a date. Days of a series are counted as bits of words of 64 days, which
    tasks combine before the shuffle, so it has a row for each word and none for each day."""
    *series, date = keys
    day, whole = F.unix_date(date), F.lit(True)
    for key in series:
        whole = whole & F.col(key).isNotNull()
    bit = F.expr(f"shiftleft(1L, cast(pmod(unix_date(`{date}`), 64) as int))")
    words = predictions.groupBy(*by, *series, F.floor(day / 64).alias("_word")).agg(
        F.count(F.lit(1)).alias("_rows"), F.bit_or(F.when(whole, bit)).alias("_days"),
        F.count_if(F.col("prediction").isNull() | F.isnan("prediction")).alias("_missing"),
        F.min(date).alias("_first"), F.max(date).alias("_last"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return words.groupBy(*by).agg(
        total("_rows").alias("n_rows"), total(F.bit_count("_days")).alias("n_keys"), total("_missing").alias("n_missing"),
        F.min("_first").alias("first_date"), F.max("_last").alias("last_date"),
    )


def _population_sql(where: str, by: str = "") -> str:
    """What ``population`` has to be: every key once, none without a prediction."""
    return f"""select {by} count(*) as n_rows, count(distinct (store_nbr, date)) as n_keys, 0 as n_missing,
                 min(date) as first_date, max(date) as last_date from model_rows {where}"""


def before_cutoff(s: Source):
    return once(s, "ml1 model", lambda: ml.train_before(rows(s), FEATURES, "sales_n1d", s.train_end))


def after_cutoff(s: Source):
    late = F.col("date") > F.lit(s.train_end)
    return once(s, "ml1", lambda: ml.score(before_cutoff(s), rows(s).filter(late), ["store_nbr", "date"]))


@query("ml1_gbt_before_cutoff", SCORED)
def gbt(s: Source):
    return after_cutoff(s)


@query("ml1_population", POPULATION, _population_sql("where date > (select train_end from cutoff)"))
def gbt_population(s: Source):
    return population(after_cutoff(s), ["store_nbr", "date"])


@query("ml2_gbt_holdout", METRICS)
def gbt_holdout(s: Source):
    return ml.train_with_holdout(rows(s), FEATURES, "sales_n1d", ["store_nbr"], purge_days=7)[1]


@query("ml3_random_forest_holdout", METRICS)
def forest_holdout(s: Source):
    return ml.train_with_holdout(rows(s), FEATURES, "sales_n1d", ["store_nbr"], ml.train_rf)[1]


def direct_models(s: Source):
    """Boosted trees for every horizon, from rows whose labels all lie before the cutoff."""
    def fit():
        train = ml.known_by(rows(s), s.train_end, max(HORIZONS))
        return ml.train_direct(train, TARGETS, FEATURES, trainer=ml.train_gbt_early)

    return once(s, "direct models", fit)


def direct(s: Source):
    return ml.score(direct_models(s), rows(s), ["store_nbr", "date", "sales"])


@query("ml4_direct_horizons", "store_nbr:i date:d forecast_horizon:i prediction:f")
def direct_horizons(s: Source):
    return direct(s)


BY_HORIZON = f"forecast_horizon:i {POPULATION}"


@query(
    "ml4_population",
    BY_HORIZON,
    _population_sql(", (select unnest(range(1, 8)) as h) group by h", "h as forecast_horizon,"),
)
def direct_population(s: Source):
    return population(direct(s), ["store_nbr", "date"], ["forecast_horizon"])


@query(
    "ml5_incomplete_batches",
    "store_nbr:i origin:d row_count:i horizon_count:i",
    """select store_nbr, origin, count(*) as row_count,
              count(distinct case when horizon in (1, 2) then horizon end) as horizon_count
       from outputs_raw group by 1, 2 having count(*) <> 2
         or count(distinct case when horizon in (1, 2) then horizon end) <> 2""",
)
def incomplete(s: Source):
    pred = s.rel("outputs_raw").withColumnRenamed("horizon", "forecast_horizon")
    return ml.incomplete_batches(pred, ["store_nbr", "origin"], [1, 2])


def recent_batch(s: Source):
    """All horizons for the fortnight before the cutoff, checked to be a complete batch."""
    def scored():
        days = F.col("date").between(F.lit(s.train_end - dt.timedelta(days=13)), F.lit(s.train_end))
        return ml.score(direct_models(s), rows(s).filter(days), ["store_nbr", "date"])

    batch = once(s, "ml6", scored)
    ml.check_horizon_batch(batch, ["store_nbr", "date"], HORIZONS)
    return batch


@query("ml6_batch_score", "store_nbr:i date:d forecast_horizon:i prediction:f")
def batch_score(s: Source):
    return recent_batch(s)


@query(
    "ml6_population",
    BY_HORIZON,
    _population_sql(
        """, (select unnest(range(1, 8)) as h) where date between (select train_end - 13 from cutoff)
             and (select train_end from cutoff) group by h""",
        "h as forecast_horizon,",
    ),
)
def batch_population(s: Source):
    return population(recent_batch(s), ["store_nbr", "date"], ["forecast_horizon"])


META = {
    "predict_run_id": "run1", "model_run_id": "m1", "model_id": "id1", "config_name": "cfg", "model_family": "store",
    "model_type": "gbt", "target_column": "actual", "model_artifact_uri": "models/id1",
}


@query(
    "ml7_prediction_rows",
    "prediction_id predict_run_id model_id run_date:d entity_id store_id:i product_id:i date:d actual:f prediction:f",
    """select sha256(to_json({'date': cast(date as varchar), 'predict_run_id': 'run1',
                'store_nbr': cast(store_nbr as varchar)})::varchar) as prediction_id, 'run1' as predict_run_id, 'id1' as model_id,
              date as run_date, cast(store_nbr as varchar) as entity_id, store_nbr as store_id, null as product_id, date, actual,
              prediction from naive_day where prediction is not null""",
)
def standard_rows(s: Source):
    scored = s.rel("naive_day").filter("prediction is not null")
    return ml.prediction_rows(scored, META, F.col("date").cast("timestamp"))


MIRRORS["recent_naive"] = "select * from naive_day where date >= (select last_date - 7 from cutoff) and prediction is not null"


@query(
    "ml8_evaluate_recent",
    "model_name run_date:d mean_absolute_error:f mean_squared_error:f r2_score:f",
    """select 'naive_' || region as model_name, (select last_date from cutoff) as run_date,
         avg(abs(prediction - actual)) as mean_absolute_error, avg(pow(prediction - actual, 2)) as mean_squared_error,
         1 - sum(pow(prediction - actual, 2)) / (var_pop(actual) * count(*)) as r2_score
       from recent_naive group by region""",
)
def evaluate_recent(s: Source):
    last = s.rel("cutoff").first()["last_date"]
    pred = s.rel("naive_day").filter("prediction is not null")
    return ml.evaluate_recent(pred.withColumn("model_name", F.concat(F.lit("naive_"), "region")), last)


@query(
    "ml9_recent_wape",
    "model_name run_date:d wape:f",
    """select 'store_' || store_nbr as model_name, date '2001-12-01' as run_date,
              sum(abs(actual - prediction)) / sum(abs(actual)) as wape
       from naive_day where prediction is not null group by 1, 2""",
)
def recent_wape(s: Source):
    named = s.rel("naive_day").withColumns(
        {"model_name": F.concat(F.lit("store_"), F.col("store_nbr").cast("string")), "run_date": F.lit(dt.date(2001, 12, 1))}
    )
    return ml.recent_wape(named.filter("prediction is not null"), named)


def explained(s: Source):
    """The trees of ml1 and what each feature adds to their predictions."""
    return ml.top_k_attributions(before_cutoff(s), rows(s), FEATURES, len(FEATURES), ["store_nbr", "date"])


@query("ml10_top_attributions", "store_nbr:i date:d predicted_value:f base_value:f first_feature first_value:f n_features:i")
def attributions(s: Source):
    first = F.element_at("top_feature_attributions", 1)
    return explained(s).select(
        "store_nbr", "date", "predicted_value", "base_value", first["feature"].alias("first_feature"),
        first["attribution"].alias("first_value"), F.size("top_feature_attributions").alias("n_features"),
    )


@query(
    "ml10_attribution_sums",
    "store_nbr:i date:d gap:f n_features:i ordered:b",
    "select store_nbr, date, 0.0 as gap, 3 as n_features, true as ordered from model_rows",
)
def attribution_sums(s: Source):
    """Base and contributions make up every prediction; contributions fall in size."""
    top = F.col("top_feature_attributions")
    sizes = F.transform(top, lambda t: F.abs(t["attribution"]))
    total = F.aggregate(top, F.col("base_value"), lambda so_far, t: so_far + t["attribution"])
    return explained(s).select(
        "store_nbr", "date", (total - F.col("predicted_value")).alias("gap"), F.size(top).alias("n_features"),
        (F.sort_array(sizes, asc=False) == sizes).alias("ordered"),
    )


SERIES = (
    "store_nbr:i part date:d forecast_date:d forecast_horizon:i actual:f prediction:f prediction_lower:f prediction_upper:f"
)
# part keys sell on few days, so many of their series are short
SHARED["part_day"] = """
select item_nbr, date, sum(unit_sales) as sales from sales_raw group by item_nbr, date"""


def arma(s: Source):
    return once(s, "ml11", lambda: ml.fit_series_arma(rows(s), ["store_nbr"], "date", "sales", 7))


def trend(s: Source):
    return once(s, "ml12", lambda: ml.fit_series_seasonal(rows(s), ["store_nbr"], "date", "sales", 7))


@query("ml11_series_autoregression", SERIES)
def autoregression(s: Source):
    return ml.series_forecasts(arma(s))


@query("ml12_series_seasonal", SERIES)
def seasonal(s: Source):
    return ml.series_forecasts(trend(s))


def _series_rows_sql() -> str:
    """Holdout rows are a fifth of a series, rounded up; a week follows its last day."""
    return """with n as (select store_nbr, count(*) as n, floor(count(*) * 0.8::double)::bigint as cut, max(date) as last,
                                list(date order by date) as days from model_rows group by 1)
      select store_nbr, 'holdout' as part, n - cut as n_rows, 0 as n_missing, days[cut + 1] as first_date,
             last as last_date, true as ordered from n
      union all select store_nbr, 'forward', 7, 0, last + 1, last + 7, true from n"""


def series_rows(fitted):
    low, high = F.col("prediction_lower"), F.col("prediction_upper")
    return ml.series_forecasts(fitted).groupBy("store_nbr", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prediction").isNull()).alias("n_missing"),
        F.min("forecast_date").alias("first_date"), F.max("forecast_date").alias("last_date"),
        F.every((low < F.col("prediction")) & (F.col("prediction") < high)).alias("ordered"),
    )


SERIES_ROWS = "store_nbr:i part n_rows:i n_missing:i first_date:d last_date:d ordered:b"


@query("ml11_series_rows", SERIES_ROWS, _series_rows_sql())
def arma_rows(s: Source):
    return series_rows(arma(s))


@query("ml12_series_rows", SERIES_ROWS, _series_rows_sql())
def trend_rows(s: Source):
    return series_rows(trend(s))


def _status_sql(least: int) -> str:
    return f"""select item_nbr, if(floor(count(*) * 0.8::double) >= {least}, 'fitted', 'short') as status, count(*) as n_obs
               from part_day group by item_nbr"""


STATUS = "item_nbr:i status n_obs:i"


@query("ml11_series_status", STATUS, _status_sql(24))
def arma_status(s: Source):
    fitted = ml.fit_series_arma(s.rel("part_day"), ["item_nbr"], "date", "sales", 7)
    return ml.series_status(fitted, ["item_nbr"])


@query("ml12_series_status", STATUS, _status_sql(25))
def trend_status(s: Source):
    fitted = ml.fit_series_seasonal(s.rel("part_day"), ["item_nbr"], "date", "sales", 7, weekly=1, yearly=0, min_obs=25)
    return ml.series_status(fitted, ["item_nbr"])


def search_ledger(s: Source):
    """Successive halving of 27 trials over boosting rounds, started twice on one ledger:
    the second start finds every fit done and adds none."""
    def searched():
        known = ml.known_by(rows(s), s.train_end, 1)
        train, held = sp.chrono_split(known, 0.2, "date", ["store_nbr"])  # filters of the stored panel
        space = {"maxDepth": (2, 8), "stepSize": (0.01, 0.3), "subsamplingRate": (0.5, 1.0)}
        at, path = dt.datetime(2001, 12, 1), scratch("trials")
        for _ in range(2):
            ledger = ml.successive_halving(
                train, held, FEATURES, "sales_n1d", space, TRIALS, 7, "gbt_store", "run1", at, path
            )
        return ledger

    return once(s, "ml13", searched)


LEDGER = "optimize_run_id config_name trial_number:i rung:i budget:i objective_metric objective_value:f parameters"


@query("ml13_trial_search", LEDGER)
def search(s: Source):
    return search_ledger(s)


@query(
    "ml13_rungs",
    "rung:i budget:i n_rows:i n_trials:i n_from_below:i best_is_least:b",
    """select rung, pow(3, rung + 1)::int as budget, pow(3, 3 - rung)::int as n_rows, n_rows as n_trials,
              case when rung = 0 then 0 else n_rows end as n_from_below, true as best_is_least
       from (select unnest(range(0, 4)) as rung from (select count(*) as n from model_rows))""",
)
def rungs(s: Source):
    """A third of each rung goes on, the best of it, and best_trial names the last one."""
    ledger = search_ledger(s)
    below = ledger.select((F.col("rung") + 1).alias("rung"), "trial_number", F.lit(1).alias("below"))
    best = ml.best_trial(ml.last_rung(ledger)).select("best_trial_number").first()[0]
    place = F.row_number().over(Window.partitionBy("rung").orderBy("objective_value", "trial_number"))
    # the winner is among the first third of every rung
    placed = ledger.withColumns({"place": place, "size": F.count(F.lit(1)).over(Window.partitionBy("rung"))})
    ahead = F.max(F.when(F.col("trial_number") == best, F.col("place") <= F.greatest(F.lit(1), F.col("size") / 3)))
    return placed.join(below, ["rung", "trial_number"], "left").groupBy("rung").agg(
        F.first("budget").alias("budget"), F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("trial_number").alias("n_trials"), F.count("below").alias("n_from_below"),
        ahead.alias("best_is_least"),
    )


SHARED["trial_ledger"] = """
select 'opt-' || cast(user_id % 5 as string) || '-' || event_type as optimize_run_id, 'cfg-' || event_type as config_name,
       cast(event_id as int) as trial_number, value as objective_value, props as parameters,
       timestamp '2024-01-01 00:00:00' + interval 1 hours as run_at from events"""


@query(
    "ml14_best_trial",
    "config_name optimize_run_id best_trial_number:i best_value:f best_params",
    """select config_name, optimize_run_id, trial_number as best_trial_number, objective_value as best_value,
              parameters as best_params
       from trial_ledger t where optimize_run_id = (select max(optimize_run_id) from trial_ledger u
                                                    where u.config_name = t.config_name)
       qualify row_number() over (partition by config_name order by objective_value, trial_number) = 1""",
)
def best(s: Source):
    return ml.best_trial(s.rel("trial_ledger"))


def model_backtest(s: Source):
    """A week ahead from every origin of the contract."""
    def scored():
        c = contract(s)
        named = BacktestContract(**{**c.__dict__, "model_config_name": "gbt_store", "train_window_days": 365})
        return ml.score_model(rows(s), named, FEATURES, TARGETS[7], 7, ml.train_gbt_early)

    return once(s, "bt14", scored)


@query("bt14_score_model", "store_nbr:i forecast_origin:d horizon:i baseline_name prediction:f")
def model_scores(s: Source):
    return model_backtest(s)


@query(
    "bt14_population",
    f"horizon:i {POPULATION}",
    _population_sql("where date in (select forecast_origin from bt_plan)", "7 as horizon,"),
)
def model_population(s: Source):
    scored = model_backtest(s).withColumn("date", F.col("forecast_origin"))
    return population(scored, ["store_nbr", "date"], ["horizon"])


def forward(s: Source):
    end = s.train_end
    return once(
        s, "bt20",
        lambda: ml.walk_forward(
            rows(s), end - dt.timedelta(days=14), end, 7, 180, FEATURES, TARGETS[7], ml.train_gbt_early, horizon=7
        ),
    )


@query("bt20_walk_forward", "store_nbr:i date:d as_of:d actual:f prediction:f")
def walk_forward(s: Source):
    return forward(s)


@query(
    "bt20_population",
    f"as_of:d {POPULATION}",
    _population_sql("where (select train_end from cutoff) - date in (0, 7, 14) group by date", "date as as_of,"),
)
def forward_population(s: Source):
    return population(forward(s), ["store_nbr", "date"], ["as_of"])


@query(
    "bt20_linear_walk_forward",
    "store_nbr:i date:d as_of:d actual:f4 prediction:f4",
    """with a as (select train_end - 7 * k as as_of from cutoff, (select unnest(range(0, 53))::integer as k)),
       fit as (select as_of, regr_slope(sales_n7d, avg_sales_store_l7d) as slope,
                      regr_intercept(sales_n7d, avg_sales_store_l7d) as icept
               from a join model_rows r on r.date > a.as_of - 180 and r.date + 7 < a.as_of group by as_of)
       select store_nbr, date, as_of, sales_n7d as actual, icept + slope * avg_sales_store_l7d as prediction
       from model_rows join fit on date = as_of""",
)
def linear_forward(s: Source):
    """A year of weekly anchors, all from one pass over the panel."""
    end = s.train_end
    return ml.walk_forward_linear(
        rows(s), end - dt.timedelta(days=364), end, 7, 180, ["avg_sales_store_l7d"], TARGETS[7], horizon=7
    )


# --- a staged batch ---------------------------------------------------------------------------
BATCH = ForecastContract("store_batch", ("store_nbr",), (1, 7, 14))


def staged(s: Source):
    origin = s.train_end
    heads = s.rel("store_day").groupBy("store_nbr").agg(
        F.max_by("sales", "date").alias("prediction"), F.count(F.lit(1)).alias("n")
    )
    spread = heads.select("*", F.explode(F.array(*[F.lit(h) for h in BATCH.horizons])).alias("forecast_horizon"))
    population = spread.withColumns(
        {
            "date": F.lit(origin),
            "is_eligible": F.col("n") >= 28,
            "ineligibility_reason": F.when(F.col("n") < 28, "insufficient_history"),
        }
    )
    text = {n: F.lit(n) for n in ("model_id", "config_name", "model_type", "model_artifact_uri", "model_run_id")}
    pred = population.filter("is_eligible").select(
        "store_nbr", "date", "forecast_horizon", "prediction"
    ).withColumns(text | {"prediction_id": F.md5(F.concat_ws("|", "store_nbr", "forecast_horizon"))})
    calib = stored(residual_rows(s).select("entity_key_json", "horizon", "actual", "prediction"))
    pins = RunPins("cand", "mr", "v1", "fa", origin, "sha")
    at = F.lit(dt.datetime.combine(origin, dt.time(6)))
    return ba.run_batch(pred, calib, population, BATCH, pins, at), pins, at


MIRRORS["staged_population"] = """
select store_nbr, n, last_sales, h as horizon from (select store_nbr, count(*) as n, arg_max(sales, date) as last_sales
  from store_day group by 1), (select unnest([1, 7, 14])::integer as h)"""


@query(
    "fp4_staged_batch",
    "entity_key_json horizon:i target_date:d prediction_p10:f prediction_p50:f prediction_p90:f forecast_strategy "
    "fallback_reason confidence_flag forecast_status",
    """select to_json({'store_nbr': b.store_nbr})::varchar as entity_key_json, b.horizon,
         (select train_end from cutoff) + b.horizon as target_date,
         greatest(last_sales - coalesce(h.radius, p.radius), 0) as prediction_p10, last_sales as prediction_p50,
         last_sales + coalesce(h.radius, p.radius) as prediction_p90, 'global_model' as forecast_strategy,
         case when r.n is null then 'no_routing_history' when r.n < 28 or r.nz < 3 then 'cold_start'
              when r.n / nullif(r.nz, 0) >= 1.32 then 'intermittent_demand' end as fallback_reason,
         case when r.n >= 28 and r.nz >= 3 and r.n / r.nz < 1.32 then 'high' else 'medium' end as confidence_flag,
         'draft' as forecast_status
       from staged_population b cross join ca_pooled p left join ca_radius h on h.horizon = b.horizon and h.n >= 20
       left join (select store_nbr, count(actual) as n, count(*) filter (actual > 0) as nz from bt_scored
                  where baseline_name in ('moving_average', 'seasonal_naive_7d') group by 1) r on r.store_nbr = b.store_nbr
       where b.n >= 28""",
)
def staged_batch(s: Source):
    return staged(s)[0].rows


TREE_BATCH = ForecastContract("node_batch", ("node_id",), (1, 7, 14), reconciliation_policy="bottom_up")


@query(
    "fp4_staged_hierarchy",
    "entity_key_json horizon:i target_date:d prediction_p10:f prediction_p50:f prediction_p90:f forecast_status "
    "reconciliation_method",
    """select to_json({'node_id': node})::varchar as entity_key_json, horizon,
              (select train_end from cutoff) + horizon as target_date, sum(greatest(last_sales - r, 0)) as prediction_p10,
              sum(last_sales) as prediction_p50, sum(last_sales + r) as prediction_p90, 'draft' as forecast_status,
              'bottom_up' as reconciliation_method
       from (select last_sales, b.horizon, coalesce(h.radius, p.radius) as r,
                    unnest(['company:all', 'region:' || state, 'store:' || b.store_nbr]) as node
             from staged_population b join raw_stores st using (store_nbr) cross join ca_pooled p
             left join ca_radius h on h.horizon = b.horizon and h.n >= 20 where b.n >= 28)
       group by node, horizon""",
)
def staged_hierarchy(s: Source):
    """Stores, regions and the company as one batch, reconciled from the stores upward."""
    origin = s.train_end
    heads = s.rel("store_day").groupBy("store_nbr").agg(
        F.max("region").alias("region"), F.max_by("sales", "date").alias("prediction"), F.count(F.lit(1)).alias("n")
    )
    heads = checkpointed(heads.filter("n >= 28"))
    levels = (("company", ()), ("region", ("region",)), ("store", ("store_nbr",)))
    nodes, edges = hi.build_hierarchy(heads.select("store_nbr", "region"), levels, "demand", "v1")
    leaf = heads.select(
        "store_nbr", "prediction", F.lit(origin).alias("date"), F.md5(F.col("store_nbr").cast("string")).alias("prediction_id"),
        F.explode(F.array(*[F.lit(h) for h in TREE_BATCH.horizons])).alias("forecast_horizon"),
    )
    text = {n: F.lit(n) for n in ("model_id", "config_name", "model_type", "model_artifact_uri", "model_run_id")}
    pred = hi.expand_leaves(leaf, nodes, edges, ["store_nbr"], ["date", "forecast_horizon"]).withColumns(text)
    pred = checkpointed(pred)
    population = pred.select("node_id", "date", "forecast_horizon").withColumns(
        {"is_eligible": F.lit(True), "ineligibility_reason": F.lit(None).cast("string")}
    )
    calib = stored(residual_rows(s).select("entity_key_json", "horizon", "actual", "prediction"))
    at = F.lit(dt.datetime.combine(origin, dt.time(6)))
    tree = ba.Hierarchy(HierarchySpec("demand", "v1", ("company", "region", "store")), nodes, edges)
    pins = RunPins("cand", "mr", "v1", "fa", origin, "sha")
    return ba.run_batch(pred, calib, population, TREE_BATCH, pins, at, tree).rows


@query("fp4_stage_records", "stage_name stage_position:i stage_status input_row_count:i output_row_count:i", """
    select stage_name, stage_position, 'completed' as stage_status, n as input_row_count, n as output_row_count
    from stage_names cross join (select count(*) as n from staged_population where n >= 28)""")
def stage_records(s: Source):
    return staged(s)[0].stages


@query("fp5_blocking_gates", "check_name passed:b observed_value:f threshold_value:f", """
    with p as (select cast(count(*) as double) as n from staged_population where n >= 28)
    select 'eligibility_snapshot_match' as check_name, true as passed, null::double as observed_value,
           null::double as threshold_value
    union all select 'eligibility_population_accounting', true, n, n from p
    union all select 'prediction_completeness', true, 1.0, 1.0
    union all select 'quantile_ordering', true, 0.0, 0.0
    union all select 'point_in_time_cutoff', true, null, null""")
def gates(s: Source):
    return staged(s)[0].checks


@query("fp7_persisted_counts", "relation n_rows:i n_ids:i", """
    with p as (select count(*) as n, count(*) filter (n >= 28) as e from staged_population)
    select 'outputs' as relation, e as n_rows, e as n_ids from p
    union all select 'eligibility_decisions', n, n from p
    union all select 'runs', 1, 1""")
def persisted(s: Source):
    result, pins, at = staged(s)
    path = scratch("run")
    ba.persist_run(result, BATCH, pins, path, at)
    ba.persist_run(result, BATCH, pins, path, at)  # a retry must add nothing
    ids = {"outputs": "forecast_output_id", "eligibility_decisions": "eligibility_decision_id", "runs": "forecast_run_id"}
    out = None
    for name, key in ids.items():
        row = s.spark.read.parquet(f"{path}/{name}").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_ids")
        ).select(F.lit(name).alias("relation"), "n_rows", "n_ids")
        out = row if out is None else out.unionByName(row)
    return out


# --- sources and sinks ---------------------------------------------------------------------------
@query(
    "io1_csv_round_trip",
    "store_nbr:i city state type cluster:i",
    "select * from raw_stores",
)
def csv_round_trip(s: Source):
    folder = scratch("csv")
    s.rel("raw_stores").write.option("header", True).csv(folder)
    return tables.read_csv(s.spark, folder, tables.RAW_SCHEMAS["stores"])


@query("io1_load_folder", "relation n_rows:i n_long:i id_sum:i text_sum:i", """
    select 'raw_items' as relation, count(*) as n_rows, count(*) filter (item_nbr % 3 = 0) as n_long, sum(item_nbr) as id_sum,
           sum(length(family) + if(item_nbr % 3 = 0, length('"a, b"' || chr(10) || chr(10) || 'c'), 0)) as text_sum from raw_items
    union all
    select 'raw_stores', count(*), 0, sum(store_nbr), sum(length(city) + length(state)) from raw_stores
    union all select 'skipped', 1, 0, 0, 0""")
def load_folder(s: Source):
    """Two known tables, one with line ends and quotes inside its texts, and an unknown one."""
    folder, target = scratch("incoming"), scratch("loaded")
    long = F.concat("family", F.lit('"a, b"\n\nc'))
    items = s.rel("raw_items").select(
        "item_nbr", F.when(F.col("item_nbr") % 3 == 0, long).otherwise(F.col("family")).alias("family"), "class",
        F.lit(None).cast("long").alias("perishable"),
    )
    for stem, df in (("items", items), ("stores", s.rel("raw_stores")), ("notes", s.rel("cutoff"))):
        df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{folder}/{stem}.csv")
    loaded = tables.load_csv_tables(s.spark, folder, target)
    found = {stem: s.spark.read.parquet(path) for stem, path in loaded.items()}
    told = lambda stem, key, text: found[stem].agg(
        F.lit(f"raw_{stem}").alias("relation"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(text.contains("\n")).alias("n_long"), F.sum(key).alias("id_sum"), F.sum(F.length(text)).alias("text_sum"),
    )
    skipped = s.spark.range(1 if "notes" not in loaded else 0).select(
        F.lit("skipped").alias("relation"), F.lit(1).alias("n_rows"), *[F.lit(0).alias(c) for c in ("n_long", "id_sum", "text_sum")]
    )
    return told("items", "item_nbr", F.col("family")).unionByName(
        told("stores", "store_nbr", F.concat("city", "state"))
    ).unionByName(skipped)


HISTORY = "store_nbr:i region date:d sales:f"


def _short(s: Source) -> BacktestContract:
    return BacktestContract(**{**contract(s).__dict__, "train_window_days": 60})


@query("io3_bounded_history", HISTORY, """
    select store_nbr, region, date, sales from store_day
    where date between (select min(forecast_origin) - 366 from bt_plan) and (select max(forecast_origin) + 14 from bt_plan)""")
def bounded(s: Source):
    return history.bounded_history(s.rel("store_day"), _short(s))


@query("io4_bounded_model_history", f"{HISTORY} promoted:i", """
    select * from store_day
    where date between (select min(forecast_origin) - 74 from bt_plan) and (select max(forecast_origin) + 14 from bt_plan)""")
def bounded_model(s: Source):
    c = BacktestContract(
        **{**contract(s).__dict__, "train_window_days": 60, "baselines": ("zero_demand", "moving_average")}
    )
    return history.bounded_model_history(s.rel("store_day"), c)


DAY = "date:d store_nbr:i sales:f"


def _ledger(s: Source):
    month = F.date_format("date", "yyyy-MM")
    return s.rel("store_day").select("date", "store_nbr", "sales", month.alias("month"))


@query("io7_overwrite_partitions", DAY, """
    select date, store_nbr, case when date >= date '2001-01-01' then sales + 1 else sales end as sales from store_day""")
def overwrite(s: Source):
    path = scratch("overwrite")
    rows_ = _ledger(s)
    writers.overwrite_partitions(rows_, path, "month")
    later = rows_.filter(F.col("month") >= "2001-01").withColumn("sales", F.col("sales") + 1)
    writers.overwrite_partitions(later, path, "month")
    return s.spark.read.parquet(path)


@query("io8_merge_replace", DAY, """
    select date, store_nbr, case when date >= date '2001-06-01' and sales > 30 then sales * 2 else sales end as sales
    from store_day""")
def merge(s: Source):
    path = scratch("merge")
    rows_ = _ledger(s)
    writers.overwrite_partitions(rows_, path, "month")
    changed = rows_.filter((F.col("month") >= "2001-06") & (F.col("sales") > 30)).withColumn("sales", F.col("sales") * 2)
    writers.merge_replace(changed, path, ["date", "store_nbr"], "month")
    return s.spark.read.parquet(path)


@query("io9_insert_once", "n_rows:i n_ids:i first_insert:i second_insert:i", """
    select count(*) as n_rows, count(*) as n_ids, count(*) filter (horizon <= 4) as first_insert,
           count(*) filter (horizon > 4) as second_insert from outputs""")
def insert(s: Source):
    path = scratch("insert")
    out = s.rel("outputs")
    first = writers.insert_once(out.filter("horizon <= 4"), path, "forecast_output_id")
    second = writers.insert_once(out, path, "forecast_output_id")
    return s.spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("forecast_output_id").alias("n_ids"),
        F.lit(first).alias("first_insert"), F.lit(second).alias("second_insert"),
    )


@query("io9_insert_once_by_partition", "month n_rows:i n_ids:i first_insert:i second_insert:i", """
    with m as (select strftime(target_date, '%Y-%m') as month, forecast_output_id from outputs)
    select month, count(*) as n_rows, count(distinct forecast_output_id) as n_ids, max(f) as first_insert,
           max(l) as second_insert
    from m cross join (select count(*) filter (month < x) as f, count(*) filter (month = x) as l
                       from m cross join (select max(month) as x from m)) group by month""")
def insert_by_partition(s: Source):
    """All months but the last, then the last two: only the last has new rows."""
    path = scratch("months")
    out = s.rel("outputs").withColumn("month", F.date_format("target_date", "yyyy-MM"))
    last = out.agg(F.max("month")).first()[0]
    before = out.filter(F.col("month") < last).agg(F.max("month")).first()[0]
    first = writers.insert_once(out.filter(F.col("month") < last), path, "forecast_output_id", "month")
    second = writers.insert_once(out.filter(F.col("month") >= before), path, "forecast_output_id", "month")
    return s.spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("forecast_output_id").alias("n_ids"),
        F.lit(first).alias("first_insert"), F.lit(second).alias("second_insert"),
    )


@query("io10_upsert", "forecast_output_id override_value:f reason_code", """
    select forecast_output_id, case when reason_code = 'promotion' then override_value + 1 else override_value end
      as override_value, reason_code from overrides""")
def upsert(s: Source):
    path = scratch("upsert")
    base = s.rel("overrides").select("forecast_output_id", "override_value", "reason_code")
    writers.upsert(base, path, "forecast_output_id")
    batch = base.filter("reason_code = 'promotion'").select(
        "forecast_output_id", (F.col("override_value") + 1).alias("override_value"),
        F.lit(None).cast("string").alias("reason_code"),
    )
    writers.upsert(batch, path, "forecast_output_id")
    return s.spark.read.parquet(path)


@query("io11_replace_then_append", DAY, """
    select date, store_nbr, sales from store_day where sales > 20 union all
    select date, store_nbr, sales from store_day where sales > 40""")
def replace_append(s: Source):
    path = scratch("write")
    day = s.rel("store_day").select("date", "store_nbr", "sales")
    writers.write(day, path, "replace")
    writers.write(day.filter("sales > 20"), path, "replace")
    writers.write(day.filter("sales > 40"), path, "append")
    return s.spark.read.parquet(path)


@query("io12_export_run", "forecast_run_id publication_version:i publication_id published_value:f", """
    select sha256(forecast_run_id) as forecast_run_id, publication_version, publication_id, published_value
    from publications where publication_version = 1
      and forecast_run_id = (select max(forecast_run_id) from publications)""")
def export(s: Source):
    path = scratch("export")
    pubs = s.rel("publications").withColumn("forecast_run_id", F.sha2(F.col("forecast_run_id"), 256))
    newest = s.rel("publications").agg(F.sha2(F.max("forecast_run_id"), 256).alias("r")).first()["r"]
    writers.export_run(pubs, newest, 1, path)
    return s.spark.read.parquet(path)


@query("io12_export_csv", "forecast_run_id publication_version:i publication_id published_value:f refused:b", """
    select sha256(forecast_run_id) as forecast_run_id, publication_version, publication_id, published_value, true as refused
    from publications where publication_version = 1
      and forecast_run_id = (select max(forecast_run_id) from publications)""")
def export_csv(s: Source):
    """CSV shards, read back with their declared types; a second export is refused."""
    path = scratch("export-csv")
    pubs = s.rel("publications").withColumn("forecast_run_id", F.sha2(F.col("forecast_run_id"), 256))
    newest = s.rel("publications").agg(F.sha2(F.max("forecast_run_id"), 256).alias("r")).first()["r"]
    writers.export_run(pubs, newest, 1, path, "csv")
    try:
        writers.export_run(pubs, newest, 1, path, "csv")
        refused = False
    except AnalysisException:
        refused = True
    return tables.read_csv(s.spark, path, pubs.schema).withColumn("refused", F.lit(refused))


# --- streams -------------------------------------------------------------------------------------------
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(s: Source):
    raw = s.spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("ss1_stream_insert_once", "event_id:i user_id:i event_type value:f", """
    select event_id, user_id, event_type, value from events""")
def stream_append(s: Source):
    path, folder, source = scratch("stream"), scratch("offsets"), scratch("arrivals")
    events = s.table("events")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    # three batches, the newest events first: all of the later ones are late and new
    step = (hi - lo) / 3
    cuts = [lo, lo + step, lo + 2 * step, None]
    for after, before in reversed(list(zip(cuts, cuts[1:], strict=False))):
        part = events.where(F.col("ts") >= F.lit(after))
        part = part if before is None else part.where(F.col("ts") < F.lit(before))
        part.write.mode("append").parquet(source)
        arriving = s.spark.readStream.schema(events.schema).parquet(source)
        # every event arrives twice
        doubled = arriving.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
        se.stream_insert_once(doubled, path, "event_id", folder).awaitTermination()
    return s.spark.read.parquet(path)


@query("ss2_stream_latest", "user_id:i event_id:i event_type value:f", """
    select user_id, event_id, event_type, value from events
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def stream_latest(s: Source):
    path, folder = scratch("latest"), scratch("offsets")
    latest = se.stream_latest(event_stream(s), ["user_id"], "ts", "event_id")

    def keep(batch, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

    running = latest.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", folder)
    running.trigger(availableNow=True).start().awaitTermination()
    return se.stream_latest(s.spark.read.parquet(path), ["user_id"], "_batch")


