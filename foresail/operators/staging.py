"""Raw sales, calendar and event tables to dense, typed panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresail.functions.calendar import CALENDAR_COLUMNS, calendar_parts
from foresail.functions.expr import as_column, surrogate_key

FACT_COLUMNS = [
    "id",
    "date",
    "store_nbr",
    "product_id",
    "product_family",
    "sales",
    "on_promotion",
    "data_split_source",
]


def date_spine(spark: SparkSession, lo, hi, loaded_to=None) -> DataFrame:
    """Every day from ``lo`` to ``hi``; continues after ``loaded_to`` if given.

    ``lo`` and ``hi`` are one-row frames (a scalar each) or dates. An inverted
    range gives no rows.
    """
    bounds = spark.range(1).select(F.lit(lo).cast("date").alias("lo"), F.lit(hi).cast("date").alias("hi"))
    if loaded_to is not None:
        bounds = bounds.withColumn("lo", F.date_add(F.lit(loaded_to).cast("date"), 1))
    return bounds.filter("lo <= hi").select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")
    )


def spine_bounds(train: DataFrame, test: DataFrame) -> tuple:
    """First train date and last test date (two min/max scans)."""
    return train.agg(F.min("date")).first()[0], test.agg(F.max("date")).first()[0]


def promotion_flag(value: Column | str) -> Column:
    """1 for any spelling of true, else 0 (also for NULL)."""
    return F.when(F.lower(as_column(value).cast("string")) == "true", 1).otherwise(0)


def stage_train(train: DataFrame, items: DataFrame) -> DataFrame:
    """Train sales with product family. Sales of unknown items drop out.

    The item dimension is joined without a forced broadcast: Spark broadcasts
    it while its size stays under the session's threshold.
    """
    families = items.select("item_nbr", F.col("family").alias("product_family"))
    return train.join(families, "item_nbr").select(
        surrogate_key(["date", "store_nbr", "item_nbr"]).alias("id"),
        "date",
        "store_nbr",
        F.col("item_nbr").alias("product_id"),
        "product_family",
        F.col("unit_sales").alias("sales"),
        promotion_flag("onpromotion").alias("on_promotion"),
    )


def stage_test(test: DataFrame, items: DataFrame, spine: DataFrame) -> DataFrame:
    """Every (store, item) of the test set on every spine date inside its bounds.

    The dates are a bounded calendar held as one array, so the dense grid comes
    from ``explode`` on the distinct pairs and needs no cross join.
    """
    lo, hi = test.agg(F.min("date"), F.max("date")).first()
    days = spine.filter(F.col("date").between(F.lit(lo), F.lit(hi))).agg(
        F.array_sort(F.collect_set("date")).alias("days")
    )
    dates = days.first()["days"]
    grid = (
        test.select("store_nbr", "item_nbr")
        .distinct()
        .withColumn("date", F.explode(F.array(*[F.lit(d) for d in dates])))
    )
    keys = ["date", "store_nbr", "item_nbr"]
    families = items.select("item_nbr", F.col("family").alias("product_family"))
    return (
        grid.join(test.select(*keys, "onpromotion"), keys, "left")
        .join(families, "item_nbr", "left")
        .select(
            surrogate_key(keys).alias("id"),
            "date",
            "store_nbr",
            F.col("item_nbr").alias("product_id"),
            "product_family",
            promotion_flag("onpromotion").alias("on_promotion"),
        )
    )


def sales_fact(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows in one fact; test rows carry no sales."""
    labelled = train.withColumn("data_split_source", F.lit("train"))
    withheld = test.withColumn("sales", F.lit(None).cast("double")).withColumn(
        "data_split_source", F.lit("test")
    )
    return labelled.select(*FACT_COLUMNS).unionByName(withheld.select(*FACT_COLUMNS))


def align_to_spine(df: DataFrame, spine: DataFrame, date: str = "date") -> DataFrame:
    """A sparse series on every spine date; gaps stay NULL."""
    return spine.select(date).join(df, date, "left")


def densify(spine: DataFrame, stores: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions on every (store, date), NULL where none was reported."""
    lo, hi = spine.agg(F.min("date"), F.max("date")).first()
    if lo is None:
        days = F.array().cast("array<date>")
    else:
        days = F.sequence(F.lit(lo), F.lit(hi), F.expr("interval 1 day"))
    keys = ["date", "store_nbr"]
    return (
        stores.select("store_nbr", F.explode(days).alias("date"))
        .join(transactions.select(*keys, "transactions"), keys, "left")
        .select(
            surrogate_key(keys).alias("id"),
            "date",
            "store_nbr",
            F.col("transactions").alias("store_transactions"),
        )
    )


def stage_events(holidays: DataFrame) -> DataFrame:
    """Holiday events with calendar parts and a surrogate id."""
    keyed = holidays.withColumn(
        "id", surrogate_key(["date", "locale", "type", "description", "transferred"])
    )
    renamed = keyed.withColumnsRenamed({"locale": "event_locale", "type": "event_type"})
    return calendar_parts(renamed)


# Flag name -> (locale, event type).
EVENT_FLAGS = {
    "is_national_holiday": ("National", "Holiday"),
    "is_national_event": ("National", "Event"),
    "is_national_additional": ("National", "Additional"),
    "is_national_bridge": ("National", "Bridge"),
    "is_national_work_day": ("National", "Work Day"),
    "is_national_transfer": ("National", "Transfer"),
    "is_regional_holiday": ("Regional", "Holiday"),
    "is_local_holiday": ("Local", "Holiday"),
    "is_local_additional": ("Local", "Additional"),
    "is_local_transfer": ("Local", "Transfer"),
}


FEW_PAIR_DAYS = 500_000  # about 30 MB


def store_event_flags(
    stores: DataFrame, events: DataFrame, match_col: str = "event_locale"
) -> DataFrame:
    """Ten event flags per store and event date.

    ``match_col`` names the event column compared with the store's city and
    state. The default is the scope column, as the published tables have it (so
    regional and local flags never fire); ``locale_name`` is the corrected mode.

    Events are reduced before stores come in: once per date for the national
    flags, once per (date, place) for the others. Stores of one city and state have
    the same flags, so these are worked out for every such pair and event date; a
    store finds its pair's days as one list and takes no part in any other shuffle.
    One row per event date, bounded by the calendar, is broadcast.
    """
    def fires(flag: str) -> Column:
        locale, kind = EVENT_FLAGS[flag]
        return F.coalesce(
            (F.col("event_locale") == locale) & (F.col("event_type") == kind), F.lit(False)
        )

    national = [f for f, (locale, _) in EVENT_FLAGS.items() if locale == "National"]
    placed = [f for f in EVENT_FLAGS if f not in national]
    by_date = events.groupBy("date", *CALENDAR_COLUMNS).agg(
        *[F.bool_or(fires(f)).alias(f) for f in national]
    )
    by_place = (
        events.filter(F.col("event_locale") != "National")
        .groupBy("date", F.col(match_col).alias("place"))
        .agg(*[F.bool_or(fires(f)).alias(f) for f in placed])
    )
    dates = F.broadcast(by_date.select("date"))
    pairs = stores.select("city", "state").distinct().crossJoin(dates)
    located = (
        pairs.withColumn("place", F.explode(F.array_distinct(F.array("city", "state"))))
        .join(by_place, ["date", "place"], "left")
        .groupBy("city", "state", "date")
        .agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in placed])
        .groupBy("city", "state")
        .agg(F.collect_list(F.struct("date", *placed)).alias("_days"))
        .withColumnsRenamed({"city": "_city", "state": "_state"})
    )
    if pairs.count() <= FEW_PAIR_DAYS:
        # few pairs are few keys to shuffle by
        located = F.broadcast(located)
    same = F.col("city").eqNullSafe(F.col("_city")) & F.col("state").eqNullSafe(F.col("_state"))
    return (
        stores.select("store_nbr", "city", "state")
        .repartition(4 * stores.sparkSession.sparkContext.defaultParallelism)
        .join(located, same)
        .select("store_nbr", F.inline("_days"))
        .join(F.broadcast(by_date), "date")
        .select("store_nbr", "date", *CALENDAR_COLUMNS, *national, *placed)
    )


def stores(df: DataFrame) -> DataFrame:
    return df.select("store_nbr", "city", "state", "type", "cluster")


RUN_KEYS = ["backtest_run_id", "backtest_contract_name", "backtest_contract_hash"]


def stage_backtest_runs(runs: DataFrame) -> DataFrame:
    """Runs with complete comparability metadata and their primary metric."""
    needed = ["target", "grain", "metric_policy_json", "model_type"]
    return runs.dropna(subset=needed).withColumn(
        "primary_metric", F.get_json_object("metric_policy_json", "$.primary_metric")
    )


def stage_backtest(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric rows with the run's model, target, grain and policy."""
    described = stage_backtest_runs(runs).select(
        *RUN_KEYS,
        "model_config_name",
        "model_family",
        "model_type",
        "target",
        "grain",
        "metric_policy_json",
        "primary_metric",
        "origin_start",
        "origin_end",
    )
    return metrics.join(described, RUN_KEYS)


def canonical_scope(scope: Column | str) -> Column:
    """Text of a JSON scope with its keys in name order, for grouping."""
    parsed = F.from_json(as_column(scope), "map<string,string>")
    ordered = F.array_sort(F.map_entries(parsed))
    return F.to_json(F.map_from_entries(ordered))


def stage_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("model_scope_key", canonical_scope("model_scope_json"))


def stage_outputs(outputs: DataFrame) -> DataFrame:
    """Forecast outputs; rows from before the flag existed count as unenforced."""
    return outputs.withColumn(
        "contract_enforced", F.coalesce(F.col("contract_enforced"), F.lit(False))
    )
