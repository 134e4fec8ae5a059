"""Ledger guards, writers, lifecycle and monitoring marts."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foresail.operators import demand as de
from foresail.operators import ledger as le
from foresail.operators import lifecycle as lc
from foresail.operators import models as ml
from foresail.operators import monitoring as mo
from foresail.operators import readmodels as rm
from foresail.sources import tables, writers

AT = F.lit(dt.datetime(2024, 1, 2))


def outputs(spark, n=3):
    rows = [(f"o{i}", "r", float(i), "draft") for i in range(n)]
    return spark.createDataFrame(
        rows, "forecast_output_id string, forecast_run_id string, prediction_p50 double, forecast_status string"
    )


def test_insert_once_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    more = spark.createDataFrame([("b", 2), ("c", 3)], "id string, v int")
    assert writers.insert_once(df, path, "id") == 2
    assert writers.insert_once(df, path, "id") == 0
    assert writers.insert_once(more, path, "id") == 1
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="one row per"):
        writers.insert_once(df.union(df), path, "id")
    with pytest.raises(ValueError, match="null"):
        writers.insert_once(spark.createDataFrame([(None, 1)], df.schema), path, "id")
    assert spark.read.parquet(path).count() == 3


def test_upsert_keeps_fields_a_batch_leaves_out(spark, tmp_path):
    path = str(tmp_path / "rows")
    writers.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, v int, t string"), path, "id")
    writers.upsert(spark.createDataFrame([("a", 9, None), ("c", 3, "z")], "id string, v int, t string"), path, "id")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 9, "x"), ("b", 2, "y"), ("c", 3, "z")]
    writers.upsert(spark.createDataFrame([("a", 0, "q")], "id string, v int, t string"), path, "id", update_matched=False)
    assert spark.read.parquet(path).filter("id = 'a'").first().v == 9


def test_merge_replace_clears_the_named_partition(spark, tmp_path):
    path = str(tmp_path / "daily")
    old = spark.createDataFrame([(1, "d1", 1), (2, "d1", 1), (3, "d2", 1)], "k int, day string, v int")
    writers.merge_replace(old, path, ["k"], "day")
    writers.merge_replace(spark.createDataFrame([(1, "d1", 7)], "k int, day string, v int"), path, ["k"], "day", clear=["d1"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 7), (3, 1)]


def test_csv_folder_loads_known_tables(spark, tmp_path):
    (tmp_path / "oil.csv").write_text("date,dcoilwtico\n2017-01-01,\n2017-01-02,NaN\n2017-01-03,52.5\n")
    (tmp_path / "notes.csv").write_text("a\n1\n")
    made = tables.load_csv_tables(spark, str(tmp_path), str(tmp_path / "out"))
    assert list(made) == ["oil"]
    assert [r.dcoilwtico for r in spark.read.parquet(made["oil"]).orderBy("date").collect()] == [None, None, 52.5]


def test_eligibility_reasons(spark):
    rows = [(1, d, True, True, d == 3) for d in (1, 2, 3)] + [(2, 1, False, True, False), (3, 1, True, False, False)]
    df = spark.createDataFrame(rows, "store_nbr int, d int, store_open boolean, product_active boolean, is_stockout boolean")
    demand = df.withColumns(
        {
            "date": F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("d")),
            "observed_sales_units": F.lit(1.0), "unconstrained_demand_units": F.lit(1.0),
            "assortment_active": F.lit(True), "has_inventory_data": F.lit(True), "promotion_planned": F.lit(False),
            "unit_price": F.lit(None).cast("double"), "data_split_source": F.lit("train"),
        }
    )
    got = de.eligibility(demand, 2, "exclude_stockout_days").orderBy("store_nbr", "date").collect()
    assert [r.ineligibility_reason for r in got] == [
        "insufficient_history", None, "stockout", "store_closed", "product_inactive",
    ]
    assert [r.observed_history_days for r in got][:3] == [1, 2, 3]


def test_snapshot_ignores_order_and_sees_changes(spark):
    rows = [(i, dt.date(2024, 1, 1), 7) for i in range(50)]
    df = spark.createDataFrame(rows, "store_nbr int, date date, forecast_horizon int")
    first = de.snapshot_id(df, ["store_nbr"])
    assert first == de.snapshot_id(df.orderBy(F.desc("store_nbr")).repartition(7), ["store_nbr"])
    assert first != de.snapshot_id(df.filter("store_nbr > 0"), ["store_nbr"])


def test_status_transitions(spark):
    rows = outputs(spark)
    assert le.status_events(rows, F.lit(None).cast("string"), AT, "me").count() == 3
    with pytest.raises(ValueError, match="invalid status"):
        le.status_events(rows, F.lit("published"), AT, "me")


def test_publication_needs_the_complete_approval_set(spark):
    rows = outputs(spark)
    approvals = le.approve(rows, None, "me", "k", "why", "ok", AT)
    made = le.publish(rows, approvals, 1, "w", "me", "k", AT)
    assert made.count() == 3 and made.select("publication_id").distinct().count() == 3
    with pytest.raises(ValueError, match="complete run"):
        le.publish(rows, approvals.filter("forecast_output_id <> 'o1'"), 1, "w", "me", "k", AT)
    with pytest.raises(ValueError, match="exceed"):
        le.rollback(made, 1, "me", "k2", "why", "ok", AT)
    _, again, lineage = le.rollback(made, 2, "me", "k2", "why", "ok", AT)
    assert {r.published_value for r in again.collect()} == {0.0, 1.0, 2.0}
    assert lineage.filter("revision_type = 'rollback'").count() == 3


def test_versions_are_monotonic_and_retry_safe(spark):
    have = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "publication_version int, idempotency_key string")
    assert le.check_version(have, 3, "c") == "new"
    assert le.check_version(have, 1, "a", 2) == "retry"
    for version, key, rows in ((1, "z", None), (1, "a", 5), (0, "n", None)):
        with pytest.raises(ValueError):
            le.check_version(have, version, key, rows)


def test_delivery_transitions(spark):
    keys = "forecast_run_id string, publication_version int, destination string"
    scopes = spark.createDataFrame([("r", 1, "w")], keys)
    events = spark.createDataFrame(
        [], keys + ", delivery_status string, delivery_attempt int, delivery_event_id string, occurred_at timestamp"
    )
    start = le.delivery_event(scopes, events, "start", "me", "k", AT)
    assert start.first().delivery_attempt == 1
    with pytest.raises(ValueError, match="invalid delivery"):
        le.delivery_event(scopes, events, "confirm", "me", "k", AT, reference="x")
    failed = le.delivery_event(scopes, start, "fail", "me", "k", AT + F.expr("interval 1 hour"), error_message="no")
    retry = le.delivery_event(scopes, start.unionByName(failed), "retry", "me", "k", AT)
    assert (retry.first().delivery_status, retry.first().delivery_attempt) == ("pending", 2)
    with pytest.raises(ValueError, match="reference"):
        le.delivery_event(scopes, start, "confirm", "me", "k", AT)


def test_drift_of_a_constant_shift(spark):
    rows = [(d, 10.0 if d < 2 else 30.0, f) for d, f in enumerate((5.0, 15.0, 9.0, 11.0))]
    df = spark.createDataFrame(rows, "d int, demand double, feature double").withColumn(
        "date", F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("d"))
    )
    wanted = [mo.DriftMetric("demand"), mo.DriftMetric("feature", "feature")]
    got = {r.metric_name: r for r in mo.data_drift(df, wanted, window=2, min_obs=2).collect()}
    assert (got["demand"].drift_status, got["demand"].is_alerting) == ("drifted", True)
    assert got["feature"].drift_status == "healthy"
    assert mo.data_drift(df, []).first().drift_status == "not_configured"


def test_completeness_of_the_latest_day(spark):
    rows = [(1, 1, 1.0), (2, 1, 1.0), (1, 2, None)]
    df = spark.createDataFrame(rows, "store int, d int, x double").withColumn(
        "date", F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("d"))
    )
    r = mo.feature_completeness(df, mo.CompletenessSpec("f", "store", ("x",))).first()
    assert (r.row_count, r.entity_count, r.previous_entity_count, r.is_alerting) == (1, 1, 2, True)
    assert mo.feature_completeness(df, None).first().feature_completeness_status == "not_configured"


def test_no_cost_events_gives_one_quiet_row(spark):
    events = spark.createDataFrame(
        [],
        "cost_event_id string, forecast_run_id string, forecast_contract_name string, model_run_id string, stage_name string, "
        "environment string, service_name string, amount_usd decimal(18,2), bytes_processed long, slot_ms long, "
        "usage_start_at timestamp",
    )
    runs = spark.createDataFrame([], "forecast_run_id string, forecast_contract_name string, started_at timestamp, row_count long")
    r = mo.pipeline_cost(runs, events).collect()
    assert [(x.cost_scope_key, x.cost_status, x.is_alerting) for x in r] == [("platform", "cost_data_unavailable", False)]


def test_daily_and_rolling_accuracy(spark):
    rows = [("c", 1, 100.0, 110.0), ("c", 1, 200.0, 180.0), ("c", 1, None, 1.0), ("c", None, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "config_name string, d int, actual double, prediction double").withColumns(
        {
            "model_family": F.lit("f"), "model_type": F.lit("t"), "model_run_id": F.lit("m"),
            "forecast_date": F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("d")),
        }
    )
    r = mo.accuracy_daily(df).first()
    assert (r.n_predictions, r.mae, r.wape, r.bias) == (2, 15.0, pytest.approx(0.1), -5.0)
    daily = spark.createDataFrame(
        [("c", "f", "t", "m", dt.date(2024, 1, d), 1, 1.0, w, 0.0) for d, w in ((1, 0.1), (2, 0.3))],
        "config_name string, model_family string, model_type string, model_run_id string, forecast_date date, "
        "n_predictions int, mae double, wape double, bias double",
    )
    perf = spark.createDataFrame([("m", "test", 1.0, 0.15)], "model_run_id string, metric_set string, mae double, wape double")
    rolled = mo.accuracy_rolling(daily, perf).orderBy("forecast_date").collect()
    assert [x.wape_7d for x in rolled] == pytest.approx([0.1, 0.2]) and rolled[1].train_test_wape == 0.15


def test_one_champion_per_grain(spark):
    rows = [("company", "a", 1.0), ("store", "b", 5.0), ("store", "c", 8.0)]
    board = spark.createDataFrame(rows, "grain string, config_name string, mae double").withColumns(
        {n: F.lit(v) for n, v in (("target", "t"), ("horizon", 1), ("segment_key_json", "{}"), ("metric_policy", "p"),
                                  ("platform", "x"), ("model_run_id", "m"), ("primary_metric", "mae"))}
        | {n: F.lit(None).cast("double") for n in ("wape", "mase", "rmsse")}
        | {"run_at": AT}
    )
    best = {r.grain: r.primary_metric_value for r in lc.champions(board).filter("is_champion").collect()}
    assert best == {"company": 1.0, "store": 5.0}


def test_bootstrap_is_deterministic_and_finds_a_clear_loss(spark):
    rows = [("ref", 1, o, 10.0) for o in range(8)] + [("bad", 2, o, 20.0 + o) for o in range(8)]
    df = spark.createDataFrame(rows, "experiment_run_id string, n int, forecast_origin int, wape double").withColumn(
        "run_created_at", F.make_timestamp(F.lit(2024), F.lit(1), F.col("n"), F.lit(0), F.lit(0), F.lit(0))
    )
    a = rm.paired_bootstrap(df, 200).collect()
    assert a == rm.paired_bootstrap(df.repartition(5), 200).collect()
    assert (a[0].conclusion, a[0].delta_wape_pp) == ("worse", 13.5)


def test_attributions_add_up_to_the_prediction(spark):
    rows = [(i, float(i % 5), float(i % 3), 2.0 * (i % 5) - (i % 3) + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a double, b double, y double")
    model = ml.train_linear(df, ["a", "b"], "y")
    for r in ml.top_k_attributions(model, df, ["a", "b"], 2, ["i"]).collect():
        assert r.base_value + sum(x.attribution for x in r.top_feature_attributions) == pytest.approx(r.predicted_value)
        sizes = [abs(x.attribution) for x in r.top_feature_attributions]
        assert sizes == sorted(sizes, reverse=True)


def test_series_models_tell_what_became_of_each_series(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7)) for i in range(80)] + [(2, dt.date(2024, 1, 1), 1.0)]
    rows += [(3, dt.date(2024, 1, 1) + dt.timedelta(days=i), float("inf")) for i in range(90)] + [(4, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, date date, y double")
    for fit in (ml.fit_series_seasonal, ml.fit_series_arma):
        fitted = fit(df, ["k"], "date", "y", 7)
        out = ml.series_forecasts(fitted).collect()
        assert {r.k for r in out} == {1}
        assert sum(r.part == "forward" for r in out) == 7
        assert all(r.prediction_lower <= r.prediction <= r.prediction_upper for r in out)
        told = {r.k: (r.status, r.n_obs) for r in ml.series_status(fitted, ["k"]).collect()}
        assert told == {1: ("fitted", 80), 2: ("short", 1), 3: ("failed", 90), 4: ("short", 0)}
    drift = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(60)], df.schema)
    ahead = ml.fit_series_arma(drift, ["k"], "date", "y", 3).filter("part = 'forward'").orderBy("forecast_horizon").collect()
    assert [r.prediction for r in ahead] == pytest.approx([60.0, 61.0, 62.0])


def test_series_of_one_length_are_fitted_side_by_side(spark):
    """A group and a call for each series is what made a million short series slow."""
    rng = np.random.default_rng(5)
    y = rng.poisson(4, (30, 60)).astype(float)
    y[0], y[1] = 3.0, np.arange(60.0)  # columns that depend on one another
    y[2, 7] = np.inf
    values, width, fitted = ml.arma_forecasts(y, 9)
    assert list(np.flatnonzero(~fitted)) == [2]
    for i in np.flatnonzero(fitted):
        alone = ml.arma_forecast(y[i], 9)
        assert values[i] == pytest.approx(alone[0]) and width[i] == pytest.approx(alone[1], abs=1e-9)
    days = pd.Series(pd.date_range("2024-01-01", periods=60))
    numbers = np.tile(ml._day_numbers(days), (30, 1))
    numbers[4] = numbers[4] * 2
    keep = [i for i in range(30) if i != 2]
    together = ml.fit_trends(numbers[keep], y[keep], 1, 0)
    assert together.fitted.all()
    alone = ml.fit_trend(days, y[5], 1, 0)
    assert together.coef[keep.index(5)] == pytest.approx(alone.coef) and together.sigma[keep.index(5)] == pytest.approx(alone.sigma)
    rows = [(i, d.date(), float(v)) for i in keep for d, v in zip(days, y[i], strict=True)] + [(None, dt.date(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "k int, date date, y double")
    for fit in (ml.fit_series_arma, ml.fit_series_seasonal):
        out = fit(df, ["k"], "date", "y", 7, min_obs=24)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        told = {r.k: (r.status, r.n_obs) for r in ml.series_status(out, ["k"]).collect()}
        assert told == {i: ("fitted", 60) for i in keep} | {None: ("short", 1)}
        held = ml.series_forecasts(out).filter("part = 'holdout' and k = 1").orderBy("forecast_horizon").collect()
        assert [(r.actual, r.forecast_horizon) for r in held] == [(48.0 + i, i + 1) for i in range(12)]
        assert {r.date for r in held} == {dt.date(2024, 2, 17)} and held[0].forecast_date == dt.date(2024, 2, 18)


def test_simulated_changes_add_a_slope_from_their_place_on():
    t, changes, runs = np.array([1.01, 1.1, 1.3, 1.5]), np.array([0.5, -2.0, 1.0]), 40
    rng = np.random.default_rng(9)
    counts = rng.poisson(0.5 * len(changes) / ml.CHANGE_SPAN, runs)
    most = int(counts.max())
    where = 1.0 + 0.5 * rng.random((runs, most))
    size = rng.laplace(0.0, np.abs(changes).mean(), (runs, most)) * (np.arange(most) < counts[:, None])
    plain = (size[:, :, None] * np.maximum(t - where[:, :, None], 0.0)).sum(1) + rng.normal(0.0, 0.3, (runs, 4))
    assert ml._deviations(t, changes, 0.3, runs, 9) == pytest.approx(plain, abs=1e-12)


def test_arma_learns_seasons_and_shocks():
    rng = np.random.default_rng(3)
    e = rng.normal(size=700)
    week = np.array([0.0, 5, 9, 3, -4, -8, 2])
    y = np.zeros(700)
    for t in range(1, 700):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.5 * e[t - 1]
    y = y + 50 + week[np.arange(700) % 7]
    errors, naive, inside = [], [], []
    for cut in range(560, 690, 10):
        values, width = ml.arma_forecast(y[:cut], 7)
        errors += list(np.abs(values - y[cut : cut + 7]))
        naive += list(np.abs(y[cut - 7 : cut] - y[cut : cut + 7]))
        inside += list(np.abs(values - y[cut : cut + 7]) <= width)
        assert (np.diff(width) >= -1e-9).all()
    assert np.mean(errors) < 0.85 * np.mean(naive)
    assert 0.65 <= np.mean(inside) <= 0.95
    assert ml.arma_forecast(y[:20], 7) is None


def test_trend_finds_planted_changes():
    days = pd.Series(pd.date_range("2020-01-01", periods=900))
    t = np.arange(900.0)
    level = 20 + 0.1 * t - 0.35 * np.maximum(t - 300, 0) + 0.5 * np.maximum(t - 600, 0)
    y = level + 4 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(0).normal(size=900)
    model = ml.fit_trend(days, y, yearly=0)  # a year's waves could stand in for the changes
    time = model.time(days)
    trend = ml._trend_design(time, model.at) @ model.coef[: 2 + len(model.at)]
    slope = np.diff(trend)
    assert slope[100:250].mean() == pytest.approx(0.1, abs=0.03)
    assert slope[350:550].mean() == pytest.approx(-0.25, abs=0.03)
    assert slope[700:].mean() == pytest.approx(0.25, abs=0.03)
    by_time = sorted(zip(np.abs(model.changes), model.at * model.span, strict=True), reverse=True)
    assert {round(at / 300) for _, at in by_time[:2]} == {1, 2}
    future = pd.Series(pd.date_range(days.iloc[-1] + pd.Timedelta(days=1), periods=60))
    spread = np.quantile(model.simulated(future, 400, 1), [0.1, 0.9], axis=0)
    assert (spread[1] - spread[0])[-10:].mean() > 1.2 * (spread[1] - spread[0])[:10].mean()
    assert (model.simulated(future, 5, 2) == model.simulated(future, 5, 2)).all()


@pytest.mark.parametrize("few", [0, 500_000])
def test_event_flags_do_not_shuffle_a_row_per_store_and_day(spark, few, monkeypatch):
    from foresail.operators import staging as st

    monkeypatch.setattr(st, "FEW_PAIR_DAYS", few)
    stores = spark.createDataFrame(
        [(1, "Quito", "Pichincha"), (2, "Quito", "Pichincha"), (3, None, "Guayas"), (4, None, None)],
        "store_nbr int, city string, state string",
    )
    d = [dt.date(2020, 1, i) for i in (1, 2, 3)]
    events = spark.createDataFrame(
        [
            (d[0], "National", "Holiday", "Ecuador", "a", False), (d[1], "Local", "Transfer", "Quito", "b", False),
            (d[1], "Regional", "Holiday", "Guayas", "c", False), (d[2], "Regional", "Holiday", "Pichincha", "d", False),
            (None, "Local", "Holiday", "Quito", "e", False), (d[2], "Local", "Additional", None, "f", False),
        ],
        "date date, locale string, type string, locale_name string, description string, transferred boolean",
    )
    flags = st.store_event_flags(stores, st.stage_events(events), match_col="locale_name")
    fired = {(r.store_nbr, r.date.day, f) for r in flags.collect() for f in st.EVENT_FLAGS if r[f]}
    national = next(f for f, kind in st.EVENT_FLAGS.items() if kind == ("National", "Holiday"))
    regional = next(f for f, kind in st.EVENT_FLAGS.items() if kind == ("Regional", "Holiday"))
    assert fired == {(i, 1, national) for i in (1, 2, 3, 4)} | {
        (1, 2, "is_local_transfer"), (2, 2, "is_local_transfer"), (3, 2, regional), (1, 3, regional), (2, 3, regional)
    }
    assert flags.count() == 12
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("inline(_days")[0].count("RepartitionByExpression") == 0  # nothing is dealt again after the lists
    assert "inline(_days" in plan


def test_a_page_without_a_delivered_version_is_empty(spark):
    rows = spark.createDataFrame([("r", 1, "warehouse", "p")], "forecast_run_id string, publication_version int, destination string, publication_id string")
    page = rm.published_page(rows, None, {"horizon": [1]}, 20)
    assert page.columns == rows.columns and page.isEmpty()
