"""Rolling windows, calendar, splits and point-in-time checks."""

from __future__ import annotations

import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from foresail.functions.calendar import calendar_parts
from foresail.operators import features as fe
from foresail.operators import splits as sp

FIRST = dt.date(2015, 12, 20)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    rows = []
    for store, length in ((1, 420), (2, 45), (3, 1)):
        for i in range(length):
            if rng.random() < 0.9 or length == 1:
                value = None if rng.random() < 0.05 and length > 1 else float(rng.choice([0, 0, rng.randint(0, 50)]))
                rows.append((store, FIRST + dt.timedelta(days=i), value))
    return rows, spark.createDataFrame(rows, "store_nbr int, date date, m double")


def by_store(rows):
    out = {}
    for store, day, value in sorted(rows):
        out.setdefault(store, []).append((day, value))
    return out


def test_long_windows_equal_plain_slices(spark, series):
    rows, df = series
    keys = ["store_nbr"]
    out = fe.last_stddev(fe.last_avg(fe.last_sum(df, keys, "date", "m"), keys, "date", "m"), keys, "date", "m")
    out = fe.lead_rows(fe.prior_sum(out, keys, "date", "m"), keys, "date", "m", (1, 7, 14, 28, 30, 60, 90))
    got = {(r.store_nbr, r.date): r for r in out.collect()}
    assert not [c for c in out.columns if c.startswith("_")]

    def total(values):
        known = [v for v in values if v is not None]
        return sum(known) if known else None

    for store, points in by_store(rows).items():
        values = [v for _, v in points]
        for i, (day, _) in enumerate(points):
            r = got[store, day]
            for n in fe.SUM_DAYS:
                assert r[f"m_l{n}d"] == total(values[max(0, i - n + 1) : i + 1])
                hi, lo = i - n, i - 2 * n + 1
                assert r[f"m_p{n}d"] == (total(values[max(0, lo) : hi + 1]) if hi >= 0 else None)
            for n in (1, 7, 14, 28, 30, 60, 90):
                assert r[f"m_n{n}d"] == total(values[i + 1 : i + 1 + n])
            for n in fe.AVG_DAYS:
                known = [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]
                mean, spread = r[f"avg_m_l{n}d"], r[f"stddev_m_l{n}d"]
                assert mean == (pytest.approx(sum(known) / len(known)) if known else None)
                assert spread == (pytest.approx(statistics.stdev(known), abs=1e-9) if len(known) > 1 else None)


def test_constant_series_has_no_spread(spark):
    rows = [(1, FIRST + dt.timedelta(days=i), 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, date date, m double")
    worst = fe.last_stddev(df, ["k"], "date", "m").agg(F.max("stddev_m_l360d")).first()[0]
    assert worst < 1e-12


def test_calendar_leads_see_gaps(spark):
    days = [dt.date(2020, 1, d) for d in (1, 2, 4)]
    df = spark.createDataFrame([(1, d, float(d.day)) for d in days], "k int, date date, m double")
    got = {r.date.day: r.m_n1d for r in fe.lead_exact(df, ["k"], "date", "m", [1]).collect()}
    assert got == {1: 2.0, 2: None, 4: None}
    assert {r.date.day: r.m_n1d for r in fe.lead_rows(df, ["k"], "date", "m", [1]).collect()}[2] == 4.0


def test_feature_table_plans_one_exchange_and_two_sorts(spark, series):
    _, df = series
    spec = fe.FeatureSpec("m", ("store_nbr",))
    plan = fe.rolling_features(df, spec)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 2


def test_sunday_weeks_and_iso_years(spark):
    df = spark.createDataFrame([(dt.date(2016, 1, 1),), (dt.date(2017, 1, 1),)], "date date")
    a, b = calendar_parts(df).orderBy("date").collect()
    assert (a.iso_week_of_year, a.iso_year, a.iso_week, a.day_of_week, a.day_name) == (0, 2015, 53, 6, "Friday")
    assert (b.iso_week_of_year, b.day_of_week, b.month_name) == (1, 1, "January")


def test_daily_counts_of_a_mixed_day(spark):
    rows = [
        (1, 1, "A", 2.0, 1), (1, 1, "A", 3.0, 0), (1, 2, "A", 4.0, 0), (1, 3, "B", 5.0, 0),
    ]
    fact = spark.createDataFrame(rows, "store_nbr int, product_id int, product_family string, sales double, on_promotion int")
    fact = fact.withColumns({"date": F.lit(FIRST), "data_split_source": F.lit("train")})
    r = fe.daily_agg(fact, "store").first()
    assert (r.sales_store, r.products_store, r.product_families_store) == (14, 3, 2)
    assert (r.sales_store_on_promotion, r.products_store_on_promotion, r.product_families_store_on_promotion) == (2, 1, 1)


def test_chronological_split_sizes(spark):
    rows = [(i % 7, FIRST + dt.timedelta(days=i // 7)) for i in range(70)]
    df = spark.createDataFrame(rows, "k int, date date")
    train, held = sp.chrono_split(df, 0.25, "date", ["k"])
    assert (train.count(), held.count()) == (52, 18)
    assert train.agg(F.max("date")).first()[0] <= held.agg(F.min("date")).first()[0]
    train, held = sp.chrono_split(df, 0.2, "date", purge_days=3)
    gap = held.agg(F.min("date")).first()[0] - train.agg(F.max("date")).first()[0]
    assert gap.days == 4
    with pytest.raises(ValueError, match="invalid split"):
        sp.chrono_split(df, 0.0, "date", ["k"])


def test_feature_registry():
    assert sp.match_rule("day_of_week").availability == "static_master_data"
    assert sp.match_rule("avg_sales_store_l7d").availability == "observed_lagged"
    sp.validate_features(["sales_store_l1d", "avg_sales_store_dow_l14d", "month"])
    with pytest.raises(ValueError, match="after the period"):
        sp.validate_features(["sales_store_n7d"])
    with pytest.raises(ValueError, match="unregistered"):
        sp.validate_features(["weather"])


def test_every_built_feature_declares_when_it_is_known(spark):
    fact = spark.createDataFrame(
        [(FIRST, 1, 1, "f", "train", 1.0, 1)],
        "date date, store_nbr int, product_id int, product_family string, data_split_source string, sales double, on_promotion int",
    )
    labels = {"date", "store_nbr", "product_id", "product_family", "data_split_source", "day_name", "month_name"}
    for grain in fe.SPECS:
        built = set(fe.feature_table(fact, grain).columns) - labels
        assert built <= set(fe.declared_features())


def test_cutoffs_reject_late_sources(spark):
    rows = [(dt.date(2020, 1, 2), dt.datetime(2020, 1, 1)), (dt.date(2020, 1, 3), dt.datetime(2020, 1, 2))]
    df = spark.createDataFrame(rows, "date date, promotion_plan_updated_at timestamp")
    got = sp.check_cutoffs(df, ["promotion"], F.col("date"), date="date")
    assert got["promotion_plan_updated_at"] == dt.datetime(2020, 1, 2)
    with pytest.raises(ValueError, match="later than the cutoff"):
        sp.check_cutoffs(df, ["promotion"], F.lit("2020-01-01"))


def test_feature_matrix_drops_empty_columns_and_incomplete_rows(spark):
    rows = [(1.0, 2.0, None, "a b"), (2.0, None, None, "c"), (None, 1.0, None, "c"), (3.0, 4.0, None, "c")]
    df = spark.createDataFrame(rows, "y double, x double, gone double, kind string")
    matrix, features = sp.feature_matrix(df, "y", categorical=["kind"])
    assert features == ["x", "kind_a_b", "kind_c"]
    assert sorted((r.y, r.kind_a_b, r.kind_c) for r in matrix.collect()) == [(1.0, 1, 0), (3.0, 0, 1)]


def test_whole_series_wait_for_the_batch_they_end_in():
    import pyarrow as pa

    from foresail.operators.rolling import whole_series

    ids = [None, None, 1, 1, 1, 1, 1, 2, 3, 3]
    for size in (1, 2, 3, 10):
        table = pa.table({"k": pa.array(ids), "i": list(range(10))})
        got = list(whole_series(iter(table.to_batches(max_chunksize=size)), ["k"]))
        assert [i for t, _ in got for i in t["i"].to_pylist()] == list(range(10))
        assert not set(got[0][0]["k"].to_pylist()) & {k for t, _ in got[1:] for k in t["k"].to_pylist()}
        runs = [(t["k"].to_pylist()[j], int(n)) for t, number in got for j, n in enumerate(number)]
        assert len(set(zip([r[0] for r in runs], [r[1] for r in runs], strict=True))) == 4


def test_feature_table_needs_no_window_and_equals_the_windows(spark, series):
    """One pass over sorted series; a Window re-copies every row for each step (failed before)."""
    _, df = series
    spec = fe.FeatureSpec("m", ("store_nbr",), exact_leads=(1, 7), exact_lead_sum=7, lead_rows=(14, 28, 60, 90))
    table = fe.rolling_features(df, spec)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
    keys = ["store_nbr"]
    plain = fe.lead_rows(fe.lead_exact(df, keys, "date", "m", (1,)), keys, "date", "m", (14, 28, 60, 90))
    plain = fe.prior_sum(fe.last_stddev(fe.last_avg(fe.last_sum(plain, keys, "date", "m"), keys, "date", "m"), keys, "date", "m"), keys, "date", "m")
    plain = fe.dow_avg(calendar_parts(plain), keys, "date", "m")
    columns = sorted(c for c in plain.columns if c.startswith(("m_", "avg_", "stddev_")))
    assert set(columns) <= set(table.columns)
    left = table.orderBy("store_nbr", "date").select(*columns).collect()
    right = plain.orderBy("store_nbr", "date").select(*columns).collect()
    for a, b in zip(left, right, strict=True):
        for c in columns:
            assert a[c] == (None if b[c] is None else pytest.approx(b[c], abs=1e-9)), c
    cum = {(r.store_nbr, r.date): r for r in table.collect()}
    for (store, day), r in cum.items():
        near = [cum.get((store, day + dt.timedelta(days=k))) for k in range(1, 8)]
        near = [x.m for x in near if x is not None and x.m is not None]
        assert r.m_n7d_cum == (sum(near) if near else None)


def test_quick_rounding_is_exact(spark):
    from foresail.plans.registry import rounded

    rng = random.Random(3)
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, -2.5e-6, 1e300, -1e13, 2.0**40, 1 / 3, float("nan"), float("inf"), None]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 14) for _ in range(4000)]
    values += [round(rng.uniform(-100, 100), 7) for _ in range(4000)] + [k / 2e6 for k in range(-500, 500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (3, 4, 6, 9):
        wrong = df.filter(~(rounded(F.col("x"), places) + 0.0).eqNullSafe(F.round("x", places) + 0.0))
        assert wrong.count() == 0


def test_entity_split_places_rows_once(spark):
    rows = [(k, FIRST + dt.timedelta(days=i), float(i)) for k, n in ((1, 10), (2, 5), (3, 1)) for i in range(n)]
    train, held = sp.entity_split(spark.createDataFrame(rows, "k int, date date, m double"), ["k"], "date", 0.2)
    both = train.unionByName(held)
    assert "Window" not in both._jdf.queryExecution().optimizedPlan().toString()
    assert (train.count(), held.count(), train.columns) == (12, 3, ["k", "date", "m"])
    assert sorted((r.k, r.m) for r in held.collect()) == [(1, 8.0), (1, 9.0), (2, 4.0)]
