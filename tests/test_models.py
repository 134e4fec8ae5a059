"""Model queries run at the full size of their operators."""

from __future__ import annotations

import datetime as dt
from collections import namedtuple

import numpy as np
import pytest
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foresail.operators import models as ml
from foresail.plans import model_queries as mq
from foresail.plans.registry import Source
from foresail.streaming import events as se

SF = "/root/testdata/sf0.001"


def test_model_queries_use_full_models(spark, monkeypatch):
    """The estimators each query asks for; a linear fit stands in so that the test is short."""
    fit, asked, searches = ml._fit, [], []

    def light(estimator, df, features, label):
        asked.append((estimator, label, df))
        return fit(LinearRegression(maxIter=1), df, features, label)

    def search(train, held, features, label, space, n, *rest, **more):
        searches.append((space, n))
        return train.sparkSession.createDataFrame([], ml.TRIAL_LEDGER)

    monkeypatch.setattr(ml, "_fit", light)
    monkeypatch.setattr(ml, "successive_halving", search)
    monkeypatch.setattr(mq, "_written", {})
    fits = {
        "ml1_gbt_before_cutoff": 1, "ml2_gbt_holdout": 1, "ml3_random_forest_holdout": 1, "ml4_direct_horizons": 7,
        "ml6_batch_score": 0, "bt14_score_model": 4, "bt20_walk_forward": 3, "ml13_trial_search": 0,
    }
    for name, count in fits.items():
        asked.clear()
        out = entry.queries()[name](spark, SF)
        assert len(asked) == count, name  # ml6 scores with the models of ml4
        for estimator, _, _ in asked:
            if name.startswith("ml3"):
                assert isinstance(estimator, RandomForestRegressor)
                assert (estimator.getNumTrees(), estimator.getMaxDepth()) == (200, 12)
            else:
                assert isinstance(estimator, GBTRegressor), name
                assert (estimator.getMaxIter(), estimator.getMaxDepth()) == (100, 5)
        if count == 7:
            assert sorted(label for _, label, _ in asked) == [f"sales_n{h}d" for h in range(1, 8)]
            assert {r[0] for r in out.select("forecast_horizon").distinct().collect()} == set(range(1, 8))
        if name == "bt20_walk_forward":
            latest = sorted(df.agg({"date": "max"}).first()[0] for _, _, df in asked)
            end = Source(spark, SF).train_end
            # the labels of the last rows learned from lie a day before each anchor
            assert latest == [end - dt.timedelta(days=d + 8) for d in (14, 7, 0)]
    assert len(searches) == 2 and searches[0] == searches[1]  # started twice on one ledger
    space, n = searches[0]
    assert n == 27 and space["maxDepth"] == (2, 8)


def panel(spark, days=120, stores=3):
    rng = np.random.default_rng(2)
    start = dt.date(2001, 1, 1)
    rows = [
        (k, start + dt.timedelta(days=d), float(v), float(v + rng.normal()))
        for k in range(stores)
        for d, v in enumerate(rng.integers(0, 50, days))
        if d % 11 or k
    ]
    return spark.createDataFrame(rows, "store_nbr long, date date, y double, x double")


def test_targets_lie_whole_days_ahead(spark):
    """Store 0 has gaps: the label of a day is the value of that very day or nothing."""
    df = panel(spark)
    value = {(r.store_nbr, r.date): r.y for r in df.collect()}
    for r in ml.direct_targets(df, ["store_nbr"], "date", "y", [1, 7]).collect():
        for h in (1, 7):
            assert r[f"y_n{h}d"] == value.get((r.store_nbr, r.date + dt.timedelta(days=h)))


def test_nothing_known_later_is_learned_from(spark, monkeypatch):
    """A wild value on the anchor and after it changes no forecast of that anchor."""
    df = panel(spark)
    anchor = dt.date(2001, 3, 20)
    wild = df.withColumn("y", F.when(F.col("date") >= F.lit(anchor), F.lit(1e6)).otherwise(F.col("y")))
    out = []
    for frame in (df, wild):
        ahead = ml.direct_targets(frame, ["store_nbr"], "date", "y", [7])
        for forward in (
            lambda a, f: ml.walk_forward(a, anchor, anchor, 7, 60, ["x"], "y_n7d", ml.train_linear, horizon=7),
            lambda a, f: ml.walk_forward_linear(a, anchor, anchor, 7, 60, ["x"], "y_n7d", horizon=7),
        ):
            out.append({r.store_nbr: r.prediction for r in forward(ahead, frame).collect()})
    for other in out[1:]:
        assert out[0].keys() == other.keys() and len(other) == 3
        assert all(abs(out[0][k] - other[k]) < 1e-6 for k in other)


def test_one_pass_least_squares_is_least_squares(spark):
    df = ml.direct_targets(panel(spark), ["store_nbr"], "date", "y", [3]).withColumn("z", F.sin("x"))
    first, last = dt.date(2001, 3, 1), dt.date(2001, 4, 1)
    got = ml.walk_forward_linear(df, first, last, 10, 45, ["x", "z"], "y_n3d", horizon=3).toPandas()
    rows = df.toPandas()
    assert len(got) and set(got.as_of) == {dt.date(2001, 3, d) for d in (1, 11, 21, 31)}
    for anchor, part in got.groupby("as_of"):
        known = (rows.date > anchor - dt.timedelta(days=45)) & (rows.date < anchor - dt.timedelta(days=3))
        train = rows[known].dropna()
        design = np.column_stack([np.ones(len(train)), train.x, train.z])
        coef = np.linalg.lstsq(design, train.y_n3d, rcond=None)[0]
        now = rows[rows.date == anchor].set_index("store_nbr")
        for r in part.itertuples():
            x = now.loc[r.store_nbr]
            assert abs(coef @ [1, x.x, x.z] - r.prediction) < 1e-8


@pytest.mark.parametrize("trainer,params", [
    (ml.train_gbt, {"maxIter": 4, "maxDepth": 3}),
    (ml.train_rf, {"numTrees": 5, "maxDepth": 4}),
    (ml.train_linear, {}),
])
def test_attributions_add_up(spark, trainer, params):
    df = panel(spark).withColumn("w", (F.dayofweek("date") * 2).cast("double"))
    df = df.withColumn("x", F.when(F.col("x") < 48, F.col("x")))
    model = trainer(df, ["x", "w"], "y", params)
    rows = ml.top_k_attributions(model, df, ["x", "w"], 2, ["store_nbr", "date", "x", "w", "y"]).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.x is None:
            assert r.predicted_value is None and r.top_feature_attributions is None
            continue
        parts = [t.attribution for t in r.top_feature_attributions]
        assert abs(r.base_value + sum(parts) - r.predicted_value) < 1e-9
        assert abs(parts[0]) >= abs(parts[1])
    one = ml.top_k_attributions(model, df, ["x", "w"], 1, ["x"]).where("x is not null").first()
    assert len(one.top_feature_attributions) == 1


def test_a_move_belongs_to_the_split_feature():
    """One tree by hand: mean 10 splits on feature 1 to 4 and 16, the right one on 0."""
    node = namedtuple("node", "tree node mean left right feature")
    nodes = [node(0, 0, 10.0, 1, 2, 1), node(0, 1, 4.0, -1, -1, -1), node(0, 2, 16.0, 3, 4, 0),
             node(0, 3, 15.0, -1, -1, -1), node(0, 4, 20.0, -1, -1, -1)]
    base, first, moves = ml.leaf_moves(nodes, [0.5], 2)
    assert (base, first) == (5.0, [0])
    assert moves == [[0.0, -3.0], [-0.5, 3.0], [2.0, 3.0]]


def test_a_broken_search_takes_up_where_it_ended(spark, tmp_path):
    df = panel(spark)
    train, held = df.where("date < '2001-04-01'"), df.where("date >= '2001-04-01'")
    calls = []

    def trainer(rows, features, label, params):
        calls.append(params)
        if broken and len(calls) > 5:
            raise RuntimeError("lost")
        return ml.train_gbt(rows, features, label, params)

    def search():
        return ml.successive_halving(
            train, held, ["x"], "y", {"maxDepth": (1, 3), "stepSize": (0.05, 0.5)}, 6, 1, "c", "r",
            dt.datetime(2001, 5, 1), str(tmp_path / "ledger"), budgets=(1, 2, 3), eta=2, trainer=trainer, parallelism=1,
        )

    broken = True
    with pytest.raises(RuntimeError):
        search()
    broken = False
    ledger = search().toPandas()
    assert len(calls) == 6 + 5  # five fits were kept, the failed one and the rest were done again
    assert sorted(ledger.groupby("rung").size().items()) == [(0, 6), (1, 3), (2, 1)]
    assert not ledger.duplicated(["trial_number", "rung"]).any()
    for rung in (0, 1):
        own = ledger[ledger.rung == rung].sort_values(["objective_value", "trial_number"])
        assert set(own.trial_number[: len(own) // 2]) == set(ledger[ledger.rung == rung + 1].trial_number)
    best = ml.best_trial(ml.last_rung(search())).first()
    assert best.best_trial_number == ledger[ledger.rung == 2].trial_number.item()
    assert len(calls) == 11


def test_stream_reads_each_part_as_a_whole(spark, monkeypatch):
    """One run per part over all of its files, none held to one file a batch."""
    run, batches = se.stream_insert_once, []

    def counted(*args):
        out = run(*args)
        out.awaitTermination()
        batches.append(len([p for p in out.recentProgress if p["numInputRows"]]))
        return out

    monkeypatch.setattr(se, "stream_insert_once", counted)
    got = entry.queries()["ss1_stream_insert_once"](spark, SF)
    assert batches == [1, 1, 1]
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_trees_on_cells_are_trees_on_rows(spark):
    """Whole samples: the fit on cells predicts what a fit on all binned rows does."""
    df = panel(spark).withColumn("label", F.col("y"))
    edges = ml.bin_edges(df, ["x"], 8)
    assert len(edges[0]) <= 9
    binned = Bucketizer(splits=edges[0], inputCol="x", outputCol="_bin_x").transform(df)
    few = ml.cells(binned, ["_bin_x"]).collect()
    assert len(few) < df.count()
    for power in (0, 1, 2):
        total = df.agg(F.sum(F.pow("y", F.lit(power)))).first()[0]
        assert sum(r._weight * r.label**power for r in few) == pytest.approx(total)
    tree = GBTRegressor(maxIter=4, maxDepth=3, maxBins=8, seed=1)
    got = ml._fit(tree, df, ["x"], "y").transform(df)
    plain = VectorAssembler(inputCols=["_bin_x"], outputCol="features")
    want = tree.fit(plain.transform(binned)).transform(plain.transform(df.join(binned, df.columns)))
    both = got.select("store_nbr", "date", "prediction").join(
        want.select("store_nbr", "date", F.col("prediction").alias("w")), ["store_nbr", "date"]
    ).toPandas()
    assert len(both) == df.count() and np.allclose(both.prediction, both.w)


def test_models_are_applied_once_to_each_cell(spark):
    """Direct horizons read the rows once, and predict what the models do row by row."""
    odd = spark.createDataFrame([(9, dt.date(2001, 1, 1), 1.0, v) for v in (None, float("nan"), -1e9)], "store_nbr long, date date, y double, x double")
    df = panel(spark).unionByName(odd).withColumn("z", F.dayofweek("date").cast("double"))
    ahead = ml.direct_targets(df, ["store_nbr"], "date", "y", [1, 2, 3]).localCheckpoint()
    fits = ml.train_direct(ahead, {h: f"y_n{h}d" for h in (1, 2, 3)}, ["x", "z"], {"maxIter": 3, "subsamplingRate": 1.0})
    named = {f"p{h}": m for h, m in fits.items()}
    got = ml.with_predictions(named, ahead)
    for name, model in named.items():
        rows = model.transform(got).select(name, "prediction").collect()
        assert len(rows) == df.count() and all(abs(r[0] - r[1]) < 1e-12 for r in rows)
    scored = ml.score(fits, ahead, ["store_nbr", "date", "x"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1, plan
    assert scored.count() == 3 * df.count() and scored.columns[-2:] == ["forecast_horizon", "prediction"]
    assert scored.filter("x is null and prediction is not null").isEmpty()


def test_fits_of_a_search_and_of_horizons_share_bins_and_cells(spark, monkeypatch, tmp_path):
    """The rows are binned and summed once, not for every fit, and the trees stay the same."""
    found, calls = ml.bin_edges, []
    monkeypatch.setattr(ml, "bin_edges", lambda *a: calls.append(a) or found(*a))
    df = ml.direct_targets(panel(spark), ["store_nbr"], "date", "y", [1, 2]).localCheckpoint()
    train, held = df.where("date < '2001-04-01'"), df.where("date >= '2001-04-01'")
    space = {"maxDepth": (1, 3), "stepSize": (0.05, 0.5), "subsamplingRate": [1.0]}
    ledger = ml.successive_halving(
        train, held, ["x"], "y", space, 4, 1, "c", "r", dt.datetime(2001, 5, 1), str(tmp_path / "l"), budgets=(1, 2), eta=2
    ).collect()
    assert len(ledger) == 6 and len(calls) == 1
    trials = ml.sample_trials(space, 4, 1)
    for r in ledger[:3]:
        model = ml.train_gbt(train, ["x"], "y", {**trials[r.trial_number], "maxIter": r.budget})
        alone = model.transform(held).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
        assert r.objective_value == pytest.approx(alone, abs=1e-9)
    # labels of two horizons end on different days, so their watched dates differ
    labels, params = {1: "y_n1d", 2: "y_n2d"}, {"maxIter": 3, "subsamplingRate": 1.0}
    calls.clear()
    together = ml.train_direct(df, labels, ["x"], params, ml.train_gbt_early)
    assert len(calls) == 1 and not ml._shared
    edges = calls[0]
    for h, label in labels.items():
        with monkeypatch.context() as m:
            m.setattr(ml, "bin_edges", lambda *a: found(*edges))
            alone = ml.train_gbt_early(df, ["x"], label, params)
        both = ml.with_predictions({"a": together[h], "b": alone}, df).select("a", "b").toPandas()
        assert np.allclose(both.a, both.b)


def test_a_population_counts_each_key_once(spark):
    day = dt.date(1969, 12, 30)
    rows = [(1, day + dt.timedelta(days=d), 1, 1.0) for d in (0, 1, 2, 70, 70)]
    rows += [(2, day, 1, None), (2, day, 2, float("nan")), (None, day, 2, 1.0), (3, None, 2, 1.0)]
    df = spark.createDataFrame(rows, "store_nbr long, date date, h int, prediction double")
    got = mq.population(df, ["store_nbr", "date"], ["h"])
    want = df.groupBy("h").agg(
        F.count(F.lit(1)), F.count_distinct("store_nbr", "date"),
        F.count_if(F.col("prediction").isNull() | F.isnan("prediction")), F.min("date"), F.max("date"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert mq.population(df, ["store_nbr", "date"]).first()[:3] == (9, 5, 2)
    assert mq.population(df.limit(0), ["store_nbr", "date"]).first()[:3] == (0, 0, 0)
    # days are combined before the shuffle, so no exchange carries a date as a key
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "date#" in line]


def test_a_forest_learns_from_one_point_a_part_of_a_cell(spark, monkeypatch):
    """Labels differ inside cells; the points keep their counts and sums, and rows their nodes."""
    seen, asked = [], []
    monkeypatch.setattr(ml, "stored", lambda df: seen.append(df.localCheckpoint()) or seen[-1])
    fit = ml._fit
    monkeypatch.setattr(ml, "_fit", lambda estimator, *rest: asked.append(estimator) or fit(estimator, *rest))
    df = panel(spark, 200, 40).withColumn("w", (F.dayofyear("date") % 2).cast("double"))
    ml.train_rf(df, ["w"], "y", {"numTrees": 3, "maxDepth": 3})
    points = seen[0].collect()
    assert len(points) <= 2 * ml.CELL_PARTS and asked[0].getCacheNodeIds()
    want = df.agg(F.count("y"), F.sum("y")).first()
    assert sum(p._weight for p in points) == want[0]
    assert sum(p._weight * p.label for p in points) == pytest.approx(want[1])
