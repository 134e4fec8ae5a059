"""Training, scoring, tuning and explanation with Spark ML; per-series models.

Regressors train on the distributed rows. Classical per-series models are fitted
with numpy inside ``applyInPandas``: a series is one row per day, so a group is
bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt
import json
import random
import uuid
import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from statistics import NormalDist
from threading import Lock, RLock
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresail.contracts import BacktestContract
from foresail.functions.expr import safe_divide, stable_id
from foresail.operators.backtest import entity_grid, origins, plan
from foresail.operators.features import lead_exact
from foresail.operators.metrics import holdout_metrics
from foresail.operators.rolling import whole_series
from foresail.operators.splits import chrono_split, validate_features
from foresail.session import stored, work_root
from foresail.sources.history import predict_slice, train_slice

# Default hyper-parameters.
GBT_DEFAULTS = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.8, "seed": 42}
RF_DEFAULTS = {"numTrees": 200, "maxDepth": 12, "seed": 42}


# Fixed value: parts that the rows of one cell are dealt over; a fit draws its samples from them.
CELL_PARTS = 32


def _fit(estimator, df: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Fit on the rows that have the label and every feature; scoring keeps all rows."""
    rows = df.dropna(subset=[label, *features]).withColumn("label", F.col(label).cast("double"))
    if isinstance(estimator, (GBTRegressor, RandomForestRegressor)):
        return _fit_cells(estimator, rows, features, label, _shared.get(df))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, estimator]).fit(rows)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Split points of each feature, half way between at most ``bins`` of its quantiles; a
    value that many rows share is one of them and leaves the others to the rest."""
    shares = [i / (10 * bins) for i in range(10 * bins + 1)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10000) for f in features]).first()
    out = []
    for values in found:
        points = sorted({v for v in values or [] if np.isfinite(v)})
        if len(points) > bins:
            points = [points[round(i * (len(points) - 1) / (bins - 1))] for i in range(bins)]
        middle = [(a + b) / 2 for a, b in zip(points, points[1:])] or points or [0.0]
        out.append([float("-inf"), *sorted(set(middle)), float("inf")])
    return out


def cells(rows: DataFrame, binned: Sequence[str], by: Sequence[str] = (), squares: bool = True) -> DataFrame:
    """Rows of equal bins as weighted points with the same count, sum and sum of squares of
    the label: all that squared error, and so every split and leaf of a tree, depends on.

    A cell's rows are dealt over parts by a hash of the whole row, so that samples of the
    parts are samples of the rows.
    """
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(CELL_PARTS))
    sums = rows.groupBy(*binned, *by, part.alias("_part")).agg(*_label_sums(F.col("label")))
    return _weighted(sums, [*binned, *by], squares=squares)


def _bucketizer(edges: Sequence[Sequence[float]], features: Sequence[str]) -> Bucketizer:
    return Bucketizer(
        splitsArray=edges, inputCols=list(features), outputCols=[f"_bin_{f}" for f in features], handleInvalid="keep"
    )


class SharedCells:
    """Bins and cells of one frame for the fits of several trials or labels, worked out once:
    the calendar of every label, the quantiles and the sums take a pass over the rows each."""

    def __init__(self, df: DataFrame, features: Sequence[str], labels: Sequence[str]):
        self.df, self.features, self.labels = df, list(features), list(dict.fromkeys(labels))
        self.late: Mapping[str, Column] = {}
        self._made: dict[tuple, object] = {}
        self._lock = RLock()

    def _once(self, key: tuple, make: Callable):
        with self._lock:
            if key not in self._made:
                self._made[key] = make()
            return self._made[key]

    def span(self, label: str, date: str) -> tuple:
        """First and last date with the label."""
        def spans():
            known = [F.when(F.col(c).isNotNull(), F.col(date)) for c in self.labels]
            return self.df.agg(*[f(c) for c in known for f in (F.min, F.max)]).first()

        found, at = self._once(("span", date), spans), 2 * self.labels.index(label)
        return found[at], found[at + 1]

    def _value(self, i: int) -> Column:
        value = F.col(self.labels[i]).cast("double")
        return F.when(~F.isnan(value), value)

    def edges(self, bins: int) -> list[list[float]]:
        def found():
            some = F.coalesce(*[self._value(i) for i in range(len(self.labels))]).isNotNull()
            return bin_edges(self.df.dropna(subset=self.features).filter(some), self.features, bins)

        return self._once(("edges", bins), found)

    def cells(self, label: str, bins: int, watched: bool) -> DataFrame:
        """``cells`` of the rows with ``label``, told apart by ``late`` where fits are watched."""
        names = [f"_bin_{f}" for f in self.features]

        def sums():
            binned = _bucketizer(self.edges(bins), self.features).transform(self.df.dropna(subset=self.features))
            part = F.pmod(F.xxhash64(*self.df.columns), F.lit(CELL_PARTS))
            # a flag a label: they only say on which side of a date a row lies, so groups stay few
            late = [self.late[c].alias(f"_late{i}") for i, c in enumerate(self.labels)] if watched else []
            totals = [c for i in range(len(self.labels)) for c in _label_sums(self._value(i), str(i))]
            return stored(binned.groupBy(*names, *late, part.alias("_part")).agg(*totals))

        def points():
            i = self.labels.index(label)
            by = [F.col(f"_late{i}").alias("_validate")] if watched else []
            few = self._once(("sums", bins, watched), sums)
            return stored(_weighted(few.filter(F.col(f"_n{i}") > 0), [*names, *by], str(i), squares=watched))

        return self._once(("points", label, bins, watched), points)


# Frames whose fits share bins and cells, for as long as the search or direct training runs.
_shared: WeakKeyDictionary[DataFrame, SharedCells] = WeakKeyDictionary()


def _label_sums(value: Column, name: str = "") -> list[Column]:
    return [
        F.count(value).cast("double").alias(f"_n{name}"), F.avg(value).alias(f"_mean{name}"),
        F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias(f"_off{name}"),
    ]


def _weighted(sums: DataFrame, kept: Sequence, name: str = "", squares: bool = True) -> DataFrame:
    """Points (label, _weight) with the count, sum and sum of squares of each row of ``sums``.

    Splits and leaves need no squares, as rows of a cell are never parted and their spread
    adds the same error to every tree; without them a cell is half as many points.
    """
    if not squares:
        return sums.select(*kept, F.col(f"_mean{name}").alias("label"), F.col(f"_n{name}").alias("_weight"))
    point = lambda label, weight: F.struct(label.alias("label"), weight.alias("_weight"))
    mean, off, n = F.col(f"_mean{name}"), F.col(f"_off{name}"), F.col(f"_n{name}")
    points = F.when(off == 0, F.array(point(mean, n))).otherwise(F.array(point(mean - off, n / 2), point(mean + off, n / 2)))
    return sums.select(*kept, F.explode(points).alias("_p")).select("*", "_p.*").drop("_p")


def _fit_cells(
    estimator, rows: DataFrame, features: Sequence[str], label: str, shared: SharedCells | None = None
) -> PipelineModel:
    """Trees on cells of binned features: one pass over the rows, then rounds over what is
    bounded by the bins and never more than the rows. Trees bin their features anyhow."""
    binned, bins = [f"_bin_{f}" for f in features], estimator.getMaxBins()
    watched = estimator.isDefined("validationIndicatorCol") if estimator.hasParam("validationIndicatorCol") else False
    if shared is not None and shared.features == list(features) and label in shared.labels:
        bucketizer = _bucketizer(shared.edges(bins), features)
        few = shared.cells(label, bins, watched)
    else:
        bucketizer = _bucketizer(bin_edges(rows, features, bins), features)
        by = [estimator.getValidationIndicatorCol()] if watched else []
        kept = list(dict.fromkeys([*rows.columns, *binned]))
        few = stored(cells(bucketizer.transform(rows).select(*kept), binned, by, squares=watched))
    assembler = VectorAssembler(inputCols=binned, outputCol="features", handleInvalid="keep")
    fitted = estimator.copy({estimator.weightCol: "_weight"}).fit(assembler.transform(few))
    return PipelineModel(stages=[bucketizer, assembler, fitted])


def train_gbt(df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None) -> PipelineModel:
    """Boosted trees over the rows with a label."""
    return _fit(GBTRegressor(**{**GBT_DEFAULTS, **(params or {})}), df, features, label)


def train_gbt_early(
    df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None, date: str = "date",
    share: float = 0.1,
) -> PipelineModel:
    """Boosted trees that stop once the latest ``share`` of the calendar no longer gains.

    Those dates are only validated on; the rounds of the defaults are the most there are.
    """
    shared = _shared.get(df)
    spans = {c: shared.span(c, date) for c in shared.labels} if shared else {}
    if label not in spans:
        spans = {label: df.filter(F.col(label).isNotNull()).agg(F.min(date), F.max(date)).first()}
    if spans[label][0] is None:
        raise ValueError("training needs labelled rows")

    def late(lo, hi) -> Column:
        if lo is None:
            return F.lit(False)
        return F.coalesce(F.col(date) > F.lit(hi - dt.timedelta(days=int((hi - lo).days * share))), F.lit(False))

    frame = df.withColumn("_validate", late(*spans[label]))
    if shared:
        shared.late = {c: late(*span) for c, span in spans.items()}
        _shared[frame] = shared
    watched = {"validationIndicatorCol": "_validate", "validationTol": 1e-3}
    return train_gbt(frame, features, label, {**watched, **(params or {})})


def train_rf(df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None) -> PipelineModel:
    # rows keep the nodes they are in: deep trees need not be walked down again at every level
    return _fit(RandomForestRegressor(cacheNodeIds=True, **{**RF_DEFAULTS, **(params or {})}), df, features, label)


def train_linear(df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None) -> PipelineModel:
    return _fit(LinearRegression(**(params or {})), df, features, label)


def train_before(df: DataFrame, features, label: str, cutoff: dt.date, params=None, hold: int = 7) -> PipelineModel:
    """Train on labelled rows older than ``hold`` days before the cutoff."""
    return train_gbt(df.filter(F.col("date") < F.lit(cutoff - dt.timedelta(days=hold))), features, label, params)


def train_with_holdout(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    trainer: Callable = train_gbt,
    params: Mapping | None = None,
    test: float = 0.2,
    purge_days: int = 0,
    date: str = "date",
    check: bool = True,
) -> tuple[PipelineModel, DataFrame]:
    """Point-in-time check, chronological split, fit and holdout metrics."""
    if check:
        validate_features(features)
    train, held = chrono_split(df, test, date, keys, purge_days)
    model = trainer(train, features, label, params)
    scored = with_predictions({"prediction": model}, held)
    return model, holdout_metrics(scored, label, "prediction").withColumn("metric_set", F.lit("test"))


def direct_targets(panel: DataFrame, keys: Sequence[str], date: str, y: str, horizons: Sequence[int]) -> DataFrame:
    """``panel`` with the value of ``y`` exactly h calendar days ahead, NULL at a gap."""
    return lead_exact(panel, keys, date, y, horizons)


def known_by(df: DataFrame, as_of: dt.date, horizon: int, date: str = "date") -> DataFrame:
    """Rows whose label, ``horizon`` days later, lies before ``as_of``."""
    return df.filter(F.date_add(F.col(date), horizon) < F.lit(as_of))


def train_direct(
    df: DataFrame, targets: Mapping[int, str], features: Sequence[str], params=None, trainer: Callable = train_gbt,
    parallelism: int = 4,
) -> dict[int, PipelineModel]:
    """One estimator per horizon over the same features, a few fitted side by side.

    Trees of all horizons are fitted on bins and cells that are worked out together; other
    estimators read ``df`` in every fit, so callers checkpoint or cache it.
    """
    if not targets:
        raise ValueError("direct training needs a target per horizon")
    run = lambda item: (item[0], trainer(df, features, item[1], params))
    _shared[df] = SharedCells(df, features, list(targets.values()))
    try:
        with ThreadPool(min(parallelism, len(targets))) as pool:
            return dict(pool.map(inheritable_thread_target(df.sparkSession)(run), sorted(targets.items())))
    finally:
        _shared.pop(df, None)


# Fixed value: how many cells are looked up by cell; models with more are applied to every row.
MOST_CELLS = 100_000


def few_cells(model: PipelineModel) -> bool:
    if not isinstance(model.stages[0], Bucketizer):
        return False
    return int(np.prod([float(len(edges)) for edges in model.stages[0].getSplitsArray()])) <= MOST_CELLS


def _in_cell(df: DataFrame, bucketizer: Bucketizer) -> DataFrame:
    """``df`` with the number of its cell, ``_cell``: the last two bins of a feature are those
    of NaN and of NULL."""
    cell, names = F.lit(0).cast("long"), bucketizer.getOutputCols()
    for name, edges in zip(names, bucketizer.getSplitsArray(), strict=True):
        cell = cell * (len(edges) + 1) + F.coalesce(F.col(name).cast("long"), F.lit(len(edges)))
    return bucketizer.transform(df).withColumn("_cell", cell).drop(*names)


def cell_predictions(models: Mapping[str, PipelineModel], spark: SparkSession) -> DataFrame:
    """_cell and a column for each model: what models on the same bins predict in every cell."""
    bucketizer = next(iter(models.values())).stages[0]
    sizes = [len(edges) + 1 for edges in bucketizer.getSplitsArray()]
    names = bucketizer.getOutputCols()
    table, stride = spark.range(int(np.prod(sizes)), numPartitions=8).withColumnRenamed("id", "_cell"), 1
    for name, size in reversed(list(zip(names, sizes, strict=True))):
        place = F.floor(F.col("_cell") / stride) % size
        table = table.withColumn(name, F.when(place < size - 1, place.cast("double")))
        stride *= size
    for name, model in models.items():
        scored = PipelineModel(stages=model.stages[1:]).transform(table)
        table = scored.select(*table.columns, F.col("prediction").alias(name))
    return stored(table.select("_cell", *models))


def with_predictions(models: Mapping[str, PipelineModel], df: DataFrame) -> DataFrame:
    """``df`` with a column of predictions for each model. Rows of equal bins take equal ways
    through all trees, so models on few cells are applied once to each cell."""
    out, by_bins = df, {}
    for name, model in models.items():
        if few_cells(model):
            first = model.stages[0]
            key = (tuple(first.getInputCols()), tuple(map(tuple, first.getSplitsArray())))
            by_bins.setdefault(key, {})[name] = model
        else:
            out = model.transform(out).select(*out.columns, F.col("prediction").alias(name))
    for some in by_bins.values():
        placed = _in_cell(out, next(iter(some.values())).stages[0])
        out = placed.join(F.broadcast(cell_predictions(some, df.sparkSession)), "_cell").select(*out.columns, *some)
    return out.select(*df.columns, *models)


def score(models: PipelineModel | Mapping[int, PipelineModel], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predictions of one model, or of every horizon's model in one relation.

    Every row comes back; one that lacks a feature has a NULL prediction.
    """

    named = models if isinstance(models, Mapping) else {0: models}
    scored = with_predictions({f"_prediction{h}": model for h, model in named.items()}, df)

    def prediction(horizon: int) -> Column:
        features = named[horizon].stages[0].getInputCols()
        whole = ~F.greatest(*[F.col(c).isNull() for c in features], F.lit(False))
        return F.when(whole, F.col(f"_prediction{horizon}")).alias("prediction")

    if not isinstance(models, Mapping):
        return scored.select(*keep, prediction(0))
    rows = [F.struct(F.lit(h).alias("forecast_horizon"), prediction(h)) for h in sorted(named)]
    return scored.select(*keep, F.inline(F.array(*rows)))


def incomplete_batches(pred: DataFrame, keys: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Entities with a missing, foreign or repeated horizon."""
    wanted = sorted(set(horizons))
    known = F.col("forecast_horizon").isin(wanted)
    return (
        pred.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct(F.when(known, F.col("forecast_horizon"))).alias("horizon_count"),
        )
        .filter((F.col("row_count") != len(wanted)) | (F.col("horizon_count") != len(wanted)))
    )


def check_horizon_batch(pred: DataFrame, keys: Sequence[str], horizons: Sequence[int]) -> None:
    if pred.isEmpty() or not incomplete_batches(pred, keys, horizons).isEmpty():
        raise ValueError("every entity must contain every configured horizon exactly once")


# The columns of the prediction ledger, in its order.
STANDARD_COLUMNS = (
    "prediction_id",
    "predict_run_id",
    "model_run_id",
    "model_id",
    "config_name",
    "model_family",
    "model_type",
    "run_at",
    "run_date",
    "target_column",
    "entity_id",
    "store_id",
    "product_id",
    "date",
    "forecast_date",
    "forecast_horizon",
    "actual",
    "prediction",
    "prediction_lower",
    "prediction_upper",
    "model_artifact_uri",
)


def prediction_rows(df: DataFrame, meta: Mapping[str, object], run_at: Column, keys: Sequence[str] = ("store_nbr",)) -> DataFrame:
    """Scored rows in the standard schema; absent columns are NULL.

    Store and entity ids fall back to the store number.
    """
    have = set(df.columns)

    def pick(name: str, kind: str, *others: Column) -> Column:
        options = ([F.col(name)] if name in have else []) + list(others)
        return F.coalesce(*[o.cast(kind) for o in options]) if options else F.lit(None).cast(kind)

    store = [F.col("store_nbr")] if "store_nbr" in have else []
    run = F.lit(meta["predict_run_id"])
    identity = {k: F.col(k).cast("string") for k in [*keys, "date"] if k in have}
    if "forecast_horizon" in have:
        identity["forecast_horizon"] = F.col("forecast_horizon").cast("string")
    fixed = {
        n: F.lit(meta.get(n)).cast("string")
        for n in ("model_run_id", "model_id", "config_name", "model_family", "model_type", "target_column", "model_artifact_uri")
    }
    columns = fixed | {
        "prediction_id": stable_id(identity | {"predict_run_id": run}),
        "predict_run_id": run,
        "run_at": run_at,
        "run_date": F.to_date(run_at),
        "entity_id": pick("entity_id", "string", *store),
        "store_id": pick("store_id", "long", *store),
        "product_id": pick("product_id", "long"),
        "date": pick("date", "date"),
        "forecast_date": pick("forecast_date", "date"),
        "forecast_horizon": pick("forecast_horizon", "int"),
        "actual": pick("actual", "double", *([F.col(meta["target_column"])] if meta.get("target_column") in have else [])),
        "prediction": F.col("prediction").cast("double"),
        "prediction_lower": pick("prediction_lower", "double"),
        "prediction_upper": pick("prediction_upper", "double"),
    }
    return df.select(*[columns[n].alias(n) for n in STANDARD_COLUMNS])


def evaluate_recent(pred: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """MAE, MSE and R2 per model over the latest days with a label."""
    recent = pred.filter(
        (F.col("date") >= F.lit(as_of - dt.timedelta(days=days))) & F.col("actual").isNotNull()
    )
    error = F.col("prediction") - F.col("actual")
    total = F.var_pop("actual") * F.count("actual")
    return recent.groupBy("model_name").agg(
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.avg(error * error).alias("mean_squared_error"),
        (1 - F.try_divide(F.sum(error * error), total)).alias("r2_score"),
    ).withColumn("run_date", F.lit(as_of))


def recent_wape(pred: DataFrame, actuals: DataFrame) -> DataFrame:
    """WAPE of scored rows against actuals by model and run date."""
    joined = pred.select("model_name", "run_date", "date", "prediction").join(
        actuals.select("model_name", "date", F.col("actual").alias("_a")).filter("_a is not null"),
        ["model_name", "date"],
    )
    return joined.groupBy("model_name", "run_date").agg(
        safe_divide(F.sum(F.abs(F.col("_a") - F.col("prediction"))), F.sum(F.abs("_a"))).alias("wape")
    )


def top_k_attributions(model: PipelineModel, df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str]) -> DataFrame:
    """The ``k`` largest contributions to each prediction, of linear models and of trees.

    Base value plus all contributions is the prediction. A linear contribution is the
    coefficient times the deviation from the feature's mean. On a tree, every split on
    the way to the leaf moves the node's mean; the move is the split feature's. Rows are
    not shuffled: sorting happens inside each row's short array. A row that lacks a
    feature has no prediction and no contributions.
    """
    whole = ~F.greatest(*[F.col(f).isNull() for f in features], F.lit(False))
    if hasattr(model.stages[-1], "coefficients"):
        scored, base, parts = _linear_parts(model, df.filter(whole), features)
    elif few_cells(model):
        # equal bins take equal ways through all trees, so each cell is explained once
        bins = model.stages[0].getOutputCols()
        binned = model.stages[0].transform(df.filter(whole))
        scored, base, parts = _tree_parts(PipelineModel(stages=model.stages[1:]), binned.select(*bins).distinct())
    else:
        scored, base, parts = _tree_parts(model, df.filter(whole))
    by_cell = few_cells(model)
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), part.alias("attribution")) for f, part in zip(features, parts, strict=True)]
    )

    def order(a: Column, b: Column) -> Column:
        x, y = F.abs(a["attribution"]), F.abs(b["attribution"])
        return F.when(x > y, -1).when(x < y, 1).when(a["feature"] < b["feature"], -1).when(
            a["feature"] > b["feature"], 1
        ).otherwise(0)

    none = [F.lit(None).cast(t) for t in ("double", "double", "array<struct<feature:string,attribution:double>>")]
    names = ("predicted_value", "base_value", "top_feature_attributions")
    explained = scored.select(
        *(bins if by_cell else keep),
        F.col("prediction").alias(names[0]),
        F.lit(base).alias(names[1]),
        F.slice(F.array_sort(pairs, order), 1, k).alias(names[2]),
    )
    if by_cell:
        explained = binned.join(stored(explained), bins).select(*keep, *names)
    return explained.unionByName(
        df.filter(~whole).select(*keep, *[c.alias(n) for c, n in zip(none, names, strict=True)])
    )


def _linear_parts(model: PipelineModel, df: DataFrame, features: Sequence[str]):
    linear = model.stages[-1]
    weights = linear.coefficients.toArray().tolist()
    scored = model.transform(df)
    means = list(scored.agg(*[F.avg(f) for f in features]).first())
    base = linear.intercept + sum(w * (m or 0.0) for w, m in zip(weights, means, strict=True))
    parts = [F.lit(w) * (F.col(f).cast("double") - F.lit(m)) for f, w, m in zip(features, weights, means, strict=True)]
    return scored, base, parts


def tree_nodes(ensemble) -> DataFrame:
    """tree, node, mean, left, right, feature of all nodes of a fitted ensemble (left -1:
    leaf), read back from the form in which Spark stores it."""
    spark = SparkSession.getActiveSession()
    path = f"{work_root(spark)}/foresail-trees-{uuid.uuid4().hex}"
    ensemble.write().save(path)
    node = "nodeData"
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col(f"{node}.id").alias("node"), F.col(f"{node}.prediction").alias("mean"),
        F.col(f"{node}.leftChild").alias("left"), F.col(f"{node}.rightChild").alias("right"),
        F.col(f"{node}.split.featureIndex").alias("feature"),
    )


def leaf_moves(nodes: Sequence, weights: Sequence[float], n_features: int):
    """(base, first leaf of each tree, moves): by leaf, numbered from left to right, what
    each feature's splits on its way add to the tree's mean, times the tree's weight."""
    by_tree: dict[int, dict[int, tuple]] = {}
    for r in nodes:
        by_tree.setdefault(r.tree, {})[r.node] = (r.mean, r.left, r.right, r.feature)
    base, first, moves = 0.0, [], []
    for tree, weight in enumerate(weights):
        own = by_tree[tree]
        first.append(len(moves))
        base += weight * own[0][0]
        todo = [(0, [0.0] * n_features)]
        while todo:
            at, so_far = todo.pop()
            mean, left, right, feature = own[at]
            if left < 0:
                moves.append(so_far)
                continue
            for child in (right, left):  # the left one is taken up next
                further = list(so_far)
                further[feature] += weight * (own[child][0] - mean)
                todo.append((child, further))
    return base, first, moves


def _tree_parts(model: PipelineModel, df: DataFrame):
    """A contribution depends on the leaf alone, so it is looked up by leaf: the tables,
    one for each feature, are bounded by the ensemble and go along as literals."""
    ensemble, prepared = model.stages[-1], PipelineModel(stages=model.stages[:-1])
    features = model.stages[0].getInputCols()
    weights = list(getattr(ensemble, "treeWeights", [1.0]))
    if isinstance(ensemble, RandomForestRegressionModel):
        weights = [1.0 / len(weights)] * len(weights)
    base, first, moves = leaf_moves(tree_nodes(ensemble).collect(), weights, len(features))
    leafy = ensemble.copy().setLeafCol("_leaf")
    scored = leafy.transform(prepared.transform(df)).withColumn("_leaf", vector_to_array("_leaf"))
    literal = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    at = F.transform(F.arrays_zip(F.col("_leaf").alias("leaf"), literal(first, "int").alias("first")),
                     lambda t: (t["leaf"] + t["first"] + 1).cast("int"))
    scored = scored.withColumn("_at", at)

    def part(i: int) -> Column:
        table = literal([m[i] for m in moves], "double")
        return F.aggregate("_at", F.lit(0.0), lambda total, leaf: total + F.element_at(table, leaf))

    return scored, base, [part(i) for i in range(len(features))]


def linear_terms(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The assembled feature vector as an array column, for inspection."""
    return model.transform(df).withColumn("feature_array", vector_to_array("features"))


# --- rolling origins -------------------------------------------------------------------------
def score_model(
    panel: DataFrame,
    c: BacktestContract,
    features: Sequence[str],
    label: str,
    horizon: int,
    trainer: Callable = train_gbt,
    params: Mapping | None = None,
) -> DataFrame:
    """Backtest of one direct horizon: a fit per origin on rows whose label was
    known by then. Origins are a handful of literals; each fit is distributed."""
    name = c.model_config_name or "model"
    keys = list(c.entity_columns)
    out = None
    for origin in c.origins:
        hi = origin - dt.timedelta(days=horizon)
        lo = hi - dt.timedelta(days=c.train_window_days)
        date = F.col(c.date_column)
        train = panel.filter((date > F.lit(lo)) & (date <= F.lit(hi)) & F.col(label).isNotNull())
        now = panel.filter(date == F.lit(origin))
        model = trainer(train, features, label, params)
        rows = model.transform(now).select(
            *keys,
            F.lit(origin).alias("forecast_origin"),
            F.lit(horizon).alias("horizon"),
            F.lit(name).alias("baseline_name"),
            "prediction",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def with_model_actuals(scored: DataFrame, panel: DataFrame, c: BacktestContract) -> DataFrame:
    """Model scores on the plan of all entities with actuals at the target date."""
    keys = list(c.entity_columns)
    steps = scored.select("forecast_origin", "horizon").distinct()
    grid = entity_grid(plan(panel.sparkSession, c), panel, c).join(steps, ["forecast_origin", "horizon"], "left_semi")
    actual = panel.select(*keys, F.col(c.date_column).alias("target_date"), F.col(c.actual_column).alias("actual"))
    return grid.join(actual, [*keys, "target_date"], "left").join(
        scored, [*keys, "forecast_origin", "horizon"], "left"
    )


def walk_forward(
    features_df: DataFrame,
    start: dt.date,
    end: dt.date,
    step: int,
    train_days: int,
    features: Sequence[str],
    label: str,
    trainer: Callable = train_gbt,
    params: Mapping | None = None,
    keep: Sequence[str] = ("store_nbr", "date"),
    horizon: int = 1,
) -> DataFrame:
    """Per anchor date: train on the days before it, predict that date.

    A row is learned from only if its label, ``horizon`` days later, lies before the
    anchor. Anchors are a handful of literals; each fit is distributed.
    """
    out = None
    for anchor in origins(start, end, step):
        train = known_by(train_slice(features_df, anchor, train_days), anchor, horizon)
        model = trainer(train, features, label, params)
        rows = model.transform(predict_slice(features_df, anchor)).select(
            *keep, F.col(label).alias("actual"), "prediction", F.lit(anchor).alias("as_of")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def walk_forward_linear(
    features_df: DataFrame,
    start: dt.date,
    end: dt.date,
    step: int,
    train_days: int,
    features: Sequence[str],
    label: str,
    keep: Sequence[str] = ("store_nbr", "date"),
    horizon: int = 1,
) -> DataFrame:
    """``walk_forward`` with least squares for all anchors in one pass over the rows.

    Products of features and label are summed by date; an anchor adds up the dates of its
    window and solves one small matrix on the driver. What gets there is one matrix a
    date, whatever the number of rows; anchors without a solution are NULL.
    """
    names = ["1", *features]
    value = {n: F.lit(1.0) if n == "1" else F.col(n).cast("double") for n in names} | {label: F.col(label).cast("double")}
    pairs = [(a, b) for i, a in enumerate(names) for b in [*names[i:], label]]
    anchors = origins(start, end, step)
    whole = features_df.dropna(subset=[label, *features]).filter(
        F.col("date").between(F.lit(anchors[0] - dt.timedelta(days=train_days)), F.lit(anchors[-1]))
    )
    sums = whole.groupBy("date").agg(*[F.sum(value[a] * value[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    by_date = {r["date"]: np.array(r[1:], float) for r in sums.collect()}
    solved = []
    for anchor in anchors:
        days = [anchor - dt.timedelta(days=d) for d in range(horizon + 1, train_days)]
        total = sum((by_date[d] for d in days if d in by_date), np.zeros(len(pairs)))
        gram, moment = np.zeros((len(names),) * 2), np.zeros(len(names))
        for (a, b), v in zip(pairs, total.tolist(), strict=True):
            if b == label:
                moment[names.index(a)] = v
            else:
                gram[names.index(a), names.index(b)] = gram[names.index(b), names.index(a)] = v
        full = np.linalg.matrix_rank(gram) == len(names)
        solved.append((anchor, np.linalg.solve(gram, moment).tolist() if full else None))
    spark = features_df.sparkSession
    weights = spark.createDataFrame(solved, "as_of date, _w array<double>")
    terms = [F.col("_w")[0]] + [F.col("_w")[i + 1] * value[n] for i, n in enumerate(features)]
    now = features_df.join(weights, F.col("date") == F.col("as_of"))
    return now.select(*keep, F.col(label).alias("actual"), sum(terms[1:], terms[0]).alias("prediction"), "as_of")


# --- per-series models --------------------------------------------------------------------------
def _split_point(n: int, test: float) -> int:
    return int(n * (1 - test))


# The orders tried, differences (whole, weekly) and (own lags, shock lags).
DIFFERENCES = ((0, 0), (1, 0), (0, 1), (1, 1))
LAGS = (((1,), ()), ((1, 7), ()), ((1,), (1,)), ((1, 7), (1, 7)), ((1, 2, 7), (1, 7)))


def _lagged(z: np.ndarray, lags: Sequence[int], start: int) -> np.ndarray:
    """(series, lags, values): every series' values from ``start`` on, ``lags`` earlier."""
    return np.stack([z[:, start - k : z.shape[1] - k] for k in lags], axis=1)


def _differenced(whole: int, seasonal: int, season: int) -> np.ndarray:
    """Coefficients c of the filter (1 - B)^whole (1 - B^season)^seasonal, c[0] = 1."""
    out = np.ones(1)
    for _ in range(whole):
        out = np.convolve(out, [1.0, -1.0])
    for _ in range(seasonal):
        out = np.convolve(out, np.r_[1.0, np.zeros(season - 1), -1.0])
    return out


def _moments(x: np.ndarray):
    """Products of the scaled columns ``x`` (series, columns, values) with one another, the
    scales, and whether each series' columns are clearly independent."""
    scale = np.sqrt((x * x).sum(2))
    scale[scale == 0] = 1.0
    gram = (x @ x.transpose(0, 2, 1)) / (scale[:, :, None] * scale[:, None, :])
    sound = np.linalg.eigvalsh(gram)[:, 0] > 1e-9
    gram[~sound] = np.eye(x.shape[1])
    return gram, scale, sound


def _least_squares(x: np.ndarray, z: np.ndarray, moments, of: Sequence[int]) -> np.ndarray:
    """Coefficients of ``z`` on the columns ``of`` of ``x``, series by series: normal
    equations with a step of refinement, or singular values where columns nearly depend."""
    gram, scale, sound = moments
    part, scale = gram[:, of][:, :, of], scale[:, of]
    x = x if len(of) == x.shape[1] else x[:, of]
    inverse = np.linalg.inv(part)
    coef = np.zeros(scale.shape)
    for _ in range(2):
        off = z - (coef[:, None] @ x)[:, 0]
        coef += (inverse @ ((x @ off[:, :, None])[:, :, 0] / scale)[:, :, None])[:, :, 0] / scale
    for i in np.flatnonzero(~sound):
        coef[i] = np.linalg.lstsq(x[i].T, z[i], rcond=None)[0]
    return coef


def _shocks(z: np.ndarray, order: int) -> np.ndarray:
    """One-step errors of a long autoregression of each series: estimates of the shocks."""
    order = min(order, max(1, z.shape[1] // 4))
    x = np.concatenate([np.ones((len(z), 1, z.shape[1] - order)), _lagged(z, range(1, order + 1), order)], axis=1)
    coef = _least_squares(x, z[:, order:], _moments(x), range(order + 1))
    out = np.zeros(z.shape)
    out[:, order:] = z[:, order:] - (coef[:, None] @ x)[:, 0]
    return out


@dataclass
class ArmaModels:
    """One model for each series of a stack: level, own lags and shock lags (by lag, 0 where
    unused), differencing filter, sigma, and the last values the lags reach back to."""

    level: np.ndarray
    own: np.ndarray
    shock: np.ndarray
    filter: np.ndarray
    sigma: np.ndarray
    z: np.ndarray
    e: np.ndarray
    y: np.ndarray


def _arma_fit(y: np.ndarray, season: int = 7) -> ArmaModels | None:
    """The models of least AICc of series of equal length, one a row of ``y``.

    Two stages: a long autoregression gives the shocks, then the differenced series is
    regressed on its lags and lagged shocks. All candidates predict the same last values
    of ``y``, so their errors compare whatever the differencing.
    """
    longest = max(max(own + shock) for own, shock in LAGS)
    start = season + 1 + longest
    count, size = y.shape
    if size < start + 8:
        return None
    owns = sorted({k for own, _ in LAGS for k in own})
    shocks = sorted({k for _, shock in LAGS for k in shock})
    best = np.full(count, np.inf)
    out = ArmaModels(
        np.zeros(count), np.zeros((count, longest)), np.zeros((count, longest)), np.zeros((count, season + 2)),
        np.zeros(count), np.zeros((count, longest)), np.zeros((count, longest)), y[:, -(season + 1) :],
    )
    for whole, seasonal in DIFFERENCES:
        c = _differenced(whole, seasonal, season)
        kept = size - len(c) + 1
        z = sum(v * y[:, len(c) - 1 - k : len(c) - 1 - k + kept] for k, v in enumerate(c) if v)
        e = _shocks(z, 2 * season)
        first = start - (len(c) - 1)
        x = np.concatenate([np.ones((count, 1, kept - first)), _lagged(z, owns, first), _lagged(e, shocks, first)], axis=1)
        known, moments = z[:, first:], _moments(x)
        n = kept - first
        for own, shock in LAGS:
            of = [0, *[1 + owns.index(k) for k in own], *[1 + len(owns) + shocks.index(k) for k in shock]]
            k = len(of)
            if n <= k + 2:
                continue
            coef = _least_squares(x, known, moments, of)
            sse = np.maximum(((known - (coef[:, None] @ x[:, of])[:, 0]) ** 2).sum(1), 1e-12)
            aicc = n * np.log(sse / n) + 2 * k * n / (n - k - 1)
            won = np.flatnonzero((aicc < best - 1e-9) | np.isinf(best))
            best[won] = aicc[won]
            out.level[won], out.sigma[won] = coef[won, 0], np.sqrt(sse[won] / (n - k))
            out.own[won], out.shock[won], out.filter[won] = 0.0, 0.0, 0.0
            out.own[np.ix_(won, [j - 1 for j in own])] = coef[won, 1 : 1 + len(own)]
            out.shock[np.ix_(won, [j - 1 for j in shock])] = coef[won, 1 + len(own) :]
            out.filter[np.ix_(won, range(len(c)))] = c
            out.z[won], out.e[won] = z[won, -longest:], e[won, -longest:]
    return None if np.isinf(best).any() else out


def _arma_ahead(m: ArmaModels, steps: int, level: np.ndarray, z, e, y, shock_now: float = 0.0) -> np.ndarray:
    """Values after the last ones; later shocks are zero, but the first is ``shock_now``."""
    lags, back, count = m.own.shape[1], m.filter.shape[1] - 1, len(m.sigma)
    z, e, y = (np.concatenate([a, np.zeros((count, steps))], axis=1) for a in (z, e, y))
    e[:, lags] = shock_now
    # newest last, as the values lie
    own, shock, past = m.own[:, ::-1].copy(), m.shock[:, ::-1].copy(), m.filter[:, :0:-1].copy()
    for i in range(steps):
        value = level + (own * z[:, i : i + lags]).sum(1) + (shock * e[:, i : i + lags]).sum(1) + e[:, i + lags]
        z[:, i + lags] = value
        y[:, i + back] = value - (past * y[:, i : i + back]).sum(1)
    return y[:, back:]


ARMA_CELLS = 4_000_000  # lagged values held at once


def arma_forecasts(y: np.ndarray, steps: int, coverage: float = 0.8):
    """(values, half widths, whether fitted) of series of equal length, one a row: the width
    grows with the response to past shocks."""
    count, size = y.shape
    values, width = np.full((count, steps), np.nan), np.full((count, steps), np.nan)
    sound = np.flatnonzero(np.isfinite(y).all(1))
    chunk = max(1, ARMA_CELLS // (16 * max(size, 1)))
    with np.errstate(all="ignore"):
        for at in range(0, len(sound), chunk):
            rows = sound[at : at + chunk]
            m = _arma_fit(y[rows])
            if m is None:
                continue
            values[rows] = _arma_ahead(m, steps, m.level, m.z, m.e, m.y)
            zero = (np.zeros_like(m.level), np.zeros_like(m.z), np.zeros_like(m.e), np.zeros_like(m.y))
            response = _arma_ahead(m, steps, *zero, 1.0)
            spread = np.sqrt(np.cumsum(response**2, axis=1))
            width[rows] = NormalDist().inv_cdf(0.5 + coverage / 2) * m.sigma[:, None] * spread
    return values, width, np.isfinite(values).all(1)


def arma_forecast(y: np.ndarray, steps: int, coverage: float = 0.8):
    """(values, half widths) of one series, or None."""
    values, width, fitted = arma_forecasts(np.asarray(y, dtype=float)[None], steps, coverage)
    return (values[0], width[0]) if fitted[0] else None


def _series_schema(df: DataFrame, keys: Sequence[str], date: str) -> str:
    kinds = dict(df.dtypes)
    keyed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return (
        f"{keyed}, part string, date date, forecast_date date, forecast_horizon int, actual double, "
        "prediction double, prediction_lower double, prediction_upper double, status string, n_obs long"
    )


SERIES_ROWS = 250_000  # rows of whole series that are fitted side by side


def _seeds(keys: Sequence[pa.Array], rows: np.ndarray) -> list[int]:
    kinds = [a.type.to_pandas_dtype() if pa.types.is_integer(a.type) or pa.types.is_floating(a.type) else None for a in keys]
    columns = [
        [v if v is None or kind is None else kind(v) for v in a.take(pa.array(rows)).to_pylist()]
        for a, kind in zip(keys, kinds, strict=True)
    ]
    return [zlib.crc32(repr(ids).encode()) for ids in zip(*columns, strict=True)]


def _per_series(df, keys, date, y, horizon, test, min_obs, fit) -> DataFrame:
    """Holdout and forward forecasts of every series, and one status row for each.

    A status row (part "status") says whether the series was fitted, was too short, or
    failed, and how many values it has; a failed fit does not end the job. Tasks hold whole
    series in order; those of a stretch of rows that have equally many values are fitted
    side by side: ``fit`` gets days and values, a series a row, the days to forecast, and
    the series' seeds, and gives (values, lower, upper, whether fitted).
    """
    keys = list(keys)
    schema = _series_schema(df, keys, date)
    names = [f.split()[0].strip("`") for f in schema.split(", ")][len(keys) :]
    day, value = "_series_day", "_series_value"

    def forecasts(part, rows, origin, days, actual, fitted):
        """Rows of one part, and the series they are of."""
        steps = days.shape[1]
        kinds = (pa.int32(), pa.int32(), pa.int32())
        numbers = (np.repeat(origin, steps), days.ravel(), np.tile(np.arange(1, steps + 1), len(rows)))
        size = len(rows) * steps
        columns = [pa.array(a, kind) for a, kind in zip(numbers, kinds, strict=True)]
        columns = [columns[0].cast(pa.date32()), columns[1].cast(pa.date32()), columns[2]]
        columns.append(pa.nulls(size, pa.float64()) if actual is None else pa.array(actual.ravel()))
        columns += [pa.array(a.ravel()) for a in fitted]
        columns += [pa.nulls(size, pa.string()), pa.nulls(size, pa.int64())]
        return np.repeat(rows, steps), [pa.repeat(part, size), *columns]

    def run(batches):
        for t, series in whole_series(batches, keys, SERIES_ROWS):
            first = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
            ids = [t[k].combine_chunks().take(pa.array(first)) for k in keys]
            held, dated = t[value].combine_chunks(), t[day].combine_chunks()
            known = held.is_valid().to_numpy(zero_copy_only=False) & dated.is_valid().to_numpy(zero_copy_only=False)
            held = held.fill_null(0.0).to_numpy(zero_copy_only=False)
            known &= ~np.isnan(held)
            held, days = held[known], dated.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            counts = np.bincount(series[known], minlength=len(first))
            starts = np.cumsum(counts) - counts
            status = np.full(len(first), "short", dtype=object)
            made = []
            for n in np.unique(counts):
                cut = _split_point(int(n), test)
                if not (min_obs <= cut < n and cut > 0):
                    continue
                rows = np.flatnonzero(counts == n)
                at = starts[rows][:, None] + np.arange(n)
                d, v = days[at], held[at]
                future = d[:, -1:] + np.arange(1, horizon + 1)
                seeds = _seeds(ids, rows)
                *near, good = fit(d[:, :cut], v[:, :cut], d[:, cut:], seeds)
                *far, ahead = fit(d, v, future, seeds)
                good &= ahead
                status[rows] = np.where(good, "fitted", "failed")
                rows = rows[good]
                made.append(forecasts("holdout", rows, d[good, cut - 1], d[good, cut:], v[good, cut:], [a[good] for a in near]))
                made.append(forecasts("forward", rows, d[good, -1], future[good], None, [a[good] for a in far]))
            blank = [pa.nulls(len(first), kind) for kind in (pa.date32(), pa.date32(), pa.int32(), *[pa.float64()] * 4)]
            told = [pa.repeat("status", len(first)), *blank, pa.array(status, pa.string()), pa.array(counts, pa.int64())]
            for rows, columns in [*made, (np.arange(len(first)), told)]:
                keyed = [a.take(pa.array(rows)) for a in ids]
                yield from pa.Table.from_arrays([*keyed, *columns], names=[*keys, *names]).to_batches(max_chunksize=10_000)

    whole = df.repartition(*keys).sortWithinPartitions(*keys, date)
    read = [F.unix_date(F.col(date).cast("date")).alias(day), F.col(y).cast("double").alias(value)]
    return whole.select(*keys, *read).mapInArrow(run, schema)


def series_forecasts(fitted: DataFrame) -> DataFrame:
    return fitted.filter(F.col("part") != "status").drop("status", "n_obs")


def series_status(fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, status, n_obs: one row a series, fitted or not."""
    return fitted.filter(F.col("part") == "status").select(*keys, "status", "n_obs")


def fit_series_arma(
    df: DataFrame, keys: Sequence[str], date: str, y: str, h: int, coverage: float = 0.8,
    test: float = 0.2, min_obs: int = 24,
) -> DataFrame:
    """Per-series seasonal ARMA with orders and differencing chosen by AICc: holdout rows,
    ``h`` steps ahead, and a status row. Values are taken as equally spaced; fewer than 24
    leave nothing to choose by."""

    def fit(days, values, targets, seeds):
        point, width, fitted = arma_forecasts(values, targets.shape[1], coverage)
        return point, point - width, point + width, fitted

    return _per_series(df, keys, date, y, h, test, min_obs, fit)


CHANGES, CHANGE_SPAN = 25, 0.8  # possible changes of slope, over the first part of the history
PENALTIES = 10.0 ** np.arange(-4, 4)


def _trend_design(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    t = t[..., None]
    return np.concatenate([np.ones_like(t), t, np.maximum(t - at, 0.0)], axis=-1)


def _season_design(days: np.ndarray, weekly: int, yearly: int) -> np.ndarray:
    """Waves at day numbers, counted from 1970."""
    t = days.astype(float)
    waves = [(7.0, k) for k in range(1, weekly + 1)] + [(365.25, k) for k in range(1, yearly + 1)]
    angles = [2 * np.pi * k * t / period for period, k in waves]
    return np.stack([f(a) for a in angles for f in (np.sin, np.cos)], axis=-1) if angles else np.empty((*t.shape, 0))


def _day_numbers(days: pd.Series) -> np.ndarray:
    return (days - pd.Timestamp("1970-01-01")).dt.days.to_numpy()


def _deviations(t: np.ndarray, changes: np.ndarray, sigma: float, runs: int, seed: int) -> np.ndarray:
    """(runs, times) simulated deviations after time 1 from a trend with ``changes``."""
    rng = np.random.default_rng(seed)
    ahead = max(float(t.max()) - 1.0, 0.0)
    scale = float(np.abs(changes).mean()) if len(changes) else 0.0
    counts = rng.poisson(ahead * len(changes) / CHANGE_SPAN, runs)
    most = int(counts.max(initial=0))
    where = 1.0 + ahead * rng.random((runs, most))
    size = rng.laplace(0.0, scale or 1e-12, (runs, most)) * (np.arange(most) < counts[:, None])
    noise = rng.normal(0.0, sigma or 1e-12, (runs, len(t)))
    if not most:
        return noise
    # every change adds a slope from its place on: sums over the changes up to each time
    order = np.argsort(t, kind="stable")
    cell = (np.searchsorted(t[order], where) + np.arange(runs)[:, None] * (len(t) + 1)).ravel()
    slope, start = (
        np.bincount(cell, w.ravel(), runs * (len(t) + 1)).reshape(runs, -1)[:, :-1].cumsum(1) for w in (size, size * (where - 1.0))
    )
    noise[:, order] += slope * (t[order] - 1.0) - start
    return noise


@dataclass
class TrendModel:
    """A piecewise trend plus seasons. ``changes`` are slope changes per unit of time,
    which runs from 0 to 1 over the history."""

    start: pd.Timestamp
    span: float
    at: np.ndarray
    coef: np.ndarray
    sigma: float
    weekly: int
    yearly: int

    @property
    def changes(self) -> np.ndarray:
        return self.coef[2 : 2 + len(self.at)]

    def time(self, days: pd.Series) -> np.ndarray:
        return (days - self.start).dt.days.to_numpy(dtype=float) / self.span

    def predict(self, days: pd.Series) -> np.ndarray:
        season = _season_design(_day_numbers(days), self.weekly, self.yearly)
        return np.concatenate([_trend_design(self.time(days), self.at), season], axis=-1) @ self.coef

    def simulated(self, days: pd.Series, runs: int, seed: int) -> np.ndarray:
        """(runs, days) deviations: slope changes as often and as large as in the history
        go on in the future, and noise is added."""
        return _deviations(self.time(days), self.changes, self.sigma, runs, seed)


@dataclass
class TrendFits:
    """Trends of a stack of series of equal length, one a row."""

    start: np.ndarray
    span: np.ndarray
    at: np.ndarray
    coef: np.ndarray
    sigma: np.ndarray
    fitted: np.ndarray


def fit_trends(days: np.ndarray, values: np.ndarray, weekly: int = 3, yearly: int = 2) -> TrendFits:
    """Ridge on slope changes, the penalty chosen by generalised cross-validation.
    ``days`` are day numbers; series of the same days share their one row."""
    count, n = values.shape
    start, span = days[:, 0].astype(float), np.maximum(days[:, -1] - days[:, 0], 1).astype(float)
    at = np.linspace(0, CHANGE_SPAN, min(CHANGES, max(1, n // 10)) + 1)[1:]
    t = (days - start[:, None]) / span[:, None]
    x = np.concatenate([_trend_design(t, at), _season_design(days, weekly, yearly)], axis=-1)
    kind = np.r_[0.0, 0.0, np.ones(len(at)), np.full(x.shape[-1] - 2 - len(at), 1e-3)]
    across = x.transpose(0, 2, 1)
    gram, moment = across @ x, across @ values[:, :, None]
    best, coef, sigma = np.full(count, np.inf), np.zeros((count, x.shape[-1])), np.zeros(count)
    for penalty in PENALTIES:
        ridge = gram + np.diag(penalty * kind + 1e-9 * n)
        tried = np.linalg.solve(ridge, moment)
        sse = ((values - (x @ tried)[:, :, 0]) ** 2).sum(1)
        free = n - np.trace(np.linalg.solve(ridge, gram), axis1=1, axis2=2)
        free = np.broadcast_to(free, (count,))
        better = (free > 1) & (n * sse / free**2 < best)
        best = np.where(better, n * sse / free**2, best)
        coef[better], sigma[better] = tried[better, :, 0], np.sqrt(sse[better] / free[better])
    return TrendFits(start, span, at, coef, sigma, np.isfinite(best))


def fit_trend(days: pd.Series, values: np.ndarray, weekly: int = 3, yearly: int = 2) -> TrendModel:
    """The trend of one series."""
    f = fit_trends(_day_numbers(days)[None], np.asarray(values, dtype=float)[None], weekly, yearly)
    if not f.fitted[0]:
        raise ValueError("more terms than values")
    return TrendModel(days.iloc[0], float(f.span[0]), f.at, f.coef[0], float(f.sigma[0]), weekly, yearly)


TREND_CELLS = 8_000_000  # design and simulated values held at once


def fit_series_seasonal(
    df: DataFrame, keys: Sequence[str], date: str, y: str, h: int, weekly: int = 3, yearly: int = 2,
    coverage: float = 0.8, runs: int = 300, test: float = 0.2, min_obs: int = 60,
) -> DataFrame:
    """Per-series piecewise trend and Fourier seasons, with intervals from simulated
    future changes; the draws are seeded by the series' keys."""

    levels = [(1 - coverage) / 2, (1 + coverage) / 2]

    def some(days, values, targets, seeds):
        count, steps = targets.shape
        one = bool((days == days[0]).all() and (targets == targets[0]).all())
        days, targets = (days[:1], targets[:1]) if one else (days, targets)
        f = fit_trends(days, values, weekly, yearly)
        t = (targets - f.start[:, None]) / f.span[:, None]
        x = np.concatenate([_trend_design(t, f.at), _season_design(targets, weekly, yearly)], axis=-1)
        point = (x @ f.coef[:, :, None])[:, :, 0]
        fitted = f.fitted & np.isfinite(point).all(1) & np.isfinite(f.sigma)
        off = np.zeros((count, runs, steps))
        for i in np.flatnonzero(fitted):
            off[i] = _deviations(t[0 if one else i], f.coef[i, 2 : 2 + len(f.at)], float(f.sigma[i]), runs, seeds[i])
        low, high = np.quantile(off, levels, axis=1)
        return point, point + low, point + high, fitted

    def fit(days, values, targets, seeds):
        size = runs * targets.shape[1] + days.shape[1] * (CHANGES + 2 * (weekly + yearly))
        chunk = max(1, TREND_CELLS // size)
        with np.errstate(all="ignore"):
            parts = [
                some(days[i : i + chunk], values[i : i + chunk], targets[i : i + chunk], seeds[i : i + chunk])
                for i in range(0, len(values), chunk)
            ]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    return _per_series(df, keys, date, y, h, test, min_obs, fit)


# --- tuning ----------------------------------------------------------------------------------------
def sample_trials(space: Mapping[str, Sequence], n: int, seed: int) -> list[dict]:
    """``n`` parameter sets: lists are choices, (low, high) tuples are ranges."""
    rng = random.Random(seed)
    trials = []
    for _ in range(n):
        chosen = {}
        for name, options in sorted(space.items()):
            if isinstance(options, tuple):
                low, high = options
                whole = isinstance(low, int) and isinstance(high, int)
                chosen[name] = rng.randint(low, high) if whole else rng.uniform(low, high)
            else:
                chosen[name] = rng.choice(list(options))
        trials.append(chosen)
    return trials


def random_search(
    train: DataFrame,
    held: DataFrame,
    features: Sequence[str],
    label: str,
    space: Mapping[str, Sequence],
    n: int,
    seed: int,
    config_name: str,
    run_id: str,
    run_at: dt.datetime,
    trainer: Callable = train_gbt,
    parallelism: int = 2,
) -> DataFrame:
    """Seeded random search on one split; one ledger row per trial.

    Trials share the cached split and run a few at a time, each as Spark jobs.
    """
    spark: SparkSession = train.sparkSession
    train, held = train.persist(), held.persist()

    def run(item):
        number, params = item
        model = trainer(train, features, label, params)
        error = F.abs(F.col(label) - F.col("prediction"))
        return number, params, model.transform(held).agg(F.avg(error)).first()[0]

    try:
        with ThreadPool(parallelism) as pool:
            done = pool.map(inheritable_thread_target(spark)(run), list(enumerate(sample_trials(space, n, seed))))
    finally:
        train.unpersist()
        held.unpersist()
    rows = [
        (run_id, config_name, number, "mae", float(value), json.dumps(params, sort_keys=True), run_at)
        for number, params, value in done
    ]
    return spark.createDataFrame(
        rows,
        "optimize_run_id string, config_name string, trial_number int, objective_metric string, "
        "objective_value double, parameters string, run_at timestamp",
    )


# A trial ledger with one row for each trial and rung.
TRIAL_LEDGER = (
    "optimize_run_id string, config_name string, trial_number int, rung int, budget int, "
    "objective_metric string, objective_value double, parameters string, run_at timestamp"
)


def successive_halving(
    train: DataFrame,
    held: DataFrame,
    features: Sequence[str],
    label: str,
    space: Mapping[str, Sequence],
    n: int,
    seed: int,
    config_name: str,
    run_id: str,
    run_at: dt.datetime,
    path: str,
    budgets: Sequence[int] = (3, 9, 27, 81),
    eta: int = 3,
    trainer: Callable = train_gbt,
    parallelism: int = 4,
) -> DataFrame:
    """Trials on growing budgets (boosting rounds); the best 1/``eta`` of a rung go on.

    Every fit is appended to the ledger at ``path`` when it is done, keyed by run, trial
    and rung, so a rerun of a broken search takes up where it ended. The ledger has a few
    dozen rows. Trials on trees share bins and cells, and the errors of a trial are summed
    over counts of held labels by cell; other trainers read the split in every fit, so
    callers store it. Ties go by number.
    """
    spark = train.sparkSession
    trials = sample_trials(space, n, seed)
    try:
        known = spark.read.schema(TRIAL_LEDGER).parquet(path).filter(F.col("optimize_run_id") == run_id).collect()
    except AnalysisException:  # no ledger yet
        known = []
    done = {(r.rung, r.trial_number): r.objective_value for r in known}
    lock, counted, counting = Lock(), {}, Lock()

    def mae(model: PipelineModel) -> float:
        error = F.abs(F.col(label) - F.col("prediction"))
        if not few_cells(model):
            return model.transform(held).agg(F.avg(error)).first()[0]
        bins = tuple(map(tuple, model.stages[0].getSplitsArray()))
        with counting:
            if bins not in counted:
                placed = _in_cell(held, model.stages[0]).filter(F.col(label).isNotNull())
                counted[bins] = stored(placed.groupBy("_cell", label).agg(F.count(F.lit(1)).alias("_n")))
        rows = counted[bins].join(F.broadcast(cell_predictions({"prediction": model}, spark)), "_cell")
        return rows.agg(F.sum(error * F.col("_n")) / F.sum("_n")).first()[0]

    def fitted(rung: int, trial: int) -> None:
        params = {**trials[trial], "maxIter": budgets[rung]}
        model = trainer(train, features, label, params)
        value = mae(model)
        row = (run_id, config_name, trial, rung, budgets[rung], "mae", float(value), json.dumps(params, sort_keys=True), run_at)
        with lock:
            spark.createDataFrame([row], TRIAL_LEDGER).coalesce(1).write.mode("append").parquet(path)
            done[rung, trial] = float(value)

    _shared[train] = SharedCells(train, features, [label])
    try:
        alive = list(range(n))
        with ThreadPool(parallelism) as pool:
            for rung in range(len(budgets)):
                todo = [t for t in alive if (rung, t) not in done]
                pool.map(inheritable_thread_target(spark)(lambda t, rung=rung: fitted(rung, t)), todo)
                alive = sorted(alive, key=lambda t, rung=rung: (done[rung, t], t))[: max(1, len(alive) // eta)]
    finally:
        _shared.pop(train, None)
    return spark.read.schema(TRIAL_LEDGER).parquet(path).filter(F.col("optimize_run_id") == run_id)


def last_rung(ledger: DataFrame) -> DataFrame:
    """The rows of each run's highest rung, which ``best_trial`` chooses from."""
    top = ledger.groupBy("optimize_run_id").agg(F.max("rung").alias("rung"))
    return ledger.join(top, ["optimize_run_id", "rung"], "left_semi")


def best_trial(trials: DataFrame, config_name: str | None = None) -> DataFrame:
    """Per configuration: newest run, then its lowest objective."""
    rows = trials if config_name is None else trials.filter(F.col("config_name") == config_name)
    newest = rows.groupBy("config_name").agg(
        F.max_by("optimize_run_id", F.struct("run_at", "optimize_run_id")).alias("optimize_run_id")
    )
    best = F.min_by(
        F.struct("trial_number", "objective_value", "parameters"), F.struct("objective_value", "trial_number")
    )
    return (
        rows.join(newest, ["config_name", "optimize_run_id"])
        .groupBy("config_name", "optimize_run_id")
        .agg(best.alias("_b"))
        .select(
            "config_name",
            "optimize_run_id",
            F.col("_b.trial_number").alias("best_trial_number"),
            F.col("_b.objective_value").alias("best_value"),
            F.col("_b.parameters").alias("best_params"),
        )
    )


