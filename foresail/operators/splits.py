"""Feature matrices, chronological splits and point-in-time checks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresail.contracts import FeatureRule
from foresail.functions.expr import require_columns
from foresail.functions.ranks import kth_values
from foresail.operators.features import declared_features
from foresail.session import stored

MAX_LEVELS = 2000
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def feature_matrix(
    df: DataFrame,
    target: str,
    excluded: Sequence[str] = (),
    categorical: Sequence[str] = (),
    date: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Numeric feature columns, one-hot categories, complete rows only.

    Categories are dimension values (weekday, store type), each a column of the matrix;
    a column with more than MAX_LEVELS of them is an entity key and is refused.
    """
    require_columns(df, [target], "feature input")
    cats = [c for c in categorical if c in df.columns]
    levels = {}
    for c in cats:
        found = df.filter(F.col(c).isNotNull()).select(c).distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} values and is no category")
        levels[c] = sorted(r[0] for r in found)
    coded = {
        _clean(f"{c}_{v}"): (F.coalesce(F.col(c) == F.lit(v), F.lit(False))).cast("int")
        for c in cats
        for v in levels[c]
    }
    dropped = (set(excluded) - {target}) | {target, *cats} | ({date} if date else set())
    numeric = [
        n for n, kind in df.dtypes if n not in dropped and kind.split("(")[0] in NUMERIC
    ]
    wide = df.withColumns(coded) if coded else df
    counts = wide.agg(*[F.count(F.col(n)).alias(n) for n in numeric]).first() if numeric else {}
    features = [n for n in numeric if counts[n] > 0] + list(coded)
    y = F.expr(f"try_cast(`{target}` as double)")
    kept = wide.select(
        *([date] if date else []), *features, y.alias(target)
    ).dropna(subset=[target, *features])
    return kept, features


def _clean(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


def align_features(df: DataFrame, trained: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the trained features, in order; absent ones and gaps become zero."""
    have = set(df.columns)
    aligned = [
        (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f) for f in trained
    ]
    return df.select(*keep, *aligned)


def _tie_breaker(keys: Sequence[str]) -> Column:
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("double")


def chrono_split(
    df: DataFrame, test: float, date: str, keys: Sequence[str] = (), purge_days: int = 0
) -> tuple[DataFrame, DataFrame]:
    """First ``1 - test`` of the rows in date order train, the rest test.

    Rows of the boundary date are told apart by a digest of ``keys``. Only counts
    per date reach the driver (a bounded calendar) and, without a purge, one
    threshold inside the boundary date; the rows are never sorted. With a purge,
    train ends ``purge_days`` before the validation start.
    """
    if purge_days < 0:
        raise ValueError("purge_days must be non-negative")
    per_day = df.filter(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    days = sorted((r[date], r["n"]) for r in per_day.collect())
    total = sum(n for _, n in days)
    split = int(total * (1 - test))
    if split <= 0 or split >= total:
        raise ValueError(f"invalid split: {total} rows with test size {test}")
    seen = 0
    for boundary, n in days:
        if seen + n > split:
            break
        seen += n
    if purge_days:
        train = df.filter(F.col(date) < F.date_sub(F.lit(boundary), purge_days))
        held = df.filter(F.col(date) >= F.lit(boundary))
        if train.isEmpty() or held.isEmpty():
            raise ValueError(f"purge of {purge_days} days leaves an empty part")
        return train, held
    inside = split - seen
    before, after = F.col(date) < F.lit(boundary), F.col(date) > F.lit(boundary)
    if inside == 0:
        return df.filter(before), df.filter(~before)
    if not keys:
        raise ValueError("a split inside one date needs keys to order its rows")
    tie = _tie_breaker(keys)
    rows = df.filter(F.col(date) == F.lit(boundary)).select(tie.alias("_t"))
    rank = df.sparkSession.range(1).select(F.lit(inside).cast("long").alias("rank"))
    threshold = kth_values(rows, rank, [], "_t").first()["kth_value"]
    first = (F.col(date) == F.lit(boundary)) & (tie <= F.lit(threshold))
    return df.filter(before | first), df.filter(after | ((F.col(date) == F.lit(boundary)) & (tie > F.lit(threshold))))


def date_split(df: DataFrame, date: str, test: float) -> tuple[DataFrame, DataFrame]:
    """Latest share of the distinct dates tests; the calendar is bounded."""
    days = [r[0] for r in df.select(date).filter(F.col(date).isNotNull()).distinct().orderBy(date).collect()]
    if not days:
        raise ValueError("no dates to split")
    cutoff = F.lit(days[int(len(days) * (1 - test))])
    return df.filter(F.col(date) < cutoff), df.filter(F.col(date) >= cutoff)


def entity_split(df: DataFrame, keys: Sequence[str], date: str, test: float) -> tuple[DataFrame, DataFrame]:
    """Per entity the first rows by date train; too short entities drop out.

    An entity has one row per date, so its window partition is bounded. Rows are
    placed once and stored: both parts in one task would hold its sorts twice.
    """
    entity = Window.partitionBy(*keys)
    placed = df.withColumns(
        {
            "_n": F.count(F.lit(1)).over(entity),
            "_k": F.row_number().over(entity.orderBy(date)),
        }
    )
    cut = F.floor(F.col("_n") * (1 - test))
    usable = placed.filter((cut > 0) & (cut < F.col("_n")))
    usable = stored(usable.withColumn("_train", F.col("_k") <= cut).drop("_n", "_k"))
    return usable.filter("_train").drop("_train"), usable.filter("not _train").drop("_train")


# --- point in time ------------------------------------------------------------------------
def match_rule(feature: str, registry: Mapping[str, FeatureRule] | None = None) -> FeatureRule | None:
    return (declared_features() if registry is None else registry).get(feature)


def validate_features(features: Sequence[str], registry: Mapping[str, FeatureRule] | None = None) -> list[FeatureRule]:
    """Every feature registered and known at the forecast cutoff."""
    matched = {f: match_rule(f, registry) for f in sorted(set(features))}
    unknown = [f for f, r in matched.items() if r is None]
    if unknown:
        raise ValueError(f"unregistered features: {', '.join(unknown[:20])}")
    leaking = [f for f, r in matched.items() if r.availability == "observed_after_period"]
    if leaking:
        raise ValueError(f"features observed after the period: {', '.join(leaking[:20])}")
    return list(matched.values())


def cutoff_report(df: DataFrame, columns: Sequence[str], cutoff: Column, date: str | None = None) -> DataFrame:
    """One row per source column: latest value, NULLs and values after the cutoff."""
    limit = cutoff.cast("timestamp")
    sources = [*columns, *([date] if date and date not in columns else [])]
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("source"), F.col(c).cast("timestamp").alias("_t"))
            for c in sources
        ]
    )
    return (
        df.withColumn("_limit", limit)
        .select("_limit", F.inline(entries))
        .groupBy("source")
        .agg(
            F.max("_t").alias("source_cutoff"),
            F.count_if(F.col("_t").isNull()).alias("null_count"),
            F.count_if(F.col("_t") > F.col("_limit")).alias("late_count"),
            F.count_if(F.col("_limit").isNull()).alias("missing_cutoff_count"),
        )
    )


def check_cutoffs(
    df: DataFrame,
    features: Sequence[str],
    cutoff: Column,
    registry: Mapping[str, FeatureRule] | None = None,
    date: str | None = None,
) -> dict[str, object]:
    """Reject a frame with any source value later than its row's cutoff."""
    rules = validate_features(features, registry)
    columns = sorted({c for r in rules for c in r.metadata_columns})
    require_columns(df, [*columns, *([date] if date else [])], "feature frame")
    rows = cutoff_report(df, columns, cutoff, date).collect() if columns or date else []
    if not rows and df.isEmpty():
        raise ValueError("an empty feature frame has no cutoffs to check")
    for r in rows:
        if r.missing_cutoff_count or r.null_count or r.late_count:
            raise ValueError(
                f"{r.source}: {r.late_count} rows later than the cutoff, {r.null_count} null, "
                f"{r.missing_cutoff_count} without a cutoff"
            )
    return {r.source: r.source_cutoff for r in rows}


