"""Exact order statistics without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresail.session import checkpointed

SPLITS = 64
# Distinct values that one task may order.
BUCKET = 100_000


def counted_values(
    values: DataFrame, groups: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """groups, _v, _n: every distinct value once, so a value held by a third of a group
    is one row. Written, as it is read in every round."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    rows = values.filter(F.col(value).isNotNull())
    return checkpointed(rows.groupBy(*groups, F.col(value).alias("_v")).agg(n.alias("_n")))


def _refined(left: DataFrame, wanted: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every bucket cut into about SPLITS parts; only parts that hold a rank stay."""
    keys = [*groups, "_bucket"]
    at = [i / SPLITS for i in range(1, SPLITS)]
    edges = left.groupBy(*keys).agg(F.percentile_approx("_v", at, 1000).alias("_edges"))
    part = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    cut = left.join(edges, keys).select(*keys, "_v", "_n", part.alias("_part"))
    totals = cut.groupBy(*keys, "_part").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    place = F.col("rank") - F.col("_before")
    wanted = wanted.join(totals, keys).filter((place > F.col("_ahead")) & (place <= F.col("_ahead") + F.col("_total")))
    wanted = checkpointed(wanted.withColumn("_before", F.col("_before") + F.col("_ahead")).drop("_ahead", "_total"))
    held = wanted.select(*keys, "_part").distinct()
    narrow = F.concat("_bucket", F.lit("."), F.col("_part").cast("string"))
    left = checkpointed(
        cut.join(held, [*keys, "_part"], "left_semi").withColumn("_bucket", narrow).drop("_part")
    )
    return left, wanted.withColumn("_bucket", narrow).drop("_part")


def kth_counted(
    counted: DataFrame, ranks: DataFrame, groups: Sequence[str], out: str = "kth_value", bucket: int = BUCKET
) -> DataFrame:
    """The ``rank``-th smallest value (1-based) for each row of ``ranks`` (groups, rank),
    out of ``counted_values``.

    A mergeable sketch proposes edges inside each bucket, counts per part tell which part
    holds a rank, and that part is the next round's bucket, until none has more than
    ``bucket`` distinct values; only those are ordered. Edges need not be accurate for
    the answer to be exact. Values that no rank can be drop out in every round.
    """
    groups = list(groups)
    keys = [*groups, "_bucket"]
    left = counted.withColumn("_bucket", F.lit(""))
    wanted = ranks.withColumns({"_bucket": F.lit(""), "_before": F.lit(0).cast("long")})
    while (left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > bucket:
        left, wanted = _refined(left, wanted, groups)
    up_to = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = left.withColumn("_end", F.sum("_n").over(up_to))
    position = F.col("rank") - F.col("_before")
    hit = (position > F.col("_end") - F.col("_n")) & (position <= F.col("_end"))
    return wanted.join(placed, keys).filter(hit).select(*ranks.columns, F.col("_v").alias(out))


def kth_values(
    values: DataFrame,
    ranks: DataFrame,
    groups: Sequence[str],
    value: str,
    out: str = "kth_value",
    weight: str | None = None,
) -> DataFrame:
    """``kth_counted`` of raw values; with ``weight`` a row stands for that many."""
    return kth_counted(counted_values(values, groups, value, weight), ranks, groups, out)


def exact_median(values: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per group: mean of the two middle order statistics."""
    groups = list(groups)
    counted = counted_values(values, groups, value)
    sizes = counted.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    middle = sizes.select(
        *groups,
        F.explode(
            F.array(
                F.floor((F.col("_size") + 1) / 2).cast("long"),
                (F.floor(F.col("_size") / 2) + 1).cast("long"),
            )
        ).alias("rank"),
    )
    return kth_counted(counted, middle, groups).groupBy(*groups).agg(F.avg("kth_value").alias(out))
