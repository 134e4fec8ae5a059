"""Writing relations: overwrite, append, insert-once, upsert and export.

There is no table format with transactions underneath, so each writer assumes
one writer per path at a time. Batches are checked before anything is written.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from foresail.session import checkpointed

RUN_ID = re.compile(r"[0-9a-f]{64}")


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The relation at ``path``, or None where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def write(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Truncate-and-load (``replace``) or ``append``."""
    modes = {"replace": "overwrite", "append": "append"}
    if mode not in modes:
        raise ValueError(f"mode must be one of {sorted(modes)}")
    writer = df.write.mode(modes[mode]).option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: str | Sequence[str]) -> None:
    """Replace exactly the partitions present in ``df``.

    Rows are clustered by partition value first, so a partition is written by
    few tasks; AQE splits the ones that are too large (a hot date).
    """
    columns = [partition] if isinstance(partition, str) else list(partition)
    (
        df.hint("rebalance", *columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


def touched_part(existing: DataFrame, batch: DataFrame, partition: str) -> DataFrame:
    """The rows of ``existing`` in partitions that ``batch`` has, pruned by Spark.

    The batch's partition values, one row each and at most as many as the ledger has
    folders, meet the partition column in a semi-join, and only matching folders are
    read. The comparison holds for every value that is there: Spark prunes only where the
    other side is filtered.
    """
    values = batch.select(partition).filter(F.length(F.col(partition).cast("string")) >= 0).distinct()
    return existing.join(F.broadcast(values), partition, "left_semi")


def merge_replace(
    df: DataFrame, path: str, keys: Sequence[str], partition: str, clear: Sequence = ()
) -> None:
    """Merge on a unique key, replacing old rows of the touched partitions.

    ``clear`` lists partition values whose old rows are dropped first (the
    run's own date, so that a re-run does not leave rows it no longer makes).
    Only touched partitions are read and rewritten.
    """
    spark = df.sparkSession
    df = unique_or_fail(df, keys, "merge batch")
    existing = read_if_exists(spark, path)
    if existing is None:
        return _failing_as_value_error(lambda: overwrite_partitions(df, path, partition))
    kept = touched_part(existing, df, partition)
    if clear:
        kept = kept.filter(~F.col(partition).isin(list(clear)))
    kept = kept.join(df.select(*keys), list(keys), "left_anti").select(*df.columns)
    # the path is both read and overwritten, so the kept rows are cut loose first
    merged = _failing_as_value_error(lambda: checkpointed(kept.unionByName(df)))
    overwrite_partitions(merged, path, partition)


BAD_BATCH = "rejected batch: "


def unique_or_fail(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df``, whose use fails on a NULL or repeated key: checked inside the job that
    uses it, on the exchange by key that a later join on the key needs anyway."""
    missing = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    stop = F.raise_error(F.lit(f"{BAD_BATCH}{what}: {', '.join(keys)} is null"))
    whole = df.withColumn("_key_ok", F.when(missing, stop).otherwise(F.lit(1)))
    again = F.raise_error(F.lit(f"{BAD_BATCH}{what} must have one row per {', '.join(keys)}"))
    count = F.sum("_key_ok").over(Window.partitionBy(*keys))
    # the check is part of a column that stays, so that it is not pruned away
    first = df.columns[0]
    checked = whole.withColumn("_count", count).withColumn(
        first, F.when(F.col("_count") > 1, again).otherwise(F.col(first))
    )
    return checked.select(*df.columns)


def _failing_as_value_error(run):
    """The result of ``run``; a batch rejected inside Spark is a ValueError here."""
    try:
        return run()
    except Exception as error:
        found = re.search(re.escape(BAD_BATCH) + r"([^\n\[\]]*)", str(error))
        if found:
            raise ValueError(found[1].split(" SQLSTATE")[0].strip()) from error
        raise


def not_yet_stored(df: DataFrame, existing: DataFrame, id_column: str, partition: str | None = None) -> DataFrame:
    """Rows of ``df`` whose id is not in ``existing``, of which only the batch's partitions
    are read where ids never move between partitions."""
    if partition is not None:
        existing = touched_part(existing, df, partition)
    return df.join(existing.select(id_column), id_column, "left_anti").select(*df.columns)


def insert_once(
    df: DataFrame, path: str, id_column: str, partition: str | None = None
) -> int:
    """Append rows whose id is not in the ledger yet; return how many.

    A NULL or repeated id rejects the whole batch. It is checked, and the new rows are
    counted, in the one job that writes: a rejected batch fails it before it commits.
    Where the ledger is partitioned only the partitions the batch touches are read, so a
    daily append does not scan the whole history. Re-running a lost append inserts
    nothing twice.
    """
    fresh = unique_or_fail(df, [id_column], "insert batch")
    existing = read_if_exists(df.sparkSession, path)
    if existing is not None:
        fresh = not_yet_stored(fresh, existing, id_column, partition)
    seen = Observation()
    counted = fresh.observe(seen, F.count(F.lit(1)).alias("added"))
    _failing_as_value_error(lambda: write(counted, path, "append", [partition] if partition else ()))
    return seen.get["added"]


def upsert(
    df: DataFrame, path: str, key: str, update_matched: bool = True, partition: str | None = None
) -> None:
    """Insert new keys; on a match overwrite the fields the batch fills in.

    A NULL in the batch leaves the stored field as it is. With
    ``update_matched=False`` existing keys are left alone altogether.
    """
    if not update_matched:
        insert_once(df, path, key, partition)
        return
    df = unique_or_fail(df, [key], "upsert batch")
    existing = read_if_exists(df.sparkSession, path)
    if existing is None:
        _failing_as_value_error(lambda: write(df, path, "append", [partition] if partition else ()))
        return
    if partition is not None:
        existing = touched_part(existing, df, partition)
    merged = _failing_as_value_error(lambda: checkpointed(merge_rows(existing, df, key)))
    if partition is None:
        write(merged, path, "replace")
    else:
        overwrite_partitions(merged, path, partition)


def merge_rows(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Full-outer merge: batch values win unless they are NULL."""
    old, new = existing.alias("old"), batch.alias("new")
    columns = list(dict.fromkeys([*existing.columns, *batch.columns]))

    def pick(name: str):
        sides = [F.col(f"{a}.{name}") for a, d in (("new", batch), ("old", existing)) if name in d.columns]
        return F.coalesce(*sides).alias(name)

    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(
        *[pick(name) for name in columns]
    )


def export_run(
    published: DataFrame, run_id: str, version: int, path: str, fmt: str = "parquet"
) -> None:
    """Export one published version to CSV or Parquet shards; never overwrite."""
    if not RUN_ID.fullmatch(run_id):
        raise ValueError("run id must be 64 lowercase hex characters")
    if version < 1:
        raise ValueError("version must be at least 1")
    rows = published.filter(
        (F.col("forecast_run_id") == run_id) & (F.col("publication_version") == version)
    )
    if rows.isEmpty():
        raise ValueError("no published rows for that run and version")
    writer = rows.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt must be csv or parquet")

