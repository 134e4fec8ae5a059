"""Streaming appends and running state over event ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foresail.sources.writers import insert_once


def stream_insert_once(
    stream: DataFrame,
    path: str,
    id_column: str,
    checkpoint: str,
    partition: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append each event once, across batches, restarts and late repeats.

    No state and no watermark: an event that arrives late for the first time is
    stored, however late it is. Repeats within a batch are dropped there; the
    anti-join of ``insert_once`` covers those of earlier batches and a batch
    that is replayed after a failure.
    """

    def append(batch: DataFrame, _: int) -> None:
        insert_once(batch.dropDuplicates([id_column]), path, id_column, partition)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_latest(stream: DataFrame, keys: Sequence[str], ts: str, tie: str | None = None) -> DataFrame:
    """Running latest event per key; write it in ``update`` mode.

    The state is one row per key. The same plan works on a batch frame.
    """
    order = F.struct(ts, tie) if tie else F.struct(ts)
    newest = F.max_by(F.struct("*"), order).alias("_latest")
    return stream.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(newest).select("_latest.*")
