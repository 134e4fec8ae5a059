"""Frames of many series in one pass over sorted batches.

``rolled`` brings the rows of a series together with one exchange, sorts them, and works
out every frame column of a batch with shifted arrays. It follows the same blocks as
``features.window_states`` (only added, never subtracted), without a row copy for every
step. A batch holds whole series; the one that a batch ends in waits for the next batch,
so no more than a batch and a series are held.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values, one dict per step: window -> (block, number of blocks, tail).
BLOCK_STEPS = (
    {14: (7, 2, None), 28: (7, 4, None), 30: (7, 4, 2)},
    {60: (30, 2, None), 90: (30, 3, None)},
    {180: (90, 2, None), 270: (90, 3, None), 360: (90, 4, None)},
)
BASE_BLOCKS = (1, 2, 3, 7)


def blocks_for(ns: Sequence[int]) -> set[int]:
    """Every window length that has to exist to build the lengths ``ns``."""
    wanted = set(ns)
    for step in reversed(BLOCK_STEPS):
        for n in [n for n in step if n in wanted]:
            block, _, tail = step[n]
            wanted |= {block} | ({tail} if tail else set())
    return wanted


@dataclass(frozen=True)
class Roll:
    """One column: ``kind`` of ``column`` over ``n`` rows or days.

    sum, avg, stddev: the last ``n`` rows, the current one included; next: the ``n`` rows
    after it; prior: the ``n`` rows before the last ``n``; row: the value ``n`` rows on;
    day: the value ``n`` days on; days: the sum of the next ``n`` days.
    """

    name: str
    kind: str
    column: str
    n: int


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


class Block:
    """Whole series, in order, as arrays."""

    def __init__(self, series: np.ndarray, day: np.ndarray, undated: np.ndarray):
        size = len(series)
        first = np.r_[True, series[1:] != series[:-1]]
        starts = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        self.at = np.arange(size) - starts[number]
        self.left = np.r_[starts[1:], size][number] - 1 - np.arange(size)
        self.undated = undated
        self.code = (number.astype(np.int64) << 33) + np.where(undated, -(1 << 31), day.astype(np.int64))

    def shifted(self, a: np.ndarray, rows: int) -> np.ndarray:
        """``a`` as it was ``rows`` rows ago (ahead, if negative); 0 outside the series."""
        if rows == 0:
            return a
        out, k = np.zeros_like(a), abs(rows)
        if k < len(a):
            if rows > 0:
                out[k:] = a[:-k]
            else:
                out[:-k] = a[k:]
            out[(self.at if rows > 0 else self.left) < k] = 0
        return out

    def states(self, x: np.ndarray, known: np.ndarray, ns: Sequence[int], spread: bool, forward: bool = False) -> dict:
        """Window length to (count, sum, squared deviation)."""
        wanted, out = blocks_for(ns), {}
        way = -1 if forward else 1
        for n in [n for n in BASE_BLOCKS if n in wanted]:
            offsets = range(-1, -n - 1, -1) if forward else range(n - 1, -1, -1)
            parts = [(self.shifted(known, k), self.shifted(x, k)) for k in offsets]
            count, total = sum(p[0] for p in parts), sum(p[1] for p in parts)
            mean = ratio(total, count)
            out[n] = (count, total, sum(c * (v - mean) ** 2 for c, v in parts) if spread else None)
        for step in BLOCK_STEPS:
            for n, (block, times, tail) in step.items():
                if n not in wanted:
                    continue
                moves = [(block, k * block) for k in range(times)] + ([(tail, times * block)] if tail else [])
                parts = [[a if a is None else self.shifted(a, way * k) for a in out[b]] for b, k in moves]
                count, total, off = sum(p[0] for p in parts), sum(p[1] for p in parts), None
                if spread:
                    mean = ratio(total, count)
                    off = sum(p[2] for p in parts) + sum(p[0] * (ratio(p[1], p[0]) - mean) ** 2 for p in parts)
                out[n] = (count, total, off)
        return out

    def between(self, x: np.ndarray, known: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(count, sum) over the days from ``low`` to ``high`` days on; rows without a date
        are their own neighbours."""
        a = np.searchsorted(self.code, np.where(self.undated, self.code, self.code + low), "left")
        b = np.searchsorted(self.code, np.where(self.undated, self.code, self.code + high), "right")
        count, total = np.zeros(len(x)), np.zeros(len(x))
        for k in range(int((b - a).max(initial=0))):
            there = a + k < b
            where = np.where(there, a + k, 0)
            count += np.where(there, known[where], 0.0)
            total += np.where(there, x[where], 0.0)
        return count, total

    def columns(self, values: dict[str, tuple[np.ndarray, np.ndarray]], rolls: Sequence[Roll]) -> Iterator[pa.Array]:
        behind, ahead = {}, {}
        for c, (x, known) in values.items():
            last = {r.n for r in rolls if r.column == c and r.kind in ("sum", "avg", "stddev", "prior")}
            following = {r.n for r in rolls if r.column == c and r.kind == "next"}
            deviates = any(r.kind == "stddev" for r in rolls if r.column == c)
            behind[c] = self.states(x, known, last, deviates)
            ahead[c] = self.states(x, known, following, False, forward=True)
        for r in rolls:
            x, known = values[r.column]
            if r.kind == "next":
                count, out, _ = ahead[r.column][r.n]
            elif r.kind == "row":
                count, out = self.shifted(known, -r.n), self.shifted(x, -r.n)
            elif r.kind in ("day", "days"):
                count, out = self.between(x, known, r.n if r.kind == "day" else 1, r.n)
            else:
                count, out, off = behind[r.column][r.n]
                if r.kind == "avg":
                    out = ratio(out, count)
                elif r.kind == "prior":
                    count, out = self.shifted(count, r.n), self.shifted(out, r.n)
                elif r.kind == "stddev":
                    count = count - 1
                    out = np.sqrt(ratio(off, count))
            yield pa.array(out, mask=count <= 0)


def whole_series(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 0
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches regrouped so that none ends inside a series and all but the last have
    ``least`` rows, with a number that changes from one series to the next."""
    waiting: list[pa.Table] = []
    held = 0

    def numbered(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            codes = pc.dictionary_encode(t[k].combine_chunks(), null_encoding="encode")
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            codes = codes.indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        # only the last row waiting is needed to see where its series ends
        t = pa.Table.from_batches([batch])
        seen = numbered(pa.concat_tables([waiting[-1].slice(waiting[-1].num_rows - 1), t]) if waiting else t)
        seen = seen[1:] if waiting else seen
        rest = int(np.searchsorted(seen, seen[-1])) if seen[-1] > 0 else 0
        if seen[-1] > 0 and held + rest >= least:
            done = pa.concat_tables([*waiting, t.slice(0, rest)]).combine_chunks()
            yield done, numbered(done)
            waiting, held, t = [], 0, t.slice(rest)
        waiting.append(t)
        held += t.num_rows
    if waiting:
        done = pa.concat_tables(waiting).combine_chunks()
        yield done, numbered(done)


def rolled(df: DataFrame, keys: Sequence[str], day: str, rolls: Sequence[Roll], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns ``rolls``, doubles, over series of ``keys`` in order of the
    number ``day``. Without ``keys`` all rows are one series. ``by`` names the keys that
    the rows are already brought together by, in whole."""
    keys, rolls, read = list(keys), list(rolls), sorted({r.column for r in rolls})
    if not by:
        df = df.repartition(*keys) if keys else df.coalesce(1)
    df = df.sortWithinPartitions(*keys, day)

    def run(batches):
        for t, series in whole_series(batches, keys):
            days = t[day].combine_chunks()
            block = Block(series, days.fill_null(0).to_numpy(zero_copy_only=False), days.is_null().to_numpy(zero_copy_only=False))
            values = {}
            for c in read:
                held = t[c].combine_chunks().cast(pa.float64())
                known = held.is_valid().to_numpy(zero_copy_only=False).astype(float)
                values[c] = (held.fill_null(0.0).to_numpy(zero_copy_only=False), known)
            with np.errstate(all="ignore"):
                made = list(block.columns(values, rolls))
            out = pa.Table.from_arrays([*t.columns, *made], names=[*t.column_names, *[r.name for r in rolls]])
            yield from out.to_batches(max_chunksize=10_000)

    schema = T.StructType([*df.schema.fields, *[T.StructField(r.name, T.DoubleType()) for r in rolls]])
    return df.mapInArrow(run, schema)
