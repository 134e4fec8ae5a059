"""Words of whole Arrow columns as numbers, in numpy and a few MB at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once; a single longer word is taken whole.
CHUNK = 1 << 21
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_powers: dict[str, np.ndarray] = {}


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def row_groups(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``limit`` bytes at most, or of one row that is longer."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n``."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece(raw: np.ndarray, breaks: np.ndarray, separator: np.ndarray, folded: np.ndarray):
    """Hashes and first bytes of the words of ``raw``; a row begins at each of ``breaks``."""
    inside = ~separator[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] |= inside[breaks]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = breaks[breaks > 0] - 1
    last[before] |= inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((folded[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    value = (sums[ends + 1] - sums[starts]) * down[starts]
    return mixed(value ^ ((ends - starts + 1).astype(np.uint64) << np.uint64(56))), starts


def hashed_words(raw, offsets, separator, folded, limit: int = CHUNK):
    """64-bit hash and row of every word, in order. ``separator`` and ``folded`` are
    tables over byte values; separators must be ASCII. Rows longer than ``limit`` are
    cut between words, so the work space stays a multiple of it."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, rows, at, end = [], [], 0, len(raw)
    while at < end:
        stop = min(end, at + limit)
        if stop < end:
            cut = np.flatnonzero(separator[raw[at:stop]])
            row_cut = offsets[np.searchsorted(offsets, stop, "right") - 1]
            best = max(row_cut, at + cut[-1] + 1 if len(cut) else 0)
            if best > at:
                stop = int(best)
            else:
                step = stop
                while step < end and not separator[raw[step]] and step not in offsets:
                    step += 1
                stop = step
        lo, hi = np.searchsorted(offsets, at, "left"), np.searchsorted(offsets, stop, "left")
        breaks = np.unique(offsets[lo:hi] - at)
        found, starts = _piece(raw[at:stop], breaks, separator, folded)
        hashes.append(found)
        rows.append(np.searchsorted(offsets, starts + at, "right") - 1)
        at = stop
    return np.concatenate(hashes), np.concatenate(rows)


def table(of: str | bytes) -> np.ndarray:
    marks = np.zeros(256, bool)
    marks[np.frombuffer(of.encode() if isinstance(of, str) else of, np.uint8)] = True
    return marks


def lower_ascii() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold
