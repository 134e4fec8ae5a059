"""Operator 9: quality classifier, a byte-level convolutional network in numpy.

A text's bytes are cut into chunks that overlap by a filter's width less one, so every
window of bytes of the whole text lies in one chunk. Filters read the bytes one-hot, so
a filter is a table of weights by place and byte. Each filter is max-pooled over each
chunk; the mean, least and largest of a filter's pooled values over all chunks of the
text go into one logistic unit. Filters and unit are trained together by gradient
descent (Adam) on a bounded labelled sample and on short stretches of its good texts.

Defined results: a null or empty text is one empty chunk and gets a score too; without
labelled rows of both classes every score is 1 (nothing can be rejected). Repeated rows get
the same score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm import textnum
from foresail.llm.common import bounded_batches, fold, fresh
from foresail.llm.training import labelled_sample

FILTERS = 24
WIDTH = 5
CHUNK = 512  # windows a chunk
PAD = 256
PER_LABEL = 1500
TRAIN_BYTES = 60_000
EPOCHS = 8
BATCH = 24
SHORT = 2  # stretches of each good text
KEEP = 2.0  # a good text lost costs so many times a poor one kept
THRESHOLD = 0.7
SEED = 9


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 257, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (3 * FILTERS,)
    bias: float


def chunk_starts(size: int) -> np.ndarray:
    return np.arange(0, max(1, size - WIDTH + 1), CHUNK)


def chunk_matrix(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Bytes of each chunk, padded after its row's end, and its number of windows."""
    at = starts[:, None] + np.arange(CHUNK + WIDTH - 1)
    inside = at < ends[:, None]
    data = np.full(at.shape, PAD, np.int16)
    data[inside] = raw[at[inside]]
    windows = np.clip(ends - starts - WIDTH + 1, 1, CHUNK)
    return data, windows


def convolved(net: Network, data: np.ndarray) -> np.ndarray:
    out = net.filters[0][data[:, :CHUNK]]
    for i in range(1, WIDTH):
        out += net.filters[i][data[:, i : i + CHUNK]]
    return out


def pooled(net: Network, data: np.ndarray, windows: np.ndarray, places: bool = False):
    """Largest value of each filter over a chunk's windows, rectified."""
    out = convolved(net, data)
    short = np.flatnonzero(windows < CHUNK)
    for i in short:
        out[i, windows[i] :] = -np.inf
    top = out.max(axis=1) + net.shift
    value = np.maximum(top, 0)
    return (value, top, out.argmax(axis=1)) if places else value


def combined(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean, least and largest over the chunks of each text; ``starts``: first chunks."""
    sizes = np.diff(np.append(starts, len(value)))
    return np.hstack(
        [
            np.add.reduceat(value, starts) / sizes[:, None],
            np.minimum.reduceat(value, starts),
            np.maximum.reduceat(value, starts),
        ]
    )


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def stretches(rows: list, rng) -> list:
    """Short stretches of good texts, cut at blanks, so that a short text is not
    taken for a poor one; a stretch of a poor text may well be good, so none of those."""
    out = []
    for i, text, label in rows:
        words = (text or "").split(" ") if label == 1 else []
        for _ in range(SHORT if len(words) > 3 else 0):
            n = int(3 * (len(words) / 3) ** rng.uniform(0, 0.6))
            at = int(rng.integers(0, len(words) - n + 1))
            out.append((i, " ".join(words[at : at + n]), 1))
    return out


def train(rows: list, seed: int = SEED) -> Network:
    """``rows``: (id, text, label 0 or 1)."""
    rng = np.random.default_rng(seed)
    rows = rows + stretches(rows, rng)
    net = Network(
        rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32),
        0.0,
    )
    labels = np.array([r[2] for r in rows], np.float64)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    importance = np.where(labels == 1, KEEP * 0.5 / share, 0.5 / (1 - share))
    texts = [np.frombuffer((r[1] or "").encode(), np.uint8) for r in rows]
    places = []
    for t in texts:
        places.append(chunk_starts(len(t)))
    params = {"filters": net.filters, "shift": net.shift, "weights": net.weights, "bias": np.zeros(1)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    total, step = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            pick = order[lo : lo + BATCH]
            data, windows = [], []
            for i in pick:
                d, w = chunk_matrix(texts[i], places[i], np.full(len(places[i]), len(texts[i])))
                data.append(d)
                windows.append(w)
            first = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]])
            sizes = np.array([len(d) for d in data])
            data, windows = np.concatenate(data), np.concatenate(windows)
            value, top, where = pooled(net, data, windows, places=True)
            features = combined(value, first)
            p = sigmoid(features @ net.weights + params["bias"][0])
            error = (p - labels[pick]) * importance[pick] / len(pick)
            grads = {
                "weights": (features.T @ error + 1e-4 * net.weights).astype(np.float32),
                "bias": np.array([error.sum()]),
            }
            back = error[:, None] * net.weights[None, :]
            owner = np.repeat(np.arange(len(pick)), sizes)
            mean, least, most = np.split(back, 3, axis=1)
            low, high = features[:, FILTERS : 2 * FILTERS], features[:, 2 * FILTERS :]
            g = mean[owner] / sizes[owner][:, None]
            g = g + least[owner] * (value == low[owner]) + most[owner] * (value == high[owner])
            g = np.where(top > 0, g, 0.1 * g)  # a small slope below 0 keeps filters alive
            grads["shift"] = g.sum(0).astype(np.float32)
            grad = np.zeros_like(net.filters)
            row, col = np.arange(len(data))[:, None], np.arange(FILTERS)[None, :]
            for i in range(WIDTH):
                np.add.at(grad[i], (data[row, where + i], col), g)
            grads["filters"] = grad
            step += 1
            rate = 0.01 * (1 - step / (total + 1))
            for k, v in params.items():
                m, s = moments[k]
                m += 0.1 * (grads[k] - m)
                s += 0.01 * (grads[k] ** 2 - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(v.dtype)
            net.bias = float(params["bias"][0])
    return net


def scores(net: Network, column: pa.Array, chunks: int = 512) -> np.ndarray:
    """One probability for each text of a column, from all of its bytes."""
    raw, offsets = textnum.bytes_of(column)
    sizes = np.diff(offsets)
    per_row = [chunk_starts(n) for n in sizes]
    first = np.concatenate([[0], np.cumsum([len(s) for s in per_row])])
    starts = np.concatenate([s + o for s, o in zip(per_row, offsets, strict=False)]) if len(sizes) else []
    ends = np.repeat(offsets[1:], np.diff(first))
    value = np.empty((first[-1], FILTERS), np.float32)
    for lo in range(0, first[-1], chunks):
        part = slice(lo, lo + chunks)
        value[part] = pooled(net, *chunk_matrix(raw, starts[part], ends[part]))
    if not len(sizes):
        return np.zeros(0)
    return sigmoid(combined(value, first[:-1]).astype(np.float64) @ net.weights + net.bias)


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Train on documents (doc_id, text) with labels (doc_id, label 0 or 1)."""
    rows = labelled_sample(docs, labels.where("label in (0, 1)"), PER_LABEL, TRAIN_BYTES)
    return train(rows) if len({r[2] for r in rows}) == 2 else None


def classify(docs: DataFrame, net: Network | None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, text_key, score: one row per input row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
    )
    if net is None:
        return rows.select("doc_id", "text_key", F.lit(1.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores(sent.value, batch.column(1)))],
                ["doc_id", "text_key", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, text_key long, score double")


def training_labels(labels: DataFrame, column: str, parts: int, held: int) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), parts) != held).select(
        "doc_id", F.col(column).alias("label")
    )


def quality(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Learn from labels (doc_id, quality) outside the held-out fold, whose texts are in
    ``source`` (``docs`` if none), and score all rows of ``docs``: doc_id, held_out,
    score, predicted, text_key."""
    texts = (docs if source is None else source).select("doc_id", "text")
    net = learn(texts, training_labels(labels, "quality", 4, 2))
    return classify(docs, net).select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "text_key",
    )


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without those predicted to be of low quality."""
    gone = quality(docs, labels).where("predicted = 0")
    did, key = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    gone = gone.select(F.col("doc_id").alias(did), F.col("text_key").alias(key)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(did)) & (F.xxhash64("text") == F.col(key))
    return docs.join(gone, same, "left_anti")
