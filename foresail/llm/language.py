"""Operator 1: language identification.

Every byte n-gram of a word with its borders is hashed to a row of an embedding table; a
text is the mean of its rows, and a linear softmax over it gives the language. Both are
trained together by stochastic gradient descent in numpy on a bounded labelled sample,
on whole texts and on short stretches of them. A part of the sample is held back: the
softmax's temperature and the score from which an answer is ``accepted`` are set on it.

For prediction table and softmax are multiplied out, so that a text's logits are means
of table rows over all n-grams of the whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0 and not
accepted; without any labelled row all texts are ``und``; ``lang_pred`` is otherwise a
learned language, also where it is not accepted. Repeated rows get the same result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm import textnum
from foresail.llm.common import bounded_batches, fold
from foresail.llm.training import labelled_sample

ROWS = 1 << 16
DIMENSIONS = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 400
SAMPLE = 4000  # texts in all; beyond ten languages each has an equal share of them
TRAIN_BYTES = 50_000
STRETCHES = 3
EPOCHS = 6
PRECISION = 0.99  # of accepted answers, on the held-back part

_FOLD = textnum.lower_ascii()
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def gram_rows(raw: np.ndarray, offsets: np.ndarray):
    """For each n: hashed table rows of the n-grams and the first byte of each."""
    byte = _FOLD[raw].astype(np.uint32)
    border = byte == 32
    row_end = np.zeros(len(raw) + 1, bool)
    row_end[offsets] = True
    ends = np.cumsum(row_end)[:-1]  # number of the row a byte belongs to, plus 1 and more
    for n in GRAMS:
        count = len(raw) - n + 1
        if count <= 0:
            continue
        ok = ends[:count] == ends[n - 1 :]
        value = np.full(count, n, np.uint32)
        for i in range(n):
            part = slice(i, i + count)
            value = value * np.uint32(0x01000193) ^ byte[part]
            if 0 < i < n - 1:
                ok &= ~border[part]
        ok &= ~(border[:count] & border[n - 1 :])
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(ok)
        yield (value[at] >> np.uint32(16)) & np.uint32(ROWS - 1), at


def counts(text: str):
    """Distinct table rows of a text and how often each occurs."""
    raw = np.frombuffer(text.encode(), np.uint8)
    found = [g for g, _ in gram_rows(raw, np.array([0, len(raw)]))] if len(raw) else []
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int),) * 2


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (ROWS, languages): embeddings times softmax, over temperature
    bias: np.ndarray
    threshold: float


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    languages = sorted({r[2] for r in rows})
    data = []
    for k, (_, text, lang) in enumerate(rows):
        texts = [text]
        for _ in range(STRETCHES):
            n = int(rng.integers(30, 250))
            at = int(rng.integers(0, max(1, len(text) - n)))
            texts.append(text[at : at + n])
        for t in texts:
            ids, times = counts(t)
            if len(ids):
                share = (times / times.sum()).astype(np.float32)
                data.append((ids, share, languages.index(lang), k % 5 == 0))
    table = rng.normal(0, 0.1, (ROWS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.5, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    learn = [d for d in data if not d[3]] or data
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)):
            ids, share, y, _ = learn[i]
            rate = 1.0 * (1 - step / steps)
            step += 1
            mean = share @ table[ids]
            error = softmax(mean @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            # each row's part of the mean is small: the step is taken per text
            table[ids] -= rate * 4 * np.outer(share / share.max(), back) / len(languages)
    logits = table @ weights
    held = [d for d in data if d[3]] or data
    raw = np.array([d[1] @ logits[d[0]] + bias for d in held])
    true = np.array([d[2] for d in held])
    grid = 2.0 ** np.arange(-4, 6.01, 0.5)
    loss = [-np.log(softmax(raw / t)[np.arange(len(true)), true] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    chance = softmax(raw / t)
    score, right = chance.max(1), chance.argmax(1) == true
    order = np.argsort(-score)
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precise >= PRECISION)
    threshold = float(score[order[good[-1]]]) if len(good) else 1.0
    return Model(languages, (logits / t).astype(np.float32), bias / t, threshold)


def predictions(model: Model, column: pa.Array):
    """(language index or -1, score) of each text of a column, over whole texts."""
    raw, offsets = textnum.bytes_of(column)
    width = len(model.languages)
    best, score = np.full(len(column), -1), np.zeros(len(column))
    for lo, hi in textnum.row_groups(offsets):
        total, grams = np.zeros((hi - lo, width)), np.zeros(hi - lo)
        # a row longer than the limit is taken in stretches; n-grams over a cut are
        # counted with the stretch that they begin in
        for at in range(offsets[lo], max(offsets[hi], offsets[lo] + 1), textnum.CHUNK):
            stop = min(offsets[hi], at + textnum.CHUNK)
            end = min(offsets[hi], stop + max(GRAMS) - 1)
            bounds = np.clip(offsets[lo : hi + 1], at, end) - at
            for ids, first in gram_rows(raw[at:end], bounds):
                keep = first < stop - at
                ids, first = ids[keep], first[keep]
                row = np.searchsorted(bounds, first, "right") - 1
                here = np.unique(row)
                if len(here):
                    starts = np.searchsorted(row, here, "left")
                    total[here] += np.add.reduceat(model.logits[ids], starts, dtype=np.float64)
                    grams[here] += np.diff(np.append(starts, len(row)))
        if width:
            some = grams > 0
            chance = softmax(total / np.maximum(grams, 1)[:, None] + model.bias)
            best[lo:hi] = np.where(some, chance.argmax(1), 0)
            score[lo:hi] = np.where(some, chance.max(1), 0.0)
    return best, score


def learn(docs: DataFrame) -> Model:
    """Train on (doc_id, text, lang) rows."""
    labels = docs.where("lang is not null").select("doc_id", F.col("lang").alias("label"))
    languages = labels.select("label").distinct().count()
    share = max(1, min(PER_LANGUAGE, SAMPLE // max(1, languages)))
    rows = labelled_sample(docs.select("doc_id", "text"), labels, share, TRAIN_BYTES)
    if not rows:
        return Model([], np.zeros((ROWS, 0), np.float32), np.zeros(0), 1.0)
    return train(rows)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)  # ROWS * languages floats

    def predicted(batches):
        model = sent.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            best, score = predictions(model, batch.column(1))
            letter = np.array(batch.column(2).to_pylist(), bool)
            best = np.where(letter, best, -1)
            score = np.where(best >= 0, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(score),
                    pa.array((best >= 0) & (score >= model.threshold)),
                ],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        predicted, f"doc_id {kind}, lang_pred string, score double, accepted boolean"
    )


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, lang) outside the held-out fold and
    predict for all: doc_id, held_out, lang_pred, score, accepted."""
    model = learn(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    out = identify(docs, model)
    return out.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted"
    )
