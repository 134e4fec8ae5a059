"""Operator 3: encoding and decoding with a unigram model of pieces.

A text is turned into pieces with the largest sum of log scores (Viterbi), looked up in
a double-array trie over UTF-8 bytes. Blanks become white-space markers, one more marker
goes before a text that is not empty; a character that is no piece becomes one byte
piece per byte. Decoding puts the pieces' bytes together, turns markers into blanks and
takes the first one away.

The trained vocabulary names its pieces in order of rank; a piece's log score follows
from it by Zipf's law, log(1 / (rank + ZIPF)). Byte pieces score UNKNOWN below the least.
Of equally good ways the one whose last piece is longest wins.

No piece has a marker or a line end after another character (looked up in the
vocabulary), so the best way through a text is that through its words one after the
other, and a worker keeps the ways of words that return.

Defined results: a null or empty text has no pieces and decodes to an empty text; a
marker character in a text decodes as a blank, so ``round_trip`` is false there, and
true for every other text; repeated rows are encoded each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm.common import bounded_batches

MARK = "▁"
ZIPF = 10.0
UNKNOWN = 10.0
KEPT_WORDS = 1_200_000  # about 250 MB a worker
KEPT_LENGTH = 100  # characters of a word whose way is kept
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class DoubleArray:
    """A trie in two arrays: child ``c`` of ``s`` is ``base[s] + c`` if its check is
    ``s``. Byte values count from 1; ``value`` is the piece that ends in a state."""

    def __init__(self, keys: dict[bytes, int]):
        children: dict[bytes, set[int]] = {}
        for key in keys:
            for i in range(len(key)):
                children.setdefault(key[:i], set()).add(key[i] + 1)
        size = 1 << 17
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        # places below ``start`` are nearly all taken and not tried again
        todo, start = deque([(b"", 0)]), 1
        while todo:
            prefix, state = todo.popleft()
            self.value[state] = keys.get(prefix, -1)
            codes = sorted(children.get(prefix, ()))
            if not codes:
                continue
            at, tried, taken = max(start, codes[0] + 1), 0, 0
            while True:
                if at + 257 > len(self.check):
                    grown = len(self.check)
                    self.base += [0] * grown
                    self.check += [-1] * grown
                    self.value += [-1] * grown
                tried += 1
                if self.check[at] >= 0:
                    taken += 1
                elif all(self.check[at - codes[0] + c] < 0 for c in codes):
                    break
                at += 1
            if taken >= 0.9 * tried:
                start = at
            base = at - codes[0]
            self.base[state] = base
            for c in codes:
                self.check[base + c] = state
                todo.append((prefix + bytes([c - 1]), base + c))
        self.check[0] = -1  # nothing leads back to the root
        for part in (self.base, self.check, self.value):
            part += [-1] * 257  # no look-up ends outside

    def matches(self, data: bytes, start: int):
        """(end, piece) of all pieces that begin at ``start``, shortest first."""
        base, check, value, state = self.base, self.check, self.value, 0
        for i in range(start, len(data)):
            at = base[state] + data[i] + 1
            if check[at] != state:
                return
            state = at
            if value[state] >= 0:
                yield i + 1, value[state]


class Pieces:
    """The vocabulary: pieces, log scores, trie, byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        """``pieces``: text and the vocabulary's own score (minus the rank), by id."""
        self.data: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.score: list[float] = []
        keys = {}
        for i, (text, score) in enumerate(pieces):
            found = BYTE_PIECE.fullmatch(text)
            control = text in ("<unk>", "<s>", "</s>")
            if found:
                self.byte_id[int(found[1], 16)] = i
            elif not control:
                keys[text.encode()] = i
            self.data.append(bytes([int(found[1], 16)]) if found else b"" if control else text.encode())
            self.score.append(-math.log(max(0.0, -score) + ZIPF))
        self.trie = DoubleArray(keys)
        self.longest = max(map(len, keys), default=0)
        least = min(s for s, d in zip(self.score, self.data, strict=True) if d)
        self.unknown = least - UNKNOWN
        inner = [t for t, _ in pieces if MARK in t.lstrip(MARK)]
        line = [t for t, _ in pieces if "\n" in t and t != "\n"]
        if inner:
            raise ValueError(f"pieces with an inner marker cannot be cut into words: {inner[:3]}")
        self.word = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if not line else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}

    def best(self, word: str) -> list[int]:
        data = word.encode()
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.score
        longest = self.longest
        low = -math.inf
        score, came, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        for start in range(n):
            here = score[start]
            if here == low:  # within a character, or after no piece's end
                continue
            lead = data[start]
            after = start + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            state, single = 0, False
            # the look-up of ``matches``, written out: most of the time goes here
            for end, byte in enumerate(data[start : start + longest], start + 1):
                at = base[state] + byte + 1
                if check[at] != state:
                    break
                state = at
                i = value[at]
                if i >= 0:
                    if end == after:
                        single = True
                    total = here + scores[i]
                    if total > score[end]:
                        score[end], came[end], piece[end] = total, start, i
            if not single and here + self.unknown > score[after]:
                score[after], came[after], piece[after] = here + self.unknown, start, -1
        out, end = [], n
        while end:
            start = came[end]
            if piece[end] < 0:
                out += [self.byte_id[b] for b in reversed(data[start:end])]
            else:
                out.append(piece[end])
            end = start
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known, words = self.known, self.word.findall(MARK + text.replace(" ", MARK))
        if len(known) > KEPT_WORDS:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = array("i", self.best(w)).tobytes()
                if len(w) <= KEPT_LENGTH:
                    known[w] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.data.__getitem__, ids))
        return data.decode("utf-8", "replace").replace(MARK, " ")[1:]


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


_held: dict[str, Pieces] = {}


def _shared(docs: DataFrame, pieces: list[tuple[str, float]]):
    """The pieces, sent to every executor once; each worker builds its trie once. A
    vocabulary is a few hundred thousand entries at most."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    key = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def keyed() -> Pieces:
        if key not in _held:
            _held.clear()
            _held[key] = Pieces(sent.value)
        return _held[key]

    return keyed


def encode(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, text, ids: one row per document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    model = _shared(docs, pieces)

    def encoded(batches):
        for batch in batches:
            ids = [model().encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))],
                ["doc_id", "text", "ids"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encoded, f"doc_id {kind}, text string, ids array<int>")


def decode(encoded: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """The rows of ``encode`` (doc_id, text, ids) with ``decoded`` added."""
    model = _shared(encoded, pieces)

    def decoded(batches):
        for batch in batches:
            texts = [model().decode(ids.values.to_pylist()) for ids in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"]
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "text", "ids").mapInArrow(
        decoded, f"doc_id {kind}, text string, ids array<int>, decoded string"
    )


def round_trips(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, round_trip: whether decoding gives the text again."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    model = _shared(docs, pieces)

    # both ways in one function: texts and ids cross to Python and back once
    def both(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [model().encode(t) for t in texts]
            same = [model().decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_tokens", "round_trip"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(both, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")
