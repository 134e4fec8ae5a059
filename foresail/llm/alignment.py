"""Operator 12: alignment of two tokenizers by inverted pair bitmaps.

A text is encoded as a blank and the text by tokenizer A and as the text by tokenizer B,
which adds the blank itself. Byte offsets where tokens of both end cut the tokens into
groups; tokens whose byte ranges overlap are linked. The count of a pair of ids is the
number of links of the whole corpus that hold it.

* Documents of a task are numbered in blocks of BLOCK. A block keeps, for each pair, the
  bitmap of its documents and multiplicity planes: plane k is the bitmap of documents in
  which the pair's links less one have bit k. The bits of its documents are OR-merged when
  a block is full, for all pairs at once; a bitmap is a sorted list of positions or, if
  that is longer, a bit set.
* Popcounts give a pair's documents and, weighted by plane, its links in the block;
  blocks hold different documents, so their counts are added, map-side first.
* Scores (a pair's count, whether it is the highest of its B id) go back to every block
  by the keys of its postings only; the postings of the block turn them into sums a
  document. Texts are read and encoded once, and no row holds a link.

Both tokenizers treat the parts of a text apart if it is cut at a single blank between
two characters that are neither white space nor the marker, as no token reaches over
such a blank (for B that is looked up in the vocabulary; if a piece has an inner marker,
texts are not cut). Parts that return are aligned once.

Defined results: a null or empty text, and one of which the joined bytes of A's or B's
tokens differ from the blank and the text, has no tokens: zeros and an empty
``groups_sha256``. Repeated rows and rows that share an id count each; null ids are
kept. Ties for the highest count all count as best. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm.common import bounded_batches, written
from foresail.llm.vectors import numbers

BLOCK = 4096  # documents a block, at most
BLOCK_POSTINGS = 1_500_000  # (document, pair) entries after which a block is closed
KEPT = 200_000_000  # estimated bytes of aligned parts that a worker keeps
LEARNED = 1 << 19  # characters of new parts aligned together
MARK = "▁"
CUT = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

BLOCKS = (
    "block long, doc_id array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, groups_sha256 array<string>, pair array<long>, docs array<binary>, "
    "planes array<array<binary>>, pair_docs array<long>, pair_links array<long>"
)
ALIGNED = (
    "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1
    characters stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Both tokenizers: ids of texts, and the bytes of ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        as_byte = byte_characters()
        self.bytes_a = {
            i: bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
            for token, i in self.a.get_vocab(with_added_tokens=True).items()
        }
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = []
        for piece in pieces:
            byte = BYTE_PIECE.fullmatch(piece)
            self.bytes_b.append(
                bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode()
            )
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)

    def encoded(self, texts: list[str]):
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return ids_a, self.b.encode(texts, num_threads=1)


def _joined(bytes_of, ids) -> bytes:
    return b"".join(map(bytes_of.__getitem__, ids))


class Aligner:
    """Aligned parts of texts, kept by part."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        n_a = max(tokens.bytes_a) + 1
        self.length_a = np.zeros(n_a, np.int64)
        for i, data in tokens.bytes_a.items():
            self.length_a[i] = len(data)
        self.length_b = np.array([len(x) for x in tokens.bytes_b], np.int64)
        # ids as text with what follows them: within a group, at the end of its A or B half
        as_text = [f"{i}{end}" for n, ends in ((n_a, ",|"), (len(self.length_b), ",;")) for end in ends for i in range(n)]
        self.as_text = np.array(as_text, object)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.good = np.zeros(0, bool)
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links of a part
        self.first = np.zeros(0, np.int64)  # of a part's links in ``links``
        self.links = np.zeros(0, np.int64)
        self.kept = 0

    def parts(self, text: str) -> list[str]:
        if not self.tokens.cuts:
            return [text]
        words = text.split()
        if MARK not in text and " ".join(words) == text:
            return words
        return CUT.split(text)

    def _ends(self, ids: list[list[int]], length, bytes_of, data: list[bytes], base):
        """Tokens, their parts and ends over all parts, and the parts they spell."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        part = np.repeat(np.arange(len(ids)), counts)
        ends = np.cumsum(length[flat])
        total = np.bincount(part, weights=length[flat], minlength=len(ids)).astype(np.int64)
        good = total == np.fromiter(map(len, data), np.int64, len(data))
        if not good.all() or _joined(bytes_of, flat.tolist()) != b"".join(data):
            good = np.array([_joined(bytes_of, own) == text for own, text in zip(ids, data, strict=True)], bool)
        ends += np.repeat(base - (np.cumsum(total) - total), counts)
        return flat, part, ends, counts, good

    def learn(self, parts: list[str]) -> None:
        """Align new parts, all of them at once: a link is a stretch between two ends of
        either tokenizer, a group one between two ends of both."""
        tokens = self.tokens
        ids_a, ids_b = tokens.encoded(parts)
        data = [b" " + p.encode() for p in parts]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        base = np.cumsum(sizes) - sizes
        a, part_a, end_a, n_a, good_a = self._ends(ids_a, self.length_a, tokens.bytes_a, data, base)
        b, part_b, end_b, n_b, good_b = self._ends(ids_b, self.length_b, tokens.bytes_b, data, base)
        good = good_a & good_b
        if not good.all():
            keep_a, keep_b = good[part_a], good[part_b]
            a, part_a, end_a = a[keep_a], part_a[keep_a], end_a[keep_a]
            b, part_b, end_b = b[keep_b], part_b[keep_b], end_b[keep_b]
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        common = end_a[last_a]
        stretches = np.union1d(end_a, end_b)
        in_a, in_b = np.searchsorted(end_a, stretches), np.searchsorted(end_b, stretches)
        n = len(parts)
        n_groups = np.bincount(part_a[last_a], minlength=n)
        n_links = np.bincount(part_a[in_a], minlength=n)
        # the groups as text: A's ids of a group, then B's
        half = np.concatenate([2 * np.searchsorted(common, end_a), 2 * np.searchsorted(common, end_b) + 1])
        at_b = 2 * len(self.length_a)
        which = np.concatenate([a + last_a * len(self.length_a), at_b + b + last_b * len(self.length_b)])
        words = self.as_text[which[np.argsort(half, kind="stable")]].tolist()
        stop = np.cumsum(np.where(good, n_a + n_b, 0)).tolist()
        texts = ["".join(words[lo:hi])[:-1] for lo, hi in zip([0, *stop], stop)]

        self.known.update(zip(parts, range(len(self.text), len(self.text) + n)))
        self.text += texts
        self.good = np.concatenate([self.good, good])
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.first = np.concatenate([self.first, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, (a[in_a] << 32) | b[in_b]])
        self.kept += 300 * n + int(sizes.sum()) + sum(map(len, texts)) + 8 * len(in_a)

    def documents(self, texts: list[str]):
        """(sizes, sha256, pairs, links of each pair) of every text."""
        if self.kept > KEPT:
            self.forget()
        rows = [self.parts(t) if t else [] for t in texts]
        known = self.known
        new = list({p for parts in rows for p in parts if p not in known})
        lo = 0
        while lo < len(new):  # some text at a time: encodings take much more room
            hi, size = lo, 0
            while hi < len(new) and (hi == lo or size + len(new[hi]) <= LEARNED):
                size += len(new[hi])
                hi += 1
            self.learn(new[lo:hi])
            lo = hi
        none = (np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        for parts in rows:
            at = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
            if not len(at) or not self.good[at].all():
                yield none
                continue
            text = ";".join(map(self.text.__getitem__, at.tolist()))
            links = self.sizes[at, 3]
            spots = np.repeat(self.first[at] - (np.cumsum(links) - links), links) + np.arange(links.sum())
            pairs, times = np.unique(self.links[spots], return_counts=True)
            yield self.sizes[at].sum(0), hashlib.sha256(text.encode()).hexdigest(), pairs, times


def packed(positions: np.ndarray) -> bytes:
    """A bitmap of sorted positions below BLOCK, in the shorter of two forms."""
    if 2 * len(positions) < BLOCK // 8:
        return positions.astype(np.uint16).tobytes()
    bits = np.zeros(BLOCK, bool)
    bits[positions] = True
    return np.packbits(bits).tobytes()


def positions(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < BLOCK // 8:
        return np.frombuffer(bitmap, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))


def popcount(bitmap: bytes) -> int:
    if len(bitmap) < BLOCK // 8:
        return len(bitmap) // 2
    return int(np.bitwise_count(np.frombuffer(bitmap, np.uint8)).sum(dtype=np.int64))


class Block:
    """Documents of a block and the postings of their pairs."""

    def __init__(self):
        self.ids, self.sizes, self.sha = [], [], []
        self.pairs, self.links, self.postings = [], [], 0

    def add(self, doc_id, sizes, sha, pairs, links) -> None:
        self.ids.append(doc_id)
        self.sizes.append(sizes)
        self.sha.append(sha)
        self.pairs.append(pairs)
        self.links.append(links)
        self.postings += len(pairs)

    @property
    def full(self) -> bool:
        return len(self.ids) >= BLOCK or self.postings >= BLOCK_POSTINGS

    def bitmaps(self):
        """pair, bitmap, planes of all pairs: the OR of the documents' single bits."""
        docs = np.repeat(np.arange(len(self.pairs)), [len(p) for p in self.pairs])
        pairs, links = np.concatenate(self.pairs), np.concatenate(self.links)
        order = np.argsort(pairs, kind="stable")  # documents stay in order
        pairs, docs, more = pairs[order], docs[order].astype(np.uint16), links[order] - 1
        codes, first = np.unique(pairs, return_index=True)
        bounds = np.append(first, len(pairs)).tolist()
        maps = [packed(docs[lo:hi]) for lo, hi in zip(bounds, bounds[1:])]
        planes: list[list[bytes]] = [[] for _ in codes]
        for k in range(int(more.max(initial=0)).bit_length()):
            on = (more >> k) & 1 == 1
            upper = np.flatnonzero(more >> k > 0)  # pairs with this plane or a higher one
            some = np.unique(np.searchsorted(codes, pairs[upper]))
            lo = np.searchsorted(pairs[on], codes[some], "left").tolist()
            hi = np.searchsorted(pairs[on], codes[some], "right").tolist()
            of_plane = docs[on]
            for i, a, b in zip(some.tolist(), lo, hi):
                planes[i].append(packed(of_plane[a:b]))
        return codes, maps, planes

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        codes, maps, planes = self.bitmaps()
        n_docs = [popcount(m) for m in maps]
        n_links = [n + sum(popcount(p) << k for k, p in enumerate(own)) for n, own in zip(n_docs, planes)]
        sizes = np.array(self.sizes, np.int64).reshape(-1, 4)
        longs = pa.list_(pa.int64())
        columns = [
            pa.array([number], pa.int64()),
            pa.array([self.ids], pa.list_(kind)),
            *(pa.array([sizes[:, i]], longs) for i in range(4)),
            pa.array([self.sha], pa.list_(pa.string())),
            pa.array([codes], longs),
            pa.array([maps], pa.list_(pa.binary())),
            pa.array([planes], pa.list_(pa.list_(pa.binary()))),
            pa.array([n_docs], longs),
            pa.array([n_links], longs),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])


_aligners: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(Tokens(path_a, path_b))
    return _aligners[key]


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """The inverted index: one row a block, written once."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.spark_partition_id().alias("task"))

    def indexed(batches):
        number, block, kind = 0, Block(), None
        for batch in batches:
            kind = batch.column(0).type
            if not number:
                number = batch.column(2)[0].as_py() << 32
            texts = batch.column(1).to_pylist()
            ids = batch.column(0).to_pylist()
            for doc_id, found in zip(ids, aligner(path_a, path_b).documents(texts), strict=True):
                block.add(doc_id, *found)
                if block.full:
                    yield block.row(number, kind)
                    number, block = number + 1, Block()
        if block.ids:
            yield block.row(number, kind)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(indexed, BLOCKS.format(id=kind)), "pair-blocks")


def pair_counts(index: DataFrame) -> DataFrame:
    """pair, n_docs, n_links over the corpus. A pair is A's id times 2**32 plus B's."""
    rows = index.select(F.explode(F.arrays_zip("pair", "pair_docs", "pair_links")).alias("p"))
    return rows.groupBy(F.col("p.pair").alias("pair")).agg(
        F.sum("p.pair_docs").alias("n_docs"), F.sum("p.pair_links").alias("n_links")
    )


def pair_scores(counts: DataFrame) -> DataFrame:
    """pair, n_links and whether that is the highest of its B id."""
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    top = counts.groupBy("b").agg(F.max("n_links").alias("top"))
    return counts.join(top, "b").select("pair", "n_links", (F.col("n_links") == F.col("top")).alias("best"))


def _summed(keys, index, scores):
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    block = index.combine_chunks().to_batches()[0]
    column = lambda name: block.column(block.schema.names.index(name))
    n = len(column("doc_id").flatten())
    pair = numbers(column("pair").flatten())
    order = np.argsort(numbers(scores["pair"]))
    at = order[np.searchsorted(numbers(scores["pair"]), pair, sorter=order)] if len(pair) else order[:0]
    count = numbers(scores["score"])[at]
    best = numbers(scores["best"])[at].astype(bool)
    n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def added(which, bitmaps, weight):
        of = [positions(b) for b in bitmaps]
        owners = np.repeat(which, [len(x) for x in of])
        docs = np.concatenate(of).astype(np.int64) if of else np.zeros(0, np.int64)
        np.add.at(count_sum, docs, count[owners] * weight)
        np.add.at(n_best, docs[best[owners]], weight)

    added(np.arange(len(pair)), column("docs").flatten().to_pylist(), 1)
    planes = column("planes").flatten().to_pylist()
    for k in range(max(map(len, planes), default=0)):
        which = [i for i, own in enumerate(planes) if len(own) > k]
        added(np.array(which), [planes[i][k] for i in which], 1 << k)
    out = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    return pa.table({c: out[c] if c in out else column(c).flatten() for c in names})


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. The paths
    name a tokenizers file (byte-level) and a sentencepiece model, at the same place on
    every executor."""
    index = blocks(docs, path_a, path_b, id_col, text_col)
    scores = pair_scores(pair_counts(index))
    keys = index.select("block", F.explode("pair").alias("pair"))
    scored = keys.join(scores, "pair").select("block", "pair", "n_links", "best")
    scored = scored.toDF("block", "pair", "score", "best")  # columns of their own
    kind = index.schema["doc_id"].dataType.elementType.simpleString()
    index = index.drop("pair_docs", "pair_links")
    return index.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(_summed, ALIGNED.format(id=kind))
