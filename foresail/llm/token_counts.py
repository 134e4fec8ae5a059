"""Operator 6: token counts, encoded in batches inside Arrow functions.

Rows are put together to batches of ``BATCH_BYTES`` of text, a longer row is cut at safe
boundaries first, and only lengths leave the function.

A boundary is safe where no token can reach over it, so the pieces' counts add up:

* ``.model`` (sentencepiece): one blank between two other characters, provided that no
  piece of the vocabulary has a white-space marker after another character, which is
  looked up in the model. The right part is encoded without the blank, as the library
  puts a marker before every text. Parts that return are encoded once a batch.
* ``.json`` (tokenizers): one blank between two letters, which starts a new word in all
  of these pre-tokenizers; the blank stays with the right part.

Defined results: null counts as empty, an empty text has no tokens; special strings
inside texts are handled as the library does by default; repeated rows are counted each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm.common import bounded_batches

BATCH_BYTES = 1 << 21
LIMIT_TOKENS = 4096
KEPT_PARTS = 300_000  # parts whose counts a worker keeps from batch to batch
MARK = "▁"
SAFE_BLANK = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
LETTER_BLANK = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


class PieceCounter:
    """Counts of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> list[str]:
        if not self.splits:
            return [text]
        if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            return SAFE_BLANK.split(text)
        return text.split(" ")

    def cut(self, text: str, at: int):
        """Where to cut after ``at``, and where the right part begins."""
        found = SAFE_BLANK.search(text, at) if self.splits else None
        return (found.start(), found.end()) if found else None

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > KEPT_PARTS:
            self.known.clear()
        known, rows = self.known, [self.parts(t) for t in texts]
        new = list({p for parts in rows for p in parts if p not in known})
        for p, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            known[p] = len(ids)
        return [sum(map(known.__getitem__, parts)) for parts in rows]


class FileCounter:
    """Counts of a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def cut(self, text: str, at: int):
        found = LETTER_BLANK.search(text, at)
        return (found.start(), found.end()) if found else None

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else FileCounter(path)


def cuts(text: str, cut, size: int):
    """The text in parts of ``size`` characters or a little more, cut at safe boundaries."""
    at = 0
    while len(text) - at > size and (found := cut(text, at + size)):
        yield text[at : found[0]]
        at = found[1]
    yield text[at:]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT_TOKENS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``path`` is the tokenizer's file, at the
    same place on every executor."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
    )

    def counted(batches):
        model = counter(path)
        for batch in batches:
            totals = [0] * len(batch)
            texts, owners, size = [], [], 0

            def flush(totals=totals, texts=texts, owners=owners):
                for row, n in zip(owners, model.counts(texts), strict=True):
                    totals[row] += n
                texts.clear()
                owners.clear()

            for row, text in enumerate(batch.column(1)):
                for part in cuts(text.as_py(), model.cut, batch_bytes):
                    texts.append(part)
                    owners.append(row)
                    size += len(part)
                    if size >= batch_bytes:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(totals, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
