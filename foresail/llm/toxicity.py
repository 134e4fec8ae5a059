"""Operator 7: toxicity from a weighted lexicon, matched by Aho-Corasick.

Texts are folded character by character: A-Z and full-width forms to small letters,
homoglyphs and digits put in place of letters to those letters. The lexicon is learned
from a bounded labelled sample: words, and stems that several words begin with, whose
share of toxic texts is too large for chance given the number of candidates. A term's
weight is its log odds. Words beside a term that only clean texts have there make an
exception phrase, in which the term does not count; callers may give more of both.

Terms and phrases are matched in one pass. A term counts where no letter or digit stands
before it and, for a whole word, none after it in the text as written. The summed
weights, as they are and per square root of the number of words, go into a logistic
unit that is fitted on the same sample.

Defined results: a null or empty text has no hits and gets the score of a text without
hits; without toxic rows to learn from every score is 0. Repeated rows get the same
score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm.common import bounded_batches, fold
from foresail.llm.training import labelled_sample

PER_LABEL = 2000
TRAIN_BYTES = 60_000
STEM = (4, 9)  # lengths of stems
STEM_WORDS = 6  # different words that a stem must begin
CHANCE = 0.01  # expected number of terms taken by chance
PURE = 0.02  # largest share of clean texts with a term, relative to toxic ones
PHRASE_TEXTS = 3
THRESHOLD = 0.7

# Characters that stand for others that look alike.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s",
    "ј": "j", "ԁ": "d", "ո": "n", "ɡ": "g", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
FOLD = {ord(a): b for a, b in ALIKE.items()}
FOLD |= {ord(a.upper()): b for a, b in ALIKE.items() if a.isalpha() and len(a.upper()) == 1}
FOLD |= {c: chr(c + 32) for c in range(65, 91)}
FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """As long as ``text``: every character stands for one."""
    return text.translate(FOLD)


def words_of(text: str) -> list[str]:
    """Folded words; what is a word is decided on the text as written."""
    flat = folded(text)
    return [flat[m.start() : m.end()] for m in WORD.finditer(text.replace("@", "a").replace("$", " "))]


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    phrases: list[str] = field(default_factory=list)  # "word term" or "term word", folded
    unit: tuple[float, float, float] = (0.0, 0.0, -30.0)  # weights of sum and density, bias

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        entries: dict[str, tuple] = {}
        for kind, terms in (("stem", self.stems), ("word", self.words)):
            for term, weight in terms.items():
                entries[term] = (kind, len(term), weight)
        for phrase in self.phrases:
            entries.setdefault(phrase, ("phrase", len(phrase), 0.0))
        for text, entry in entries.items():
            out.add_word(text, entry)
        if entries:
            out.make_automaton()
        return out


def hits(text: str, automaton) -> tuple[float, int]:
    """Summed weight and number of hits, each stretch counted once."""
    if not len(automaton):
        return 0.0, 0
    flat = folded(text)
    found, excused = {}, []
    for end, (kind, size, weight) in automaton.iter(flat):
        start, end = end - size + 1, end + 1
        if start and text[start - 1].isalnum():
            continue
        if kind != "stem" and end < len(text) and text[end].isalnum():
            continue
        if kind == "phrase":
            excused.append((start, end))
        else:
            found[start] = max(weight, found.get(start, 0.0))
    if excused:
        found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in excused)}
    return sum(found.values()), len(found)


def features(text: str, total: float) -> tuple[float, float]:
    length = text.count(" ") + text.count("\n") + 1
    return math.log1p(total), total / math.sqrt(length)


def _unlikely(with_term: int, toxic_with: int, share: float) -> float:
    """Upper bound of the log chance of so many toxic texts among those with the term."""
    p = toxic_with / with_term
    if p <= share:
        return 0.0
    rest = (1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0
    return -with_term * (p * math.log(p / share) + rest)


def learn(rows: list, phrases: tuple[str, ...] = (), terms: dict[str, float] | None = None) -> Lexicon:
    """``rows``: (id, text, label 0 or 1)."""
    toxic = sum(r[2] for r in rows)
    clean = len(rows) - toxic
    if not toxic or not clean:
        return Lexicon(words=dict(terms or {}), phrases=list(phrases))
    # near copies of one text are one witness: those with the same least word hash
    seen: dict[tuple[int, int], set[str]] = {}
    for _, text, label in rows:
        bag = set(words_of(text))
        least = min((zlib.crc32(w.encode()) for w in bag), default=0)
        seen.setdefault((least, label), set()).update(bag)
    bags = [(bag, label) for (_, label), bag in seen.items()]
    toxic = sum(label for _, label in bags)
    clean = len(bags) - toxic
    bad, good = Counter(), Counter()
    for bag, label in bags:
        (bad if label else good).update(bag)
    share = toxic / len(bags)

    def pick(bad, good):
        known = [w for w, n in bad.items() if n >= 3]
        limit = math.log(CHANCE / max(1, len(bad) + len(good)))
        out = {}
        for w in known:
            a, b = bad[w], good[w]
            pure = b / clean <= PURE * a / toxic
            if pure and _unlikely(a + b, a, share) < limit:
                out[w] = math.log(((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1)))
        return out

    words = {w: x for w, x in pick(bad, good).items() if len(w) >= 3}
    # stems: what several words begin with, more telling together than any one of them
    heads = {w[:k] for w in bad for k in range(*STEM) if len(w) > k and bad[w] >= 2 and good[w] == 0}
    sbad, sgood, kinds = Counter(), Counter(), {}
    for bag, label in bags:
        seen = set()
        for w in bag:
            for k in range(STEM[0], min(STEM[1], len(w) + 1)):
                if w[:k] in heads:
                    seen.add(w[:k])
                    if label:
                        kinds.setdefault(w[:k], set()).add(w)
        (sbad if label else sgood).update(seen)
    stems: dict[str, float] = {}
    for s, x in sorted(pick(sbad, sgood).items(), key=lambda p: len(p[0])):
        most = max(bad[w] for w in kinds[s])
        if len(kinds[s]) >= STEM_WORDS and sbad[s] >= 1.5 * most:
            if not any(s.startswith(t) for t in stems):
                stems[s] = x
    words = {w: x for w, x in words.items() if not any(w.startswith(s) for s in stems)}
    lexicon = Lexicon(words | dict(terms or {}), stems)

    beside: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for _, text, label in rows:
        seq = words_of(text)
        found = set()
        for i, w in enumerate(seq):
            if w in lexicon.words:
                found |= {f"{seq[i - 1]} {w}"} if i else set()
                found |= {f"{w} {seq[i + 1]}"} if i + 1 < len(seq) else set()
        beside[label].update(found)
    learned = [p for p, n in beside[0].items() if n >= PHRASE_TEXTS and not beside[1][p]]
    lexicon.phrases = sorted(learned) + [folded(p) for p in phrases]

    automaton = lexicon.automaton()
    x = np.array([features(r[1], hits(r[1], automaton)[0]) for r in rows])
    y = np.array([r[2] for r in rows], float)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, b = np.zeros(2), 0.0
    scale = np.maximum(x.std(0), 1e-9)
    z = x / scale
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        e = (p - y) * weight / len(y)
        w -= 3.0 * (z.T @ e + 1e-5 * w)
        b -= 3.0 * e.sum()
    # more hits never make a text less toxic
    lexicon.unit = (max(0.0, w[0] / scale[0]), max(0.0, w[1] / scale[1]), b)
    return lexicon


def score(text: str, total: float, unit: tuple[float, float, float]) -> float:
    a, d = features(text, total)
    x = unit[0] * a + unit[1] * d + unit[2]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def rate(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_terms: one row per document, from the whole text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def rated(batches):
        automaton = lexicon.automaton()  # a few thousand terms at most
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            found = [hits(t, automaton) for t in texts]
            scores = [score(t, f[0], lexicon.unit) for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([f[1] for f in found], pa.int64()),
                ],
                ["doc_id", "score", "n_terms"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(rated, f"doc_id {kind}, score double, n_terms long")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels (doc_id, toxic) outside the held-out fold and score all rows of
    ``docs``: doc_id, held_out, score, predicted, n_terms."""
    known = labels.where("toxic in (0, 1)").where(fold(F.col("doc_id"), 3) != 1)
    known = known.select("doc_id", F.col("toxic").alias("label"))
    lexicon = learn(labelled_sample(docs.select("doc_id", "text"), known, PER_LABEL, TRAIN_BYTES))
    return rate(docs, lexicon).select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_terms",
    )
