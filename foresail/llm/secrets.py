"""Operator 2: secret scans, fixed patterns plus a linear-chain conditional random field.

The patterns give the base spans. The field tags tokens as begin, inside or outside of
a secret from their shape, the kinds of the two tokens before and the one after, and
features of the whole text; it is trained with exact forward-backward sums on tokens
around the patterns' spans and around other unusual tokens of a bounded sample, so it
carries what a secret looks like, and where it stands, beyond the patterns. Spans that
it adds touch no base span and have ``ADDED_CHARS`` characters at least.

Decoding is Viterbi. Most tokens are so surely outside that no neighbour can change it:
the bound for that is computed from the weights, and only the runs of other tokens are
decoded, between neighbours known to be outside, which gives the same best path.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no
spans; spans that begin at one place are ordered by kind (assign, access, hex, learned).
Repeated rows get the same result; an empty table gives an empty result; without any
span in the sample only base spans are found; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresail.llm.common import bounded_batches

SAMPLE = 400  # texts with and as many without base spans
SAMPLE_BYTES = 60_000
WINDOW = 8  # tokens on either side of a span in training
EPOCHS = 4
ADDED_CHARS = 12
KEPT_CHUNKS = 300_000
SLICE = 1 << 20
KINDS = ("assign", "access", "hex", "learned")
OUT, BEGIN, IN = 0, 1, 2

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# for Spark to find texts to learn from
ANY_BASE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"

TOKEN = re.compile(r"[^\s\"'=:,;()<>\[\]{}]+|[\"'=:,;()<>\[\]{}]")
PLAIN = re.compile(r"[^\W\d_]+[^\w\s\"'=:,;()<>\[\]{}]*|[^\w\s\"'=:]+")
KEYISH = re.compile(r"pass|secret|token|key|auth|cred|pwd|bearer", re.I)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SHAPES, CONTEXTS, FILES = 24, 7, 3


def shape(token: str) -> tuple[int, ...]:
    """Numbers of the features that hold of a token by itself."""
    if PLAIN.fullmatch(token) and not KEYISH.search(token) and len(token) < 40:
        return (0,)
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    upper = sum("A" <= c <= "Z" for c in token)
    lower = sum("a" <= c <= "z" for c in token)
    out = [1 + min(5, n // 6)]  # 1..6
    out.append(7 + min(3, 4 * digits // n))  # 7..10
    if digits and upper + lower:
        out.append(11)
    if upper and not lower and digits:
        out.append(12)
    if n >= 8 and all(c in "0123456789abcdef" for c in token):
        out.append(13)
    if digits == n:
        out.append(14)
    if KEYISH.search(token):
        out.append(15)
    if "@" in token:
        out.append(16)
    if "." in token[:-1]:
        out.append(17)
    if len(set(token)) >= 0.6 * n and n >= 10:
        out.append(18)
    if n == 1 and not token.isalnum():
        out.append(19)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    out.append(20 + min(3, changes // 2))  # 20..23
    return tuple(out)


def context(token: str | None) -> int:
    """What a token is to its neighbours."""
    if token is None:
        return 0
    if token in "=:":
        return 1
    if token in "\"'":
        return 2
    if KEYISH.search(token):
        return 3
    if len(token) >= 12 and any(c.isdigit() for c in token):
        return 4
    return 5 if any(c.isdigit() for c in token) else 6


def file_features(text: str) -> tuple[int, ...]:
    """Features of the whole text."""
    out = [0] if len(text) < 2000 else [1]
    if "=" in text or "{" in text:
        out.append(2)
    return tuple(out)


@dataclass
class Field:
    shapes: np.ndarray = field(default_factory=lambda: np.zeros((SHAPES, 3)))
    before: np.ndarray = field(default_factory=lambda: np.zeros((CONTEXTS, 3)))
    before2: np.ndarray = field(default_factory=lambda: np.zeros((CONTEXTS, 3)))
    after: np.ndarray = field(default_factory=lambda: np.zeros((CONTEXTS, 3)))
    files: np.ndarray = field(default_factory=lambda: np.zeros((FILES, 3)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def parts(self):
        return (self.shapes, self.before, self.before2, self.after, self.files)

    def emission(self, active: tuple) -> np.ndarray:
        return sum(w[list(ids)].sum(0) for w, ids in zip(self.parts(), active, strict=True))

    def slack(self) -> float:
        """The most that neighbours, text and transitions can add to a tag over OUT."""
        gain = sum((w[:, 1:] - w[:, :1]).max() for w in (self.before, self.before2, self.after))
        gain += np.maximum(0, (self.files[:, 1:] - self.files[:, :1]).max(1)).sum()
        t = self.step
        turns = [
            t[a, y] + t[y, b] - t[a, OUT] - t[OUT, b] for a in range(3) for y in (1, 2) for b in range(3)
        ]
        # at a text's ends only one of the two transitions is there
        ends = [t[a, y] - t[a, OUT] for a in range(3) for y in (1, 2)]
        ends += [t[y, b] - t[OUT, b] for b in range(3) for y in (1, 2)]
        return float(gain + max(0.0, *turns, *ends))


def active(tokens: list[str], i: int, files: tuple[int, ...]) -> tuple:
    return (
        shape(tokens[i]),
        (context(tokens[i - 1]) if i else 0,),
        (context(tokens[i - 2]) if i > 1 else 0,),
        (context(tokens[i + 1]) if i + 1 < len(tokens) else 0,),
        files,
    )


def viterbi(emissions: np.ndarray, step: np.ndarray, first=None, last=None) -> list[int]:
    """Best tags; ``first`` and ``last``: known tags just before and after, if any.
    Of equally good tags the smaller wins."""
    score = emissions[0] + (step[first] if first is not None else 0)
    back = []
    for e in emissions[1:]:
        total = score[:, None] + step
        back.append(total.argmax(0))
        score = total.max(0) + e
    tag = int((score + (step[:, last] if last is not None else 0)).argmax())
    out = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        out.append(tag)
    return out[::-1]


def _gradient(model: Field, emissions: np.ndarray):
    """Marginals of tags and of pairs of neighbouring tags."""
    n, t = len(emissions), model.step
    forward, backward = np.empty((n, 3)), np.zeros((n, 3))
    forward[0] = emissions[0]
    for i in range(1, n):
        x = forward[i - 1][:, None] + t
        m = x.max(0)
        forward[i] = m + np.log(np.exp(x - m).sum(0)) + emissions[i]
    for i in range(n - 2, -1, -1):
        x = t + (backward[i + 1] + emissions[i + 1])[None, :]
        m = x.max(1)
        backward[i] = m + np.log(np.exp(x - m[:, None]).sum(1))
    m = forward[-1].max()
    z = m + np.log(np.exp(forward[-1] - m).sum())
    single = np.exp(forward + backward - z)
    pairs = np.zeros((3, 3))
    for i in range(1, n):
        pairs += np.exp(forward[i - 1][:, None] + t + (emissions[i] + backward[i])[None, :] - z)
    return single, pairs


def windows(text: str) -> list[tuple[list[tuple], list[int]]]:
    """Stretches of tokens to learn from: around base spans and unusual tokens."""
    found = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)]
    tokens, files, spans = [f[0] for f in found], file_features(text), base_spans(text)
    tags = [OUT] * len(tokens)
    for start, _, end in spans:
        covered = [i for i, f in enumerate(found) if f[1] < end and f[2] > start]
        for k, i in enumerate(covered):
            if tags[i] == OUT:
                tags[i] = IN if k else BEGIN
    centres = [i for i, t in enumerate(tags) if t == BEGIN]
    centres += [i for i, w in enumerate(tokens) if tags[i] == OUT and shape(w) != (0,)][:6]
    centres += [len(tokens) // 2] if tokens else []
    out = []
    for c in centres:
        part = range(max(0, c - WINDOW), min(len(tokens), c + WINDOW + 1))
        out.append(([active(tokens, i, files) for i in part], [tags[i] for i in part]))
    return out


def train(texts: list[str], seed: int = 2) -> Field | None:
    """Stochastic gradient ascent on the conditional likelihood; weights are drawn back
    to a prior in which plain words are outside, and transitions stay within 4."""
    data = [w for t in texts for w in windows(t)]
    if not any(BEGIN in tags for _, tags in data):
        return None
    prior = Field()
    prior.shapes[0, OUT] = 30.0
    model = Field()
    model.shapes += prior.shapes
    rng, step, total = np.random.default_rng(seed), 0, EPOCHS * len(data)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            feats, tags = data[k]
            rate = 0.1 * (1 - step / total)
            step += 1
            emissions = np.array([model.emission(f) for f in feats])
            single, pairs = _gradient(model, emissions)
            diff = -single
            diff[np.arange(len(tags)), tags] += 1
            for f, d in zip(feats, diff, strict=True):
                if np.abs(d).max() > 1e-4:
                    for w, ids in zip(model.parts(), f, strict=True):
                        w[list(ids)] += rate * d
            seen = np.zeros((3, 3))
            np.add.at(seen, (tags[:-1], tags[1:]), 1)
            model.step += rate * (seen - pairs)
            np.clip(model.step, -4, 4, out=model.step)
            if step % 100 == 0:
                for w, p in zip(model.parts(), prior.parts(), strict=True):
                    w -= rate * 0.02 * (w - p)
    return model


class Scanner:
    """A field with what a worker remembers of tokens it has seen."""

    def __init__(self, model: Field | None):
        self.model = model
        self.sure: dict[str, bool] = {}  # white-space separated stretch: surely outside
        self.slack = model.slack() if model else 0.0
        self.of_shape: dict[tuple[int, ...], bool] = {}

    def outside(self, token: str) -> bool:
        ids = shape(token)
        if ids not in self.of_shape:
            local = self.model.shapes[list(ids)].sum(0)
            self.of_shape[ids] = float(local[1:].max() - local[OUT]) + self.slack < 0
        return self.of_shape[ids]

    def unsure(self, text: str) -> bool:
        """Whether any token of the text needs decoding."""
        sure = self.sure
        if len(sure) > KEPT_CHUNKS:
            sure.clear()
        at = 0
        while at < len(text):
            stop = at + SLICE
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            chunks = set(text[at:stop].split())
            for c in chunks.difference(sure):
                tokens = (c,) if PLAIN.fullmatch(c) else TOKEN.findall(c)
                sure[c] = all(map(self.outside, tokens))
            if not all(map(sure.__getitem__, chunks)):
                return True
            at = stop
        return False

    def learned(self, text: str) -> list[tuple[int, int]]:
        """Spans of the best tags, decoding only what is not surely outside."""
        if self.model is None or not self.unsure(text):
            return []
        files, model, out = file_features(text), self.model, []
        certain: dict[str, bool] = {}
        run: list[tuple[np.ndarray, int, int]] = []
        before = before2 = None
        found = TOKEN.finditer(text)
        now = next(found, None)
        first = None
        while now is not None:
            token, after = now.group(), next(found, None)
            if token not in certain:
                if len(certain) > KEPT_CHUNKS:
                    certain.clear()
                certain[token] = self.outside(token)
            if certain[token]:
                if run:
                    out += _spans(run, viterbi(np.array([r[0] for r in run]), model.step, first, OUT))
                    run = []
                first = OUT
            else:
                around = (
                    shape(token),
                    (context(before),),
                    (context(before2),),
                    (context(after.group() if after else None),),
                    files,
                )
                run.append((model.emission(around), now.start(), now.end()))
            before2, before, now = before, token, after
        if run:
            out += _spans(run, viterbi(np.array([r[0] for r in run]), model.step, first))
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans."""
        base = base_spans(text)
        starts = [a for a, _, _ in base]  # in order; the furthest end up to each one
        ends = [0, *accumulate((b for _, _, b in base), max)]
        added = [
            (s, 3, e)
            for s, e in self.learned(text)
            if e - s >= ADDED_CHARS and ends[bisect_left(starts, e)] <= s
        ]
        return base, sorted(base + added)


def _spans(run: list, tags: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    before = OUT
    for (_, start, end), tag in zip(run, tags, strict=True):
        if tag == BEGIN or tag == IN and before == OUT:
            out.append([start, end])
        elif tag == IN:
            out[-1][1] = end
        before = tag
    return [(s, e) for s, e in out]


def learn(docs: DataFrame) -> Field | None:
    """Train on at most SAMPLE texts that have a base span and SAMPLE others.

    Texts are dealt to SAMPLE slots by a hash; the least hash of each slot comes from an
    aggregation without the texts, which are then read for the chosen ones alone.
    """
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select(
        "text", F.xxhash64("doc_id", "text").alias("pick")
    )
    has = F.col("text").rlike(ANY_BASE)
    slots = short.groupBy(has.alias("has"), F.pmod("pick", F.lit(SAMPLE)).alias("slot"))
    chosen = slots.agg(F.min("pick").alias("pick")).select("pick")
    rows = short.join(F.broadcast(chosen), "pick").groupBy("pick").agg(F.min("text").alias("text")).collect()
    return train([r["text"] for r in sorted(rows, key=lambda r: r["pick"])])


def scan(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def scanned(batches):
        scanner = Scanner(model)  # a few hundred weights
        for batch in batches:
            out = [scanner.spans(t.as_py()) for t in batch.column(1)]
            counts = [[sum(k == kind for _, k, _ in spans) for _, spans in out] for kind in range(4)]
            digests = [hashlib.sha256(written_spans(b).encode()).hexdigest() for b, _ in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts[:3]),
                    pa.array(digests, pa.string()),
                    pa.array([written_spans(s) for _, s in out], pa.string()),
                    pa.array(counts[3], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        scanned,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "spans string, n_learned long",
    )


def secret_scan(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` (doc_id, text) and scan all of them."""
    return scan(docs, learn(docs))
