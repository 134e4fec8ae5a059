"""Operator 12 against brute force, over both tokenizers and over odd texts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest

from foresail.llm import alignment
from foresail.llm.queries import BYTE_VOCABULARY, VOCABULARY

PATHS = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(VOCABULARY)
TEXTS = [
    "The quick brown fox, it's 12345 years old.",
    "The quick brown fox, it's 12345 years old.",
    " leading and trailing ",
    "two  blanks\tand\nlines\n\n  indented",
    "caf\u00e9 na\u00efve \u65e5\u672c\u8a9e \U0001f600 \u00a0x\u3000y",
    "<|endoftext|> </s> <unk> <0x41> [special]",
    "a \u2581 marker",
    "nul\x00byte \x1c sep",
    "word " * 700,
    "x" * 30_000,
    "",
    None,
    " ",
    "the the the the",
]


def brute(rows):
    """Every link of every text, one by one."""
    tokens = alignment.Tokens(*PATHS)
    out, corpus, by_text = [], Counter(), []
    for doc_id, text in rows:
        links, head = Counter(), (doc_id, 0, 0, 0, 0, "")
        if text:
            a = tokens.a.encode(" " + text, add_special_tokens=False).ids
            b = tokens.b.encode(text)
            spans = []
            for ids, data in ((a, tokens.bytes_a), (b, tokens.bytes_b)):
                at, own = 0, []
                for i in ids:
                    own.append((at, at + len(data[i]), i, data[i]))
                    at += len(data[i])
                spans.append(own)
            if all(b"".join(s[3] for s in own) == (" " + text).encode() for own in spans):
                ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
                groups, low = [], 0
                for end in ends:
                    groups.append("|".join(",".join(str(s[2]) for s in own if low < s[1] <= end) for own in spans))
                    low = end
                first = 0
                for lo, hi, i, _ in spans[0]:
                    while spans[1][first][1] <= lo:
                        first += 1
                    k = first
                    while k < len(spans[1]) and spans[1][k][0] < hi:
                        links[i, spans[1][k][2]] += 1
                        k += 1
                sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
                head = (doc_id, len(a), len(b), len(groups), sum(links.values()), sha)
        corpus.update(links)
        by_text.append(links)
        out.append(head)
    top = Counter()
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    return [
        (*h[:5], sum(n for k, n in links.items() if corpus[k] == top[k[1]]), sum(n * corpus[k] for k, n in links.items()), h[5])
        for h, links in zip(out, by_text, strict=True)
    ]


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_odd_texts(spark):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, pair int")
    want = brute(rows)
    assert sum(w[4] == 0 for w in want) == 3  # null, empty and the marker
    same(alignment.alignment(df, *PATHS), want)
    same(alignment.alignment(df.limit(0), *PATHS), [])
    same(alignment.alignment(df.where("text is null"), *PATHS), [(11, 0, 0, 0, 0, 0, 0, "")])


@pytest.mark.parametrize("size", [7, 4096])
def test_given_documents_in_blocks_of(spark, monkeypatch, size):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    if size < 4096:
        df = df.where("length(text) < 1500")
    monkeypatch.setattr(alignment.Block, "full", property(lambda self: len(self.ids) >= size))
    same(alignment.alignment(df, *PATHS), brute([tuple(r) for r in df.collect()]))


def test_bitmaps_hold_positions_and_planes():
    import numpy as np

    for positions in ([], [0], [5, 4095], list(range(0, 4096, 3)), list(range(4096)), list(range(255)), list(range(256))):
        bitmap = alignment.packed(np.array(positions, np.int64))
        assert alignment.positions(bitmap).tolist() == positions
        assert alignment.popcount(bitmap) == len(positions) and len(bitmap) <= 512
    block = alignment.Block()
    links = {7: [1, 2, 3, 9], 9: [4]}
    for d in range(4):
        own = sorted(p for p in links if d < len(links[p]))
        block.add(d, (1, 1, 1, 1), "", np.array(own, np.int64), np.array([links[p][d] for p in own]))
    codes, maps, planes = block.bitmaps()
    assert codes.tolist() == [7, 9] and [alignment.popcount(m) for m in maps] == [4, 1]
    for code, bitmap, own in zip(codes.tolist(), maps, planes, strict=True):
        total = alignment.popcount(bitmap) + sum(alignment.popcount(p) << k for k, p in enumerate(own))
        assert total == sum(links[code])


def test_pair_counts_over_the_corpus(spark):
    df = spark.createDataFrame([(1, "the cat the cat"), (2, "the dog"), (3, None)], "doc_id long, text string")
    index = alignment.blocks(df, *PATHS, "doc_id", "text")
    tokens = alignment.Tokens(*PATHS)
    (a,), (b,) = tokens.encoded(["the"])
    row = {r.pair: r for r in alignment.pair_counts(index).collect()}[(a[0] << 32) | b[0]]
    assert (row.n_docs, row.n_links) == (2, 3)
    assert re.fullmatch(r"[0-9a-f]{64}", alignment.alignment(df, *PATHS).where("doc_id = 2").first().groups_sha256)
