"""Exact and near dedup and decontamination against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest

from foresail.llm import decontaminate, exact_dedup, near_dedup

BASE = "one two three four five six seven eight nine ten " * 2 + "and some more words to fill this text up " * 3
ROWS = [
    (1, "a b c", "x"),
    (2, "ab  c\t", "y"),
    (3, None, None),
    (4, "", "x"),
    (5, " \n ", "x"),
    (5, " \n ", "x"),
    (6, "ÉÀ é", "z"),
    (7, BASE, "x"),
    (8, BASE.replace("seven", "SEVEN"), "x"),
    (9, BASE.replace("fill", "pad", 1), "x"),
    (10, "short text", "x"),
    (11, "Short  text", "x"),
    (None, "no id here at all", "x"),
    (12, "unrelated " + " ".join(f"w{i}" for i in range(300)), "x"),
    (13, "unrelated " + " ".join(f"w{i}" for i in range(290)), "x"),
    (14, " ".join(f"w{i}" for i in range(150, 450)), "x"),
]
SCHEMA = "doc_id long, text string, kept string"  # a column whose name clashes


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_exact_dedup_matches_brute_force(docs):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in ROWS]
    want = []
    for (doc, _, _), n in zip(ROWS, norm, strict=True):
        group = [(-len(t or ""), d is None, d or 0, d) for (d, t, _), m in zip(ROWS, norm, strict=True) if m == n]
        keep = min(group)[3]
        want.append((doc, keep, len(group), doc == keep, hashlib.sha256(n.encode()).hexdigest()))
    got = by_row(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=str)
    left = exact_dedup.drop_exact(docs)
    assert left.columns == docs.columns
    assert by_row(left, "doc_id") == sorted([(w[0],) for w in want if w[3]], key=str)


def test_rows_that_leave_early_are_not_shuffled_by_digest(spark):
    rows = [(i, "x" * (i + 1)) for i in range(40)] + [(100 + i, f"{i:064d}tail") for i in range(30)]
    rows += [(200 + i, "a copy of a text") for i in range(5)] + [(300, "a copy  of a text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.exact_dedup(df)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in out.collect()}
    assert got == {d: (d, 1) if d < 200 else (300, 6) for d, _ in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.rindex("Final Plan") :] if "Final Plan" in plan else plan
    assert len(re.findall(r"hashpartitioning\(text_sha256", plan.split("Initial Plan")[0])) <= 2


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        component = r[0] if not sets[i] else min(ids, default=None)
        out.append((r[0], len(sets[i]), component, component == r[0]))
    return sorted(out, key=str)


def test_near_dedup_matches_brute_force(docs):
    got = by_row(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(ROWS)


def test_drop_near_takes_only_the_near_copies(spark):
    """Of two rows without an id, and of two texts under one id, one each is a near copy."""
    text = " ".join(f"v{i}" for i in range(200))
    near = [text.replace(f"v{i} ", f"u{i} ") for i in (20, 90, 160)]
    rows = [
        (1, near[0], "x"),
        (None, near[1], "gone"),
        (None, "a clean text without an id", "x"),
        (None, None, "x"),
        (2, near[2], "gone"),
        (2, "a clean second text of the same id", "x"),
        (3, text, "gone"),
        (3, text, "gone"),
    ]
    left = near_dedup.drop_near(spark.createDataFrame(rows, SCHEMA))
    assert by_row(left, "doc_id", "text", "kept") == sorted((r for r in rows if r[2] == "x"), key=str)


def test_chained_edits_form_one_component(spark):
    """Copies linked only through others, and a crowd of texts that share a passage."""
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((100 + i, " ".join(words), None))
        for at in rng.integers(0, 200, 2):
            words[at] = f"n{i}_{at}"
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(200 + i, passage + " " + " ".join(f"q{i}_{k}" for k in range(60)), None) for i in range(12)]
    got = by_row(near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(rows)


def test_crowd_around_the_limit(spark, monkeypatch):
    """Edited copies of one text, most pairs just below or above the limit: all links are
    found, and the last comparison makes few rows but links."""
    rng = np.random.default_rng(8)
    base, rows = [f"c{i}" for i in range(150)], []
    for i in range(160):
        words = list(base)
        for at in rng.choice(150, rng.integers(2, 6), replace=False):
            words[at] = f"e{i}_{at}"
        rows.append((i, " ".join(words), None))
    seen, rest = [], near_dedup._rest

    def counted(members, sets):
        pairs = near_dedup.written(rest(members, sets), "counted")
        tested = near_dedup.compared(pairs, sets)
        close = tested.where("100 * (n_both + 4) >= 75 * (n_any - 4)")
        seen.append((pairs.count(), pairs.distinct().count(), close.count()))
        return pairs

    monkeypatch.setattr(near_dedup, "_rest", counted)
    got = by_row(near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(rows)
    # a pair of two nodes outside the main component comes from either side
    assert seen and all(once == close and pairs <= 2 * once for pairs, once, close in seen)


def test_sketch_passes_over_fewer_links_than_the_bands():
    """Chance that more bits than SKETCH_OFF differ in a pair at the limit, one of eight expected."""
    n = 2 * near_dedup.SKETCH
    lost = sum(math.comb(n, k) * 7 ** (n - k) for k in range(near_dedup.SKETCH_OFF + 1, n + 1))
    assert lost * 10**9 <= 8**n


def test_min_max_estimate_is_close():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    sig = near_dedup.signatures(np.concatenate([a, b]), np.array([0, 2000]))
    assert abs(near_dedup.similarity(sig[0], sig[1]) - 1500 / 2500) < 0.15


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


ITEMS = [
    (1, " ".join(f"b{i}" for i in range(20))),
    (2, "tiny item"),
    (3, None),
    (4, "..."),
    (10, "Tiny, ITEM!"),
]


def test_contamination_matches_brute_force(spark):
    rows = [
        (1, "x " * 10 + " ".join(f"B{i}" for i in range(3, 18)) + " y", "k"),
        (2, "a tiny-item here", "k"),
        (3, None, "k"),
        (4, "", "k"),
        (5, " ".join(f"z{i}" for i in range(400)) + " tiny item", "k"),
        (6, " ".join(f"b{i}" for i in range(12)), "k"),
        (7, "É tiny ITEM é", "k"),
        (7, "É tiny ITEM é", "k"),
        (None, "tiny item", "k"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")

    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    want = []
    for doc, text, _ in rows:
        w, hit, items = words(text), set(), set()
        for item, t in ITEMS:
            b = words(t)
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    items.add(str(item))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want.append((doc, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)))
    found = decontaminate.contamination(docs, bench)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(found, *columns) == sorted(want, key=str)
    shuffled = decontaminate.contamination(docs, bench, broadcast_windows=0)
    assert by_row(shuffled, *columns) == sorted(want, key=str)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert by_row(left, "doc_id") == sorted([(w[0],) for w in want if not w[5]], key=str)
    cleaned = dict(by_row(decontaminate.remove_spans(docs.where("doc_id in (1, 2, 3)"), found), "doc_id", "text"))
    assert cleaned == {1: "x " * 10 + "y", 2: "a here", 3: None}


def test_sketch_works_on_many_permutations_at_once(monkeypatch):
    """One pass a permutation cost 3 ms a node, however short its text."""
    import time

    import numpy as np

    from foresail.llm import near_dedup as nd

    rng = np.random.default_rng(nd.SEED + 1)
    a, b = rng.integers(0, 1 << 31, size=(2, nd.SKETCH), dtype=np.uint32)
    values = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    short = (values >> np.uint64(32)).astype(np.uint32)
    ends = np.array([[f(short * (x * np.uint32(2) + np.uint32(1)) + y) for f in (np.min, np.max)] for x, y in zip(a, b, strict=True)])
    ends = (ends ^ (ends >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    plain = np.packbits((ends >> np.uint32(31)).astype(bool)).view(np.int64)
    for cells in (1, 1000, 1 << 16):
        monkeypatch.setattr(nd, "SKETCH_CELLS", cells)
        assert (nd.sketch(values) == plain).all()
    start = time.process_time()
    for _ in range(20):
        nd.sketch(values[:20])
    assert time.process_time() - start < 0.03
