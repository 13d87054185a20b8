"""Ranked search, periodic runs and decontamination against brute-force versions, with awkward rows: nulls,
empty and long texts, ties, repeated rows, clashing column names, empty tables, several item blocks."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopscope.llm import leaks, periods, queries, ranking, terms
from tests.conftest import SMALL
from tests.llm.test_operators import ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PASSAGE = " ".join(f"alpha{i} Beta{i}" for i in range(8))
MORE = [
    (20, "say: " + PASSAGE.upper() + " and more", "en", "a", 1), (21, PASSAGE + ", " + PASSAGE, "en", "a", 1),
    (22, "tiny item", "en", "a", 1), (23, "TINY-item tiny item", "en", "a", 1), (24, " ".join(PASSAGE.split()[:9]), "en", "a", 1),
    (25, "one two three one two", "en", "b", 1), (26, "two one two one three", "en", "b", 1), (None, PASSAGE, "en", "a", 1),
    (27, "Ünïcode wörter 中文 字", "zh", "a", 1), (28, "a " * 500 + "b " * 3, "en", "a", 1),
    (29, ("x y z " * 40) + " ".join(f"q{i}" for i in range(50)) + (" u v" * 9), "en", "a", 1),
]
ITEMS = [(1, PASSAGE), (2, "tiny item"), (3, "TINY item!"), (4, None), (5, " ,; "), (6, "one two three"), (7, "wörter 中文"),
         (8, "nothing of this occurs anywhere at all in any of those texts"), (9, PASSAGE + " zeta"), (None, "q1 q2 q3"), (2, "q5 q6"),
         (10, " ".join(f"tok{i}" for i in range(30)))]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS + MORE, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("?") for c in ("h", "m", "bag", "item", "echo", "words", "items", "kind", "a.b", "row_key")})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))


def words(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]


# ---------------------------------------------------------------- ranked search

def brute_ranking(rows, given, top):
    bags = [(d, Counter(words(t)), len(words(t))) for d, t in rows]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in given:
        scored = []
        for d, b, n in bags:
            m = 50 + (50 * n * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
                    for t in set(words(text)) if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("top, block, cells", [(50, 1 << 18, 1 << 22), (2, 40, 64)])
def test_ranking_against_all_scores(spark, docs, items, monkeypatch, top, block, cells):
    monkeypatch.setattr(ranking, "BLOCK_WORDS", block)
    monkeypatch.setattr(ranking, "CELLS", cells)
    want = brute_ranking([r[:2] for r in ROWS + MORE], ITEMS, top)
    got = ranking.ranked(docs, items, top).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == want


def test_scores_in_integers_equal_those_in_doubles(monkeypatch):
    rng = np.random.default_rng(1)
    given = [np.unique(rng.integers(0, 40, 12)) for _ in range(9)]
    weights = rng.integers(1, 30_000, 40)
    row, term = np.repeat(np.arange(30), 5), np.concatenate([rng.choice(40, 5, replace=False) for _ in range(30)])
    part = weights[term] * rng.integers(1, 10**6, 150)

    def scores():
        s = ranking._Scorer(given, weights)
        return np.hstack([s.scores(g, s.matrix(g), row, term, part, 30) for g in s.groups])

    want = np.array([[part[(row == r) & np.isin(term, i)].sum() for i in given] for r in range(30)])
    assert (scores() == want).all()
    monkeypatch.setattr(ranking, "EXACT_TERMS", 2)
    monkeypatch.setattr(ranking, "CELLS", 50)
    assert (scores() == want).all()


# ---------------------------------------------------------------- periodic runs

def brute_runs(seq):
    n, out = len(seq), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                root = seq[i:i + length]
                if not any(root[p:] == root[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.integers(1, 12), st.integers(1, 9))
def test_runs_against_all_lags(parts, period, times):
    seq = [x for p in parts for x in (p[:period] * times + p)]
    assert [tuple(r) for r in periods.find_runs(np.array(seq, dtype=np.int64)).tolist()] == brute_runs(seq)


def test_runs_of_words_without_repetition_in_long_periods():
    rng = np.random.default_rng(3)
    seq = np.concatenate((rng.integers(0, 50, 300), np.tile(rng.integers(0, 9, 37), 5), np.tile(rng.integers(0, 9, 16), 4), rng.integers(0, 9, 90)))
    assert [tuple(r) for r in periods.find_runs(seq).tolist()] == brute_runs(seq.tolist())


def test_periodic_runs_query(spark, docs, tmp_path):
    path = str(tmp_path / "in")
    real = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(real)
    plain.write.parquet(f"{path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, path).fillna(-1, ["doc_id"]).collect())
    want, planted = [], 0
    for d, t in plain.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if len(w) < 3000:
            runs = brute_runs(w)
        else:
            runs = [tuple(r) for r in periods.find_runs(np.unique(w, return_inverse=True)[1]).tolist()]
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        want.append((-1 if d is None else d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest()))
    assert planted > 10
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r)) or sorted(got, key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- decontamination

def brute_hits(rows, given, window=10):
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for item, text in given:
            x = words(text)
            size = min(len(x), window)
            if not size:
                continue
            mine = {tuple(x[p:p + size]) for p in range(len(x) - size + 1)}
            at = [p for p in range(len(w) - size + 1) if tuple(w[p:p + size]) in mine]
            hit |= {q for p in at for q in range(p, p + size)}
            if at and item is not None:
                found.add(str(item))
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, shard", [(1 << 20, 1 << 20), (30, 64)])
def test_hits_against_all_windows(docs, items, monkeypatch, block, shard):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    original = leaks._hits

    def small(blocks):  # the shard size must hold in the workers, too
        run = original(blocks)

        def inner(batches):
            leaks.SHARD_WORDS = shard
            yield from run(batches)

        return inner

    monkeypatch.setattr(leaks, "_hits", small)
    got = leaks.benchmark_hits(docs, items).collect()
    want = brute_hits([r[:2] for r in ROWS + MORE], ITEMS)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == want
    clean = leaks.without_leaks(docs, items)
    assert clean.columns == docs.columns
    assert sorted((r[0] for r in clean.collect()), key=str) == sorted((d for d, _, n, _ in want if not n), key=str)


def test_longest_matches_against_all_pairs(docs, items):
    got = {r.item_id: (r.n_words, r.item_word, r.doc_id, r.doc_word) for r in leaks.longest_matches(docs, items).collect()}
    rows = [(d, words(t)) for d, t in (r[:2] for r in ROWS + MORE)]
    for item in {i for i, _ in ITEMS if i is not None}:
        best = 0
        for x in (words(t) for i, t in ITEMS if i == item):
            for _, w in rows:
                for p in range(len(x)):
                    for q in range(len(w)):
                        n = 0
                        while p + n < len(x) and q + n < len(w) and x[p + n] == w[q + n]:
                            n += 1
                        best = max(best, n)
        assert (got[str(item)][0] if str(item) in got else 0) == best
        if best:
            n, p, d, q = got[str(item)]
            x = [words(t) for i, t in ITEMS if i == item]
            assert any(w[q:q + n] == y[p:p + n] for y in x for i, w in rows if i == d)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=20))
def test_binary_search_in_suffix_array(seq, item):
    ids, m = np.array(seq, dtype=np.int64), len(item)
    q, rest = np.array(item), m - np.arange(m)
    order = leaks.suffix_array(ids, m)
    depth, low, high, _, _ = leaks.search(ids, order, q, rest, np.zeros(m, np.int64))
    for j in range(m):
        match = [next((k for k in range(m - j + 1) if k == m - j or p + k >= len(seq) or seq[p + k] != item[j + k]), 0) for p in range(len(seq))]
        most = max(match, default=0)
        assert depth[j] == most
        if most:
            assert sorted(order[low[j]:high[j]].tolist()) == [p for p, k in enumerate(match) if k == most]


def test_long_texts_are_read_in_stretches(monkeypatch):
    text = ("Word" + " é1 x-" * 3).encode() * 400
    data, offs = np.frombuffer(text, np.uint8), np.array([0, 0, len(text) // 2, len(text) // 2, len(text)])
    whole = terms.hashed_words(data, offs)
    monkeypatch.setattr(terms, "SLICE_BYTES", 50)
    parts = terms.hashed_words(data, offs)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


# ---------------------------------------------------------------- empty tables

def test_empty_tables(spark, docs, items):
    none_d, none_i = docs.where("false"), items.where("false")
    assert ranking.ranked(none_d, items).count() == 0 and ranking.ranked(docs, none_i).count() == 0
    assert ranking.ranked(docs, none_i).dtypes == ranking.ranked(docs, items).dtypes
    assert periods.periodic_runs(none_d).count() == 0
    assert leaks.benchmark_hits(none_d, items).count() == 0 and leaks.longest_matches(none_d, items).count() == 0
    assert leaks.benchmark_hits(docs, none_i).where("n_hit > 0").count() == 0
    assert leaks.without_leaks(docs, none_i).count() == docs.count()
