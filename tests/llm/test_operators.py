"""Each operator against a brute-force version, on small tables with awkward rows: null columns, empty
and long texts, ties, repeated rows, clashing column names, and empty tables."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shopscope.llm import (common, fingerprints, jaccard, leaks, licenses, linear, mixing, packing, periods, pii, quality, queries, ranking, suffixes,
                           tokens, toxicity)
from tests.conftest import MEDIUM, SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(20_000))
BASE = " ".join(f"tok{i}" for i in range(80))
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE.replace("tok40", "other"), "en", None, None),
    (4, "", "en", "b", 0), (5, None, None, None, None), (6, " \n\t ", "de", "b", 5), (7, "one two three", "en", "b", 13),
    (8, "One TWO three", "en", "c", 13), (9, "é" * 300 + " ü", "fr", "c", 302), (10, LONG, "en", "a", len(LONG)),
    (10, LONG, "en", "a", len(LONG)), (11, "Released under the MIT License.\nmail a@b.org phone +1 (555) 123-4567, card 4111 1111 1111 1111", "en", "c", 1),
    (12, "x" * 250 + " y " + "x" * 250, "en", "c", 1), (None, "no id here", "en", "d", 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    # columns that operators use inside must not clash with the input's
    return df.withColumns({c: F.lit("?") for c in ("size", "cls", "kind", "candidates", "given", "label", "key", "score")})


@pytest.fixture(scope="module")
def real(spark):
    return common.documents(spark, SMALL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def both(docs, real):
    return docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").unionByName(
        real.withColumn("doc_id", F.col("doc_id") + 1000))


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1

def test_license_templates_identify_themselves():
    scan = licenses.Scanner().scan
    for name, wordings in licenses.TEMPLATES.items():
        for t in wordings:
            got = scan(t)
            assert got[0] == name and got[5] == "exact", (name, t, got)


def test_license_wording_differences():
    t = licenses.wording("Licensed under the Apache License, Version 2.0.")
    assert licenses.differences(t, licenses.wording("We say: licensed under the new Apache License, version 2.0!")) == (0, 1)
    assert licenses.differences(t, licenses.wording("licensed under the Apache License")) == (2, 0)


def test_license_scan(docs):
    got = licenses.license_scan(docs).collect()
    assert [(r.doc_id, r.license, r.verdict) for r in got] == [(11, "MIT", "exact")]


def wrapped(text, width):
    return "\n".join(textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


@pytest.mark.parametrize("width", [10_000, 78, 30, 12])
def test_license_templates_in_documents(spark, width):
    given = [(name, t) for name, wordings in licenses.TEMPLATES.items() for t in wordings]
    rows = [(k, f"import os\n\nCopyright 2020 The Authors\n\n{wrapped(t, width)}\n\nand other words follow\nhere.")
            for k, (_, t) in enumerate(given)]
    rows += [(1000 + k, wrapped(t, width)) for k, (_, t) in enumerate(given)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).where("verdict = 'exact'").collect()
    assert sorted((r.doc_id, r.license) for r in got) == sorted(
        (i + k, name) for i in (0, 1000) for k, (name, _) in enumerate(given))


def test_license_scan_finds_every_license_of_a_block(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    gpl2, gpl3 = (licenses.TEMPLATES[k][1] for k in ("GPL-2.0", "GPL-3.0"))
    rows = [(1, f"{mit}\n{apache}"), (2, f"{gpl3} {gpl2.replace('published', 'issued')} {gpl3}"),
            (3, "\n".join(["All rights reserved.", licenses.TEMPLATES["ISC"][0], mit, apache, licenses.TEMPLATES["BSD-3-Clause"][1]])),
            (4, licenses.TEMPLATES["LGPL-3.0"][0])]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.verdict) for r in got) == [
        (1, "Apache-2.0", "exact"), (1, "MIT", "exact"), (2, "GPL-2.0", "variant"), (2, "GPL-3.0", "exact"),
        (3, "All-Rights-Reserved", "exact"), (3, "Apache-2.0", "exact"), (3, "BSD-3-Clause", "exact"), (3, "ISC", "exact"),
        (3, "MIT", "exact"), (4, "LGPL-3.0", "exact")]


@pytest.mark.parametrize("width", [10_000_000, 78])
def test_license_rank_needs_no_line_breaks(spark, width):
    """Notices far apart in a very long text, on one line or wrapped, are found as by alignment with every template."""
    filler = " ".join(f"w{i * 7919 % 4001}" for i in range(3000))
    given = [licenses.TEMPLATES[k][0] for k in ("MIT", "BSD-2-Clause", "All-Rights-Reserved", "CC-BY-4.0", "Unlicense", "MPL-2.0")]
    text = wrapped(f" {filler} ".join(["", *(t.upper() if i % 2 else t for i, t in enumerate(given)), ""]), width)
    got = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("verdict = 'exact'").collect()
    assert sorted(r.license for r in got) == sorted(k for k, v in licenses.TEMPLATES.items() for t in v if t in given)


def test_confirmed_templates_save_bytes():
    """No template whose wording stands in a block is lost by the ranking (brute force: alignment with all)."""
    scanner = licenses.Scanner()
    filler = [f"w{i * 7919 % 4001}" for i in range(licenses.PIECE)]
    for k, (name, i, template, _) in enumerate(scanner.templates):
        for cut in (0, 1, len(filler) - 1):
            words = filler[:cut] + template + filler[cut:]
            assert (name, i) in [scanner.templates[j][:2] for saved, j in scanner.ranked(words) if saved > 0]


# ---------------------------------------------------------------- 2

def repeats(rows, n=200):
    seen = Counter()
    raw = [(i, t.encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[p:p + n] for p in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if seen[b[p:p + n]] > 1:
                gone[p:p + n] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if b else 0
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot, small", [(4096, False), (2, False), (4096, True)])
def test_suffixes_against_all_windows(docs, real, monkeypatch, hot, small):
    monkeypatch.setattr(suffixes, "HOT", hot)
    if small:  # short runs and batches, also in the workers
        runs, merge = suffixes._runs, suffixes._merge

        def small_runs(hot_, buckets):
            def run(batches):
                suffixes.RUN_BYTES = 3000
                yield from runs(hot_, buckets)(batches)

            return run

        def small_merge(batches):
            suffixes.MERGED = 5
            yield from merge(batches)

        monkeypatch.setattr(suffixes, "_runs", small_runs)
        monkeypatch.setattr(suffixes, "_merge", small_merge)
    df = both(docs, real.limit(80)).withColumn("text", F.substring("text", 1, 6000))
    got = Counter(tuple(r) for r in suffixes.without_repeats(df).drop("kept").collect())
    assert got == repeats(texts(df))


def test_marked_intervals_are_joined():
    rng = np.random.default_rng(4)
    doc, start = rng.integers(-3, 3, 300) * 10 ** 18, rng.integers(0, 900, 300)
    end = start + rng.integers(1, 40, 300)
    got = list(zip(*(x.tolist() for x in suffixes._joined(doc, start, end))))
    cover = {(d, p) for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist()) for p in range(s, e)}
    assert {(d, p) for d, s, e in got for p in range(s, e)} == cover
    assert sum(e - s for _, s, e in got) == len(cover)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(got, got[1:])) and got == sorted(got)


def test_merge_runs_gives_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(400)]
    runs = [sorted(words[i::7]) for i in range(7)]
    blobs = [len(r).to_bytes(8, "little") + b"".join(suffixes.front_coded(r, [b""] * len(r), np.zeros(len(r), suffixes._NUMBERS))) for r in runs]
    out = list(suffixes.merge_runs([suffixes.read_run(b) for b in blobs]))
    assert [w for _, w, _ in out] == sorted(words)
    assert [k for k, _, _ in out][1:] == [suffixes.shared_prefix(a[1], b[1]) for a, b in zip(out, out[1:])]


# ---------------------------------------------------------------- 3, 9

def test_toxicity_finds_held_out_rows(spark):
    df, lab = common.documents(spark, MEDIUM), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = toxicity.toxicity(df, lab).join(lab, "doc_id").collect()
    clean = [r.score for r in got if not r.toxic]
    toxic = [r.score for r in got if r.toxic]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert max(clean) < 0.5 and np.mean([a > b for a in toxic for b in clean]) > 0.6


def test_swap_penalty_lowers_false_positives_on_mentions():
    # "women" stands in many toxic texts of the sample, "men" in none
    toxic = [f"idiot women item{i}" if i % 4 else f"idiot item{i}" for i in range(60)]
    neutral = [f"nice men item{i}" if i % 2 else f"nice thing item{i}" for i in range(240)]
    rows = [toxicity.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1] for t in toxic + neutral]
    indptr, idx = np.concatenate(([0], np.cumsum([len(r) for r in rows]))), np.concatenate(rows).astype(np.int32)
    y = np.array([1.0] * 60 + [0.0] * 240)
    swaps = toxicity.swaps_of(indptr, idx)
    score = {}
    for penalty in (0.0, 50.0):
        m = linear.fit(np.arange(300), y, indptr, idx, np.ones(len(idx), np.float32), dim=1 << toxicity.BITS, l2=1e-4, swaps=swaps,
                       swap_penalty=penalty)
        score[penalty] = [float(m.weight[toxicity.term_feature(t)]) for t in ("women", "men")]
    assert score[50.0][0] - score[50.0][1] < 0.2 * (score[0.0][0] - score[0.0][1])


def test_quality_counts_and_verdicts(docs, real, labels):
    df = both(docs, real)
    got = {r.doc_id: r for r in quality.quality_rules(df, labels.withColumn("doc_id", F.col("doc_id") + 1000)).collect()}
    for i, t in texts(df):
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        again = {j + k for j in range(len(w) - 4) if windows[tuple(w[j:j + 5])] > 1 for k in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)), i
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.kept and r.base_failed)
    kept = [got[r.doc_id + 1000].kept for r in labels.where("quality = 1").join(real, "doc_id").collect()
            if not got[r.doc_id + 1000].base_failed]
    assert np.mean(kept) > 0.95


def test_classifiers_without_labels(docs, labels):
    none = labels.limit(0)
    assert toxicity.toxicity(docs, none).count() == len(ROWS)
    assert {r.kept for r in quality.quality_rules(docs, none).where("not base_failed").collect()} == {True}
    assert set(quality.keep_good(docs, none).columns) == set(docs.columns)


@pytest.mark.parametrize("given", [[0] * 40, [0, 0, 0, 0, 1]])
def test_rules_alone_decide_without_a_model(spark, docs, given):
    long = spark.createDataFrame([(100 + k, " ".join(f"word{k}_{j}" for j in range(20))) for k in range(len(given))], "doc_id long, text string")
    few = spark.createDataFrame([(100 + k, y) for k, y in enumerate(given)], "doc_id long, quality int")
    got = quality.quality_rules(long, few).collect()
    assert len(got) == len(given) and all(r.kept and not r.base_failed for r in got)
    assert quality.keep_good(long, few).count() == len(given)


# ---------------------------------------------------------------- 4

def groups(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("small", [32, 1])
def test_jaccard_groups_against_all_pairs(spark, docs, real, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL_GROUP", small)
    monkeypatch.setattr(jaccard, "BLOCK", 4000)
    # a chain of near copies whose ends aren't similar, and a group around the threshold
    words = [f"c{i}" for i in range(300)]
    chain = [(5000 + k, " ".join([f"x{k}_{j}" if j < 9 * k else w for j, w in enumerate(words)])) for k in range(12)]
    rng = np.random.default_rng(3)
    near = [(6000 + k, " ".join(np.where(rng.random(150) < 0.03, f"r{k}", [f"d{i}" for i in range(150)]))) for k in range(40)]
    more = spark.createDataFrame(chain + near, "doc_id long, text string")
    df = both(docs, real).select("doc_id", "text").unionByName(more)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df).collect())
    assert got == groups(texts(df))


@pytest.mark.parametrize("block", [1 << 16, 300])
def test_jaccard_link_counts_against_all_pairs(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "LINK_BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LINK_SPLIT", 1 << 30)
    rng = np.random.default_rng(5)
    near = [(6000 + k, " ".join(np.where(rng.random(150) < 0.02, f"r{k}", [f"d{i}" for i in range(150)]))) for k in range(40)]
    near += [(6050, near[0][1]), (6050, near[0][1]), (6051, near[1][1]), (6051, "another text under the same id")]
    df = docs.where("doc_id is not null").select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows, want = texts(df), Counter()
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for (i, _), a in zip(rows, sets):
        want[i, len(a), sum(100 * len(a & b) >= 80 * len(a | b) for b in sets if a and b) - bool(a)] += 1
    got = jaccard.jaccard_groups(df, links=True).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == want
    assert max(r.n_links for r in got) > 10


def test_jaccard_keeps_one_of_each_group(docs):
    kept = jaccard.keep_one_of_each_group(docs)
    assert kept.columns[0] == "doc_id" and set(kept.columns) == set(docs.columns)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 10, 10, 11, 12]


@pytest.mark.parametrize("stage", ["quality", "jaccard", "pii", "mixing"])
def test_stages_take_any_column_names(docs, labels, stage):
    odd = docs.withColumns({c: F.lit(c) for c in ("a.b", "__id", "__cls", "__text", "copy", "given", "row_key")})
    out = {"quality": lambda d: quality.keep_good(d, labels), "jaccard": jaccard.keep_one_of_each_group, "pii": pii.redact,
           "mixing": mixing.mixed_documents}[stage](odd)
    plain = {"quality": lambda d: quality.keep_good(d, labels), "jaccard": jaccard.keep_one_of_each_group, "pii": pii.redact,
             "mixing": mixing.mixed_documents}[stage](docs.select("doc_id", "text", "source", "lang", "n_chars"))
    assert out.columns == odd.columns
    rows = out.collect()
    assert all(r["a.b"] == "a.b" and r["__id"] == "__id" for r in rows)
    keys = ("doc_id", "text", "source")
    assert sorted(str([r[k] for k in keys]) for r in rows) == sorted(str([r[k] for k in keys]) for r in plain.collect())


def test_training_sample_is_bounded_in_bytes(spark, labels):
    given = [(i, ("good words %d " % i) * 20 if i % 2 else ("bad # %d " % i) * 20) for i in range(60)] + [(60, "x y " * 2_000_000)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, quality int")
    sample = linear.bounded_sample(common.text_rows(docs), marks, "quality", 6000, 8_000).collect()
    assert 0 < sum(len(r.text) for r in sample) <= 8_000 and 60 not in {r.doc_id for r in sample}
    whole = linear.bounded_sample(common.text_rows(docs), marks, "quality", 6000, 1 << 24)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == set(range(60))
    wanted = linear.telling_features(whole, quality._features, 4.0, 7)
    assert 0 < len(wanted) <= 7
    _, _, _, idx, _ = linear.collected(whole, quality._features, wanted)
    assert set(idx.tolist()) <= set(wanted.tolist())


def test_character_strings_and_word_pairs():
    rows = ["aé中b", "xy", "one two one"]
    raw = [r.encode() for r in rows]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    prefix = common.prefix_hash(data)
    s, e, d = common.words_of(data, offs)
    words, pairs, chars = quality.ngrams(data, offs, prefix, common.span_hash(prefix, s, e), d)
    assert chars[1].tolist() == [0, 0] + [2] * 9 and pairs[1].tolist() == [2, 2] and words[1].tolist() == [0, 1, 2, 2, 2]
    def slot(t):
        x = np.frombuffer(t.encode(), np.uint8)
        return int(quality._slots(common.span_hash(common.prefix_hash(x), np.array([0]), np.array([len(x)])), 2)[0])
    assert chars[0].tolist() == [slot(r[i:i + 3]) for r in rows for i in range(len(r) - 2)]


def test_jaccard_judges_rows_by_id_and_text(spark):
    near, other = BASE.replace("tok40", "other"), BASE[::-1]
    rows = [(3, BASE), (5, BASE), (5, "an unrelated text under the same id"), (None, near), (None, other), (None, other),
            (None, other.replace("04kot", "xyz")), (7, "a text of its own"), (7, near), (None, ""), (None, None)]
    kept = jaccard.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [tuple(r) for r in kept.collect()]
    assert sorted(r for r in got if r[0]) == [(3, BASE), (5, "an unrelated text under the same id"), (7, "a text of its own")]
    nameless = [t for i, t in got if i is None]
    assert len(nameless) == 3 and nameless.count("") == 1 and nameless.count(None) == 1


# ---------------------------------------------------------------- 5

def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def base_spans(t):
    out = []
    for rank, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                                      ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                                      ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data_against_plain_patterns(spark, docs, real):
    odd = spark.createDataFrame([
        (7001, "é a@b.c_d@e.f x@y.z. +1 (555) 555-12345 1.2.3.4.5.6.7.8 999.1.1.1 1.02.003.0255 4111 1111-1111 1111 +12 3"),
        (7002, "1 " * 3000 + "@" * 50 + "a" * 5000 + " ssn 123-45-6789, token 0123456789abcdef0123456789abcdef"),
        (7003, "a@b.c@d.e a..@-.- +1234567890+1234567890 5500-0000-0000-0004 00000000000000")], "doc_id long, text string")
    df = both(docs, real).select("doc_id", "text").unionByName(odd)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in texts(df):
        want = base_spans(t)
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in pii.BASE_KINDS], i
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), i
        assert set(filter(None, said.split(","))) <= set(r.spans.split(",")), i


def test_reliabilities_follow_the_better_labeler():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    vote = lambda p: np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1
    votes = Counter(zip(*(v.tolist() for v in (vote(0.95), vote(0.9), vote(0.85), vote(0.6), np.zeros(4000, int)))))
    _, table, _ = pii.estimate([(k, float(n)) for k, n in votes.items()])
    right = [t[1, 1] for t in table[:4]]
    assert right == sorted(right, reverse=True) and right[0] > 0.9 and right[3] < 0.75


def test_redaction(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[11].endswith("mail [EMAIL] phone [PHONE], card [CARD]") and text[5] is None and text[10] == LONG


def test_redaction_stores_no_texts(docs, monkeypatch):
    """A table of the spans would hold every text again, for as long as the result is read."""
    tags = []
    monkeypatch.setattr(pii, "staged", lambda df, tag, **k: tags.append(tag) or common.staged(df, tag, **k))
    assert pii.redact(docs).count() == docs.count() and not tags


# ---------------------------------------------------------------- 6

def check_bins(rows, capacities=packing.CAPACITIES):
    bins = {}
    for r in rows:
        if r.length:
            bins.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_offset, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, cap), items in bins.items():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert cap == min(c for c in capacities if c >= at)


def test_packing(docs, real):
    df = both(docs, real)
    rows = packing.pack(df).collect()
    check_bins(rows)
    size = Counter()
    for i, t in texts(df):
        size[i] += len(WORD.findall(t))
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == size and {r.doc_id for r in rows if r.bin_id is None} == {4, 5, 6}


def one_by_one(histogram, capacities, overhead):
    """Bins of the same best-fit rule, piece by piece, with the plan's choice of a new bin's size."""
    left, bins = dict(histogram), []
    for s in sorted(histogram, reverse=True):
        count = histogram[s]
        while count:
            room = [b for b in bins if b[0] - b[1] >= s]
            if room:
                b = min(room, key=lambda b: b[0] - b[1])
            else:
                below = sorted(x for x in histogram if x < s)
                cost = lambda c: (c + overhead) / (min(count, c // s) * s + packing._estimated_fill(
                    c - min(count, c // s) * s, below, left))
                b = [min((c for c in capacities if c >= s), key=lambda c: (cost(c), -c)), 0]
                bins.append(b)
            b[1] += s
            count -= 1
    return sorted(b[1] for b in bins)


def test_plan_equals_best_fit_piece_by_piece():
    rng = np.random.default_rng(2)
    for _ in range(20):
        histogram = {int(s): int(c) for s, c in zip(rng.integers(1, 64, 12), rng.integers(1, 30, 12))}
        placements, bins = packing.plan(histogram, (16, 32, 64), 2)
        assert sum(p[2] * p[0] for p in placements) == sum(s * c for s, c in histogram.items())
        assert sum(n * u for _, n, _, u in bins) == sum(s * c for s, c in histogram.items())
        assert sorted(u for _, n, _, u in bins for _ in range(n)) == one_by_one(histogram, (16, 32, 64), 2)


# ---------------------------------------------------------------- 7

def test_mixture(docs, real):
    df = both(docs, real)
    rows = mixing.mixture(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    names = sorted(s for s in by if s is not None) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    fixed = set()
    while True:  # share, cap, share the excess again
        rest = total - sum(target[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        over = []
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
            if target[s] > 3 * by[s][0].source_size:
                over.append(s)
        if not over:
            break
        for s in over:
            target[s] = 3.0 * by[s][0].source_size
        fixed |= set(over)
    for s in names:
        assert by[s][0].target == pytest.approx(target[s])
        assert sum(r.taken for r in by[s]) == pytest.approx(target[s], abs=0.51)
        assert all(0 <= r.taken <= 3 * r.size for r in by[s])
    again = mixing.mixture(df.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mixed_documents_follow_the_mixture(docs, real):
    df = both(docs, real)
    want, repeated = Counter(), Counter(r.doc_id for r in df.select("doc_id").collect())
    for r in mixing._selected(df).collect():
        want[r.doc_id] += r.epochs + (r.extra > 0 and 2 * r.extra >= r.size)
    got = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert all(got[d] == n for d, n in want.items() if repeated[d] == 1)
    assert not set(got) - set(want)


def test_mixed_documents_exchange_no_text(real):
    plan = mixing.mixed_documents(real)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("symbols", ["", "#" * 4, "#" * 9])
def test_slices_are_even_whatever_the_quality(spark, symbols):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(f"{symbols} " + "word " * 9).alias("text"), F.lit("s").alias("source"))
    most = mixing._measured(df).groupBy("slice").count().agg(F.max("count")).first()[0]
    assert most <= 20_000 / 100


def test_passing_tables_go(spark):
    with common.passing_tables(spark):
        gone, kept = (common.staged(spark.range(3).toDF("a"), "t", keep=k) for k in (False, True))
        paths = [Path(urlparse(f.inputFiles()[0]).path).parent for f in (gone, kept)]
        assert all(p.exists() for p in paths)
    assert not paths[0].exists() and kept.count() == 3


def test_mixed_documents_keep_their_columns(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert all(n <= 3 * sum(r[0] == d for r in ROWS) for d, n in Counter(r.doc_id for r in out.collect()).items())


# ---------------------------------------------------------------- 8

def test_elias_fano_round_trip():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 1000):
        for step in (1, 3, 1000):
            x = np.cumsum(rng.integers(0, step + 1, n))
            ef = tokens.EliasFano.of(x)
            assert ef.values().tolist() == x.tolist() == [ef.select(i) for i in range(n)]
            some = rng.integers(0, n, 40)
            assert ef.select_many(np.arange(n)).tolist() == x.tolist() and ef.select_many(some).tolist() == x[some].tolist()
    far = np.array([0, 0, 5, 1 << 40, (1 << 61) + 3, (1 << 61) + 3, (1 << 62) + 1])
    assert tokens.EliasFano.of(far).select_many(np.arange(len(far))).tolist() == far.tolist()
    assert not len(tokens.EliasFano.of(far[:0]).select_many(np.arange(0)))


def test_tokens_round_trip(spark, docs, real):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = spark.createDataFrame([(8001, "It's <|endoftext|>x ½ ﬁ Ångström é a b \x1c z ᾳΣ 'Sie' don't 12ab_é!"), (8002, "İß ǅ ́x")],
                                "doc_id long, text string")
    df = both(docs, real).select("doc_id", "text").unionByName(odd)
    got = tokens.read_tokens(spark, tokens.write_tokens(df, path)).collect()
    t, at, want = Tokenizer.from_file(path), 0, []
    for i, text in sorted(texts(df)):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == want


# ---------------------------------------------------------------- 10

def test_fingerprints(docs, real):
    df = both(docs, real).dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    rows = sorted(texts(df))
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        own, edited, following = fingerprints.fingerprints([x.encode() for x in (t, e, n)])
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.written(own), fingerprints.written(edited))
        assert fingerprints.read(r.fingerprint).tolist() == own.tolist()
        assert (r.near_edited, r.near_next) == (fingerprints.containment(own, edited), fingerprints.containment(own, following))
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0


def test_chunks_resist_shifts():
    text = " ".join(f"word{i * 31 % 977}" for i in range(3000)).encode()
    a, b = fingerprints.fingerprints([text, b"some words in front " + text[:9000] + b"INSERTED" + text[9000:]])
    assert fingerprints.containment(a, b) > 0.95


# ---------------------------------------------------------------- all

@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, docs, labels, name):
    none = docs.limit(0)
    items = spark.createDataFrame([("i", "some words")], "item_id string, text string")
    run = {"op1": licenses.license_scan, "op2": suffixes.without_repeats, "op3": lambda d: toxicity.toxicity(d, labels),
           "op4": jaccard.jaccard_groups, "op5": pii.personal_data, "op6": packing.pack, "op7": mixing.mixture,
           "op8": lambda d: tokens.read_tokens(spark, tokens.write_tokens(d, _path())),
           "op9": lambda d: quality.quality_rules(d, labels), "op10": fingerprints.fingerprint_documents,
           "op11": lambda d: ranking.ranked(d, items), "op12": periods.periodic_runs,
           "op13": lambda d: leaks.benchmark_hits(d, items)}[name.split("_")[0]]
    assert run(none).count() == 0


def _path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["op2", "op5", "op6", "op8", "op10"])
def test_rows_without_id(spark, docs, name):
    rows = {"op2": suffixes.without_repeats, "op5": pii.personal_data, "op6": packing.pack,
            "op8": lambda d: tokens.read_tokens(spark, tokens.write_tokens(d, _path())),
            "op10": fingerprints.fingerprint_documents}[name](docs)
    got = rows.collect()
    assert len(got) == (18 if name == "op6" else len(ROWS)) and any(r.doc_id is None for r in got)


def test_personal_data_plan_is_native(spark):
    plan = pii.with_spans(common.text_rows(common.documents(spark, SMALL)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    kept = common.documents(spark, SMALL)
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(stage(spark, kept, SMALL), f"test-{name}")
        assert out.columns == columns
        if name in ("quality", "jaccard"):
            assert 0 < out.count() < kept.count()
        kept = out
    check_bins(corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect())
