"""Periodic stretches of words: every maximal repetition of at least four periods (and six words).

A run is a stretch of consecutive words with smallest period q, at least max(6, 4q) words long, that no
neighbouring word extends. Seed and extend on diagonals:

1. At lag q, word i of a run equals word i + q on a diagonal of at least max(6, 4q) - q words. Lags fall
   into bands 1, 2-3, 4-7, 8-15, ...; the least overlap that a band's runs guarantee (5, 6, 12, 24, ...
   words) is the length k of the k-grams indexed for it. k-grams are named exactly: two neighbouring
   shorter grams with names are renamed by one sort, and only grams that occur again keep a name, so
   the long bands see almost nothing of ordinary text.
2. Pairs: an occurrence and the next one of the same k-gram in the same document, if their lag is in
   the band. As k >= q and a run's root isn't itself a repetition, the next occurrence inside a run is
   exactly q ahead: n pairs a band at most, never all pairs of a gram's occurrences, and a pair's lag is
   the smallest period of its stretch.
3. Furthest-covered table: pairs in order of (lag, place). The table's entry of a lag is the end of
   what its last pair covers; a pair that starts within it is no new extension and only moves the end.
   A stretch of a diagonal holds a pair at each place, so the entry reached last is its exact end.

Words are runs of bytes other than space and \\t-\\r, compared as bytes. Null or empty texts have no words
and no runs. Repeated rows are judged one by one; a document never leaves its row, so there is no exchange
and no group that could grow. Empty input: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopscope.llm.common import text_rows

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words that are searched at once (a longer document is searched alone).
WORDS_AT_ONCE = 1 << 18

_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(first: np.ndarray, second: np.ndarray, shift: int):
    """Names of the grams first[i] + second[i + shift] that occur again, else -1, and the places of
    all that do, ordered by (name, place)."""
    n = len(first)
    names = np.full(n, -1, dtype=np.int64)
    at = np.flatnonzero((first[:n - shift] >= 0) & (second[shift:] >= 0)) if n > shift else np.zeros(0, np.int64)
    if not len(at):
        return names, at
    key = first[at] * np.int64(n + 1) + second[at + shift]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = key[1:] == key[:-1]
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    at, key = at[again], key[again]
    if len(at):
        names[at] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    return names, at


def _stretches(names: np.ndarray, at: np.ndarray, k: int, low: int, high: int):
    """(start, length, period) of the stretches whose pairs have a lag from ``low`` to ``high``."""
    lag = at[1:] - at[:-1]
    pair = np.flatnonzero((names[at[1:]] == names[at[:-1]]) & (lag >= low) & (lag <= high))
    if not len(pair):
        return np.zeros((0, 3), np.int64)
    lag, place = lag[pair], at[pair]
    order = np.lexsort((place, lag))
    lag, place = lag[order], place[order]
    covered = place[:-1] + k
    new = np.concatenate(([True], (lag[1:] != lag[:-1]) | (place[1:] > covered)))
    head = np.flatnonzero(new)
    last = np.concatenate((head[1:], [len(place)])) - 1
    start, period = place[head], lag[head]
    length = place[last] + k - start + period
    keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return np.stack((start, length, period), axis=1)[keep]


def find_runs(ids: np.ndarray) -> np.ndarray:
    """All runs of a sequence of word numbers as rows (start, length, period), ordered by start, period.

    Documents may stand one after the other if no number occurs in two of them: no repeated gram and
    no run then crosses a border."""
    one, _ = _named(ids, ids, 0)
    two, _ = _named(one, one, 1)
    four, _ = _named(two, two, 2)
    out = [_stretches(*_named(four, one, 4), 5, 1, 1)]
    names, at = _named(four, two, 4)
    low, k = 2, 6
    while len(at):
        out.append(_stretches(names, at, k, low, 2 * low - 1))
        names, at = _named(names, names, k)
        low, k = 2 * low, 2 * k
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def echoed(words: list[bytes], seed: int | None) -> list[bytes]:
    """A known repetition put into a document: from word a = seed mod n on, its words repeat with
    period 1 + (n - a) div (3 + seed mod 8). ``None`` leaves the words as they are."""
    n = len(words)
    if seed is None or not n:
        return words
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _results(rows: list[tuple]) -> pa.RecordBatch:
    numbers, border = [], [0]
    for _, words in rows:
        known = {w: i for i, w in enumerate(dict.fromkeys(words), border[-1])}
        numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        border.append(border[-1] + len(words))
    ids = np.concatenate(numbers)
    runs = find_runs(ids)
    step = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(step[:-1]) == 0
    edge = np.array(border)
    cut = np.searchsorted(runs[:, 0], edge)
    base = np.repeat(edge[:-1], np.diff(cut))
    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - base), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN)))
    collapsed = []
    for i, (_, words) in enumerate(rows):
        if cut[i] < cut[i + 1]:
            words = [words[j] for j in np.flatnonzero(kept[border[i]:border[i + 1]]).tolist()]
        collapsed.append(b" ".join(words))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.diff(edge)), lists, pa.array(collapsed, pa.binary())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def _search(batches):
    for b in batches:
        rows, size = [], 0
        seeds = b.column("echo")
        texts = b.column("text").cast(pa.binary())
        for i, doc in enumerate(b.column("doc_id").to_pylist()):
            words = echoed(texts[i].as_py().split(), seeds[i].as_py())
            rows.append((doc, words))
            size += len(words)
            if size >= WORDS_AT_ONCE:
                yield _results(rows)
                rows, size = [], 0
        if rows:
            yield _results(rows)


def periodic_runs(docs: DataFrame, echo: Column | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of each document ordered by start, then period, and
    its words without those that only repeat (a run's words after its first period), joined by a space.

    ``echo``: for trials, seeds (null: none) of repetitions that are put into the documents first."""
    given = F.lit(None) if echo is None else echo
    return text_rows(docs, given.cast("long").alias("echo")).mapInArrow(_search, _SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (exactly compared; ties: smallest start, then period)."""
    def order(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(a != b, F.when(a > b, -1).otherwise(1))
                .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
                .when(x["period"] != y["period"], F.when(x["period"] < y["period"], -1).otherwise(1)).otherwise(0))

    return F.get(F.array_sort(runs, order), 0)
