"""Toxicity: counterfactual-regularised logistic regression on hashed words.

Trained on at most ``SAMPLE`` rows that ``labels.toxic`` marks and that are not held out (rows whose
crc32 of doc_id is a multiple of 5 are held out). For every training text that names an identity
group, the term is swapped for the other terms of its group, and the squared change of the score is
added to the objective: equal texts about different groups get nearly equal scores, so a neutral
mention of one group gets no weight that only its company in the sample would justify.

Words enter the model only if their share of toxic texts is unlikely by chance (``EVIDENCE``): with
invented or rare words a regression would otherwise learn the sample by heart. Terms of a swap stay.

A text's features are its distinct words: lower-cased (A-Z) runs of letters, digits and bytes above
127, so marks around a word don't hide it. Whole texts are scored in Arrow batches; labels, lang,
source and doc_id are no inputs. Null texts score as empty ones (the bias alone). Without labels of
both kinds the score is the share of label 1. Empty input: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopscope.llm import linear
from shopscope.llm.common import lower_ascii, prefix_hash, span_hash, text_rows, text_slices, words_of

#: Labelled rows that the regression is trained on, at most.
SAMPLE = 16_000
BITS = 20
SWAP_PENALTY = 10.0
#: Words whose label share would be as far off by chance with a probability above exp(-EVIDENCE) are left out.
EVIDENCE = 8.0
THRESHOLD = 0.5
#: Terms that may stand for each other in a sentence, by group (fixed values).
IDENTITY_TERMS = {
    "gender": ["women", "men", "transgender", "nonbinary", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
    "gender_one": ["woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"],
    "religion": ["muslim", "jewish", "christian", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"],
    "religions": ["muslims", "jews", "christians", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"],
    "origin": ["black", "white", "asian", "african", "european", "arab", "latino", "hispanic", "indigenous"],
    "nation": ["american", "chinese", "mexican", "indian", "turkish", "french", "german", "spanish", "polish"],
    "status": ["immigrants", "refugees", "migrants", "foreigners", "natives", "citizens"],
    "age": ["old", "young", "elderly", "teenage"],
    "ability": ["blind", "deaf", "disabled", "autistic", "sighted"],
}
_GAP = np.ones(256, dtype=bool)
_GAP[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, feature) pairs of a slice."""
    data = lower_ascii(data)
    s, e, d = words_of(data, offs, _GAP)
    h = span_hash(prefix_hash(data), s, e) >> np.uint64(64 - BITS)
    key = np.unique(d.astype(np.int64) << BITS | h.astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def term_feature(term: str) -> int:
    raw = np.frombuffer(term.encode(), np.uint8)
    return int(features(raw, np.array([0, len(raw)]))[1][0])


def _rows(batch):
    for lo, hi, data, offs in text_slices(batch):
        d, f = features(data, offs)
        at = np.searchsorted(d, np.arange(hi - lo + 1))
        yield [(f[i:j], np.ones(j - i)) for i, j in zip(at, at[1:])]


def swaps_of(indptr: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term taken out, term put in, number of texts) of every counterfactual of the sample."""
    times = np.bincount(idx, minlength=1 << BITS)
    out = [(a, b, times[a]) for group in IDENTITY_TERMS.values()
           for a in map(term_feature, group) if times[a] for b in map(term_feature, group) if a != b]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, swap_penalty: float = SWAP_PENALTY) -> linear.Model:
    sample = linear.labelled_sample(text_rows(docs), labels.where(~held_out()), "toxic", rows)
    ids, y, indptr, idx, val = linear.collected(sample, _rows)
    # every term of a swap gets a weight, also where the sample never shows it
    swaps = swaps_of(indptr, idx)
    seen = np.unique(swaps[1]) if len(swaps[1]) else np.zeros(0, np.int64)
    indptr, idx, val = linear.only(np.union1d(linear.informative(y, indptr, idx, EVIDENCE), seen), indptr, idx, val)
    if len(seen):
        idx, val = np.concatenate((idx, seen.astype(np.int32))), np.concatenate((val, np.zeros(len(seen), np.float32)))
        indptr = indptr.copy()
        indptr[-1] += len(seen)
    return linear.fit(ids, y, indptr, idx, val, dim=1 << BITS, l2=1e-4, swaps=swaps, swap_penalty=swap_penalty)


def _score(model):
    def run(batches):
        m = model.value
        for b in batches:
            dots = []
            for lo, hi, data, offs in text_slices(b):
                d, f = features(data, offs)
                dots.append(np.bincount(d, m.weight[f], minlength=hi - lo))
            p = m.probability(np.concatenate(dots)) if dots else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return text_rows(docs).mapInArrow(_score(model), "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
