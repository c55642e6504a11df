"""Counterfactual-regularised toxicity classifier.

A linear model over hashed words and word beginnings.  It is fitted on a bounded
sample of labelled documents (``SAMPLE`` rows, the first by a hash of doc_id):
logistic loss, L1 shrinkage, and a counterfactual penalty.  For the penalty,
each identity term in the labelled sentences is swapped for every other term of
its group, and for none, and the squared change of the sentence's score is
charged, so that a mention of a group by itself moves no score.  Scoring reads
every text whole.

Cases: a null or empty text scores by the intercept alone; labels without a
toxic mark are not learned from; with no usable label every score is 0.5 and
with one class only the intercept is fitted; repeated rows score alike, and of
two labels of one doc_id the toxic one counts; very long texts are whole; extra
columns and columns of ``labels`` of the same names are left aside.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .simhash import LOWER

SAMPLE = 12_000
DIM = 1 << 18
THRESHOLD = 0.7
#: Terms of one tuple are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)
_EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_"
MEMORY = 500_000
_GROUP = {t.encode(): tuple(x.encode() for x in group) for group in IDENTITY for t in group}
_SENTENCE = re.compile(rb"[.!?\n]+")


def features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a lower-cased word without its punctuation: the word and its beginnings."""
    h = xxhash.xxh32_intdigest
    out = [h(word) % DIM]
    for n in (4, 5, 7):
        if len(word) > n:
            out.append(h(word[:n], n) % DIM)
    return tuple(out)


def words(text: bytes | None) -> set[bytes]:
    return {w.strip(_EDGE) for w in set((text or b"").translate(LOWER).split())} - {b""}


def counterfactuals(text: bytes | None) -> list[tuple[set[bytes], set[bytes]]]:
    """(words of a sentence, words with an identity term swapped) for each sentence of a text that holds terms.

    A term goes to every other one of its group, which takes its place in turn
    where the sentence holds both, and to none.
    """
    out = []
    for sentence in _SENTENCE.split((text or b"").translate(LOWER)):
        own = [w.strip(_EDGE) for w in sentence.split()]
        for a in sorted(_GROUP.keys() & set(own)):
            for b in (*_GROUP[a], b""):
                if a != b:
                    out.append((set(own) - {b""}, {b if w == a else a if w == b else w for w in own} - {b""}))
    return out


def _packed(words: set[bytes]) -> bytes:
    return np.array([f for w in sorted(words) for f in features(w)], "<u4").tobytes()


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[tuple[int, bytes]], list[tuple[bytes, bytes]]]:
    """((toxic, packed features) of the sample, (features of a sentence, those of its swap)); rows whose remainder says held out stay away."""
    mark = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_d"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("_d")))
    mark = mark.groupBy("_d").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_d"), "_d").limit(sample)
    rows = docs.select("doc_id", "text").join(mark, F.col("doc_id") == F.col("_d")).select("toxic", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            swaps = [[{"a": _packed(x), "b": _packed(y)} for x, y in counterfactuals(t)] for t in texts]
            pair = pa.struct([("a", pa.binary()), ("b", pa.binary())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packed(words(t)) for t in texts], pa.binary()), pa.array(swaps, pa.list_(pair))], names=["toxic", "f", "swaps"])

    got = rows.mapInArrow(run, "toxic int, f binary, swaps array<struct<a: binary, b: binary>>").collect()
    return sorted((r.toxic, bytes(r.f)) for r in got), sorted((bytes(s.a), bytes(s.b)) for r in got for s in r.swaps)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


class Rows:
    """Feature lists laid out one after the other."""

    def __init__(self, lists: list[np.ndarray]):
        self.n = len(lists)
        self.x = np.concatenate([np.zeros(0, np.int32), *[v.astype(np.int32) for v in lists]])
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(v) for v in lists])

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(self.row, weights[self.x], minlength=self.n) + bias, -30, 30)))

    def gradient(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.x, r[self.row], minlength=DIM)


def fit(rows: list[tuple[int, bytes]], swaps: list[tuple[bytes, bytes]] = (), steps: int = 120, rate: float = 0.5, shrink: float = 2e-4, fairness: float = 5.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by AdaGrad with soft thresholds over the whole sample; ``shrink`` holds at ``SAMPLE`` rows and grows for fewer.

    ``fairness`` times the mean squared change of the score from a sentence to
    its swap is added to the loss.  Besides the sentences of the sample, every
    term by itself counts as a sentence, so that terms that the sample lacks
    are bound too.
    """
    weights = np.zeros(DIM)
    if not rows:
        return weights, 0.0
    y = np.array([r[0] for r in rows], dtype=float)
    share = y.mean()
    shrink *= math.sqrt(SAMPLE / len(y))  # the noise of a gradient falls with the root of the sample
    if share in (0.0, 1.0):
        return weights, 6.0 if share else -6.0
    lists = [np.frombuffer(r[1], "<u4") for r in rows]
    seen = np.bincount(np.concatenate([np.unique(x) for x in lists]), minlength=DIM)
    docs = Rows([x[seen[x] >= 3] for x in lists])
    alone = [(_packed({a}), _packed({b} - {b""})) for a, group in _GROUP.items() for b in (*group, b"") if a != b]
    pairs = [*swaps, *alone]
    here, there = (Rows([(f := np.frombuffer(p[i], "<u4"))[seen[f] >= 3] for p in pairs]) for i in (0, 1))
    bias, g2, gb2 = float(np.log(share / (1 - share))), np.full(DIM, 1e-8), 1e-8
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    charge = 2 * fairness / len(pairs)
    for _ in range(steps):
        r = (docs.scores(weights, bias) - y) * cost
        p, q = here.scores(weights, bias), there.scores(weights, bias)
        up, down = charge * (p - q) * p * (1 - p), charge * (p - q) * q * (1 - q)
        grad = docs.gradient(r) + here.gradient(up) - there.gradient(down)
        step = r.sum() + up.sum() - down.sum()
        g2 += grad**2
        gb2 += step**2
        pace = rate / np.sqrt(g2)
        weights -= pace * grad
        weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * shrink, 0)
        bias -= rate / np.sqrt(gb2) * step
    return weights, float(bias)


#: The scores of words under one model, named by its token.
_KNOWN: dict[str, dict[bytes, float]] = {}


def score_documents(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted.  The weights, of a fixed number, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, weights.astype(np.float32), bias))

    def run(batches):
        token, w, b0 = shared.value
        if token not in _KNOWN:
            _KNOWN.clear()
        known = _KNOWN.setdefault(token, {})
        for b in slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                if len(known) > MEMORY:
                    known.clear()
                total = b0
                own = set((t or b"").translate(LOWER).split())
                for raw in own.difference(known):
                    bare = raw.strip(_EDGE)
                    known[raw] = float(w[list(features(bare))].sum()) if bare else 0.0
                total += sum([known[x] for x in own])
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))
            score = np.array(out, dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score_documents(docs, *fit(*sampled(docs, labels, sample)))
