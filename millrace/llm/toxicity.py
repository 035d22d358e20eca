"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (3 to 6, lower case, words bounded by spaces) it contains.  Feature
``j`` has the value ``r_j = log(((p_j + 1) / (p + 2)) / ((q_j + 1) / (q + 2)))``, where ``p_j`` of ``p`` toxic and ``q_j`` of
``q`` other texts of the sample hold it; an L2-regularised logistic regression on these values, in which both classes
weigh the same, gives the weights.  The features are the :data:`FEATURES` n-grams of greatest chi-squared among those of at
least :data:`LEAST_DOCUMENTS` texts of the sample.

The model is fitted on the driver from a bounded sample of labelled rows (``per_class`` rows of each class); scoring is
one narrow pass over the corpus, vectorised over Arrow batches, with no shuffle.  A long text passes in blocks of half a
megabyte that overlap by the longest n-gram, so its score is that of the whole and memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import adam, code_point_blocks, frugal, held_out, labelled_sample, mix, sigmoid

ORDERS = (3, 4, 5, 6)
#: Rows of each class that the model is fitted on, at most (in expectation).
PER_CLASS = 800
#: n-grams that the model is fitted on, and the texts of the sample that must hold one.
FEATURES = 4096
LEAST_DOCUMENTS = 2
_SLOTS = 1 << 21
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class ToxicityModel:
    """Sorted n-gram hashes, the weight of each (coefficient times log-count ratio) and the intercept."""

    grams: np.ndarray
    weights: np.ndarray
    intercept: float


def _gram_hashes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    wide = points.astype(np.uint64)
    rolling = np.zeros(len(wide), np.uint64)
    for n in range(1, ORDERS[-1] + 1):
        if len(wide) < n:
            return
        rolling = rolling[: len(wide) - n + 1] * _MULTIPLIER + wide[n - 1 :]
        if n in ORDERS:
            yield n, mix(rolling + np.uint64(n))


def _documents(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text."""
    for _, points, starts, ends in code_point_blocks(pa.array(texts, pa.large_string())):
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            grams = [h for _, h in _gram_hashes(points[a:b])]
            yield np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)


def fit(rows: list[tuple[int, str, int]], features: int = FEATURES, l2: float = 1e-3, prior: float | None = None) -> ToxicityModel:
    """Fits on (id, text, label) rows.  Without rows of both classes every text scores the smoothed share of label 1."""
    y = np.array([r[2] for r in rows], float)
    toxic, other = y.sum(), len(y) - y.sum()
    if not toxic or not other:
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), float(np.log((toxic + 0.5) / (other + 0.5))))
    counts = np.zeros((2, _SLOTS), np.float32)
    mask = np.uint64(_SLOTS - 1)
    for label, grams in zip(y, _documents([r[1] for r in rows]), strict=True):
        counts[int(label), np.unique((grams & mask).astype(np.int64))] += 1
    q, p = counts
    # chi-squared of presence against label chooses the features
    df = p + q
    chi = (p * other - q * toxic) ** 2 / (df * (toxic + other - df) + 1.0)
    chi[df < LEAST_DOCUMENTS] = 0
    slots = np.argsort(-chi, kind="stable")[:features]
    slots = slots[chi[slots] > 0]
    chosen = np.zeros(_SLOTS, bool)
    chosen[slots] = True
    per_row = [g[chosen[(g & mask).astype(np.int64)]] for g in _documents([r[1] for r in rows])]
    grams, df = np.unique(np.concatenate(per_row), return_counts=True)
    grams = grams[df >= LEAST_DOCUMENTS]
    columns, sizes = [], []
    for g in per_row:
        at = np.searchsorted(grams, g)
        at = at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == g)] if len(grams) else at[:0]
        columns.append(at)
        sizes.append(len(at))
    column, row = np.concatenate(columns), np.repeat(np.arange(len(rows)), sizes)
    pj = np.bincount(column, y[row], len(grams)) + 1.0
    qj = np.bincount(column, 1.0 - y[row], len(grams)) + 1.0
    r = np.log((pj / (toxic + 2)) / (qj / (other + 2)))
    balance = np.where(y == 1, 0.5 / toxic, 0.5 / other)

    def gradient(w: np.ndarray) -> np.ndarray:
        z = np.bincount(row, (w[:-1] * r)[column], len(rows)) + w[-1]
        g = balance * (sigmoid(z) - y)
        return np.concatenate([np.bincount(column, g[row], len(grams)) * r + l2 * w[:-1], [g.sum()]])

    w = adam(gradient, np.zeros(len(grams) + 1), 300, 0.05)
    shift = 0.0 if prior is None else float(np.log(prior / (1 - prior)))
    return ToxicityModel(grams, w[:-1] * r, float(w[-1] + shift))


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[(model.grams & np.uint64(_SLOTS - 1)).astype(np.int64)] = True

    def __call__(self, column: pa.Array) -> np.ndarray:
        model, out = self.model, np.full(len(column), self.model.intercept)
        size = len(model.grams)
        if not size:
            return sigmoid(out)
        last, seen = -1, np.zeros(size, bool)
        for lo, points, starts, ends in code_point_blocks(column, overlap=ORDERS[-1] - 1):
            found = []
            for n, h in _gram_hashes(points):
                at = np.flatnonzero(self.slots[(h & np.uint64(_SLOTS - 1)).view(np.int64)])
                feature = np.minimum(np.searchsorted(model.grams, h[at]), size - 1)
                doc = np.searchsorted(starts, at, "right") - 1
                good = (model.grams[feature] == h[at]) & (at + n <= ends[doc])
                found.append(doc[good] * size + feature[good])
            if not found:
                continue
            pairs = np.unique(np.concatenate(found))
            if len(starts) == 1:  # perhaps a piece of a long text: a feature counts once in all of them
                if lo != last:
                    last, seen = lo, np.zeros(size, bool)
                pairs = pairs[~seen[pairs]]
                seen[pairs] = True
            out[lo : lo + len(starts)] += np.bincount(pairs // size, model.weights[pairs % size], len(starts))
        return sigmoid(out)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Score between 0 and 1 of a text column; null and empty texts score the intercept."""

    @F.arrow_udf("double")
    @frugal
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(model)
        for batch in batches:
            yield pa.array(scorer(batch), pa.float64())

    return score(text)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    return fit(labelled_sample(docs, labels, "toxic", per_class))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Nulls: a null text is an empty one; a null id gives ``held_out`` false and is never learned from; labels that are null
    are ignored.  Repeated rows are scored each.  An empty table gives an empty result; without labels of both classes all
    texts get one score.  Ties: equal texts have equal scores.  Other columns are ignored, whatever their names.  A text of
    any length is scored whole, in bounded memory.
    """
    model = train(docs, labels, per_class)
    scored = docs.select(F.col("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that score below ``threshold``.

    A null text is judged as an empty one; repeated rows are judged each; an empty table gives an empty result.
    """
    return docs.where(toxicity_score(F.col("text"), train(docs, labels, per_class)) < threshold)
