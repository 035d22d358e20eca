"""Quality: Bradley-Terry pairwise ranking of documents.

A document's strength is a linear function of features of its form (shares of character classes, word lengths, repeated
words and lines, marks glued to words) and of its words (their shares in hashed buckets).  Every labelled document that may
be learned from is preferred, or not, to every one of the other label; the logistic loss on the differences of the features
of all these pairs gives the weights, as in a Bradley-Terry model.  The strength below which the known share of worse
documents falls (a quantile of the training strengths) is the threshold; the score is the probability that a document beats
one at the threshold.

The pairs are never rows.  A document's part in the gradient depends on its own strength and on how the strengths of the
other label lie, so an evaluation is two passes over a table of the labelled documents' features: one counts strengths at
the nodes of a grid of 1/64 (between two nodes by distance), one sums features weighted by the mean probability of losing to
(or beating) the other label, taken from that grid; linear interpolation at this width moves a probability by less than 1e-5.
What comes to the driver are sums of fixed size.

Features and scores are one narrow vectorised pass.  A long text passes in blocks of half a megabyte whose sums add up, so
memory is bounded but for eight bytes for each of its distinct words and lines; a line of more than a block counts as lines
of that size.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BLOCK_ROWS, fold, hash_spans, held_out, materialize, sigmoid, text_word_spans, utf8_blocks
from millrace.scratch import temporary

#: Buckets of word hashes, and how much stronger their weights are held down than those of the form.
WORD_BUCKETS, WORD_PENALTY = 256, 100.0
#: Standardised features are clipped to this range, so that one odd value does not decide.
CLIP = 6.0
#: Nodes of the grid of strengths to a unit, and the strength at its ends, where stronger ones count.
GRID, REACH = 64, 512
#: Steps of the fit, at most, and the gain of a step (in loss) below which it ends.
STEPS, LEAST_GAIN = 40, 1e-6
#: Strengths around the threshold that come to the driver, at most.
NEAREST = 50_000
#: Cells that the threshold is narrowed down by.
CELLS = 1 << 12
#: Bits for each labelled id of the bitmap that spares other texts a join, and bits of it at most.
BITS_PER_ID, MOST_BITS = 32, 1 << 28
_N_NODES = 2 * REACH * GRID + 1

#: Marks whose share of all bytes is a feature of its own.
MARKS = b"|!%#$&*@<>{}[]=_/\\~^+;:?.,-"
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n",
}
_TABLE = np.full(256, len(_CLASSES) + len(MARKS) + 1, np.int64)
for _k, _chars in enumerate([*_CLASSES.values(), *(bytes([m]) for m in MARKS)]):
    _TABLE[list(_chars)] = _k
_TABLE[128:] = len(_CLASSES) + len(MARKS)
_N_CLASSES = len(_CLASSES) + len(MARKS) + 2
_MARK = np.ones(256, bool)
_MARK[128:] = False
for _chars in (*_CLASSES.values(), b"\r\f\v\0.,;:?!'\"()-"):
    _MARK[list(_chars)] = False
_UPPER = np.zeros(256, bool)
_UPPER[list(_CLASSES["upper"])] = True

NAMES = [
    *(f"share_{c}" for c in _CLASSES), *(f"share_{chr(m)}" for m in MARKS), "share_other_script", "share_other",
    "log_words", "few_words", "word_length", "word_length_spread", "long_words", "distinct_words", "repeats_previous",
    "upper_words", "marked_words", "line_length", "short_lines", "repeated_lines", "marked_lines", "upper_lines",
    *(f"words_{k}" for k in range(WORD_BUCKETS)),
]
_FORM = len(NAMES) - WORD_BUCKETS


#: Sums over a text's bytes, words and lines that add up over its pieces, beside the counts of classes and buckets.
_SUMS = ["bytes", "words", "length", "length2", "long", "distinct", "repeats", "upper", "marked", "lines", "short", "repeated", "dense", "shouted"]


def _same(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of each owner's hashes are distinct."""
    order = np.lexsort((hashes, owner))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return np.bincount(owner[order][first], minlength=n)


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text; an empty text has the features of no words at all."""
    size = len(column)
    counts, buckets, sums = np.zeros((size, _N_CLASSES)), np.zeros((size, WORD_BUCKETS)), np.zeros((size, len(_SUMS)))
    last, held = -1, ([], [], [])  # the word and line hashes, and the last word, of the pieces of one text

    def settle() -> None:
        if last >= 0 and len(held[2]) > 1:
            sums[last, 5] = len(np.unique(np.concatenate(held[0])))
            sums[last, 11] = sums[last, 9] - len(np.unique(np.concatenate(held[1])))

    for lo, raw, offsets in utf8_blocks(column):
        if not len(raw):
            continue
        n, sizes = len(offsets) - 1, np.diff(offsets)
        if n > 1 or lo != last:
            settle()
            last, held = lo if n == 1 else -1, ([], [], [])
        text_of = np.repeat(np.arange(n), sizes)
        counts[lo : lo + n] += np.bincount(text_of * _N_CLASSES + _TABLE[raw], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
        starts, ends = text_word_spans(raw, offsets)
        words = text_of[starts]
        lengths = (ends - starts).astype(float)
        hashes = hash_spans(raw, starts, ends)
        buckets[lo : lo + n] += np.bincount(words * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
        repeat = np.zeros(len(words), bool)
        repeat[1:] = (hashes[1:] == hashes[:-1]) & (words[1:] == words[:-1])
        if len(hashes) and held[2] and held[2][-1] == hashes[0]:
            repeat[0] = True
        upper = _UPPER[raw[starts]] & _UPPER[raw[np.minimum(starts + 1, ends - 1)]] & (lengths > 1)
        marked = _MARK[raw[np.minimum(ends, len(raw) - 1)]] & (ends < offsets[1:][words])
        bounds = np.unique(np.concatenate([[0], np.flatnonzero(raw == 10) + 1, offsets[:-1], [len(raw)]]))
        a, b = bounds[:-1], bounds[1:]
        full = (b - a) > 1
        a, b = a[full], b[full]
        lines = text_of[a]
        line_hash = hash_spans(raw, a, np.where(raw[b - 1] == 10, b - 1, b))
        marks_before = np.concatenate([[0], np.cumsum(_MARK[raw] | (raw == 33))])
        upper_before = np.concatenate([[0], np.cumsum(_UPPER[raw])])
        dense = (marks_before[b] - marks_before[a]) > 0.04 * (b - a)
        shouted = (upper_before[b] - upper_before[a]) > 0.4 * (b - a)
        of_words = lambda x: np.bincount(words, x, n)
        of_lines = lambda x: np.bincount(lines, x, n)
        many, n_lines = np.bincount(words, minlength=n), np.bincount(lines, minlength=n)
        sums[lo : lo + n] += np.stack(
            [
                sizes, many, of_words(lengths), of_words(lengths**2), of_words(lengths > 20), _same(hashes, words, n), of_words(repeat), of_words(upper),
                of_words(marked), n_lines, of_lines((b - a) < 20), n_lines - _same(line_hash, lines, n), of_lines((b - a) * dense), of_lines((b - a) * shouted),
            ],
            axis=1,
        )
        if n == 1:
            held[0].append(np.unique(hashes))
            held[1].append(np.unique(line_hash))
            held[2].append(hashes[-1] if len(hashes) else None)
    settle()
    s = dict(zip(_SUMS, sums.T, strict=True))
    words, bytes_, lines = np.maximum(s["words"], 1), np.maximum(s["bytes"], 1), np.maximum(s["lines"], 1)
    mean = s["length"] / words
    log_line = np.where(s["bytes"] > 0, np.log1p(s["bytes"] / lines), 0.0)
    form = [
        np.log1p(s["words"]), s["words"] < 8, mean, np.sqrt(np.maximum(s["length2"] / words - mean**2, 0)), s["long"] / words, s["distinct"] / words,
        s["repeats"] / words, s["upper"] / words, s["marked"] / words, log_line, s["short"] / lines, s["repeated"] / lines, s["dense"] / bytes_, s["shouted"] / bytes_,
    ]
    return np.concatenate([np.sqrt(counts / bytes_[:, None]), np.stack(form, axis=1).astype(float), np.sqrt(buckets / words[:, None])], axis=1)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weights


Step = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]
#: Runs a step (features, labels -> arrays) over all labelled rows, block by block, and puts together what it gives.
Pass = Callable[..., list[np.ndarray]]


def _added(parts: Iterator[list[np.ndarray]]) -> list[np.ndarray]:
    total: list[np.ndarray] = []
    for part in parts:
        total = [a + b for a, b in zip(total, part, strict=True)] if total else part
    return total


def _distinct(parts: Iterator[list[np.ndarray]]) -> list[np.ndarray]:
    """Sorted distinct values with their counts for each label, of parts of that form."""
    held = list(parts)
    if not held:
        return []
    values, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return [values, np.stack([np.bincount(inverse, np.concatenate([h[1][k] for h in held]), len(values)) for k in (0, 1)])]


def _local_pass(x: np.ndarray, y: np.ndarray) -> Pass:
    def run(step: Step, together: Callable = _added) -> list[np.ndarray]:
        return together(step(x[k : k + BLOCK_ROWS], y[k : k + BLOCK_ROWS]) for k in range(0, len(y), BLOCK_ROWS))

    return run


def _table_pass(table: DataFrame) -> Pass:
    """Passes over a table ``y, x``: a task puts its own rows together, the driver the tasks."""

    def run(step: Step, together: Callable = _added) -> list[np.ndarray]:
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for k in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(k, BLOCK_ROWS)
                    x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float32).reshape(part.num_rows, -1)
                    yield step(x.astype(float), part.column("y").to_numpy())

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = together(blocks(batches))
            if own:
                yield pa.record_batch([pa.array([zlib.compress(pickle.dumps(own), 1)], pa.binary())], names=["own"])

        return together(pickle.loads(zlib.decompress(r["own"])) for r in table.mapInArrow(task, "own binary").collect())

    return run


def _nodes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid's node below each strength, and the strength's part of the way to the next."""
    at = np.clip((s + REACH) * GRID, 0, _N_NODES - 1.001)
    low = at.astype(np.int64)
    return low, at - low


def _grid_counts(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many strengths of each label lie at each node; one between two nodes is shared by distance."""
    low, part = _nodes(s)
    low += y * _N_NODES
    return (np.bincount(low, 1 - part, 2 * _N_NODES) + np.bincount(low + 1, part, 2 * _N_NODES)).reshape(2, _N_NODES)


def _meetings(counts: np.ndarray) -> tuple[float, int, np.ndarray]:
    """(mean loss over all pairs, first node, and from there on the mean probability of each label at each node of the wrong
    outcome) of the strengths' counts."""
    held = np.flatnonzero(counts.any(axis=0))
    lo = max(int(held[0]) - 1, 0)  # a node more on either side, should a sum be rounded otherwise the next time
    worse, better = counts[:, lo : int(held[-1]) + 3] / counts.sum(axis=1, keepdims=True)
    n = len(worse)
    lead = np.arange(1 - n, n) / GRID  # of one strength over another
    size = 1 << (3 * n).bit_length()

    def meet(kernel: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(kernel, size) * np.fft.rfft(others, size), size)[n - 1 : 2 * n - 1]

    return float(worse @ meet(np.logaddexp(0, lead), better)), lo, np.stack([meet(sigmoid(lead), better), meet(sigmoid(-lead), worse)])


def _fit_weights(each: Pass, mean: np.ndarray, scale: np.ndarray, sizes: np.ndarray, held_down: np.ndarray) -> np.ndarray:
    """The weights of least loss over all pairs: L-BFGS whose first metric is the curvature where all strengths are equal."""

    def standard(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / scale, -CLIP, CLIP)

    def spread(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = standard(x)
        return [np.stack([z[y == k].sum(axis=0) for k in (0, 1)]), (z.T @ (z / sizes[y][:, None])).astype(np.float32)]

    def loss_at(w: np.ndarray) -> tuple[float, int, np.ndarray]:
        (counts,) = each(lambda x, y: [_grid_counts(standard(x) @ w, y)])
        loss, lo, wrong = _meetings(counts)
        return loss + float(held_down @ w**2) / 2, lo, wrong

    def gradient(w: np.ndarray, lo: int, wrong: np.ndarray) -> np.ndarray:
        def step(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            z = standard(x)
            low, part = _nodes(z @ w)
            chance = wrong[y, low - lo] * (1 - part) + wrong[y, low - lo + 1] * part
            return [(chance * np.where(y == 1, -1.0, 1.0) / sizes[y]) @ z]

        return each(step)[0] + held_down * w

    sums, products = each(spread)
    m0, m1 = sums / sizes[:, None]
    curvature = (products - np.outer(m0, m0) - np.outer(m1, m1) + np.outer(m1 - m0, m1 - m0)) / 4
    metric = np.linalg.inv(curvature + np.diag(held_down + 1e-6))
    w = np.zeros(len(mean))
    loss, *met = loss_at(w)
    g = gradient(w, *met)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        q, shares = g.copy(), []
        for s, t in reversed(past):
            shares.append((s @ q) / (s @ t))
            q -= shares[-1] * t
        q = metric @ q
        if past:
            s, t = past[-1]
            q *= (s @ t) / (t @ metric @ t)
        for (s, t), share in zip(past, reversed(shares), strict=True):
            q += (share - (t @ q) / (s @ t)) * s
        rate, new = 1.0, np.inf
        while rate > 1e-3:
            new, *met = loss_at(w - rate * q)
            if new <= loss - 1e-4 * rate * (g @ q):
                break
            rate /= 2
        gain = loss - new
        if not gain > 0:
            break
        moved = gradient(w - rate * q, *met)
        if -rate * (q @ (moved - g)) > 1e-14:
            past = [*past[-9:], (-rate * q, moved - g)]
        w, g, loss = w - rate * q, moved, new
        if gain < LEAST_GAIN:
            break
    return w


def _threshold(each: Pass, strength: Callable[[np.ndarray], np.ndarray], sizes: np.ndarray, share: float) -> float:
    """The middle of the widest gap among the strengths nearest to the quantile ``share``, where each label has that share.

    Counts in ever narrower cells lead to a stretch of few strengths, which are then looked at one by one.
    """
    weight, total = np.array([share, 1 - share]) / sizes, int(sizes.sum())
    lo, hi, under = -REACH - 1.0, REACH + 1.0, np.zeros(2)
    clipped = lambda x: np.clip(strength(x), -REACH, REACH)

    def first_at(counts: np.ndarray) -> int:
        return min(int(np.searchsorted(weight @ (under[:, None] + np.cumsum(counts, axis=1)), share - 1e-12)), counts.shape[1] - 1)

    for _ in range(4):
        edges = np.linspace(lo, hi, CELLS + 1)

        def count(x: np.ndarray, y: np.ndarray, edges: np.ndarray = edges) -> list[np.ndarray]:
            cell = np.searchsorted(edges, clipped(x), "right") - 1
            own = (cell >= 0) & (cell < CELLS)
            return [np.bincount(y[own] * CELLS + cell[own], minlength=2 * CELLS).reshape(2, CELLS)]

        (counts,) = each(count)
        rows = under.sum() + np.cumsum(counts.sum(axis=0))
        at = first_at(counts)
        # the cells of the quantile and of three strengths on either side
        before, behind = max((rows[at - 1] if at else under.sum()) - 3, under.sum()), min(rows[at] + 2, rows[-1] - 1)
        a, b = int(np.searchsorted(rows, before, "right")), int(np.searchsorted(rows, behind, "right"))
        lo, hi, under = edges[a], edges[b + 1], under + counts[:, :a].sum(axis=1)
        if counts[:, a : b + 1].sum() <= NEAREST:
            break

    def look(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        s = clipped(x)
        own = (s >= lo) & (s < hi)
        return [s[own], np.stack([y[own] == 0, y[own] == 1]).astype(float)]

    values, counts = each(look, _distinct)
    rows, at = under.sum() + np.cumsum(counts.sum(axis=0)), first_at(counts)
    # of equal strengths the quantile takes as many as it needs
    start = rows[at] - counts[:, at].sum()
    below = float(weight @ (under + counts[:, :at].sum(axis=1)))
    k = start + max(np.ceil((share - below - 1e-12) / (weight @ counts[:, at]) * counts[:, at].sum()) - 1, 0)
    k = min(k, total - 2)
    near = np.arange(max(k - 2, 0), min(k + 3, total - 1))
    here = lambda k: values[np.minimum(np.searchsorted(rows, k, "right"), len(values) - 1)]
    g = near[(here(near + 1) - here(near)).argmax()]
    return float((here(g) + here(g + 1)) / 2)


def _fit(each: Pass, l2: float, share_worse: float | None) -> QualityModel:
    size = len(NAMES)
    sums = each(lambda x, y: [np.bincount(y, minlength=2).astype(float), x.sum(axis=0)])
    if not sums or not sums[0].all():
        return QualityModel(np.zeros(size), np.ones(size), np.zeros(size), 0.0)
    sizes, mean = sums[0], sums[1] / sums[0].sum()
    (squares,) = each(lambda x, y: [((x - mean) ** 2).sum(axis=0)])
    scale = np.maximum(np.sqrt(squares / sizes.sum()), 1e-6)
    held_down = l2 * np.where(np.arange(size) < _FORM, 1.0, WORD_PENALTY)
    model = QualityModel(mean, scale, _fit_weights(each, mean, scale, sizes, held_down), 0.0)
    model.threshold = _threshold(each, model.strength, sizes, sizes[0] / sizes.sum() if share_worse is None else share_worse)
    return model


def fit(rows: list[tuple[int, str, int]], l2: float = 1e-4, share_worse: float | None = None) -> QualityModel:
    """Fits on all (id, text, label) rows; ``share_worse`` is the share of label 0 that sets the threshold's quantile, by
    default that of the rows.

    Without rows of both classes all documents have the same strength and score 0.5.
    """
    x = features(pa.array([r[1] for r in rows], pa.large_string()))
    return _fit(_local_pass(x, np.array([r[2] for r in rows], np.int64)), l2, share_worse)


def _features_column(text: Column) -> Column:
    """The features of each text as 32-bit numbers."""

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [features(batch.slice(k, BLOCK_ROWS)).astype(np.float32) for k in range(0, len(batch), BLOCK_ROWS)]
            yield pa.array([row.tobytes() for part in parts for row in part], pa.binary())

    return packed(text)


def quality_score(text: Column, model: QualityModel) -> Column:
    """Probability that a text beats one at the threshold."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.strength(features(batch.slice(k, BLOCK_ROWS))) for k in range(0, len(batch), BLOCK_ROWS)]
            yield pa.array(sigmoid(np.concatenate([np.empty(0), *parts]) - model.threshold), pa.float64())

    return score(text)


def _may_be_among(ids: Column, known: DataFrame) -> Column:
    """True for each id of ``known``, and for few others: one bit of a bitmap for each hash, which is broadcast.

    It spares texts a join; who passes is joined, so the bitmap's size costs time and no results.
    """
    bits = min(MOST_BITS, 1 << max(12, (known.count() * BITS_PER_ID - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(bits))
    each = known.select(place(F.col("doc_id")).alias("b"))
    found = each.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("v")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("w").to_numpy()] = found.column("v").to_numpy().view(np.uint64)
    shared = known.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def isset(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return isset(place(ids))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``y, x``: label and features of every labelled document that may be learned from.

    An id counts once however often either table repeats it, with its least label and that of its texts of least md5.
    """
    learned = lambda: F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1)
    own = labels.where(F.col("quality").isin(0, 1) & learned())
    known = materialize(own.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y")), "known")
    texts = docs.where(learned()).where(_may_be_among(F.col("doc_id"), known))
    rows = texts.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("which"), _features_column(F.col("text")).alias("x"))
    once = rows.groupBy("doc_id").agg(F.min_by("x", "which").alias("x"))
    return materialize(once.join(known, "doc_id").select("y", "x"), "features")


def train(docs: DataFrame, labels: DataFrame, l2: float = 1e-4) -> QualityModel:
    """Fits on every labelled row outside the held-out fold; the tables that it makes are gone when it returns."""
    with temporary(docs.sparkSession):
        return _fit(_table_pass(_labelled(docs, labels)), l2, None)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; ``predicted`` is 1 from a score of 0.5.

    Nulls: a null text is an empty one; a null id gives ``held_out`` false and is never learned from; null labels are
    ignored.  Repeated rows are scored each; an empty table gives an empty result; without labels of both classes all
    documents score 0.5.  Ties: equal texts have equal scores.  Other columns are ignored, whatever their names.  A text of
    any length is learned from and scored whole, in bounded memory.
    """
    model = train(docs, labels)
    scored = docs.select(F.col("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
