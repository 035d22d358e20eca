"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary of pieces.

Each language has a probability for every piece of the vocabulary.  A word (a run of letters and their marks, led by the
vocabulary's word mark) is scored by the forward algorithm, which sums the probabilities of *all* its segmentations into
pieces; a letter that no piece covers is a segment of its own with a floor probability.  The forward sums are rescaled on
the way, so words of any length have finite scores.  Pieces hold the word mark only at their start, so no segmentation
crosses a word and a text's log-likelihood is the sum over its words; the language of the greatest one is predicted.

The score is the mean over the text's letters of the posterior (equal priors) that their word gives to the predicted
language.  It does not grow with the text: a text of two languages in equal parts, or of words that no language explains
better than another, scores low however long it is.

The piece probabilities are fitted by expectation-maximisation (forward-backward) on a bounded sample of documents per
language.  Scoring is one narrow pass: words are hashed straight from Arrow buffers, only words that a task has not seen
go through the forward algorithm, vectorised over words of like length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SAMPLE_CHARS, below, fold, frugal, held_out, word_blocks

#: Documents of each language that the model is fitted on, at most (in expectation), of :data:`SAMPLE_CHARS` at most.
PER_LANGUAGE = 300
#: Languages that are learned, at most: those of most documents.
LANGUAGES = 256
#: A text of a lower score has no determined language, for :func:`keep_identified`.
LEAST_SCORE = 0.5
MARK = "▁"
UNDETERMINED = "und"
_FLOOR = 1e-7
_SLOTS = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Numbers in a task's table of known scores; it starts anew when full.
CACHE_VALUES = 3_000_000
#: Words are padded to these lengths and scored together; longer ones are scored alone.
_PADDED = np.array([4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256])
#: Numbers in one array of forward sums, about; positions between two rescalings; letters of a word that the fit takes whole.
_CELLS, _RESCALED, _FITTED = 4_000_000, 16, 32


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _lettered(text: str) -> bool:
    return all(c.isalpha() or category(c)[0] == "M" for c in text)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[str, ...]:
    """The vocabulary's pieces of letters (with or without the word mark), lower-cased, in order of first appearance."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            piece = model.id_to_piece(k).lower()
            if piece == MARK or (_lettered(piece.removeprefix(MARK)) and len(piece) > piece.startswith(MARK)):
                found[piece] = None
    return tuple(found)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


class _Pieces:
    """Finds the pieces that start at each position of many words of one length."""

    def __init__(self, pieces: tuple[str, ...]):
        keys = []
        for piece in pieces:
            h = np.zeros(1, np.uint64)
            for c in _points(piece):
                h = h * _MULTIPLIER + c + np.uint64(1)
            keys.append(h[0])
        keys = np.array(keys, np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.longest = max((len(p) for p in pieces), default=1)
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[self._slot(keys)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, pieces) of those of the hashes that are a piece's."""
        at = np.flatnonzero(self.slots[self._slot(h)])
        if not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[k] == h[at]
        return at[good], self.ids[k[good]]

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) for a matrix of code points; single code points without a piece have piece -1."""
        n, length = words.shape
        wide = words.astype(np.uint64) + np.uint64(1)
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = h * _MULTIPLIER + wide[:, j - 1]
                rows, found = self.find(h)
                if j == i + 1 and len(rows) < n:
                    missing = np.ones(n, bool)
                    missing[rows] = False
                    yield i, j, np.flatnonzero(missing), np.full(n - len(rows), -1)
                if len(rows):
                    yield i, j, rows, found


@dataclass
class LanguageModel:
    """``probabilities[piece, language]``; the last row is the floor of letters without a piece."""

    languages: list[str]
    probabilities: np.ndarray
    vocabulary: str


@lru_cache(maxsize=2)
def _piece_table(vocabulary: str) -> _Pieces:
    return _Pieces(load_pieces(vocabulary))


def _code_points(word: str) -> np.ndarray:
    return np.frombuffer((MARK + word).encode("utf-32-le", "replace"), np.uint32)


def _padded(words: list[str], g: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the words, their lengths with the mark, matrix of their code points) of words of like length."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    classes = np.searchsorted(_PADDED, sizes)
    for k in np.unique(classes):
        width = int(_PADDED[k])
        rows = np.flatnonzero(classes == k)
        step = max(1, _CELLS // (width * g))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            text = "".join([(MARK + words[r]).ljust(width, "\0") for r in own.tolist()])
            yield own, sizes[own], np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).reshape(len(own), width)


def _batch_scores(pieces: _Pieces, matrix: np.ndarray, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log-likelihoods of padded words: row r's is complete once all pieces that start before its length are in."""
    n, width = matrix.shape
    alpha = np.zeros((width + 1, n, p.shape[1]))
    alpha[0] = 1.0
    log, out, done = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1])), 0

    def complete(position: int) -> None:
        nonlocal done, log
        while done < position:
            done += 1
            rows = np.flatnonzero(sizes == done)
            if len(rows):
                out[rows] = np.log(alpha[done][rows]) + log[rows]
            if done % _RESCALED == 0 and done < width:
                ahead = alpha[done : done + pieces.longest + 1]
                top = ahead.max(axis=0)
                top = np.where(top > 0, top, 1.0)
                ahead /= top
                log = log + np.log(top)

    for i, j, rows, found in pieces.matches(matrix):  # in order of start, so alpha[i] is complete
        complete(i)
        alpha[j][rows] += alpha[i][rows] * p[found]
    complete(width)
    return out


def _long_score(pieces: _Pieces, word: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log-likelihoods of one long word: its pieces are found for all positions at once, then summed in order."""
    n, wide = len(word), word.astype(np.uint64) + np.uint64(1)
    h, starts, ends, which = np.zeros(n, np.uint64), [], [], []
    for k in range(1, min(n, pieces.longest) + 1):
        h = h[: n - k + 1] * _MULTIPLIER + wide[k - 1 :]
        at, found = pieces.find(h)
        if k == 1:
            missing = np.setdiff1d(np.arange(n), at)
            at, found = np.concatenate([at, missing]), np.concatenate([found, np.full(len(missing), -1)])
        starts.append(at)
        ends.append(at + k)
        which.append(found)
    start = np.concatenate(starts)
    order = np.argsort(start, kind="stable")
    end, found, bounds = np.concatenate(ends)[order], np.concatenate(which)[order], np.searchsorted(start[order], np.arange(n + 1))
    alpha, log = np.zeros((n + 1, p.shape[1])), np.zeros(p.shape[1])
    alpha[0] = 1.0
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if i % _RESCALED == 0:
            ahead = alpha[i : i + pieces.longest + 1]
            top = ahead.max(axis=0)
            ahead /= top
            log += np.log(top)
        alpha[end[a:b]] += alpha[i] * p[found[a:b]]
    return np.log(alpha[n]) + log


def word_scores(words: list[str], model: LanguageModel) -> np.ndarray:
    """Log-likelihood of each word in each language, over all segmentations."""
    pieces, p = _piece_table(model.vocabulary), model.probabilities
    out = np.zeros((len(words), p.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) < _PADDED[-1]]
    for rows, sizes, matrix in _padded([words[k] for k in short], p.shape[1]):
        out[np.array(short)[rows]] = _batch_scores(pieces, matrix, sizes, p)
    for k, w in enumerate(words):
        if len(w) >= _PADDED[-1]:
            out[k] = _long_score(pieces, _code_points(w), p)
    return out


def fit(counts: dict[str, dict[str, float]], vocabulary: str, rounds: int = 4) -> LanguageModel:
    """Fits piece probabilities from each language's word counts by expectation-maximisation.

    A word of more than 32 letters is fitted in parts of 32.
    """
    languages = sorted(counts)
    g = len(languages)
    parts: dict[str, np.ndarray] = {}
    for k, name in enumerate(languages):
        for word, n in counts[name].items():
            for at in range(0, len(word), _FITTED):
                parts.setdefault(word[at : at + _FITTED], np.zeros(g))[k] += n
    words = sorted(parts)
    weights = np.array([parts[w] for w in words]).reshape(len(words), g)
    pieces = _piece_table(vocabulary)
    size = len(load_pieces(vocabulary)) + 1
    p = np.full((size, g), 1.0 / size)
    mark = [k for k, piece in enumerate(load_pieces(vocabulary)) if piece == MARK]
    groups = [(rows, sizes, list(pieces.matches(matrix)), matrix.shape[1]) for rows, sizes, matrix in _padded(words, g)] if g else []
    for _ in range(rounds if g else 0):
        expected = np.zeros_like(p)
        for rows, sizes, matches, width in groups:
            alpha = np.zeros((width + 1, len(rows), g))
            alpha[0] = 1.0
            for i, j, at, found in matches:
                alpha[j][at] += alpha[i][at] * p[found]
            beta, every = np.zeros_like(alpha), np.arange(len(rows))
            beta[sizes, every] = weights[rows] / np.maximum(alpha[sizes, every], 1e-300)
            for i, j, at, found in reversed(matches):
                through = p[found] * beta[j][at]
                beta[i][at] += through
                through *= alpha[i][at]
                for k in range(g):
                    expected[:, k] += np.bincount(np.where(found < 0, size - 1, found), through[:, k], size)
        # what a language has never seen is equally unlikely in all of them, however much text each was fitted on
        p = np.maximum(expected / np.maximum(expected.sum(axis=0), 1e-300), _FLOOR)
        p[-1] = _FLOOR
        p[mark] = p[mark].mean(axis=1, keepdims=True)  # the mark alone says nothing of the language
    return LanguageModel(languages, p, vocabulary)


def letter_runs(text: str) -> list[str]:
    """The maximal runs of letters and their marks that hold a letter."""
    if text.isalpha():
        return [text]
    kept = "".join(c if c.isalpha() or category(c)[0] == "M" else " " for c in text)
    return [w for w in kept.split() if any(map(str.isalpha, w))]


def _runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> list[list[str]]:
    """The runs of letters in each of the chosen spans."""
    data = raw.tobytes()
    return [letter_runs(data[a:b].decode("utf-8", "replace")) for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]


class _Scorer:
    """Scores texts; of every span of characters that a task has seen it knows the log-likelihoods, the letters, and the sum
    over its letters of each language's posterior."""

    def __init__(self, model: LanguageModel):
        self.model, self.g = model, len(model.languages)
        self._reset()

    def _reset(self):
        self.keys, self.values = np.empty(0, np.uint64), np.empty((0, 2 * self.g + 1))

    def _score(self, spans: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(spans), 2 * self.g + 1))
        words = [w for runs in spans for w in runs]
        if words:
            span = np.repeat(np.arange(len(spans)), [len(runs) for runs in spans])
            scores = word_scores(words, self.model)
            letters = np.array([len(w) for w in words], float)
            likely = np.exp(scores - scores.max(axis=1, keepdims=True))
            likely *= (letters / likely.sum(axis=1))[:, None]
            for k, column in enumerate([*scores.T, *likely.T, letters]):
                out[:, k] = np.bincount(span, column, len(spans))
        return out

    def _lookup(self, keys: np.ndarray, spans, first: np.ndarray) -> np.ndarray:
        if len(self.keys) * self.values.shape[1] > CACHE_VALUES:
            self._reset()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            scores = self._score(_runs(*spans, first[new]))
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.values = merged[order], np.concatenate([self.values, scores])[order]
            at = np.searchsorted(self.keys, keys)
        return self.values[at]

    def __call__(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n, g = len(column), self.g
        if not g:
            return [UNDETERMINED] * n, np.zeros(n)
        total = np.zeros((n, 2 * g + 1))
        for lo, h, offsets, spans in word_blocks(column):
            if not len(h):
                continue
            keys, first, which = np.unique(h, return_index=True, return_inverse=True)
            values = self._lookup(keys, spans, first)
            m = len(offsets) - 1
            text = np.repeat(np.arange(m), np.diff(offsets))
            for k in range(2 * g + 1):
                total[lo : lo + m, k] += np.bincount(text, values[which, k], m)
        letters = total[:, -1]
        best = total[:, :g].argmax(axis=1)
        score = np.where(letters > 0, total[np.arange(n), g + best] / np.maximum(letters, 1), 0.0)
        names = np.array([*self.model.languages, UNDETERMINED], dtype=object)
        return names[np.where(letters > 0, best, g)].tolist(), np.clip(score, 0.0, 1.0)


_RESULT = "struct<lang_pred:string,score:double>"


def language(text: Column, model: LanguageModel) -> Column:
    """``struct<lang_pred, score>`` of a text column."""

    @F.arrow_udf(_RESULT)
    @frugal
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(model)
        for batch in batches:
            names, scores = scorer(batch)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict(text)


def train(
    docs: DataFrame, per_language: int = PER_LANGUAGE, vocabulary: str | None = None, parts: int = 4, rest: int = 2, languages: int = LANGUAGES
) -> LanguageModel:
    """Fits on about ``per_language`` documents of each value of ``lang``, outside the held-out fold.

    Of more than ``languages`` values those of most documents are learned (ties by name).  Documents are chosen by the hash
    of their id, and an id counts once, with the least of its texts of at most :data:`SAMPLE_CHARS`: what reaches the
    driver is bounded however often rows repeat.
    """
    vocabulary = vocabulary or default_vocabulary()
    known = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != rest) & (F.char_length("text") <= SAMPLE_CHARS)
    )
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    if not sizes:
        return fit({}, vocabulary)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / max(r["n"], 1))) for r in sizes], "lang string, share double")
    chosen = known.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").where(below(F.col("share"), F.lit("language"), F.col("doc_id")))
    rows = sorted((r["t"]["lang"], r["t"]["text"]) for r in chosen.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("t")).collect())
    counts: dict[str, dict[str, float]] = {g: {} for g, _ in rows}
    for lo, h, offsets, spans in word_blocks(pa.array([t for _, t in rows], pa.large_string())):
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = counts[rows[lo + k][0]]
            _, first, times = np.unique(h[a:b], return_index=True, return_counts=True)
            for runs, n in zip(_runs(*spans, a + first), times.tolist(), strict=True):
                for word in runs:
                    own[word] = own.get(word, 0.0) + n
    return fit({g: c for g, c in counts.items() if c}, vocabulary)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Nulls: a null text, like one without letters, is ``und`` with score 0; rows of null ``lang`` or id are never learned
    from; a null id gives ``held_out`` false.  Repeated rows are scored each; an empty table gives an empty result;
    without a language to learn all rows are ``und``.  Ties: equal likelihoods go to the first language by name.  Very long
    texts are scored whole, in blocks of half a megabyte.  Other columns are ignored, whatever their names.
    """
    model = train(docs, per_language, vocabulary)
    done = docs.select(F.col("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), language(F.col("text"), model).alias("l"))
    return done.select("doc_id", "held_out", "l.lang_pred", "l.score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, per_language: int = PER_LANGUAGE, vocabulary: str | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) whose language is determined with a score of ``least`` or more.

    Null texts and texts without letters go, repeated rows are judged each, an empty table gives an empty result.
    """
    return docs.where(language(F.col("text"), train(docs, per_language, vocabulary))["score"] >= least)
