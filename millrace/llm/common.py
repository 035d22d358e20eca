"""Shared pieces: label folds, bounded samples, vectorised token hashing.

The hashing helpers take text straight from Arrow buffers into NumPy, in blocks of a few hundred kilobytes, so a Python
worker's memory depends neither on the size of an Arrow batch nor on the length of a text: a text of more than a block
comes in pieces, cut behind a line's end or a space (a run of a quarter megabyte without either is cut within).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import materialize, scratch_path

__all__ = ["materialize", "scratch_path"]

#: UTF-8 bytes of text that are hashed at a time.
BLOCK_BYTES = 1 << 19
#: Texts that are converted at a time.
BLOCK_ROWS = 1000

# ---- labels ----------------------------------------------------------------------------------------------------------

#: Longer texts (in code points) are never in a sample that a model is fitted on, which bounds its bytes; all are scored.
SAMPLE_CHARS = 1 << 16


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``."""
    return F.crc32(id_column.cast("string")) % parts


def held_out(id_column: Column, parts: int, rest: int) -> Column:
    """Whether a row is kept from learning; false for a null id, which no fold holds (nor is it ever learned from)."""
    return F.coalesce(fold(id_column, parts) == rest, F.lit(False))


def below(share: Column | float, *key: Column) -> Column:
    """Whether a hash of ``key`` is in the lowest ``share`` of its range."""
    return F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < share * 1_000_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, parts: int = 3, rest: int = 1
) -> list[tuple[int, str, int]]:
    """About ``per_class`` texts of each label (0 and 1) on the driver: the only rows a classifier is fitted on.

    Ids come from the folds other than ``rest`` and are chosen by their hash, so the choice does not depend on
    partitioning.  An id counts once however often either table repeats it, with its least label and the least of its
    texts of at most :data:`SAMPLE_CHARS`, so rows and bytes are bounded, as are the ids that are broadcast.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != rest))
    known = own.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    chosen = known.where(below(share, F.lit(label), F.col("doc_id")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= SAMPLE_CHARS)
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return sorted((r["doc_id"], r["text"], r["y"]) for r in once.collect())


# ---- workers ---------------------------------------------------------------------------------------------------------

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system; allocators keep a peak otherwise, and a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def frugal(run: Callable) -> Callable:
    """A function from batches to results that releases what it freed after each of them."""

    @wraps(run)
    def inner(batches):
        try:
            for out in run(batches):
                yield out
                del out
                release()
        finally:
            release()

    return inner


# ---- blocks of text --------------------------------------------------------------------------------------------------


def _as_strings(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def _cut(raw: np.ndarray, a: int, b: int) -> int:
    """Where a piece of a long text that begins at ``a`` ends, at ``b`` at the latest: behind a line's end, else a space."""
    half = a + (b - a) // 2
    for mark in (10, 32):
        at = np.flatnonzero(raw[half:b] == mark)
        if len(at):
            return half + int(at[-1]) + 1
    while raw[b] & 0xC0 == 0x80:  # not within a character
        b -= 1
    return b


def raw_blocks(column: pa.Array, block: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, bool]]:
    """(number of the first text, UTF-8 bytes, offsets of the texts in them, begins, ends) of consecutive texts.

    A null counts as empty.  A text of more than a block comes in pieces of at most a block, each with the text's number;
    ``begins`` and ``ends`` tell whether a block holds the beginning and the end of its texts.
    """
    for first in range(0, len(column), BLOCK_ROWS):
        part = _as_strings(column.slice(first, BLOCK_ROWS))
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], np.int64, n + 1, part.offset * 8)
        data = part.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, "right")) - 1)
            a, end = int(offsets[lo]), int(offsets[hi])
            if end - a <= block:
                yield first + lo, raw[a:end], offsets[lo : hi + 1] - a, True, True
            else:
                at = a
                while at < end:
                    stop = end if end - at <= block else _cut(raw, at, at + block)
                    yield first + lo, raw[at:stop], np.array([0, stop - at]), at == a, stop == end
                    at = stop
            lo = hi


def _lowered(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    texts = pc.utf8_lower(pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(raw))))
    new = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2], np.uint8)[new[0] : new[-1]], new - new[0]


def utf8_blocks(column: pa.Array, block: int = BLOCK_BYTES, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """:func:`raw_blocks` without its flags, in lower case if asked: a long text's number comes several times."""
    for lo, raw, offsets, _, _ in raw_blocks(column, block):
        yield (lo, *(_lowered(raw, offsets) if lower and len(raw) else (raw, offsets)))


def code_point_blocks(column: pa.Array, block: int = BLOCK_BYTES, overlap: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, code points in lower case, starts, ends); every text stands between two spaces.

    White space and control characters are all the code point of a space.  A further piece of a long text begins with
    the last ``overlap`` code points of the one before.
    """
    tail = ""
    for lo, raw, offsets, begins, ends in raw_blocks(column, block):
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace").lower().replace("\0", " ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        if begins and ends:
            points = np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "replace"), np.uint32)
            marks = np.flatnonzero(points == 0)
            starts, stops = marks[0::2], marks[1::2] + 1
        else:
            piece = (" " if begins else tail) + texts[0] + (" " if ends else "")
            tail = piece[-overlap:] if overlap else ""
            points = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
            starts, stops = np.zeros(1, np.int64), np.array([len(points)])
        yield lo, np.where(points < 33, np.uint32(32), points), starts, stops


# ---- words as hashes -------------------------------------------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values; changes ``h`` in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ASCII letters, digits and non-ASCII bytes."""
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = _WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def text_word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_spans` of each of the texts that begin at the offsets: a word never spans two of them."""
    starts, ends = word_spans(raw)
    if len(starts):
        inner = offsets[1:-1]
        at = np.searchsorted(starts, inner, "left") - 1
        held = np.maximum(at, 0)
        cut = np.unique(inner[(at >= 0) & (inner > starts[held]) & (inner < ends[held])])
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial modulo 2^64."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    return mix(h)


def block_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(hash of each lower-cased word, offsets of the texts in them, (bytes in lower case, starts, ends))."""
    if len(raw):
        raw, offsets = _lowered(raw, offsets)
        starts, ends = text_word_spans(raw, offsets)
        h = hash_spans(raw, starts, ends)
    else:
        starts = ends = np.empty(0, np.int64)
        h = np.empty(0, np.uint64)
    return h, np.searchsorted(starts, offsets, "left"), (raw, starts, ends)


def word_blocks(column: pa.Array, block: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """(first text, hash of each lower-cased word, offsets of the texts in them, (bytes, starts, ends)).

    A word is a run of ASCII letters and digits and of any non-ASCII characters.  A text of more than a block comes in
    pieces, several blocks of its number.
    """
    for lo, raw, offsets in utf8_blocks(column, block):
        yield (lo, *block_words(raw, offsets))


def whole_word_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hash of each word, offsets of the texts in them): :func:`word_blocks` with the pieces of a long text put
    together, which takes eight bytes for each of its words."""
    held: list[np.ndarray] = []
    last = -1
    for lo, h, offsets, _ in word_blocks(column):
        if held and lo != last:
            yield last, np.concatenate(held), np.array([0, sum(map(len, held))])
            held = []
        if len(offsets) == 2:
            held.append(h.copy())
            last = lo
        else:
            yield lo, h, offsets
    if held:
        yield last, np.concatenate(held), np.array([0, sum(map(len, held))])


def window_hash(words: np.ndarray, offsets_in_window: list[int]) -> np.ndarray:
    """Hash of the words at the given offsets of every window; the last offset + 1 is the window's length."""
    span = offsets_in_window[-1] + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in offsets_in_window:
        h *= np.uint64(_BASE)
        h += words[k : k + n]
    return mix(h)


# ---- linear models ---------------------------------------------------------------------------------------------------


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def adam(gradient, start: np.ndarray, steps: int, rate: float = 0.1) -> np.ndarray:
    """Full-batch Adam with a rate that falls to zero; deterministic."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
