"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a window of tokens; its hash takes only the selected positions, so tokens at the ignored positions
may be substituted without losing the hit.  Hashes of the documents' windows are joined with those of the benchmark's; every
hit fixes a diagonal (document position minus item position), along which the whole item is compared and an ungapped
segment is verified: long enough, with enough equal tokens (:func:`tokens_needed`, :data:`IDENTITY`).

**Complete masks.**  A segment of n tokens with at most n/5 substituted is cut into blocks of k tokens; every substitution
spoils one, so at least floor(n/k) - floor(n/5) are whole, and of those some lie near each other.  The masks of
:data:`MASKS` select two blocks of three tokens (items of 14 tokens and more), three of two (9 to 13) or four of five tokens
(5 to 8), at every distance that can occur: each overlap that meets the rule holds a window of one of them, so none is
lost.  Shorter items (under five tokens, where a fifth is less than one) are sought whole and unchanged.

**Plan.**  The benchmark's distinct hashes set bits of a filter of bounded size, the only thing that is broadcast.  One narrow
pass over the documents keeps the windows that pass it, with the tokens around them, as a table; that table's hits are
joined with the benchmark's by hash, then with the items' tokens, and verified.  All three joins are Spark's own, of tables
of known size: small sides are broadcast by its own check, skewed ones split by adaptive execution.  A larger benchmark than the
filter is for lets more windows through; it costs time, no results.

**Repeats.**  A hash is one entry of a stretch or item, with all its places as runs (of one word, say) of first and last place;
two runs meet on an interval of diagonals.  So repeated tokens give no product of rows, and the diagonals of a stretch and
an item are no more than their tokens together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import frugal, hash_spans, materialize, mix, text_word_spans, utf8_blocks, window_hash

#: Selected positions are 1.  By the least and the most tokens of the items that they are for.
MASKS = {
    (14, None): tuple("111" + "0" * (3 * gap - 3) + "111" for gap in range(1, 6)),
    (9, 13): tuple("11" + "00" * a + "11" + "00" * b + "11" for a in range(3) for b in range(3 - a)),
    (5, 8): ("1111", "10111", "11011", "11101"),
    (4, 4): ("1111",), (3, 3): ("111",), (2, 2): ("11",), (1, 1): ("1",),
}
#: A verified segment has this many tokens (or this share of a shorter item) and this share of equal ones.
SEGMENT_TOKENS = 20
SEGMENT_SHARE = 0.8
IDENTITY = 0.8
#: Items of more tokens are compared in parts of so many, which overlap by more than twice a segment, so that none is lost
#: (a longer segment holds one of 20 to 39 tokens that meets the rule).
PART_TOKENS, PART_OVERLAP = 1024, 64
#: Windows of a document whose hits go into one row, with the tokens around them.
CORE_TOKENS = 2048
#: Bits of the filter for each hash of the benchmark, bits of it at most, and bits that each hash sets.
BITS_PER_HASH, MOST_BITS, PROBES = 64, 1 << 28, 6

_LONGEST = max(len(m) for masks in MASKS.values() for m in masks)


def _positions(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def masks_for(size: int) -> tuple[str, ...]:
    """The masks for an item of ``size`` tokens."""
    return next((masks for (least, most), masks in MASKS.items() if size >= least and (most is None or size <= most)), ())


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of each window of the mask's length, which depends on the mask too."""
    return mix(window_hash(words, _positions(mask)) + np.uint64(int("1" + mask, 2)))


# ---- tokens ----------------------------------------------------------------------------------------------------------


def token_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens: runs of ASCII letters, digits and non-ASCII characters.

    In scripts without spaces (Chinese characters and kana, Thai, Lao, Burmese, Khmer) each character is a token.
    """
    starts, ends = text_word_spans(raw, offsets)
    if not len(raw) or raw.max() < 0xE0:
        return starts, ends
    following = np.append(raw[1:], 0)
    south_east = ((raw == 0xE0) & (following >= 0xB8) & (following <= 0xBB)) | ((raw == 0xE1) & np.isin(following, (0x80, 0x81, 0x82, 0x9E, 0x9F)))
    lead = np.flatnonzero(((raw >= 0xE3) & (raw <= 0xE9)) | south_east)
    cuts = np.unique(np.concatenate([lead, lead + 3]))
    at = np.searchsorted(starts, cuts, "right") - 1
    cuts, at = cuts[at >= 0], at[at >= 0]
    cuts = cuts[(cuts > starts[at]) & (cuts < ends[at])]
    return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))


def token_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hash of each token in lower case, offsets of the texts in them); a long text comes in pieces."""
    for lo, raw, offsets in utf8_blocks(column, lower=True):
        starts, ends = token_spans(raw, offsets)
        yield lo, hash_spans(raw, starts, ends), np.searchsorted(starts, offsets, "left")


def tokens_of(texts: list[str]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for lo, words, offsets in token_blocks(pa.array(texts, pa.large_string())):
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            out[lo + k].append(words[a:b])
    return [np.concatenate([np.empty(0, np.uint64), *parts]) for parts in out]


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of equal values."""
    edges = np.flatnonzero(h[1:] != h[:-1]) + 1
    return np.concatenate([[0], edges]) if len(h) else edges, np.append(edges, len(h)) - 1 if len(h) else edges


# ---- verification ----------------------------------------------------------------------------------------------------


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the segment of the highest score, at +1 for an equal token and -2 for another; first of ties."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    return int(np.argmin(total[: end + 1])), end


def longest_segment(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the longest segment with a share of at least :data:`IDENTITY` equal tokens; first of ties."""
    share = Fraction(IDENTITY).limit_denominator(1000)
    total = np.concatenate([[0], np.cumsum(np.where(equal, share.denominator, 0) - share.numerator)])
    # the first place whose total is not above that of the end
    starts = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int(np.argmax(np.arange(len(total)) - starts))
    return int(starts[end]), end


def tokens_needed(size: int) -> int:
    """The least tokens of a verified segment of an item of ``size`` tokens."""
    return min(SEGMENT_TOKENS, math.ceil(Fraction(SEGMENT_SHARE).limit_denominator(1000) * size))


def _enough(equal: int, tokens: int) -> bool:
    share = Fraction(IDENTITY).limit_denominator(1000)
    return equal * share.denominator >= share.numerator * tokens


def verify(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start in the document, tokens, equal tokens) of the verified segment along a diagonal, or None.

    It is the best-scoring segment, or where that one is too short or too different the longest of enough equal tokens.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    equal = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    needed = tokens_needed(len(item))
    for find in (best_segment, longest_segment):
        a, b = find(equal)
        count = int(equal[a:b].sum())
        if b - a >= needed and _enough(count, b - a):
            return lo + a + diagonal, b - a, count
    return None


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int] | None:
    """The verified segment of most equal tokens among the diagonals, the first of ties, or None.

    Diagonals go by their number of equal tokens, which no segment exceeds, so few are looked at more closely.
    """
    lo, hi = np.maximum(0, -diagonals), np.minimum(len(item), len(doc) - diagonals)
    count = np.array([int((item[a:b] == doc[a + d : b + d]).sum()) if b > a else 0 for a, b, d in zip(lo.tolist(), hi.tolist(), diagonals.tolist(), strict=True)])
    best = None
    for k in np.argsort(-count, kind="stable").tolist():
        if count[k] < best[2] if best else not _enough(int(count[k]), tokens_needed(len(item))):
            break
        found = verify(doc, item, int(diagonals[k]))
        if found and (best is None or (-found[2], found[0]) < (-best[2], best[0])):
            best = found
    return best


def diagonals_of(spans: list[dict], doc_size: int, item_size: int) -> np.ndarray:
    """The diagonals on which equal hashes meet: ``spans`` has the runs of each in the document (``first, last``) and in the
    item (``a, b``)."""
    change = np.zeros(doc_size + item_size + 2, np.int64)
    for x in spans:
        first, last, a, b = (np.array(x[c]) for c in ("first", "last", "a", "b"))
        np.add.at(change, (first[:, None] - b[None, :]).reshape(-1) + item_size, 1)
        np.add.at(change, (last[:, None] - a[None, :]).reshape(-1) + item_size + 1, -1)
    return np.flatnonzero(np.cumsum(change) > 0) - item_size


# ---- tables ----------------------------------------------------------------------------------------------------------

_SEED = pa.struct([("h", pa.int64()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))])
_SEED_DDL = "struct<h:bigint,first:array<int>,last:array<int>>"
_PART = pa.struct([("part", pa.int32()), ("tokens", pa.list_(pa.int64())), ("seeds", pa.list_(_SEED))])
_PARTS_DDL = f"array<struct<part:int,tokens:array<bigint>,seeds:array<{_SEED_DDL}>>>"
_PIECE = pa.struct([("start", pa.int64()), ("tokens", pa.list_(pa.int64())), ("hits", pa.list_(_SEED))])
_PIECES_DDL = f"array<struct<start:bigint,tokens:array<bigint>,hits:array<{_SEED_DDL}>>>"
_OVERLAP = pa.struct([("start", pa.int64()), ("tokens", pa.int64()), ("equal", pa.int64())])
_OVERLAP_DDL = "struct<start:bigint,tokens:bigint,equal:bigint>"


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n[k]`` whole numbers from ``first[k]`` on, for each k in turn."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sizes(edges: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(edges, n))


class _Grouped:
    """Seeds of owners in arrays: for each owner its distinct hashes, for each hash its runs."""

    def __init__(self, owner: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray):
        order = np.lexsort((first, h, owner))
        owner, h, self.first, self.last = owner[order], h[order], first[order].astype(np.int32), last[order].astype(np.int32)
        hashes = _edges(owner, h)
        self.runs = _sizes(hashes, len(h))
        self.h = h[hashes]
        self.owners = owner[hashes]

    @staticmethod
    def array(parts: list[_Grouped], per_owner: np.ndarray) -> pa.ListArray:
        """``list<struct<h, first, last>>`` for each owner of all parts."""
        join = lambda arrays, kind: np.concatenate([np.empty(0, kind), *arrays])
        counts = join([p.runs for p in parts], np.int64)
        first, last = (_lists(pa.array(join([getattr(p, c) for p in parts], np.int32)), counts) for c in ("first", "last"))
        h = pa.array(join([p.h.view(np.int64) for p in parts], np.int64))
        return _lists(pa.StructArray.from_arrays([h, first, last], fields=list(_SEED)), per_owner)


def item_parts(texts: list[str]) -> pa.ListArray:
    """The parts of benchmark texts: ``list<struct<part, tokens, seeds>>``."""
    step, per_text, numbers, tokens, groups, seeds = PART_TOKENS - PART_OVERLAP, [], [], [], [], []
    for words in tokens_of(texts):
        starts = range(0, len(words) - PART_OVERLAP, step) if len(words) > PART_TOKENS else range(min(len(words), 1))
        per_text.append(len(starts))
        for k, at in enumerate(starts):
            part = words[at : at + PART_TOKENS]
            hashes = [h for mask in masks_for(len(part)) if len(h := seed_hashes(part, mask))]
            spans = [(h, *runs(h)) for h in hashes]
            joined = [np.concatenate(x) for x in zip(*((h[f], f, e) for h, f, e in spans), strict=True)] if spans else [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
            group = _Grouped(np.zeros(len(joined[0]), np.int64), *joined)
            numbers.append(k)
            tokens.append(part.view(np.int64))
            groups.append(group)
            seeds.append(len(group.h))
    flat = _lists(pa.array(np.concatenate([np.empty(0, np.int64), *tokens])), np.array([len(t) for t in tokens], np.int64))
    columns = [pa.array(numbers, pa.int32()), flat, _Grouped.array(groups, np.array(seeds, np.int64))]
    return _lists(pa.StructArray.from_arrays(columns, fields=list(_PART)), np.array(per_text, np.int64))


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits (a power of two in number) that each hash sets: a row for each of :data:`PROBES`."""
    step = mix(h + np.uint64(1)) | np.uint64(1)
    return np.stack([(h + step * np.uint64(k)) & np.uint64(bits - 1) for k in range(PROBES)])


def _passing(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the hashes all of whose bits are set."""
    mask = np.uint64(len(words) * 64 - 1)

    def isset(b: np.ndarray) -> np.ndarray:
        return (words[(b >> np.uint64(6)).view(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1

    at = np.flatnonzero(isset(h & mask))
    step = mix(h[at] + np.uint64(1)) | np.uint64(1)
    for k in range(1, PROBES):
        good = isset((h[at] + step * np.uint64(k)) & mask)
        at, step = at[good], step[good]
    return at


def filter_of(hashes: np.ndarray) -> np.ndarray:
    """The filter of known hashes, on one machine."""
    bits = _bits(len(hashes))
    out = np.zeros(bits // 64, np.uint64)
    at = _probes(hashes, bits).reshape(-1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _bits(n: int) -> int:
    return min(MOST_BITS, 1 << max(12, math.ceil(math.log2(max(n, 1) * BITS_PER_HASH))))


class Benchmark:
    """The benchmark as tables: ``parts`` (``uid, tokens``), ``seeds`` (``uid, h, a, b``), both once for parts of equal tokens,
    and ``items`` (``uid, item_id, text_id, total``: the items that a part belongs to, and their number of tokens)."""

    def __init__(self, benchmark: DataFrame):
        @F.arrow_udf(_PARTS_DDL)
        def cut(text: pa.Array) -> pa.Array:
            parts = [item_parts(text.slice(k, 64).to_pylist()) for k in range(0, len(text), 64)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_PART))

        known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
        # the number keeps the filter that Spark infers for explode from running the function twice
        numbered = known.select(F.monotonically_increasing_id().alias("_n"), "item_id", _digest(F.col("text")).alias("text_id"), cut(F.col("text")).alias("p"))
        parts = numbered.select("_n", "item_id", "text_id", F.explode("p").alias("p")).select("item_id", "text_id", "p.*")
        uid = F.unhex(F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")))
        table = materialize(parts.select("item_id", "text_id", "part", uid.alias("uid"), "tokens", "seeds"), "benchmark")
        size = F.size("tokens") - F.when(F.col("part") > 0, PART_OVERLAP).otherwise(0)
        totals = table.groupBy("item_id", "text_id").agg(F.sum(size).alias("total"))
        self.items = table.select("uid", "item_id", "text_id").distinct().join(totals, ["item_id", "text_id"])
        once = materialize(table.groupBy("uid").agg(F.first("tokens").alias("tokens"), F.first("seeds").alias("seeds")), "benchmark-parts")
        self.parts = once.select("uid", F.col("tokens").alias("item"))
        each = once.select("uid", F.explode("seeds").alias("s"))
        self.seeds = materialize(each.select("uid", "s.h", F.col("s.first").alias("a"), F.col("s.last").alias("b")), "benchmark-seeds")
        sizes = once.groupBy(F.least(F.size("tokens"), F.lit(14)).alias("size")).agg(F.max(F.size("tokens")).alias("longest")).collect()
        self.longest = max((r["longest"] for r in sizes), default=0)
        #: the masks of the sizes that there are, at most those of MASKS
        self.masks = tuple(dict.fromkeys(m for r in sizes for m in masks_for(r["size"])))

    def filter_words(self) -> np.ndarray:
        """A Bloom filter of the seeds' hashes, made by Spark; its words of 64 bits, of :data:`MOST_BITS` at most, come to the driver."""
        bits = _bits(self.seeds.agg(F.approx_count_distinct("h").alias("n")).first()["n"])

        @F.arrow_udf("array<bigint>")
        def places(h: pa.Array) -> pa.Array:
            at = _probes(np.asarray(h, np.int64).view(np.uint64), bits)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * PROBES, pa.int32()), pa.array(at.T.reshape(-1).astype(np.int64)))

        each = self.seeds.select(F.monotonically_increasing_id().alias("_n"), places(F.col("h")).alias("b")).select(F.explode("b").alias("b"))
        words = each.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("v")).toArrow()
        out = np.zeros(bits // 64, np.uint64)
        out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
        return out


class Seeker:
    """Finds the windows of texts that pass the filter: pieces ``start, tokens, hits``, whose places count from ``start``."""

    def __init__(self, masks: tuple[str, ...], longest: int, words: np.ndarray):
        self.masks, self.longest, self.words = masks, longest, words
        self.margin = longest + _LONGEST

    def _pieces(self, tokens: np.ndarray, offsets: np.ndarray, base: int = 0, least: int = 0, most: int | None = None) -> tuple | None:
        """(text, start, number of tokens, tokens, seeds) of the pieces of the texts: windows from ``least`` to before
        ``most``; places of a text count from ``base``."""
        parts = []
        for mask in self.masks:
            h = seed_hashes(tokens, mask)
            at = _passing(h, self.words) if len(h) else np.empty(0, np.int64)
            text = np.searchsorted(offsets, at, "right") - 1
            good = (at + len(mask) <= offsets[text + 1]) & (at >= least)
            if most is not None:
                good &= at < most
            at, text = at[good], text[good]
            if len(at):
                core = (at - offsets[text]) // CORE_TOKENS
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) != 1) | (h[at[1:]] != h[at[:-1]]) | (np.diff(text) != 0) | (np.diff(core) != 0)
                k = np.flatnonzero(new)
                parts.append((text[k], core[k], h[at[k]], at[k], at[np.append(k[1:], len(at)) - 1]))
        if not parts:
            return None
        text, core, h, first, last = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((core, text))
        text, core, h, first, last = text[order], core[order], h[order], first[order], last[order]
        edges = _edges(text, core)
        owner = np.repeat(np.arange(len(edges)), _sizes(edges, len(text)))
        of_piece = text[edges]
        lo = np.maximum(offsets[of_piece], np.minimum.reduceat(first, edges) - self.longest)
        hi = np.minimum(offsets[of_piece + 1], np.maximum.reduceat(last, edges) + self.margin)
        seeds = _Grouped(owner, h, first - lo[owner], last - lo[owner])
        return of_piece, base + lo - offsets[of_piece], hi - lo, tokens[_ranges(lo, hi - lo)].view(np.int64), seeds

    def __call__(self, column: pa.Array) -> pa.ListArray:
        """``list<struct<start, tokens, hits>>`` for each text."""
        found: list[tuple] = []
        # of a text that comes in pieces, the tokens that later windows and their surroundings still need are carried on
        last, held, base, done = -1, np.empty(0, np.uint64), 0, 0

        def take(number: int, pieces: tuple | None) -> None:
            if pieces is not None:
                found.append((pieces[0] + number, *pieces[1:]))

        def settle(final: bool) -> None:
            nonlocal held, base, done
            ready = len(held) if final else len(held) - self.margin
            if ready > done:
                take(last, self._pieces(held, np.array([0, len(held)]), base, done, ready))
                cut = max(0, ready - self.margin)
                held, base, done = held[cut:].copy(), base + cut, ready - cut

        for lo, tokens, offsets in token_blocks(column) if self.masks else ():
            if len(offsets) > 2:
                take(lo, self._pieces(tokens, offsets))
                continue
            if lo != last:
                if last >= 0:
                    settle(True)
                last, held, base, done = lo, np.empty(0, np.uint64), 0, 0
            held = np.concatenate([held, tokens])
            settle(False)
        if last >= 0:
            settle(True)
        # a block of many texts may have come before the end of an earlier one
        join = lambda k, kind: np.concatenate([np.empty(0, kind), *(f[k] for f in found)])
        text, start, sizes = join(0, np.int64), join(1, np.int64), join(2, np.int64)
        hits = np.concatenate([np.empty(0, np.int64), *(np.bincount(f[4].owners, minlength=len(f[0])) for f in found)]).astype(np.int64)
        columns = [pa.array(start), _lists(pa.array(join(3, np.int64)), sizes), _Grouped.array([f[4] for f in found], hits)]
        pieces = pa.StructArray.from_arrays(columns, fields=list(_PIECE))
        order = np.argsort(text, kind="stable")
        if (np.diff(text) < 0).any():
            pieces = pieces.take(pa.array(order))
        return _lists(pieces, np.bincount(text, minlength=len(column)))


def document_pieces(text: Column, benchmark: Benchmark) -> Column:
    """``array<struct<start, tokens, hits>>``: the stretches of a text around windows that pass the benchmark's filter."""
    words, masks, longest = benchmark.seeds.sparkSession.sparkContext.broadcast(benchmark.filter_words()), benchmark.masks, benchmark.longest

    @F.arrow_udf(_PIECES_DDL)
    @frugal
    def seek(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seeker = Seeker(masks, longest, words.value)
        for batch in batches:
            yield seeker(batch)

    return seek(text)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _overlaps(docs: DataFrame, bench: Benchmark, key: Column) -> DataFrame:
    """``row, key, uid, start, tokens, equal`` of verified segments between rows of ``docs`` and parts of the benchmark."""
    sought = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("key"), document_pieces(F.col("text"), bench).alias("p"))
    pieces = sought.select("row", "key", F.explode("p").alias("p")).select("row", "key", "p.*")
    # numbered when the table is written: an attempt that fails leaves nothing in it
    pieces = materialize(pieces.select(F.monotonically_increasing_id().alias("piece"), "*"), "pieces")
    hits = pieces.select("piece", F.explode("hits").alias("x")).select("piece", "x.*")
    met = hits.join(bench.seeds, "h").groupBy("piece", "uid").agg(F.collect_list(F.struct("first", "last", "a", "b")).alias("spans"))
    pairs = materialize(met, "met").join(bench.parts, "uid")

    @F.arrow_udf(_OVERLAP_DDL)
    def verified(doc: pa.Array, item: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for d, i, x in zip(doc, item, spans, strict=True):
            d, i = (np.asarray(y.values, np.int64) for y in (d, i))
            found = best_overlap(d, i, diagonals_of(x.as_py(), len(d), len(i)))
            rows.append(None if found is None else dict(zip(("start", "tokens", "equal"), found, strict=True)))
        return pa.array(rows, _OVERLAP)

    both = pieces.select("piece", "row", "key", F.col("start").alias("base"), "tokens").join(pairs, "piece")
    checked = materialize(both.select("row", "key", "uid", "base", verified("tokens", "item", "spans").alias("o")), "overlaps").where(F.col("o").isNotNull())
    return checked.select("row", "key", "uid", (F.col("base") + F.col("o.start")).alias("start"), F.col("o.tokens").alias("tokens"), F.col("o.equal").alias("equal"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, tokens, equal, item_share``: a row for each document and benchmark item that overlap.

    The segment is that of most equal tokens, the first of ties.  ``start`` counts the document's tokens, ``item_share`` is
    the share of the item's tokens that the segment equals; of an item of more than :data:`PART_TOKENS` tokens it is the
    segment in one part.  Nulls: null texts overlap nothing, items of a null id or text are ignored; a null ``doc_id``
    stays null.  Repeated rows of ``docs`` give a row each, repeated benchmark rows count once; empty tables give an empty
    result.  Very long texts are sought whole, in blocks; other columns are ignored, whatever their names.
    """
    bench = Benchmark(benchmark)
    named = _overlaps(docs, bench, F.col("doc_id")).join(bench.items, "uid")
    first = F.min(F.struct((-F.col("equal")).alias("less"), "start", "tokens", "equal")).alias("o")
    best = named.groupBy("row", "key", "item_id", "text_id").agg(first, F.first("total").alias("total"))
    return best.select(
        F.col("key").alias("doc_id"), "item_id", F.col("o.start").alias("start"), F.col("o.tokens").alias("tokens"), F.col("o.equal").alias("equal"), (F.col("o.equal") / F.col("total")).alias("item_share")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that overlap no benchmark item.

    A row stays or goes by its text alone, also with a null id; null texts stay; repeated rows are treated alike; an empty
    table of either kind drops nothing.  What goes is a table of text digests, broadcast only if Spark finds it small.
    """
    found = _overlaps(docs, Benchmark(benchmark), _digest(F.col("text")))
    name = next(c for c in ("digest", *(f"digest_{k}" for k in range(len(docs.columns) + 1))) if c not in docs.columns)
    gone = materialize(found.select(F.col("key").alias(name)).distinct(), "contaminated")
    return docs.withColumn(name, _digest(F.col("text"))).join(gone, name, "left_anti").drop(name)
