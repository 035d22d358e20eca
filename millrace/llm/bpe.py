"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of many pre-tokens form one doubly linked list with a mark between any two.  Every adjacent pair whose joined
bytes are in the vocabulary waits in the bucket of its merge rank.  Three levels of 64-bit words mark the buckets in use;
find-first-set at each level gives the lowest rank.  All positions of that bucket merge in one vectorised step, leftmost
first where they overlap; entries whose pair has changed since are stale and are skipped.  Pre-tokens do not touch each
other, so this equals merging each alone; should a vocabulary let a merge open a pair of a lower rank, the pre-tokens
concerned are merged again alone, strictly one step at a time.  A pre-token of megabytes is no special case; it takes some
thirty bytes of memory for each of its own.  Other long texts pass in slices of pre-tokens, whose ids are hashed or put into
arrays as they come.

Pre-tokens repeat, so every task keeps the encodings of those it has seen; the memory of that table is bounded: when it is
full, the half that was learned last goes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import frugal

#: Entries in a task's table of known encodings, and the longest pre-token (in characters) that it holds.
CACHE_ENTRIES = 200_000
CACHE_LENGTH = 64
#: Characters of text whose new pre-tokens are merged together, and from how many on that is worth it.
BLOCK_CHARS = 1_000_000
TOGETHER = 500
#: Longer texts are encoded by themselves, in slices of so many pre-tokens.
LONG_CHARS = 1_000_000
SLICE_PRETOKENS = 200_000


def default_vocabulary() -> tuple[str, str]:
    """The rank file and the splitting pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets by rank; :meth:`lowest` finds the first rank in use by find-first-set on three bitmap levels."""

    __slots__ = ("buckets", "low", "middle", "top")

    def __init__(self):
        self.buckets: dict[int, list] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, which is then in use."""
        bucket = self.buckets.get(rank)
        if bucket is None:
            bucket = self.buckets[rank] = []
            word, group = rank >> 6, rank >> 12
            self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
            self.middle[group] = self.middle.get(group, 0) | 1 << (word & 63)
            self.top |= 1 << group
        return bucket

    def lowest(self) -> int:
        """The lowest rank in use, or -1."""
        top = self.top
        if not top:
            return -1
        group = (top & -top).bit_length() - 1
        bits = self.middle[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list:
        """Removes a bucket in use and returns it."""
        bucket = self.buckets.pop(rank)
        word, group = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[group] &= ~(1 << (word & 63))
            if not self.middle[group]:
                self.top &= ~(1 << group)
        return bucket


class ByteBPE:
    """Encoder and decoder of one vocabulary; equals what merging by lowest rank, leftmost first, gives."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.decimals = {str(rank).encode(): token for token, rank in ranks.items()}
        compiled = regex.compile(pattern)
        self.split, self.each = compiled.findall, compiled.finditer
        self.known: dict[str, bytes] = {}
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # every pair of tokens whose bytes together are a token
        pairs, joined = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    joined.append(rank)
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.joined = np.array(pairs, np.int64)[order], np.array(joined, np.int64)[order]

    def merge_alone(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, one merge at a time."""
        ranks = self.ranks
        n = len(piece)
        ids = [ranks[piece[i : i + 1]] for i in range(n)]
        ends = list(range(1, n + 1))  # where the symbol that starts here ends; 0: it is part of an earlier one
        before = list(range(-1, n - 1))
        pair_rank = [-1] * n  # rank of the pair that starts here, -1 without one
        queue, lookup = RankQueue(), ranks.get
        for i in range(n - 1):
            rank = lookup(piece[i : i + 2])
            if rank is not None:
                pair_rank[i] = rank
                heappush(queue.bucket(rank), i)
        while (rank := queue.lowest()) >= 0:
            bucket = queue.buckets[rank]
            i = heappop(bucket)
            if not bucket:
                queue.take(rank)
            if pair_rank[i] != rank or not ends[i]:
                continue  # stale
            j = ends[i]
            end = ends[j]
            ids[i], ends[i], ends[j] = rank, end, 0
            pair_rank[i] = pair_rank[j] = -1
            if end < n:
                before[end] = i
                new = lookup(piece[i : ends[end]])
                if new is not None:
                    pair_rank[i] = new
                    heappush(queue.bucket(new), i)
            left = before[i]
            if left >= 0:
                new = lookup(piece[left:end])
                if new is None:
                    pair_rank[left] = -1
                elif new != pair_rank[left]:
                    pair_rank[left] = new
                    heappush(queue.bucket(new), left)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = ends[i]
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, -1 where it is none; marks are negative and join with nothing."""
        out = np.empty(len(left), np.int32)
        for k in range(0, len(left), 1 << 20):
            key = (left[k : k + (1 << 20)].astype(np.int64) << np.int64(32)) | (right[k : k + (1 << 20)] & np.int64(0xFFFFFFFF))
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            out[k : k + (1 << 20)] = np.where(self.pairs[at] == key, self.joined[at], -1)
        return out

    @staticmethod
    def _push(queue: RankQueue, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                queue.bucket(int(ranks[a])).append(positions[a:b])

    def merge_together(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of many pre-tokens, merged in one queue."""
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        marks = np.cumsum(sizes + 1) - 1
        n = len(raw)
        ids = self.bytes_to_id[raw]
        ids[marks] = -1
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        following[-1] = n - 1
        pair_rank = np.full(n, -1, np.int32)
        pair_rank[:-1] = self._pair_ranks(ids[:-1], ids[1:])
        alive, starting = np.ones(n, bool), np.zeros(n, bool)
        queue, again = RankQueue(), []
        at = np.flatnonzero(pair_rank >= 0)
        self._push(queue, pair_rank[at], at)
        while (rank := queue.lowest()) >= 0:
            bucket = queue.take(rank)
            at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            at = at[(pair_rank[at] == rank) & alive[at]]  # the others are stale
            if not len(at):
                continue
            second = following[at]
            starting[at] = True
            overlap = starting[second].any()
            starting[at] = False
            if overlap:
                taken, last = [], -1
                for i, j in zip(at.tolist(), second.tolist(), strict=True):
                    if i != last:
                        taken.append(i)
                        last = j
                at = np.array(taken)
                second = following[at]
            end = following[second]
            ids[at] = rank
            alive[second] = False
            pair_rank[second] = -1
            following[at] = end
            before[end] = at
            left = before[at]
            left = left[left >= 0]
            changed = np.concatenate([at, left])
            new = self._pair_ranks(ids[changed], ids[following[changed]])
            pair_rank[changed] = new
            some = new >= 0
            if some.any():
                if new[some].min() < rank:
                    again.extend(np.searchsorted(marks, changed[some][new[some] < rank]).tolist())
                self._push(queue, new[some], changed[some])
        kept = np.flatnonzero(alive)
        bounds = np.searchsorted(kept, marks)
        starts = np.concatenate([[0], bounds[:-1] + 1])
        flat = ids[kept].tolist()
        out = [flat[a:b] for a, b in zip(starts.tolist(), bounds.tolist(), strict=True)]
        for k in set(again):
            out[k] = self.merge_alone(pieces[k])
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pre-tokens; one that is a token itself is that token."""
        out: list = [self.ranks.get(p) for p in pieces]
        rest = [k for k, whole in enumerate(out) if whole is None]
        out = [None if whole is None else [whole] for whole in out]
        left = [pieces[k] for k in rest]
        merged = self.merge_together(left) if sum(map(len, left)) >= TOGETHER else [self.merge_alone(p) for p in left]
        for k, ids in zip(rest, merged, strict=True):
            out[k] = ids
        return out

    def _joined(self, split: list[list[str]]) -> Iterator[bytes]:
        """The ids of each list of pre-tokens as decimals joined by one space."""
        if len(self.known) > CACHE_ENTRIES:  # what was seen first is what is seen often
            self.known = dict(islice(self.known.items(), CACHE_ENTRIES // 2))
        known = self.known
        new = list(set().union(*split).difference(known))
        merged = self.merge([t.encode("utf-8", "replace") for t in new])
        known.update((t, " ".join(map(str, ids)).encode()) for t, ids in zip(new, merged, strict=True))
        try:
            for tokens in split:
                yield b" ".join(map(known.__getitem__, tokens))
        finally:
            for t in new:
                if len(t) > CACHE_LENGTH:
                    known.pop(t, None)

    def slices(self, texts: Iterable[str]) -> Iterator[tuple[bytes, bool]]:
        """(ids as decimals joined by one space, whether the text ends) of every text in turn; a long one in several slices."""
        block, size = [], 0
        for t in texts:
            if len(t) <= LONG_CHARS:
                block.append(t)
                size += len(t)
                if size < BLOCK_CHARS:
                    continue
            for joined in self._joined([self.split(x) for x in block]):
                yield joined, True
            block, size = [], 0
            if len(t) > LONG_CHARS:
                found = self.each(t)
                tokens = [m.group() for m in islice(found, SLICE_PRETOKENS)]
                while tokens:
                    ahead = [m.group() for m in islice(found, SLICE_PRETOKENS)]
                    for joined in self._joined([tokens]):
                        yield joined, not ahead
                    tokens = ahead
        for joined in self._joined([self.split(x) for x in block]):
            yield joined, True

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as decimals joined by one space."""
        parts: list[bytes] = []
        for joined, ends in self.slices(texts):
            parts.append(joined)
            if ends:
                yield parts[0] if len(parts) == 1 else b" ".join(parts)
                parts = []

    def encode(self, text: str) -> list[int]:
        return [int(x) for joined in self.encode_all([text]) for x in joined.split()]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One tokenizer for each vocabulary and Python worker."""
    return ByteBPE(load_ranks(path), pattern)


def encode_column(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """``array<int>`` of token ids; null and empty texts have none."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    @F.arrow_udf("array<int>")
    @frugal
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            counts, flat, size = [0], [], 0
            for joined, ends in bpe.slices(t.as_py() or "" for t in batch):
                flat.append(np.array(joined.split(), np.int32) if joined else np.empty(0, np.int32))
                size += len(flat[-1])
                if ends:
                    counts.append(size)
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values)

    return encode(text)


def decode_column(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Bytes of an ``array<int>`` of token ids; null for null.  An id outside the vocabulary is an error."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    @F.arrow_udf("binary")
    @frugal
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            yield pa.array((None if x is None else bpe.decode_bytes(x) for x in batch.to_pylist()), pa.binary())

    return decode(ids)


_DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(bpe: ByteBPE, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
    """(number of ids, hash of their decimals, hash of the decoded bytes) of each text, slice by slice."""
    n, ids_hash, decoded_hash = 0, hashlib.sha256(), hashlib.sha256()
    for joined, ends in bpe.slices(texts):
        ids = joined.split()
        if n:
            ids_hash.update(b" ")
        ids_hash.update(joined)
        decoded_hash.update(b"".join(map(bpe.decimals.__getitem__, ids)))
        n += len(ids)
        if ends:
            yield n, ids_hash.hexdigest(), decoded_hash.hexdigest()
            n, ids_hash, decoded_hash = 0, hashlib.sha256(), hashlib.sha256()


def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and its ids decoded again.

    Nulls: a null text is an empty one (no ids, the hashes of nothing); a null id stays null.  Repeated rows are encoded
    each, equal texts alike; an empty table gives an empty result, other columns are ignored whatever their names.  Texts
    of any length are encoded whole, long ones slice by slice.  The ids themselves stay in the worker; :func:`encode_column` returns them.
    """
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    @frugal
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            rows = list(_digests(bpe, (t.as_py() or "" for t in batch)))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGEST, strict=True)], names=_DIGEST.names)

    done = docs.select(F.col("doc_id"), digest(F.col("text")).alias("d"))
    return done.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
