"""Near-duplicates by DartMinHash: sparse weighted signatures, banded joining, exact verification, classes.

A text is the weighted set of its five-word shingles, a shingle's weight being the number of times it occurs.  Darts are
thrown at the plane weight x rank of every element by a hash of the element, one on average in each cell of area 1 (cells
double in width along the weight, halving in height along the rank).  A text keeps the darts below the weight of their
element and below a rank that leaves about ``k ln k + 2k`` of them; each dart falls on one of ``k`` coordinates, where the
earliest (of lowest rank) stays.  Two texts agree on a coordinate with the probability of their weighted Jaccard
similarity.  Coordinates are joined in bands; candidate pairs are verified by the exact similarity.

Whole exact copies are one node from the start.  Within a bucket, all members are first compared with one leader, the
member that shares most buckets with others (in a group of edited copies the text they come from): comparisons in
proportion to the bucket's size.  Members that the leader is not linked with are then compared with every other member of
another class so far, in blocks whose rows never become pairs; they give one link for each class met.  Two members linked
with their leader are one class already, so this finds all classes that comparing all pairs of all buckets would, and no
bucket is capped.  Classes are the connected components of the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import frugal, materialize, mix, whole_word_blocks, window_hash
from millrace.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bands and coordinates in each: a pair at similarity 0.8 meets in some band with probability 0.9993.
BANDS, ROWS = 24, 6
#: Members of a bucket in a block of the second step.
BLOCK_MEMBERS = 256
#: Elements whose darts are thrown at a time.
THROWN = 1 << 16

_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(16)])
_UNIT = 1.0 / (1 << 53)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


def _salted(h: np.ndarray, salt) -> np.ndarray:
    return mix(h + np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15))


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each count, in one array."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _darts(element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the element, rank, hash) of the darts below each element's weight and rank limit."""
    owners, ranks, ids = [], [], []
    low, width, strip = 0.0, 1.0, 0
    alive = np.arange(len(element))
    while len(alive):
        rows = np.ceil(limit[alive] * width).astype(np.int64)
        owner, row = np.repeat(alive, rows), _ranges(rows)
        cell = _salted(element[owner] ^ _salted(np.full(len(owner), strip, np.uint64), row.astype(np.uint64)), 1)
        count = np.searchsorted(_POISSON, _uniform(cell), "right")
        owner, row, number = np.repeat(owner, count), np.repeat(row, count), _ranges(count)
        dart = _salted(np.repeat(cell, count), number.astype(np.uint64) + np.uint64(2))
        x = low + width * _uniform(_salted(dart, 3))
        rank = (row + _uniform(_salted(dart, 4))) / width
        good = (x < weight[owner]) & (rank < limit[owner])
        owners.append(owner[good])
        ranks.append(rank[good])
        ids.append(dart[good])
        low, width, strip = low + width, width * (2.0 if strip else 1.0), strip + 1
        alive = alive[weight[alive] > low]
    return (np.concatenate(owners), np.concatenate(ranks), np.concatenate(ids)) if owners else (alive, np.empty(0), np.empty(0, np.uint64))


def signatures(element: np.ndarray, weight: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """``k`` dart hashes of each weighted set; ``text`` is the set of each element.  Sets without weight stay 0.

    A set that has an empty coordinate throws again below twice the rank, which keeps the darts it has.
    """
    out = np.zeros((n_texts, k), np.uint64)
    total = np.bincount(text, weight, n_texts)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n_texts)
    limit[todo] = (k * math.log(k) + 2 * k) / total[todo]
    member = np.ones(len(element), bool)
    while len(todo):
        best = np.full(n_texts * k, np.inf)
        every = np.flatnonzero(member)
        for at in range(0, len(every), THROWN):
            own = every[at : at + THROWN]
            owner, rank, dart = _darts(element[own], weight[own], limit[text[own]])
            slot = text[own[owner]] * k + (_salted(dart.copy(), 5) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            won = rank == best[slot]
            out.reshape(-1)[slot[won]] = dart[won]
        empty = np.isinf(best.reshape(n_texts, k)[todo]).any(axis=1)
        todo = todo[empty]
        limit[todo] *= 2
        again = np.zeros(n_texts, bool)
        again[todo] = True
        member = again[text]
    return out


def _shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every five-word shingle; fewer words are one shingle, none are none."""
    sizes = np.diff(offsets)
    h = window_hash(words, list(range(SHINGLE_WORDS)))
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
    good = np.arange(len(h)) + SHINGLE_WORDS <= offsets[1:][text]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE_WORDS))
    whole = [window_hash(words[offsets[t] : offsets[t + 1]], list(range(sizes[t])))[0] for t in short.tolist()]
    return np.concatenate([h[good], np.array(whole, np.uint64)]), np.concatenate([text[good], short])


def _counted(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) with the number of each."""
    if len(text) and text[0] == text[-1]:  # one text, perhaps a very long one
        h, count = np.unique(h, return_counts=True)
        return h, np.full(len(h), text[0]), count.astype(float)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return h[at], text[at], np.diff(np.append(at, len(h))).astype(float)


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        keys = _salted(keys ^ signature[:, r::rows][:, :bands], r + 1)
    return _salted(keys, np.arange(bands, dtype=np.uint64))


def bands(text: Column, n_bands: int = BANDS, rows: int = ROWS) -> Column:
    """``array<bigint>``: a key for each band of a text's signature; none for a text without words."""

    @F.arrow_udf("array<bigint>")
    @frugal
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, flat = np.zeros(len(batch), np.int64), []
            for lo, words, offsets in whole_word_blocks(batch):
                h, owner, weight = _counted(*_shingles(words, offsets))
                n = len(offsets) - 1
                full = np.bincount(owner, minlength=n) > 0
                key = _band_keys(signatures(h, weight, owner, n, n_bands * rows), n_bands, rows)
                flat.append(key[full].reshape(-1).view(np.int64))
                sizes[lo : lo + n] = full * n_bands
            values = np.concatenate(flat) if flat else np.empty(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))

    return keys(text)


def weighted_shingles(text: Column) -> Column:
    """``array<int>``: a hash of each shingle and of which occurrence it is, so equal counts share equal elements."""

    @F.arrow_udf("array<int>")
    @frugal
    def elements(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, flat = np.zeros(len(batch), np.int64), []
            for lo, words, offsets in whole_word_blocks(batch):
                h, owner, weight = _counted(*_shingles(words, offsets))
                count = weight.astype(np.int64)
                each = _salted(np.repeat(h, count), _ranges(count).astype(np.uint64))
                flat.append((each >> np.uint64(32)).astype(np.uint32).view(np.int32))
                n = len(offsets) - 1
                sizes[lo : lo + n] = np.bincount(np.repeat(owner, count), minlength=n)
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))

    return elements(text)


def _node(text: Column) -> Column:
    """Sixteen bytes that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class _Verifier:
    """Exact similarities of pairs of nodes; texts are read again only for the nodes that are in a shared bucket."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, members: DataFrame):
        # of each node one row's text is wanted: that of its least id, or any where all its ids are null
        wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
        texts = docs.select("doc_id", "text", _node(F.col("text")).alias("_n"))
        found = texts.join(wanted.withColumnRenamed("doc_id", "_d"), (F.col("_n") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("_d")))
        self.shingles = materialize(found.groupBy("node").agg(F.first("text").alias("text")).select("node", weighted_shingles(F.col("text")).alias("s")), "shingles")

    def __call__(self, pairs: DataFrame, similarity: float) -> DataFrame:
        """``a, b, similar`` for distinct pairs."""
        left = pairs.join(self.shingles.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
        both = left.join(self.shingles.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.select("a", "b", (shared >= similarity * (F.size("sa") + F.size("sb") - shared)).alias("similar"))


def _cell_links(cell: list[tuple], similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """One link for each left member and class of a right member that it is similar to, of another class than its own.

    A cell's rows are (is_left, node, label, shingles).
    """
    left, right = [r for r in cell if r[0]], [r for r in cell if not r[0]]
    if not left or not right:
        return
    names = {label: n for n, label in enumerate(dict.fromkeys(r[2] for r in cell))}
    labels = np.array([names[r[2]] for r in right])
    sizes = np.array([len(r[3]) for r in right])
    owner = np.repeat(np.arange(len(right)), sizes)
    flat = np.concatenate([r[3] for r in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for _, node, label, own in left:
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n = hi - lo
        shared = np.bincount(owner[_ranges(n) + np.repeat(lo, n)], minlength=len(right))
        good = np.flatnonzero((shared >= similarity * (len(own) + sizes - shared)) & (labels != names[label]))
        for k in good[np.unique(labels[good], return_index=True)[1]].tolist():
            yield node, right[k][1]


def _links_of_rest(rest: DataFrame, others: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` of members left over (``band, node, label, s, xs, ys``) with all members of their buckets.

    Both sides are dealt to the cells of a grid over each bucket, of :data:`BLOCK_MEMBERS` rows a side.
    """
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    x = rest.select("band", part(F.col("xs")).alias("x"), all_of(F.col("ys")).alias("y"), F.lit(True).alias("is_left"), "node", "label", "s")
    y = others.select("band", all_of(F.col("xs")).alias("x"), part(F.col("ys")).alias("y"), F.lit(False).alias("is_left"), "node", "label", "s")

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                keys = zip(*(batch.column(c).to_pylist() for c in ("band", "x", "y", "is_left", "node", "label")), strict=True)
                column = batch.column("s")
                values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
                for key, a, b in zip(keys, np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                    yield (*key, values[a:b])

        for _, cell in groupby(rows(), key=itemgetter(0, 1, 2)):
            found = list(dict.fromkeys((min(f), max(f)) for f in _cell_links([r[3:] for r in cell], similarity)))
            if found:
                yield pa.record_batch([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    cells = x.unionByName(y).repartition(F.col("band"), F.col("x"), F.col("y")).sortWithinPartitions("band", "x", "y")
    return cells.mapInArrow(compare, "a binary, b binary")


def near_links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame | None:
    """Verified links ``a, b`` between nodes (``node, doc_id, bands``), or None where no two nodes share a bucket.

    Their connected components are those of all similar pairs that share a bucket.
    """
    placed = nodes.select("node", F.explode("bands").alias("band"))
    counted = placed.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("n"))
    shared = materialize(counted.where(F.col("x") != F.col("y")).select("band", "n"), "shared")
    members = materialize(placed.join(shared, "band"), "members")
    if not members.limit(1).count():
        return None
    verify = _Verifier(docs, nodes, members)
    central = materialize(members.groupBy("node").agg(F.sum("n").alias("weight")), "central")
    leaders = members.join(central, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("best")).select("band", F.col("best.node").alias("leader"))
    leaders = materialize(leaders, "leaders")
    compared = members.join(leaders, "band").where(F.col("node") != F.col("leader"))
    compared = compared.select("band", "node", "n", F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    checked = materialize(verify(materialize(compared.select("a", "b").distinct(), "pairs"), similarity), "checked")
    links = checked.where("similar").select("a", "b")
    # the rest: not linked with its leader, in a bucket of three or more that holds more than one class
    unlinked = compared.where("n > 2").join(checked.where("NOT similar"), ["a", "b"]).select("band", "node")
    labels = components(links)
    labelled = members.where("n > 2").join(labels, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.first("n").alias("n")).where(F.col("p") != F.col("q"))
    rest = unlinked.join(labelled.select("band", "node", "label"), ["band", "node"])
    sizes = mixed.join(rest.groupBy("band").agg(F.count("*").alias("r")), "band")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_MEMBERS).cast("int")
    sizes = materialize(sizes.select("band", blocks("r").alias("xs"), blocks("n").alias("ys")), "sizes")
    if not sizes.limit(1).count():
        return links
    with_shingles = lambda df: materialize(df.join(sizes, "band"), "side").join(verify.shingles, "node").select("band", "node", "label", "s", "xs", "ys")
    more = _links_of_rest(with_shingles(rest), with_shingles(labelled.select("band", "node", "label")), similarity)
    return links.unionByName(materialize(more, "more"))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, node, is_kept`` for every row of ``docs``; ``class_id`` is the least id of the class.

    Equal texts are one class; so are texts linked, directly or through others, by a weighted Jaccard similarity of
    ``similarity`` or more over five-word shingles (lower case, marks ignored; a text of fewer words is one shingle).
    ``is_kept`` marks rows whose id is the class id and whose text is that id's text in the class.

    Nulls and odd rows: a null text is an empty one; texts without any word are copies of equal texts only.  A row with a
    null id takes part as any other; the id of a class is its least one that is not null, or null without one.  Ties:
    repeated rows share a class and the mark.  A very long text is one set of shingles, some fifty bytes of memory for each
    of its words.  An empty table gives an empty result; other columns are ignored, whatever their names.

    Shingles are compared by hashes of 32 bits: two different ones of a pair of 400-word texts coincide with probability
    4e-5, which moves the similarity by a four-hundredth.
    """
    sketch = materialize(docs.select("doc_id", _node(F.col("text")).alias("node"), bands(F.col("text")).alias("bands")), "sketch")
    nodes = materialize(sketch.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "nodes")
    links = near_links(docs, nodes, similarity)
    of_node = nodes.select("node", F.col("doc_id").alias("first_id"))
    if links is not None:
        grouped = of_node.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        # null ids come after all others
        order = F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "node")
        least = materialize(grouped.groupBy("component").agg(F.min(order).alias("least")), "least")
        of_node = grouped.join(least, "component").select("node", F.col("least.first_id").alias("class_id"), (F.col("least.node") == F.col("node")).alias("leads"))
    else:
        of_node = of_node.select("node", F.col("first_id").alias("class_id"), F.lit(True).alias("leads"))
    of_node = materialize(of_node, "classes")
    return sketch.select("doc_id", "node").join(of_node, "node").select(
        "doc_id", "class_id", "node", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_kept")
    )


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` (all columns, whatever their names) of each near-duplicate class: the one of the least id.

    Of repeated rows any one stays; null texts and null ids as in :func:`near_duplicate_classes`; an empty table stays empty.
    """
    kept = materialize(near_duplicate_classes(docs, similarity).where("is_kept").groupBy("doc_id", "node").agg(F.count("*").alias("n")), "kept")
    name = next(c for c in ("node", *(f"node_{k}" for k in range(len(docs.columns) + 1))) if c not in docs.columns)
    marked = docs.withColumn(name, _node(F.col("text")))
    same = marked["doc_id"].eqNullSafe(kept["doc_id"]) & (marked[name] == kept["node"])
    out = marked.join(kept, same, "left_semi")
    if kept.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", name])
    return out.drop(name)
