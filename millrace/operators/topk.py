"""Exact best items per query inside one task, and the pass over items that uses it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from millrace.scratch import materialize

#: Scores are compared with so many digits, so that sums in another order tie alike.
DIGITS = 9
#: Candidates that a task holds beside the best it keeps, before it drops those that are beaten (or half as many as the best).
SPARE = 250_000
#: Queries that one task takes, where a block has more, and candidates that all tasks of a block together may pass on.
TASK_QUERIES = 256
PASSED_ON = 20_000_000


def rounded(x: np.ndarray) -> np.ndarray:
    return np.round(x, DIGITS) + 0.0  # no negative zero


class TopK:
    """The ``k`` best of each query by :func:`rounded` score, equal ones by the least item id; holds ``queries * k`` entries and
    some spare."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)  # the k-th best so far
        self.last = np.full(queries, np.iinfo(np.int64).max)  # and its item, where ids are whole numbers
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.limit = 0

    def add(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        key, floor = rounded(score), self.floor[query]
        good = key >= floor
        if item.dtype.kind in "iu":
            good &= (key > floor) | (item < self.last[query])
        if good.any():
            self.parts.append((query[good], item[good], score[good]))
            self.held += int(good.sum())
            if self.held > self.limit + max(SPARE, self.limit // 2):
                self._drop_beaten()

    def _drop_beaten(self) -> None:
        query, item, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        whole = item.dtype.kind in "iu"
        order = np.lexsort((item if whole else np.unique(item, return_inverse=True)[1], -rounded(score), query))
        query, item, score = query[order], item[order], score[order]
        edges = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        within = np.arange(len(query)) - np.repeat(edges, np.diff(np.append(edges, len(query))))
        keep = within < self.k
        last = within == self.k - 1
        self.floor[query[last]] = rounded(score[last])
        if whole:
            self.last[query[last]] = item[last]
        self.parts = [(query[keep], item[keep], score[keep])]
        self.held = self.limit = int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of what is left."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self._drop_beaten()
        return self.parts[0]


class Tours:
    """Global and local :class:`TopK` of a block of queries; local ones count items of the query's location (null equals null)."""

    def __init__(self, locations: list, k_global: int, k_local: int):
        self.glob = TopK(len(locations), k_global) if k_global else None
        self.local = TopK(len(locations), k_local) if k_local else None
        codes: dict = {}
        self.query_place = np.array([codes.setdefault(x, len(codes)) for x in locations], np.int64)
        self.codes = codes

    def places(self, locations: list) -> np.ndarray:
        """Numbers of items' locations; -1 for one that no query has."""
        return np.array([self.codes.get(x, -1) for x in locations], np.int64)

    def add(self, query: np.ndarray, item: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        if self.glob is not None:
            self.glob.add(query, item, score)
        if self.local is not None:
            here = self.query_place[query] == place
            self.local.add(query[here], item[here], score[here])

    def add_matrix(self, first: int, scores: np.ndarray, item: np.ndarray, place: np.ndarray, positive: bool = False) -> None:
        """Scores of the queries from number ``first`` on (rows) with items (columns); ``positive`` passes over the others."""
        wanted = scores > 0 if positive else None
        for top, local in ((self.glob, False), (self.local, True)):
            if top is not None:
                good = scores >= top.floor[first : first + len(scores), None] - 10.0**-DIGITS  # a little more than add() keeps
                if wanted is not None:
                    good &= wanted
                if local:
                    good &= self.query_place[first : first + len(scores), None] == place
                q, i = np.nonzero(good)
                top.add(q + first, item[i], scores[q, i])

    def batches(self, ids: list, id_type: pa.DataType, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        ids = pa.array(ids, id_type)
        for scope, top in (("global", self.glob), ("local", self.local)):
            if top is not None:
                query, item, score = top.result()
                for at in range(0, len(query), 100_000):
                    q, i, s = query[at : at + 100_000], item[at : at + 100_000], score[at : at + 100_000]
                    columns = [ids.take(pa.array(q)), pa.array(i, item_type), pa.array(s), pa.array(rounded(s)), pa.repeat(scope, len(q))]
                    yield pa.record_batch(columns, names=["query_id", "item_id", "score", "key", "scope"])


def item_ids(column: pa.Array) -> np.ndarray:
    """Ids as an array that NumPy can order: whole numbers, or text by code points."""
    return column.to_numpy(zero_copy_only=False).astype(np.str_) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def tours_in_blocks(
    queries: DataFrame, items: DataFrame, k_global: int, k_local: int, block: int, columns: list[str], task: Callable[..., Callable], prepare: Callable[[list], object] | None = None
) -> DataFrame:
    """``query_id, item_id, scope, score, rank``: passes over ``items`` with one block of queries after another.

    Only one block of at most about ``block`` queries (``query_id, location`` and ``columns``) is on the driver and in the
    tasks at a time; its ranking is a table before the next is taken.  ``prepare`` may compute from a block's rows what all
    its tasks need.  A task passes on its own best, at most ``k_global + k_local`` for each query; ``task`` makes the
    function over the items' record batches.  A block of many queries is dealt to tasks of :data:`TASK_QUERIES`, each over a larger
    part of the items, so that neither a task's memory nor what all tasks pass on grows with the block.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    id_type, item_type = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(items.schema["item_id"].dataType)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double, key double, scope string"
    limit = F.when(F.col("scope") == "global", F.lit(k_global)).otherwise(F.lit(k_local))
    order = Window.partitionBy("query_id", "scope").orderBy(F.col("key").desc(), F.col("item_id"))
    cores = items.sparkSession.sparkContext.defaultParallelism
    out = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = own.select("query_id", "location", *columns).collect()
        if not rows:
            continue
        common = () if prepare is None else (prepare(rows),)
        shares = min(-(-len(rows) // TASK_QUERIES), 2 * cores)
        held = items
        if shares > 1:
            held = items.coalesce(max(-(-2 * cores // shares), PASSED_ON // (len(rows) * (k_global + k_local))))
        found = None
        for at in range(shares):
            part = held.mapInArrow(task(rows[at::shares], k_global, k_local, id_type, item_type, *common), kinds)
            found = part if found is None else found.unionByName(part)
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k_global, k_local)).where(F.col("rank") <= limit)
        part = materialize(ranked.select("query_id", "item_id", "scope", "score", "rank"), "tours")
        out = part if out is None else out.unionByName(part)
    return items.sparkSession.createDataFrame([], kinds + ", rank int").select("query_id", "item_id", "scope", "score", "rank") if out is None else out
