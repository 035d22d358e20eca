"""Every query of the retrieval engine, with the SQL that computes the same rows.

A query is registered with its oracle: ``@query("name", sql)`` over a function of :class:`Tables`.  SQL is left out only
where none expresses the operator; such a query has a brute-force test.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from millrace.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a scale-factor folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = partial(lambda f, spark, sf_dir: f(Tables(spark, sf_dir)), f)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _load() -> None:
    from millrace.plans import log_queries, rank_queries, retrieval_queries, source_queries, text_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the documents' fields for the benchmark texts: local and global rankings, fused."""
    return queries()["rrf_bm25_fused"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
