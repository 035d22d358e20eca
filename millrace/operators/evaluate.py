"""Recall metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query_recall(predictions: DataFrame, qrels: DataFrame, k: int | None) -> DataFrame:
    """``query_id, recall``: the share of a query's relevant items among its first ``k`` (all without ``k``).

    ``predictions`` has ``query_id, item_id, rank``; queries without predictions count 0, those without relevant items do
    not count.
    """
    shown = predictions if k is None else predictions.where(F.col("rank") <= k)
    hits = qrels.select("query_id", "item_id").distinct().join(shown.select("query_id", "item_id", F.lit(1).alias("_hit")).distinct(), ["query_id", "item_id"], "left")
    return hits.groupBy("query_id").agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("recall"))


def recall_at_k(predictions: DataFrame, qrels: DataFrame, k: int | None) -> DataFrame:
    """One row ``recall``; 0 without queries."""
    return per_query_recall(predictions, qrels, k).agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))


def stratified_recall(per_query: DataFrame, strata: DataFrame) -> DataFrame:
    """``stratum, recall, n``; queries of no stratum are ``unknown``."""
    joined = per_query.join(strata.select("query_id", "stratum"), "query_id", "left")
    return joined.groupBy(F.coalesce("stratum", F.lit("unknown")).alias("stratum")).agg(F.avg("recall").alias("recall"), F.count("*").alias("n"))


def label_candidates(pairs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for relevant pairs."""
    marked = qrels.select("query_id", "item_id").distinct().withColumn("_r", F.lit(1))
    return pairs.join(marked, ["query_id", "item_id"], "left").withColumn("label", F.coalesce("_r", F.lit(0))).drop("_r")
