"""Connected components of a graph in tables: least labels spread along edges, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``); the component is its least node.

    Each round takes the least label among neighbours, then the label of that label, so chains shorten by half; rounds
    end when no label changes.  Labels and edges stay in tables; nodes with very many links are summed up by partial
    aggregation, and joined by a side that adaptive execution can split.  Null ends are ignored.
    """
    known = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = materialize(known.select(F.col("a").alias("u"), F.col("b").alias("v")).union(known.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        hooked = materialize(
            labels.join(seen, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "hooked"
        )
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        labels = materialize(hooked.join(jump, "component", "left").select("node", "old", F.least("component", "beyond").alias("component")), "labels")
        if not labels.where(F.col("old") != F.col("component")).limit(1).count():
            return labels.select("node", "component")
