"""The answer file: writing, reading, validation, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.scratch import materialize
from millrace.sources.tables import ITEM_ID

HEADER = "query_id,answer"


def answer_rows(queries: DataFrame, predictions: DataFrame, max_len: int = 50) -> DataFrame:
    """``query_id, answer``: a row for each query, its distinct items by rank joined by spaces, empty without any.

    ``predictions`` has ``query_id, item_id, rank``; of a repeated item the best rank stays.
    """
    best = predictions.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"].cast("string"))
    lists = best.groupBy("query_id").agg(F.array_join(F.slice(ordered, 1, max_len), " ").alias("answer"))
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


def write_answer(answer: DataFrame, path: str) -> None:
    """One CSV file in order of the ids, with a header; an empty answer is nothing, not quotes."""
    answer.orderBy("query_id").coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, items``; everything is text, an empty answer is an empty list."""
    rows = spark.read.schema("query_id string, answer string").option("header", True).csv(path)
    return rows.select("query_id", F.filter(F.split(F.coalesce("answer", F.lit("")), " "), lambda x: x != "").alias("items"))


def _problem(df: DataFrame, rule: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def validate_rows(answer: DataFrame, queries: DataFrame, corpus: DataFrame, max_len: int = 50) -> DataFrame:
    """``rule, detail`` for every violation among rows ``query_id, answer``.

    Rules: ``duplicate_query``, ``missing_query``, ``unexpected_query``, ``row_count``, ``too_long``, ``repeated_item``,
    ``bad_item_id``, ``unknown_item`` (only ids of the right form are sought in the corpus).  A null id is reported.
    """
    ids, wanted = answer.select("query_id"), queries.select("query_id").distinct()
    lists = answer.select("query_id", F.filter(F.split(F.coalesce("answer", F.lit("")), " "), lambda x: x != "").alias("items"))
    each = lists.select("query_id", F.explode(F.array_distinct("items")).alias("item_id"))
    good = F.col("item_id").rlike(ITEM_ID)
    unknown = each.where(good).join(corpus.select("item_id").distinct(), "item_id", "left_anti")
    counts = answer.agg(F.count("*").alias("n")).withColumn("k", F.lit(1)).join(wanted.agg(F.count("*").alias("m")).withColumn("k", F.lit(1)), "k")
    parts = [
        _problem(ids.groupBy("query_id").count().where("count > 1"), "duplicate_query", F.col("query_id")),
        _problem(wanted.join(ids, "query_id", "left_anti"), "missing_query", F.col("query_id")),
        _problem(ids.distinct().join(wanted, "query_id", "left_anti"), "unexpected_query", F.col("query_id")),
        _problem(counts.where("n <> m"), "row_count", F.concat_ws(" <> ", F.col("n").cast("string"), F.col("m").cast("string"))),
        _problem(lists.where(F.size("items") > max_len), "too_long", F.col("query_id")),
        _problem(lists.where(F.size(F.array_distinct("items")) < F.size("items")), "repeated_item", F.col("query_id")),
        _problem(each.where(~good), "bad_item_id", F.concat_ws(" ", F.col("query_id"), F.col("item_id"))),
        _problem(unknown, "unknown_item", F.concat_ws(" ", F.col("query_id"), F.col("item_id"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_file(spark: SparkSession, path: str, queries: DataFrame, corpus: DataFrame, max_len: int = 50) -> DataFrame:
    """:func:`validate_rows` of a CSV file, after its header and its rows' number of columns have been found right.

    The first line is the header; the same line again is a row (of an unexpected query).  Fields may be quoted, and what
    stands between quotes is not cut at its commas; a row of one field, or of three and more, is reported whole.
    """
    lines = spark.read.text(path)
    first = lines.select("value").first()
    if first is None or first["value"] != HEADER:
        return spark.createDataFrame([("header", "" if first is None else first["value"])], "rule string, detail string")
    options = {"header": "true", "enforceSchema": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_odd", "escape": '"'}
    rows = spark.read.schema("query_id string, answer string, _odd string").options(**options).csv(path)
    # Spark has no corrupt record without reading the others: a table of them also cuts the lineage to the file
    read = materialize(rows, "answer")
    odd = read.where(F.col("_odd").isNotNull())
    if odd.limit(1).count():
        return _problem(odd, "columns", F.col("_odd"))
    return validate_rows(read.select("query_id", F.coalesce("answer", F.lit("")).alias("answer")), queries, corpus, max_len)


def compare_answers(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``queries_compared, mean_jaccard, identical_sets`` over the queries of both; lists are ``query_id, items``.

    Two empty lists share nothing (Jaccard 0) but are identical.
    """
    both = a.select("query_id", F.array_distinct("items").alias("x")).join(b.select("query_id", F.array_distinct("items").alias("y")), "query_id")
    union = F.size(F.array_union("x", "y"))
    shared = F.size(F.array_intersect("x", "y"))
    scored = both.select((shared / F.greatest(union, F.lit(1))).alias("j"), (shared == union).cast("double").alias("same"))
    return scored.agg(
        F.count("*").alias("queries_compared"), F.coalesce(F.avg("j"), F.lit(0.0)).alias("mean_jaccard"), F.coalesce(F.avg("same"), F.lit(0.0)).alias("identical_sets")
    )
