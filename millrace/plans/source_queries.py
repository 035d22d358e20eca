"""Queries over what is written and read back: cached tables, stores, resumable parts, JSON lines, answer files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import vector
from millrace.operators.fusion import rank_by
from millrace.plans.context import centroids_without
from millrace.plans.registry import Tables, query
from millrace.plans.rank_queries import _ANSWERS, answers
from millrace.plans.retrieval_queries import _BM25, _GEO, _ROUNDED, _SPARSE, bm25_tours, geo_history, geo_items, sparse_sides, weights
from millrace.scratch import scratch_path
from millrace.sources import answer, tables


def _path(t: Tables, label: str) -> str:
    return scratch_path(t.spark, label)


@query("cached_table", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def cached_table(t: Tables) -> DataFrame:
    """A table that is built once under the fingerprint of its input; the second call reads what the first has written."""
    source = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    path, key = _path(t, "cached"), tables.fingerprint(t.customer, ["c_custkey", "c_nationkey"])
    tables.cached(t.spark, path, lambda: source.groupBy("n_name").agg(F.count("*").alias("n")), key)
    return tables.cached(t.spark, path, lambda: source.limit(0).groupBy("n_name").agg(F.count("*").alias("n")), key)


@query("saved_tables", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def saved_tables(t: Tables) -> DataFrame:
    folder = _path(t, "saved")
    tables.save_tables({"nation": t.nation, "region": t.region}, folder)
    loaded = tables.load_tables(t.spark, folder, ["nation", "region"])
    return loaded["nation"].join(loaded["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("vector_store", "SELECT vec_id AS item_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding) AS size FROM embeddings WHERE vec_id % 3 <> 1")
def vector_store(t: Tables) -> DataFrame:
    """A store of two appended parts, one of them appended twice, finished, and read for a third of its items less."""
    encoded = F.struct(F.col("embedding").alias("dense"), F.create_map(F.lit(1), F.lit(1.0)).alias("sparse"), F.array("embedding").alias("tokens"))
    items = t.embeddings.select(F.col("vec_id").alias("item_id"), encoded.alias("encoded"))
    writer = tables.StoreWriter(t.spark, _path(t, "store"))
    for part in ("0", "1", "1"):
        writer.append(items.where(F.col("item_id") % 2 == int(part)), part)
    writer.finalize()
    store = tables.open_store(t.spark, writer.path, items.where("item_id % 3 <> 1").select("item_id"))
    return store.select("item_id", F.round(F.element_at("dense", 1).cast("double"), 6).alias("first"), F.size("dense").cast("bigint").alias("size"))


@query("resumable_parts", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def resumable_parts(t: Tables) -> DataFrame:
    """A long run by parts of its keys; the second start finds them all done."""
    path, keys = _path(t, "parts"), t.customer.select("c_mktsegment").distinct()
    build = lambda df: t.customer.join(df, "c_mktsegment").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    for _ in range(2):
        tables.write_parts(t.spark, path, keys, "c_mktsegment", build, 3, "v1")
    return tables.load_parts(t.spark, path, 3, "v1")


@query(
    "training_lines",
    """WITH n AS (SELECT s_nationkey, list(s_name ORDER BY s_suppkey) AS negs FROM supplier GROUP BY ALL HAVING count(*) >= 1)
       SELECT c_name AS query, c_mktsegment AS pos, negs[1] AS neg FROM customer JOIN n ON c_nationkey = s_nationkey""",
)
def training_lines(t: Tables) -> DataFrame:
    pairs = t.customer.select(F.col("c_name").alias("search_query_norm"), F.col("c_custkey").alias("item_id"), F.col("c_name").alias("query"), F.col("c_mktsegment").alias("pos"), "c_nationkey")
    # a line has one negative, so of a nation's suppliers the first is gathered and not all of them
    first = rank_by(t.supplier.select("s_nationkey", "s_suppkey", "s_name"), [F.col("s_suppkey")], 1, "s_nationkey")
    lists = first.select("s_nationkey", F.array("s_name").alias("negatives"))
    negatives = pairs.join(lists, F.col("c_nationkey") == F.col("s_nationkey")).select("search_query_norm", "item_id", "negatives")
    path = _path(t, "lines")
    tables.write_training_jsonl(pairs, negatives, path, 1)
    lines = t.spark.read.schema("query string, pos array<string>, neg array<string>").json(path)
    return lines.select("query", F.element_at("pos", 1).alias("pos"), F.element_at("neg", 1).alias("neg"))


@query("answer_file", f"WITH {_ANSWERS.replace('CAST(value * 100 AS BIGINT)', 'CAST(CAST(value * 100 AS DECIMAL(20,0)) AS VARCHAR)')} SELECT CAST(user_id AS VARCHAR) AS query_id, answer FROM an")
def answer_file(t: Tables) -> DataFrame:
    path = _path(t, "answer")
    answer.write_answer(answers(t), path)
    return answer.read_answer(t.spark, path).select("query_id", F.array_join("items", " ").alias("answer"))


@query("validate_answer_file", f"WITH {_ANSWERS} SELECT 'unexpected_query' AS rule, CAST(user_id AS VARCHAR) AS detail FROM an WHERE user_id % 5 = 0 UNION ALL SELECT 'row_count', CAST(count(*) AS VARCHAR) || ' <> ' || CAST(count(*) FILTER (user_id % 5 <> 0) AS VARCHAR) FROM an")
def validate_answer_file(t: Tables) -> DataFrame:
    path, rows = _path(t, "answer"), answers(t)
    answer.write_answer(rows, path)
    items = answer.read_answer(t.spark, path).select(F.explode("items").alias("item_id")).distinct()
    wanted = t.events.select(F.col("user_id").cast("string").alias("query_id")).distinct().where("query_id % 5 <> 0")
    return answer.validate_file(t.spark, path, wanted, items, 5)


_KEPT = _GEO.replace("FROM customer),", "FROM customer WHERE c_custkey % 3 <> 0),").replace("FROM orders JOIN customer ON o_custkey = c_custkey)", "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0)")


@query(
    "centroids_without_positives",
    f"WITH {_KEPT}, b AS (SELECT coalesce(ic.location_id, hc.location_id) AS location_id, coalesce(ic.lat, hc.lat) AS lat, coalesce(ic.lon, hc.lon) AS lon FROM ic FULL JOIN hc ON ic.location_id = hc.location_id) {_ROUNDED} FROM b",
)
def centroids_without_positives(t: Tables) -> DataFrame:
    """Centroids of items and clicks, without the items that are held out."""
    held = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("item_id"))
    out = centroids_without(geo_history(t), geo_items(t), held)
    return out.select(F.col("location_id").cast("bigint").alias("location_id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(
    "pair_sparse",
    f"WITH {_BM25}, {_SPARSE} SELECT loc.query_id, loc.item_id, coalesce(ss.score, 0) AS sparse_score FROM loc LEFT JOIN ss ON ss.query_id = loc.query_id AND ss.item_id = loc.item_id",
)
def pair_sparse(t: Tables) -> DataFrame:
    q, d = sparse_sides(t)
    pairs = bm25_tours(t)[0].select("query_id", "item_id")
    # only documents of the pairs are counted
    held = weights(d.join(pairs.select("item_id").distinct(), "item_id", "left_semi"), "item_id", "terms")
    return vector.pair_sparse(pairs, q, held).select("query_id", "item_id", "sparse_score")
