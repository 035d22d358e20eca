"""Queries over features, ranking, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text
from millrace.operators import evaluate, features, fusion
from millrace.plans.candidates import Encoded, candidate_features
from millrace.plans.config import Config
from millrace.plans.context import make_benchmark_stage
from millrace.plans.feature_oracle import feature_bank_sql
from millrace.plans.registry import Tables, query
from millrace.plans.retrieval_queries import _BM25, bm25_tours
from millrace.plans.text_queries import TITLE
from millrace.sources import answer

# ---- item groups -------------------------------------------------------------------------------------------------------------


@query(
    "dup_clusters",
    f"SELECT p_partkey, count(*) OVER (PARTITION BY {TITLE.format('p_name')}) AS dup_cluster_size, CAST(count(*) OVER (PARTITION BY {TITLE.format('p_name')}) = 1 AS INT) AS is_unique_title FROM part",
)
def dup_clusters(t: Tables) -> DataFrame:
    titled = t.part.select("p_partkey", text.normalize_title("p_name").alias("title"))
    sized = features.with_groups(titled, ["title"], dup_cluster_size=F.count("*"))
    return sized.select("p_partkey", "dup_cluster_size", (F.col("dup_cluster_size") == 1).cast("int").alias("is_unique_title"))


@query(
    "category_sizes",
    """SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS microcat_size, count(*) OVER (PARTITION BY nullif(p_size, 7)) AS item_loc_freq FROM part""",
)
def category_sizes(t: Tables) -> DataFrame:
    shaped = t.part.select("p_partkey", "p_brand", F.nullif("p_size", F.lit(7)).alias("size"))
    sized = features.with_groups(features.with_groups(shaped, ["p_brand"], microcat_size=F.count("*")), ["size"], item_loc_freq=F.count("*"))
    return sized.select("p_partkey", "microcat_size", "item_loc_freq")


@query(
    "price_zscore",
    """WITH x AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_retailprice > 905 THEN ln(1 + p_retailprice) END AS l FROM part),
       w AS (SELECT p_partkey, l, count(l) OVER g AS n, avg(l) OVER g AS m, stddev_pop(l) OVER g AS sd FROM x WINDOW g AS (PARTITION BY p_brand, p_size))
       SELECT p_partkey, round(CASE WHEN n >= 5 AND sd > 1e-12 THEN (l - m) / sd END, 5) AS z FROM w""",
)
def price_zscore(t: Tables) -> DataFrame:
    shaped = t.part.withColumn("price", F.when(F.col("p_retailprice") > 905, F.col("p_retailprice")))
    return features.price_zscore(shaped, "price", ["p_brand", "p_size"], "z").select("p_partkey", F.round("z", 5).alias("z"))


_WINDOWS = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 50 AS q, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS v, l_returnflag AS c FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY v DESC NULLS LAST) AS mn, dense_rank() OVER (PARTITION BY q ORDER BY v DESC NULLS LAST) AS dn, rank() OVER (PARTITION BY q ORDER BY v NULLS LAST) AS ar,
    count(*) OVER (PARTITION BY q, v) AS ties, rank() OVER (PARTITION BY q, c ORDER BY v NULLS LAST) AS cr, count(*) OVER (PARTITION BY q, c, v) AS cties, count(v) OVER (PARTITION BY q, c) AS cn,
    max(v) OVER (PARTITION BY q) AS mx, row_number() OVER (PARTITION BY q ORDER BY v DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fr FROM x)"""


@query(
    "rank_windows",
    f"""WITH {_WINDOWS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v IS NOT NULL THEN mn END AS min_rank, CASE WHEN v IS NOT NULL THEN dn END AS dense_rank,
        CASE WHEN v IS NOT NULL THEN ar + (ties - 1) / 2.0 END::DOUBLE AS avg_rank, round(CASE WHEN v IS NOT NULL THEN (cr + (cties - 1) / 2.0) / nullif(cn, 0) END::DOUBLE, 6) AS pct_rank,
        round(v / nullif(mx, 0), 6) AS over_max, round(v - mx, 6) AS minus_max, CASE WHEN v IS NOT NULL THEN fr END AS first_rank FROM r""",
)
def rank_windows(t: Tables) -> DataFrame:
    x = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 50).alias("q"), F.when(F.col("l_linenumber") != 5, F.col("l_quantity")).alias("v"), F.col("l_returnflag").alias("c")
    )
    # rows are sorted within one value of a key, values within a key
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    x = x.withColumn("within", F.row_number().over(Window.partitionBy("q", "v").orderBy(*keys)))
    x = features.value_ranks(features.value_ranks(x, "v", ["q"], "q_"), "v", ["q", "c"], "c_")
    known = lambda c: F.when(F.col("v").isNotNull(), c)
    return x.select(
        *keys, F.col("q_min").alias("min_rank"), F.col("q_dense").alias("dense_rank"), F.col("q_average").alias("avg_rank"), F.round(F.col("c_average") / F.col("c_known"), 6).alias("pct_rank"),
        F.round(F.col("v") / F.nullif(F.col("q_max"), F.lit(0.0)), 6).alias("over_max"), F.round(F.col("v") - F.col("q_max"), 6).alias("minus_max"),
        known(F.col("q_min") - 1 + F.col("within")).cast("bigint").alias("first_rank"),
    )


# ---- evaluation: the BM25 ranking of the benchmark texts against the documents that hold them ------------------------------
_QRELS = "qr AS (SELECT item_id AS query_id, doc_id AS item_id, source FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"
_RECALL = """pq AS (SELECT query_id, sum(CAST(h.item_id IS NOT NULL AS INT)) / CAST(count(*) AS DOUBLE) AS recall FROM (SELECT DISTINCT query_id, item_id FROM qr) r LEFT JOIN (SELECT DISTINCT query_id, item_id FROM {0}) h USING (query_id, item_id) GROUP BY query_id)"""


def qrels(t: Tables) -> DataFrame:
    """Documents that hold a benchmark text: an equi-join on its tokens 2 to 4, then the whole text.

    The inner tokens are whole in any match, the first and the last may be parts of the document's.  The benchmark goes to the
    documents: a triple that is met is compared with the text where it stands, so no text moves.  Texts of fewer than five
    tokens have no three inner ones and meet every document.
    """
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    size = F.size(F.split("needle", r"\s+"))
    inner = lambda k: F.get(F.split("needle", r"\s+"), F.lit(k))
    needles = asked.where(size >= 5).select("query_id", "needle", F.xxhash64(inner(1), inner(2), inner(3)).alias("k"))
    docs = t.documents.select("doc_id", "text")
    triples = F.transform("words", lambda w, n: F.xxhash64(w, F.get("words", n + 1), F.get("words", n + 2)))
    found = docs.withColumn("words", F.split("text", r"\s+")).select("doc_id", "text", F.explode(triples).alias("k")).join(F.broadcast(needles), "k").where(F.contains("text", F.col("needle")))
    short = docs.join(asked.where(size < 5), F.contains("text", F.col("needle")))
    return found.select("query_id", "doc_id").unionByName(short.select("query_id", "doc_id")).select("query_id", F.col("doc_id").alias("item_id")).distinct()


@query("recall_at_k", f"WITH {_BM25}, {_QRELS}, top AS (SELECT * FROM gl WHERE rank <= 10), {_RECALL.format('top')} SELECT round(coalesce(avg(recall), 0), 6) AS recall FROM pq")
def recall_at_k(t: Tables) -> DataFrame:
    return evaluate.recall_at_k(bm25_tours(t)[1], qrels(t), 10).select(F.round("recall", 6).alias("recall"))


@query("pool_ceiling", f"WITH {_BM25}, {_QRELS}, pool AS (SELECT query_id, item_id FROM gl UNION SELECT query_id, item_id FROM loc), {_RECALL.format('pool')} SELECT query_id, round(recall, 6) AS recall FROM pq")
def pool_ceiling(t: Tables) -> DataFrame:
    local, glob = bm25_tours(t)
    pool = local.select("query_id", "item_id", "rank").unionByName(glob.select("query_id", "item_id", "rank"))
    return evaluate.per_query_recall(pool, qrels(t), None).select("query_id", F.round("recall", 6).alias("recall"))


@query(
    "stratified_recall",
    f"""WITH {_BM25}, {_QRELS}, top AS (SELECT * FROM gl WHERE rank <= 10), {_RECALL.format("top")},
        st2 AS (SELECT item_id AS query_id, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 300 THEN 'long' END AS stratum FROM benchmark)
        SELECT coalesce(stratum, 'unknown') AS stratum, round(avg(recall), 6) AS recall, count(*) AS n FROM pq LEFT JOIN st2 USING (query_id) GROUP BY ALL""",
)
def stratified_recall(t: Tables) -> DataFrame:
    size = F.length("text")
    strata = t.benchmark.select(F.col("item_id").alias("query_id"), F.when(size < 200, "short").when(size < 300, "long").alias("stratum"))
    per = evaluate.per_query_recall(bm25_tours(t)[1], qrels(t), 10)
    return evaluate.stratified_recall(per, strata).select("stratum", F.round("recall", 6).alias("recall"), "n")


@query("label_candidates", f"WITH {_BM25}, {_QRELS} SELECT gl.query_id, gl.item_id, CAST(EXISTS (SELECT 1 FROM qr WHERE qr.query_id = gl.query_id AND qr.item_id = gl.item_id) AS INT) AS label FROM gl")
def label_candidates(t: Tables) -> DataFrame:
    return evaluate.label_candidates(bm25_tours(t)[1].select("query_id", "item_id"), qrels(t)).select("query_id", "item_id", "label")


# ---- answers ---------------------------------------------------------------------------------------------------------------

_HEX = "substr(md5('item ' || {0}), 1, 16)"
_ANSWERS = f"""ev AS (SELECT user_id, {_HEX.format("CAST(value * 100 AS BIGINT)")} AS item, min(event_id) AS rank FROM events WHERE event_type <> 'view' GROUP BY ALL),
rk AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY rank, item) AS rn FROM ev),
an AS (SELECT u.user_id, coalesce(string_agg(item, ' ' ORDER BY rn) FILTER (rn <= 5), '') AS answer FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN rk USING (user_id) GROUP BY u.user_id)"""


def answers(t: Tables, kind: str = "view") -> DataFrame:
    item = F.substring(F.md5(F.concat(F.lit("item "), (F.col("value") * 100).cast("decimal(20,0)").cast("string"))), 1, 16)
    ranked = t.events.where(F.col("event_type") != kind).select(F.col("user_id").alias("query_id"), item.alias("item_id"), F.col("event_id").alias("rank"))
    return answer.answer_rows(t.events.select(F.col("user_id").alias("query_id")).distinct(), ranked, 5)


@query("answer_rows", f"WITH {_ANSWERS.replace('CAST(value * 100 AS BIGINT)', 'CAST(CAST(value * 100 AS DECIMAL(20,0)) AS VARCHAR)')} SELECT user_id AS query_id, answer FROM an")
def answer_rows(t: Tables) -> DataFrame:
    return answers(t)


@query(
    "compare_answers",
    """WITH n AS (SELECT user_id, event_type, CAST(round(value) AS BIGINT) AS i FROM events), a AS (SELECT user_id, list(DISTINCT i) AS x FROM n WHERE event_type <> 'view' GROUP BY ALL), b AS (SELECT user_id, list(DISTINCT i) AS y FROM n WHERE event_type <> 'click' GROUP BY ALL),
       c AS (SELECT len(list_intersect(x, y)) AS s, len(list_distinct(list_concat(x, y))) AS u FROM a JOIN b USING (user_id))
       SELECT count(*) AS queries_compared, round(avg(s / CAST(greatest(u, 1) AS DOUBLE)), 6) AS mean_jaccard, round(avg(CAST(s = u AS INT)), 6) AS identical_sets FROM c""",
)
def compare_answers(t: Tables) -> DataFrame:
    sets = lambda kind: t.events.where(F.col("event_type") != kind).groupBy(F.col("user_id").alias("query_id")).agg(F.collect_set(F.round("value").cast("bigint")).alias("items"))
    out = answer.compare_answers(sets("view"), sets("click"))
    return out.select("queries_compared", F.round("mean_jaccard", 6).alias("mean_jaccard"), F.round("identical_sets", 6).alias("identical_sets"))


_GIVEN = """gv AS (SELECT user_id AS query_id, CASE user_id % 7 WHEN 0 THEN 'ABCD' WHEN 1 THEN i || ' ' || i WHEN 2 THEN i || ' ' || substr(md5('x' || user_id), 1, 16) WHEN 3 THEN '' ELSE i END AS answer, user_id
    FROM (SELECT DISTINCT user_id, substr(md5('item ' || (user_id % 50)), 1, 16) AS i FROM events) WHERE user_id % 11 <> 3
    UNION ALL SELECT DISTINCT user_id, '', user_id FROM events WHERE user_id % 13 = 2),
wt AS (SELECT DISTINCT user_id AS query_id FROM events WHERE user_id % 17 <> 5), cp AS (SELECT DISTINCT substr(md5('item ' || (user_id % 40)), 1, 16) AS item_id FROM events),
ls AS (SELECT query_id, [x for x in string_split(answer, ' ') if x <> ''] AS items FROM gv), ea AS (SELECT query_id, unnest(list_distinct(items)) AS item_id FROM ls)"""


@query(
    "validate_answer",
    f"""WITH {_GIVEN}
        SELECT 'duplicate_query' AS rule, CAST(query_id AS VARCHAR) AS detail FROM gv GROUP BY query_id HAVING count(*) > 1
        UNION ALL SELECT 'missing_query', CAST(query_id AS VARCHAR) FROM wt WHERE query_id NOT IN (SELECT query_id FROM gv)
        UNION ALL SELECT DISTINCT 'unexpected_query', CAST(query_id AS VARCHAR) FROM gv WHERE query_id NOT IN (SELECT query_id FROM wt)
        UNION ALL SELECT 'row_count', CAST(n AS VARCHAR) || ' <> ' || CAST(m AS VARCHAR) FROM (SELECT count(*) AS n FROM gv), (SELECT count(*) AS m FROM wt) WHERE n <> m
        UNION ALL SELECT 'too_long', CAST(query_id AS VARCHAR) FROM ls WHERE len(items) > 1
        UNION ALL SELECT 'repeated_item', CAST(query_id AS VARCHAR) FROM ls WHERE len(list_distinct(items)) < len(items)
        UNION ALL SELECT 'bad_item_id', query_id || ' ' || item_id FROM ea WHERE NOT regexp_full_match(item_id, '[0-9a-f]{{16}}')
        UNION ALL SELECT 'unknown_item', query_id || ' ' || item_id FROM ea WHERE regexp_full_match(item_id, '[0-9a-f]{{16}}') AND item_id NOT IN (SELECT item_id FROM cp)""",
)
def validate_answer(t: Tables) -> DataFrame:
    users = t.events.select("user_id").distinct()
    text_of = lambda c: c.cast("string")
    i = F.substring(F.md5(F.concat(F.lit("item "), text_of(F.col("user_id") % 50))), 1, 16)
    other = F.substring(F.md5(F.concat(F.lit("x"), text_of(F.col("user_id")))), 1, 16)
    r = F.col("user_id") % 7
    given = F.when(r == 0, F.lit("ABCD")).when(r == 1, F.concat_ws(" ", i, i)).when(r == 2, F.concat_ws(" ", i, other)).when(r == 3, F.lit("")).otherwise(i)
    rows = users.where("user_id % 11 <> 3").select(F.col("user_id").alias("query_id"), given.alias("answer"))
    rows = rows.unionByName(users.where("user_id % 13 = 2").select(F.col("user_id").alias("query_id"), F.lit("").alias("answer")))
    wanted = users.where("user_id % 17 <> 5").withColumnRenamed("user_id", "query_id")
    corpus = users.select(F.substring(F.md5(F.concat(F.lit("item "), text_of(F.col("user_id") % 40))), 1, 16).alias("item_id")).distinct()
    return answer.validate_rows(rows, wanted, corpus, 1)


@query(
    "select_top_k",
    """WITH s AS (SELECT user_id % 50 AS query_id, CAST(round(value) AS BIGINT) AS item_id, sum(CAST(round(value * 100) AS BIGINT)) AS score FROM events GROUP BY ALL),
       r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn FROM s)
       SELECT q.query_id, coalesce(string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY rn) FILTER (rn <= 10), '') AS items FROM (SELECT DISTINCT user_id % 60 AS query_id FROM events) q LEFT JOIN r USING (query_id) GROUP BY ALL""",
)
def select_top_k(t: Tables) -> DataFrame:
    scores = t.events.groupBy((F.col("user_id") % 50).alias("query_id"), F.round("value").cast("bigint").alias("item_id")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("score"))
    queries = t.events.select((F.col("user_id") % 60).alias("query_id")).distinct()
    best = fusion.select_top_k(queries, scores, 10)
    return best.select("query_id", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


# ---- the whole feature table -----------------------------------------------------------------------------------------------


def part_stage(t: Tables):
    """A stage in which parts are items, suppliers ask for the part of their number, and orders are the click history."""
    lat = lambda k: F.when(k % 29 != 3, F.lit(40.0) + (k % 97) * F.lit(0.1))
    lon = lambda k: F.lit(10.0) + (k % 89) * F.lit(0.1)
    key = F.col("p_partkey")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
    items = t.part.select(
        key.alias("item_id"), F.col("p_name").alias("item_title_raw"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("item_description_raw"),
        F.concat(F.lit("Вид услуги "), "p_type", F.lit(" Услуга "), "p_brand").alias("item_infm_params_text"), F.length("p_type").cast("bigint").alias("item_category_id"),
        F.when(brand != 7, brand).alias("item_microcat_id"), F.when(key % 50 != 0, key % 7).alias("item_location_id"), F.col("p_retailprice").alias("item_price"), lat(key).alias("item_latitude"), lon(key).alias("item_longitude"),
        (key % 6).cast("double").alias("item_rating"), F.when(key % 4 != 0, (key % 13).cast("double")).alias("item_rating_reviews_count"), (key % 3 == 0).alias("item_is_phone_hidden"), F.lit(False).alias("item_is_message_forbidden"),
    )
    queries = t.supplier.join(t.part, F.col("s_suppkey") == key).select(
        F.col("s_suppkey").alias("query_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("search_query"), (F.col("s_suppkey") % 9).alias("search_location_id"), F.length("p_type").cast("bigint").alias("search_category"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Услуга "), "p_brand")).alias("search_infm_params_text"),
    )
    own = items.select("item_id", "item_title_raw", "item_microcat_id", "item_latitude", "item_longitude", "item_location_id")
    log = t.lineitem.join(t.part, F.col("l_partkey") == key).select(
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("search_query"), F.col("l_partkey").alias("item_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_suppkey") % 1000).alias("row_id"),
        (F.col("l_suppkey") % 9).alias("search_location_id"),
    ).join(own, "item_id")
    return make_benchmark_stage(items, queries, log)


def part_encoded(t: Tables, stage) -> Encoded:
    """Stand-in encodings: the vector of number ``id`` modulo the number of vectors, and token counts of the texts."""
    vectors = t.embeddings.select(F.col("vec_id").alias("_k"), F.col("embedding").alias("vec"))
    n = t.embeddings.agg((F.max("vec_id") + 1).alias("n")).withColumn("_one", F.lit(1))

    def side(df: DataFrame, key: str, words: str) -> DataFrame:
        numbered = df.select(key, words).withColumn("_one", F.lit(1)).join(n, "_one").withColumn("_k", F.col(key) % F.col("n"))
        weights = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("k"), F.lit(1.0).cast("float").alias("v"))))
        return numbered.join(vectors, "_k").select(key, "vec", weights.alias("weights"), F.array("vec", F.reverse("vec")).alias("tokens"))

    return Encoded(side(stage.items, "item_id", "title"), side(stage.queries, "query_id", "tokens"))


@query("feature_bank_46", feature_bank_sql(Config()))
def feature_bank_46(t: Tables) -> DataFrame:
    stage = part_stage(t)
    frame = candidate_features(stage, part_encoded(t, stage), Config())
    return frame.select("query_id", "item_id", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in features.RANKER_FEATURES))

