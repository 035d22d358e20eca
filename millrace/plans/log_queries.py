"""Queries over the click log: cleaning, splitting, statistics, candidates, mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import clean, logs, mining, split
from millrace.plans.registry import Tables, query
from millrace.plans.text_queries import QUERY, TITLE
from millrace.scratch import materialize

# ---- the click log: orders of customers, joined with their lines and parts ------------------------------------------------
#: Rows are ordered by row_id, a number that no two lines share.
_ROW = "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000"
_LOG = f"""lg AS (SELECT {QUERY.format("c_mktsegment || ' ' || o_orderpriority")} AS norm, l_partkey AS item_id, {TITLE.format("p_name")} AS title_norm, p_name || ' ' || p_type AS tower,
    CASE WHEN p_brand = 'Brand#7' THEN NULL ELSE p_brand END AS microcat, {_ROW} AS row_id, c_nationkey AS loc
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def click_log(t: Tables) -> DataFrame:
    joined = (
        t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    )
    return joined.select(
        text.normalize_query(F.concat_ws(" ", "c_mktsegment", "o_orderpriority")).alias("search_query_norm"), F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("search_query"),
        F.col("l_partkey").alias("item_id"), text.normalize_title("p_name").alias("item_title_norm"), F.col("p_name").alias("item_title_raw"), F.concat(F.lit("Услуга "), "p_type").alias("item_infm_params_text"),
        F.when(F.col("p_brand") != "Brand#7", F.col("p_brand")).alias("item_microcat_id"), F.expr(_ROW).alias("row_id"), F.col("c_nationkey").cast("bigint").alias("location"),
    )


_CLEAN = f"""WITH {_LOG},
c1 AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY norm, item_id ORDER BY row_id) AS rn FROM lg) WHERE rn = 1),
c2 AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY norm, tower ORDER BY row_id) AS rn FROM c1) WHERE rn = 1),
c3 AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY md5('42|' || norm || '|' || row_id), row_id) AS rn FROM c2) WHERE rn <= 16)"""


@query(
    "dedup_pairs_then_tower",
    _CLEAN
    + """ SELECT '0_start' AS step, count(*) AS n_rows FROM lg UNION ALL SELECT '1_pair_dedup', count(*) FROM c1 UNION ALL SELECT '2_tower_dedup', count(*) FROM c2
        UNION ALL SELECT '3_cap', count(*) FROM c3 UNION ALL SELECT 'n_queries_preserved', count(DISTINCT norm) FROM c3""",
)
def dedup_pairs_then_tower(t: Tables) -> DataFrame:
    return clean.cleaning_stats(clean.clean_steps(click_log(t)))


@query("cap_per_query", _CLEAN + " SELECT norm AS search_query_norm, item_id, row_id FROM c3")
def cap_per_query(t: Tables) -> DataFrame:
    return clean.clean_train(click_log(t)).select("search_query_norm", "item_id", "row_id")


@query(
    "log_counts",
    f"""WITH {_LOG}, a AS (SELECT norm, item_id, count(*) AS n FROM lg GROUP BY ALL), b AS (SELECT norm, title_norm, count(*) AS n FROM lg GROUP BY ALL),
        p AS (SELECT DISTINCT norm, i.item_id, i.title_norm FROM lg JOIN (SELECT p_partkey AS item_id, {TITLE.format("p_name")} AS title_norm FROM part) i ON lg.title_norm = i.title_norm)
        SELECT p.norm AS search_query_norm, p.item_id, coalesce(a.n, 0) AS log_qitem_count, coalesce(b.n, 0) AS log_bridge_count
        FROM p LEFT JOIN a ON a.norm = p.norm AND a.item_id = p.item_id LEFT JOIN b ON b.norm = p.norm AND b.title_norm = p.title_norm""",
)
def log_counts(t: Tables) -> DataFrame:
    log = click_log(t)
    items = t.part.select(F.col("p_partkey").alias("item_id"), text.normalize_title("p_name").alias("item_title_norm"))
    pairs = log.select("search_query_norm", "item_title_norm").distinct().join(items, "item_title_norm")
    return logs.log_counts(pairs, logs.query_logs(log)).select("search_query_norm", "item_id", "log_qitem_count", "log_bridge_count")


_TOK = "tk AS (SELECT token, microcat, sum(n) AS n FROM (SELECT norm, microcat, count(*) AS n, unnest(list_distinct(string_split(norm, ' '))) AS token FROM lg GROUP BY norm, microcat) GROUP BY ALL)"


@query("token_microcat", f"WITH {_LOG}, {_TOK} SELECT token, microcat AS item_microcat_id, CAST(n AS BIGINT) AS n_clicks FROM tk")
def token_microcat(t: Tables) -> DataFrame:
    return logs.query_logs(click_log(t)).tokens


_ASKED_TEXTS = f"""asked AS (SELECT DISTINCT norm FROM lg UNION SELECT DISTINCT {QUERY.format("c_mktsegment || ' low ' || c_mktsegment")} FROM customer UNION SELECT 'nothing known')"""


def asked_texts(t: Tables) -> DataFrame:
    """Texts of the log, texts that only share tokens with it, and one that shares none."""
    own = click_log(t).select("search_query_norm")
    partly = t.customer.select(text.normalize_query(F.concat_ws(" ", "c_mktsegment", F.lit("low"), "c_mktsegment")).alias("search_query_norm"))
    return own.unionByName(partly).unionByName(t.spark.createDataFrame([("nothing known",)], "search_query_norm string")).distinct()


@query(
    "p_microcat_backoff",
    f"""WITH {_LOG}, {_TOK}, {_ASKED_TEXTS},
        tot AS (SELECT norm, count(*) AS total FROM lg GROUP BY ALL), mc AS (SELECT norm, microcat, count(*) AS n FROM lg GROUP BY ALL), tt AS (SELECT token, sum(n) AS total FROM tk GROUP BY ALL),
        pr AS (SELECT norm, microcat FROM (SELECT norm, unnest(string_split(norm, ' ')) AS token FROM asked) JOIN tk USING (token) UNION SELECT norm, 'none' FROM asked),
        direct AS (SELECT pr.norm, pr.microcat, coalesce(mc.n, 0) / CAST(total AS DOUBLE) AS p FROM pr JOIN tot USING (norm) LEFT JOIN mc ON mc.norm = pr.norm AND mc.microcat = pr.microcat),
        w AS (SELECT norm, microcat, unnest(string_split(norm, ' ')) AS token FROM pr WHERE norm NOT IN (SELECT norm FROM tot)),
        back AS (SELECT w.norm, w.microcat, avg(coalesce(tk.n, 0) / CAST(tt.total AS DOUBLE)) AS p FROM w JOIN tt USING (token) LEFT JOIN tk ON tk.token = w.token AND tk.microcat = w.microcat GROUP BY ALL),
        k AS (SELECT * FROM direct UNION ALL SELECT * FROM back)
        SELECT pr.norm AS search_query_norm, pr.microcat AS item_microcat_id, round(coalesce(k.p, 0), 6) AS p_microcat FROM pr LEFT JOIN k ON k.norm = pr.norm AND k.microcat IS NOT DISTINCT FROM pr.microcat""",
)
def p_microcat_backoff(t: Tables) -> DataFrame:
    known = logs.query_logs(click_log(t))
    texts = asked_texts(t)
    # candidates: the microcats (null ones too) that were clicked for one of the text's tokens, and one that is in no log
    words = texts.select("search_query_norm", F.explode(text.split_words("search_query_norm")).alias("token"))
    pairs = words.join(known.tokens, "token").select("search_query_norm", "item_microcat_id").distinct()
    pairs = pairs.unionByName(texts.select("search_query_norm", F.lit("none").alias("item_microcat_id")))
    out = logs.p_microcat(pairs, known)
    return out.select("search_query_norm", "item_microcat_id", F.round("p_microcat", 6).alias("p_microcat"))


@query(
    "log_candidates",
    f"""WITH {_LOG}, qs AS (SELECT norm, min(loc) AS loc, substr(md5(norm), 1, 16) AS query_id FROM lg GROUP BY norm),
        i AS (SELECT p_partkey AS item_id, {TITLE.format("p_name")} AS title_norm, p_partkey % 25 AS loc FROM part),
        a AS (SELECT norm, item_id, min(row_id) AS f FROM lg GROUP BY ALL), b AS (SELECT norm, title_norm, count(*) AS n, min(row_id) AS f FROM lg GROUP BY ALL),
        x AS (SELECT query_id, i.item_id, b.n, b.f, row_number() OVER (PARTITION BY query_id, i.title_norm ORDER BY CAST(i.loc <> qs.loc AS INT), i.item_id) AS rn FROM qs JOIN b USING (norm) JOIN i USING (title_norm)),
        o AS (SELECT query_id, item_id, 0 AS s, f AS k1, 0 AS k2, 0 AS k3 FROM qs JOIN a USING (norm) UNION ALL SELECT query_id, item_id, 1, -n, f, rn FROM x WHERE rn <= 20),
        m AS (SELECT query_id, item_id, min((s, k1, k2, k3)) AS k FROM o GROUP BY ALL)
        SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY k, item_id) AS rank FROM m) WHERE rank <= 150""",
)
def log_candidates(t: Tables) -> DataFrame:
    log = materialize(click_log(t).select("search_query_norm", "item_id", "item_title_norm", "item_microcat_id", "row_id", "location"), "log")
    texts = log.groupBy("search_query_norm").agg(F.min("location").alias("location"))
    queries = texts.withColumn("query_id", F.substring(F.md5("search_query_norm"), 1, 16))
    items = t.part.select(F.col("p_partkey").alias("item_id"), text.normalize_title("p_name").alias("item_title_norm"), (F.col("p_partkey") % 25).alias("location"), F.col("p_partkey").alias("pos"))
    found = logs.log_candidates(queries, items, logs.query_logs(log))
    return found.select("query_id", "item_id", F.col("rank").cast("bigint").alias("rank"))


# ---- hold-outs: the same join, other columns, so that there are many texts -------------------------------------------------
_SPLIT = """sl AS (SELECT CASE WHEN l_orderkey % 40 = 0 THEN 'single ' || l_orderkey ELSE p_brand || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) END AS norm, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS loc,
    l_orderkey AS item_id FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
tu AS (SELECT norm, loc FROM sl GROUP BY ALL), tx AS (SELECT norm, count(*) AS n FROM tu GROUP BY ALL),
se AS (SELECT norm, 'seen' AS stratum FROM (SELECT norm FROM tx WHERE n >= 2 ORDER BY md5('7|' || norm), norm LIMIT 15)),
nw AS (SELECT norm, 'new' AS stratum FROM (SELECT norm FROM tx WHERE norm NOT IN (SELECT norm FROM se) ORDER BY md5('7|' || norm), norm LIMIT 25)),
ch AS (SELECT * FROM se UNION ALL SELECT * FROM nw),
on1 AS (SELECT norm, loc, stratum FROM (SELECT tu.norm, tu.loc, ch.stratum, row_number() OVER (PARTITION BY tu.norm ORDER BY md5(concat_ws('|', '7', tu.norm, CAST(tu.loc AS VARCHAR))), tu.loc NULLS FIRST) AS rn FROM tu JOIN ch USING (norm)) WHERE rn = 1),
qy AS (SELECT 'val' || lpad(CAST(row_number() OVER (ORDER BY norm) - 1 AS VARCHAR), 13, '0') AS query_id, norm, loc, stratum FROM on1),
qr AS (SELECT DISTINCT query_id, item_id FROM sl JOIN qy ON sl.norm = qy.norm AND sl.loc IS NOT DISTINCT FROM qy.loc),
rm AS (SELECT * FROM sl WHERE norm NOT IN (SELECT norm FROM qy WHERE stratum = 'new') AND item_id NOT IN (SELECT item_id FROM qr)
       AND NOT EXISTS (SELECT 1 FROM qy WHERE qy.norm = sl.norm AND qy.loc IS NOT DISTINCT FROM sl.loc))"""


def split_log(t: Tables) -> DataFrame:
    joined = (
        t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    )
    single = F.concat_ws(" ", F.lit("single"), F.col("l_orderkey").cast("string"))
    name = F.when(F.col("l_orderkey") % 40 == 0, single).otherwise(F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")))
    return joined.select(name.alias("search_query_norm"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("search_location_id"), F.col("l_orderkey").alias("item_id"))


def held(t: Tables) -> split.HeldOut:
    return split.hold_out(split_log(t), 40, 0.385, 7, "val", ["search_location_id"])


@query("holdout_queries", f"WITH {_SPLIT} SELECT query_id, norm AS search_query_norm, loc AS search_location_id, stratum FROM qy")
def holdout_queries(t: Tables) -> DataFrame:
    return held(t).queries


#: The second hold-out: from what the first has left, with texts that it has not chosen.
_SECOND = """tu2 AS (SELECT norm, loc FROM rm WHERE norm NOT IN (SELECT norm FROM qy) GROUP BY ALL), tx2 AS (SELECT norm, count(*) AS n FROM tu2 GROUP BY ALL),
se2 AS (SELECT norm, 'seen' AS stratum FROM (SELECT norm FROM tx2 WHERE n >= 2 ORDER BY md5('8|' || norm), norm LIMIT 8)),
nw2 AS (SELECT norm, 'new' AS stratum FROM (SELECT norm FROM tx2 WHERE norm NOT IN (SELECT norm FROM se2) ORDER BY md5('8|' || norm), norm LIMIT 12)),
ch2 AS (SELECT * FROM se2 UNION ALL SELECT * FROM nw2),
on2 AS (SELECT norm, loc, stratum FROM (SELECT tu2.norm, tu2.loc, ch2.stratum, row_number() OVER (PARTITION BY tu2.norm ORDER BY md5(concat_ws('|', '8', tu2.norm, CAST(tu2.loc AS VARCHAR))), tu2.loc NULLS FIRST) AS rn FROM tu2 JOIN ch2 USING (norm)) WHERE rn = 1)"""


@query(
    "holdout_second",
    f"WITH {_SPLIT}, {_SECOND} SELECT 'r' || lpad(CAST(row_number() OVER (ORDER BY norm) - 1 AS VARCHAR), 15, '0') AS query_id, norm AS search_query_norm, loc AS search_location_id, stratum FROM on2",
)
def holdout_second(t: Tables) -> DataFrame:
    return split.make_splits(split_log(t), 40, 20, 0.385, 7, ["search_location_id"])[1].queries


@query("holdout_qrels", f"WITH {_SPLIT} SELECT query_id, item_id FROM qr")
def holdout_qrels(t: Tables) -> DataFrame:
    return held(t).qrels


@query("holdout_train_part", f"WITH {_SPLIT} SELECT norm AS search_query_norm, loc AS search_location_id, item_id, count(*) AS n FROM rm GROUP BY ALL")
def holdout_train_part(t: Tables) -> DataFrame:
    return held(t).remaining.groupBy("search_query_norm", "search_location_id", "item_id").agg(F.count("*").alias("n"))


@query("cold_start_ratio", f"WITH {_SPLIT} SELECT round(avg(CAST(o_orderkey NOT IN (SELECT item_id FROM rm) AS INT)), 6) AS cold_start_ratio FROM orders")
def cold_start_ratio(t: Tables) -> DataFrame:
    corpus = t.orders.select(F.col("o_orderkey").alias("item_id"))
    return split.cold_start_ratio(corpus, held(t).remaining).select(F.round("cold_start_ratio", 6).alias("cold_start_ratio"))


# ---- relational building blocks --------------------------------------------------------------------------------------------


@query(
    "union_dedup_corpus",
    """SELECT nation, arg_min(name, (src, id)) AS name, min((src, id))[1] AS src FROM (SELECT c_nationkey % 17 AS nation, c_name AS name, 0 AS src, c_custkey AS id FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT s_nationkey, s_name, 1, s_suppkey FROM supplier) GROUP BY nation""",
)
def union_dedup_corpus(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal < 0").select((F.col("c_nationkey") % 17).alias("nation"), F.col("c_name").alias("name"), F.lit(0).alias("src"), F.col("c_custkey").alias("id"))
    b = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.lit(1).alias("src"), F.col("s_suppkey").alias("id"))
    return clean.union_keep_first([a, b], "nation", "id").select("nation", "name", "src")


@query(
    "semi_anti_joins",
    """SELECT (SELECT count(*) FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS semi,
              (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS anti,
              (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE nullif(s_nationkey, 3) IS NOT DISTINCT FROM nullif(c_nationkey, 3))) AS null_safe_anti""",
)
def semi_anti_joins(t: Tables) -> DataFrame:
    o, line = t.orders, t.lineitem
    semi = o.join(line.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.count("*").alias("semi"))
    anti = o.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("anti"))
    c = t.customer.select(F.nullif("c_nationkey", F.lit(3)).alias("n"))
    s = t.supplier.select(F.nullif("s_nationkey", F.lit(3)).alias("m")).distinct()
    safe = c.join(s, F.col("n").eqNullSafe(F.col("m")), "left_anti").agg(F.count("*").alias("null_safe_anti"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(semi).join(one(anti), "k").join(one(safe), "k").drop("k")


# ---- mining ----------------------------------------------------------------------------------------------------------------

_MINE_ITEMS = "mi AS (SELECT p_partkey AS item_id, string_split(lower(p_name), ' ') AS title, [lower(p_type)] AS params, string_split(lower(p_brand || ' ' || p_type), ' ') AS descr, p_name || ' Услуга ' || p_type AS tower FROM part)"
_MINE = f"""{_LOG}, {_MINE_ITEMS},
f AS (SELECT item_id, 'title' AS field, title AS toks FROM mi UNION ALL SELECT item_id, 'params', params FROM mi UNION ALL SELECT item_id, 'desc', descr FROM mi),
st AS (SELECT field, count(*) AS n, avg(len(toks)) AS mean FROM f GROUP BY ALL), tf AS (SELECT field, item_id, len(toks) AS len, unnest(toks) AS term FROM f),
tc AS (SELECT field, item_id, len, term, count(*) AS tf FROM tf GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tc GROUP BY ALL),
po AS (SELECT field, term, item_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS w FROM tc JOIN df USING (field, term) JOIN st USING (field)),
qt AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS norm FROM part), qe AS (SELECT norm, unnest(list_distinct(string_split(norm, ' '))) AS term FROM qt),
sc AS (SELECT norm, item_id, coalesce(sum(w) FILTER (field = 'title'), 0) + 0.5 * coalesce(sum(w) FILTER (field = 'params'), 0) + coalesce(sum(w) FILTER (field = 'desc'), 0) AS score FROM qe JOIN po USING (term) GROUP BY ALL),
rk AS (SELECT * FROM (SELECT norm, item_id, score, row_number() OVER (PARTITION BY norm ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 200)"""


def mining_items(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("item_id"), F.split(F.lower("p_name"), " ").alias("title"), F.array(F.lower("p_type")).alias("params"), F.split(F.lower(F.concat_ws(" ", "p_brand", "p_type")), " ").alias("desc"),
        text.item_tower_text("p_name", F.concat(F.lit("Услуга "), "p_type")).alias("item_tower_text"),
    )


def mined_ranking(t: Tables) -> DataFrame:
    texts = t.part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query_id")).distinct().withColumn("tokens", F.split("query_id", " "))
    return mining.lexical_rankings(texts, mining_items(t), 200)


@query("bm25_mining", f"WITH {_MINE} SELECT norm AS query_id, item_id, round(score, 5) AS score, rank FROM rk")
def bm25_mining(t: Tables) -> DataFrame:
    return mined_ranking(t).select("query_id", "item_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "hard_negatives",
    f"""WITH {_MINE}, ps AS (SELECT p_name || ' ' || lower(p_type) AS norm, p_partkey AS item_id FROM part),
        wn AS (SELECT norm, item_id AS neg, rank FROM rk WHERE rank - 1 >= 10 AND rank - 1 < 200 AND (norm, item_id) NOT IN (SELECT norm, item_id FROM ps)),
        kp AS (SELECT pr.norm, pr.item_id, neg, rank FROM (SELECT DISTINCT norm, item_id FROM ps) pr JOIN wn USING (norm) JOIN mi a ON a.item_id = pr.item_id JOIN mi b ON b.item_id = neg WHERE a.tower <> b.tower),
        nb AS (SELECT *, row_number() OVER (PARTITION BY norm, item_id ORDER BY rank, neg) AS rn, count(*) OVER (PARTITION BY norm, item_id) AS n FROM kp),
        sg AS (SELECT *, CASE WHEN n <= 2 THEN rn - 1 ELSE (rn * 2 + n - 1) // n - 1 END AS stratum FROM nb)
        SELECT norm AS search_query_norm, item_id, neg AS negative_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY norm, item_id, stratum ORDER BY md5('42|' || norm || '|' || item_id || '|' || neg), neg) AS pick FROM sg) WHERE pick = 1""",
)
def hard_negatives(t: Tables) -> DataFrame:
    positives = t.part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("search_query_norm"), F.col("p_partkey").alias("item_id"))
    ranking = mined_ranking(t).withColumnRenamed("query_id", "search_query_norm")
    return mining.mine_negatives(positives, ranking, mining_items(t), positives, 2, 10, 200, 42)


