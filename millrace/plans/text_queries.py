"""Queries over scans, ids, text functions and string similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.plans.registry import Tables, query
from millrace.plans.retrieval_queries import _BM25, bm25_tours
from millrace.sources import tables

_KEYS = "|".join(sorted(text.SPLIT_KEYS, key=lambda k: (-len(k), k)))
_LISTED = ", ".join(f"'{k}'" for k in text.WHITELIST)
TITLE = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^0-9a-zа-яё\s]', ' ', 'g'), '\s+', ' ', 'g'))"
QUERY = "array_to_string(list_sort(string_split(" + TITLE + ", ' ')), ' ')"
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[0-9a-zа-яё]+')"


@query(
    "scan_cast_project",
    """SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS DOUBLE) AS price, n_lines
       FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey""",
)
def scan_cast_project(t: Tables) -> DataFrame:
    raw = t.part.select(F.col("p_partkey").alias("item_id"), "p_name", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    lines = t.lineitem.groupBy(F.col("l_partkey").cast("string").alias("item_id")).agg(F.count("*").alias("n_lines"))
    return tables.standardize(raw).join(lines, "item_id", "left").select("item_id", "p_name", "price", "n_lines")


_IDS = "CASE doc_id % 10 WHEN 0 THEN upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) WHEN 1 THEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) WHEN 2 THEN NULL ELSE substr(md5(CAST(doc_id AS VARCHAR)), 1, 16) END"


@query(
    "id_check_counts",
    f"""WITH d AS (SELECT {_IDS} AS id FROM documents)
        SELECT (SELECT count(*) FROM d WHERE id IS NULL OR NOT regexp_full_match(id, '[0-9a-f]{{16}}')) AS bad_item_ids,
               (SELECT count(*) FROM d WHERE id IS NULL OR length(id) <> 16) AS bad_query_ids""",
)
def id_check_counts(t: Tables) -> DataFrame:
    ids = t.documents.select(F.expr(_IDS.replace("VARCHAR", "STRING")).alias("id"))
    flags = ids.select(
        (F.col("id").isNull() | ~F.col("id").rlike(tables.ITEM_ID)).cast("bigint").alias("a"), (F.col("id").isNull() | (F.char_length("id") != tables.QUERY_ID_LENGTH)).cast("bigint").alias("b")
    )
    return flags.agg(F.sum("a").cast("bigint").alias("bad_item_ids"), F.sum("b").cast("bigint").alias("bad_query_ids"))


@query("normalize_title", f"SELECT page_id, {TITLE.format('url')} AS title, md5({TITLE.format('html')}) AS html_md5 FROM pages")
def normalize_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.normalize_title("url").alias("title"), F.md5(text.normalize_title("html")).alias("html_md5"))


@query("normalize_query", f"SELECT doc_id, md5({QUERY.format('text')}) AS norm_md5, CAST(length({QUERY.format('text')}) AS BIGINT) AS n FROM documents")
def normalize_query(t: Tables) -> DataFrame:
    norm = text.normalize_query("text")
    return t.documents.select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).cast("bigint").alias("n"))


_PARAMS = """'начало ' || CASE WHEN p_size % 3 = 0 THEN 'Вид услуги ' || p_type || ', Услуга ' || p_name ELSE 'Услуга ' || p_brand END
    || ' Стоимость ' || CAST(p_size AS VARCHAR) || ' Услуга ' || p_brand || ' Своя услуга ' || CASE WHEN p_size % 2 = 0 THEN 'Начальная цена 5' ELSE p_name END
    || ' Место оказания услуг ' || p_type"""
_PAIRS = f"""p AS (SELECT p_partkey, p_name, {_PARAMS} AS x FROM part),
    kv AS (SELECT p_partkey, p_name, regexp_extract_all(x, '({_KEYS})') AS ks, regexp_split_to_array(x, '{_KEYS}')[2:] AS vs FROM p)"""


def _part_params(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", F.expr(_PARAMS.replace("VARCHAR", "STRING")).alias("x"))


@query(
    "parse_params",
    f"""WITH {_PAIRS}
        SELECT p_partkey, array_to_string([k || '=' || trim(v, ' ,') for k, v in list_zip(ks, vs)], ';') AS pairs FROM kv""".replace("for k, v in list_zip(ks, vs)", "for z in list_zip(ks, vs)")
    .replace("k || '=' || trim(v, ' ,')", "z[1] || '=' || trim(z[2], ' ,')"),
)
def parse_params(t: Tables) -> DataFrame:
    pairs = F.transform(text.parse_params("x"), lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    return _part_params(t).select("p_partkey", F.array_join(pairs, ";").alias("pairs"))


_FLAT = f"""WITH {_PAIRS},
    e AS (SELECT p_partkey, p_name, unnest(ks) AS k, unnest(vs) AS v, unnest(range(len(ks))) AS pos FROM kv),
    f AS (SELECT p_partkey, p_name, k || ' ' || trim(v, ' ,') AS kv, min(pos) AS pos FROM e WHERE k IN ({_LISTED}) AND trim(v, ' ,') <> '' GROUP BY ALL),
    w AS (SELECT p_partkey, string_agg(kv, ' ' ORDER BY pos) AS white FROM f GROUP BY p_partkey)"""


@query("extract_whitelisted", _FLAT + " SELECT kv.p_partkey, coalesce(white, '') AS white FROM kv LEFT JOIN w USING (p_partkey)")
def extract_whitelisted(t: Tables) -> DataFrame:
    return _part_params(t).select("p_partkey", text.extract_whitelisted("x").alias("white"))


@query("tower_text", _FLAT + " SELECT kv.p_partkey, trim(kv.p_name || ' ' || coalesce(white, '')) AS tower, trim(kv.p_name || ' ' || trim(p.x)) AS query_tower FROM kv JOIN p USING (p_partkey) LEFT JOIN w USING (p_partkey)")
def tower_text(t: Tables) -> DataFrame:
    return _part_params(t).select("p_partkey", text.item_tower_text("p_name", "x").alias("tower"), text.query_tower_text("p_name", "x").alias("query_tower"))


#: Pairs to score: the local BM25 ranking, the 50 best documents of the language that a benchmark text is asked in.
_DOCS = f"dd AS (SELECT doc_id, {TOKENS.format('text')} AS dt, {TOKENS.format('split_part(text, chr(10), 1)')} AS tt, split_part(text, chr(10), 1) AS title FROM documents)"
_ASKED = f"qq AS (SELECT item_id AS query_id, text, {TOKENS.format('text')} AS qt FROM benchmark)"
_CANDIDATES = "loc JOIN qq USING (query_id) JOIN dd ON doc_id = loc.item_id"


def _candidates(t: Tables, asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate pairs ``item_id`` (of the benchmark), ``doc_id`` with the columns of both sides."""
    pairs = bm25_tours(t)[0].select(F.col("query_id").alias("item_id"), F.col("item_id").alias("doc_id"))
    return pairs.join(asked, "item_id").join(docs, "doc_id")


@query(
    "token_coverage",
    f"""WITH {_BM25}, {_DOCS}, {_ASKED}
        SELECT query_id AS item_id, doc_id, round(len(list_intersect(list_distinct(qt), list_distinct(dt))) / CAST(greatest(len(list_distinct(qt)), 1) AS DOUBLE), 6) AS coverage FROM {_CANDIDATES}""",
)
def token_coverage(t: Tables) -> DataFrame:
    pairs = _candidates(t, _asked(t), t.documents.select("doc_id", F.array_distinct(text.tokens("text")).alias("dt")))
    return pairs.select("item_id", "doc_id", F.round(text.coverage(F.col("qt"), F.col("dt")), 6).alias("coverage"))


def _asked(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.tokens("text").alias("qt"), text.trigrams("text").alias("qg"))


@query(
    "title_prefix",
    f"""WITH {_BM25}, {_DOCS}, {_ASKED}, p AS (SELECT query_id, doc_id, qt, tt, least(len(qt), len(tt)) AS n FROM {_CANDIDATES})
        SELECT query_id AS item_id, doc_id, round(CASE WHEN n >= 1 THEN len([k for k in range(1, n + 1) if qt[1:k] = tt[1:k]]) / CAST(len(qt) AS DOUBLE) ELSE 0 END, 6) AS prefix FROM p""",
)
def title_prefix(t: Tables) -> DataFrame:
    pairs = _candidates(t, _asked(t), t.documents.select("doc_id", text.tokens(F.substring_index("text", "\n", 1)).alias("tt")))
    return pairs.select("item_id", "doc_id", F.round(text.prefix_match(F.col("qt"), F.col("tt")), 6).alias("prefix"))


_GRAMS = "list_distinct([substr(' ' || {0} || ' ', i, 3) for i in range(1, length({0}) + 1)])"


@query(
    "ngram_sim",
    f"""WITH {_BM25}, {_DOCS}, {_ASKED}, g AS (SELECT query_id, doc_id, {_GRAMS.format("qq.text")} AS qg, {_GRAMS.format("title")} AS dg FROM {_CANDIDATES})
        SELECT query_id AS item_id, doc_id, round(coalesce(len(list_intersect(qg, dg)) / nullif(CAST(len(list_distinct(list_concat(qg, dg))) AS DOUBLE), 0), 0), 6) AS sim FROM g""",
)
def ngram_sim(t: Tables) -> DataFrame:
    pairs = _candidates(t, _asked(t), t.documents.select("doc_id", text.trigrams(F.substring_index("text", "\n", 1)).alias("dg")))
    return pairs.select("item_id", "doc_id", F.round(text.set_jaccard(F.col("qg"), F.col("dg")), 6).alias("sim"))


@query(
    "param_overlap",
    f"""WITH {_PAIRS},
        q AS (SELECT s_suppkey, p_brand, p_size, 'Вид услуги ' || p_type || ' Услуга ' || p_brand AS y FROM supplier JOIN part ON p_partkey = s_suppkey),
        qk AS (SELECT s_suppkey, p_brand, p_size, regexp_extract_all(y, '({_KEYS})') AS qks, [trim(v, ' ,') for v in regexp_split_to_array(y, '{_KEYS}')[2:]] AS qvs FROM q)
        SELECT s_suppkey, kv.p_partkey, CAST(len([z for z in list_zip(qks, qvs) if contains(p.x, z[1] || ' ' || z[2])]) AS BIGINT) AS matched,
               round(len(list_intersect(qks, ks)) / CAST(len(list_distinct(list_concat(qks, ks))) AS DOUBLE), 6) AS keys
        FROM kv JOIN p USING (p_partkey) JOIN part USING (p_partkey) JOIN qk ON part.p_brand = qk.p_brand AND part.p_size = qk.p_size""",
)
def param_overlap(t: Tables) -> DataFrame:
    from millrace.operators.features import param_overlap as overlap

    items = _part_params(t).join(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey").select("p_partkey", "p_brand", "p_size", "x", text.parse_params("x").alias("i_pairs"))
    asked = t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey"))
    asked = asked.select("s_suppkey", "p_brand", "p_size", text.parse_params(F.concat(F.lit("Вид услуги "), "p_type", F.lit(" Услуга "), "p_brand")).alias("q_pairs"))
    matched, keys = overlap(F.col("q_pairs"), F.col("x"), F.col("i_pairs"), F.lit(True))
    return items.join(asked, ["p_brand", "p_size"]).select("s_suppkey", "p_partkey", matched.cast("bigint").alias("matched"), F.round(keys, 6).alias("keys"))
