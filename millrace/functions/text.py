"""Text normalisation, parameter parsing and string similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: attribute keys of the flat "Key Value Key Value" format ------------------------------------------------
SPLIT_KEYS = [
    "Тип стоимости за услугу", "Работаете с юрлицами и ип", "Как вы работаете",
    "Куда выезжаете", "Название услуги", "Место оказания услуг",
    "График работы от", "График работы до", "Рабочие дни", "Марка авто",
    "Продолжительность", "Начальная цена", "Опыт работы", "Производители",
    "Вид услуги", "Тип услуги", "Своя услуга", "Стоимость", "Время для",
    "Работа по договору", "Бригада", "Услуга", "График", "Время",
]
WHITELIST = ["Вид услуги", "Тип услуги", "Название услуги", "Своя услуга", "Услуга"]
EARTH_RADIUS_KM = 6371.0088

#: Tokens of lemmatised text: digits, Latin and Cyrillic letters, in either case as Python's re folds it.
TOKEN = "((?iu)[0-9a-zа-яё]+)"


def _text(column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def normalize_title(column) -> Column:
    """Lower case; all but digits, Latin and Cyrillic letters become spaces; spaces collapse; null is empty."""
    kept = F.regexp_replace(F.lower(_text(column)), r"[^0-9a-zа-яё\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_query(column) -> Column:
    """:func:`normalize_title` with the words in code-point order; repeated words stay."""
    return F.array_join(F.array_sort(F.split(normalize_title(column), " ")), " ")


def add_normalized_query(df: DataFrame, source: str = "search_query") -> DataFrame:
    return df.withColumn("search_query_norm", normalize_query(source))


def add_normalized_title(df: DataFrame, source: str = "item_title_raw") -> DataFrame:
    return df.withColumn("item_title_norm", normalize_title(source))


def key_pattern(keys: list[str]) -> str:
    """An alternation of the keys taken literally, the longest first."""
    ordered = sorted(dict.fromkeys(keys), key=lambda k: (-len(k), k))
    return "|".join("\\Q" + k + "\\E" for k in ordered)


def parse_params(column, keys: list[str] | None = None) -> Column:
    """``array<struct<k, v>>``: each key found, and the text up to the next one without outer spaces and commas."""
    text, pattern = _text(column), key_pattern(keys or SPLIT_KEYS)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.slice(F.split(text, pattern, -1), F.lit(2), F.greatest(F.size(found), F.lit(0)))
    stripped = F.transform(values, lambda v: F.btrim(v, F.lit(" ,")))
    return F.zip_with(found, stripped, lambda k, v: F.struct(k.alias("k"), v.alias("v")))


def extract_whitelisted(column, keys: list[str] | None = None, whitelist: list[str] | None = None) -> Column:
    """The distinct pairs of whitelisted keys with a value, as ``K V K V`` in order of appearance."""
    kept = F.filter(parse_params(column, keys), lambda p: p["k"].isin(whitelist or WHITELIST) & (p["v"] != ""))
    return F.array_join(F.transform(F.array_distinct(kept), lambda p: F.concat_ws(" ", p["k"], p["v"])), " ")


def item_tower_text(title, params) -> Column:
    """The title followed by the whitelisted parameters; the key by which equal offers are known."""
    return F.trim(F.concat_ws(" ", F.trim(_text(title)), F.nullif(extract_whitelisted(params), F.lit(""))))


def item_tower_from_filtered(title, filtered) -> Column:
    """:func:`item_tower_text` of parameters that are already filtered."""
    return F.trim(F.concat_ws(" ", F.trim(_text(title)), F.nullif(_text(filtered), F.lit(""))))


def query_tower_text(query, params) -> Column:
    """The query followed by its raw parameters."""
    return F.trim(F.concat_ws(" ", F.trim(_text(query)), F.nullif(F.trim(_text(params)), F.lit(""))))


def tokens(column) -> Column:
    """Lower-cased tokens of :data:`TOKEN`, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(_text(column)), F.lit(TOKEN), F.lit(1))


def split_words(column) -> Column:
    """White-space separated words; none for an empty text."""
    return F.filter(F.split(_text(column), r"\s+"), lambda w: w != "")


def trigrams(column) -> Column:
    """Distinct character trigrams of the text between two spaces; none for an empty text."""
    text = _text(column)
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda p: F.substr(padded, p, F.lit(3)))
    return F.when(F.length(text) >= 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def coverage(query_tokens: Column, item_tokens: Column) -> Column:
    """Share of the query's distinct tokens among the item's; 0 for a query without tokens."""
    return F.size(F.array_intersect(query_tokens, item_tokens)) / F.greatest(F.size(F.array_distinct(query_tokens)), F.lit(1))


def prefix_match(query_tokens: Column, title_tokens: Column) -> Column:
    """Length of the common prefix over the query's tokens; 0 for a query without tokens."""
    n = F.least(F.size(query_tokens), F.size(title_tokens))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice(query_tokens, F.lit(1), k) == F.slice(title_tokens, F.lit(1), k))
    return F.when(n >= 1, F.size(same) / F.greatest(F.size(query_tokens), F.lit(1))).otherwise(F.lit(0.0))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null where a coordinate is."""
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))  # least() would pass over a null
