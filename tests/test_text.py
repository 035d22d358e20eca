import math
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import hooks, text


def apply(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in df.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_queries_with_the_same_words_are_equal(spark):
    got = apply(spark, text.normalize_query, ["установка сэндвич панели", "сэндвич панели установка", "PlayStation 5 скупка", "скупка playstation 5", "баня,  на дровах!!", None, "", "   "])
    assert got[0] == got[1] and got[2] == got[3] and got[4:] == ["баня дровах на", "", "", ""]


def test_titles_equal_plain_python(spark):
    draw = random.Random(0)
    values = ["".join(draw.choice("aБё 1!-\tЫ,ßé") for _ in range(draw.randint(0, 20))) for _ in range(300)]
    plain = [" ".join(re.sub(r"[^0-9a-zа-яё\s]", " ", v.lower()).split()) for v in values]
    assert apply(spark, text.normalize_title, values) == plain
    assert apply(spark, text.normalize_query, values) == [" ".join(sorted(p.split())) for p in plain]


def test_params_end_at_the_next_key(spark):
    pairs = lambda c: F.transform(text.parse_params(c), lambda p: F.concat_ws("=", p["k"], p["v"]))
    got = apply(spark, pairs, ["Вид услуги Компьютерная помощь Место оказания услуг пр-т Ленина", "x Услуга a, Своя услуга b ,", "no keys", None, "", "Своя услуга Начальная цена 5"])
    assert got == [["Вид услуги=Компьютерная помощь", "Место оказания услуг=пр-т Ленина"], ["Услуга=a", "Своя услуга=b"], [], [], [], ["Своя услуга=", "Начальная цена=5"]]


def test_params_equal_a_plain_scan(spark):
    draw = random.Random(1)
    parts = [*text.SPLIT_KEYS, "баня", "a, ", "1600", "x", ","]
    values = [" ".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(300)]
    keys = re.compile("|".join(re.escape(k) for k in sorted(text.SPLIT_KEYS, key=len, reverse=True)))

    def plain(v):
        found = list(keys.finditer(v))
        return [(m.group(), v[m.end() : (found[k + 1].start() if k + 1 < len(found) else len(v))].strip(" ,")) for k, m in enumerate(found)]

    assert [[tuple(p) for p in row] for row in apply(spark, text.parse_params, values)] == [plain(v) for v in values]


def test_whitelisted_params_and_tower_texts(spark):
    value = "Услуга Баня Стоимость 1600 Услуга Баня Стоимость 1700 Услуга Сауна Стоимость 1500"
    assert apply(spark, text.extract_whitelisted, [value, None, "", "text without keys"]) == ["Услуга Баня Услуга Сауна", "", "", ""]
    df = spark.createDataFrame([(" title ", value), ("title", None), (None, "")], "t string, p string")
    assert [r.x for r in df.select(text.item_tower_text("t", "p").alias("x")).collect()] == ["title Услуга Баня Услуга Сауна", "title", ""]
    assert [r.x for r in df.select(text.query_tower_text("t", "p").alias("x")).collect()] == ["title " + value, "title", ""]


def test_tokens_and_lemmas(spark):
    values = ["Баня-на ДРОВАХ 5л", "ſ ıx", "", None, "éa b"]
    assert apply(spark, text.tokens, values) == [re.findall("[0-9a-zа-яё]+", (v or "").lower(), re.I) for v in values]
    lemma = lambda words: words.str.replace("дровах", "дрова")
    assert apply(spark, lambda c: hooks.lemmas(c, lemma), values)[0] == ["баня", "на", "дрова", "5л"]


def test_similarities_equal_plain_python(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randint(1, 3)))
    rows = [(" ".join(word() for _ in range(draw.randint(0, 5))), " ".join(word() for _ in range(draw.randint(0, 5)))) for _ in range(300)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string")
    a, b = text.split_words("a"), text.split_words("b")
    out = df.select("k", text.set_jaccard(text.trigrams("a"), text.trigrams("b")).alias("j"), text.coverage(a, b).alias("c"), text.prefix_match(a, b).alias("p")).orderBy("k").collect()
    grams = lambda s: {f" {s} "[i : i + 3] for i in range(len(s))} if s else set()
    for (x, y), r in zip(rows, out, strict=True):
        g, h, p, q = grams(x), grams(y), x.split(), y.split()
        n = next((k for k, (u, v) in enumerate(zip(p, q, strict=False)) if u != v), min(len(p), len(q)))
        assert r.j == pytest.approx(len(g & h) / len(g | h) if g | h else 0)
        assert r.c == pytest.approx(len(set(p) & set(q)) / max(len(set(p)), 1)) and r.p == pytest.approx(n / len(p) if p else 0)


def test_haversine(spark):
    df = spark.createDataFrame([(55.75, 37.62, 59.93, 30.33), (0.0, 0.0, 0.0, 180.0), (1.0, 2.0, 1.0, 2.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r.x for r in df.select(text.haversine_km("a", "b", "c", "d").alias("x")).collect()]
    assert got[0] == pytest.approx(633.0, abs=2) and got[1] == pytest.approx(math.pi * text.EARTH_RADIUS_KM) and got[2:] == [0.0, None]


def test_lemmas_are_asked_for_once_and_the_cache_is_bounded(spark):
    import pandas as pd

    from millrace.functions import hooks

    asked = []
    table = hooks.dictionary_lemmatizer({"cats": "cat", "ran": "run"})
    cache = hooks.LemmaCache(lambda t: asked.extend(t) or table(t), 3)
    assert cache({"cats", "ran"}) == {"cats": "cat", "ran": "run"} and cache({"cats", "dog"}) == {"cats": "cat", "dog": "dog"}
    assert sorted(asked) == ["cats", "dog", "ran"] and len(cache.known) == 3
    cache({"a", "b"})
    assert len(cache.known) == 3 and "ran" not in cache.known
    df = spark.createDataFrame([("Cats ran!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(hooks.lemmatize_text("t", table)).collect()] == ["cat run", "", ""]
    assert isinstance(table(pd.Series(["x"])), pd.Series)
