import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluate, features, fusion, geo, lexical, vector


def items_of(spark, docs):
    return spark.createDataFrame([(k, *[f.split() for f in d]) for k, d in enumerate(docs)], "item_id int, title array<string>, params array<string>, desc array<string>")


def asked(spark, texts):
    return spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "query_id int, tokens array<string>")


DOCS = [("баня дрова", "", "топить баню"), ("автоподбор осмотр", "услуга", ""), ("баня сауна парение", "", "долгий текст про баня и сауна"), ("", "", "")]


def plain_bm25(docs, query):
    out = {}
    for f, name in enumerate(("title", "params", "desc")):
        texts = [d[f].split() for d in docs]
        mean = max(sum(map(len, texts)) / len(texts), 1e-9)
        for k, words in enumerate(texts):
            for t in set(query.split()):
                df = sum(t in w for w in texts)
                if t in words:
                    tf = words.count(t)
                    w = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
                    out[k, name] = out.get((k, name), 0) + w
    return out


def test_bm25_equals_plain_python_and_prefers_short_titles(spark):
    queries = ["баня", "сауна услуга баня баня", "unknown", ""]
    scores = lexical.combine_fields(lexical.score_fields(asked(spark, queries), lexical.fit_bm25(items_of(spark, DOCS)))).collect()
    got = {(r.query_id, r.item_id, f): r[f"bm25_{f}"] for r in scores for f in lexical.FIELDS if r[f"bm25_{f}"]}
    want = {(q, i, f): w for q, text in enumerate(queries) for (i, f), w in plain_bm25(DOCS, text).items()}
    assert got == pytest.approx(want)
    total = {r.item_id: r.score for r in scores if r.query_id == 0}
    assert total.keys() == {0, 2} and all(r.score == pytest.approx(r.bm25_title + 0.5 * r.bm25_params + r.bm25_desc) for r in scores)
    title = {r.item_id: r.bm25_title for r in scores if r.query_id == 0}
    assert title[0] > title[2] > 0


def ranking(spark, lists):
    rows = [(q, i, n + 1) for q, items in lists.items() for n, i in enumerate(items)]
    return spark.createDataFrame(rows, "query_id int, item_id string, rank int")


def order(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


def test_fusion_prefers_agreement_and_skips_zero_weights(spark):
    a, b = ranking(spark, {0: ["x", "y", "z"]}), ranking(spark, {0: ["y", "x", "w"]})
    assert set(order(fusion.rrf_fuse({"a": a, "b": b}, k=200, depth=2))[0]) == {"x", "y"}
    assert order(fusion.rrf_fuse({"a": ranking(spark, {0: ["x"]}), "b": ranking(spark, {0: ["y"]})}, {"a": 0, "b": 1})) == {0: ["y"]}
    a, b = ranking(spark, {0: ["solo", "p", "q", "both"]}), ranking(spark, {0: ["r", "s", "t", "u", "both"]})
    assert order(fusion.rrf_fuse({"a": a, "b": b}, k=1))[0][0] == "solo" and order(fusion.rrf_fuse({"a": a, "b": b}, k=200))[0][0] == "both"


def test_fusion_equals_plain_python(spark):
    draw = random.Random(0)
    names, lists = ["x", "y", "z"], {n: {q: draw.sample("abcdefghij", draw.randint(0, 8)) for q in range(25)} for n in "xyz"}
    weights = {"x": 2.0, "z": 0.5}
    want = {}
    for q in range(25):
        score, first = {}, {}
        for n in names:
            for rank, i in enumerate(lists[n][q], 1):
                score[i] = score.get(i, 0.0) + weights.get(n, 1.0) / (60 + rank)
                first.setdefault(i, len(first))
        if score:
            want[q] = sorted(score, key=lambda i: (-round(score[i], 12), first[i]))
    assert order(fusion.rrf_fuse({n: ranking(spark, lists[n]) for n in names}, weights, 60)) == want


def test_pool(spark):
    pool = fusion.merge_pool(ranking(spark, {0: list("abcdef")}), ranking(spark, {0: ["s", "t", "u", "a", "b", "c"]}), ranking(spark, {0: ["u"]}))
    got = order(pool)[0]
    assert len(got) == 9 and {"u", "s"} & set(got[:6]) and got.index("u") < got.index("t")


def test_near_list_keeps_the_order(spark):
    places = [(0, 55.75, 37.62), (1, 59.93, 30.33), (2, 55.80, 37.50), (3, None, 37.6), (4, 55.70, 37.70)]
    items = spark.createDataFrame([(str(k), a, b) for k, a, b in places], "item_id string, item_latitude double, item_longitude double")
    queries = spark.createDataFrame([(0, 55.75, 37.62), (1, None, None)], "query_id int, q_lat double, q_lon double")
    assert order(geo.nearby(ranking(spark, {0: list("41302"), 1: list("01")}), queries, items, 100)) == {0: ["4", "0", "2"]}


def test_centroids(spark):
    rows = [(7, 10.0, 1.0), (7, 20.0, 3.0), (8, 30.0, 5.0), (9, None, 6.0), (None, 1.0, 1.0)]
    clicks = spark.createDataFrame(rows, "search_location_id int, item_latitude double, item_longitude double")
    assert {r.location_id: (r.lat, r.lon) for r in geo.click_centroids(clicks).collect()} == {7: (15.0, 2.0), 8: (30.0, 5.0)}
    items = spark.createDataFrame([(8, 0.0, 0.0)], "item_location_id int, item_latitude double, item_longitude double")
    assert {r.location_id: r.lat for r in geo.merged_centroids(items, clicks).collect()} == {7: 15.0, 8: 0.0}


def test_pool_features(spark):
    rows = [(0, "5", 0.2), (0, "7", 0.9), (0, "9", 0.5), (1, "5", 0.1), (1, "8", 0.3), (1, "99", None)]
    frame = spark.createDataFrame(rows, "query_id int, item_id string, dense_cos double")
    out = features.add_pool_features(frame, ranking(spark, {0: ["9", "5", "7"], 1: ["8", "5"]}), 1000, ["dense_cos"]).collect()
    got = {(r.query_id, r.item_id): (r.pool_rank, r.dense_cos_rank_in_pool) for r in out}
    assert got == {(0, "5"): (1, 3), (0, "7"): (2, 1), (0, "9"): (0, 2), (1, "5"): (1, 2), (1, "8"): (0, 1), (1, "99"): (1000, None)}
    assert {r.dense_cos_minus_max for r in out if r.dense_cos_rank_in_pool == 1} == {0.0}


@pytest.mark.parametrize("block", [2, 4096])
def test_dense_tour_equals_brute_force(spark, block):
    draw = np.random.default_rng(0)
    docs, asks = draw.normal(size=(80, 16)), draw.normal(size=(7, 16))
    items = spark.createDataFrame([(k, v.tolist(), [1, 2, None][k % 3]) for k, v in enumerate(docs)], "item_id int, vec array<double>, location int")
    queries = spark.createDataFrame([(k, v.tolist(), [1, None, 5][k % 3]) for k, v in enumerate(asks)], "query_id int, vec array<double>, location int")
    tour = vector.dense_tour(queries, items.repartition(5), 6, 4, block)
    local, glob = tour.where("scope = 'local'"), tour.where("scope = 'global'")
    scores = asks @ docs.T
    assert order(glob) == {q: np.argsort(-scores[q])[:6].tolist() for q in range(7)}
    same = {q: [i for i in np.argsort(-scores[q]).tolist() if [1, 2, None][i % 3] == [1, None, 5][q % 3]][:4] for q in range(7)}
    assert order(local) == {q: v for q, v in same.items() if v}


def test_sparse_tour_drops_zeros(spark):
    items = spark.createDataFrame([(0, {"a": 1.0}, 1), (1, {"b": 2.0}, 1), (2, {"a": 1.0, "b": 1.0}, 2)], "item_id int, weights map<string,float>, location int")
    queries = spark.createDataFrame([(0, {"a": 1.0}, 2)], "query_id int, weights map<string,float>, location int")
    local, glob = vector.sparse_tour(queries, items, 5, 5)
    assert order(glob) == {0: [0, 2]} and order(local) == {0: [2]}
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "query_id int, item_id int")
    assert {r.item_id: r.sparse_score for r in vector.pair_sparse(pairs, queries, items).collect()} == {1: 0.0, 2: 1.0}


def test_maxsim_equals_brute_force(spark):
    draw = np.random.default_rng(1)
    docs, asks = [draw.normal(size=(n, 8)) for n in (3, 5, 1, 4)], [draw.normal(size=(n, 8)) for n in (2, 4, 0)]
    table = lambda name, xs: spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(xs)], f"{name} int, tokens array<array<double>>")
    pairs = spark.createDataFrame([(q, i) for q in (2, 0, 1) for i in (3, 1, 0, 2)], "query_id int, item_id int")
    q, d = table("query_id", asks), table("item_id", docs)
    got = {(r.query_id, r.item_id): r.s for r in vector.pair_maxsim(pairs, q, d, "s").collect()}
    want = {(a, b): float((asks[a] @ docs[b].T).max(axis=1).sum()) if len(asks[a]) else 0.0 for a in range(3) for b in range(4)}
    assert got == pytest.approx(want)
    wide = pairs.join(q.withColumnRenamed("tokens", "x"), "query_id").join(d.withColumnRenamed("tokens", "y"), "item_id")
    assert {(r.query_id, r.item_id): r.s for r in wide.select("query_id", "item_id", vector.maxsim("x", "y").alias("s")).collect()} == pytest.approx(want)


def test_group_centroids(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("b", [-1.0, 0.0]), (None, [0.0, 2.0])], "g string, vec array<double>")
    got = {r.g: r.centroid for r in vector.group_centroids(items, "g").collect()}
    assert got["a"] == pytest.approx([0.5**0.5] * 2) and got["b"] == [0.0, 0.0] and got[None] == [0.0, 1.0]


def test_select_top_k(spark):
    scores = spark.createDataFrame([(0, "a", 0.1), (0, "b", 0.9), (0, "c", 0.5), (2, "b", 0.3)], "query_id int, item_id string, score double")
    got = {r.query_id: r["items"] for r in fusion.select_top_k(spark.range(3).withColumnRenamed("id", "query_id"), scores, 2).collect()}
    assert got == {0: ["b", "c"], 1: [], 2: ["b"]}


def test_labels_and_recall(spark):
    pairs = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c")], "query_id int, item_id string")
    qrels = spark.createDataFrame([(0, "b"), (1, "c"), (1, "zzz")], "query_id int, item_id string")
    assert {(r.query_id, r.item_id): r.label for r in evaluate.label_candidates(pairs, qrels).collect()} == {(0, "a"): 0, (0, "b"): 1, (1, "a"): 0, (1, "c"): 1}
    shown = ranking(spark, {0: ["x", "y", "b"], 1: ["c"]})
    recall = lambda k: evaluate.recall_at_k(shown, qrels.where("query_id = 0"), k).first().recall
    assert (recall(2), recall(3)) == (0.0, 1.0)
    more = qrels.unionByName(spark.createDataFrame([(5, "q")], "query_id int, item_id string"))
    per = evaluate.per_query_recall(shown, more, None)
    assert {r.query_id: r.recall for r in per.collect()} == {0: 1.0, 1: 0.5, 5: 0.0}
    strata = spark.createDataFrame([(0, "seen"), (1, "new")], "query_id int, stratum string")
    assert {r.stratum: (r.recall, r.n) for r in evaluate.stratified_recall(per, strata).collect()} == {"seen": (1.0, 1), "new": (0.5, 1), "unknown": (0.0, 1)}
    assert evaluate.recall_at_k(shown, qrels.where(F.lit(False)), 5).first().recall == 0.0


def test_qrels_find_texts_inside_tokens_and_short_ones(spark):
    from types import SimpleNamespace

    from millrace.plans.rank_queries import qrels

    bench = spark.createDataFrame([(1, "one two three four five"), (2, "red fox"), (3, None), (4, "six seven eight nine ten")], "item_id bigint, text string")
    texts = ['so "one two three four five", he said', "one two three four five", "a (red fox) ran", "one two three four", "xsix seven eight nine tenth", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(map(tuple, qrels(SimpleNamespace(benchmark=bench, documents=docs)).collect())) == [(1, 0), (1, 1), (2, 2), (4, 4)]
