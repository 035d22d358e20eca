import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import clean, features, logs, mining, split
from millrace.streaming import clicks

LOG = "search_query_norm string, item_id string, item_title_norm string, item_microcat_id int, row_id bigint"


def test_dedup_then_cap(spark):
    rows = [("a b", "1", "t1", 0), ("b a", "1", "t1", 1), ("a b", "2", "t1", 2), ("a b", "3", "t3", 3)]
    log = spark.createDataFrame([(q, i, t, None, k) for q, i, t, k in rows], "search_query string, item_id string, item_title_raw string, item_infm_params_text string, row_id bigint")
    stats = {r.step: r.n_rows for r in clean.cleaning_stats(clean.clean_steps(log, 5)).collect()}
    assert stats == {"0_start": 4, "1_pair_dedup": 3, "2_tower_dedup": 2, "3_cap": 2, "n_queries_preserved": 1}
    assert sorted(r.item_id for r in clean.clean_train(log, 5).collect()) == ["1", "3"]
    many = spark.createDataFrame([(f"query {q}", f"{q}-{i}", f"t{i}", None, q * 100 + i) for q in range(3) for i in range(30)], log.schema)
    kept = clean.clean_train(many, 5)
    assert Counter(r.search_query_norm for r in kept.collect()) == {f"{q} query": 5 for q in range(3)}
    assert sorted(kept.collect()) == sorted(clean.clean_train(many.repartition(7), 5).collect())


def test_keep_first_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1, "b"), (None, 0, "a"), ("x", 2, None)], "k string, row_id int, v string")
    assert sorted((r.row_id, r.v) for r in clean.keep_first(df, ["k"], ["row_id"]).collect()) == [(0, "a"), (2, None)]


def _split_log(spark):
    rows = [(f"text {t}", loc, f"{t:08x}{loc:04x}{k:04x}") for t in range(60) for loc in range(3) for k in range(2)] + [("single", None, "f" * 16)]
    return spark.createDataFrame(rows, "search_query_norm string, search_location_id int, item_id string")


def test_hold_outs_are_cold_and_disjoint(spark):
    log = _split_log(spark)
    val, ranker = split.make_splits(log, 10, 8, 0.5, 0, ["search_location_id"])
    v, r = val.queries.collect(), ranker.queries.collect()
    assert (len(v), len(r)) == (10, 8) and Counter(x.stratum for x in v) == {"seen": 5, "new": 5}
    assert {len(x.query_id) for x in v + r} == {16} and len({x.query_id for x in v + r}) == 18
    assert not {x.search_query_norm for x in v} & {x.search_query_norm for x in r}
    rest = ranker.remaining.collect()
    positives = {x.item_id for h in (val, ranker) for x in h.positives.collect()}
    assert not positives & {x.item_id for x in rest} and positives
    texts = {x.search_query_norm for x in rest}
    assert not texts & {x.search_query_norm for x in v + r if x.stratum == "new"}
    assert {x.search_query_norm for x in v if x.stratum == "seen"} <= texts | {x.search_query_norm for x in r}
    again = split.make_splits(log.repartition(9), 10, 8, 0.5, 0, ["search_location_id"])[0]
    assert sorted(map(tuple, v)) == sorted(map(tuple, again.queries.collect()))
    assert {x.query_id for x in val.qrels.collect()} == {x.query_id for x in v}


def test_cold_start_ratio(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "item_id string") for xs in ("abcd", "cd"))
    assert split.cold_start_ratio(a, b).first()[0] == 0.5 and split.cold_start_ratio(a.limit(0), b).first()[0] == 0.0


def _history(draw, n=200):
    words = ["red", "blue", "box", "cat", "sun"]
    return [(" ".join(sorted(draw.choice(words) for _ in range(draw.randint(1, 3)))), f"i{draw.randrange(30)}", f"t{draw.randrange(6)}", draw.choice([1, 2, 3, None]), k) for k in range(n)]


def test_microcat_shares_equal_plain_python(spark):
    rows = _history(random.Random(0))
    by_text, by_token = {}, {}
    for q, _, _, m, _ in rows:
        by_text.setdefault(q, Counter())[m] += 1
    for q, c in by_text.items():
        for t in set(q.split()):
            by_token.setdefault(t, Counter()).update(c)

    def plain(q, m):
        if q in by_text:
            return (by_text[q][m] if m is not None else 0) / sum(by_text[q].values())
        shares = [(by_token[t][m] if m is not None else 0) / sum(by_token[t].values()) for t in q.split() if t in by_token]
        return sum(shares) / len(shares) if shares else 0.0

    texts = [*list(by_text)[:10], "red red red zzz", "blue zzz", "zzz", ""]
    pairs = spark.createDataFrame([(q, m) for q in texts for m in (1, 2, 3, 4, None)], "search_query_norm string, item_microcat_id int")
    got = {(r[0], r[1]): r[2] for r in logs.p_microcat(pairs, logs.query_logs(spark.createDataFrame(rows, LOG))).collect()}
    assert got == pytest.approx({(q, m): plain(q, m) for q in texts for m in (1, 2, 3, 4, None)})


def test_log_candidates_equal_plain_python(spark):
    draw = random.Random(1)
    rows = _history(draw, 300)
    items = [(f"i{k}", f"t{k % 6}", draw.choice([1, 2, None]), k) for k in range(60)]
    texts = sorted({r[0] for r in rows})[:12] + ["never seen"]
    queries = [(n, q, draw.choice([1, 2, None])) for n, q in enumerate(texts)]
    known = {i for i, *_ in items}

    def plain(text, place, per_title, most):
        own = [r for r in rows if r[0] == text]
        out = [i for i in dict.fromkeys(r[1] for r in own) if i in known]
        for title, _ in Counter(r[2] for r in own).most_common():
            members = [i for i in items if i[1] == title]
            out += [i[0] for i in sorted(members, key=lambda i: (i[2] != place, i[3]))[:per_title]]
        return list(dict.fromkeys(out))[:most]

    q = spark.createDataFrame(queries, "query_id int, search_query_norm string, location int")
    i = spark.createDataFrame(items, "item_id string, item_title_norm string, location int, pos int")
    got = {}
    for r in sorted(logs.log_candidates(q, i, logs.query_logs(spark.createDataFrame(rows, LOG)), 4, 20).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.item_id)
    want = {n: plain(text, place, 4, 20) for n, text, place in queries}
    assert got == {n: v for n, v in want.items() if v}


def test_negatives_leave_out_positives_and_equal_offers(spark):
    ranking = spark.createDataFrame([("q", str(k), k + 1) for k in range(5)], "search_query_norm string, item_id string, rank int")
    items = spark.createDataFrame([(str(k), t) for k, t in enumerate(["same", "same", "d1", "d2", "d3"])], "item_id string, item_tower_text string")
    positives = spark.createDataFrame([("q", "0")], "search_query_norm string, item_id string")
    pick = lambda n, a=0, b=5: sorted(r.negative_id for r in mining.mine_negatives(positives, ranking, items, positives, n, a, b).collect())
    assert pick(3) == ["2", "3", "4"] and pick(9) == ["2", "3", "4"] and pick(2, 0, 4) == ["2", "3"] and pick(2, 5, 9) == []
    two = pick(2)
    assert len(two) == 2 and two[0] in "23" and set(two) <= {"2", "3", "4"}


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_negative_strata(spark, n):
    ranking = spark.createDataFrame([("q", f"{k:03}", k + 1) for k in range(40)], "search_query_norm string, item_id string, rank int")
    items = spark.createDataFrame([(f"{k:03}", f"t{k}") for k in range(40)] + [("p", "own")], "item_id string, item_tower_text string")
    pair = spark.createDataFrame([("q", "p")], "search_query_norm string, item_id string")
    out = sorted((r.stratum, int(r.negative_id)) for r in mining.mine_negatives(pair, ranking, items, pair, n, 5, 35).collect())
    edges = [int(x * 30 / n) for x in range(n + 1)]
    assert len(out) == n and all(edges[s] <= k - 5 < edges[s + 1] for s, k in out)


def test_price_scores_and_item_groups(spark):
    rows = [(k, "a" if k < 8 else "b", [100.0, 200.0, 0.0, None, 50.0, 80.0, 90.0, 10.0, 5.0][k]) for k in range(9)]
    df = spark.createDataFrame(rows, "k int, g string, price double")
    got = {r.k: r.z for r in features.price_zscore(df, "price", ["g"], "z").collect()}
    import statistics

    import numpy as np

    logs_ = np.log1p([100.0, 200.0, 50.0, 80.0, 90.0, 10.0])
    assert got[0] == pytest.approx((np.log1p(100.0) - logs_.mean()) / statistics.pstdev(logs_)) and got[2] is None and got[3] is None and got[8] is None


def test_feature_bank_on_whole_stage(spark):
    from millrace.plans import registry
    from millrace.plans.rank_queries import part_stage

    folder = "/root/testdata/sf0.001"
    frame = registry.queries()["feature_bank_46"](spark, folder).toPandas()
    assert list(frame.columns) == ["query_id", "item_id", *features.RANKER_FEATURES] and len(features.RANKER_FEATURES) == 46
    assert not frame.duplicated(["query_id", "item_id"]).any() and frame.query_id.nunique() == 10
    assert frame.dense_cos.between(-1.01, 1.01).all() and frame.colbert_maxsim.notna().all()
    stage = part_stage(registry.Tables(spark, folder))
    items = {r.item_id: r for r in stage.items.collect()}
    queries = {r.query_id: r for r in stage.queries.collect()}
    places = {r.location_id: (r.lat, r.lon) for r in stage.centroids.collect()}
    sizes = Counter(i.item_title_norm for i in items.values())
    for r in frame.itertuples():
        q, i = queries[r.query_id], items[r.item_id]
        assert r.loc_match == (q.location == i.location) and r.category_match == (q.category == i.category) and r.dup_cluster_size == sizes[i.item_title_norm]
        assert r.qcov_title == pytest.approx(len(set(q.tokens) & set(i.title)) / max(len(set(q.tokens)), 1), abs=1e-3)
        assert r.has_query_params == bool(q.params_text) and r.price == pytest.approx(i.price, abs=0.1)
        missing = q.location not in places or i.lat is None
        assert (r.haversine_km != r.haversine_km) == missing and (r.dist_rank_in_pool != r.dist_rank_in_pool) == missing
    for _, group in frame.groupby("query_id"):
        assert group.bm25f_rank_in_pool.tolist() == pytest.approx(group.bm25f_total.rank(ascending=False, method="min").tolist())
        assert group.dist_rank_in_pool.tolist() == pytest.approx(group.haversine_km.rank(method="average").tolist(), nan_ok=True)
        assert group.microcat_rank.tolist() == pytest.approx(group.p_microcat_given_query.rank(ascending=False, method="dense").tolist())


def test_feature_bank_has_the_pool_of_the_published_settings(spark):
    from millrace.plans import registry

    # 200 parts are fewer than the pool's 600 places: each of them meets each of the ten queries
    frame = registry.queries()["feature_bank_46"](spark, "/root/testdata/sf0.001")
    assert frame.groupBy("query_id").count().toPandas()["count"].tolist() == [200] * 10


def test_ranker_prefers_relevant_pairs(spark):
    from millrace.operators import rank

    draw = random.Random(2)
    rows = [(k % 10, k, draw.random(), None if k % 5 == 0 else draw.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, f1 double, f2 double").withColumn("label", (F.col("f1") > 0.7).cast("double"))
    out = rank.predict_scores(rank.train_ranker(df, ["f1", "f2"], trees=5, depth=2), df, ["f1", "f2"]).collect()
    assert min(r.score for r in out if r.label == 1) > max(r.score for r in out if r.label == 0)


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    clicks.append_counts(clicks.windowed_counts(stream, ["event_type"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    last = events.agg(F.max("ts")).first()[0]
    finished = events.withColumn("w", F.window("ts", "10 minutes")).where(F.col("w.end") <= F.lit(last) - F.expr("INTERVAL 30 MINUTES"))
    want = {r.event_type: r["count"] for r in finished.groupBy("event_type").count().collect()}
    assert {r.event_type: r.n_clicks for r in clicks.totals(got, ["event_type"]).collect()} == want


def test_the_ranker_is_listwise_and_survives_saving(spark, tmp_path):
    """A feature that is high for all pairs of some queries must not help: only order within a query counts."""
    from millrace.operators import rank

    draw = random.Random(3)
    rows = []
    for q in range(40):
        level = draw.random() * 10
        own = [draw.random() for _ in range(8)]
        rows += [(q, i, level + x, x, float(x == max(own)) if q % 10 else 0.0) for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, shifted double, own double, label double")
    model = rank.train_ranker(df, ["shifted", "own"], trees=8, depth=3)
    out = rank.predict_scores(model, df, ["shifted", "own"]).toPandas()
    asked = out[out.query_id % 10 > 0]
    first = asked.sort_values("score", ascending=False).groupby("query_id").head(2)
    assert first.groupby("query_id").label.max().mean() > 0.9
    rank.save_ranker(model, str(tmp_path / "ranker"))
    again = rank.predict_scores(rank.load_ranker(str(tmp_path / "ranker")), df, ["shifted", "own"]).toPandas()
    assert (again.sort_values(["query_id", "item_id"]).score.values == out.sort_values(["query_id", "item_id"]).score.values).all()
