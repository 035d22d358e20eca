"""What the queries move and keep must not outgrow their input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import features, lexical, topk, vector
from millrace.plans import rank_queries, registry, retrieval_queries, source_queries
from millrace.sources import tables

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def test_pool_ranks_compare_all_digits_where_asked(spark):
    frame = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5 + 1e-12), (0, 3, 0.5)], "query_id int, item_id int, dense_cos double")
    merged = spark.createDataFrame([], "query_id int, item_id int, rank int")
    ranks = lambda **o: {r.item_id: r.dense_cos_rank_in_pool for r in features.add_pool_features(frame, merged, 9, ["dense_cos"], **o).collect()}
    assert ranks() == {1: 1, 2: 2, 3: 3} and ranks(digits=None) == {2: 1, 1: 2, 3: 3}


def test_maxsim_expression_makes_no_table_of_pairs(spark, monkeypatch):
    made = []

    def counted(df, label, real=retrieval_queries.materialize):
        out = real(df, label)
        made.append(out.count())
        return out

    monkeypatch.setattr(retrieval_queries, "materialize", counted)
    pairs = QUERIES["maxsim_expression"](spark, FOLDER).count()
    assert pairs > max(made) and max(made) == spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.floor(F.col("vec_id") / 4)).distinct().count()


def test_training_lines_carry_no_more_than_they_write(spark, monkeypatch):
    carried = []

    def write(pairs, negatives, path, n, real=tables.write_training_jsonl):
        carried.append(negatives.agg(F.max(F.size("negatives"))).first()[0] - n)
        return real(pairs, negatives, path, n)

    monkeypatch.setattr(source_queries.tables, "write_training_jsonl", write)
    QUERIES["training_lines"](spark, "/root/testdata/sf0.01")
    assert carried == [0]


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_bm25_scores_are_a_narrow_pass(spark):
    assert _exchanges(QUERIES["bm25_field_scores"](spark, FOLDER)) == 0


def test_bm25_rankings_shuffle_the_best_items_alone(spark, monkeypatch):
    made = []

    def planned(df, label, real=topk.materialize):
        made.append((_exchanges(df), df.columns))
        return real(df, label)

    monkeypatch.setattr(topk, "materialize", planned)
    QUERIES["bm25f_topk_local"](spark, FOLDER).count()
    QUERIES["sparse_topk"](spark, FOLDER).count()
    assert made == [(1, ["query_id", "item_id", "scope", "score", "rank"])] * 2


def test_qrels_move_no_texts(spark):
    plan = rank_queries.qrels(registry.Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line and "query_id" not in line] and "SortMergeJoin" not in plan


@pytest.mark.parametrize("dense", [0, 1000])
@pytest.mark.parametrize("block", [2, 4096])
def test_bm25_passes_equal_the_postings(spark, monkeypatch, dense, block):
    monkeypatch.setattr(lexical, "DENSE_TERMS", dense)
    monkeypatch.setattr(lexical, "TOKEN_SLICE", 30)
    draw = random.Random(2)
    text = lambda n: [f"w{draw.randrange(12)}" for _ in range(draw.randrange(n))]
    items = [(k, draw.choice([1, 2, None]), text(4), text(2), None if k == 7 else text(20)) for k in range(60)]
    d = spark.createDataFrame(items, "item_id int, location int, title array<string>, params array<string>, desc array<string>").repartition(3)
    q = spark.createDataFrame([(k, draw.choice([1, None]), text(9)) for k in range(7)], "query_id int, location int, tokens array<string>")
    want = {(r[0], r[1]): r[2:] for r in lexical.score_fields(q, lexical.fit_bm25(d)).collect()}
    got = {(r[0], r[1]): r[2:] for r in lexical.score_scan(q, d, block=block).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    pairs = spark.createDataFrame([(a, b) for a in range(7) for b in range(0, 60, 3)], "query_id int, item_id int")
    scored = {(r[0], r[1]): r[2:] for r in lexical.pair_scores(pairs, q, d, block=block).select("query_id", "item_id", "bm25_title", "bm25_params", "bm25_desc").collect()}
    assert len(scored) == 140 and all(scored[k] == pytest.approx(want.get(k, (0.0, 0.0, 0.0))) for k in scored)
    glob = lexical.lexical_tours(q, d, 0, 5, block=block)[1].collect()
    total = {k: w[0] + 0.5 * w[1] + w[2] for k, w in want.items()}
    best = {a: [b for _, b in sorted((-round(s, 9), b) for (x, b), s in total.items() if x == a)[:5]] for a in range(7)}
    assert {a: [r.item_id for r in sorted(glob, key=lambda r: r["rank"]) if r.query_id == a] for a in range(7)} == best


def test_many_queries_are_dealt_to_tasks(spark, monkeypatch):
    """What tasks pass on does not grow with the items' partitions, nor a task's queries with the block."""
    monkeypatch.setattr(topk, "TASK_QUERIES", 8)
    monkeypatch.setattr(topk, "PASSED_ON", 40 * 3 * 2)
    sizes, draw = [], np.random.default_rng(1)
    docs, asks = draw.normal(size=(200, 4)), draw.normal(size=(40, 4))
    items = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(docs)], "item_id int, vec array<double>, location int").repartition(20)
    queries = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(asks)], "query_id int, vec array<double>, location int")
    task = vector._dense_task
    monkeypatch.setattr(vector, "_dense_task", lambda rows, *a: sizes.append(len(rows)) or task(rows, *a))
    found = {}
    for r in sorted(vector.dense_tour(queries, items, 3).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.item_id)
    assert sizes == [8] * 5
    assert found == {q: np.argsort(-(docs @ v), kind="stable")[:3].tolist() for q, v in enumerate(asks)}


def test_top_k_keeps_little_beside_the_best():
    top = topk.TopK(1, 10)
    for at in range(0, 1_000_000, 1000):
        top.add(np.zeros(1000, np.int64), np.arange(at, at + 1000), np.full(1000, 1.0 * at))
        assert top.held < 300_000

def test_mining_sorts_no_pairs_with_their_rankings(spark, monkeypatch):
    made = []

    def planned(df, label, real=topk.materialize):
        made.append(_exchanges(df))
        return real(df, label)

    monkeypatch.setattr(topk, "materialize", planned)
    plan = QUERIES["hard_negatives"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert made == [1] and "Window" not in plan and not re.search(r"BroadcastExchange.*item_tower|Broadcast\w+Join.*negative_id", plan)

def test_rank_windows_gather_no_rows_by_their_key_alone(spark):
    plan = QUERIES["rank_windows"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q#" in plan and not re.search(r"hashpartitioning\(q#\d+L?, \d+\)", plan)


def test_value_ranks_equal_windows(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice([1, 2, None]), draw.choice([None, 0.0, 1.5, 2.5, 7.0])) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, g int, v double")
    for r in features.value_ranks(df, "v", ["g"], "p_").collect():
        own = [v for _, g, v in rows if g == r.g and v is not None]
        if r.v is None:
            assert (r.p_min, r.p_dense, r.p_average) == (None, None, None)
        else:
            ascending = 1 + sum(v < r.v for v in own) + (own.count(r.v) - 1) / 2
            assert (r.p_min, r.p_dense, r.p_average, r.p_known, r.p_max) == (1 + sum(v > r.v for v in own), 1 + len({v for v in own if v > r.v}), ascending, len(own), max(own))

def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_candidates_cut_clicks_and_titles_before_they_meet_queries(spark):
    """Windows of the texts' clicks and of the titles' items are limited, besides the two over what the queries meet."""
    assert _plan(QUERIES["log_candidates"](spark, FOLDER)).count("WindowGroupLimit") >= 8
