import hashlib
import random
import zlib

import numpy as np

from millrace.operators import clean, features, vector
from millrace.plans import pipeline
from millrace.plans.candidates import candidate_features
from millrace.plans.config import Config
from millrace.plans.context import make_benchmark_stage
from millrace.sources import tables

CFG = Config(n_validation_queries=8, n_ranker_queries=8, seen_fraction=0.5, retrieval_k=20, pool_size=12, negative_rank_min=0, negative_rank_max=20, near_radius_km=50)
SERVICES = ["баня на дровах", "ремонт окон", "стрижка собак", "уборка дома", "вывоз мусора"]


def encoder():
    def encode(texts):
        out = []
        for t in texts:
            words = t.split() or [""]
            rows = [np.random.default_rng(zlib.crc32(w.encode())).normal(size=8) for w in words]
            rows = [r / np.linalg.norm(r) for r in rows]
            dense = sum(rows) / max(np.linalg.norm(sum(rows)), 1e-9)
            out.append((dense, {zlib.crc32(w.encode()) % 1000: 1.0 for w in words}, rows))
        return out

    return encode


def _item(k):
    return (f"{k:016x}", f"{SERVICES[k % 5]} {k % 7}", f"описание {k % 3}", "Вид услуги Красота" if k % 2 else "", 114, k % 5, 1 + k % 3, 100.0 + k, 55.0 + k % 3, 37.0, 5.0, float(k), bool(k % 2), False)


def _bench(spark):
    return spark.createDataFrame([_item(k) for k in range(60)], tables.ITEM_SCHEMA)


def _log(spark):
    draw, rows = random.Random(0), []
    for n in range(400):
        k = draw.randrange(60, 200)
        query = f"{SERVICES[k % 5]} {draw.randrange(12)}"
        rows.append((n, query, draw.randrange(1, 5), 0, "", 114, *_item(k)))
    schema = "row_id bigint, search_query string, search_location_id bigint, search_is_delivery_search int, search_infm_params_text string, search_category bigint, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in tables.ITEM_SCHEMA
    )
    return spark.createDataFrame(rows, schema)


def test_from_log_to_ranker_report_and_answers(spark):
    context = pipeline.build_train_context(_log(spark), _bench(spark), CFG)
    val, ranker = (pipeline.make_train_stage(context, n) for n in ("val", "ranker"))
    assert val.queries.count() == ranker.queries.count() == 8
    positives = {r.item_id for r in context.positives.collect()}
    assert not positives & {r.item_id for r in context.train_part.select("item_id").collect()}
    assert positives <= {r.item_id for r in context.master.select("item_id").collect()}
    encoded = pipeline.encode_stage(val, encoder)
    model = pipeline.train_on_stage(ranker, pipeline.encode_stage(ranker, encoder), CFG, trees=3, depth=2)
    ranked = pipeline.rank_stage(model, val, encoded, CFG)
    report = {r.metric: r.value for r in pipeline.report(ranked, val, 5).collect()}
    assert set(report) == {"recall@5", "pool ceiling", "recall@5 seen", "recall@5 new"} and 0 <= report["recall@5"] <= report["pool ceiling"] <= 1
    answers = {r.query_id: r.answer.split() for r in pipeline.answer_lists(ranked, val, 5).collect()}
    assert len(answers) == 8 and all(len(a) == len(set(a)) <= 5 for a in answers.values())


def test_candidates_of_a_benchmark_stage(spark):
    queries = [(f"{k:016}", f"{SERVICES[k % 5]}", 1 + k % 4, 0, "Вид услуги Красота" if k % 2 else None, 114) for k in range(7)]
    stage = make_benchmark_stage(_bench(spark), spark.createDataFrame(queries, tables.QUERY_SCHEMA), _log(spark))
    frame = candidate_features(stage, pipeline.encode_stage(stage, encoder), CFG).toPandas()
    assert list(frame.columns) == ["query_id", "item_id", *features.RANKER_FEATURES] and frame.query_id.nunique() == 7
    assert not frame.duplicated(["query_id", "item_id"]).any() and frame.groupby("query_id").size().max() >= 12
    assert frame.colbert_maxsim.notna().all() and frame.dense_cos.between(-1.01, 1.01).all()
    assert set(frame[frame.query_id == f"{3:016}"].is_query_loc_empty) == {1.0} and set(frame[frame.query_id == f"{0:016}"].is_query_loc_empty) == {0.0}


def test_mining_is_deterministic_and_leaves_out_positives(spark):
    log = clean.clean_train(_log(spark))
    rows = sorted(map(tuple, pipeline.mine(log, CFG, encoder).collect()))
    assert rows == sorted(map(tuple, pipeline.mine(log.repartition(5), CFG, encoder).collect()))
    positives = {(r.search_query_norm, r.item_id) for r in log.collect()}
    assert rows and not {(q, n) for q, _, n, _ in rows} & positives
    assert pipeline.mine(log, CFG).count() > 0


def test_token_weights_and_mean_similarity(spark):
    tokens = spark.createDataFrame([(1, 7, 0.5), (1, 7, 0.9), (1, 8, -1.0), (1, 0, 3.0)], "text_id int, token int, weight double")
    assert vector.token_weights_max(tokens, [0]).first().weights == {7: 0.9}
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[1.0, 1.0]]), ([], [[1.0, 1.0]])], "q array<array<double>>, d array<array<double>>")
    assert [r.s for r in df.select(vector.maxsim_mean("q", "d", 0.5).alias("s")).collect()] == [3.0, 0.0]


def test_model_files(tmp_path):
    (tmp_path / "m").write_bytes(b"model")
    assert pipeline.file_has_digest(str(tmp_path / "m"), hashlib.sha256(b"model").hexdigest()) and not pipeline.file_has_digest(str(tmp_path / "m"), "0" * 64)
