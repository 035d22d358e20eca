import argparse
import hashlib
import json
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.plans import config
from millrace.plans.config import Config, get_paths, load_config
from millrace.sources import answer, tables


def test_load_casts_decimals_and_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, Decimal("2.50"))], "item_id bigint, item_price decimal(10,2)")
    df.write.parquet(str(tmp_path / "t"))
    assert tables.load_table(spark, str(tmp_path / "t")).dtypes == [("item_id", "string"), ("item_price", "double")]
    assert tables.load_table(spark, str(tmp_path / "t"), ["item_price"]).columns == ["item_price"]


def test_id_checks(spark):
    good = spark.createDataFrame([("0123456789abcdef",)], "item_id string")
    tables.assert_valid_item_ids(good)
    tables.assert_valid_query_ids(good.withColumnRenamed("item_id", "query_id"))
    for bad in ("0123456789ABCDEF", "123", None):
        with pytest.raises(ValueError):
            tables.assert_valid_item_ids(spark.createDataFrame([(bad,)], "item_id string"))
    with pytest.raises(ValueError):
        tables.assert_valid_query_ids(spark.createDataFrame([("short",), (None,)], "query_id string"))


def test_cached_tables_follow_their_key(spark, tmp_path):
    built = []
    build = lambda n: lambda: built.append(n) or spark.range(n)
    path = str(tmp_path / "c")
    for n in (3, 3, 4):
        assert tables.cached(spark, path, build(n), tables.fingerprint(spark.range(n), ["id"])).count() == n
    assert built == [3, 4]
    assert tables.fingerprint(spark.range(9), ["id"]) == tables.fingerprint(spark.range(9).orderBy(F.desc("id")), ["id"])


def test_training_lines(spark, tmp_path):
    pairs = spark.createDataFrame([("q", 1, "запрос", "p1"), ("q", 2, "запрос", "p2"), ("r", 3, "r", "p3")], "search_query_norm string, item_id int, query string, pos string")
    negatives = spark.createDataFrame([("q", 1, ["a", "b", "c"]), ("q", 2, ["a"]), ("r", 3, [])], "search_query_norm string, item_id int, negatives array<string>")
    assert tables.write_training_jsonl(pairs, negatives, str(tmp_path / "j"), 2) == 1
    lines = [json.loads(x) for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"query": "запрос", "pos": ["p1"], "neg": ["a", "b"]}]


def test_store_of_encodings(spark, tmp_path):
    items = spark.createDataFrame([("a", ([1.0], {1: 2.0}, [[1.0]])), ("b", ([2.0], {}, []))], "item_id string, encoded struct<dense:array<float>,sparse:map<int,float>,tokens:array<array<float>>>")
    tables.build_store(items, str(tmp_path / "s"))
    assert tables.load_store(spark, str(tmp_path / "s"), spark.createDataFrame([("b",)], "item_id string")).first().dense == [2.0]


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, item_id string, rank int")


def test_answers_are_distinct_cut_and_complete(spark, tmp_path):
    queries = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    rows = answer.answer_rows(queries, _ranked(spark, [("q1", "A", 1), ("q1", "A", 2), ("q1", "B", 3), ("q1", "C", 4), ("q9", "X", 1)]), 2)
    assert {r.query_id: r.answer for r in rows.collect()} == {"q1": "A B", "q2": ""}
    answer.write_answer(rows, str(tmp_path / "a"))
    lines = [x for f in (tmp_path / "a").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == ["query_id,answer", "q1,A B", "q2,"]
    assert {r.query_id: r["items"] for r in answer.read_answer(spark, str(tmp_path / "a")).collect()} == {"q1": ["A", "B"], "q2": []}


A, B, C = "0" * 16, "1" * 16, "a" * 16


@pytest.mark.parametrize(
    ("rows", "rule"),
    [
        ([("q1", A), ("q2", "")], None),
        ([("q1", A.replace("0", "A")), ("q2", "")], "bad_item_id"),
        ([("q1", A), ("q1", A), ("q2", "")], "duplicate_query"),
        ([("q1", f"{A} {A}"), ("q2", "")], "repeated_item"),
        ([("q1", A)], "missing_query"),
        ([("q1", A), ("q2", ""), ("q3", "")], "unexpected_query"),
        ([("q1", C), ("q2", "")], "unknown_item"),
        ([("q1", f"{A} {B} {C}"), ("q2", "")], "too_long"),
    ],
)
def test_validation(spark, rows, rule):
    queries = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    corpus = spark.createDataFrame([(A,), (B,)], "item_id string")
    found = {r.rule for r in answer.validate_rows(spark.createDataFrame(rows, "query_id string, answer string"), queries, corpus, 2).collect()}
    assert (rule in found) if rule else not found


def test_validation_of_files(spark, tmp_path):
    queries, corpus = spark.createDataFrame([("q1",)], "query_id string"), spark.createDataFrame([(A,)], "item_id string")
    for name, content, want in (("h", "id,answer\nq1,\n", {"header"}), ("c", f"query_id,answer\nq1,{A},x\n", {"columns"}), ("g", f"query_id,answer\nq1,{A}\n", set())):
        (tmp_path / name).write_text(content)
        assert {r.rule for r in answer.validate_file(spark, str(tmp_path / name), queries, corpus).collect()} == want


def test_comparison(spark):
    lists = lambda rows: spark.createDataFrame(rows, "query_id string, items array<string>")
    out = answer.compare_answers(lists([("q1", ["a", "b"]), ("q2", ["c"]), ("x", [])]), lists([("q1", ["a", "x"]), ("q2", ["c"])])).first()
    assert (out.queries_compared, out.mean_jaccard, out.identical_sets) == (2, pytest.approx((1 / 3 + 1) / 2), 0.5)


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("pool_size: 7\n")
    assert load_config(str(tmp_path / "c.yaml"), seed=1) == Config(pool_size=7, seed=1)
    with pytest.raises(ValueError, match="unknown"):
        load_config(None, sed=1)
    monkeypatch.setenv("MILLRACE_DATA", "/env")
    assert get_paths().data == "/env" and get_paths("/flag").table("t") == "/flag/t.parquet"


def test_answer_files_with_quotes_and_a_second_header(spark, tmp_path):
    queries = spark.createDataFrame([("q1",), ("query_id",)], "query_id string")
    corpus = spark.createDataFrame([(A,)], "item_id string")
    (tmp_path / "quoted").write_text(f'query_id,answer\n"q1","{A}"\nquery_id,\n')
    assert answer.validate_file(spark, str(tmp_path / "quoted"), queries, corpus).count() == 0
    (tmp_path / "again").write_text(f"query_id,answer\nq1,{A}\nquery_id,answer\n")
    assert {r.rule for r in answer.validate_file(spark, str(tmp_path / "again"), queries, corpus).collect()} == {"bad_item_id"}
    (tmp_path / "few").write_text("query_id,answer\nq1\n")
    assert {r.rule for r in answer.validate_file(spark, str(tmp_path / "few"), queries, corpus).collect()} == {"columns"}
    (tmp_path / "comma").write_text('query_id,answer\n"q,1",\n')
    assert {(r.rule, r.detail) for r in answer.validate_file(spark, str(tmp_path / "comma"), queries, corpus).collect() if r.rule == "unexpected_query"} == {("unexpected_query", "q,1")}


def test_a_store_is_appended_and_finished(spark, tmp_path):
    def encoded(ids, x):
        return spark.createDataFrame([(i, ([float(x)], {1: 1.0}, [[float(x)]])) for i in ids], "item_id string, encoded struct<dense:array<float>,sparse:map<int,float>,tokens:array<array<float>>>")

    writer = tables.StoreWriter(spark, str(tmp_path / "store"))
    assert writer.append(encoded(["a", "b"], 1), "0") and not writer.append(encoded(["a", "b"], 2), "0") and writer.append(encoded(["b", "c"], 3), "1")
    with pytest.raises(ValueError, match="not finished"):
        tables.open_store(spark, str(tmp_path / "store"))
    assert {r.item_id: r.dense for r in writer.finalize().collect()} == {"a": [1.0], "b": [1.0], "c": [3.0]}
    some = tables.open_store(spark, str(tmp_path / "store"), spark.createDataFrame([("c",), ("z",)], "item_id string"))
    assert [r.item_id for r in some.collect()] == ["c"]


def test_parts_are_resumed_and_stale_ones_are_not_read(spark, tmp_path):
    keys, built = spark.range(50).selectExpr("cast(id as string) k"), []
    build = lambda df: built.append(1) or df.selectExpr("k", "length(k) n")
    assert tables.load_parts(spark, str(tmp_path / "p"), 3, "v1") is None
    assert tables.write_parts(spark, str(tmp_path / "p"), keys, "k", build, 3, "v1") == 3
    shutil.rmtree(tmp_path / "p/v1/part=00001")
    assert tables.load_parts(spark, str(tmp_path / "p"), 3, "v1") is None
    assert tables.write_parts(spark, str(tmp_path / "p"), keys, "k", build, 3, "v1") == 1 and len(built) == 4
    assert tables.load_parts(spark, str(tmp_path / "p"), 3, "v1").count() == 50 and tables.load_parts(spark, str(tmp_path / "p"), 3, "v2") is None


def test_checkpoints_schemas_models_and_arguments(spark, tmp_path):
    for name in ("checkpoint-9", "checkpoint-100", "checkpoint-x", "other"):
        (tmp_path / "run" / name).mkdir(parents=True)
    assert tables.latest_checkpoint(spark, str(tmp_path / "run")).endswith("checkpoint-100") and tables.latest_checkpoint(spark, str(tmp_path / "none")) is None
    queries = spark.createDataFrame([("q", "text", 5, 1, None, 7)], "query_id string, search_query string, search_location_id int, search_is_delivery_search int, search_infm_params_text string, search_category int")
    queries.write.parquet(str(tmp_path / "q"))
    assert tables.load_benchmark_queries(spark, str(tmp_path / "q")).schema.simpleString() == tables.QUERY_SCHEMA.simpleString()
    with pytest.raises(ValueError, match="item_id"):
        tables.load_benchmark_items(spark, str(tmp_path / "q"))
    with pytest.raises(ValueError, match="item_title_raw"):
        tables.load_train(spark, str(tmp_path / "q"))
    assert tables.load_train(spark, str(tmp_path / "q"), ["search_query"]).columns == ["search_query"]
    (tmp_path / "m").write_bytes(b"weights")
    digest = hashlib.sha256(b"weights").hexdigest()
    (tmp_path / "models.yaml").write_text(f"encoder: {{name: m, sha256: {digest}}}\n")
    models = config.load_models_config(str(tmp_path / "models.yaml"))
    assert config.ensure_models(str(tmp_path), models)["encoder"].name == "m"
    with pytest.raises(FileNotFoundError, match="put the file absent"):
        config.ensure_models(str(tmp_path), {"x": config.ModelFile("absent", digest)})
    with pytest.raises(FileNotFoundError, match="damaged"):
        config.ensure_models(str(tmp_path), {"x": config.ModelFile("m", "0" * 64)})
    parser = argparse.ArgumentParser()
    config.add_path_arguments(parser)
    assert config.paths_of(parser.parse_args(["--data", "/d"])).data == "/d"
