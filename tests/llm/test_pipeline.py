import hashlib
import importlib.util
import random
import re
from collections import Counter

import pytest
import tiktoken

import corpus_pipeline
from millrace.llm import bpe, language, toxicity
from millrace.llm.common import fold

WORDS = ["stone%d" % k for k in range(150)]


def _write(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw, folder = random.Random(0), str(tmp_path_factory.mktemp("corpus"))
    text = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    bench = [(k, text(30)) for k in range(5)]
    rows = {}
    for k in range(160):
        words = text(draw.randint(40, 90))
        rows[k] = words + " vilest scumbag filthy" if k % 8 == 0 else words
    for k in range(160, 170):
        rows[k] = text(40) + " " + bench[k % 5][1] + " " + text(10)
    for k in range(170, 180):
        rows[k] = rows[k - 169] + " end" if k % 2 else rows[k - 169]
    rows |= {180: "12 34 !!", 181: "", 182: None}
    docs = [(k, t, "en", "src", len(t or "")) for k, t in rows.items()]
    _write(spark, folder, docs, [(k, 1, int(k % 8 == 0)) for k in range(160)], bench)
    return folder, rows, bench


def brute(rows, bench, toxic):
    """Ids that remain, by plain Python; ``toxic`` are those that the first stage's classifier rejects."""
    kept = {k: t for k, t in rows.items() if k not in toxic and re.search(r"[^\W\d_]", t or "")}
    grams = lambda t: Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4))
    sets, first = {k: grams(t) for k, t in kept.items()}, {}
    for k in sorted(kept):
        near = [j for j in first if sum((sets[k] & sets[j]).values()) >= 0.8 * sum((sets[k] | sets[j]).values())]
        if not near:
            first[k] = kept[k]
    return {k: t for k, t in first.items() if not any(b in t for _, b in bench)}


def test_run_equals_brute_force(spark, corpus):
    folder, rows, bench = corpus
    table = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score_documents(table, labels).collect() if r.predicted}
    assert toxic == {k for k, t in rows.items() if "vilest" in (t or "")}
    want = brute(rows, bench, toxic)
    library = tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()[0]), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(want)
    for k, t in want.items():
        ids = library.encode_ordinary(t)
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_columns_and_survive_empty_tables(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "encoding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (name == "encoding" or out.columns == docs.columns)


def test_folds(spark):
    import zlib

    df = spark.range(200)
    got = {r.id: r.f for r in df.select("id", fold(df.id, 3).alias("f")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 for k in range(200)}


def test_queries_are_registered_where_the_subpackage_is():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d", n)} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
    assert importlib.util.find_spec("millrace.llm") and language.UNDETERMINED == "und"
