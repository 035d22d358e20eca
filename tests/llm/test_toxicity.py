import random

import numpy as np
import pyarrow as pa

from millrace.llm import common, toxicity

CLEAN, BAD = ["river", "stone", "cloud", "garden", "window", "morning", "letter"], ["vilest", "scumbag", "filthy"]


def _rows(n, seed=0):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        words = [draw.choice(CLEAN) for _ in range(30)]
        label = k % 4 == 0
        if label:
            words[draw.randrange(30)] = draw.choice(BAD)
        rows.append((k, " ".join(words), int(label)))
    return rows


def test_held_out_accuracy():
    model = toxicity.fit(_rows(300))
    rows = _rows(200, 1)
    scores = toxicity._Scorer(model)(pa.array([t for _, t, _ in rows]))
    assert np.mean((scores >= 0.7) == np.array([y for *_, y in rows])) > 0.98


def test_score_is_the_sum_over_distinct_ngrams():
    model = toxicity.fit(_rows(200))
    text = "River  scumbag\nriver " + "stone " * 5
    padded = " " + "".join(" " if ord(c) < 33 else c for c in text.lower()) + " "
    weights = dict(zip(model.grams.tolist(), model.weights.tolist(), strict=True))

    def gram_hash(gram):
        h = 0
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
        return int(toxicity.mix(np.array([(h + len(gram)) % 2**64], np.uint64))[0])

    grams = {padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}
    z = model.intercept + sum(weights.get(gram_hash(g), 0.0) for g in grams)
    assert np.isclose(toxicity._Scorer(model)(pa.array([text]))[0], 1 / (1 + np.exp(-z)))


def test_blocks_do_not_change_scores(monkeypatch):
    model = toxicity.fit(_rows(200))
    texts = pa.array([t for _, t, _ in _rows(50, 2)] + ["", None, "x" * 5000])
    whole = toxicity._Scorer(model)(texts)
    monkeypatch.setattr(toxicity, "code_point_blocks", lambda c, overlap: common.code_point_blocks(c, 100, overlap))
    assert np.allclose(whole, toxicity._Scorer(model)(texts))


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    rows = [(k, t, y) for k, t, y in _rows(120)]
    docs = [(k, t, "x", 0.5) for k, t, _ in rows] + [(500, None, "x", 0.1), (501, "", None, None), (None, "scumbag vilest", "x", 0.1), (0, rows[0][1], "x", 0.5), (502, "stone " * 30_000, "x", 0.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, held_out string, score double")
    labels = spark.createDataFrame([(k, 0, y) for k, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score_documents(df, labels).collect()
    assert len(out) == len(docs)
    assert out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    by = {r.doc_id: r for r in out}
    assert by[500].score == by[501].score and by[None].held_out is False
    assert by[502].predicted == 0 and all(0 <= r.score <= 1 for r in out)
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_empty_tables_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert len({r.score for r in toxicity.score_documents(docs, labels).collect()}) == 1
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_the_query_equals_brute_force(spark):
    """Every document's score against a sum over the n-grams that plain Python finds in it."""
    rows = _rows(150)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, "Ünïcode scumbag\tÉ"), (901, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels)
    weights = dict(zip(model.grams.tolist(), model.weights.tolist(), strict=True))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in toxicity.score_documents(df, labels).collect():
        padded = " " + "".join(" " if ord(c) < 33 else c for c in (texts[r.doc_id] or "").lower()) + " "
        z = model.intercept
        for gram in {padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}:
            h = 0
            for c in gram:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            z += weights.get(int(toxicity.mix(np.array([(h + len(gram)) % 2**64], np.uint64))[0]), 0.0)
        assert np.isclose(r.score, 1 / (1 + np.exp(-z))) and r.predicted == int(r.score >= 0.7)
