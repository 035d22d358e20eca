import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language

COUNTS = {
    "en": {"the": 50, "water": 10, "with": 12, "thing": 8, "weather": 4, "and": 30, "house": 5},
    "de": {"der": 40, "wasser": 10, "mit": 12, "ding": 8, "wetter": 4, "und": 30, "haus": 5, "über": 3},
}


def _brute(word, model, g):
    """Log of the sum over all segmentations, in logarithms throughout."""
    pieces = {p: k for k, p in enumerate(language.load_pieces(model.vocabulary))}
    longest = max(map(len, pieces))
    text = language.MARK + word
    alpha = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            k = pieces.get(text[i:j], -1 if j == i + 1 else None)
            if k is not None:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + np.log(model.probabilities[k, g]))
    return alpha[-1]


def _model():
    return language.fit(COUNTS, language.default_vocabulary())


def test_forward_sums_all_segmentations():
    model = _model()
    words = ["the", "wetter", "über", "zażółć", "中文", "internationalisation", "a" * 47, "ab" * 60, "ш" * 60, "x" * 255, "waterhouse" * 30, "x" * 700]
    want = np.array([[_brute(w, model, g) for g in range(2)] for w in words])
    assert np.allclose(language.word_scores(words, model), want)


@pytest.mark.parametrize("letter", ["ก", "щ", "q", "字"])
@pytest.mark.parametrize("size", [40, 46, 60, 300])
def test_long_unknown_words_have_finite_scores(letter, size):
    rest = {"en": "the weather and the water", "de": "der wetter und das wasser"}
    names, scores = language._Scorer(_model())(pa.array([f"{t} {letter * size}" for t in rest.values()] + [letter * size]))
    assert names[:2] == ["en", "de"] and np.isfinite(scores).all() and (scores <= 1).all()
    assert scores[2] == pytest.approx(0.5, abs=0.05) or letter == "q"  # nothing tells two languages apart that know none of it


def test_words_are_runs_of_letters_with_their_marks():
    assert language.letter_runs("l’été") == ["l", "été"] and language.letter_runs("中文。字") == ["中文", "字"]
    assert language.letter_runs("ภาษาที่") == ["ภาษาที่"] and language.letter_runs("a1b") == ["a", "b"] and language.letter_runs("12́") == []


def test_expectation_maximisation_raises_the_likelihood():
    words = [(w, n) for w, n in COUNTS["de"].items()]
    values = []
    for rounds in (1, 2, 4):
        model = language.fit(COUNTS, language.default_vocabulary(), rounds)
        scores = language.word_scores([w for w, _ in words], model)[:, model.languages.index("de")]
        values.append(sum(n * s for (_, n), s in zip(words, scores, strict=True)))
    assert values == sorted(values)


def test_prediction_and_undetermined():
    scorer = language._Scorer(_model())
    names, scores = scorer(pa.array(["The water and the weather", "Der Wetter und das WASSER", None, "", "12 34 !!", "über " * 50_000]))
    assert names == ["en", "de", "und", "und", "und", "de"]
    assert all(scores[[2, 3, 4]] == 0) and scores[5] > 0.9 and 0.5 <= scores[0] <= 1


def test_the_score_does_not_grow_with_the_text():
    names, scores = language._Scorer(_model())(pa.array(["the water und das wasser", "the water und das wasser " * 40_000, "the water and the house", "the water and the house " * 40_000]))
    assert scores[1] == pytest.approx(scores[0]) and scores[3] == pytest.approx(scores[2]) and scores[0] < 0.75 < scores[2]


def test_documents_equal_brute_force(spark):
    texts = {"en": "the water and the weather with the house", "de": "der wasser und das wetter mit dem haus"}
    odd = ["the haus, und l’weather " + "ж" * 50, "The WATER und 字字", "x1y2 the", "ding thing"]
    rows = [(k, texts["en" if k % 2 else "de"], "en" if k % 2 else "de") for k in range(60)] + [(200 + k, t, None) for k, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(df)
    assert model.languages == ["de", "en"]
    for r in language.identify(df).collect():
        words = [w for span in next(t for i, t, _ in rows if i == r.doc_id).lower().split() for w in language.letter_runs(span)]
        each = np.array([[_brute(w, model, g) for g in range(2)] for w in words])
        best = int(each.sum(axis=0).argmax())
        share = np.exp(each - each.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(np.average(share[:, best], weights=[len(w) for w in words]))


def test_documents(spark):
    texts = {"en": "the water and the weather with the house", "de": "der wasser und das wetter mit dem haus"}
    rows = [(k, texts["en" if k % 2 else "de"], "en" if k % 2 else "de", 0.0) for k in range(60)]
    rows += [(100, None, "en", 0.0), (101, "1 2", None, 0.0), (None, "the water", "de", 0.0), (1, texts["en"], "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double").withColumn("lang_pred", F.lit("x"))
    out = language.identify(df).collect()
    assert len(out) == len(rows)
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in out if r.doc_id is not None and r.doc_id < 60)
    by = {r.doc_id: r for r in out}
    assert by[100].lang_pred == by[101].lang_pred == "und" and by[None].lang_pred == "en" and by[None].held_out is False
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 2
    assert language.identify(df.limit(0)).count() == 0 and language.keep_identified(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", df.lang.substr(9, 1)).where("doc_id is null")).collect()} == {"und"}


def test_undetermined_texts_go(spark):
    texts = {"en": "the water and the weather with the house", "de": "der wasser und das wetter mit dem haus"}
    rows = [(k, texts["en" if k % 2 else "de"], "en" if k % 2 else "de") for k in range(60)] + [(70, "Привет, как дела сегодня", None), (71, "ภาษาไทย", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in language.keep_identified(df, 0.55).collect()} == set(range(60))


def test_what_is_learned_is_bounded(spark):
    """10,000 noisy language names and an id that 20,000 rows repeat."""
    noise = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("noise").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    same = spark.range(20_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("the water").alias("text"), F.lit("en").alias("lang"))
    model = language.train(noise.unionByName(same), languages=5)
    assert len(model.languages) <= 5 and "en" in model.languages
