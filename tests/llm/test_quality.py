import random

import numpy as np
import pyarrow as pa

from millrace.llm import quality


def _rows(n, seed=0):
    draw = random.Random(seed)
    words = ["Water", "runs", "over", "old", "stones", "while", "birds", "sing"]
    rows = []
    for k in range(n):
        text = ". ".join(" ".join(draw.choice(words).lower() for _ in range(8)).capitalize() for _ in range(6)) + "."
        if k % 3 == 0:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "%%% "), " | ".join(text.split()), "spam " * 60][k // 3 % 4]
        rows.append((k, text, int(k % 3 != 0)))
    return rows


def test_held_out_accuracy_and_order():
    model = quality.fit(_rows(240))
    rows = _rows(200, 1)
    strength = model.strength(quality.features(pa.array([t for _, t, _ in rows])))
    y = np.array([r[2] for r in rows])
    assert strength[y == 1].min() > strength[y == 0].max()
    assert np.mean((strength >= model.threshold) == (y == 1)) == 1.0


def test_threshold_is_the_quantile_of_the_share():
    rows = _rows(240)
    model = quality.fit(rows, share_worse=1 / 3)
    strength = model.strength(quality.features(pa.array([t for _, t, _ in rows])))
    assert abs((strength < model.threshold).mean() - 1 / 3) < 0.02


def test_features_do_not_depend_on_neighbours():
    texts = [t for _, t, _ in _rows(30)] + ["", "\n\n", "é", "word\nword\nword", "A" * 3000]
    whole = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], quality.features(pa.array([t]))[0]), k


def test_documents(spark):
    rows = _rows(90)
    docs = [(k, t, 1) for k, t, _ in rows] + [(900, None, 1), (901, "", 1), (None, "x", 1), (0, rows[0][1], 1), (902, "one two " * 40_000, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, predicted int")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(None, 1, 1), (5, None, 1)], "doc_id bigint, quality int, toxic int")
    out = quality.score_documents(df, labels).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(docs) and by[900].score == by[901].score and by[None].held_out is False
    assert np.mean([by[k].predicted == y for k, _, y in rows]) > 0.95
    none = labels.limit(0)
    assert {r.score for r in quality.score_documents(df, none).collect()} == {0.5}
    assert quality.score_documents(df.limit(0), labels).count() == 0


def _plain_form(text):
    """The features of form by plain Python, from the words that they are defined by."""
    data = text.encode()
    n = max(len(data), 1)
    word_bytes = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))
    marks = [b for b in range(128) if b not in word_bytes and b not in b" \t\n\r\f\v\0.,;:?!'\"()-"]
    words, at = [], 0
    while at < len(data):
        end = at
        while end < len(data) and data[end] in word_bytes:
            end += 1
        if end > at:
            words.append((data[at:end], data[end : end + 1]))
        at = max(end, at + 1)
    upper = lambda w: len(w) > 1 and all(65 <= b <= 90 for b in w[:2])
    lines = [x for x in data.splitlines(keepends=True) if len(x) > 1]
    bare = [x.removesuffix(b"\n") for x in lines]
    sizes = np.array([len(w) for w, _ in words] or [0], float)
    per, n_lines = max(len(words), 1), max(len(lines), 1)
    dense = sum(len(x) for x in lines if sum(b in marks or b == 33 for b in x) > 0.04 * len(x))
    shouted = sum(len(x) for x in lines if sum(65 <= b <= 90 for b in x) > 0.4 * len(x))
    return [
        np.log1p(len(words)), len(words) < 8, sizes.sum() / per, sizes.std() if words else 0, sum(sizes > 20) / per, len({w for w, _ in words}) / per,
        sum(a == b for (a, _), (b, _) in zip(words, words[1:], strict=False)) / per, sum(upper(w) for w, _ in words) / per,
        sum(bool(after) and after[0] in marks for _, after in words) / per, np.log1p(len(data) / n_lines) if data else 0.0, sum(len(x) < 20 for x in lines) / n_lines,
        (len(bare) - len(set(bare))) / n_lines, dense / n, shouted / n,
    ]


def test_features_of_form_equal_plain_python():
    draw = random.Random(4)
    alphabet = ["spam", "Ham", "EGGS", "naïve", "x" * 25, "!", "%%", "$", ".", ", ", " ", " ", "\n", "\n\n", "a-b", "|"]
    texts = [t for _, t, _ in _rows(40)] + ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 80))) for _ in range(200)]
    texts = [t.replace("\r", "").replace("\x0b", "").replace("\x0c", "") for t in texts]
    first = quality.NAMES.index("log_words")
    got = quality.features(pa.array(texts))[:, first : quality._FORM]
    for k, t in enumerate(texts):
        assert np.allclose(got[k], np.array(_plain_form(t), float)), (t, got[k], _plain_form(t))


def test_the_query_equals_the_model_text_by_text(spark):
    rows = _rows(120)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, quality int")
    model = quality.train(df, labels)
    for r in quality.score_documents(df, labels).collect():
        text = next((t for k, t, _ in rows if k == r.doc_id), "")
        z = np.clip((quality.features(pa.array([text]))[0] - model.mean) / model.scale, -quality.CLIP, quality.CLIP) @ model.weights - model.threshold
        assert np.isclose(r.score, 1 / (1 + np.exp(-z))) and r.predicted == int(r.score >= 0.5)


def test_every_labelled_document_is_learned_from(spark):
    from millrace.llm.common import fold

    draw = random.Random(7)
    rows = [(k, f"{'spam! ' if k % 2 else 'tree, '}{draw.choice('abcdef')} {draw.randint(0, 99)}", int(k % 2 == 0)) for k in range(5200)]
    rows.append((5200, "stone " * 20_000, 1))  # of more code points than a sample had room for
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, quality int")
    learned = {r.doc_id for r in df.where(fold(df.doc_id, 3) != 1).select("doc_id").collect()}
    assert 5200 in learned and len(learned) > 3000
    x = quality.features(pa.array([t for k, t, _ in rows if k in learned]))
    model = quality.train(df, labels)
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-6) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6), atol=1e-6)
    # and the model is that of the same rows in memory
    local = quality.fit([r for r in rows if r[0] in learned])
    assert np.allclose(model.strength(x) - model.threshold, local.strength(x) - local.threshold, atol=0.02)


def test_loss_and_its_slope_are_those_of_all_pairs():
    draw = np.random.default_rng(0)
    s, y = draw.normal(0, 3, 400), (np.arange(400) % 3 > 0).astype(np.int64)
    loss, lo, wrong = quality._meetings(quality._grid_counts(s, y))
    lead = s[y == 0][:, None] - s[y == 1]
    assert abs(loss - np.logaddexp(0, lead).mean()) < 1e-5
    chance = 1 / (1 + np.exp(-lead))
    low, part = quality._nodes(s)
    got = wrong[y, low - lo] * (1 - part) + wrong[y, low - lo + 1] * part
    assert np.allclose(got[y == 0], chance.mean(axis=1), atol=1e-5) and np.allclose(got[y == 1], chance.mean(axis=0), atol=1e-5)


def test_threshold_equals_sorting(monkeypatch):
    draw = np.random.default_rng(1)
    monkeypatch.setattr(quality, "NEAREST", 10)
    for strengths in (draw.normal(0, 4, 5000), np.round(draw.normal(0, 1, 5000), 1), np.repeat([-1.0, 2.0], 2500), np.zeros(5000)):
        y = (strengths + draw.normal(0, 1, 5000) > -1).astype(np.int64)
        sizes = np.bincount(y, minlength=2).astype(float)
        if not sizes.all():
            y[:100] = 1 - y[:100]
            sizes = np.bincount(y, minlength=2).astype(float)
        for share in (sizes[0] / 5000, 0.1, 0.999):
            got = quality._threshold(quality._local_pass(strengths, y), lambda x: x, sizes, share)
            order = np.argsort(strengths, kind="stable")
            s, below = strengths[order], np.cumsum(np.where(y == 0, share / sizes[0], (1 - share) / sizes[1])[order])
            at = min(int(np.searchsorted(below, share - 1e-12)), 4998)
            tied = np.flatnonzero(s == s[at])
            assert s[max(tied[0] - 3, 0)] <= got <= s[min(tied[-1] + 4, 4999)]
            if len(tied) == 1:
                near = np.arange(max(at - 2, 0), min(at + 3, 4999))
                g = near[(s[near + 1] - s[near]).argmax()]
                assert got == (s[g] + s[g + 1]) / 2
