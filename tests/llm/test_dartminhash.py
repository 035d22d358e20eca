import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import dartminhash as m
from millrace.llm.components import components

WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")
VOCABULARY = ["v%d" % k for k in range(300)]


def shingles(text):
    words = WORD.findall((text or "").lower().encode())
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])


def brute_classes(rows):
    """Least id of each class, by comparing all pairs."""
    rows = [(i, t or "") for i, t in rows]
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1]
            if not same and sets[i] and sets[j]:
                shared = sum((sets[i] & sets[j]).values())
                same = shared >= 0.8 * sum((sets[i] | sets[j]).values())
            if same:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return Counter((rows[k][0], least[find(k)]) for k in range(len(rows)))


def corpus(seed=0):
    draw = random.Random(seed)
    text = lambda n: [draw.choice(VOCABULARY) for _ in range(n)]
    rows = [" ".join(text(draw.randint(6, 120))) for _ in range(120)]
    for size, edits in ((60, 3), (40, 8), (3, 2)):
        base = text(100)
        rows.append(" ".join(base))
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randint(1, edits)):
                copy[draw.randrange(len(copy))] = draw.choice(VOCABULARY)
            rows.append(" ".join(copy))
    rows += [rows[3]] * 30 + [rows[5].upper() + "!!", "a b", "A, b.", "", "", "...", "?"]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(3))
def test_agreement_estimates_weighted_jaccard(seed):
    draw = np.random.default_rng(seed)
    e = draw.integers(0, 2**63, 300).astype(np.uint64)
    a = draw.integers(0, 9, 300) * draw.choice([1.0, 0.25])
    b = np.maximum(a + draw.integers(-1, 2, 300), 0)
    k = 3000
    one = lambda w: m.signatures(e[w > 0], w[w > 0], np.zeros((w > 0).sum(), int), 1, k)[0]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((one(a) == one(b)).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)
    assert (one(a) != 0).all()


def test_signatures_do_not_depend_on_neighbours():
    draw = np.random.default_rng(1)
    e, text = draw.integers(0, 2**63, 400).astype(np.uint64), np.repeat(np.arange(4), [1, 9, 90, 300])
    w = draw.integers(1, 4, 400).astype(float)
    whole = m.signatures(e, w, text, 5, 144)
    for t in range(4):
        own = text == t
        assert (m.signatures(e[own], w[own], np.zeros(own.sum(), int), 1, 144)[0] == whole[t]).all()
    assert (whole[4] == 0).all()


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, node string, band string")
    out = m.near_duplicate_classes(df).collect()
    assert Counter((r.doc_id, r.class_id) for r in out) == brute_classes(rows)
    assert sorted(r.doc_id for r in out if r.is_kept) == sorted({r.class_id for r in out})
    kept = m.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in out})


def test_the_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_MEMBERS", 7)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r.doc_id, r.class_id) for r in m.near_duplicate_classes(df).collect()) == brute_classes(rows)


def test_nulls_repeated_rows_and_empty_tables(spark):
    long = " ".join(VOCABULARY) * 300
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, long), (10, long + " tail"), (None, "alone in the world today"), (None, "alone in the world today")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = Counter((r.doc_id, r.class_id) for r in m.near_duplicate_classes(df).collect())
    assert out == Counter({(1, 1): 1, (2, 1): 1, (None, 7): 1, (7, 7): 2, (9, 9): 1, (10, 9): 1, (None, None): 2})
    assert Counter(r.doc_id for r in m.keep_one_of_each(df).collect()) == Counter([1, 7, 9, None])
    empty = df.limit(0)
    assert m.near_duplicate_classes(empty).count() == 0 and m.keep_one_of_each(empty).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 100)] + [(300, k) for k in range(301, 360)] + [(None, 1)]
    out = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102, 200)} | {k: 300 for k in range(300, 360)}
    assert {r.node: r.component for r in out} == want and len(out) == len(want)


def test_near_copies_of_null_ids_meet(spark):
    rows = corpus(2)
    draw = random.Random(0)
    rows = [(None if draw.random() < 0.3 else i, t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = m.near_duplicate_classes(df).collect()
    assert Counter((r.doc_id, r.class_id) for r in out) == brute_classes(rows)
    classes = len({r.class_id for r in out if r.class_id is not None})
    assert sum(r.is_kept and r.doc_id is not None for r in out) == classes


def test_darts_thrown_in_parts_are_the_same(monkeypatch):
    draw = np.random.default_rng(2)
    e, text = draw.integers(0, 2**63, 4000).astype(np.uint64), np.repeat(np.arange(3), [100, 900, 3000])
    w = draw.integers(1, 4, 4000).astype(float)
    whole = m.signatures(e, w, text, 3, 144)
    monkeypatch.setattr(m, "THROWN", 17)
    assert (m.signatures(e, w, text, 3, 144) == whole).all()
