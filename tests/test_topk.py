import random

import numpy as np
import pytest

from millrace.operators import lexical, topk


def _brute(rows, k):
    out = {}
    for q, i, s in rows:
        out.setdefault(q, []).append((-round(s, 9), i))
    return {q: [i for _, i in sorted(v)[:k]] for q, v in out.items()}


@pytest.mark.parametrize("kind", [int, str])
def test_running_top_k_equals_sorting(monkeypatch, kind):
    monkeypatch.setattr(topk, "SPARE", 50)
    draw = random.Random(0)
    rows = [(draw.randrange(5), kind(n), draw.choice([0.1, 0.5, 0.5 + 1e-12, draw.random()])) for n in draw.sample(range(10_000), 2000)]
    top = topk.TopK(5, 7)
    for at in range(0, len(rows), 90):
        q, i, s = zip(*rows[at : at + 90], strict=True)
        top.add(np.array(q), np.array(i), np.array(s))
    q, i, s = top.result()
    got = {n: [x for _, x in sorted(zip(-topk.rounded(s[q == n]), i[q == n].tolist(), strict=True))] for n in range(5)}
    assert got == _brute(rows, 7)


def test_many_ties_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(topk, "SPARE", 100)
    top = topk.TopK(2, 3)
    for at in range(0, 20_000, 40):
        top.add(np.repeat([0, 1], 40), np.tile(np.arange(at, at + 40), 2), np.zeros(80))
        assert top.held <= 6 + 100 + 80
    assert sorted(top.result()[1].tolist()) == [0, 0, 1, 1, 2, 2]


@pytest.mark.parametrize("block", [3, 4096])
def test_term_tours_equal_brute_force(spark, block):
    draw = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    queries = [(q, draw.choice([1, 2, None]), draw.sample(words, draw.randint(0, 6))) for q in range(10)]
    items = [(f"i{k:03}", draw.choice([1, 2, None]), {w: draw.choice([0.0, 0.5, 1.0, draw.random()]) for w in draw.sample(words, draw.randint(0, 9))}) for k in range(150)]
    asked = spark.createDataFrame([(q, place, own, [2.0] * len(own)) for q, place, own in queries], "query_id int, location int, terms array<string>, boosts array<double>")
    held = spark.createDataFrame([(i, place, list(w), list(w.values())) for i, place, w in items], "item_id string, location int, terms array<string>, impacts array<double>").repartition(5)
    local, glob = lexical.term_tours(asked, held, 4, 6, block)
    for tour, k, here in ((glob, 6, False), (local, 4, True)):
        rows = [(q, i, 2.0 * sum(w.get(t, 0.0) for t in own)) for q, place, own in queries for i, at, w in items if not here or at == place]
        want = _brute([r for r in rows if r[2] > 0], k)
        got = {}
        for r in sorted(tour.collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append(r.item_id)
        assert got == want
