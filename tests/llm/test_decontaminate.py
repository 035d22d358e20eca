import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import decontaminate as d

WORDS = ["w%d" % k for k in range(400)]


def _text(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


class _matcher:
    """The stages of the plan without Spark: parts and their filter, pieces of texts, hits by equal hashes, verification."""

    def __init__(self, items):
        self.parts = [(i, p) for (i, _), parts in zip(items, d.item_parts([t for _, t in items]).to_pylist(), strict=True) for p in parts]
        self.seeds = {}
        for k, (_, p) in enumerate(self.parts):
            for x in p["seeds"]:
                self.seeds.setdefault(x["h"], []).append((k, x))
        masks = tuple(dict.fromkeys(m for _, p in self.parts for m in d.masks_for(len(p["tokens"]))))
        self.seeker = d.Seeker(masks, max((len(p["tokens"]) for _, p in self.parts), default=0), d.filter_of(np.array(list(self.seeds), np.int64).view(np.uint64)))

    def __call__(self, column):
        out = []
        for pieces in self.seeker(column).to_pylist():
            best = {}
            for piece in pieces:
                spans = {}
                for x in piece["hits"]:
                    for k, y in self.seeds.get(x["h"], []):
                        spans.setdefault(k, []).append({"first": x["first"], "last": x["last"], "a": y["first"], "b": y["last"]})
                for k, s in spans.items():
                    i, p = self.parts[k]
                    found = d.best_overlap(np.array(piece["tokens"]), np.array(p["tokens"]), d.diagonals_of(s, len(piece["tokens"]), len(p["tokens"])))
                    if found and found[2] > best.get(i, (0, 0, 0))[2]:
                        best[i] = (piece["start"] + found[0], *found[1:])
            out.append([{"item_id": i, "start": f[0], "tokens": f[1], "equal": f[2]} for i, f in sorted(best.items())])
        return out


def _brute(doc, item):
    """The most equal tokens of a segment that meets the rule, over all diagonals and segments, or 0."""
    needed, best = d.tokens_needed(len(item)), 0
    for diagonal in range(1 - len(item), len(doc)):
        lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        total = np.concatenate([[0], np.cumsum(item[lo:hi] == doc[lo + diagonal : hi + diagonal])])
        for a in range(len(total)):
            for b in range(a + needed, len(total)):
                if 5 * (total[b] - total[a]) >= 4 * (b - a):
                    best = max(best, int(total[b] - total[a]))
    return best


@pytest.mark.parametrize("share", [0.0, 0.1])
def test_planted_passages_are_found_and_clean_texts_are_not(share):
    draw = random.Random(int(share * 10))
    items = [(k, _text(draw, draw.randint(20, 60))) for k in range(60)]
    docs, want = [], []
    for k in range(240):
        text, held = _text(draw, draw.randint(30, 300)).split(), k % 3 == 0
        if held:
            item, passage = items[k % 60]
            words = [draw.choice(WORDS) if draw.random() < share else w for w in passage.split()]
            at = draw.randrange(len(text))
            text[at:at] = words
        docs.append(" ".join(text))
        want.append({items[k % 60][0]} if held else set())
    got = [{o["item_id"] for o in x} for x in _matcher(items)(pa.array(docs))]
    found = sum(w <= g for w, g in zip(want, got, strict=True) if w) / sum(map(bool, want))
    assert found == 1.0 if share == 0 else found > 0.9
    assert all(g <= w for w, g in zip(want, got, strict=True))


def test_segments_equal_brute_force():
    draw = np.random.default_rng(0)
    for _ in range(300):
        equal = draw.random(draw.integers(1, 30)) < 0.7
        value = np.where(equal, 1, -2)
        best = max([value[a:b].sum() for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)] + [0])
        a, b = d.best_segment(equal)
        assert value[a:b].sum() == best


def test_every_seed_hit_is_verified_on_its_diagonal():
    item = np.arange(100, 140).astype(np.uint64)
    doc = np.concatenate([np.arange(30), item, np.arange(500, 520)]).astype(np.uint64)
    assert d.verify(doc, item, 30) == (30, 40, 40)
    assert d.verify(doc, item, 31) is None
    doc[[35, 45]] = 0
    assert d.verify(doc, item, 30) == (30, 40, 38)


def test_case_and_marks_do_not_matter_and_short_items_count_whole():
    matcher = _matcher([(1, "Five small words are enough"), (2, "too short now"), (3, None or "")])
    found = matcher(pa.array(["xx FIVE, small words -- are (enough)! yy", "too short now", "five small words are not enough"]))
    # three tokens count whole and unchanged; of five, four in a row are enough
    assert [[o["item_id"] for o in x] for x in found] == [[1], [2], [1]]
    assert [x for x in matcher(pa.array(["too short then", "five small were not enough"])) if x] == []


def test_documents_with_nulls_repeats_and_long_texts(spark):
    draw = random.Random(5)
    items = [(k, _text(draw, 30)) for k in range(20)] + [(None, _text(draw, 30)), (50, None), (51, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(k, _text(draw, 50) + " " + (items[k % 20][1] if k % 2 else ""), "a") for k in range(60)] + [(100, None, "a"), (101, "", "a"), (None, items[0][1], "a"), (1, items[1][1], "a"), (102, _text(draw, 60_000) + " " + items[2][1], "a")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    rows = lambda x: sorted(map(tuple, x.select("doc_id", "item_id", "equal").collect()), key=repr)
    whole = rows(d.contaminated(df, bench))
    assert whole == rows(d.contaminated(df.repartition(7), bench.unionByName(bench)))
    assert {(i, j) for i, j, _ in whole} == {(k, k % 20) for k in range(60) if k % 2} | {(None, 0), (1, 1), (102, 2)}
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k in range(60) if k % 2 == 0} | {100, 101}
    assert d.contaminated(df.limit(0), bench).count() == 0 and d.contaminated(df, bench.limit(0)).count() == 0


def test_substitutions_near_the_ends_do_not_lose_an_overlap():
    item = ["t%d" % k for k in range(20)]
    words = ["x" if k in (2, 4, 17) else w for k, w in enumerate(item)]
    found = _matcher([(1, " ".join(item))])(pa.array([" ".join(["a", "b", *words, "c"])]))[0]
    assert [(o["item_id"], o["equal"]) for o in found] == [(1, 17)]


@pytest.mark.parametrize("size", [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 18, 19, 20, 25, 31])
def test_every_overlap_that_meets_the_rule_is_found(size):
    draw = random.Random(size)
    items = [(k, " ".join("t%di%d" % (k, j) for j in range(size))) for k in range(150)]
    docs = []
    for _, passage in items:
        words = passage.split()
        for at in draw.sample(range(size), size // 5):
            words[at] = "other"
        docs.append(" ".join([_text(draw, 9), *words, _text(draw, 9)]))
    assert [[o["item_id"] for o in x] for x in _matcher(items)(pa.array(docs))] == [[k] for k, _ in items]


def test_longest_segments_equal_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(300):
        equal = draw.random(draw.integers(1, 30)) < 0.7
        sizes = [b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 5 * int(equal[a:b].sum()) >= 4 * (b - a)]
        a, b = d.longest_segment(equal)
        assert b - a == max(sizes, default=0) and 5 * int(equal[a:b].sum()) >= 4 * (b - a)


def test_any_overlap_that_meets_the_rule_is_found_brute_force():
    draw, vocabulary = random.Random(8), ["a", "b", "c", "d", "e"] + WORDS[:40]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 34)))) for k in range(60)]
    texts = []
    for _ in range(60):
        words = draw.choice(items)[1].split()
        for _ in range(draw.randint(0, 1 + len(words) // 4)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        cut = draw.randint(0, max(0, len(words) - 8))
        texts.append(" ".join([draw.choice(vocabulary) for _ in range(draw.randint(0, 12))] + words[cut:] + [draw.choice(vocabulary) for _ in range(draw.randint(0, 12))]))
    got = [{o["item_id"]: o["equal"] for o in x} for x in _matcher(items)(pa.array(texts))]
    tokens = d.tokens_of(texts), d.tokens_of([t for _, t in items])
    for k in range(len(texts)):
        want = {i for i in range(60) if _brute(tokens[0][k], tokens[1][i])}
        assert set(got[k]) == want


def test_repeated_words_cost_no_product():
    import time

    matcher = _matcher([(1, "spam " * 1000), (2, "ham eggs " * 400)])
    began = time.perf_counter()
    found = matcher(pa.array(["spam " * 20_000, "ham eggs " * 10_000, "spam ham " * 50]))
    assert [[(o["item_id"], o["equal"]) for o in x] for x in found] == [[(1, 1000)], [(2, 800)], []]
    assert time.perf_counter() - began < 3


def test_scripts_without_spaces_are_tokens_by_character():
    found = _matcher([(1, "今天天气很好我们去公园散步吧朋友们都来了"), (2, "ภาษาไทยง่ายมากครับ")])
    got = found(pa.array(["他说今天天气很好我们去公园散步吧朋友们都来了是的", "今天天气很好我们去山上散步吧朋友们都来了", "nothing", "พูดภาษาไทยง่ายมากครับผม"]))
    assert [[o["item_id"] for o in x] for x in got] == [[1], [1], [], [2]]


def test_long_texts_in_pieces_equal_whole_ones(monkeypatch):
    from millrace.llm import common

    draw = random.Random(3)
    items = [(k, _text(draw, 40)) for k in range(30)]
    texts = pa.array([" ".join([_text(draw, draw.randint(0, 4000)), items[k][1], _text(draw, 900), items[(k + 7) % 30][1]]) for k in range(12)] + ["", None, "x"])
    whole = _matcher(items)(texts)
    monkeypatch.setattr(d, "utf8_blocks", lambda c, lower: common.utf8_blocks(c, 700, lower))
    assert _matcher(items)(texts) == whole and all(len(x) == 2 for x in whole[:12])


def test_long_items_are_compared_in_parts():
    draw = random.Random(4)
    item = _text(draw, 3000).split()
    matcher = _matcher([(1, " ".join(item))])
    for at in (0, 950, 1000, 2000, 2970):
        assert [o["item_id"] for o in matcher(pa.array([" ".join(["x", *item[at : at + 30], "y"])]))[0]] == [1]
