"""Texts of tens of megabytes: results are those of the whole text, and what Python holds beside it stays small."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bpe, common, dartminhash, decontaminate, language, licenses, quality, toxicity

LINE = "Water runs over the old stones while birds sing, and nobody of the house minds it at all.\n"
MEGABYTES = 24


@pytest.fixture(scope="module")
def long_text():
    draw = random.Random(0)
    words = LINE.split()
    block = "".join(" ".join(draw.choice(words) for _ in range(14)) + ("\n" if k % 3 else " ") for k in range(12_000))
    return (block * (MEGABYTES * 1_000_000 // len(block) + 1))[: MEGABYTES * 1_000_000]


def peak_of(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _runs(long_text):
    column = pa.array([long_text, None, "short", long_text[:1000]])
    labelled = [(k, LINE * (1 + k % 3) + ("scumbag" if k % 2 else ""), k % 2) for k in range(40)]
    toxic = toxicity._Scorer(toxicity.fit(labelled))
    good = quality.fit([(k, t.upper() if y else t, 1 - y) for k, t, y in labelled])
    tongue = language._Scorer(language.fit({"en": {w: 1.0 for w in LINE.lower().split()}, "xx": {"zzz": 1.0}}, language.default_vocabulary()))
    scan = licenses._Scanner(licenses.fit([LINE] * 30), licenses.CONFIRMING)
    parts = decontaminate.item_parts(["the house of old birds minds it all while nobody sings over running water of stones"]).to_pylist()[0]
    seeds = np.array([s["h"] for p in parts for s in p["seeds"]], np.int64).view(np.uint64)
    seek = decontaminate.Seeker(decontaminate.masks_for(20), 20, decontaminate.filter_of(seeds))
    byte_level = bpe.tokenizer(*bpe.default_vocabulary())
    return {
        "op1": lambda: scan(column),
        "op2": lambda: quality.sigmoid(good.strength(quality.features(column))),
        "op5": lambda: seek(column),
        "op8": lambda: toxic(column),
        "op9": lambda: tongue(column),
        "op10": lambda: list(bpe._digests(byte_level, (t.as_py() or "" for t in column))),
    }


#: Bytes that an operator may hold at its peak, beside the text itself, for each byte of text.
ALLOWED = {"op1": 4, "op2": 4, "op5": 4, "op8": 4, "op9": 4, "op10": 6}


def test_memory_does_not_follow_the_text(long_text):
    for name, run in _runs(long_text).items():
        run()  # caches and tables of the models are there before
        assert peak_of(run) < ALLOWED[name] * len(long_text), name


def test_signatures_of_a_long_text(long_text):
    def run():
        for _, words, offsets in common.whole_word_blocks(pa.array([long_text])):
            h, owner, weight = dartminhash._counted(*dartminhash._shingles(words, offsets))
            dartminhash.signatures(h, weight, owner, 1, 144)

    assert peak_of(run) < 12 * len(long_text)


def test_pieces_give_what_the_whole_text_gives(monkeypatch):
    draw = random.Random(1)
    words = LINE.split() + ["scumbag", "idiot", "GPL", "!!!", "naïve", "Straße"]
    texts = pa.array([" ".join(draw.choice(words) + ("\n" if draw.random() < 0.1 else "") for _ in range(draw.randint(1, 3000))) for _ in range(12)] + ["", None])
    labelled = [(k, " ".join(draw.choice(words) for _ in range(60)), k % 2) for k in range(80)]
    toxic, good = toxicity.fit(labelled), quality.fit(labelled)
    tongue = language.fit({"en": {w: 1.0 for w in LINE.lower().split()}, "xx": {"zzz": 1.0}}, language.default_vocabulary())

    def results():
        names, scores = language._Scorer(tongue)(texts)
        words = np.concatenate([h for _, h, _ in common.whole_word_blocks(texts)])
        return toxicity._Scorer(toxic)(texts), quality.features(texts), names, scores, words

    whole = results()
    original = common.raw_blocks
    monkeypatch.setattr(common, "raw_blocks", lambda column, block=0: original(column, 900))
    cut = results()
    assert np.allclose(whole[0], cut[0]) and whole[2] == cut[2] and np.allclose(whole[3], cut[3])
    assert np.allclose(whole[1], cut[1])
    assert (whole[4] == cut[4]).all()


def test_signatures_equal_those_of_short_blocks(monkeypatch):
    text = pa.array([LINE * 200, LINE * 3, "x y"])

    def result():
        out = []
        for _, words, offsets in common.whole_word_blocks(text):
            h, owner, weight = dartminhash._counted(*dartminhash._shingles(words, offsets))
            out.append(dartminhash.signatures(h, weight, owner, len(offsets) - 1, 144))
        return np.concatenate(out)

    whole = result()
    original = common.raw_blocks
    monkeypatch.setattr(common, "raw_blocks", lambda column, block=0: original(column, 700))
    assert (result() == whole).all()
