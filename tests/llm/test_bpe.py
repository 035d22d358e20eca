import hashlib
import random

import pytest
import tiktoken

from millrace.llm import bpe


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBPE(bpe.load_ranks(bpe.default_vocabulary()[0]), bpe.default_vocabulary()[1])


@pytest.fixture(scope="module")
def library(ours):
    return tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=ours.ranks, special_tokens={})


ALPHABET = "aabbcc  \n\t\r\x1c\x85\xa0　éñ中文😀'sDLl12½²_-!?\x00‍́"


def test_random_texts_equal_the_library(ours, library):
    draw = random.Random(1)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    for text, joined in zip(texts, ours.encode_all(texts), strict=True):
        ids = [int(x) for x in joined.split()]
        assert ids == library.encode_ordinary(text)
        assert ours.decode_bytes(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, "the" * 9000 + " " * 4000 + "!" * 9000, "<|endoftext|> x", "\n\n\n   x", "\r\n" * 500])
def test_long_pretokens(ours, library, text):
    assert ours.encode(text) == library.encode_ordinary(text)


def test_one_at_a_time_equals_together(ours):
    draw = random.Random(2)
    pieces = ["".join(draw.choice("abcdeé!") for _ in range(draw.randint(2, 40))).encode() for _ in range(800)]
    assert ours.merge_together(pieces) == [ours.merge_alone(p) for p in pieces]


def test_a_vocabulary_whose_merges_open_lower_ranks():
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"abc": 0, b"ab": 5, b"bcd": 2, b"cd": 3, b"abcd": 1}
    ours = bpe.ByteBPE(ranks, r"\S+")
    library = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcdabcab", "ababcdcd", "abcabcd" * 200, "cdab" * 300):
        assert ours.encode(text) == library.encode_ordinary(text)


def test_queue_finds_the_lowest_rank():
    queue, draw, held = bpe.RankQueue(), random.Random(3), {}
    for _ in range(3000):
        if held and draw.random() < 0.5:
            lowest = queue.lowest()
            assert lowest == min(held)
            assert queue.take(lowest) == held.pop(lowest)
        else:
            rank = draw.randrange(50_256)
            queue.bucket(rank).append(1)
            held.setdefault(rank, []).append(1)
    assert queue.lowest() == (min(held) if held else -1)


def test_documents(spark, library):
    texts = ["Hello world", None, "", "naïve café 😀 " * 2000, "Hello world", "x" * 100_000]
    df = spark.createDataFrame([(k if k != 4 else None, t, 7) for k, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = sorted(((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(df).collect()))
    want = []
    for t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digest_documents(df.limit(0)).count() == 0
    back = df.select("text", bpe.decode_column(bpe.encode_column(df.text)).alias("b")).collect()
    assert all(bytes(r.b).decode() == (r.text or "") for r in back)


def test_a_full_cache_starts_anew(ours, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    for text in ("one two three four five six seven eight", "nine ten eleven", "one nine"):
        assert ours.encode(text) == library.encode_ordinary(text)


def test_long_texts_in_slices_equal_the_library(ours, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_CHARS", 50)
    monkeypatch.setattr(bpe, "SLICE_PRETOKENS", 7)
    draw = random.Random(9)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 200))) for _ in range(300)]
    for text, joined, digest in zip(texts, ours.encode_all(texts), bpe._digests(ours, texts), strict=True):
        ids = library.encode_ordinary(text)
        assert [int(x) for x in joined.split()] == ids
        assert digest == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
