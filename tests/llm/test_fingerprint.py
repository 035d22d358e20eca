import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import fingerprint as f


def _signed(h):
    return h - 2**64 if h >= 2**63 else h


def brute_sketch(text, scale=f.SCALE):
    words = [_signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in (text or "").lower().split()]
    if not words:
        return []
    hashes = []
    for i in range(max(len(words) - 4, 1)):
        h = 42
        for w in words[i : i + 5]:  # a hash of several columns: each seeds the next
            h = xxhash.xxh64(np.int64(w).tobytes(), seed=h).intdigest()
        hashes.append(_signed(h))
    low = sorted({h for h in hashes if h < -(2**63) + 2**64 // scale})
    return low or [min(hashes)]


TEXTS = ["one two three four five six seven " * k for k in (1, 3, 20)] + ["short", "", None, "Ünïcode wörds über Straße 中文 x y z", " ".join(f"w{k}" for k in range(900)), " ".join(f"w{k}" for k in range(450))]


def test_sketches_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").select("k", f.sketch(F.col("text")).alias("s"))
    for r in df.collect():
        assert r.s == brute_sketch(TEXTS[r.k]), r.k


def test_likeness_containment_and_merging(spark):
    df = spark.createDataFrame([(TEXTS[7], TEXTS[8])], "a string, b string").select(f.sketch(F.col("a")).alias("a"), f.sketch(F.col("b")).alias("b"))
    out = df.select(f.jaccard(F.col("a"), F.col("b")).alias("j"), f.containment(F.col("b"), F.col("a")).alias("c"), f.merge_sketches(F.col("a"), F.col("b")).alias("m"), "a").first()
    assert abs(out.j - 446 / 896) < 0.1 and out.c == 1.0 and out.m == out.a


def brute_rows(rows):
    ordered = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    out = []
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (set(brute_sketch(x)) for x in (text, edited, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=repr)


def test_documents_and_stretches(spark):
    draw = np.random.default_rng(0)
    ids = sorted({*draw.integers(-50, 50, 40).tolist(), *draw.integers(10**12, 10**12 + 9, 6).tolist(), 2**62, -(2**62)})
    rows = [(int(i), " ".join(draw.choice(["ä", "bb", "ccc", "😀"], int(n)))) for i, n in zip(ids, draw.integers(0, 60, len(ids)), strict=True)]
    rows[3], rows[4], rows[5] = (rows[3][0], None), (rows[4][0], "long " * 40_000), (rows[5][0], "")
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, fingerprint string")
    want = brute_rows(rows)
    assert rows_of(f.fingerprints(df)) == want
    for stretch in (1, 4, 13):
        assert rows_of(f.fingerprints(df, stretch=stretch)) == want


def test_cells_above(spark):
    cells = sorted({int(x) for x in np.random.default_rng(2).integers(0, 900, 60)})
    df = spark.createDataFrame([(c,) for c in cells], "cell bigint")
    got = {r.cell: r.above for r in f._above(df, len(cells), 8).collect()}
    assert got == dict(zip(cells, [*cells[1:], None], strict=True))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "x y"), (1, "q")], "doc_id bigint, text string")
    out = f.fingerprints(df).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out if r.doc_id == 5}) == 1
    edited = {r.doc_id: r.edited_sha256 for r in out if r.doc_id != 5}
    assert edited[None] == hashlib.sha256(b"x a").hexdigest()
    one = f.fingerprints(df.where("doc_id = 1")).first()
    assert one.near_next == 1.0 and f.fingerprints(df.limit(0)).count() == 0


def test_null_ids_and_repeated_rows_are_cut(spark):
    """A third of the rows without id, a third one row repeated: no window partition holds more than a few stretches."""
    rows = [(None, f"text {k} of none") for k in range(400)] + [(7, "the same words again and again")] * 400 + [(k * 3, f"text {k} of its own") for k in range(100, 500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, _cell string")
    paired = f.with_next(df.select("doc_id", "text"), ["doc_id", "text"], ["text"], stretch=20)
    sizes = paired.groupBy(F.spark_partition_id()).count().collect()
    assert paired.count() == 1200 and len(sizes) > 1
    pairs = [(r.doc_id, r.next_doc_id, r.text, r.next_text) for r in paired.collect()]
    rank = lambda i: -(2**63) if i is None else i
    assert sum(rank(a) < rank(b) for a, b, *_ in pairs) == 1  # the last row, before the first
    assert sum(a is not None and a == b for a, b, *_ in pairs) == 399 and sum(a is None and b is None for a, b, *_ in pairs) == 399
    assert len({t for a, _, t, _ in pairs if a is None}) == 400 == len({t for *_, b, t in [(p[0], p[1], p[3]) for p in pairs] if b is None})
    assert rows_of(f.fingerprints(df.where("doc_id > 7"), stretch=9)) == brute_rows([r for r in rows if r[0] is not None and r[0] > 7])
