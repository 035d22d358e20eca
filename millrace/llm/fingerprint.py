"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch retains every shingle hash below a fixed fraction of the hash range, so its size follows the document's and two
sketches of very unequal documents still compare: Jaccard similarity and containment are those of the retained hashes,
and the sketch of a union is the union of sketches.  A text none of whose hashes is below the fraction retains its least
one, so that no text with a word has an empty sketch; :func:`merge_sketches` keeps to the same rule.

The shingles are of five words (runs of non-space characters, lower case); a shorter text is one shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import materialize

SHINGLE_WORDS = 5
#: A hash is retained if it is among the lowest 1 / SCALE of all 64-bit values.
SCALE = 4
#: About how many documents of the order by id are one window partition.
STRETCH = 512
#: Cuts of the order that are set by a sample, at most, and rows of the sample for each (in expectation).
CUTS, SAMPLE = 400, 20


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _limit(scale: int) -> int:
    return -(2**63) + 2**64 // scale


def sketch(text: Column, scale: int = SCALE) -> Column:
    """``array<bigint>``, sorted: the retained hashes of a text; empty for a text without words."""
    hashed = F.transform(_words(text), lambda w: F.xxhash64(w))

    def retained(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(1), F.greatest(n - SHINGLE_WORDS + 1, F.lit(1)))
        windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + (k - 1)) for k in range(SHINGLE_WORDS))))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(_let(windows, lowest))

    def lowest(windows: Column) -> Column:
        low = F.filter(windows, lambda h: h < F.lit(_limit(scale)))
        return _let(low, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(F.array(F.array_min(windows))))

    return _let(hashed, retained)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a transformation of a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 if the first has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def merge_sketches(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the shingles of both texts."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: h < F.lit(_limit(scale)))
    return F.when(F.size(low) > 0, F.array_sort(low)).when(F.size(both) > 0, F.array(F.array_min(both))).otherwise(both)


def as_string(hashes: Column) -> Column:
    """The retained hashes in hexadecimal, joined by spaces."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), " ")


def _above(cells: DataFrame, n: int, block: int = 4096) -> DataFrame:
    """``cell, above``: for each of ``n`` distinct numbers the next greater one; null for the greatest.

    Up to ``block`` numbers are one window; more are cut into blocks by value, whose ends meet by the same rule one level
    up, so no task sees more than ``block`` rows.
    """
    if n <= block:
        return cells.select("cell", F.lead("cell").over(Window.orderBy("cell")).alias("above"))
    cut = cells.select("cell", F.floor(F.col("cell") / block).cast("bigint").alias("block"))
    inner = cut.select("cell", "block", F.lead("cell").over(Window.partitionBy("block").orderBy("cell")).alias("inner"))
    blocks = materialize(cut.groupBy("block").agg(F.min("cell").alias("least")), "blocks")
    up = _above(blocks.select(F.col("block").alias("cell")), blocks.count(), block)
    joined = up.join(blocks.select(F.col("block").alias("above"), F.col("least").alias("next_least")), "above", "left").select(F.col("cell").alias("block"), "next_least")
    return inner.join(joined, "block", "left").select("cell", F.coalesce("inner", "next_least").alias("above"))


_MIN, _MAX = -(2**63), 2**63 - 1


def _edges(cuts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Where ids, and (id, tie) pairs, that several cuts share begin and end, so that they are mixed with no others."""
    out = []
    for (k, t, _), (k2, t2, _) in zip(cuts, cuts[1:], strict=False):
        if k == k2:
            out += [(k, _MIN, _MIN), *([(k + 1, _MIN, _MIN)] if k < _MAX else [])]
            if t == t2:
                out += [(k, t, _MIN), *([(k, t + 1, _MIN)] if t < _MAX else [])]
    return out


def with_next(docs: DataFrame, columns: list[str], tie: list[str], derived: dict[str, Column] | None = None, stretch: int = STRETCH) -> DataFrame:
    """``columns`` of ``docs`` and ``next_<column>``: those of the following row in descending ``doc_id``, circular.

    ``derived`` columns are computed once from each row, behind the exchange, so that they are not part of it.

    Rows are ordered by id, rows of one id by a hash of ``tie``, repeated rows by a random number; rows of null ids come
    last.  That order is cut into stretches: at a bounded sample of its rows, at the ends of ids (and ties) that hold
    several of those cuts, and evenly between: so neither null ids nor a repeated row are one stretch.  A stretch is one
    window partition, so no task sees all rows; the first row of a stretch also goes, as the last one, to the stretch before
    it (that of the whole order to the last stretch).
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_MIN))
    number = (F.rand(5) * F.lit(float(1 << 62))).cast("bigint")
    numbered = docs.select(*columns, key.alias("_key"), F.xxhash64(*tie).alias("_tie"), number.alias("_n"))
    n = docs.count()
    wanted = min(CUTS, n // stretch)
    cuts: list[tuple[int, int, int]] = []
    if wanted > 1:
        share = min(1.0, wanted * SAMPLE / n)
        rows = sorted((r["_key"], r["_tie"], r["_n"]) for r in numbered.where(F.rand(6) < share).select("_key", "_tie", "_n").collect())
        cuts = [rows[len(rows) * k // wanted] for k in range(wanted)] if rows else []
        cuts = sorted({*cuts, *_edges(cuts)})
    finer = max(1, n // max(1, len(cuts)) // stretch)
    if len(cuts) > 1:
        at = lambda c: F.struct(*(F.lit(x).cast("bigint").alias(f) for x, f in zip(c, ("a", "b", "c"), strict=True)))
        low = F.array(*(at(c) for c in cuts))
        part = F.size(F.filter(low, lambda c: c <= F.struct(F.col("_key").alias("a"), F.col("_tie").alias("b"), F.col("_n").alias("c"))))  # 0: below all cuts
        start, end = F.element_at(low, F.greatest("_part", F.lit(1))), F.element_at(low, F.least(F.greatest("_part", F.lit(1)) + 1, F.lit(len(cuts))))
        # the first of the three in which the stretch's ends differ tells a row's place in it
        place = lambda f, c: F.try_divide(F.col(c).cast("double") - start[f].cast("double"), end[f].cast("double") - start[f].cast("double"))
        within = F.when(start["a"] < end["a"], place("a", "_key")).when(start["b"] < end["b"], place("b", "_tie")).when(start["c"] < end["c"], place("c", "_n"))
        fine = F.greatest(F.least(F.floor(F.coalesce(within, F.lit(0.0)) * finer), F.lit(finer - 1)), F.lit(0))
        numbered = numbered.withColumn("_part", part)
        cell = (F.col("_part").cast("bigint") * finer + F.when(F.col("_part") > 0, fine).otherwise(0)).cast("bigint")
    else:
        cell = F.lit(0).cast("bigint")
    placed = numbered.select(*columns, "_key", "_tie", "_n", cell.alias("_cell"))
    heads = materialize(placed.groupBy(F.col("_cell").alias("cell")).agg(F.max(F.struct("_key", "_tie", "_n")).alias("head")), "heads")
    number, lowest = heads.agg(F.count("*"), F.min("cell")).first()
    targets = heads.join(_above(heads.select("cell"), number), "cell").select(
        F.col("head._key").alias("_key"), F.col("head._tie").alias("_tie"), F.col("head._n").alias("_n"), F.coalesce("above", F.lit(lowest or 0)).alias("_target")
    )
    targets = materialize(targets, "targets")  # a table of known size, so that a small one is broadcast and texts stay where they are
    extra = placed.join(targets, ["_key", "_tie", "_n"]).select(*columns, "_key", "_tie", "_n", F.col("_target").alias("_cell"), F.lit(1).alias("_extra"))
    both = placed.withColumn("_extra", F.lit(0)).unionByName(extra)
    order = Window.partitionBy("_cell").orderBy("_extra", F.col("_key").desc(), F.col("_tie").desc(), F.col("_n").desc())
    names = [*columns, *(derived or {})]
    followed = both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    if derived:
        followed = followed.withColumns(derived)
        followed = followed.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in derived))
    return followed.where("_extra = 0").select(*names, *(f"next_{c}" for c in names))


def fingerprints(docs: DataFrame, scale: int = SCALE, stretch: int = STRETCH) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last half (``n_chars // 2`` code points) replaced by as many first ones (or all) of the next
    document in descending ``doc_id``, after the last the first.  Columns: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next`` and ``in_edited``, the estimated share of the text's shingles that the
    edited text has.

    Nulls: a null text is an empty one; a null id sorts last and stays null.  Ties: rows of one id follow each other by a
    hash of their text, repeated rows in any order (their texts are equal).  A single row's next document is itself.  Texts
    without words have the empty fingerprint; two of them are alike by 1, one and a text with words by 0.  A very long text
    is fingerprinted whole, in arrays of its words in the executor's memory.  An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(text, ["doc_id", "text"], ["text"], {"sketch": sketch(F.col("text"), scale)}, stretch)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    done = pairs.select("doc_id", n.cast("bigint").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    done = done.select("*", sketch(F.col("edited"), scale).alias("edited_sketch"))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        jaccard(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        jaccard(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"),
    )
