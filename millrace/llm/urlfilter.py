"""URL filters by a sort-merge range join over reversed hosts.

A rule is a host and a path prefix; it fits the host, all its subdomains, and the paths that start with the prefix.  With
the host's labels reversed (``example.net`` is ``net.example.``) subdomains share a prefix, so a rule is an interval of
keys.  URLs and rules are cut at common keys into stretches (a rule goes to every stretch its interval meets); in each
stretch one sweep over the sorted keys keeps the stack of hosts with rules whose intervals are open, which are nested.  A
host's path rules nest too: they come in order of the path, each with the nearest one that it lies in, so the longest that
fits a URL is found by bisection and a walk up that chain, and a million rules on one host cost a URL twenty steps.

Stretches are cut by (key, random number) from a bounded sample of rows, so a host with a third of all rows is spread over
several, also if its rows repeat.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a stretch should hold, and those of the sample that sets the cuts, for each stretch.
STRETCH_ROWS = 20_000
SAMPLE = 40
#: Stretches are tasks; beyond so many (some hundred kilobytes of cuts in each task) they grow with the rows, which a task
#: streams in order, so its memory stays the same.
MOST_STRETCHES = 20_000
#: Characters of a key that a cut has; a longer key is above its beginning, so any cut is a valid one.
KEY_CHARS = 300

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end (a port or user name is part of it),
    the path what then follows up to ``?``, ``#`` or the end.
    """
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def reversed_key(host: Column) -> Column:
    """The host's labels in reverse order, each ended by a zero character, which sorts before all others."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\0"), F.lit("\0")))


class HostRules:
    """The path rules of one host: added in order of path, asked for the longest prefix of a path."""

    __slots__ = ("inner", "key", "paths", "rules")

    def __init__(self, key: str):
        self.key, self.paths, self.rules, self.inner = key, [], [], []

    def add(self, path: str, rule: tuple) -> None:
        if self.paths and self.paths[-1] == path:  # of one host and path the later verdict counts
            self.rules[-1] = rule
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.inner[at]
        self.paths.append(path)
        self.rules.append(rule)
        self.inner.append(at)

    def longest(self, path: str) -> tuple | None:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.inner[at]
        return self.rules[at] if at >= 0 else None


def _sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``rows`` of one stretch: (key, is_url, path, name, verdict, id, host), sorted by key with rules before URLs.

    Of the rules that fit the one of the longest text wins, of equally long ones that of the longer host.
    """
    stack: list[HostRules] = []
    for key, is_url, path, name, verdict, page, host in rows:
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        if is_url:
            fits = [rule for open_host in stack if (rule := open_host.longest(path)) is not None]
            rule = max(fits, key=itemgetter(0, 1), default=None)
            yield page, host, path, rule and rule[2], rule and rule[3]
        else:
            if not stack or stack[-1].key != key:
                stack.append(HostRules(key))
            stack[-1].add(path, (len(name), len(host), name, verdict))


_OUT = "page_id bigint, host string, path string, rule string, verdict string"


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id``, ``url``).

    ``rules`` has ``host, path, verdict``; of the rules that fit, the one of the longest text (host and path) wins, of
    equally long ones that of the longer host, then the later in order by path and verdict.  Without one, ``rule`` is
    null and the verdict ``default``.  Ties among URLs: each is judged by itself.  URLs and paths of any length are whole.

    Nulls: a null URL, or one without ``://``, has an empty host and path, which no rule with a host fits; a null id stays
    null; rules with a null host, path or verdict are ignored, a rule with an empty host fits every host.  Repeated rows
    are judged each, repeated rules count once.  Empty tables: no rows, or all rows with the default.  Other columns are
    ignored, whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.when(F.col("host") == "", F.lit("\1")).otherwise(reversed_key(F.col("host"))))
    # a URL's place among the stretches: its key, then a number that splits the rows of one host, whatever they hold
    urls = urls.withColumn("spread", (F.rand(7) * F.lit(float(1 << 62))).cast("bigint"))
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull()).select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict"
    ).distinct().withColumn("key", reversed_key(F.col("host")))
    n = urls.count()
    stretches = int(max(1, min(MOST_STRETCHES, n // STRETCH_ROWS + 1)))
    cuts: list[tuple[str, int]] = []
    if n:
        stretches = max(stretches, min(64, n // 200 + 1))
        share = min(1.0, SAMPLE * stretches / n)
        # chosen by the row, not its values: of repeated rows a share comes, so the sample is bounded; hosts are cut to what orders them
        sample = urls.where(F.rand(11) < share).select(F.substring("key", 1, KEY_CHARS).alias("key"), "spread").collect()
        ordered = sorted((r["key"], r["spread"]) for r in sample)
        cuts = sorted({ordered[len(ordered) * k // stretches] for k in range(1, stretches)}) if ordered else []
    keys = [k for k, _ in cuts]

    @F.arrow_udf("int")
    def stretch(key: pa.Array, spread: pa.Array) -> pa.Array:
        places = zip(key.to_pylist(), spread.to_pylist(), strict=True)
        return pa.array(np.fromiter((bisect_right(cuts, p) for p in places), np.int32, len(key)))

    @F.arrow_udf("array<int>")
    def stretches_of(key: pa.Array) -> pa.Array:
        # from the stretch that holds the interval's start to the one that holds its end
        spans = [range(bisect_right(cuts, (k, -(2**63) - 1)), bisect_right(keys, k + "\U0010ffff") + 1) for k in key.to_pylist()]
        return pa.array([list(s) for s in spans], pa.list_(pa.int32()))

    sides = urls.select(
        stretch(F.col("key"), F.col("spread")).alias("stretch"), "key", F.lit(True).alias("is_url"), "path", F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("verdict"), "page_id", "host",
    ).unionByName(
        known.select(
            F.explode(stretches_of(F.col("key"))).alias("stretch"), "key", F.lit(False).alias("is_url"), "path", F.concat("host", "path").alias("name"),
            "verdict", F.lit(None).cast("bigint").alias("page_id"), "host",
        )
    )
    dealt = sides.repartitionByRange(len(cuts) + 1, "stretch").sortWithinPartitions("stretch", "key", "is_url", "path", "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("stretch", "key", "is_url", "path", "name", "verdict", "page_id", "host")), strict=True)

        def judged() -> Iterator[tuple]:
            for _, group in groupby(rows(), key=itemgetter(0)):
                yield from _sweep(row[1:] for row in group)

        block: list[tuple] = []
        names, types = ("page_id", "host", "path", "rule", "verdict"), (pa.int64(), *[pa.string()] * 4)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*block, strict=True)) or [()] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for page, h, p, rule, verdict in judged():
            block.append((page, h, p, rule, verdict or default))
            if len(block) >= 10_000:
                yield flush()
                block.clear()
        yield flush()

    return dealt.mapInArrow(sweep, _OUT)
