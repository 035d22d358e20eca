"""Schemas, scans and sinks of the retrieval engine's tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_COLUMNS = ["search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category"]
ITEM_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_title_raw", T.StringType()),
        T.StructField("item_description_raw", T.StringType()),
        T.StructField("item_infm_params_text", T.StringType()),
        T.StructField("item_category_id", T.LongType()),
        T.StructField("item_microcat_id", T.LongType()),
        T.StructField("item_location_id", T.LongType()),
        T.StructField("item_price", T.DoubleType()),
        T.StructField("item_latitude", T.DoubleType()),
        T.StructField("item_longitude", T.DoubleType()),
        T.StructField("item_rating", T.DoubleType()),
        T.StructField("item_rating_reviews_count", T.DoubleType()),
        T.StructField("item_is_phone_hidden", T.BooleanType()),
        T.StructField("item_is_message_forbidden", T.BooleanType()),
    ]
)
ITEM_COLUMNS = ITEM_SCHEMA.names
QUERY_SCHEMA = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("search_query", T.StringType()),
        T.StructField("search_location_id", T.LongType()),
        T.StructField("search_is_delivery_search", T.IntegerType()),
        T.StructField("search_infm_params_text", T.StringType()),
        T.StructField("search_category", T.LongType()),
    ]
)
ID_COLUMNS = ["item_id", "query_id"]
ITEM_ID = r"^[0-9a-f]{16}$"
QUERY_ID_LENGTH = 16


def standardize(df: DataFrame) -> DataFrame:
    """Decimals become doubles and ids strings, where the columns exist."""
    casts = {f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, T.DecimalType)}
    casts |= {c: F.col(c).cast("string") for c in ID_COLUMNS if c in df.columns}
    return df.withColumns(casts) if casts else df


def load_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table in standard types; only the columns that a plan uses are read."""
    df = standardize(spark.read.parquet(path))
    return df.select(*columns) if columns else df


def _with_schema(schema: T.StructType, extra: T.StructType | None = None):
    names = {f.name: f.dataType for f in [*schema, *(extra or [])]}

    def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
        df = load_table(spark, path)
        missing = [n for n in schema.names if n not in df.columns and (columns is None or n in columns)]
        if missing:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        typed = df.withColumns({c: F.col(c).cast(names[c]) for c in df.columns if c in names})
        return typed.select(*columns) if columns else typed

    return load


#: A click: the query's columns, then the item's.
_QUERY_PART = T.StructType([f for f in QUERY_SCHEMA if f.name != "query_id"])
_load_queries, _load_items = _with_schema(QUERY_SCHEMA), _with_schema(ITEM_SCHEMA)
_load_train = _with_schema(T.StructType([*_QUERY_PART, ITEM_SCHEMA["item_id"], ITEM_SCHEMA["item_title_raw"]]), T.StructType([*ITEM_SCHEMA]))


def load_benchmark_queries(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The benchmark's queries in the types of :data:`QUERY_SCHEMA`; a missing column is an error, further ones stay."""
    return _load_queries(spark, path, columns)


def load_benchmark_items(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The benchmark's items in the types of :data:`ITEM_SCHEMA`."""
    return _load_items(spark, path, columns)


def load_train(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The click log: the columns of a query and the id and title of its item are required, other item columns are typed."""
    return _load_train(spark, path, columns)


def invalid_item_ids(df: DataFrame, column: str = "item_id") -> DataFrame:
    """Rows whose id is not 16 lower-case hexadecimal digits; a null id is one of them."""
    return df.where(F.col(column).isNull() | ~F.col(column).rlike(ITEM_ID))


def invalid_query_ids(df: DataFrame, column: str = "query_id") -> DataFrame:
    """Rows whose id has not 16 characters; a null id is one of them."""
    return df.where(F.col(column).isNull() | (F.char_length(column) != QUERY_ID_LENGTH))


def assert_valid_item_ids(df: DataFrame, column: str = "item_id") -> None:
    n = invalid_item_ids(df, column).count()
    if n:
        raise ValueError(f"{n} rows of {column} are not 16 lower-case hexadecimal digits")


def assert_valid_query_ids(df: DataFrame, column: str = "query_id") -> None:
    n = invalid_query_ids(df, column).count()
    if n:
        raise ValueError(f"{n} rows of {column} have not {QUERY_ID_LENGTH} characters")


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A key of a table's rows that does not depend on their order; nothing but two sums reaches the driver."""
    hashed = F.xxhash64(*columns).cast("decimal(38,0)")
    row = df.agg(F.count("*").alias("n"), F.sum(hashed).alias("s"), F.bit_xor(F.xxhash64(*reversed(columns))).alias("x")).first()
    return hashlib.md5(f"{row['n']}|{row['s']}|{row['x']}".encode()).hexdigest()


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: str = "") -> DataFrame:
    """Reads a finished table, or builds and writes it; ``key`` (see :func:`fingerprint`) keeps stale ones apart."""
    full = f"{path.rstrip('/')}-{key}" if key else path
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{full}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(full)
    return spark.read.parquet(full)


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_training_jsonl(pairs: DataFrame, negatives: DataFrame, path: str, n: int) -> int:
    """JSON lines ``{"query", "pos": [..], "neg": [..]}`` of pairs with at least ``n`` negatives; returns their number.

    ``pairs`` has ``search_query_norm, item_id, query, pos``, ``negatives`` has ``search_query_norm, item_id, negatives``
    (an array of texts).  Only the ``n`` texts that are written go to the join, however long the arrays are.
    """
    heads = negatives.where(F.size("negatives") >= n).select("search_query_norm", "item_id", F.slice("negatives", 1, n).alias("neg"))
    groups = pairs.join(heads, ["search_query_norm", "item_id"]).select("query", F.array("pos").alias("pos"), "neg")
    groups.write.mode("overwrite").json(path)
    return groups.sparkSession.read.schema("query string, pos array<string>, neg array<string>").json(path).count()


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small JSON report, written through Spark so that any file system serves."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def build_store(items: DataFrame, path: str) -> None:
    """``item_id, dense, sparse, tokens`` of encoded items, written once; the _SUCCESS file marks it complete."""
    items.select("item_id", "encoded.dense", "encoded.sparse", "encoded.tokens").write.mode("overwrite").parquet(path)


def load_store(spark: SparkSession, path: str, items: DataFrame | None = None) -> DataFrame:
    """The store, or its part for the given items."""
    store = spark.read.parquet(path)
    return store if items is None else store.join(items.select("item_id").distinct(), "item_id", "left_semi")


class StoreWriter:
    """An append-only store: every part of encoded items is a folder of its own, and only a finished store can be read.

    A part that is appended again under the same name is left as it is, so a run that was broken off goes on where it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, items: DataFrame, part: str) -> bool:
        """Writes a part (``item_id`` and ``encoded``); False if it is there already."""
        folder = f"{self.path}/part={part}"
        if exists(self.spark, f"{folder}/_SUCCESS"):
            return False
        build_store(items, folder)
        return True

    def finalize(self) -> DataFrame:
        """Marks the store as complete and opens it."""
        target = _hadoop_path(self.spark, f"{self.path}/_COMPLETE")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target, True).close()
        return open_store(self.spark, self.path)


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = _hadoop_path(spark, path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def open_store(spark: SparkSession, path: str, items: DataFrame | None = None) -> DataFrame:
    """The rows of a finished store, or those of the given items; of an item in several parts the first part's."""
    if not exists(spark, f"{path.rstrip('/')}/_COMPLETE"):
        raise ValueError(f"the store {path} was not finished")
    # parts are named by their folder, whose value is text whatever it looks like
    rows = spark.read.option("basePath", path).parquet(path).withColumn("part", F.col("part").cast("string"))
    wanted = rows if items is None else rows.join(items.select("item_id").distinct(), "item_id", "left_semi")
    least = wanted.groupBy("item_id").agg(F.min("part").alias("part"))
    return wanted.join(least, ["item_id", "part"]).drop("part")


def write_parts(spark: SparkSession, path: str, keys: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], parts: int, fingerprint_key: str) -> int:
    """Writes ``build`` of each of ``parts`` hashed shares of ``keys`` as a part of its own; returns how many were written.

    Finished parts under the same ``fingerprint_key`` are skipped, so a long run can be broken off and resumed.
    """
    written = 0
    for k in range(parts):
        folder = f"{path.rstrip('/')}/{fingerprint_key}/part={k:05d}"
        if not exists(spark, f"{folder}/_SUCCESS"):
            build(keys.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)).write.mode("overwrite").parquet(folder)
            written += 1
    return written


def load_parts(spark: SparkSession, path: str, parts: int, fingerprint_key: str) -> DataFrame | None:
    """All parts of a resumable run under the key; None if one is missing, as it is for another key (stale results)."""
    folders = [f"{path.rstrip('/')}/{fingerprint_key}/part={k:05d}" for k in range(parts)]
    if not all(exists(spark, f"{f}/_SUCCESS") for f in folders):
        return None
    return spark.read.parquet(*folders)


def latest_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """The folder ``checkpoint-N`` of the greatest number, or None; names of another form are passed over."""
    target = _hadoop_path(spark, folder)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return None
    names = [s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()]
    numbers = [int(n.removeprefix("checkpoint-")) for n in names if n.startswith("checkpoint-") and n.removeprefix("checkpoint-").isdigit()]
    return f"{folder.rstrip('/')}/checkpoint-{max(numbers)}" if numbers else None
