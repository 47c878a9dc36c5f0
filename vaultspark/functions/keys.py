"""Hash keys, surrogate keys, buckets and dense row numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.config import SEPARATOR
from vaultspark.sources.scratch import stored


def _texts(columns, null_marker: str | None) -> list[Column]:
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return texts if null_marker is None else [F.coalesce(t, F.lit(null_marker)) for t in texts]


def business_key(*columns, bits: int = 256, separator: str = SEPARATOR, null_marker: str | None = None) -> Column:
    """SHA-2 of the key columns as strings. One column: null stays null. Several are joined by the separator, nulls left out,
    so the key is never null; with null_marker, nulls take part as that text and keep their place."""
    texts = _texts(columns, null_marker)
    return F.sha2(texts[0] if len(texts) == 1 else F.concat_ws(separator, *texts), bits)


def change_hash(entity: str | Column, *columns, separator: str = SEPARATOR, null_marker: str | None = None) -> Column:
    """SHA-512 over an entity's hash and its attributes. Without null_marker a value that moves to an empty neighbouring
    column leaves the hash as it is."""
    return F.sha2(F.concat_ws(separator, *_texts([entity], None), *_texts(columns, null_marker)), 512)


def surrogate_key(hash_column: str | Column) -> Column:
    """A 64-bit key that depends on this row's hash alone; may be negative."""
    return F.xxhash64((F.col(hash_column) if isinstance(hash_column, str) else hash_column).cast("string"))


def bucket(n: int, *columns) -> Column:
    """0 to n - 1 from the columns' hash. pmod, as abs() of the smallest integer overflows under ANSI."""
    return F.pmod(F.hash(*columns).cast("long"), F.lit(n)).cast("int")


def portable_bucket(n: int, *columns) -> Column:
    """As bucket(), from the MD5 of the columns as texts, which any engine can recompute; dearer than bucket(). A null counts as no text."""
    digits = F.substring(F.md5(F.concat_ws(SEPARATOR, *_texts(columns, None))), 1, 13)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n)).cast("int")


def keyed_sample(df: DataFrame, percent: float, *keys, by: Callable[..., Column] = bucket) -> DataFrame:
    """A reproducible share of keys: the same key is in or out in every table and run, and smaller shares are subsets."""
    return df.filter(by(1_000_000, *keys) < int(percent * 10_000))


def dense_index(df: DataFrame, order: list[str], name: str = "row_index", start: int = 0) -> DataFrame:
    """Consecutive numbers from start in the order of the columns. Rows are range-partitioned and sorted; a row's number is
    its place in its partition plus the sizes of those before, so no task sees more than one partition. The columns have to
    order rows fully for numbers to be reproducible."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "dense-index")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(sizes), "_part")  # one row per partition: small whatever the table's size
    return numbered.withColumn(name, (F.col("_before") + F.col("_place") + start).cast("long")).drop("_part", "_place", "_before")


def persistent_keys(existing: DataFrame, keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Keys with a number each: those of existing (columns and name) keep theirs, new ones follow the largest in order."""
    new = keys.select(*columns).distinct().join(existing, columns, "left_anti")
    top = existing.agg(F.coalesce(F.max(name), F.lit(0)).alias("top")).first()["top"]
    return existing.select(*columns, F.col(name).cast("long").alias(name)).unionByName(dense_index(new, columns, name, top + 1))


def index_join(rows: DataFrame, keyed: DataFrame, key: str, order: list[str], by: Column) -> DataFrame:
    """Gives each row the key whose dense index is by modulo the number of keys: every row gets a valid foreign key."""
    indexed = dense_index(keyed.select(*dict.fromkeys([key, *order])), order, "_index")
    n = indexed.count()
    return rows.withColumn("_index", F.pmod(by, F.lit(n)).cast("long")).join(indexed.select("_index", key), "_index").drop("_index")
