"""Column order, closed schemas and how tables are laid out on disk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.sources.scratch import stored


def keys_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """The layout columns before the others, so that they are among those with statistics."""
    return df.select(*keys, *[c for c in df.columns if c not in keys])


def require_columns(df: DataFrame, columns: list[str], entity: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{entity}: column {missing[0]} is missing")


def closed(df: DataFrame, columns: list[str], entity: str) -> DataFrame:
    """Exactly these columns; a missing one raises and is named with the entity."""
    require_columns(df, columns, entity)
    return df.select(*columns)


def renamed(df: DataFrame, names: dict[str, str], *more: Column) -> DataFrame:
    """A projection by a mapping of source to target names, and more columns."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items()], *more)


def write_sorted(df: DataFrame, path: str, keys: list[str], partition_by: list[str] = (), rows_per_file: int = 5_000_000, mode: str = "overwrite") -> None:
    """Range-partitioned and sorted by the layout keys, keys first, so that row groups hold narrow ranges of them."""
    out = keys_first(df, keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*partition_by).parquet(path)


def curve_place(df: DataFrame, keys: list[str], bits: int = 6) -> Column:
    """A row's place on a space-filling curve through several keys: the bits of its range ranks, interleaved from the most significant on, the first key
    first. A rank is how many of a key's 2^bits - 1 quantiles (approximate, from one pass) the value reaches, so ranks are even
    whatever the distribution; nulls rank lowest. Keys are numbers, dates or times."""
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    number = {k: F.unix_micros(F.col(k).cast("timestamp")).cast("double") if df.schema[k].dataType.typeName().startswith(("date", "timestamp")) else F.col(k).cast("double") for k in keys}
    found = df.agg(*[F.percentile_approx(number[k], cuts, 1 << (bits + 3)).alias(k) for k in keys]).first()  # 2^bits numbers a key
    place = F.lit(0).cast("long")
    for n, k in enumerate(keys):
        edges = F.array(*[F.lit(float(q)) for q in sorted(set(found[k] or []))] or [F.lit(0.0)])
        value = number[k]
        rank = F.coalesce(F.aggregate(edges, F.lit(0), lambda seen, edge: seen + (value >= edge).cast("int")), F.lit(0))
        for bit in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(keys) + len(keys) - 1 - n))
    return place


def write_curve(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 5_000_000, bits: int = 6, mode: str = "overwrite") -> None:
    """As write_sorted(), along a curve through all keys instead of in order of the first: files and row groups hold a narrow range of every key,
    so a filter on any of them passes over most."""
    out = keys_first(df, keys).withColumn("_place", curve_place(df, keys, bits)).repartitionByRange("_place", *keys).sortWithinPartitions("_place", *keys).drop("_place")
    out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def files_to_read(df: DataFrame, key: str, low, high) -> tuple[int, int]:
    """Of the files of a table that was read as df, how many may hold a key from low to high by their ranges, and how many there are."""
    files = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    row = files.agg(F.count_if((F.col("_low") <= F.lit(high)) & (F.col("_high") >= F.lit(low))), F.count("*")).first()
    return row[0], row[1]


def exact_quantiles(df: DataFrame, key: str, shares: list[float]) -> list:
    """For each share the smallest value that so many of the rows (nulls don't count) are at or below; None without rows. As percentile_disc(), which brings
    every partition's values to one task; here values are counted in tasks by value, a range of values adds up its own counts, and a
    range is one row for the others."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_value")).agg(F.count("*").alias("_n"))
    placed = stored(counts.repartitionByRange("_value").withColumn("_range", F.spark_partition_id()), "quantiles")
    ranges = placed.groupBy("_range").agg(F.sum("_n").alias("_n")).orderBy("_range").collect()  # one row per range
    total, out = sum(r["_n"] for r in ranges), []
    for share in shares:
        rank, before = max(1, math.ceil(total * share)), 0
        for r in ranges:
            if before + r["_n"] >= rank:
                upto = Window.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one range's values
                within = placed.filter(F.col("_range") == r["_range"]).withColumn("_upto", F.sum("_n").over(upto))
                out.append(within.filter(F.col("_upto") >= rank - before).agg(F.min("_value")).first()[0])
                break
            before += r["_n"]
    return out or [None] * len(shares)


#: Rows of a file that are compared in one piece.
BLOCK = 1 << 16


def order_on_disk(df: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Of each file of a table that was read as df: _file (a hash of its path), n, back (rows that come before the one ahead of them), and low and
    high, the ends of its keys. Rows are compared within blocks of a file, so a task holds no file, and a block's ends stand for it
    when blocks are compared."""
    rows = df.select(F.struct(*keys).alias("k"), F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    rows = rows.withColumn("_block", F.floor(F.col("_at") / block))
    rows = rows.withColumn("_back", F.lag("k").over(Window.partitionBy("_file", "_block").orderBy("_at")) > F.col("k"))
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.count_if("_back").alias("back"), F.min("k").alias("low"), F.max("k").alias("high"), F.min_by("k", "_at").alias("_first"), F.max_by("k", "_at").alias("_last"))
    blocks = blocks.withColumn("_back", F.lag("_last").over(Window.partitionBy("_file").orderBy("_block")) > F.col("_first"))  # a file's blocks
    return blocks.groupBy("_file").agg(F.sum("n").alias("n"), (F.sum("back") + F.count_if("_back")).alias("back"), F.min("low").alias("low"), F.max("high").alias("high"))
