"""Upserts and change feeds without a table log, and snapshots with a tree of digests."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.operators.loaders import split_by_repeats


def upsert_latest(target: DataFrame | None, batch: DataFrame, keys: list[str], sequence: list[str], derived: dict[str, Column] | None = None, hashes: Collection[str] = (), sparse: bool = False) -> DataFrame:
    """Target with batch merged in: per key the row with the largest sequence, ties to the larger of the other columns. One
    aggregation with partial results; rows with a null key are merged as one key. A column that only one side has is null in the
    other's rows. What needn't be moved: derived columns follow from the keys and are made again; hashes are columns of lower-case hexadecimal
    digits, which are moved as bytes; sparse: few keys repeat in the batch or are in both, and only rows of such keys are moved."""
    rows = batch if target is None else target.unionByName(batch, allowMissingColumns=True)
    moved = [c for c in rows.columns if c not in (derived or {})]
    rest = [c for c in moved if c not in keys]
    lead = [F.col(c).alias(f"_s{i}") for i, c in enumerate(sequence)]
    once, several = split_by_repeats(rows, keys) if sparse else (None, rows)
    light = several.select(*[F.unhex(c).alias(c) if c in hashes else F.col(c) for c in moved])
    best = light.groupBy(*keys).agg(F.max(F.struct(*lead, *rest)).alias("_row"))
    out = best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in moved])
    out = out.select(*[F.lower(F.hex(c)).alias(c) if c in hashes else F.col(c) for c in moved])
    out = out.select(*[derived[c].alias(c) if c not in moved else F.col(c) for c in rows.columns])
    return out if once is None else once.unionByName(out)


def snapshot_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The change feed between two snapshots with one row per key: insert, delete, and update_preimage with
    update_postimage for rows whose other columns differ (nulls are equal). Column _change_type comes last."""
    rest = [c for c in after.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("_a"))
    b = after.select(*keys, F.struct(*rest).alias("_b"))
    both = a.join(b, keys, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    event = lambda kind, row: F.struct(F.lit(kind).alias("kind"), F.col(row).alias("row"))
    events = (
        F.when(F.col("_a").isNull(), F.array(event("insert", "_b")))
        .when(F.col("_b").isNull(), F.array(event("delete", "_a")))
        .otherwise(F.array(event("update_preimage", "_a"), event("update_postimage", "_b")))
    )
    out = both.select(*keys, F.explode(events).alias("_e"))
    return out.select(*keys, *[F.col(f"_e.row.{c}").alias(c) for c in rest], F.col("_e.kind").alias("_change_type"))


#: Leaves of the digest tree, and how many of them one branch has.
LEAVES, FAN = 1 << 14, 1 << 7


def in_leaves(snapshot: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """snapshot with _leaf, from the hash of its keys, and _digest of the whole row, nulls told apart from other values."""
    names = sorted(snapshot.columns)
    marked = [F.struct(F.col(c).isNull(), F.col(c)) for c in names]
    return snapshot.withColumn("_leaf", F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")).withColumn("_digest", F.xxhash64(*marked))


def write_leaves(snapshot: DataFrame, keys: list[str], path: str, leaves: int = LEAVES, fan: int = FAN) -> None:
    """Keeps a snapshot as snapshot_differences() reads it: a folder of rows by branch, sorted by leaf so that row groups hold few leaves, and beside
    it a small table of digests: of each leaf the number of rows and two combinations of their digests."""
    rows = in_leaves(snapshot, keys, leaves).withColumn("_branch", F.floor(F.col("_leaf") / fan).cast("int"))
    rows.repartition("_branch").sortWithinPartitions("_branch", "_leaf").write.partitionBy("_branch").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/schema")  # a snapshot without rows has no folder of rows
    kept = snapshot.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    digests = kept.groupBy("_branch", "_leaf").agg(F.count("*").alias("n"), F.bit_xor("_digest").alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "_digest")).alias("y"))
    digests.coalesce(1).write.parquet(f"{path}/digests")  # at most one row per leaf


def differing_leaves(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(_branch, _leaf) whose digests differ. First the branches' digests are compared, made of their leaves', then the leaves of those
    branches that differ; only the tables of digests are read."""
    sides = [spark.read.parquet(f"{p}/digests") for p in (before, after)]
    told = [F.col("n"), F.col("x"), F.col("y")]
    branches = [d.groupBy("_branch").agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("_leaf", *told)).alias("x"), F.bit_xor(F.xxhash64("y", "_leaf", "n")).alias("y")) for d in sides]

    def unlike(pair: list[DataFrame], on: list[str]) -> DataFrame:
        a, b = (d.select(*on, F.struct(*told).alias(name)) for d, name in zip(pair, "ab"))
        return a.join(b, on, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*on)

    odd = unlike(branches, ["_branch"])
    return unlike([d.join(odd, "_branch", "left_semi") for d in sides], ["_branch", "_leaf"])


def read_leaves(spark: SparkSession, path: str, leaves: list[tuple[int, int]]) -> DataFrame:
    """The rows of some leaves (branch, leaf): folders and row groups of others are passed over."""
    rows = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
    wanted = F.col("_branch").isin(sorted({b for b, _ in leaves})) & F.col("_leaf").isin(sorted(x for _, x in leaves))
    return rows.filter(wanted).drop("_branch", "_leaf", "_digest")


def snapshot_differences(spark: SparkSession, before: str, after: str, keys: list[str]) -> DataFrame:
    """snapshot_changes() of two snapshots that write_leaves() has kept, with as many leaves and of the same columns: only rows of leaves whose
    digests differ are read and joined. Two leaves with different rows are taken for equal with a chance of 2^-128."""
    odd = [tuple(r) for r in differing_leaves(spark, before, after).collect()]  # at most LEAVES pairs of numbers
    return snapshot_changes(*(read_leaves(spark, p, odd) for p in (before, after)), keys)


def arrivals(feed: DataFrame, version: int, time) -> DataFrame:
    """What loaders take from a feed: inserts and post-images, with the commit they came in."""
    kept = feed.filter(F.col("_change_type").isin("insert", "update_postimage")).drop("_change_type")
    return kept.withColumn("VersionCarga", F.lit(version).cast("long")).withColumn("FechaCargaBronce", time)
