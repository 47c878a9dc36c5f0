"""Profiles of snapshots and comparisons between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_snapshot(df: DataFrame, date: str) -> DataFrame:
    """The rows of the last snapshot: a one-row maximum joined back."""
    last = df.agg(F.max(date).alias("_last"))
    return df.join(F.broadcast(last), F.col(date) == F.col("_last")).drop("_last")  # one row


def _unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_e")).select("_e.*")


def value_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and share per value of each column."""
    counts = _unpivot(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("column").agg(F.sum("n").alias("_all"))
    return counts.join(total, "column").select("column", "value", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def _measures(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.round(F.avg(F.col(c).cast("double")), 4).alias("mean"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns]
    return df.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_e")).select("_e.*")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, maximum, mean, nulls and distinct values of numeric columns: one aggregation for all but the distinct values, and for these
    one per column, which reads that column only and combines equal values before its shuffle; no row is copied."""
    distinct = [df.select(c).distinct().agg(F.lit(c).alias("column"), F.count(c).alias("distinct")) for c in columns]
    return _measures(df, columns).join(reduce(DataFrame.unionByName, distinct), "column")


def profile_states(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mergeable profiles of numeric columns, a row each, from one pass: column, n, nulls, min, max, total, a sketch of the distinct values and one of
    the ranks. A snapshot's states are a few kilobytes a column, whatever its rows."""
    value = lambda c: F.col(c).cast("double")
    parts = [
        F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(value(c)).alias("min"), F.max(value(c)).alias("max"), F.sum(value(c)).alias("total"),
                 F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), 14).alias("distinct"), F.kll_sketch_agg_double(value(c), 400).alias("ranks"))
        for c in columns
    ]
    return df.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_e")).select("_e.*")


def merged_profiles(states: DataFrame) -> DataFrame:
    """The states of all rows that the states of several snapshots or drops stand for."""
    sums = [F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("total")]
    return states.groupBy("column").agg(*sums, F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"))


def finished_profiles(states: DataFrame, quantiles: list[float]) -> DataFrame:
    """column, min, max, mean, nulls; distinct, estimated with a relative standard error of about 1.04 / sqrt(2^14) = 0.8 %; and quantiles, whose
    ranks are off by less than 1 % with a chance of 99 %. Quantiles are null where a column has nothing but nulls."""
    some = F.col("n") > F.col("nulls")
    ranks = F.when(some, F.kll_sketch_get_quantile_double("ranks", F.array(*map(F.lit, quantiles))))
    return states.select("column", "min", "max", F.round(F.try_divide("total", F.col("n") - F.col("nulls")), 4).alias("mean"), "nulls", F.hll_sketch_estimate("distinct").alias("distinct"), ranks.alias("quantiles"))


def coverage(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Share of parents with children, orphans, and children per parent: min, max, mean, 95th percentile."""
    per = children.groupBy(key).agg(F.count("*").alias("_n"))
    both = parents.select(key).distinct().withColumn("_p", F.lit(1)).join(per, key, "full_outer")
    has = F.col("_p").isNotNull() & F.col("_n").isNotNull()
    n = F.when(has, F.col("_n"))
    return both.agg(F.count("_p").alias("parents"), F.count_if(has).alias("covered"), F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"), F.percentile(n, 0.95).alias("p95"))


def change_rates(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Share of changed values per column over keys in both, and the numbers of new and removed keys."""
    a = before.select(key, F.struct(*columns).alias("a"))
    b = after.select(key, F.struct(*columns).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return _rates(a.join(b, key, "full_outer"), columns, F.count_if(both))


def change_rates_of_differences(differences: DataFrame, keys: list[str], columns: list[str], kept: int) -> DataFrame:
    """change_rates() from a feed of the differences alone (as snapshot_changes() gives): kept is how many keys are in both snapshots, from
    their digests."""
    side = lambda *kinds: F.max(F.when(F.col("_change_type").isin(*kinds), F.struct(*columns)))
    pairs = differences.groupBy(*keys).agg(side("update_preimage", "delete").alias("a"), side("update_postimage", "insert").alias("b"))
    return _rates(pairs, columns, F.lit(kept))


def _rates(pairs: DataFrame, columns: list[str], kept) -> DataFrame:
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    changed = [F.count_if(both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"_{i}") for i, c in enumerate(columns)]
    out = pairs.agg(*changed, kept.alias("_kept"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"))
    rate = lambda i: F.round(F.try_divide(F.col(f"_{i}"), F.col("_kept")), 6)
    return out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), rate(i).alias("rate")) for i, c in enumerate(columns)])).alias("_e"), "added", "removed").select("_e.*", "added", "removed")


def mutated(unchanged: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """A next snapshot from its three parts, aligned by name."""
    return unchanged.unionByName(changed).unionByName(new)
