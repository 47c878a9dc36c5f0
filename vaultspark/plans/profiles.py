"""Profiles of tables and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.operators import profile
from vaultspark.operators.cdc import snapshot_differences, write_leaves
from vaultspark.plans.registry import also, query, table
from vaultspark.plans.vault import DAY_1, DAY_2, SQL_DAY_2, day_2
from vaultspark.sources.scratch import scratch_path, stored


@query(f"WITH {SQL_DAY_2} SELECT c_custkey, c_acctbal FROM day_2")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    both = customer.withColumn("day", F.lit(DAY_1).cast("date")).unionByName(day_2(customer).withColumn("day", F.lit(DAY_2).cast("date")))
    return profile.latest_snapshot(both, "day").select("c_custkey", "c_acctbal")


@query("""WITH v AS (SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS "column", unnest([o_orderstatus, o_orderpriority]) AS value FROM orders)
SELECT "column", value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY "column"), 6) AS share FROM v GROUP BY 1, 2""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_distribution(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c in _NUMBERS))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(table(spark, sf_dir, "lineitem"), list(_NUMBERS))


_COVERAGE = """b AS (SELECT p.k AS p, n.n FROM p FULL OUTER JOIN n ON p.k = n.k)
SELECT count(p) AS parents, count(*) FILTER (p IS NOT NULL AND n IS NOT NULL) AS covered, CAST(coalesce(sum(n) FILTER (p IS NULL), 0) AS BIGINT) AS orphans, min(n) FILTER (p IS NOT NULL) AS least,
  max(n) FILTER (p IS NOT NULL) AS most, round(avg(n) FILTER (p IS NOT NULL), 4) AS mean, quantile_cont(n, 0.95) FILTER (p IS NOT NULL AND n IS NOT NULL) AS p95 FROM b"""


@query(f"WITH n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT DISTINCT c_custkey AS k FROM customer), {_COVERAGE}")
def referential_coverage_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against all customers."""
    return profile.coverage(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


also(referential_coverage="referential_coverage_whole")


@query(f"WITH {SQL_DAY_2}, n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT DISTINCT c_custkey AS k FROM day_2), {_COVERAGE}")
def referential_coverage_day_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against the customers of the second snapshot, which lacks some and adds some without orders."""
    return profile.coverage(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), day_2(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("k")), "k")


@query(f"""WITH {SQL_DAY_2}, b AS (SELECT a.c_custkey AS ka, d.c_custkey AS kb, a.c_acctbal <> d.c_acctbal AS m, a.c_name <> d.c_name AS n FROM customer a FULL OUTER JOIN day_2 d ON a.c_custkey = d.c_custkey)
SELECT unnest(['c_acctbal', 'c_name']) AS "column", unnest([round(avg(CAST(m AS INT)), 6), round(avg(CAST(n AS INT)), 6)]) AS rate, count(*) FILTER (ka IS NULL) AS added, count(*) FILTER (kb IS NULL) AS removed FROM b""")
def field_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    parts = day_2(customer).filter("c_custkey % 5 <> 0 AND c_custkey < 1000000"), day_2(customer).filter("c_custkey % 5 = 0 AND c_custkey < 1000000"), day_2(customer).filter("c_custkey >= 1000000")
    return profile.change_rates(customer, profile.mutated(*parts), "c_custkey", ["c_acctbal", "c_name"])


@query(f"""WITH {SQL_DAY_2.replace("c_custkey % 5 = 0", "c_custkey % 160 = 0")}, b AS (SELECT a.c_custkey AS ka, d.c_custkey AS kb, a.c_acctbal <> d.c_acctbal AS m, a.c_name <> d.c_name AS n FROM customer a FULL OUTER JOIN day_2 d ON a.c_custkey = d.c_custkey)
SELECT unnest(['c_acctbal', 'c_name']) AS "column", unnest([round(avg(CAST(m AS INT)), 6), round(avg(CAST(n AS INT)), 6)]) AS rate, count(*) FILTER (ka IS NULL) AS added, count(*) FILTER (kb IS NULL) AS removed FROM b""")
def field_change_rate_by_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots that differ in few rows, kept with their digests: only leaves that differ are read, and the rates are those of all rows."""
    customer, path = table(spark, sf_dir, "customer"), scratch_path(spark, "snapshots")
    before, after = f"{path}-1", f"{path}-2"
    write_leaves(customer, ["c_custkey"], before)
    write_leaves(day_2(customer, every=160), ["c_custkey"], after)
    feed = snapshot_differences(spark, before, after, ["c_custkey"])
    rows, removed = spark.read.parquet(f"{before}/digests").agg(F.sum("n")).first()[0], feed.filter("_change_type = 'delete'").count()
    return profile.change_rates_of_differences(feed, ["c_custkey"], ["c_acctbal", "c_name"], rows - removed)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, count(*) - count({c}) AS nulls, true AS distinct_close, true AS quantiles_close FROM lineitem" for c in _NUMBERS))
def column_profile_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of three drops of the line items, kept as sketches and merged: the measures are those of all rows; the estimates of distinct values
    are within 4 % of the exact ones, and the ranks of the quartiles within 2 %."""
    lines, names = table(spark, sf_dir, "lineitem").select("l_orderkey", *_NUMBERS), list(_NUMBERS)
    states = None
    for drop in range(3):
        one = stored(profile.profile_states(lines.filter(F.col("l_orderkey") % 3 == drop), names), "profile")
        states = one if states is None else states.unionByName(one)
    found = stored(profile.finished_profiles(profile.merged_profiles(states), [0.25, 0.5, 0.75]), "profile")
    exact = profile.column_profile(lines, names).select("column", F.col("distinct").alias("_d"))
    cuts = {r["column"]: r["quantiles"] for r in found.collect()}  # a row per column
    # the share of rows below a quantile and up to it enclose its rank
    near = [F.struct(F.lit(c).alias("column"), F.least(*[((F.avg((F.col(c) < q).cast("int")) <= p + 0.02) & (F.avg((F.col(c) <= q).cast("int")) >= p - 0.02)) for p, q in zip((0.25, 0.5, 0.75), cuts[c])]).alias("quantiles_close")) for c in names]
    ranks = lines.agg(F.array(*near).alias("_p")).select(F.explode("_p").alias("_e")).select("_e.*")
    close = F.abs(F.col("distinct") - F.col("_d")) <= F.greatest(0.04 * F.col("_d"), F.lit(1))
    return found.join(exact, "column").join(ranks, "column").select("column", "min", "max", "mean", "nulls", close.alias("distinct_close"), "quantiles_close")
