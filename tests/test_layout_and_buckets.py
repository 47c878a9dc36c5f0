"""Curves through several keys, merges into buckets without a shuffle of the table, and sketches that merge."""

import random

import pytest
from pyspark.sql import functions as F

from vaultspark.operators import layout, profile
from vaultspark.sources.bucketed import BucketedTable
from vaultspark.sources.scratch import scratch_path


def test_a_curve_narrows_every_key(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(10_000), int(rng.paretovariate(0.7)), i) for i in range(8000)] + [(None, 5, -1), (5, None, -2)]
    df = spark.createDataFrame(rows, "a int, b long, own int").withColumn("c", F.timestamp_seconds(F.col("own").cast("long")))
    path = scratch_path(spark, "curve")
    layout.write_curve(df, f"{path}-curve", ["a", "b"], rows_per_file=100)
    layout.write_sorted(df, f"{path}-sorted", ["a", "b"], rows_per_file=100)
    curve, ordered = spark.read.parquet(f"{path}-curve"), spark.read.parquet(f"{path}-sorted")
    assert sorted(map(tuple, curve.select("a", "b", "own").collect()), key=str) == sorted(rows, key=str) and curve.columns[:2] == ["a", "b"]
    for key, low, high, share in (("b", 40, 60, 0.5), ("a", 3000, 3200, 0.5)):
        few, files = layout.files_to_read(curve, key, low, high)
        assert few < share * files
    assert layout.files_to_read(curve, "b", 40, 60)[0] < 0.5 * layout.files_to_read(ordered, "b", 40, 60)[0]
    places = df.select("a", "b", layout.curve_place(df, ["a", "b"], 2).alias("p")).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("p").count().collect()
    assert {r["p"] for r in places} <= set(range(16)) and len(places) >= 8
    layout.write_curve(df.limit(0), f"{path}-none", ["a", "c"])
    assert df.select(layout.curve_place(df, ["c", "a"]).alias("p")).distinct().count() > 500


def test_upserts_into_buckets(spark):
    path = scratch_path(spark, "buckets")
    table = BucketedTable(spark, path, ["k", "j"], ["t"], 4)
    assert table.read() is None and table.last_batch == -1
    rng, want = random.Random(7), {}
    schema = "k int, j int, t int, v string"
    for batch in range(4):
        rows = [(rng.choice([None, *range(30)]), rng.randrange(3), rng.randrange(batch * 5, batch * 5 + 12), f"{batch}-{i}") for i in range(120)]
        for _ in range(2):  # a replay changes nothing
            table.upsert(spark.createDataFrame(rows, schema), batch)
        new = {}
        for k, j, t, v in rows:
            new[k, j] = max(new.get((k, j), (-1, "")), (t, v))
        for at, (t, v) in new.items():
            if at not in want or (t >= want[at][0] if at[0] is not None else (t, v) > want[at]):
                want[at] = (t, v)
    again = BucketedTable(spark, path, ["k", "j"], ["t"], 16)  # another session's view
    assert {(r["k"], r["j"]): (r["t"], r["v"]) for r in again.read().collect()} == want and again.last_batch == 3
    again.upsert(spark.createDataFrame([(1, 1, 99, "x", 5.0)], schema + ", more double"), 4)
    got = {(r["k"], r["j"]): (r["t"], r["v"], r["more"]) for r in again.read().collect()}
    assert got == {at: (*tv, None) for at, tv in want.items()} | {(1, 1): (99, "x", 5.0)}


def test_merges_do_not_shuffle_the_table(spark):
    table = BucketedTable(spark, scratch_path(spark, "buckets"), ["id"], ["t"], 4)
    rows = lambda n: spark.range(n).withColumn("t", F.lit(1)).withColumn("v", F.col("id") % 7)
    table.upsert(rows(50_000), 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = table.merged(rows(500))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*("))
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "SelectedBucketsCount: 4 out of 4" in line)
    above = [line for line in lines[:scan] if depth(line) < depth(lines[scan])]
    join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in above[join:]), plan


def test_sketches_of_drops_merge(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(3000) if rng.random() > 0.1 else None, rng.gauss(0, 10), None) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "a long, b double, c double")
    parts = df.randomSplit([0.5, 0.3, 0.2], 1) + [df.limit(0)]
    states = [profile.profile_states(p, ["a", "b", "c"]) for p in parts]
    merged = profile.merged_profiles(states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3]))
    got = {r["column"]: r for r in profile.finished_profiles(merged, [0.1, 0.5, 0.9]).collect()}
    exact = {r["column"]: r for r in profile.column_profile(df, ["a", "b", "c"]).collect()}
    for c in "abc":
        assert (got[c]["min"], got[c]["max"], got[c]["nulls"]) == (exact[c]["min"], exact[c]["max"], exact[c]["nulls"])
        assert got[c]["mean"] == exact[c]["mean"] if c == "c" else abs(got[c]["mean"] - exact[c]["mean"]) < 1e-3
        assert abs(got[c]["distinct"] - exact[c]["distinct"]) <= 0.03 * exact[c]["distinct"]
    values = sorted(r[1] for r in rows)
    for q, found in zip((0.1, 0.5, 0.9), got["b"]["quantiles"]):
        assert abs(sum(v <= found for v in values) / len(values) - q) < 0.02
    assert got["c"]["quantiles"] is None and exact["c"]["distinct"] == 0
