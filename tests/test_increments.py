"""Aggregates kept by increments, and differences of snapshots from their digests, against recomputing."""

import random

import pytest
from pyspark.sql import functions as F

from vaultspark.operators import analytics, cdc, profile
from vaultspark.sources.scratch import scratch_path
from vaultspark.sources.store import VersionedTable
from vaultspark.streaming.flows import aggregating


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_states_of_batches_merge_to_those_of_all_rows(spark, monkeypatch):
    """Members far apart fill several pages, some rows have no member or amount, and nothing but touched buckets' states is read."""
    rng = random.Random(3)
    data = [(m, rng.choice([None, 0, 5, 40_000, 32_768, rng.randrange(200_000)]), rng.choice([None, 1.25, -3.5])) for m in (1, 2, 3, None) for _ in range(300)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i long, month int, member long, amount double")
    states = VersionedTable(spark, scratch_path(spark, "states"))
    handle = aggregating(states, lambda b: analytics.distinct_states(b, ["month"], "amount", "member"), ["month"], buckets=3)
    parts = [rows.filter(F.col("i") % 4 == k) for k in range(4)] + [rows.filter("month = 2"), rows.limit(0)]
    for k, part in enumerate(parts):
        before = states._state()["parts"]
        handle(part, k)
        touched = {b for b, p in states._state()["parts"].items() if before.get(b) != p}
        assert k != 4 or len(touched) == 1
    handle(rows, 5)
    got = {r["month"]: (r["n"], float(r["total"]), r["members"]) for r in analytics.finished_states(states.read(), ["month"]).collect()}
    want = {}
    for k, part in enumerate(parts):
        for r in part.collect():
            n, total, members = want.get(r["month"], (0, 0.0, frozenset()))
            want[r["month"]] = (n + 1, total + (r["amount"] or 0), members | ({r["member"]} - {None}))
    assert got == {m: (n, round(t, 2), len(s)) for m, (n, t, s) in want.items()}


@pytest.mark.parametrize("leaves", [1, 50, cdc.LEAVES])
def test_differences_are_those_of_whole_snapshots(spark, leaves):
    rng = random.Random(leaves)
    before = {i: (rng.choice(["a", "b", None]), rng.randrange(3)) for i in range(3000)}
    after = {i: v for i, v in before.items() if i % 500} | {i + 10**6: ("new", None) for i in range(4)}
    after |= {i: (None, before[i][1]) for i in range(7, 3000, 400)}
    frame = lambda d: spark.createDataFrame([(i, *v) for i, v in d.items()], "k long, v string, w int").repartition(3)
    path = scratch_path(spark, "leaves")
    cdc.write_leaves(frame(before), ["k"], f"{path}-1", leaves)
    cdc.write_leaves(frame(after).select("w", "k", "v"), ["k"], f"{path}-2", leaves)
    got = cdc.snapshot_differences(spark, f"{path}-1", f"{path}-2", ["k"])
    want = cdc.snapshot_changes(frame(before), frame(after), ["k"])
    names = ["k", "v", "w", "_change_type"]
    assert rows_of(got, *names) == rows_of(want, *names) and got.count() > 10
    odd = cdc.differing_leaves(spark, f"{path}-1", f"{path}-2").collect()
    assert len(odd) <= min(leaves, 6 + 4 + 8) and (leaves < cdc.LEAVES or len(odd) > 10)
    read = cdc.read_leaves(spark, f"{path}-1", [tuple(r) for r in odd]).count()
    assert read == 3000 if leaves == 1 else leaves == 50 or read < 40
    assert cdc.snapshot_differences(spark, f"{path}-1", f"{path}-1", ["k"]).count() == 0
    kept = len(before.keys() & after.keys())
    assert rows_of(profile.change_rates_of_differences(got, ["k"], ["v", "w"], kept)) == rows_of(profile.change_rates(frame(before), frame(after), "k", ["v", "w"]))


def test_snapshots_without_rows(spark):
    path, some = scratch_path(spark, "leaves"), spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    cdc.write_leaves(some.limit(0), ["k"], f"{path}-0")
    cdc.write_leaves(some, ["k"], f"{path}-1")
    assert rows_of(cdc.snapshot_differences(spark, f"{path}-0", f"{path}-1", ["k"]), "v", "_change_type") == [("a", "insert"), ("b", "insert")]
    assert rows_of(cdc.snapshot_differences(spark, f"{path}-1", f"{path}-0", ["k"]), "v", "_change_type") == [("a", "delete"), ("b", "delete")]
