"""Waiting transactions, change detection with a hot key, and pruned anti-joins."""

import random

import pytest
from pyspark.sql import functions as F

from vaultspark.operators import gold, loaders
from vaultspark.sources.scratch import scratch_path
from vaultspark.sources.store import VersionedTable
from vaultspark.streaming.flows import detecting_changes, enriching


@pytest.fixture
def path(spark):
    return scratch_path(spark, "flows")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_waiting_rows_get_the_keys_that_hold_when_they_are_appended(spark, path, monkeypatch):
    link = spark.createDataFrame([(f"t{i}", f"c{i % 3}") for i in range(9)], "t string, c string")
    maps = [spark.createDataFrame(m, "c string, id long") for m in ([("c0", 1)], [("c0", 2), ("c1", 2)], [("c0", 3), ("c1", 3), ("c2", 3)])]
    now = [0]
    resolve = lambda rows: gold.resolved(rows, F.col("k") == "A", link, maps[now[0]], "t", "c")
    target, work = VersionedTable(spark, f"{path}-target"), VersionedTable(spark, f"{path}-work")
    handle = enriching(target, work, resolve, ["t", "k"])
    batch = lambda *ids: spark.createDataFrame([(f"t{i}", "B" if i == 8 else "A") for i in ids], "t string, k string")
    handle(batch(0, 1, 2), 0)
    now[0] = 1
    with monkeypatch.context() as m:  # stops after the decisions are written; by the replay the map is another
        m.setattr(target, "append", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            handle(batch(3, 4, 8), 1)
    now[0] = 2
    for _ in range(2):
        handle(batch(3, 4, 8), 1)
    assert rows_of(target.read(), "t", "id") == [("t0", 1), ("t1", 2), ("t3", 2), ("t4", 2)]
    handle(batch(), 2)
    handle(batch(77), 3)  # in no link: waits on
    assert rows_of(target.read(), "t", "id") == [("t0", 1), ("t1", 2), ("t2", 3), ("t3", 2), ("t4", 2)]
    assert rows_of(work.read().filter("NOT _ready"), "t") == [("t77",)]


def test_a_hot_key_is_spread_over_tasks(spark, monkeypatch):
    rng = random.Random(1)
    data = [(7 if i % 10 else i, i, rng.choice("AB"), "x") for i in range(4000)] + [(None, 4000 + i, "A", "x") for i in range(3)]
    df = spark.createDataFrame(data, "k long, seq long, h string, own string").repartition(6)
    seen, stored, coalesced = [], loaders.stored, "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")  # few rows would go to one task
    monkeypatch.setattr(loaders, "stored", lambda df, name: seen.append(stored(df, name)) or seen[-1])
    got = rows_of(loaders.changed_rows(df, None, "k", "h", "seq", "seq"), "k", "seq", "h")
    spark.conf.unset(coalesced)
    last, want = {}, []
    for k, seq, h, _ in data:
        if last.get(k) != h:
            want.append((k, seq, h))
        last[k] = h
    assert got == sorted(want, key=str)
    per_task = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(per_task) == 4 and max(per_task) < 0.5 * len(data)
    target = spark.createDataFrame([(7, "A", 0), (7, "B", -5), (10, "B", 0), (None, "A", 0)], "k long, h string, seq long")
    latest = {7: "A"} | {10: "B"}
    firsts = {k: h for k, _, h in reversed(want)}
    expected = [w for w in want if not (w[0] in latest and w == next(x for x in want if x[0] == w[0]) and firsts[w[0]] == latest[w[0]])]
    assert rows_of(loaders.changed_rows(df, target, "k", "h", "seq", "seq"), "k", "seq", "h") == sorted(expected, key=str)


def test_ranges_without_rows_and_empty_batches(spark):
    df = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B")], "k long, seq long, h string")
    assert rows_of(loaders.preceding(df, ["k"], ["seq"], ["h"]), "seq", "_before.h") == [(1, None), (2, "A"), (3, "A")]
    assert loaders.changed_rows(df.limit(0), df, "k", "h", "seq", "seq").count() == 0


def test_hot_batches_are_compared_with_the_latest(spark, path):
    table = VersionedTable(spark, path)
    handle = detecting_changes(table, "k", "h", "seq", "seq", 3)
    for batch, values in enumerate(("AAB", "BA", "A", "AB")):
        handle(spark.createDataFrame([(1, 10 * batch + i, h) for i, h in enumerate(values)], "k long, seq long, h string"), batch)
    assert rows_of(table.read(), "seq", "h") == [(0, "A"), (11, "A"), (2, "B"), (31, "B")]


@pytest.mark.parametrize("words", [1, 64, 1 << 20])
def test_pruned_anti_join_gives_the_same_rows(spark, words):
    """Few words give many false positives, which cost time only; null keys are never found."""
    target = spark.createDataFrame([(i, f"p{i % 7}", 0) for i in range(3000)] + [(None, "p1", 0), (5, None, 0)], "a long, b string, v long")
    batch = spark.createDataFrame([(i, f"p{i % 7}", 1) for i in range(2950, 3050)] + [(3049, "p4", 2), (None, "p1", 3), (5, None, 4), (6, "p0", 5)], "a long, b string, v long")
    want = rows_of(loaders.new_by_key(batch, target, ["a", "b"]), "a", "b", "v")
    assert rows_of(loaders.new_by_key_pruned(batch, target, ["a", "b"], words=words), "a", "b", "v") == want and len(want) > 50
    left = loaders.may_have_keys(target, batch, ["a", "b"], words).count()
    assert left >= 50 and (words < 1 << 20 or left <= 55)
    assert rows_of(loaders.new_by_key_pruned(batch, None, ["a", "b"]), "a") == rows_of(loaders.new_by_key(batch, None, ["a", "b"]), "a")
