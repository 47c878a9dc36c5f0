"""As-of joins and levels over time against plain versions."""

import datetime
import random

from vaultspark.operators import analytics


def test_as_of_joins(spark):
    rng = random.Random(2)
    key = lambda: rng.choice([7] * 8 + [1, 2, None])
    history = [(key(), rng.randrange(400), f"h{i}") for i in range(300)]
    history = list({(k, t): (k, t, v) for k, t, v in history}.values())
    asked = [(key(), rng.randrange(-5, 400), i) for i in range(500)] + [(99, 5, 1000)]
    h = spark.createDataFrame(history, "k int, t int, v string").repartition(5)
    a = spark.createDataFrame(asked, "k int, t int, own int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in analytics.as_of(a, h, ["k"], ["t"], ["v"]).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(k, t, i, max(((t2, v) for k2, t2, v in history if k2 == k and t2 <= t), default=(0, None))[1]) for k, t, i in asked]
    assert got == sorted(want, key=str)
    assert analytics.as_of(a.limit(0), h, ["k"], ["t"], ["v"]).count() == 0
    assert {r["v"] for r in analytics.as_of(a, h.limit(0), ["k"], ["t"], ["v"]).collect()} == {None}


def test_levels_follow_keys_that_move(spark):
    day = lambda m, d=5: datetime.date(2026, m, d)
    rows = [(1, day(1), "A", 10.0), (1, day(3), "B", 12.5), (2, day(2), "A", 1.0), (2, day(2, 9), "A", None), (3, day(4), None, 4.0), (2, day(6), "A", 2.0)]
    history = spark.createDataFrame(rows, "k int, t date, g string, v double")
    got = {(r["g"], r["month"].month): float(r["level"]) for r in analytics.levels_over_time(history, "k", ["t"], "g", "v", "t").collect()}
    assert got == {("A", 1): 10, ("A", 2): 10, ("A", 3): 0, ("A", 4): 0, ("A", 5): 0, ("A", 6): 2} | {("B", m): 12.5 for m in range(3, 7)} | {(None, m): 4 for m in range(4, 7)}
