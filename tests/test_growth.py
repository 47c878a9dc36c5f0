"""What a query moves, keeps or broadcasts must not outgrow its input."""

import pytest
from pyspark.sql import functions as F

from vaultspark.operators import gold, quality
from vaultspark.operators.cdc import upsert_latest
from vaultspark.operators.layout import exact_quantiles, order_on_disk
from vaultspark.operators.loaders import changed_rows, changed_rows_pruned, new_by_key, split_by_repeats
from vaultspark.plans.bank import _days
from vaultspark.plans.star import fact
from vaultspark.sources.store import VersionedTable
from vaultspark.streaming import flows
from vaultspark.streaming.bank import BankVault
from vaultspark.streaming.flows import Governance, detecting_changes

from tests.test_bank import frame
from tests.test_bank_vault import landed, settings


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _satellite(spark, time="2026-01-01"):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "h string, Hash_Diferenciador string, v int")
    return rows.withColumn("FechaRegistro", F.lit(time).cast("timestamp"))


def test_growing_sides_are_not_broadcast(spark):
    one = _satellite(spark)
    hub = one.select("h", F.col("v").alias("id"))
    dimension = gold.type1_dimension(hub, "h", ["id"], [(one, ["v"])], "key", ["key", "h", "id", "v"], "dim")
    for rows in (dimension, changed_rows(one, one, "h"), new_by_key(hub, hub, ["h"])):
        assert "Broadcast" not in _plan(rows)
    assert {(r["h"], r["v"]) for r in dimension.collect()} == {("a", 1), ("b", 2)}


def test_fact_moves_rows_by_their_own_keys(spark, sf_dir):
    plan = _plan(fact(spark, sf_dir))
    moved = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert moved and not [line for line in moved if "hashpartitioning(Hash_" in line] and "Broadcast" not in plan


def test_satellites_beside_their_hub_are_not_joined(spark):
    one = _satellite(spark)
    plan = _plan(gold.type1_dimension(one, "h", [], [(one, ["v"]), (one, ["Hash_Diferenciador"])], "key", ["key", "h", "v", "Hash_Diferenciador"], "dim"))
    assert "Exchange" not in plan and "Join" not in plan


def test_exact_quantiles_as_percentile_disc(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("v"), F.lit(0).alias("w")).unionByName(spark.createDataFrame([(None, 1)] * 50, "v long, w int"))
    shares = [0.0, 0.1, 0.4, 0.42, 0.999, 1.0]
    want = df.selectExpr(*[f"percentile_disc({s}) WITHIN GROUP (ORDER BY v)" for s in shares]).first()
    assert exact_quantiles(df, "v", shares) == list(want)
    assert exact_quantiles(df.filter("v < 0"), "v", [0.5]) == [None]


def test_order_on_disk_in_blocks(spark, tmp_path):
    values = [1, 5, 4, 6, 7, 3, 8, 9, 2]  # 4, 3 and 2 come after larger ones
    spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.parquet(str(tmp_path / "t"))
    for block in (1, 2, 3, 5, 100):
        files = order_on_disk(spark.read.parquet(str(tmp_path / "t")), ["v"], block)
        assert [(r["n"], r["back"], r["low"]["v"], r["high"]["v"]) for r in files.collect()] == [(9, 3, 1, 9)]


def test_pruned_changes_are_the_changes(spark):
    made = lambda n, day: spark.range(n).select(F.when(F.col("id") % 50 != 7, (F.col("id") * 7 % 400).cast("string")).alias("h"), (F.col("id") * day % 13).cast("string").alias("Hash_Diferenciador"), F.lit(f"2026-01-0{day}").cast("timestamp").alias("FechaRegistro"), F.col("id").alias("wide"))
    batch, target = made(900, 2), made(300, 1)
    for held in (None, target):
        want = sorted(map(str, changed_rows(batch, held, "h").collect()))
        for words in (1, 4, 1 << 10):
            assert sorted(map(str, changed_rows_pruned(batch, held, "h", words=words).collect())) == want and want


def test_rows_are_dealt_while_they_are_narrow(spark, sf_dir):
    """Before they have the source's columns, most of which are made from a row's number."""
    for source, number in (("TRXPFL", "o_orderkey"), ("BLNCFL", "o_orderkey"), ("CMSTFL", "c_custkey")):
        for rows in _days(spark, sf_dir, source):
            above, *below = _plan(rows).split("Exchange hashpartitioning")
            assert below and f"({number}#" in below[0] and " INTERVAL " not in "".join(below) and "Broadcast" not in above and len(rows.columns) >= 60


@pytest.mark.parametrize("source, kind, row", [("TRXPFL", "Sat_Transaccion", {"TRXID": "t1", "CUSTID": 1, "TRXAMT": 5.0}), ("BLNCFL", "Sat_Operacion", {"CUSTID": 1, "BLSQ": 2})])
def test_batches_are_not_copied_on_the_way(spark, tmp_path, monkeypatch, source, kind, row):
    for module in (quality, flows):
        monkeypatch.setattr(module, "stored", lambda *a: pytest.fail("rows of a batch are copied"))
    for day in (1, 2):
        vault = BankVault(spark, settings(tmp_path), f"2026-01-0{day}")
        landed(vault, source, frame(spark, kind, [row]), day)
    assert vault.table(f"{kind}_Montos").read().count() == (2 if source == "TRXPFL" else 1)


def test_latest_versions_are_kept_in_short_and_rules_hold_for_all_rows(spark, tmp_path):
    """Also for rows that change nothing, which no target gets."""
    told, table = [], VersionedTable(spark, str(tmp_path / "t"))
    rules = {"drop": {"kept": "v <> 3"}, "warn": {"small": "v < 2"}, "fail": {"set": "v IS NOT NULL"}}
    handle = detecting_changes(table, "h", "c", "t", under=Governance(rules, "e", lambda batch, counts: told.append((batch, counts))))
    rows = lambda t, values: spark.createDataFrame([(str(v), f"{v}" * 128, t, v) for v in values], "h string, c string, t long, v int")
    handle(rows(1, [1, 2, 3, 2]), 0)
    handle(rows(2, [1, 2, 3]), 1)
    with pytest.raises(quality.QualityError, match="set"):
        handle(rows(3, [1, 4, None]), 2)
    latest = VersionedTable(spark, f"{table.path}-latest")
    assert table.last_batch == latest.last_batch == 1
    handle(rows(3, [1, 4]), 2)
    assert sorted((r["h"], r["t"]) for r in table.read().collect()) == [("1", 1), ("2", 1), ("4", 3)]
    assert told == [(b, {"drop": {"kept": d}, "warn": {"small": s}, "fail": {"set": 0}}) for b, d, s in ((0, 1, 3), (1, 1, 2), (2, 0, 1))]
    assert {(len(r["h"]), len(r["c"])) for r in latest.read().collect()} == {(16, 32)}


def test_upserts_move_hashes_as_bytes_and_make_derived_columns_again(spark):
    rows = lambda t, ids: spark.createDataFrame([(i, t) for i in ids], "i long, t long").select("i", F.sha2(F.col("i").cast("string"), 256).alias("h"), F.lit("x").alias("s"), "t")
    old, new, derived = rows(1, range(50)), rows(2, range(25, 75)).union(rows(0, range(10))), {"h": F.sha2(F.col("i").cast("string"), 256)}
    want = sorted(map(tuple, upsert_latest(old, new, ["i"], ["t"]).collect()))
    assert len(want) == 75 and sorted(map(tuple, upsert_latest(old, new, ["i"], ["t"], derived).collect())) == want
    again = upsert_latest(old, new, ["h"], ["t"], hashes=["h"])
    assert again.columns == old.columns and sorted(map(tuple, again.collect())) == want
    assert "unhex" in _plan(again) and "h#" not in _plan(upsert_latest(old, new, ["i"], ["t"], derived)).split("Exchange")[1]


def test_dimensions_move_the_columns_that_they_show(spark):
    """Of a satellite's other columns, which the hub's rows don't need, none takes part in a shuffle."""
    one = _satellite(spark).withColumn("wide", F.lit("w"))
    later = one.withColumn("FechaRegistro", F.lit("2026-01-02").cast("timestamp")).withColumn("v", F.col("v") + 10).limit(1)
    tied = one.withColumn("Hash_Diferenciador", F.lit("z" * 128)).withColumn("v", F.lit(7))
    history = spark.createDataFrame(one.union(later).union(tied.limit(1)).collect(), one.schema)
    dimension = gold.type1_dimension(one.select("h"), "h", [], [(history, [F.col("v").alias("shown")])], "key", ["key", "h", "shown"], "dim")
    assert "wide" not in _plan(dimension).split("Exchange", 1)[0] and {(r["h"], r["shown"]) for r in dimension.collect()} == {("a", 11), ("b", 2)}
    assert [r["v"] for r in gold.current_columns(tied.union(one), "h", ["v"]).collect()] == [7, 7]


def test_rows_whose_key_is_alone_stay_where_they_are(spark):
    rows = lambda t, ids: spark.createDataFrame([(i, t) for i in ids], "i long, t long")
    old, new = rows(1, [*range(50), None]), rows(2, [3, 7, 60, 60, None])
    want = sorted(map(str, upsert_latest(old, new, ["i"], ["t"]).collect()))
    assert len(want) == 52 and sorted(map(str, upsert_latest(old, new, ["i"], ["t"], sparse=True).collect())) == want
    assert sorted(map(str, upsert_latest(None, old.union(new), ["i"], ["t"], sparse=True).collect())) == want
    once, several = split_by_repeats(old.union(new), ["i"])
    assert once.count() == 48 and several.count() == 8 and "Exchange hashpartitioning" not in _plan(once)
    for words in (1, 2):  # few bits let more rows through, never fewer
        once, several = split_by_repeats(old.union(new), ["i"], words)
        assert once.count() + several.count() == 56 and several.count() >= 8


def test_digests_of_long_texts_beyond_ascii_tell_versions_apart(spark):
    rows = lambda t, ends: spark.createDataFrame([(str(i), "ñ€" * 20 + end, t) for i, end in enumerate(ends)], "h string, c string, t long")
    held, batch = rows(1, "abc"), rows(2, "axc")
    for words in (1, 1 << 10):
        assert [r["h"] for r in changed_rows_pruned(batch, held, "h", "c", "t", words).collect()] == ["1"]
