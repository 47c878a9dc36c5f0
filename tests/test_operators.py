"""Functional tests of the library's operators on small rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vaultspark.config import THRESHOLDS, Settings
from vaultspark.functions.classify import channel_class, share_class, threshold_class
from vaultspark.functions.dates import calendar
from vaultspark.functions.keys import bucket, business_key, change_hash, dense_index, keyed_sample, persistent_keys, surrogate_key
from vaultspark.operators import gold, quality
from vaultspark.operators.cdc import arrivals, snapshot_changes, upsert_latest
from vaultspark.operators.layout import closed, keys_first
from vaultspark.operators.loaders import changed_rows, first_per_key, new_by_key
from vaultspark.operators.profile import coverage
from vaultspark.sources.ingest import evolved, fitted
from vaultspark.sources.scratch import scratch_path
from vaultspark.sources.store import VersionedTable
from vaultspark.streaming.flows import appending, ingesting, run_available, run_continuously


def sha(text, bits=256):
    return hashlib.new(f"sha{bits}", text.encode()).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_business_key_of_one_and_several_columns(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(business_key("x")).collect()] == [sha("a"), None, sha("a")]
    assert [r[0] for r in df.select(business_key("x", "y")).collect()] == [sha("a|b"), sha("b"), sha("a")]
    assert [r[0] for r in df.select(business_key("x", "y", null_marker="~")).collect()] == [sha("a|b"), sha("~|b"), sha("a|~")]


def test_change_hash_keeps_its_value_when_a_value_moves_next_door(spark):
    df = spark.createDataFrame([("k", "v", None), ("k", None, "v")], "k string, x string, y string")
    assert len({r[0] for r in df.select(change_hash("k", "x", "y")).collect()}) == 1
    assert len({r[0] for r in df.select(change_hash("k", "x", "y", null_marker="~")).collect()}) == 2
    assert df.select(change_hash("k", "x", "y")).first()[0] == sha("k|v", 512)


def test_surrogate_key_depends_on_its_row_alone(spark):
    few, more = (spark.createDataFrame([(h,) for h in hs], "h string").select("h", surrogate_key("h").alias("id")) for hs in (["a", "b"], ["c", "b", "a"]))
    assert dict(rows(few)) == {k: v for k, v in rows(more) if k != "c"} and len({v for _, v in rows(more)}) == 3


def test_thresholds_have_gaps_unless_asked(spark):
    df = spark.createDataFrame([(0.0,), (1000.0,), (1000.5,), (1001.0,), (-1.0,), (None,)], "v double")
    bands = THRESHOLDS["RANGO_MONTO"]
    assert [r[0] for r in df.select(threshold_class(F.col("v"), bands)).collect()] == ["MICRO", "MICRO", "DESCONOCIDO", "PEQUENA", "DESCONOCIDO", "DESCONOCIDO"]
    assert [r[0] for r in df.select(threshold_class(F.col("v"), bands, gapless=True)).collect()] == ["MICRO", "MICRO", "PEQUENA", "PEQUENA", "DESCONOCIDO", "DESCONOCIDO"]


def test_share_and_channel_classes(spark):
    df = spark.createDataFrame([(0,), (39,), (40,), (99,)], "v int")
    assert [r[0] for r in df.select(share_class(F.col("v"), "abc", (40, 30, 30))).collect()] == ["a", "a", "b", "c"]
    kinds = spark.createDataFrame([("DATM", "ATM"), ("CATM", "POS"), ("X", "ATM"), ("X", "POS"), (None, None)], "k string, c string")
    assert [r[0] for r in kinds.select(channel_class(F.col("k"), F.col("c"))).collect()] == ["RETIRO_ATM", "DEPOSITO_ATM", "OTRA_OP_ATM", "NO_ATM", "NO_ATM"]


def test_dense_index_is_consecutive_over_partitions(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1009).repartition(7)
    got = rows(dense_index(df, ["k"], "i", 5).orderBy("k"), "k", "i")
    assert sorted(i for _, i in got) == list(range(5, 1005)) and [k for k, i in sorted(got, key=lambda r: r[1])] == sorted(k for k, _ in got)
    assert dense_index(df.filter("k < 0"), ["k"]).count() == 0


def test_persistent_keys_keep_old_numbers(spark):
    old = spark.createDataFrame([("b", 1), ("a", 2)], "k string, id long")
    assert rows(persistent_keys(old, spark.createDataFrame([("c",), ("a",), ("d",), ("c",)], "k string"), ["k"], "id")) == [("a", 2), ("b", 1), ("c", 3), ("d", 4)]


def test_samples_are_nested_and_buckets_in_range(spark):
    df = spark.range(5000)
    small, large = ({r[0] for r in keyed_sample(df, p, "id").collect()} for p in (10, 30))
    assert small < large and 350 < len(small) < 650
    assert df.select(bucket(7, "id").alias("b")).agg(F.min("b"), F.max("b")).first()[:] == (0, 6)


def test_hub_loader_takes_each_key_once_and_skips_known_ones(spark):
    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 1)], "k string, v int")
    assert rows(new_by_key(batch, None, ["k"])) == [("a", 1), ("b", 5), (None, 1)]
    assert rows(new_by_key(batch, spark.createDataFrame([("a",)], "k string"), ["k"])) == [("b", 5), (None, 1)]
    assert rows(first_per_key(batch, ["k"], [-F.col("v")])) == [("a", 2), ("b", 5), (None, 1)]


def test_satellite_loader_compares_with_the_latest_version(spark):
    schema = "k string, Hash_Diferenciador string, FechaRegistro int"
    target = spark.createDataFrame([("x", "A", 1), ("x", "B", 2), ("y", "A", 1)], schema)
    batch = spark.createDataFrame([("x", "A", 3), ("x", "A", 3), ("y", "A", 3), ("z", "Q", 3)], schema)
    assert rows(changed_rows(batch, target, "k")) == [("x", "A", 3), ("z", "Q", 3)]
    assert rows(changed_rows(batch, None, "k")) == [("x", "A", 3), ("y", "A", 3), ("z", "Q", 3)]


def test_satellite_loader_with_a_sequence_keeps_a_value_that_returns(spark):
    schema = "k string, Hash_Diferenciador string, FechaRegistro int, n int"
    batch = spark.createDataFrame([("x", "A", 3, 1), ("x", "B", 3, 2), ("x", "B", 3, 3), ("x", "A", 3, 4)], schema)
    assert rows(changed_rows(batch, None, "k", sequence="n"), "n") == [(1,), (2,), (4,)]
    target = spark.createDataFrame([("x", "A", 1, 0)], schema)
    assert rows(changed_rows(batch, target, "k", sequence="n"), "n") == [(2,), (4,)]


def test_upsert_and_change_feed(spark):
    before = spark.createDataFrame([(1, 1, "a"), (2, 1, None), (3, 1, "c")], "k int, s int, v string")
    after = spark.createDataFrame([(1, 2, "b"), (2, 1, None), (4, 2, "d")], "k int, s int, v string")
    assert rows(upsert_latest(before, after, ["k"], ["s"])) == [(1, 2, "b"), (2, 1, None), (3, 1, "c"), (4, 2, "d")]
    feed = snapshot_changes(before, after, ["k"])
    assert rows(feed, "k", "v", "_change_type") == [(1, "a", "update_preimage"), (1, "b", "update_postimage"), (3, "c", "delete"), (4, "d", "insert")]
    assert rows(arrivals(feed, 7, F.lit(None).cast("timestamp")), "k", "VersionCarga") == [(1, 7), (4, 7)]


def test_current_row_ties_go_to_the_larger_change_hash(spark):
    df = spark.createDataFrame([("h", "v1", "2024-01-01", "aaa"), ("h", "v2", "2024-01-01", "zzz"), ("g", "v3", "2023-01-01", "x")], "k string, v string, FechaRegistro string, Hash_Diferenciador string")
    assert rows(gold.current_rows(df, "k"), "k", "v") == [("g", "v3"), ("h", "v2")]


def test_dominant_child_takes_the_largest_sequence_then_hash(spark):
    hub = spark.createDataFrame([("o1", 100), ("o2", 50), ("o3", 100)], "op string, seq int")
    link = spark.createDataFrame([("c", "o1"), ("c", "o2"), ("c", "o3"), ("d", "o2")], "cu string, op string")
    assert rows(gold.dominant_child(hub, link, "cu", "op", "seq")) == [("c", "o3"), ("d", "o2")]


def test_enriched_rows_do_not_fan_out(spark):
    trx = spark.createDataFrame([("t1", "F"), ("t2", "P"), ("t3", "O"), ("t4", "F")], "t string, kind string")
    link = spark.createDataFrame([("t1", "c"), ("t1", "c"), ("t3", "d")], "t string, c string")
    mapping = spark.createDataFrame([("c", 1), ("c", 1)], "c string, id int")
    kinds = F.col("kind").isin("F", "O")
    assert rows(gold.enriched(trx, kinds, link, mapping, "t", "c"), "t", "id") == [("t1", 1)]
    assert rows(gold.resolved(trx, kinds, link, mapping, "t", "c").filter("NOT _ready"), "t") == [("t3",), ("t4",)]


def test_closed_schema_names_column_and_entity(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert closed(df, ["b"], "e").columns == ["b"] and keys_first(df, ["b"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="dim: column c"):
        closed(df, ["a", "c"], "dim")


def test_quality_actions(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    rule = {"positive": "v > 0"}
    assert quality.drop(df, rule).count() == 1 and quality.violations(df, rule).first()[0] == 2
    kept, seen = quality.warn(df, rule)
    assert kept.count() == 3 and seen.get == {"positive": 2}
    with pytest.raises(quality.QualityError, match="positive"):
        quality.enforce(df, rule, "e")
    assert quality.enforce(df.limit(0), rule).count() == 0


def test_calendar_attributes(spark):
    df = spark.sql("SELECT explode(array(date'2024-02-29', date'2024-02-29', date'2023-12-31', NULL)) AS d")
    got = {str(r["FechaClave"]): r for r in calendar(df, "d").collect()}
    assert len(got) == 2 and got["2024-02-29"]["NombreDia"] == "Jueves" and got["2024-02-29"]["DiaDelAnio"] == 60
    assert got["2023-12-31"]["EsFinSemana"] and got["2023-12-31"]["NombreMes"] == "Diciembre" and got["2023-12-31"]["SemanaDelAnio"] == 52


def test_misfits_are_rescued_and_schemas_grow(spark):
    known = spark.createDataFrame([(1, 1.5)], "k int, v double").schema
    drop = spark.createDataFrame([(1, "2.5", "n"), (2, "bad", None)], "k int, v string, more string")
    got = fitted(drop, known)
    assert rows(got) == [(1, 2.5, '{"more":"n"}'), (2, None, '{"v":"bad"}')]
    assert evolved(known, drop.schema).fieldNames() == ["k", "v", "more"] and evolved(None, known) == known


def test_versioned_table_skips_replays_and_upserts_buckets(spark):
    df = spark.createDataFrame([(i, 0, "old") for i in range(20)], "k int, s int, v string")
    table = VersionedTable(spark, scratch_path(spark, "t"))
    assert not table.exists() and table.read() is None
    table.append(df, 0)
    table.append(df, 0)
    assert table.read().count() == 20
    table.replace(table.read().filter("k < 5"), 1)
    assert table.read().count() == 5
    merged = VersionedTable(spark, scratch_path(spark, "u"))
    merged.upsert(df, ["k"], ["s"], 0, buckets=4)
    merged.upsert(spark.createDataFrame([(3, 1, "new"), (99, 1, "new"), (4, -1, "late")], df.schema), ["k"], ["s"], 1, buckets=4)
    got = {r["k"]: r["v"] for r in merged.read().collect()}
    assert len(got) == 21 and got[3] == got[99] == "new" and got[4] == "old" and merged.read().count() == 21


def test_a_stream_reads_each_file_once(spark):
    path = scratch_path(spark, "in")
    df = spark.range(10)
    df.write.parquet(path)
    table = VersionedTable(spark, f"{path}-out")
    for expected in (10, 10, 20):
        if expected == 20:
            df.write.mode("append").parquet(path)
        run_available(spark.readStream.schema(df.schema).parquet(path), appending(table), f"{path}-checkpoint")
        assert table.read().count() == expected


def test_coverage_counts_orphans(spark):
    children = spark.createDataFrame([(1,), (1,), (2,), (9,)], "k int")
    got = coverage(children, spark.createDataFrame([(1,), (2,), (3,)], "k int"), "k").first()
    assert (got["parents"], got["covered"], got["orphans"], got["least"], got["most"], got["mean"]) == (3, 2, 1, 1, 2, 1.5)


def test_settings_have_no_defaults_and_lead_an_ingest(spark, tmp_path):
    with pytest.raises(KeyError, match="vaultspark.bronze_dir"):
        Settings.read(spark)
    given = {"landing_dir": tmp_path / "landing", "bronze_dir": tmp_path / "bronze", "silver_dir": tmp_path / "silver", "gold_dir": tmp_path / "gold", "checkpoint_dir": tmp_path / "checkpoints"}
    given |= {f"{s}_path": f"drops/{s}" for s in ("cmstfl", "trxpfl", "blncfl")} | {f"{s}_schema": f"schemas/{s}" for s in ("cmstfl", "trxpfl", "blncfl")}
    for name, value in given.items():
        spark.conf.set(f"vaultspark.{name}", str(value))
    try:
        settings = Settings.read(spark)
        spark.conf.unset("vaultspark.gold_dir")
        with pytest.raises(KeyError, match="vaultspark.gold_dir"):
            Settings.read(spark)
    finally:
        for name in given:
            spark.conf.unset(f"vaultspark.{name}")
    drop = lambda df, day: df.write.parquet(f"{settings.drops('CMSTFL')}/año=2026/mes=1/dia={day}")
    old = spark.range(3).withColumnRenamed("id", "CUSTID")
    drop(old, 1)
    assert ingesting(spark, settings, "CMSTFL", old.schema, "2026-01-05").read().count() == 3
    new = spark.range(3, 5).selectExpr("id AS CUSTID", "'x' AS CUSEM")
    drop(new, 2)
    for _ in range(2):
        rows = ingesting(spark, settings, "CMSTFL", new.schema, "2026-01-05").read()
    assert sorted((r["CUSTID"], r["CUSEM"], str(r["FechaRegistroParquet"])) for r in rows.collect()) == [(i, "x" if i > 2 else None, f"2026-01-0{1 + (i > 2)}") for i in range(5)]


def test_a_continuous_flow_takes_what_lands_and_resumes(spark, tmp_path):
    path, df = str(tmp_path / "in"), spark.range(10)
    table = VersionedTable(spark, str(tmp_path / "table"))
    (tmp_path / "in").mkdir()
    landed = 0
    for drops in (2, 1):  # the second flow goes on where the first was stopped
        flow = run_continuously(spark.readStream.schema(df.schema).parquet(path), appending(table), f"{path}-checkpoint", "1 second")
        for _ in range(drops):
            df.write.mode("append").parquet(path)
            landed += 10
            flow.processAllAvailable()
            assert table.read().count() == landed
        flow.stop()
