"""Types that widen in any order of drops, schemas on record, and rules on running streams."""

import itertools
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType, StructField, StructType, TimestampType

from vaultspark.functions.types import unified, wider
from vaultspark.operators.quality import QualityError
from vaultspark.sources.ingest import SchemaHistory, bronze_schema, file_stream, ingest_drop
from vaultspark.sources.scratch import scratch_path
from vaultspark.sources.store import VersionedTable
from vaultspark.streaming.flows import RuleCounts, appending, governing, ruled, run_available, sinking

SIMPLE = [ByteType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType(), StringType(), BooleanType(), DateType(), TimestampType(), NullType(), DecimalType(18, 2), DecimalType(30, 10)]


def test_the_lattice_is_one():
    """Idempotent, commutative and, since drops come in any order, associative."""
    some = SIMPLE + [ArrayType(IntegerType()), ArrayType(StringType()), StructType([StructField("a", IntegerType())]), StructType([StructField("a", DoubleType()), StructField("b", DateType())])]
    names = lambda t: sorted(f.name for f in t.fields) if isinstance(t, StructType) else t  # noqa: E731  columns keep the order they came in
    for a, b in itertools.product(some, repeat=2):
        assert wider(a, a) == a and names(wider(a, b)) == names(wider(b, a))
    for a, b, c in itertools.product(SIMPLE, repeat=3):
        assert wider(wider(a, b), c) == wider(a, wider(b, c)), (a, b, c)


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_drops_in_any_order_give_one_schema(spark, order):
    path = scratch_path(spark, "drops")
    table, values = VersionedTable(spark, path), [F.lit(1), F.lit(2).cast("long"), F.lit(2.5).cast("double"), F.lit("x")]
    for batch, i in enumerate(order):
        ingest_drop(spark.range(i, i + 1).select("id", values[i].alias("v"), F.lit(i).alias(f"own_{i}")), table, f"{path}-schema", batch, widen=True)
    rows = table.read()
    assert {f.name: f.dataType.simpleString() for f in rows.schema.fields} == {"id": "bigint", "v": "string", "_rescued_data": "string"} | {f"own_{i}": "int" for i in range(4)}
    assert {r["id"]: (float(r["v"]) if r["v"] != "x" else "x") for r in rows.collect()} == {0: 1.0, 1: 2.0, 2: 2.5, 3: "x"}
    assert rows.filter("_rescued_data IS NOT NULL").isEmpty()


def test_a_crash_between_schemas_leaves_the_last(spark, monkeypatch):
    path = scratch_path(spark, "schema")
    first = bronze_schema(spark.range(1), path)
    with monkeypatch.context() as m:
        m.setattr(SchemaHistory, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            bronze_schema(spark.range(1).withColumn("more", F.lit(1)), path)
    assert SchemaHistory(spark, path).last() == (0, first)
    both = bronze_schema(spark.range(1).withColumn("more", F.lit(1)), path)
    assert SchemaHistory(spark, path).last() == (1, both) and bronze_schema(spark.range(1), path) == both
    assert SchemaHistory(spark, path).last()[0] == 1  # nothing new, no file


def test_tables_read_parts_of_several_types(spark):
    table = VersionedTable(spark, scratch_path(spark, "types"))
    assert unified([spark.range(1), spark.range(2)]).count() == 3
    table.append(spark.sql("SELECT 1 AS a, 'x' AS b"))
    table.append(spark.sql("SELECT 2.5D AS a, DATE '2026-01-01' AS c"))
    table.append(spark.sql("SELECT 'y' AS b, 3L AS a").limit(0))
    assert sorted(((r["a"], r["b"], str(r["c"])) for r in table.read().collect())) == [(1.0, "x", "None"), (2.5, None, "2026-01-01")]
    assert len(table._state()["schemas"]) == 3


RULES = {"drop": {"positive": "v > 0"}, "warn": {"small": "v < 50"}, "fail": {"key": "id IS NOT NULL"}}


def test_rules_on_a_running_stream(spark):
    rng, path, want = random.Random(4), scratch_path(spark, "rules"), {}
    counts, schema = RuleCounts(spark), "id long, v int"

    def land(batch, rows):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/in/{batch}")

    def run():
        sinking(ruled(file_stream(spark, f"{path}/in/*", spark.createDataFrame([], schema).schema), RULES, "r"), f"{path}/out", f"{path}/checkpoint")

    for batch in range(3):
        rows = [(i, rng.choice([None, *range(-20, 100)])) for i in range(200)]
        land(batch, rows)
        run()
        want[batch] = {"rows": 200, "drop positive": sum(not (v is not None and v > 0) for _, v in rows), "warn small": sum(not (v is not None and v < 50) for _, v in rows), "fail key": 0}
    before = sorted(map(tuple, spark.read.parquet(f"{path}/out").collect()))
    land(3, [(1, 5), (None, 5)])
    for _ in range(2):
        with pytest.raises(StreamingQueryException, match="r: a row violates key"):
            run()
        assert sorted(map(tuple, spark.read.parquet(f"{path}/out").collect())) == before
    assert {b: c for b, c in counts.settled()["r"].items() if b < 3} == want
    assert len(before) == sum(c["rows"] - c["drop positive"] for c in want.values())


def test_rules_on_a_batch_function(spark):
    path, told = scratch_path(spark, "governed"), []
    table = VersionedTable(spark, f"{path}-table")
    handle = governing(appending(table), RULES, "r", lambda batch, counts: told.append((batch, counts)))
    spark.createDataFrame([(1, 5), (2, -5), (3, 70)], "id long, v int").write.parquet(f"{path}/0")
    stream = lambda: file_stream(spark, f"{path}/*", table_schema)
    table_schema = spark.read.parquet(f"{path}/0").schema
    run_available(stream(), handle, f"{path}-checkpoint")
    assert told == [(0, {"drop": {"positive": 1}, "warn": {"small": 1}, "fail": {"key": 0}})]
    spark.createDataFrame([(4, 5), (None, 5)], "id long, v int").write.parquet(f"{path}/1")
    with pytest.raises(StreamingQueryException, match="QualityError"):
        run_available(stream(), handle, f"{path}-checkpoint")
    assert sorted(r["id"] for r in table.read().collect()) == [1, 3] and table.last_batch == 0
    with pytest.raises(QualityError, match="key"):
        handle(spark.read.parquet(f"{path}/1"), 1)
