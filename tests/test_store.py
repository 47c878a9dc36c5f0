"""Versioned tables: writers that die or meet, stale ones, new columns, and change detection against latest versions."""

import pytest
from pyspark.sql import functions as F

from vaultspark.sources.scratch import scratch_path, shared_folder
from vaultspark.sources.store import VersionedTable
from vaultspark.streaming.flows import detecting_changes


@pytest.fixture
def table(spark):
    return VersionedTable(spark, scratch_path(spark, "store"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_a_writer_that_dies_leaves_the_last_state(spark, table, monkeypatch):
    table.append(spark.range(3), 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))  # dies before its state file has its name
        with pytest.raises(KeyboardInterrupt):
            table.append(spark.range(3, 5), 1)
    fs, half = table._file("_NEXT-dead")
    fs.create(half, True).close()  # what a writer leaves that dies while it writes
    assert ids(table.read()) == [0, 1, 2] and table.last_batch == 0 and table.version == 0
    table.append(spark.range(3, 5), 1)
    table.append(spark.range(3, 5), 1)
    assert ids(table.read()) == [0, 1, 2, 3, 4] and len(table._states()) == 2
    for batch in range(2, 6):
        table.append(spark.range(batch + 3, batch + 4), batch)
    assert ids(table.read()) == list(range(9)) and len(table._states()) == 3


@pytest.mark.parametrize("commits", [1, 4])
def test_a_stale_writer_fails(spark, table, monkeypatch, commits):
    """However far behind: the state file of its own number may be gone by then."""
    other = VersionedTable(spark, table.path)
    table.append(spark.range(1))
    before = other._state()
    for i in range(commits):
        table.append(spark.range(i + 1, i + 2))
    monkeypatch.setattr(other, "_state", lambda: before)
    for write in (other.append, other.replace, lambda df: other.upsert(df, ["id"], ["id"])):
        with pytest.raises(RuntimeError, match="another writer"):
            write(spark.range(50, 60))
    assert ids(table.read()) == list(range(commits + 1)) and table.version == commits


def test_of_two_racing_writers_one_fails(spark, table, monkeypatch):
    """The second one commits between the other's look at the newest state and its rename."""
    other, publish = VersionedTable(spark, table.path), VersionedTable._publish
    table.append(spark.range(1))

    def late(self, from_, to):
        if self is table:
            other.append(spark.range(1, 2))
        publish(self, from_, to)

    monkeypatch.setattr(VersionedTable, "_publish", late)
    with pytest.raises(RuntimeError, match="another writer"):
        table.append(spark.range(2, 3))
    assert ids(other.read()) == [0, 1] and other.version == 1


def test_upserts_take_new_columns(spark, table):
    rows = lambda text, schema: spark.createDataFrame(text, schema)
    table.upsert(rows([(i, 1) for i in range(20)], "id long, t long"), ["id"], ["t"], 0, 4)
    table.upsert(rows([(1, 2, "x")], "id long, t long, more string"), ["id"], ["t"], 1, 4)
    table.upsert(rows([(2, 2), (1, 0)], "id long, t long"), ["id"], ["t"], 2, 4)
    table.upsert(rows([(i, 3) for i in (30, 31, 32, 33)], "id long, t long"), ["id"], ["t"], 3, 4)
    got = {r["id"]: (r["t"], r["more"]) for r in table.read().collect()}
    assert got == {i: (1, None) for i in range(20)} | {1: (2, "x"), 2: (2, None)} | {i: (3, None) for i in (30, 31, 32, 33)}


def test_versions_are_compared_with_the_latest_table_alone(spark, table, monkeypatch):
    handle = detecting_changes(table, "id", "h", "t")
    day = lambda t, values: spark.createDataFrame([(i, h, t) for i, h in values], "id long, h string, t long")
    monkeypatch.setattr(table, "read", lambda: pytest.fail("the history is read"))
    handle(day(1, [(1, "A"), (2, "A"), (2, "A")]), 0)
    handle(day(2, [(1, "B"), (2, "A")]), 1)
    handle(day(3, [(1, "A"), (3, "C")]), 2)
    handle(day(3, [(1, "A"), (3, "C")]), 2)
    handle(spark.createDataFrame([], "id long, h string, t long"), 3)
    monkeypatch.undo()
    assert sorted(tuple(r) for r in table.read().select("id", "h", "t").collect()) == [(1, "A", 1), (1, "A", 3), (1, "B", 2), (2, "A", 1), (3, "C", 3)]


def test_a_replay_does_what_a_stopped_batch_left(spark, table, monkeypatch):
    handle = detecting_changes(table, "id", "h", "t")
    rows = spark.createDataFrame([(1, "A", 1)], "id long, h string, t long")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "upsert", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            handle(rows, 0)
    handle(rows, 0)
    handle(rows.withColumn("t", F.lit(2).cast("long")), 1)
    assert table.read().count() == 1


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

        def getConf(self):
            return spark.sparkContext.getConf().set("spark.checkpoint.dir", "")

    class Session:
        sparkContext = Elsewhere()
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
