"""Structured Streaming flows: every flow is a batch function of (rows, batch id) over a stream."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from vaultspark.config import Settings
from vaultspark.operators import quality
from vaultspark.operators.analytics import merged_states
from vaultspark.operators.loaders import changed_from_digests, changed_rows, load_time, version_digests
from vaultspark.sources.ingest import file_stream, ingest_drop, with_load_columns, with_parts
from vaultspark.sources.scratch import stored
from vaultspark.sources.store import VersionedTable, touched_buckets


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handles what is there now, in batches, and ends; the checkpoint remembers what has been read."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_continuously(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 minute"):
    """The running query; stop() ends it."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def sinking(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is there now to a table that streams can read: Spark's file sink, which lists the files of finished batches, so
    table_stream() and batch reads see each row once, whatever has failed in between."""
    stream.writeStream.format("parquet").option("compression", "zstd").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a table that sinking() keeps: its rows as they come, each file once."""
    return file_stream(spark, path, spark.read.parquet(path).schema)


def run_available_files(spark: SparkSession, path: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """run_available() over a table that sinking() keeps, where a batch is a table itself: of its files that have come. So whatever is made of it reads
    the columns that it needs, as often as it needs them, and nothing is copied for that; the rows that a stream hands over are read whole by each use."""
    schema = spark.read.parquet(path).schema

    def of_files(rows: DataFrame, batch: int) -> None:
        files = sorted(r[0] for r in rows.distinct().collect())  # names, as many as files
        read = rows.sparkSession.read.schema(schema)
        handle(read.parquet(*files) if files else rows.sparkSession.createDataFrame([], schema), batch)

    run_available(table_stream(spark, path).select("_metadata.file_path"), of_files, checkpoint)


class RuleCounts(StreamingQueryListener):
    """How many rows of each micro-batch break each rule, by the name of the stream's observation: {name: {batch: {rule: rows}}}. Filled by
    the query's progress events; settled() waits for those that are under way."""

    def __init__(self, spark: SparkSession):
        self.spark, self.counts = spark, {}
        spark.streams.addListener(self)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        for name, row in event.progress.observedMetrics.items():
            self.counts.setdefault(name, {}).setdefault(event.progress.batchId, row.asDict())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def settled(self) -> dict:
        """The counts; listens no longer."""
        self.spark._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)
        return self.counts


def ruled(stream: DataFrame, rules: dict[str, dict[str, str]], name: str) -> DataFrame:
    """A stream under rules, {action: {rule name: SQL}}, while it runs: broken rules are counted per micro-batch under the stream's name, for
    RuleCounts; rows that break a drop rule are left out; a row that breaks a fail rule stops the query before the batch is
    committed, so the target stays as it was."""
    every = {f"{action} {rule}": sql for action, some in rules.items() for rule, sql in some.items()}
    watched = stream.observe(name, F.count("*").alias("rows"), *[F.count_if(quality.broken(sql)).alias(n) for n, sql in every.items()])
    for rule, sql in rules.get("fail", {}).items():
        watched = watched.filter(F.when(quality.broken(sql), F.raise_error(F.lit(f"{name}: a row violates {rule}")).cast("boolean")).otherwise(True))
    return quality.drop(watched, rules.get("drop", {}))


@dataclass(frozen=True)
class Governance:
    """What a flow's entity is put under: rules, {action: {rule: SQL}}; told() gets a batch's counts, {action: {rule: rows}}."""

    rules: dict[str, dict[str, str]] = field(default_factory=dict)
    entity: str = ""
    told: Callable[[int, dict], None] = lambda batch, counts: None

    def watching(self, rows: DataFrame, batch: int) -> tuple[DataFrame, Callable[[], None]]:
        """What drop rules leave, counted while it is written, and what has to be called before it counts: it tells, or raises QualityError."""
        kept, settle = quality.watching(rows, self.rules, self.entity)
        return kept, lambda: self.told(batch, settle())

    def dropped(self, rows: DataFrame) -> DataFrame:
        return quality.drop(rows, self.rules.get("drop", {}))


def governing(handle: Callable[[DataFrame, int], None], rules: dict[str, dict[str, str]], entity: str, told: Callable[[int, dict], None] = lambda batch, counts: None, settled: bool = False) -> Callable[[DataFrame, int], None]:
    """A batch function under rules, for the flows that have one: told() gets a batch's counts, {action: {rule: rows}}; what drop rules leave
    goes on; a broken fail rule raises QualityError before anything of the batch is handled. settled: batches come from a table, so they are counted in a
    pass of their own and not copied."""

    def run(rows: DataFrame, batch: int) -> None:
        kept, counts = quality.governed(rows, rules, entity, settled)
        told(batch, counts)
        handle(kept, batch)

    return run


def appending(table: VersionedTable, under: Governance = Governance()) -> Callable[[DataFrame, int], None]:
    """under: rules that are checked while the rows are written; if one fails, the table stays as it was."""

    def handle(rows: DataFrame, batch: int) -> None:
        kept, settle = under.watching(rows, batch)
        table.append(kept, batch, settle)

    return handle


def ingesting(spark: SparkSession, settings: Settings, source: str, schema: StructType, time=None) -> VersionedTable:
    """Takes what has landed of a source (CMSTFL, TRXPFL or BLNCFL) into its bronze table, each file once, in the schema remembered for
    the source, which schema may widen. The table."""
    table = VersionedTable(spark, settings.table("bronze", source))
    stream = with_load_columns(file_stream(spark, settings.drops(source), with_parts(schema)), load_time(time))
    run_available(stream, lambda rows, batch: ingest_drop(rows, table, settings.schema(source), batch), settings.checkpoint(f"bronze-{source}"))
    return table


def upserting(table: VersionedTable, keys: list[str], sequence: list[str], buckets: int = 1, derived: dict[str, Column] | None = None, hashes: Collection[str] = (), unique: bool = False) -> Callable[[DataFrame, int], None]:
    """derived and hashes: as in upsert_latest(). unique: keys hardly repeat within a batch, so of a first one few rows are moved."""
    return lambda rows, batch: table.upsert(rows, keys, sequence, batch, buckets, derived, hashes, unique and not table.exists())


def detecting_changes(table: VersionedTable, key: str, change: str, time: str, sequence: str | None = None, buckets: int = 8, settled: bool = False, under: Governance = Governance()) -> Callable[[DataFrame, int], None]:
    """A state satellite. Duplicates are dropped within a batch and versions compared with the latest, so a value that comes
    back later is a new version. The latest versions are a table of their own beside the history, one row per key in
    buckets of the key's hash: a batch reads and writes the buckets that it touches and never the history. If a batch stops
    between the two writes, its replay skips the first and does the second. Without sequence the latest versions are kept as version_digests(), taken
    from what has been appended. settled: batches come from a table already. under: rules, checked while the rows are written; if one fails, the tables
    stay as they were."""
    latest = VersionedTable(table.spark, f"{table.path}-latest")

    def by_digests(rows: DataFrame, batch: int) -> None:
        kept = under.dropped(rows)
        touched = touched_buckets(version_digests(kept, key, change), [key], buckets)
        if not touched:
            under.told(batch, quality.governed(rows, under.rules, under.entity, True)[1])
            return
        watched, settle = under.watching(rows, batch)
        table.append(changed_from_digests(kept, latest.read_buckets(touched), key, change, watched=watched), batch, settle)
        new = table.appended(batch)
        if new is not None:  # else both tables are past the batch
            latest.upsert(version_digests(new, key, change, time), [key], [time, change], batch, buckets, sparse=True)

    def by_rows(rows: DataFrame, batch: int) -> None:
        touched = touched_buckets(rows, [key], buckets)
        if touched:
            new = stored(changed_rows(rows, latest.read_buckets(touched), key, change, time, sequence), "changed")
            table.append(new, batch)
            last = new.groupBy(key).agg(F.max_by(change, F.struct(time, change)).alias(change), F.max(time).alias(time))
            latest.upsert(last, [key], [time, change], batch, buckets)

    def handle(rows: DataFrame, batch: int) -> None:
        (by_digests if sequence is None else by_rows)(rows if settled else stored(rows, "batch"), batch)

    return handle


def enriching(target: VersionedTable, work: VersionedTable, resolve: Callable[[DataFrame], DataFrame], columns: list[str]) -> Callable[[DataFrame, int], None]:
    """Transactions that get their keys on the stream, or wait. resolve() adds the keys that hold now and _ready, as gold.resolved() does; what
    is not ready is tried again with each later batch, and so gets the keys that hold when it is appended.

    A batch and the rows that wait are resolved together, once, and written to `work`, ready or not; then the ready ones are appended. A
    batch that stops between the two writes finds its decisions in `work` when it is replayed, even if the maps have changed by
    then: no row is lost or appended twice. `work` holds one batch and what waits, never the history.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        if work.last_batch < batch:
            rows = rows.select(*columns)
            if work.exists():
                rows = rows.unionByName(work.read().filter("NOT _ready").select(*columns))
            work.replace(resolve(rows), batch)
        target.append(work.read().filter("_ready").drop("_ready"), batch)

    return handle


def aggregating(states: VersionedTable, of: Callable[[DataFrame], DataFrame], by: list[str], buckets: int = 8) -> Callable[[DataFrame, int], None]:
    """An aggregate kept up to date by its batches alone: of() makes mergeable states of a batch, which are merged into the table's. Only
    the buckets of groups that the batch touches are read and written, never the rows that came before; a replay changes nothing."""

    def handle(rows: DataFrame, batch: int) -> None:
        if states.last_batch < batch:
            states.merge(stored(of(rows), "states"), by, lambda old, new: merged_states(old, new, by), batch, buckets)

    return handle


def fanning_out(tables: dict[str, VersionedTable], projections: dict[str, list]) -> Callable[[DataFrame, int], None]:
    """Several targets from one read of each batch."""

    def handle(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for name, table in tables.items():
                table.append(rows.select(*projections[name]), batch)
        finally:
            rows.unpersist()

    return handle
