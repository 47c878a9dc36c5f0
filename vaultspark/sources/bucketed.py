"""Tables in Spark's own buckets: sorted by their keys, so that a batch is merged without shuffling what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vaultspark.operators.cdc import upsert_latest
from vaultspark.sources.files import NumberedFiles


class BucketedTable(NumberedFiles):
    """One row per key, the latest by sequence, in `buckets` buckets of the keys. Every version is a folder of bucketed files and a numbered file that
    names it; catalogs only hold it while it is read, so any session can open the folder."""

    prefix = "_TABLE-"

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sequence: list[str], buckets: int = 8):
        super().__init__(spark, path)
        self.keys, self.sequence, self.buckets = list(keys), list(sequence), buckets

    def _last(self) -> tuple[int, dict | None]:
        files = self._states()
        return (int(files[-1].getName().removeprefix(self.prefix)), self._load(files[-1])) if files else (-1, None)

    @property
    def last_batch(self) -> int:
        state = self._last()[1]
        return state["batch"] if state else -1

    def read(self) -> DataFrame | None:
        """All rows, with their buckets known to the optimizer; None on the first run."""
        state = self._last()[1]
        if state is None:
            return None
        schema, name = StructType.fromJson(state["schema"]), f"bucketed_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {state['buckets']} BUCKETS LOCATION '{state['folder']}'")
        rows = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: rows keeps the files and their buckets
        return rows

    def merged(self, batch: DataFrame) -> DataFrame:
        """The table with batch merged in: per key the row with the larger sequence, ties to the batch's. Only the batch is shuffled: it is reduced to
        one row per key and dealt like the table's buckets. A column that only one side has is null in the other's rows. Null keys are merged
        as one key."""
        new, old = upsert_latest(None, batch, self.keys, self.sequence), self.read()
        if old is None:
            return new
        names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
        side = lambda df: df.select(*self.keys, F.struct(*[F.col(c) if c in df.columns else F.lit(None).cast((old if c in old.columns else new).schema[c].dataType).alias(c) for c in names]).alias("_row"))
        a, b = side(old).alias("a"), side(new).alias("b")
        # null keys have no partner in a join that keeps the buckets: they are few (one a side) and merged on their own
        known = lambda df: df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys))
        seq = lambda of: F.struct(*[F.col(f"{of}._row.{c}") for c in self.sequence])
        newer = F.col("a._row").isNull() | (F.col("b._row").isNotNull() & (seq("b") >= seq("a")))
        on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in self.keys]
        row = F.when(newer, F.col("b._row")).otherwise(F.col("a._row"))
        both = known(a).alias("a").join(known(b).alias("b").hint("merge"), on, "full_outer").select(row.alias("_row")).select("_row.*")
        rest = [df.filter(" OR ".join(f"`{k}` IS NULL" for k in self.keys)) for df in (old, new)]
        return both.unionByName(upsert_latest(rest[0], rest[1], self.keys, self.sequence).select(*names))

    def upsert(self, batch: DataFrame, batch_id: int | None = None) -> None:
        number, state = self._last()
        if batch_id is not None and state and batch_id <= state["batch"]:
            return
        rows, folder, name = self.merged(batch), f"{self.path}/v-{uuid.uuid4().hex}", f"bucketed_{uuid.uuid4().hex}"
        buckets = state["buckets"] if state else self.buckets  # a table keeps the number that it began with
        rows.write.format("parquet").bucketBy(buckets, *self.keys).sortBy(*self.keys).option("path", folder).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
        last = batch_id if batch_id is not None else state["batch"] if state else -1
        self.put({"folder": folder, "schema": rows.schema.jsonValue(), "buckets": buckets, "batch": last}, number + 1)
