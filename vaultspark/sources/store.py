"""Versioned tables on Parquet: files are written first, then a small numbered state file names those that count.

A state file appears whole, under the next number, or not at all, and the newest wins; so a reader sees the state before or after
a write, never between, and a writer that dies leaves the last state in force. A writer commits only on top of the state that it
read: if any other has been committed since, however many, it fails and has to begin anew. A batch id at or below the last
one recorded is skipped, so a stream's replays change nothing.

The state also has the schema of every part, so a read needs no look into files, and parts of several schemas, with columns or types that
have changed since, are read in the least schema that holds them all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vaultspark.functions.keys import bucket
from vaultspark.functions.types import unified
from vaultspark.operators.cdc import upsert_latest
from vaultspark.operators.layout import keys_first
from vaultspark.sources.files import NumberedFiles

#: State files that stay behind the newest, for readers that have just listed them.
KEPT = 2
NOTHING = {"parts": {}, "schemas": [], "of": {}, "version": -1, "last_batch": -1}


class VersionedTable(NumberedFiles):
    prefix = "_STATE-"

    def __init__(self, spark: SparkSession, path: str, layout_keys: list[str] = ()):
        super().__init__(spark, path)
        self.layout_keys = list(layout_keys)

    def _state(self) -> dict:
        """parts (name to folder), schemas, of (folder to the number of its schema), version and last_batch."""
        states = self._states()
        return self._load(states[-1]) if states else NOTHING

    def _commit(self, state: dict, parts: dict[str, str], batch_id: int | None, schema: StructType) -> None:
        """The state after `state`, unless another one has come after it. Parts that are new have the schema."""
        schemas = state["schemas"] if schema.json() in state["schemas"] else [*state["schemas"], schema.json()]
        of = {p: state["of"].get(p, schemas.index(schema.json())) for p in parts.values()}
        last = state["last_batch"] if batch_id is None else batch_id
        before = self.put({"parts": parts, "schemas": schemas, "of": of, "version": state["version"] + 1, "last_batch": last}, state["version"] + 1)
        for old in before[:-KEPT]:
            self._file(old.getName())[0].delete(old, False)

    @property
    def version(self) -> int:
        return self._state()["version"]

    @property
    def last_batch(self) -> int:
        return self._state()["last_batch"]

    def exists(self) -> bool:
        """Whether anything has been written; asked first, so that real analysis errors of a read are not taken for it."""
        return bool(self._state()["parts"])

    def _rows(self, state: dict, parts: list[str]) -> DataFrame | None:
        by_schema: dict[int, list[str]] = {}
        for part in sorted(set(parts)):
            by_schema.setdefault(state["of"][part], []).append(part)
        frames = [self.spark.read.schema(StructType.fromJson(json.loads(state["schemas"][i]))).parquet(*some) for i, some in sorted(by_schema.items())]
        return unified(frames) if frames else None

    def read(self) -> DataFrame | None:
        """All rows, or None on the first run."""
        state = self._state()
        return self._rows(state, [*state["parts"].values()])

    def read_buckets(self, numbers: list[int]) -> DataFrame | None:
        """Of a table that upsert() or merge() keeps, the rows of some buckets, or None if there are none."""
        state = self._state()
        return self._rows(state, [state["parts"][str(b)] for b in numbers if str(b) in state["parts"]])

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df = keys_first(df, self.layout_keys) if self.layout_keys else df
        df.write.option("compression", "zstd").parquet(path)
        return path

    def _seen(self, state: dict, batch_id: int | None) -> bool:
        return batch_id is not None and batch_id <= state["last_batch"]

    def append(self, df: DataFrame, batch_id: int | None = None, settle: Callable[[], object] | None = None) -> None:
        """settle: called when the files are written and before they count; if it raises, the table stays as it was."""
        state = self._state()
        if not self._seen(state, batch_id):
            part = self._write(df, "part")
            if settle:
                settle()
            self._commit(state, state["parts"] | {part: part}, batch_id, df.schema)

    def appended(self, batch_id: int) -> DataFrame | None:
        """Of a table that only append() writes, the rows that a batch brought, or None unless it is the last one."""
        state = self._state()
        return self._rows(state, [*state["parts"].values()][-1:]) if state["last_batch"] == batch_id else None

    def replace(self, df: DataFrame, batch_id: int | None = None) -> None:
        """Full refresh; df may be computed from the table itself."""
        state = self._state()
        if not self._seen(state, batch_id):
            part = self._write(df, "full")
            self._commit(state, {part: part}, batch_id, df.schema)

    def merge(self, batch: DataFrame, keys: list[str], how: Callable[[DataFrame | None, DataFrame], DataFrame], batch_id: int | None = None, buckets: int = 1) -> None:
        """Replaces rows by how(old, batch): of a table in buckets of the keys' hash, only those that the batch touches are read and
        written. how() sees whole buckets (None if there are none yet) and keeps keys in theirs. A table keeps the number of buckets
        it began with."""
        state = self._state()
        if self._seen(state, batch_id):
            return
        touched = touched_buckets(batch, keys, buckets)
        old = [state["parts"][str(b)] for b in touched if str(b) in state["parts"]]
        part = f"{self.path}/upsert-{uuid.uuid4().hex}"
        merged = how(self._rows(state, old), batch)
        merged.withColumn("_bucket", bucket(buckets, *keys)).write.option("compression", "zstd").partitionBy("_bucket").parquet(part)  # one folder per bucket
        self._commit(state, state["parts"] | {str(b): f"{part}/_bucket={b}" for b in touched}, batch_id, merged.schema)

    def upsert(self, batch: DataFrame, keys: list[str], sequence: list[str], batch_id: int | None = None, buckets: int = 1, derived: dict[str, Column] | None = None, hashes: Collection[str] = (), sparse: bool = False) -> None:
        """merge() where the latest row per key stays. A column that only the batch or only the table has is null in the other's rows. derived,
        hashes and sparse: as in upsert_latest()."""
        self.merge(batch, keys, lambda old, new: upsert_latest(old, new, keys, sequence, derived, hashes, sparse), batch_id, buckets)


def touched_buckets(batch: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """The numbers of the buckets that a batch's keys fall in: at most `buckets`, ascending."""
    return sorted(r[0] for r in batch.select(bucket(buckets, *keys)).distinct().collect())
