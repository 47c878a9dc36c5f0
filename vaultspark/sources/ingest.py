"""Incremental ingest of Parquet drops: each file once, with its partition date, new columns added, misfits rescued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vaultspark.functions.dates import partition_date
from vaultspark.functions.types import merged
from vaultspark.sources.files import NumberedFiles

PARTS = ("año", "mes", "dia")


def with_parts(schema: StructType, parts: tuple[str, ...] = PARTS) -> StructType:
    """The schema of a stream over year, month and day folders: their values stay strings."""
    known = set(schema.fieldNames())
    return StructType([*schema.fields, *[StructField(p, StringType()) for p in parts if p not in known]])


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_load_columns(df: DataFrame, time: Column) -> DataFrame:
    return df.withColumn("FechaRegistroParquet", partition_date()).withColumn("FechaCargaBronce", time)


def evolved(known: StructType | None, found: StructType, widen: bool = False) -> StructType:
    """The known columns, then those that are new. Known columns keep their types, or with widen get the least type that holds both."""
    if known is None:
        return found
    if widen:
        return merged(known, found)
    names = set(known.fieldNames())
    return StructType([*known.fields, *[f for f in found.fields if f.name not in names]])


def fitted(df: DataFrame, schema: StructType, column: str = "_rescued_data") -> DataFrame:
    """df in the schema's columns and order. A missing column is null; a value that can't be cast to its type is null too and
    kept, as are columns that the schema lacks, in a JSON string, which is null if there is nothing to keep."""
    types, fit, kept = {f.name: f.dataType for f in df.schema.fields}, [], []
    for f in schema.fields:
        if f.name not in types:
            fit.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif types[f.name] == f.dataType:
            fit.append(F.col(f.name))
        else:
            cast = F.col(f.name).try_cast(f.dataType)
            fit.append(cast.alias(f.name))
            kept.append(F.when(cast.isNull(), F.col(f.name).cast("string")).alias(f.name))
    kept += [F.col(n) for n in types if n not in schema.fieldNames()]
    rescued = F.nullif(F.to_json(F.struct(*kept)), F.lit("{}")) if kept else F.lit(None).cast("string")
    return df.select(*fit, rescued.alias(column))


class SchemaHistory(NumberedFiles):
    """The schemas that a bronze table has had, each under a number of its own: a crash leaves the last one in force."""

    prefix = "_SCHEMA-"

    def last(self) -> tuple[int, StructType | None]:
        """The newest schema's number and the schema; -1 and None if there is none."""
        files = self._states()
        if not files:
            return -1, None
        return int(files[-1].getName().removeprefix(self.prefix)), StructType.fromJson(self._load(files[-1])["schema"])


def bronze_schema(df: DataFrame, path: str, widen: bool = False) -> StructType:
    """The schema remembered beside a bronze table, evolved by df's and remembered again if that changed it."""
    history = SchemaHistory(df.sparkSession, path)
    number, known = history.last()
    now = evolved(known, df.schema, widen)
    if now != known:
        history.put({"schema": now.jsonValue()}, number + 1)
    return now


def ingest_drop(drop: DataFrame, table, schema_path: str, batch_id: int | None = None, widen: bool = False) -> None:
    """Appends one drop to a bronze table (a VersionedTable) in the evolved schema. With widen, a drop of a wider type widens the column, so
    drops in any order give one schema; without, values that don't fit the known type are rescued."""
    table.append(fitted(drop, bronze_schema(drop, schema_path, widen)), batch_id)
