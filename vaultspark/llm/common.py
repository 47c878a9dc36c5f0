"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.sources.scratch import shared_folder, stored  # noqa: F401  for the operators

#: ASCII white space; everything else belongs to a word. `bytes.split()` splits at exactly these.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(seed: int, *cols: str):
    """A 64-bit hash of the columns, nulls told apart by position."""
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
