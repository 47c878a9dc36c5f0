"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs. Near-duplicates are of five-word shingles at 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import language, minhash, mixing, packing, secrets
from vaultspark.llm.common import stored, table

#: A byte that no context of a language knows costs 8 bits and the escapes before it, 14 to 19 in all; only texts that consist
#: of little else, so of another script or noise, come above this.
MOST_BITS = 13.0


#: Bytes of an Arrow batch at most. A worker holds a few batches at once, and the five stages share their workers' memory.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:  # a value with a unit is replaced
        spark.conf.set(name, str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or letterless, and texts that are little else than bytes in no language that the labels teach:
    noise or another script. A text in another language of a known script stays."""
    bounded_batches(spark)
    model = language.train(docs.filter(~language.held_out()))
    found = language.scored(docs, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    bounded_batches(spark)
    return minhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources reach their target weights."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 1024, a row per piece."""
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: SQL can't express language models, signatures or tokenizers; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
