"""Mixing sources to target weights, with DataFrame functions only.

Words per source are summed (partial sums before the shuffle, so a hot source costs one row a task); each source gets a
target; a document of a source with rate = target / size is emitted floor(rate) times plus one more copy with
probability rate - floor(rate), drawn from a hash of the seed and the row. No random state: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultspark.llm.common import WORD, stored, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target (double).

    sizes has source and size. Sources by code point, null last, weigh `weights`, repeating, and share all words; a target
    stops at `most` times the source's size and the excess is shared again by weight until none is above. In order of
    cap / weight the sources that are capped come first, so one pass of running sums finds them. The two windows run over
    one row per distinct source, the only thing here that one task sees whole. A source without words gets target 0.
    """
    whole = Window.partitionBy()
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("_rank", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    capped = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    order = whole.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = capped.select("source", "source_size", "_w", "_cap", (F.sum("source_size").over(whole) - before).alias("_left"), rest.alias("_rest"))
    full = F.col("_cap").cast("double") * F.col("_rest") <= F.col("_w").cast("double") * F.col("_left")
    level = level.withColumn("_full", full)
    open_w = F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(0)).over(whole)
    left = F.sum("source_size").over(whole) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(whole)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(left.cast("double") * F.col("_w") / open_w)
    return level.select("source", "source_size", target.alias("target"))


def _planned(docs: DataFrame, seed: int, weights: tuple[int, ...], most: int, columns: list[str] | None = None) -> DataFrame:
    """row (the caller's, or only these columns of it), size, source_size, target and copies. Rows without text are small
    enough to be written once counted and drawn; rows with it are counted again where they are joined, as they are not moved."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    unit = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / float(1 << 52)
    sized = docs.select("source", word_count(F.col("text")).alias("size"), unit.alias("unit"), F.struct(*(columns or "*")).alias("row"))
    if columns and "text" not in columns:
        sized = stored(sized, "mix-sizes")
    targets = stored(source_targets(sized.select("source", "size"), weights, most), "mix-targets")
    targets = targets.select(F.col("source").alias("of"), "source_size", "target")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = F.least(whole + (F.col("unit") < rate - whole).cast("int"), F.lit(most)).cast("int")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixing_plan(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, columns: list[str] | None = None) -> DataFrame:
    """docs, or only these columns of it, with size, source_size, target and copies (int).

    docs needs doc_id, text and source; columns of its own called size, source_size, target or copies are replaced. Null
    text has size 0. A row of size 0 is copied by its source's rate like any other (rate 0 where the source has no words).
    Rows that are equal in doc_id and text are drawn alike. An empty table gives an empty result.
    """
    own = docs.drop("size", "source_size", "target", "copies")
    return _planned(own, seed, weights, most, columns).select("row.*", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mixed corpus: each row of docs repeated by its copies, with the columns of docs."""
    plan = _planned(docs, seed, weights, most)
    return plan.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixing_plan(docs, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
