"""Questions asked of the star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.operators.loaders import preceding
from vaultspark.sources.scratch import stored


def monthly(fact: DataFrame, calendar: DataFrame, amount: str, customer: str) -> DataFrame:
    """Transactions, amount and unique customers per month, in order of time."""
    out = fact.join(calendar, "FechaClave").groupBy("Anio", "Mes", "NombreMes").agg(
        F.count("*").alias("transacciones"), F.round(F.sum(amount), 2).alias("monto_total"), F.countDistinct(customer).alias("clientes"))
    return out.orderBy("Anio", "Mes")


def movement_metrics(fact: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Count, total and mean of withdrawals and deposits per group."""
    out = []
    for flag, name in (("EsRetiro", "retiros"), ("EsDeposito", "depositos")):
        value = F.when(F.col(flag), F.col(amount))
        out += [F.count_if(flag).alias(f"n_{name}"), F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias(f"total_{name}"), F.round(F.avg(value), 6).alias(f"promedio_{name}")]
    return fact.groupBy(*by).agg(*out)


def validity(history: DataFrame, key: str, time: str) -> DataFrame:
    """History rows with the time each version ends, null for the current one."""
    return history.withColumn("valid_to", F.lead(time).over(Window.partitionBy(key).orderBy(time)))


def as_of(rows: DataFrame, history: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows with columns of the last row of history that has the same keys (nulls are one key) and comes at or before them in order; null where
    there is none. Both are put in one sequence, in ranges of keys and order, and values are carried on within a range; what
    comes into a range is one row per range, so a key of any size is spread over tasks and no pair of rows is ever made."""
    own = [c for c in rows.columns if c not in (*keys, *order)]
    value = F.struct(F.struct(*keys).alias("key"), F.struct(*columns).alias("row"))
    given = history.select(*keys, *order, F.lit(0).alias("_side"), value.alias("_value"))
    asked = rows.select(*keys, *order, F.lit(1).alias("_side"), F.struct(*own).alias("_own") if own else F.lit(None).alias("_own"))
    by = [*keys, *order, "_side"]
    placed = stored(given.unionByName(asked, allowMissingColumns=True).repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "as-of")
    known = F.col("_value").isNotNull()
    ends = placed.groupBy("_range").agg(F.max_by(F.when(known, F.col("_value")), F.when(known, F.struct(*by))).alias("_end"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ends = ends.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.coalesce(F.last("_value", ignorenulls=True).over(within), F.col("_carried"))
    out = placed.join(F.broadcast(ends), "_range").withColumn("_last", last).filter("_side = 1")  # one row per range
    found = F.when(F.col("_last.key").eqNullSafe(F.struct(*keys)), F.col("_last.row"))
    back = [F.col(c) if c in (*keys, *order) else F.col(f"_own.{c}").alias(c) for c in rows.columns]
    return out.withColumn("_found", found).select(*back, *[F.col(f"_found.{c}").alias(c) for c in columns])


def levels_over_time(history: DataFrame, key: str, order: list[str], group: str, value: str, time: str) -> DataFrame:
    """group, month and level: the sum, at the end of each month, of the value that each key has then, for every month from a group's first to the
    last of all. Each version counts with its difference from the one before it, in its own group and month, and the differences
    are added up over the months, so keys are not repeated for every month. A key that moves to another group leaves the first."""
    rows = preceding(history, [key], order, [group, value])
    month, last = F.trunc(time, "month").alias("month"), history.agg(F.trunc(F.max(time), "month").alias("_end"))
    change = lambda of, sign: F.struct(F.col(f"{of}{group}").alias("group"), (sign * F.coalesce(F.col(f"{of}{value}").cast("decimal(18,2)"), F.lit(0))).cast("decimal(20,2)").alias("change"))
    came, left = change("", 1), change("_before.", -1)
    parts = rows.select(month, F.explode(F.when(F.col("_before").isNull(), F.array(came)).otherwise(F.array(came, left))).alias("_c"))
    changes = parts.groupBy(F.col("_c.group").alias(group), "month").agg(F.sum("_c.change").alias("change"))
    spans = changes.groupBy(group).agg(F.min("month").alias("_first")).withColumn("_end", F.lit(last.first()["_end"]))
    every = spans.select(group, F.explode(F.sequence("_first", "_end", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    upto = Window.partitionBy(group).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a group's months
    both = every.alias("e").join(changes.alias("c"), F.col(f"e.{group}").eqNullSafe(F.col(f"c.{group}")) & (F.col("e.month") == F.col("c.month")), "left")
    filled = both.select(F.col(f"e.{group}").alias(group), F.col("e.month").alias("month"), F.coalesce("c.change", F.lit(0)).alias("change"))
    return filled.select(group, "month", F.sum("change").over(upto).cast("decimal(28,2)").alias("level"))


def outliers(totals: DataFrame, group: str, value: str, limit: float = 2.0) -> DataFrame:
    """Rows whose value is over `limit` standard deviations from their group's mean. Statistics are aggregated and joined
    back, so a large group is not gathered."""
    stats = totals.groupBy(group).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    z = (F.col(value) - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd"))
    return totals.join(stats, group).withColumn("z", F.round(z, 4)).filter(F.abs("z") > limit).drop("_mean", "_sd")


#: Ids of one bitmap: Spark's bitmap functions hold so many bits.
BITMAP = 32768


def distinct_states(rows: DataFrame, by: list[str], amount: str, member: str) -> DataFrame:
    """Mergeable states of count, sum and exact distinct members per group: by, _page, n, total (decimal) and members (a bitmap). member is a
    dense id of 0 or more, null for none; the members of a group are spread over pages of BITMAP ids, so a state row has a fixed
    size and a group of any size is aggregated in parts. Rows are combined before the shuffle."""
    page = F.coalesce(F.floor(F.col(member) / BITMAP), F.lit(-1)).cast("long")
    bits = F.bitmap_construct_agg(F.when(F.col(member).isNotNull(), F.pmod(F.col(member), F.lit(BITMAP))))
    value = F.col(amount).cast("decimal(18,2)")
    return rows.groupBy(*by, page.alias("_page")).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("decimal(28,2)").alias("total"), bits.alias("members"))


def merged_states(old: DataFrame | None, new: DataFrame, by: list[str]) -> DataFrame:
    """The states of the rows of both: of any rows, in any order and grouping, the same states."""
    rows = new if old is None else old.select(new.columns).unionByName(new)
    sums = [F.sum("n").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"), F.bitmap_or_agg("members").alias("members")]
    return rows.groupBy(*by, "_page").agg(*sums)


def finished_states(states: DataFrame, by: list[str]) -> DataFrame:
    """by, n, total and members: counts and sums, and how many members are in a bitmap."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"), F.sum(F.bitmap_count("members")).alias("members"))
