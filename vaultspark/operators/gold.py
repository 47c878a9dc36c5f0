"""Builders of the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions.keys import surrogate_key
from vaultspark.operators.layout import closed
from vaultspark.operators.loaders import first_per_key, growing, latest_per_key


def current_rows(satellite: DataFrame, key: str, order: str = "FechaRegistro", tie: str = "Hash_Diferenciador") -> DataFrame:
    """The current version of each entity; at equal times the larger change hash."""
    return latest_per_key(satellite, [key], [F.col(order), F.col(tie)])


def current_columns(satellite: DataFrame, key: str, chosen: list, order: str = "FechaRegistro", tie: str = "Hash_Diferenciador") -> DataFrame:
    """Some columns of current_rows(), without moving the others: a satellite is several times as wide as what is read of it. At equal times the first 32
    characters of the change hash, 128 bits of it, tell which is larger."""
    rows = satellite.select(key, F.col(order).alias("_time"), F.substring(F.col(tie).cast("string"), 1, 32).alias("_tie"), *chosen)
    names = rows.columns[3:]
    best = rows.groupBy(key).agg(F.max(F.struct("_time", "_tie", *names)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in names])


def type1_dimension(hub: DataFrame, key: str, hub_columns: list, satellites: list[tuple[DataFrame, list]], id_column: str, columns: list[str], entity: str) -> DataFrame:
    """Hub rows with the current attributes of each satellite and a surrogate key. Hub rows without satellite rows stay. All
    joins are on the hub hash, so the rows are shuffled by it once. A satellite that is the hub's own frame has one version per key beside
    the hub's columns, as a first load has: it isn't joined."""
    out = hub.select(key, *hub_columns, *[c for satellite, chosen in satellites if satellite is hub for c in chosen])
    for satellite, chosen in [s for s in satellites if s[0] is not hub]:
        out = out.join(growing(current_columns(satellite, key, chosen)), key, "left")
    return closed(out.withColumn(id_column, surrogate_key(key)), columns, entity)


def dominant_child(children: DataFrame, link: DataFrame, parent: str, child: str, rank: str) -> DataFrame:
    """Each parent's child with the largest rank, ties to the larger child hash."""
    best = link.join(children.select(child, rank), child).groupBy(parent).agg(F.max(F.struct(rank, child)).alias("_b"))
    return best.select(parent, F.col(f"_b.{child}").alias(child))


def dominant_link(link: DataFrame, parent: str, child: str, rank: str) -> DataFrame:
    """As dominant_child, of a link that carries the rank: no join."""
    return link.groupBy(parent).agg(F.max(F.struct(rank, child)).alias("_b")).select(parent, F.col(f"_b.{child}").alias(child))


def key_map(dominant: DataFrame, dim_parent: DataFrame, dim_child: DataFrame, parent: str, child: str, parent_id: str, child_id: str) -> DataFrame:
    """Both surrogate keys per parent. Dimensions are as large as their hubs, so no broadcast is asked for; the optimizer
    takes one where the table is small."""
    return dominant.join(dim_parent.select(parent, parent_id), parent, "left").join(dim_child.select(child, child_id), child, "left").select(parent, child, parent_id, child_id)


def enriched(transactions: DataFrame, kinds: Column, link: DataFrame, mapping: DataFrame, transaction: str, parent: str, *details: DataFrame) -> DataFrame:
    """Transactions of the wanted kinds with their parent's keys: filtered first, every static side reduced to one row per key, so
    no row fans out: the first by all its columns. Works on batches and streams; on a stream the static sides are those of
    each run, so a row keeps the keys that held when it was appended. Rows without link or map entry are left out, without
    details kept."""
    out = transactions.filter(kinds).join(growing(first_per_key(link.select(transaction, parent), [transaction])), transaction)
    out = out.join(growing(first_per_key(mapping, [parent])), parent)
    for detail in details:
        out = out.join(growing(first_per_key(detail, [transaction])), transaction, "left")
    return out


def resolved(transactions: DataFrame, kinds: Column, link: DataFrame, mapping: DataFrame, transaction: str, parent: str) -> DataFrame:
    """Every transaction of the wanted kinds with its parent's keys and _ready: whether link and map know it. Keys of those that are
    not ready are null. The static sides are reduced as in enriched()."""
    out = transactions.filter(kinds).join(growing(first_per_key(link.select(transaction, parent), [transaction])), transaction, "left")
    known = first_per_key(mapping, [parent]).withColumn("_known", F.lit(True))
    return out.join(growing(known), parent, "left").withColumn("_ready", F.coalesce("_known", F.lit(False))).drop("_known")


def atm_flags(kind: str, withdrawal: str, deposit: str) -> list[Column]:
    flag = lambda code: F.when(F.col(kind) == code, True).otherwise(False)
    return [flag(withdrawal).alias("EsRetiro"), flag(deposit).alias("EsDeposito")]


def new_rows(view: DataFrame, target: DataFrame | None, keys: list[str]) -> DataFrame:
    """Incremental refresh of a view whose rows never change: those the target lacks."""
    return view if target is None else view.join(target.select(*keys), keys, "left_anti")
