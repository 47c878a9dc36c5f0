"""Bronze and silver: ingest, hubs, links, satellites, upserts and change feeds.

Roles: customer is the customer master, orders are transactions, lineitem are balances, events are a stream. The second
snapshot of the customers changes a fifth of the balances, adds some keys and lacks some.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions.keys import business_key, change_hash
from vaultspark.operators import quality
from vaultspark.operators.cdc import arrivals, snapshot_changes
from vaultspark.operators.layout import renamed, write_sorted
from vaultspark.operators.loaders import changed_rows, load_time, new_by_key, new_by_key_pruned
from vaultspark.plans.registry import query, table
from vaultspark.sources.bucketed import BucketedTable
from vaultspark.sources.ingest import SchemaHistory, file_stream, ingest_drop, with_load_columns, with_parts
from vaultspark.sources.scratch import scratch_path, stored
from vaultspark.sources.store import VersionedTable
from vaultspark.streaming.flows import appending, detecting_changes, fanning_out, run_available, upserting

DAY_1, DAY_2 = "2026-01-01", "2026-01-02"
MONEY = "decimal(18,2)"


def day_2(customer: DataFrame, every: int = 5) -> DataFrame:
    key = F.col("c_custkey")
    balance = F.when(key % every == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal"))
    stay = customer.withColumn("c_acctbal", balance).filter(key % 97 != 1)
    return stay.unionByName(customer.filter(key % 167 == 0).withColumn("c_custkey", key + 1_000_000))


SQL_DAY_2 = """day_2 AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment
  FROM customer WHERE c_custkey % 97 <> 1
  UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 167 = 0)"""


def customer_satellite(customer: DataFrame, day: str) -> DataFrame:
    key = business_key("c_custkey").alias("Hash_Cliente")
    names = {"c_custkey": "IdentificadorCliente", "c_name": "nombre_cliente", "c_mktsegment": "segmento_cliente"}
    rows = renamed(customer, names, F.col("c_acctbal").cast(MONEY).alias("saldo"), key)
    hashed = change_hash("Hash_Cliente", "nombre_cliente", "segmento_cliente", "saldo")
    return rows.withColumn("Hash_Diferenciador", hashed).withColumn("FechaRegistro", load_time(day)).withColumn("FuenteDatos", F.lit("bronze.customer"))


def hub_customer_rows(customer: DataFrame, *more) -> DataFrame:
    rows = customer.select(business_key("c_custkey").alias("Hash_Cliente"), F.col("c_custkey").alias("IdentificadorCliente"), F.lit("bronze.customer").alias("FuenteDatos"), *more)
    return quality.drop(rows, quality.RULES["hub_customer"]["drop"])


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS FechaRegistroParquet, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def partition_date_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly folders are landed and streamed into bronze twice; the second run finds nothing new."""
    orders, landing, bronze = table(spark, sf_dir, "orders"), scratch_path(spark, "landing"), scratch_path(spark, "bronze")
    day = F.col("o_orderdate").cast("date")
    parts = [F.year(day).cast("string").alias("año"), F.month(day).cast("string").alias("mes"), F.lit("1").alias("dia")]
    orders.select("*", *parts).repartition("año", "mes").write.partitionBy("año", "mes", "dia").parquet(landing)
    bronze_table = VersionedTable(spark, bronze)
    for _ in range(2):
        stream = with_load_columns(file_stream(spark, landing, with_parts(orders.schema)), load_time(DAY_1))
        run_available(stream, appending(bronze_table), f"{bronze}-checkpoint")
    return bronze_table.read().groupBy("FechaRegistroParquet").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey, c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment, CAST(NULL AS VARCHAR) AS rescued FROM customer
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal, 2) END, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN '{"c_acctbal":"n/a"}' END FROM customer""")
def schema_evolution_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second drop has a new column and a balance of another type, which is not always a number."""
    customer, bronze = table(spark, sf_dir, "customer"), scratch_path(spark, "bronze")
    target = VersionedTable(spark, bronze)
    text = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.format_string("%.2f", "c_acctbal"))
    drops = [customer.select("c_custkey", "c_acctbal"), customer.select("c_custkey", text.alias("c_acctbal"), "c_mktsegment")]
    for number, drop in enumerate(drops):
        ingest_drop(drop, target, f"{bronze}-schema", number)
    return target.read().select("c_custkey", "c_acctbal", "c_mktsegment", F.col("_rescued_data").alias("rescued"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN CAST(o_orderkey + 0.5 AS DOUBLE)::VARCHAR WHEN 3 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS v, CAST(NULL AS VARCHAR) AS rescued,
  'string' AS type, CAST(4 AS BIGINT) AS schemas FROM orders""")
def schema_lattice_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four drops bring one column as int, long, double and string: it ends as a string, nothing is rescued, and each schema is on record."""
    orders, bronze = table(spark, sf_dir, "orders"), scratch_path(spark, "bronze")
    target = VersionedTable(spark, bronze)
    values = [F.col("o_custkey").cast("int"), F.col("o_custkey"), F.col("o_orderkey") + F.lit(0.5).cast("double"), F.lit("n/a")]
    for number, value in enumerate(values):
        drop = orders.filter(F.col("o_orderkey") % 4 == number).select("o_orderkey", value.alias("v"))
        ingest_drop(drop, target, f"{bronze}-schema", number, widen=True)
    rows, (last, _) = target.read(), SchemaHistory(spark, f"{bronze}-schema").last()
    return rows.select("o_orderkey", "v", F.col("_rescued_data").alias("rescued"), F.lit(rows.schema["v"].dataType.simpleString()).alias("type"), F.lit(last + 1).cast("long").alias("schemas"))


@query("SELECT sha256(CAST(c_custkey AS VARCHAR)) AS Hash_Cliente, c_custkey AS IdentificadorCliente, 'bronze.customer' AS FuenteDatos FROM customer WHERE c_custkey > 0")
def hub_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = new_by_key(hub_customer_rows(table(spark, sf_dir, "customer")), None, ["Hash_Cliente"])
    return quality.enforce(rows, quality.RULES["hub_customer"]["fail"], "hub_customer")


@query("SELECT DISTINCT sha256(l_orderkey || '|' || l_linenumber) AS Hash_Operacion, l_orderkey AS orden, l_linenumber AS linea FROM lineitem")
def hub_lineitem_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(business_key("l_orderkey", "l_linenumber").alias("Hash_Operacion"), F.col("l_orderkey").alias("orden"), F.col("l_linenumber").alias("linea"))
    return new_by_key(rows, None, ["Hash_Operacion"])


@query(f"WITH {SQL_DAY_2} SELECT sha256(CAST(c_custkey AS VARCHAR)) AS Hash_Cliente, c_custkey AS IdentificadorCliente, 'bronze.customer' AS FuenteDatos FROM day_2 WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def hub_incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return new_by_key(hub_customer_rows(day_2(customer)), hub_customer_rows(customer), ["Hash_Cliente"])


@query("""SELECT sha256(l_orderkey || '|' || l_linenumber) AS Hash_Operacion, l_orderkey AS orden, l_linenumber AS linea FROM (
  SELECT DISTINCT l_orderkey + 100000000 AS l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 200 < 2)""")
def hub_pruned_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth of the line items is delivered again, and once more under new order keys: the batch meets the hub of all line
    items, whose keys are pruned by the batch's before the anti-join."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    again = lines.filter("l_orderkey % 200 < 2")
    rows = lambda df: df.select(business_key("l_orderkey", "l_linenumber").alias("Hash_Operacion"), F.col("l_orderkey").alias("orden"), F.col("l_linenumber").alias("linea"))
    hub = stored(new_by_key(rows(lines), None, ["Hash_Operacion"]), "hub")
    return new_by_key_pruned(rows(again.unionByName(again.withColumn("l_orderkey", F.col("l_orderkey") + 100_000_000))), hub, ["Hash_Operacion"])


def customer_order_link(orders: DataFrame) -> DataFrame:
    pair = orders.select(business_key("o_custkey").alias("Hash_Cliente"), business_key("o_orderkey").alias("Hash_Transaccion"))
    return pair.withColumn("Hash_Link", business_key("Hash_Cliente", "Hash_Transaccion"))


@query("""SELECT c AS Hash_Cliente, t AS Hash_Transaccion, sha256(c || '|' || t) AS Hash_Link
FROM (SELECT DISTINCT sha256(CAST(o_custkey AS VARCHAR)) AS c, sha256(CAST(o_orderkey AS VARCHAR)) AS t FROM orders)""")
def link_customer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_by_key(customer_order_link(table(spark, sf_dir, "orders")), None, ["Hash_Cliente", "Hash_Transaccion"])


def _event_batches(spark: SparkSession, sf_dir: str, batches: int, handle: Callable[[DataFrame, int], None], *columns) -> None:
    """The events land in ascending event_id, each batch as a folder of as many files as it has partitions, and are streamed as
    they land: one micro-batch per folder, whatever its number of files."""
    events, path = table(spark, sf_dir, "events"), scratch_path(spark, "events")
    top = events.agg(F.max("event_id")).first()[0] or 0
    for b in range(batches):
        inside = F.floor(F.col("event_id") * batches / (top + 1)) == b
        events.filter(inside).write.parquet(f"{path}/{b}")
        run_available(file_stream(spark, f"{path}/*", events.schema).select(*columns), handle, f"{path}-checkpoint")


@query("""SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def scd1_upsert_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in three batches is merged into a table of eight buckets."""
    target = VersionedTable(spark, scratch_path(spark, "last-seen"))
    _event_batches(spark, sf_dir, 3, upserting(target, ["user_id"], ["ts", "event_id"], 8), "user_id", "ts", "event_id", "event_type", "value")
    return target.read().select("user_id", "event_id", "event_type", "value")


@query("""SELECT user_id, event_id, event_type, value, CASE WHEN third = 2 THEN event_type END AS only_late FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, CAST(floor(event_id * 3 / ((SELECT max(event_id) FROM events) + 1)) AS INT) AS third FROM events) WHERE r = 1""")
def scd1_bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scd1_upsert_last_seen into a table in Spark's own buckets, whose rows are not shuffled by a merge; the last batch has a column more."""
    target = BucketedTable(spark, scratch_path(spark, "bucketed"), ["user_id"], ["ts", "event_id"])
    late = lambda rows, batch: rows if batch < 2 else rows.withColumn("only_late", F.col("event_type"))
    _event_batches(spark, sf_dir, 3, lambda rows, batch: target.upsert(late(rows, batch), batch), "user_id", "ts", "event_id", "event_type", "value")
    return target.read().select("user_id", "event_id", "event_type", "value", "only_late")


@query("SELECT c_custkey AS IdentificadorCliente, c_name AS nombre_cliente, c_mktsegment AS segmento_cliente, CAST(c_acctbal AS DECIMAL(18,2)) AS saldo, DATE '2026-01-01' AS fecha, 128 AS ancho FROM customer")
def satellite_first_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changed_rows(customer_satellite(table(spark, sf_dir, "customer"), DAY_1), None, "Hash_Cliente")
    rows = quality.enforce(rows, quality.RULES["satellite"]["fail"], "satellite")
    return rows.select("IdentificadorCliente", "nombre_cliente", "segmento_cliente", "saldo", F.col("FechaRegistro").cast("date").alias("fecha"), F.length("Hash_Diferenciador").alias("ancho"))


@query(f"WITH {SQL_DAY_2} SELECT d.c_custkey AS IdentificadorCliente, CAST(d.c_acctbal AS DECIMAL(18,2)) AS saldo FROM day_2 d LEFT JOIN customer c USING (c_custkey) WHERE c.c_custkey IS NULL OR d.c_acctbal <> c.c_acctbal")
def satellite_day2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    stored_rows = stored(changed_rows(customer_satellite(customer, DAY_1), None, "Hash_Cliente"), "satellite")
    return changed_rows(customer_satellite(day_2(customer), DAY_2), stored_rows, "Hash_Cliente").select("IdentificadorCliente", "saldo")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
WHERE before IS NULL OR before <> event_type""")
def satellite_revert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each user's event type over a stream of three batches; a type that comes back is a version again."""
    target = VersionedTable(spark, scratch_path(spark, "versions"))
    change = change_hash(business_key("user_id"), "event_type").alias("Hash_Diferenciador")
    _event_batches(spark, sf_dir, 3, detecting_changes(target, "user_id", "Hash_Diferenciador", "event_id", "event_id"), "user_id", "event_id", "event_type", change)
    return target.read().select("user_id", "event_id", "event_type")


@query("""WITH hot AS (SELECT event_id, event_type, CASE WHEN event_id % 10 <> 3 THEN 0 ELSE user_id END AS u FROM events)
SELECT u AS user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY u ORDER BY event_id) AS before FROM hot) WHERE before IS NULL OR before <> event_type""")
def satellite_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """satellite_revert_stream where one user has nine tenths of the events: that user's rows are compared in ranges, not in one task."""
    target = VersionedTable(spark, scratch_path(spark, "hot-versions"))
    user = F.when(F.col("event_id") % 10 != 3, F.lit(0).cast("long")).otherwise(F.col("user_id"))
    change = change_hash(business_key(user), "event_type").alias("Hash_Diferenciador")
    _event_batches(spark, sf_dir, 2, detecting_changes(target, "user_id", "Hash_Diferenciador", "event_id", "event_id"), user.alias("user_id"), "event_id", "event_type", change)
    return target.read().select("user_id", "event_id", "event_type")


@query("""SELECT o_orderkey AS transaccion, CAST(o_totalprice AS DECIMAL(18,2)) AS monto FROM orders
UNION ALL SELECT o_orderkey + 100000000, CAST(o_totalprice + 1 AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 50 = 0""")
def transaction_satellite_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions are delivered again with other amounts, and some new ones: the first write wins."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transaccion"), "o_totalprice")
    amount = lambda df, more: df.select("transaccion", (F.col("o_totalprice") + more).cast(MONEY).alias("monto"), business_key("transaccion").alias("Hash_Transaccion"))
    again = rows.unionByName(rows.filter("transaccion % 50 = 0").withColumn("transaccion", F.col("transaccion") + 100_000_000))
    first = new_by_key(amount(rows, 0), None, ["Hash_Transaccion"])
    second = new_by_key(amount(again, 1), first, ["Hash_Transaccion"])
    return first.unionByName(second).select("transaccion", "monto")


@query("""SELECT unnest(['hub', 'link', 'sat_amounts', 'sat_stable']) AS target, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1""")
def pure_append_multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream feeds a hub, a link and two satellites; every target keeps the commit its rows came in."""
    orders, path = table(spark, sf_dir, "orders"), scratch_path(spark, "orders")
    orders.write.parquet(path)
    key, version = business_key("o_orderkey").alias("Hash_Transaccion"), [F.col("VersionCarga"), F.col("FechaCargaBronce")]
    projections = {
        "hub": [key, "o_orderkey", *version],
        "link": [key, business_key("o_custkey").alias("Hash_Cliente"), *version],
        "sat_stable": [key, "o_orderstatus", "o_orderdate", "o_orderpriority", *version],
        "sat_amounts": [key, F.col("o_totalprice").cast(MONEY).alias("monto"), *version],
    }
    tables = {name: VersionedTable(spark, f"{path}-{name}") for name in projections}
    fan = fanning_out(tables, projections)
    stream = file_stream(spark, path, orders.schema)
    run_available(stream, lambda rows, batch: fan(arrivals(rows.withColumn("_change_type", F.lit("insert")), batch, load_time(DAY_1)), batch), f"{path}-checkpoint")
    counts = [t.read().select(F.lit(name).alias("target"), "Hash_Transaccion") for name, t in tables.items()]
    rows = counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("Hash_Transaccion").alias("keys"))


@query(f"""WITH {SQL_DAY_2}, both_days AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS k, a.c_custkey AS ka, b.c_custkey AS kb, a.c_acctbal AS va, b.c_acctbal AS vb
  FROM customer a FULL OUTER JOIN day_2 b ON a.c_custkey = b.c_custkey)
SELECT k AS c_custkey, vb AS c_acctbal, 'insert' AS change FROM both_days WHERE ka IS NULL
UNION ALL SELECT k, va, 'delete' FROM both_days WHERE kb IS NULL
UNION ALL SELECT k, va, 'update_preimage' FROM both_days WHERE va <> vb
UNION ALL SELECT k, vb, 'update_postimage' FROM both_days WHERE va <> vb""")
def snapshot_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return snapshot_changes(customer, day_2(customer), ["c_custkey"]).select("c_custkey", "c_acctbal", F.col("_change_type").alias("change"))


@query("""SELECT 'drop' AS action, 'positive_balance' AS rule, count(*) FILTER (NOT coalesce(c_acctbal > 0, false)) AS broken, count(*) FILTER (c_acctbal > 0) AS kept FROM customer
UNION ALL SELECT 'warn', 'known_segment', count(*) FILTER (NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false)), count(*) FROM customer
UNION ALL SELECT 'fail', 'key_set', 0, count(*) FROM customer""")
def quality_drop_warn_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    rules = {"drop": {"positive_balance": "c_acctbal > 0"}, "warn": {"known_segment": "c_mktsegment IN ('BUILDING', 'MACHINERY')"}, "fail": {"key_set": "c_custkey IS NOT NULL"}}
    kept = {"drop": quality.drop_counted(customer, rules["drop"]), "warn": quality.warn(customer, rules["warn"]), "fail": (quality.enforce(customer, rules["fail"], "customer"), None)}
    told = []
    for action, (rows, seen) in kept.items():
        name = next(iter(rules[action]))
        n = rows.count()  # the action that fills the observation
        told.append((action, name, seen.get[name] if seen else 0, n))
    return spark.createDataFrame(told, "action string, rule string, broken long, kept long")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def layout_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in order of its keys, which come first, and read back."""
    path = scratch_path(spark, "layout")
    write_sorted(table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber", "l_orderkey"), path, ["l_orderkey", "l_linenumber"])
    back = spark.read.parquet(path)
    return back.groupBy(*back.columns[:2]).agg(F.count("*").alias("n"))
