"""Whole entities: change feeds and streams of a table, the customer dimension in its closed schema, every class table, rules, layout on disk."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultspark.config import THRESHOLDS, UNKNOWN
from vaultspark.functions.classify import threshold_class
from vaultspark.functions.keys import business_key, change_hash, surrogate_key
from vaultspark.operators import quality
from vaultspark.operators.cdc import arrivals, snapshot_changes
from vaultspark.operators.layout import exact_quantiles, files_to_read, order_on_disk, write_curve, write_sorted
from vaultspark.operators.loaders import changed_rows, load_time, new_by_key
from vaultspark.plans.registry import query, table
from vaultspark.plans.star import DEPOSIT, SQL_FACT, WITHDRAWAL, _case, _dim_operation, fact
from vaultspark.plans.vault import DAY_1, DAY_2, SQL_DAY_2, day_2, hub_customer_rows
from vaultspark.sources.ingest import file_stream
from vaultspark.sources.scratch import scratch_path, stored
from vaultspark.sources.store import VersionedTable
from vaultspark.specs import bank
from vaultspark.streaming.flows import RuleCounts, fanning_out, ruled, run_available, sinking, table_stream


@query(f"""WITH {SQL_DAY_2} SELECT c_custkey AS IdentificadorCliente, CAST(0 AS BIGINT) AS VersionCarga FROM customer WHERE c_custkey > 0
UNION ALL SELECT c_custkey, 1 FROM day_2 WHERE c_custkey > 0 AND c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def table_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bronze table gets two snapshots; the hub is fed from the change feed between each and the one before, and keeps the version that
    brought a key."""
    customer = table(spark, sf_dir, "customer")
    hub, before = VersionedTable(spark, scratch_path(spark, "feed-hub")), customer.limit(0)
    for version, snapshot in enumerate((customer, day_2(customer))):
        came = arrivals(snapshot_changes(before, snapshot, ["c_custkey"]), version, load_time(DAY_1))
        rows = hub_customer_rows(came, F.col("VersionCarga"))
        hub.append(new_by_key(rows, hub.read(), ["Hash_Cliente"]), version)
        before = snapshot
    return hub.read().select("IdentificadorCliente", "VersionCarga")


@query("SELECT o_orderkey AS IdentificadorTransaccion, o_orderstatus AS TipoTransaccion, CAST(o_totalprice AS DECIMAL(18,2)) AS monto, CAST(o_orderkey % 2 AS BIGINT) AS VersionCarga FROM orders")
def stream_over_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders land in two drops and are streamed into a bronze table; a second stream reads that table and feeds hub and satellite, which
    keep the batch that brought a row. Each stream runs once more without news."""
    orders, path = table(spark, sf_dir, "orders"), scratch_path(spark, "table-stream")
    key, version = business_key("o_orderkey").alias("Hash_Transaccion"), F.col("VersionCarga")
    projections = {
        "hub": [key, F.col("o_orderkey").alias("IdentificadorTransaccion"), version],
        "sat": [key, F.col("o_orderstatus").alias("TipoTransaccion"), F.col("o_totalprice").cast("decimal(18,2)").alias("monto")],
    }
    targets = {name: VersionedTable(spark, f"{path}-{name}") for name in projections}
    fan = fanning_out(targets, projections)
    handle = lambda rows, batch: fan(rows.withColumn("VersionCarga", F.lit(batch).cast("long")), batch)
    for drop in (0, 1, 1):
        if not targets["hub"].exists() or targets["hub"].last_batch < drop:
            orders.filter(F.col("o_orderkey") % 2 == drop).write.parquet(f"{path}-landing/{drop}")
        sinking(file_stream(spark, f"{path}-landing/*", orders.schema), f"{path}-bronze", f"{path}-bronze-checkpoint")
        run_available(table_stream(spark, f"{path}-bronze"), handle, f"{path}-silver-checkpoint")
    return targets["hub"].read().join(targets["sat"].read(), "Hash_Transaccion").drop("Hash_Transaccion")


_STREAM_RULES = {"drop": {"positive_amount": "o_totalprice > 50000"}, "warn": {"known_priority": "o_orderpriority IN ('1-URGENT', '2-HIGH')"}, "fail": {"key_set": "o_orderkey IS NOT NULL"}}


@query("""WITH b AS (SELECT CAST(o_orderkey % 3 AS BIGINT) AS batch, count(*) AS n, count(*) FILTER (NOT o_totalprice > 50000) AS dropped, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS warned FROM orders GROUP BY 1)
SELECT batch, n, unnest(['drop positive_amount', 'warn known_priority', 'fail key_set']) AS rule, unnest([dropped, warned, 0]) AS broken, (SELECT sum(n - dropped)::BIGINT FROM b) AS kept, true AS stopped FROM b""")
def stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stream into a table under rules in three drops: what each batch breaks, and what the table keeps. A fourth drop has a row without
    key: it stops the query, and the table stays as it was."""
    orders, path = table(spark, sf_dir, "orders"), scratch_path(spark, "ruled")
    counts, stopped = RuleCounts(spark), False
    drops = [orders.filter(F.col("o_orderkey") % 3 == b) for b in range(3)] + [orders.withColumn("o_orderkey", F.nullif("o_orderkey", F.lit(orders.agg(F.min("o_orderkey")).first()[0])))]
    for b, drop in enumerate(drops):
        drop.write.parquet(f"{path}/landing/{b}")
        try:
            sinking(ruled(file_stream(spark, f"{path}/landing/*", orders.schema), _STREAM_RULES, "orders"), f"{path}/bronze", f"{path}/checkpoint")
        except StreamingQueryException as e:
            stopped = b == 3 and "a row violates key_set" in str(e)
    seen = counts.settled()["orders"]
    kept = spark.read.parquet(f"{path}/bronze").count()
    told = [(b, row["rows"], rule, row[rule], kept, stopped) for b, row in seen.items() for rule in row if rule != "rows"]
    return spark.createDataFrame(told, "batch long, n long, rule string, broken long, kept long, stopped boolean")


INCOME = THRESHOLDS["CATEGORIA_INGRESOS"]

def _master() -> dict:
    """By satellite: what of a customer stands for an attribute."""
    return {
        "Sat_Cliente_DatosEstables": {"pais_residencia": F.col("c_nationkey").cast("string"), "CategoriaIngresos": threshold_class(F.col("c_acctbal"), INCOME), "RangoEtario": F.lit(UNKNOWN)},
        "Sat_Cliente_Contacto": {"nombre_completo_cliente": F.col("c_name")},
        "Sat_Cliente_Clasificacion": {"segmento_cliente": F.col("c_mktsegment"), "region_geografica": F.col("c_nationkey")},
        "Sat_Cliente_Financiero": {"ingresos_cliente": F.col("c_acctbal")},
    }


def _master_satellite(customer: DataFrame, name: str, day: str) -> DataFrame:
    given = _master()[name]
    values = [given.get(a, F.lit(None).cast("string")).alias(a) for a in bank.DIMENSIONS["Dim_Cliente"][3][name]]
    rows = customer.select(business_key("c_custkey").alias("Hash_Cliente"), *values, load_time(day).alias("FechaRegistro"))
    return rows.withColumn("Hash_Diferenciador", change_hash("Hash_Cliente", *bank.DIMENSIONS["Dim_Cliente"][3][name]))


@query(f"""WITH {SQL_DAY_2}, every AS (SELECT *, 1 AS day FROM customer UNION ALL SELECT *, 2 FROM day_2),
now AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY day DESC) = 1)
SELECT sha256(CAST(c_custkey AS VARCHAR)) AS Hash_Cliente, c_custkey AS IdentificadorCliente, CAST(c_nationkey AS VARCHAR) AS PaisResidencia, {_case("c_acctbal", INCOME)} AS CategoriaIngresos,
  c_name AS NombreCompletoCliente, c_mktsegment AS SegmentoCliente, c_nationkey AS RegionGeografica, c_acctbal AS IngresosCliente, true AS has_id, 28 AS columnas FROM now WHERE c_custkey > 0""")
def dim_customer_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer dimension in its closed schema, from the hub and the histories of four satellites over two days; attributes
    that a customer doesn't have are null."""
    customer = table(spark, sf_dir, "customer")
    later = day_2(customer)
    hub = new_by_key(hub_customer_rows(customer.unionByName(later)), None, ["Hash_Cliente"])
    histories = {}
    for name in bank.DIMENSIONS["Dim_Cliente"][3]:
        first = changed_rows(_master_satellite(customer, name, DAY_1), None, "Hash_Cliente")
        histories[name] = first.unionByName(changed_rows(_master_satellite(later, name, DAY_2), first, "Hash_Cliente"))
    out = bank.dimension("Dim_Cliente", hub, histories)
    chosen = ["Hash_Cliente", "IdentificadorCliente", "PaisResidencia", "CategoriaIngresos", "NombreCompletoCliente", "SegmentoCliente", "RegionGeografica", "IngresosCliente"]
    return out.select(*chosen, (F.col("DimIdCliente") == surrogate_key("Hash_Cliente")).alias("has_id"), F.lit(len(out.columns)).alias("columnas"))


#: What each class table is asked of: table and value, alike in Spark and DuckDB.
_CLASSED = {
    "RANGO_ETARIO": ("customer", "c_custkey % 90"),
    "CATEGORIA_INGRESOS": ("customer", "c_acctbal * 10"),
    "CATEGORIA_SALDO": ("customer", "c_acctbal"),
    "UTILIZACION_CREDITO": ("lineitem", "l_discount"),
    "SOBREGIRO": ("orders", "o_totalprice / 100"),
    "RANGO_MONTO": ("lineitem", "l_extendedprice"),
    "RIESGO_FRAUDE": ("orders", "o_orderkey % 103"),
}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, {_case(value, THRESHOLDS[kind])} AS label, count(*) AS n FROM {t} GROUP BY ALL" for kind, (t, value) in _CLASSED.items()))
def threshold_class_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each label of the seven class tables has; values between two bands have none. A table is read once."""
    out = None
    for name in dict.fromkeys(t for t, _ in _CLASSED.values()):
        labels = [F.struct(F.lit(kind).alias("kind"), threshold_class(F.expr(value), THRESHOLDS[kind]).alias("label")) for kind, (t, value) in _CLASSED.items() if t == name]
        rows = table(spark, sf_dir, name).select(F.explode(F.array(*labels)).alias("c")).groupBy("c.kind", "c.label").agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


_AMOUNT, _FRAUD, _SCORE = "o_totalprice - 50000", "o_orderkey % 110", "c_acctbal / 5"
_TELLS = "SELECT '{}' AS entity, '{}' AS action, '{}' AS rule, {} AS broken, {} AS kept FROM {}"
_AMOUNTS_KEPT, _FACT_KEPT = f"count(*) FILTER ({_AMOUNT} > 0)", "count(*) FILTER (o_totalprice > 0)"


def _breaks(rule: str) -> str:
    return f"count(*) FILTER (NOT coalesce({rule}, false))"


_SQL_RULES = [
    ("hub_transaction", "fail", "key_set", "0", "count(*)", "orders"),
    ("hub_transaction", "fail", "hash_set", "0", "count(*)", "orders"),
    ("sat_transaction_amounts", "drop", "positive_amount", _breaks(f"{_AMOUNT} > 0"), _AMOUNTS_KEPT, "orders"),
    ("sat_transaction_amounts", "warn", "fraud_range", _breaks(f"{_FRAUD} BETWEEN 0 AND 100"), _AMOUNTS_KEPT, "orders"),
    ("sat_customer_finance", "warn", "score_range", _breaks(f"{_SCORE} BETWEEN 300 AND 1150"), "count(*)", "customer"),
    ("dim_operation", "fail", "id_set", "0", "count(*)", "(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"),
    ("dim_operation", "fail", "hash_set", "0", "count(*)", "(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"),
    *[("enriched", "fail", r, "0", "count(*)", "fact") for r in ("transaction_set", "customer_set", "id_set", "kind_known")],
    *[("fact", "fail", r, "0", _FACT_KEPT, "fact") for r in ("id_set", "transaction_set", "date_set", "kind_known")],
    ("fact", "warn", "operation_set", "0", _FACT_KEPT, "fact"),
    ("fact", "drop", "positive_amount", _breaks("o_totalprice > 0"), _FACT_KEPT, "fact"),
]


@query(f"WITH {SQL_FACT} " + " UNION ALL ".join(_TELLS.format(*row) for row in _SQL_RULES))
def entity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub, satellites, dimension, enriched rows and fact under their rules, each computed once: how many rows break each rule and how
    many are kept. Orders are transactions; amount, fraud risk and score are expressions that some rows break."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = business_key("o_orderkey").alias("Hash_Transaccion")
    kind = F.when(F.col("TipoTransaccion") == WITHDRAWAL, "DATM").when(F.col("TipoTransaccion") == DEPOSIT, "CATM")
    whole = stored(fact(spark, sf_dir).withColumn("TipoTransaccion", kind), "fact")  # for two entities
    entities = {
        "hub_transaction": new_by_key(orders.select(key, F.col("o_orderkey").alias("IdentificadorTransaccion")), None, ["Hash_Transaccion"]),
        "sat_transaction_amounts": orders.select(key, F.expr(_AMOUNT).alias("monto_principal"), F.expr(_FRAUD).alias("riesgo_fraude")),
        "sat_customer_finance": customer.select(business_key("c_custkey").alias("Hash_Cliente"), F.expr(_SCORE).alias("score_cliente")),
        "dim_operation": _dim_operation(spark, sf_dir).select("DimIdOperacion", "Hash_Operacion"),
        "enriched": whole.select("Hash_Transaccion", "Hash_Cliente", "DimIdCliente", "TipoTransaccion"),
        "fact": whole,
    }
    told = []
    for entity, rows in entities.items():
        kept, broken = quality.governed(rows, quality.RULES[entity], entity)
        n = kept.count()
        told += [(entity, action, rule, broken[action][rule], n) for action, rules in quality.RULES[entity].items() for rule in rules]
    return spark.createDataFrame(told, "entity string, action string, rule string, broken long, kept long")


@query("SELECT count(*) AS n, 0 AS rows_out_of_order, 0 AS files_that_overlap FROM lineitem")
def layout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written by its layout keys, as it lies on disk: rows of a file that come before the one ahead of them, and files whose
    keys reach into the next one's."""
    path = scratch_path(spark, "layout")
    keys = ["l_shipdate", "l_orderkey"]
    write_sorted(table(spark, sf_dir, "lineitem").select("l_quantity", *keys), path, keys)
    files = order_on_disk(spark.read.parquet(path), keys)
    files = files.withColumn("over", F.lag("high").over(Window.orderBy("low", "high")) > F.col("low"))  # one row per file
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("back"), F.lit(0)).alias("rows_out_of_order"), F.count_if("over").alias("files_that_overlap"))


@query("SELECT count(*) AS n, count(*) FILTER (l_partkey BETWEEN q[1] AND q[2]) AS asked, true AS fewer_files FROM lineitem, (SELECT [quantile_disc(l_partkey, 0.4), quantile_disc(l_partkey, 0.42)] AS q FROM lineitem)")
def layout_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table laid out along a curve through two keys: the rows of a fiftieth of the second key, and whether fewer than half as many files have to be
    read for them as of the same table in order of the first key, then the second."""
    lines, path, keys = table(spark, sf_dir, "lineitem").select("l_quantity", "l_shipdate", "l_partkey"), scratch_path(spark, "curve"), ["l_shipdate", "l_partkey"]
    n = lines.count()
    low, high = exact_quantiles(lines, "l_partkey", [0.4, 0.42])
    write_curve(lines, f"{path}-curve", keys, max(1, n // 256))
    write_sorted(lines, f"{path}-sorted", keys, rows_per_file=max(1, n // 256))
    curve, ordered = spark.read.parquet(f"{path}-curve"), spark.read.parquet(f"{path}-sorted")
    (few, _), (many, _) = (files_to_read(d, "l_partkey", low, high) for d in (curve, ordered))
    return curve.agg(F.count("*").alias("n"), F.count_if(F.col("l_partkey").between(low, high)).alias("asked"), F.lit(2 * few < many).alias("fewer_files"))
