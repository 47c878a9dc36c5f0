"""The bank's whole vault and its dimensions, loaded from files over two days.

What stands for a source's columns is stated once, as expressions that read alike in Spark and DuckDB; hashes, classes, versions and
schemas are made by the library on one side and by plain SQL on the other. Customers are the master, an order's line items are an account,
orders are transactions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.config import THRESHOLDS, Settings
from vaultspark.functions.keys import surrogate_key
from vaultspark.operators.loaders import growing
from vaultspark.plans.registry import query, table
from vaultspark.plans.star import _case
from vaultspark.plans.vault import DAY_1, DAY_2, SQL_DAY_2, day_2
from vaultspark.sources.scratch import scratch_path
from vaultspark.specs.bank import CLASSES, DIMENSIONS, KEY_NAMES, KEYS, SATELLITES, dimension
from vaultspark.streaming.bank import HUBS, KIND_OF, LINKS, BankVault, rules_of

DAYS = (DAY_1, DAY_2)
_MONEY = "CAST({} AS DECIMAL(18,2))"
_OPENED = "CAST(o_orderdate AS DATE)"

#: By source: a row's number and date, from which columns without a counterpart are filled, and what stands for the others. {day} is
#: 0 or 1.
GIVEN = {
    "CMSTFL": ("c_custkey", "DATE '2020-01-01'", {
        "CUSTID": "c_custkey", "CUSAG2": "18 + c_custkey % 70", "CUSNM": "c_name", "CUSMD": "CASE WHEN c_custkey % 2 = 0 THEN c_name END",
        "CUSPH": "CAST(c_custkey + CASE WHEN c_custkey % 7 = 0 THEN {day} ELSE 0 END AS STRING)", "CUSSG": "c_mktsegment", "CUSRG": "CAST(c_nationkey AS STRING)",
        "CUSSC": "300 + c_custkey % 900", "CUSIN": "CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 10 AS DECIMAL(18,2))", "CUSBL": "CAST(c_acctbal AS DECIMAL(18,2))",
    }),
    "BLNCFL": ("o_orderkey", _OPENED, {
        "CUSTID": "o_custkey", "BLSQ": "o_orderkey", "BLACT": "o_orderpriority", "BLST": "CASE WHEN o_orderkey % 9 = 0 AND {day} = 1 THEN 'B' ELSE o_orderstatus END",
        "BLAV": "CAST(coalesce(total, 0) + CASE WHEN o_orderkey % 4 = 0 THEN 1000 * {day} ELSE 0 END AS DECIMAL(18,2))", "BLTB": "total", "BLRT": "discount",
        "BLOV": "CAST(o_orderkey % 4000 AS DECIMAL(18,2))", "BLCL": "CAST(lines AS STRING)",
    }),
    "TRXPFL": ("o_orderkey", _OPENED, {
        "TRXID": "CAST(o_orderkey AS STRING)", "CUSTID": "o_custkey", "TRXDT": _OPENED, "TRXTYP": "CASE o_orderkey % 4 WHEN 0 THEN 'DATM' WHEN 1 THEN 'CATM' ELSE 'CMPR' END",
        "TRXCH": "CASE WHEN o_orderkey % 5 = 0 THEN 'ATM' ELSE 'POS' END", "TRXAMT": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 50000 AS DECIMAL(18,2))",
        "TRXFR": "CAST(o_orderkey % 110 AS DECIMAL(18,2))", "TRXST": "o_orderstatus", "TRXDSC": "o_orderpriority",
    }),
}
_WHOLE = {"CUSYR", "CUSDP2", "CUSAC2", "CUSTX", "CUSLR", "CUSRC", "TRXSQ"}

#: DuckDB: the rows of a source on each day. An order's line items make an account; some accounts open on the second day, some close.
_ACCOUNT = """account AS (SELECT o.*, total, discount, lines FROM orders o LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total,
  max(CAST(l_discount AS DECIMAL(18,2))) AS discount, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_SQL_ROWS = {
    "CMSTFL": (SQL_DAY_2, "customer", "day_2"),
    "BLNCFL": (_ACCOUNT, "account WHERE o_orderkey % 10 <> 3", "account WHERE o_orderkey % 10 <> 7"),
    "TRXPFL": ("none AS (SELECT 1)", "orders WHERE o_orderkey % 3 <> 0", "orders WHERE o_orderkey % 3 = 0"),
}


def _columns(source: str, day: int) -> dict[str, str]:
    """Every column that a source's hubs, links and satellites read, and the expression that gives it on a day."""
    number, date, given = GIVEN[source]
    out = {c: e.format(day=day) for c, e in given.items()}
    for name, satellite in SATELLITES.items():
        if name.startswith(f"{KIND_OF[source]}_"):
            for n, (column, attribute) in enumerate(satellite.names.items(), 2):
                if attribute.startswith("fecha_"):
                    filled = f"CAST({date} + INTERVAL {n} DAY AS DATE)"
                elif column in _WHOLE:
                    filled = f"{number} % {n}"
                else:
                    filled = _MONEY.format(f"({number} * 31 + {n}) % 1000") if name.endswith("Montos") else f"'{column}-' || CAST({number} % {n} AS STRING)"
                out.setdefault(column, filled)
    return out


def _days(spark: SparkSession, sf_dir: str, source: str) -> list[DataFrame]:
    """The rows of a source on each day, as files bring them. They are dealt by key while they are narrow: a file of the source may be a single
    row group, and everything after has as many tasks as the files that land. Within a file they come by date, so that the many dates of a row, here and in
    all tables that are fed from it, are stored as runs."""
    number = GIVEN[source][0]
    if source == "CMSTFL":
        rows = [r.repartition(number) for r in (table(spark, sf_dir, "customer"), day_2(table(spark, sf_dir, "customer")))]
    else:
        orders = table(spark, sf_dir, "orders").repartition(number)
        if source == "BLNCFL":
            lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
            sums = lines.agg(F.expr("CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total"), F.expr("max(CAST(l_discount AS DECIMAL(18,2))) AS discount"), F.count("*").alias("lines"))
            orders = orders.join(growing(sums), "o_orderkey", "left")
            rows = [orders.filter("o_orderkey % 10 <> 3"), orders.filter("o_orderkey % 10 <> 7")]
        else:
            rows = [orders.filter("o_orderkey % 3 <> 0"), orders.filter("o_orderkey % 3 = 0")]
        rows = [r.sortWithinPartitions("o_orderdate") for r in rows]
    return [r.selectExpr(*[f"{e} AS {c}" for c, e in _columns(source, day).items()]) for day, r in enumerate(rows)]


def _settings(spark: SparkSession) -> Settings:
    root = scratch_path(spark, "bank")
    layers = {f"{layer}_dir": f"{root}/{layer}" for layer in ("landing", "bronze", "silver", "gold", "checkpoint")}
    sources = {f"{s.lower()}_{what}": f"{s}-{what}" for s in GIVEN for what in ("path", "schema")}
    return Settings(**layers, **sources)


def bank_vault(spark: SparkSession, sf_dir: str, *sources: str, told=lambda entity, batch, counts: None) -> BankVault:
    """The vault of some sources after two days; what a day brings lands as files in the folder of its date and is loaded before the next
    day's land. A last run finds nothing new."""
    settings = _settings(spark)
    for source in sources:
        for day, rows in [*enumerate(_days(spark, sf_dir, source)), (1, None)]:
            vault = BankVault(spark, settings, DAYS[day], told=told)
            if rows is not None:
                year, month, date = DAYS[day].split("-")
                rows.write.option("compression", "zstd").parquet(f"{settings.drops(source)}/año={year}/mes={month}/dia={date}")
                schema = rows.schema
            vault.ingest(source, schema)
            vault.load(source)
    return BankVault(spark, settings, DAYS[-1])


def _of_source(source: str) -> dict[str, tuple[str, list[str]]]:
    """By entity: its hash column, and the columns that its rows are told by."""
    kind = KIND_OF[source]
    key, keys, _ = KEYS[kind]
    out = {HUBS[kind]: (key, [KEY_NAMES[k] for k in keys])}
    if kind in LINKS:
        out[LINKS[kind]] = ("Hash_Link", ["Hash_Cliente", key])
    return out | {n: (key, [*s.names.values(), *s.class_names]) for n, s in SATELLITES.items() if n.startswith(f"{kind}_")}


def _loaded(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    vault = bank_vault(spark, sf_dir, source)
    rows = []
    for entity, (key, columns) in _of_source(source).items():
        digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
        rows.append(vault.table(entity).read().select(F.lit(entity).alias("entidad"), F.col(key).alias("clave"), F.col("FechaRegistro").cast("date").alias("dia"), digest.alias("atributos")))
    return reduce(DataFrame.unionAll, rows)


def _sql_source(source: str) -> str:
    """DuckDB: the source's rows of both days, day 0 and day 1, with hashes under their names."""
    key, keys, _ = KEYS[KIND_OF[source]]
    ctes, *days = _SQL_ROWS[source]
    parts = " UNION ALL ".join(f"SELECT {day} AS day, {', '.join(f'{e} AS {c}' for c, e in _columns(source, day).items())} FROM {rows}" for day, rows in enumerate(days))
    texts = [f"CAST({k} AS VARCHAR)" for k in keys]
    own = f"sha256({texts[0] if len(texts) == 1 else f"concat_ws('|', {', '.join(texts)})"}) AS {key}"
    customer = "" if key == "Hash_Cliente" else ", sha256(CAST(CUSTID AS VARCHAR)) AS Hash_Cliente"
    return f"WITH {ctes}, plain AS ({parts}), src AS (SELECT *, {own}{customer}, DATE '{DAY_1}' + CAST(day AS INTEGER) AS dia FROM plain)"


def _sql_classes(name: str) -> list[str]:
    out = [_case(column, THRESHOLDS[bands]) for _, column, bands in CLASSES.get(name, ())]
    if name == "Sat_Transaccion_DatosEstables":
        out.append("CASE WHEN TRXTYP = 'DATM' THEN 'RETIRO_ATM' WHEN TRXTYP = 'CATM' THEN 'DEPOSITO_ATM' WHEN TRXCH = 'ATM' THEN 'OTRA_OP_ATM' ELSE 'NO_ATM' END")
    return out


def _sql_loaded(source: str) -> str:
    """DuckDB: what each entity holds. States keep a key's last day in hubs and links and each day that changed it in satellites; what
    happens once is kept as it came."""
    kind, out = KIND_OF[source], []
    key, keys, _ = KEYS[kind]
    for entity, (hashed, _) in _of_source(source).items():
        satellite = SATELLITES.get(entity)
        values = [*satellite.names, *_sql_classes(entity)] if satellite else keys if entity in HUBS.values() else ["Hash_Cliente", key]
        clave = "sha256(Hash_Cliente || '|' || " + key + ")" if hashed == "Hash_Link" else hashed
        kept = " AND ".join(r.replace("IdentificadorCliente", "CUSTID").replace("monto_principal", "TRXAMT") for r in rules_of(entity).get("drop", {}).values())
        digest = f"md5(concat_ws('|', {', '.join(f'CAST({v} AS VARCHAR)' for v in values)}))"
        rows = f"SELECT '{entity}' AS entidad, {clave} AS clave, dia, {digest} AS atributos FROM src WHERE {kept or 'true'}"
        if kind == "Sat_Transaccion":
            out.append(rows)
        elif satellite:
            out.append(f"SELECT * FROM ({rows}) QUALIFY atributos IS DISTINCT FROM lag(atributos) OVER (PARTITION BY clave ORDER BY dia)")
        else:
            out.append(f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY clave ORDER BY dia DESC) = 1")
    return f"{_sql_source(source)} {' UNION ALL '.join(f'({o})' for o in out)}"


@query(_sql_loaded("CMSTFL"))
def bank_customers_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' hub and four satellites, from files over two days: every row's key, day and digest of all its attributes."""
    return _loaded(spark, sf_dir, "CMSTFL")


@query(_sql_loaded("BLNCFL"))
def bank_balances_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations' hub, link and three satellites, as bank_customers_loaded."""
    return _loaded(spark, sf_dir, "BLNCFL")


@query(_sql_loaded("TRXPFL"))
def bank_transactions_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions' hub, link and two satellites, as bank_customers_loaded; amounts that break the rule are left out."""
    return _loaded(spark, sf_dir, "TRXPFL")


def _sql_dimension(name: str) -> str:
    kind, id_column, own, chosen = DIMENSIONS[name]
    key, keys, source = KEYS[kind]
    columns = []
    for satellite, names in chosen.items():
        classes = dict(zip(SATELLITES[satellite].class_names, _sql_classes(satellite)))
        columns_of = {a: c for c, a in SATELLITES[satellite].names.items()} | classes
        columns += [f"{columns_of[a]} AS {target}" for a, target in names.items()]
    last = f"SELECT * FROM src WHERE CUSTID > 0 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY day DESC) = 1"
    return f"{_sql_source(source)} SELECT {key}, {', '.join(f'{k} AS {o}' for k, o in zip(keys, own))}, {', '.join(columns)}, true AS id_del_hash FROM ({last})"


def _dimension(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dimension in its closed schema over the vault that files have filled, with whether its id is that of its hash."""
    kind, id_column, _, chosen = DIMENSIONS[name]
    key, _, source = KEYS[kind]
    vault = bank_vault(spark, sf_dir, source)
    rows = dimension(name, vault.table(HUBS[kind]).read(), {s: vault.table(s).read() for s in chosen})
    return rows.withColumn("id_del_hash", F.col(id_column) == surrogate_key(key)).drop(id_column)


@query(_sql_dimension("Dim_Cliente"))
def bank_dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the customer dimension, from files to gold: current attributes of four satellites, customers that are gone included."""
    return _dimension(spark, sf_dir, "Dim_Cliente")


@query(_sql_dimension("Dim_Operacion"))
def bank_dim_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the operation dimension, as bank_dim_customer."""
    return _dimension(spark, sf_dir, "Dim_Operacion")
