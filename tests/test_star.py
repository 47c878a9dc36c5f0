"""Questions on the star are asked of the rows that the fact has."""

import datetime

import duckdb
import pytest

from vaultspark.plans.oracles import ORACLES
from vaultspark.plans.queries import QUERIES

DAY = datetime.datetime(2026, 3, 5)


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    """Customers 1-12 with two orders and an operation each; besides, orders of customers that are null, not positive, in no
    hub (77) or without an operation (20), which the fact leaves out."""
    folder = tmp_path_factory.mktemp("star")
    customers = [*range(1, 13), 0, -3, 20]
    orders = [(2 * c + i, c, "FO"[i], 1000.0 if c == 1 else 10.0 + c, DAY) for c in range(1, 13) for i in (0, 1)]
    out = [(100 + i, c, s, 5000.0, DAY) for i, (c, s) in enumerate((c, s) for c in (None, 0, -3, 77, 20) for s in "FO")]
    lines = [(o[0], 1) for o in orders + out if o[1] != 20]
    frames = {
        "customer": ([(c, f"name {c}", 0, 50.0, "BUILDING") for c in customers], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": (orders + out, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_star_questions_agree_with_the_fact(spark, small_dir):
    ask = lambda name: [r.asDict() for r in QUERIES[name](spark, small_dir).collect()]
    fact = ask("fact_orders")
    assert {r["IdentificadorCliente"] for r in fact} == set(range(1, 13)) and len(fact) == 24
    total = round(sum(r["MontoPrincipal"] for r in fact), 2)
    assert [r["n"] for r in ask("load_checks") if r["entity"] == "fact"] == [24]
    assert ask("monthly_star_fact") == [{"Anio": 2026, "Mes": 3, "NombreMes": "Marzo", "transacciones": 24, "monto_total": total, "clientes": 12}]
    metrics = ask("deposit_withdrawal_metrics_fact")
    assert {r["IdentificadorCliente"]: (r["n_retiros"], r["n_depositos"]) for r in metrics} == {c: (1, 1) for c in range(1, 13)}
    (place,) = ask("segment_region_metrics_fact")
    assert (place["segmento"], place["region"], place["n_retiros"], place["n_depositos"]) == ("BUILDING", "R", 12, 12)
    assert round(place["total_retiros"] + place["total_depositos"], 2) == total
    assert [(r["IdentificadorCliente"], r["total"]) for r in ask("outlier_customers_fact")] == [(1, 2000.0)]


def test_sql_of_load_checks_counts_the_rows_of_the_fact(spark, small_dir):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["load_checks"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["load_checks"](spark, small_dir).collect()) == want and want[1][:3] == ("fact", 24, 0)
