"""Every query of the library runs, has the columns of its SQL, and gives its rows."""

import decimal
import math

import duckdb
import pytest

from vaultspark.plans.oracles import ORACLES
from vaultspark.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.4f}"
    return str(value)[:200]


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert got.count() > 0
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert table_of(got.columns, got.collect()) == table_of(names, result.fetchall())


def test_samples_are_nested(spark, sf_dir):
    rows = QUERIES["keyed_samples"](spark, sf_dir).collect()
    assert 0 < sum(r["in_small"] for r in rows) < len(rows)
