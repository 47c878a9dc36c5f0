"""Coverage counts every row of both tables."""

from vaultspark.plans.queries import QUERIES


def test_coverage_of_whole_tables(spark, tmp_path):
    """Orders of customer 5 (5 modulo 97) and customer 98 (1 modulo 97) count; 3 has no orders, 9 and null are orphans."""
    orders = [(5,), (5,), (98,), (9,), (None,)]
    spark.createDataFrame(orders, "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, 1.0), (98, 1.0), (3, 1.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    whole = QUERIES["referential_coverage_whole"](spark, str(tmp_path)).first().asDict()
    assert {k: whole[k] for k in ("parents", "covered", "orphans", "least", "most", "mean")} == {"parents": 3, "covered": 2, "orphans": 2, "least": 1, "most": 2, "mean": 1.5}
    later = QUERIES["referential_coverage_day_2"](spark, str(tmp_path)).first().asDict()
    assert {k: later[k] for k in ("parents", "covered", "orphans")} == {"parents": 2, "covered": 1, "orphans": 3}
