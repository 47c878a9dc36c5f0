"""The pipeline and the registered queries, against plain versions and SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.llm import brute
from tests.llm.test_text_operators import BYTE, check_packed, text_of
from tests.test_queries import table_of
from vaultspark.llm import mixing
from vaultspark.llm.oracles import ORACLES
from vaultspark.llm.queries import QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(9001, None, "en", "src1", None), (9002, "12 34 !!", "en", "src1", 8), (None, "no id here", "en", None, 10), (9003, text_of(1, 30) + " password=abcdefgh99", "en", "src2", 40)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).select(*docs.columns, F.lit("kept").alias("_row"))
    columns = docs.columns
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        after = out.collect()
        if name == "language_id":
            assert sorted(str(r) for r in after) == sorted(str(r) for r in before if re.search(r"[^\W\d_]", r["text"] or ""))
        elif name == "near_dedup":
            component, _ = brute.components([(r["doc_id"], r["text"]) for r in before], 5)
            assert sorted(str(r) for r in after) == sorted(str(r) for r, c in zip(before, component) if r["doc_id"] == c)
        elif name == "secret_scan":
            assert len(after) == len(before) and not [1 for r in after if brute.secrets(r["text"])]
            texts = {r["doc_id"]: r["text"] for r in after}
            assert all(texts[r["doc_id"]] == r["text"] for r in before if not brute.secrets(r["text"]))
        else:
            sizes = {}
            for r in before:
                sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORD.findall(r["text"]))
            want, copies = brute.targets(sizes), {}
            for r in after:
                copies[str(r)] = copies.get(str(r), 0) + 1
            for r in before:
                rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
                assert int(rate + 1e-9) <= copies.get(str(r), 0) <= min(3, int(rate) + 1)
        docs, before = spark.createDataFrame(after, docs.schema), after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packed(pieces, [(r["doc_id"], r["text"]) for r in before], BYTE, 0, 1024)


def test_pipeline_runs_and_agrees_with_itself(spark, sf_dir):
    one, two = (corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect() for _ in range(2))
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) > 100


def test_entry_registers_everything():
    assert {re.match(r"op\d+", n)[0] for n in QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert QUERIES.keys() <= queries().keys() and "pipeline" in queries() and ORACLES.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns) and table_of(got.columns, got.collect()) == table_of(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_gives_whole_results(name, spark, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    if name in ("op8_neighbours", "op9_topk"):
        n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 100 = 0").count()
        assert got.count() == 10 * n
    else:
        ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
        assert {r["doc_id"] for r in got.collect()} == ids


def test_mixing_seed_matters(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = [sorted((r["doc_id"], r["copies"]) for r in mixing.mixing_plan(docs, seed).collect()) for seed in (1, 1, 2)]
    assert taken[0] == taken[1] != taken[2]
