"""Every operator and stage on tables with clashing column names, without ids, and with one id for all rows."""

import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import BYTE, WORDS, text_of
from vaultspark.llm import language, minhash, mixing, packing, secrets, substring, tokens
from vaultspark.llm.common import shared_folder

CLASHING = "_id _h _copy _kinds _source _letters _text_hash _row _key row key text_hash class band bands letters unit of kinds maybe word mask low chunks done hit draw zip at on".split()
TEXTS = [text_of(31, 60), "short token=abcdefgh99", "deadbeef" * 5 + " x"]


def _own(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, k: (i, TEXTS[k % 3], "en", "abc"[k % 3], len(TEXTS[k % 3]))
    some = [row(k, k) for k in range(1, 10)] + [(10, None, None, None, None), (None, "", "en", "a", 0)]
    return {
        "clashing": _own(spark.createDataFrame(some, schema)).repartition(3).cache(),
        "no ids": _own(spark.createDataFrame([row(None, k) for k in range(9)], schema)).cache(),
        "one id": spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("n_chars")).cache(),
        "empty": _own(spark.createDataFrame([], schema)),
    }


def keeps(out, docs):
    """All columns and values of the caller's are there."""
    own = [c for c in docs.columns if c in CLASHING]
    assert set(docs.columns) <= set(out.columns)
    broken = out.filter(F.lit(False) if not own else ~F.array_min(F.array(*[F.col(c) == f"own {c}" for c in own])))
    assert broken.isEmpty()
    return out.count()


@pytest.mark.parametrize("name", ["clashing", "no ids", "one id", "empty"])
def test_operators(spark, tables, name):
    docs = tables[name]
    n = docs.count()
    assert keeps(language.identify(docs, language.train(docs)), docs) == n
    assert keeps(mixing.mixing_plan(docs), docs) == n
    assert mixing.mix(docs).columns == docs.columns and (n == 0 or mixing.mix(docs).count() > 0)
    found = secrets.find_secrets(docs)
    assert keeps(found, docs) == n
    assert found.filter(F.contains("text", F.lit("token=")) & (F.size("spans") != 1)).isEmpty()
    clean = secrets.redact(docs)
    assert keeps(clean, docs) == n and clean.filter(F.contains("text", F.lit("abcdefgh99"))).isEmpty()
    assert minhash.near_duplicates(docs).count() == n
    kept = minhash.deduplicated(docs)
    assert keeps(kept, docs) == {"clashing": 5, "no ids": 9, "one id": 3, "empty": 0}[name]
    removed = substring.remove_repeats(docs, keep_text=False)
    assert removed.count() == n and {r[0] for r in removed.filter("n_words = 60").select("n_removed").distinct().collect()} <= {60}
    out = f"{shared_folder(spark)}/awkward-{uuid.uuid4().hex}"
    tokens.write_tokens(docs, WORDS, 2, out)
    assert tokens.read_tokens(spark, out, with_ids=False).count() == n
    assert packing.pack(docs, BYTE, 0, with_ids=False).filter("start = 0").count() == n


@pytest.mark.parametrize("name", ["clashing", "no ids", "one id", "empty"])
def test_stages(spark, sf_dir, tables, name):
    docs = tables[name]
    for stage, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        assert out.columns == docs.columns, stage
        keeps(out, docs)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
