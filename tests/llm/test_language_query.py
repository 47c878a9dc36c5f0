"""The whole language query against a plain version."""

import random
import zlib

import numpy as np

from vaultspark.llm import language


def test_query_is_what_the_trees_of_the_other_texts_say(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    samples = {}
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"]:
            samples.setdefault(r["lang"], []).append(r["text"].encode())
    assert all(len(t) <= language.SAMPLE_DOCS and sum(map(len, t)) <= language.SAMPLE_BYTES for t in samples.values())  # so all are learned
    model = language.build_model(samples)
    got = {r["doc_id"]: r for r in language.op1_language(spark, sf_dir).collect()}
    assert got.keys() == held.keys() and any(held.values())
    for r in rows:
        one, text = got[r["doc_id"]], r["text"] or ""
        assert one["held_out"] == held[r["doc_id"]]
        if not any(c.isalpha() for c in text):
            assert (one["lang_pred"], one["score"]) == ("und", 0.0)
            continue
        bits = model.code_lengths([text.encode()])[0]
        weight = np.exp2(np.maximum(bits.min() - bits, -1000))
        assert one["lang_pred"] == model.langs[int(bits.argmin())] and abs(one["score"] - weight.max() / weight.sum()) < 1e-6


def test_every_language_is_learned(spark):
    """Seventy labels, one of them with few rows among many of the others, and one with texts of a megabyte only."""
    words = [["".join(random.Random(100 * k + i).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for i in range(9)] for k in range(69)]
    text = lambda k, n: " ".join(words[k][i * i % 9] for i in range(n))
    rows = [(100 * k + i, text(k, 30), f"l{k}") for k in range(69) for i in range(3 if k else 900)]
    long = "щука и лещ " * 95_000
    rows += [(9000 + i, f"{i} {long}", "long") for i in range(5)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.langs) == sorted({r[2] for r in rows}) and len(model.langs) == 70
    asked = spark.createDataFrame([(1, "лещ и щука"), (2, text(5, 12)), (3, text(68, 12))], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(asked, model).collect()} == {1: "long", 2: "l5", 3: "l68"}


def test_a_text_longer_than_a_block(spark):
    """Its code length is the sum over its parts' bytes, each after its own context."""
    model = language.build_model({"a": [b"the cat sat on the mat. " * 40], "b": [b"der hund lag auf dem bett. " * 40]})
    long = ("the cat lag on dem mat. " * (3 * language.BLOCK // 24)).encode()
    whole = model.code_lengths([b"x", long, b"y"])[1]
    cut = language.BLOCK // 24 * 24  # the same words on both sides
    halves = model.code_lengths([long[:cut], long[cut - language.ORDER :], long[cut - language.ORDER : cut]])
    assert np.allclose(whole, halves[0] + halves[1] - halves[2])
