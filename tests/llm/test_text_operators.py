"""The operators on texts, against plain versions, with awkward rows."""

import hashlib
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from vaultspark.llm import fmindex, language, minhash, mixing, packing, secrets, substring, tokens
from vaultspark.llm.common import shared_folder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


BASE = text_of(1, 120)
LONG = text_of(2, 30_000, 5000)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("w7 ", "W7 ") + " tail", "en", "b"), (4, text_of(3, 50) + " " + " ".join(BASE.split()[10:80]), None, "b"),
    (5, None, "en", None), (6, "", "fr", None), (7, " \t\n\x0b", "fr", "c"), (None, BASE, "en", "c"), (None, None, None, None), (8, LONG, "en", "a"), (9, "one two", "en", "c"), (10, "One TWO", "en", "c"),
    (11, "a b " * 100, "fr", "d"), (12, "été déjà vu, où ça? «là»  deux  espaces\n\n\nfin", "fr", "d"), (13, "密码 token: 'abcdefgh12' x", "zh", "d"), (14, "1234 5678 !!!", "en", "d"), (15, "x y z\x1cq ́e", "en", "e"),
    (16, "<|endoftext|> and \n\n<|endoftext|>\n", "en", "e"), (17, "İİ Σς ß 'tis don't", "en", "e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 language


def test_code_lengths_are_those_of_the_definition():
    samples = {"a": [b"abracadabra banana", "the cat café".encode()], "b": [b"xyz banana band", "über alles".encode(), b""]}
    model = language.build_model(samples)
    count = {x: {} for x in samples}
    for x, texts in samples.items():
        for t in texts:
            for k in range(1, language.ORDER + 2):
                for i in range(len(t) - k + 1):
                    count[x][t[i : i + k]] = count[x].get(t[i : i + k], 0) + 1
    for x in count:
        count[x] = {g: n for g, n in count[x].items() if n >= (language.LEAST_COUNT if len(g) > 2 else 1)}

    def bits(x, t):
        out = 0.0
        for i in range(len(t)):
            for k in range(min(language.ORDER, i), -1, -1):
                children = {g: n for g, n in count[x].items() if len(g) == k + 1 and g[:k] == t[i - k : i]}
                if not children:
                    continue
                whole = sum(children.values()) + len(children)
                if n := children.get(t[i - k : i + 1]):
                    out -= math.log2(n / whole)
                    break
                out -= math.log2(len(children) / whole)
            else:
                out += 8
        return out

    texts = [b"banana", b"", b"the band \xff zebra abra", "café über".encode(), b"a", b"bananabanana abracad"]
    whole = model.code_lengths(texts)
    assert np.allclose(whole, [[bits(x, t) for x in "ab"] for t in texts])
    block, language.BLOCK = language.BLOCK, 5
    try:
        assert np.allclose(whole, model.code_lengths(texts))
    finally:
        language.BLOCK = block


def test_language_of_held_out_texts(spark, small):
    model = language.train(small.filter(~language.held_out()))
    got = language.identify(small.filter(language.held_out()), model)
    right, n = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 30 and right > 0.97


def test_language_of_awkward_rows(spark, docs):
    model = language.train(docs)
    extra = docs.withColumn("score", F.lit("own")).withColumn("other", F.lit(1))
    rows = language.identify(extra, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["other"] == 1 for r in rows)
    assert {r["lang_pred"] for r in rows if not any(c.isalpha() for c in r["text"] or "")} == {"und"}
    assert {r["lang_pred"] for r in rows if any(c.isalpha() for c in r["text"] or "")} <= {"en", "fr", "zh"}
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"} and language.identify(docs.limit(0), model).count() == 0


# 2 token ids


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_encoder_gives_the_ids_of_the_whole_text(path):
    pieces = ["a", "B", "é", "é", "ß", "ñ", ".", ",", '"', "'s", "'", "1", "23", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "漢", "́", "​", "İ", "Σ", "-", "_", "ll", "'ll", "\r\n", "ª", "²"]
    r = random.Random(5)
    texts = ["".join(r.choices(pieces, k=r.randrange(12))) for _ in range(4000)] + [t for _, t, *_ in ROWS if t]
    whole, mine = Tokenizer.from_file(path), tokens.Encoder(path)
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want.ids, text


def test_a_tokenizer_of_another_kind_encodes_whole_texts(tmp_path):
    from tokenizers import models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"ab": 0, "c": 1, "a": 2, "?": 3}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split("a", "removed")
    other.save(str(tmp_path / "other.json"))
    mine = tokens.Encoder(str(tmp_path / "other.json"))
    assert mine.whole and not tokens.encoder(BYTE).whole and not tokens.encoder(WORDS).whole
    assert np.frombuffer(mine.encode("c a ab c"), "<u4").tolist() == other.encode("c a ab c").ids


def test_cache_turnover_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 20)
    mine, plain = tokens.Encoder(BYTE), Tokenizer.from_file(BYTE)
    for seed in range(30):
        text = text_of(seed, 40)
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == plain.encode(text).ids


def test_tokens_round_trip(spark, docs, small):
    plain = Tokenizer.from_file(WORDS)
    for df in (docs, small, docs.limit(0)):
        out = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
        tokens.write_tokens(df.withColumn("start", F.lit("own")), WORDS, 2, out)
        got = sorted(tokens.read_tokens(spark, out).collect(), key=lambda r: r["start"])
        want = sorted(((-1 if i is None else i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in pairs(df)), key=lambda r: r[0])
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"])) for r in got) == sorted(want)
        assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [i for i, _ in want]
        at = 0
        for r in got:
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), brute.crc(r["ids"]))
            at += len(r["ids"])


def test_one_document_is_read_from_its_own_frame():
    dictionary = tokens.trained([b"\1\0\2\0\3\0\4\0"], 50_000, False)
    ids = [np.array(x, "<u4").tobytes() for x in ([1, 2, 3], [], [65535, 7])]
    for wide in (False, True):
        block = tokens.pack_block(dictionary, dictionary.compressor(), 11, [(5, ids[0]), (None, ids[1]), (6, ids[2])], wide)
        before, index, frames = tokens.open_block(block, dictionary)
        assert before == 11 and [tokens.read_document(block, i, dictionary.decompressor(), index, frames).tobytes() for i in range(3)] == ids
    with pytest.raises(ValueError):
        tokens.open_block(block, tokens.trained([], 40_000, False))


# 3 mixing


def test_targets_share_the_excess(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 0, "b": 9}, {"x": 7}, {"a": 1, "b": 1, "c": 1, "d": 400, "é": 3, "Z": 20}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = brute.targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixing_awkward_rows(spark, docs):
    plan = mixing.mixing_plan(docs.withColumn("size", F.lit("own"))).collect()
    assert len(plan) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in plan)
    assert [r["size"] for r in plan] == [len(brute.WORD.findall(r["text"] or "")) for r in plan]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert mixed.count() == sum(r["copies"] for r in plan) and mixing.mix(docs.limit(0)).count() == 0
    own = docs.withColumn("target", F.lit("own"))
    assert {r["target"] for r in mixing.mix(own).collect()} == {"own"}


def test_mixing_plans_chosen_columns_alike(docs):
    columns = ["doc_id", "size", "source_size", "target", "copies"]
    narrow = mixing.mixing_plan(docs, columns=["doc_id"])
    assert narrow.columns == columns and sorted(map(str, narrow.collect())) == sorted(map(str, mixing.mixing_plan(docs).select(*columns).collect()))
    assert mixing.mixing_plan(docs, columns=["doc_id", "text"]).columns == ["doc_id", "text", *columns[1:]]


def test_mixing_comes_near_its_targets(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 7 == 0, "y").otherwise("z").alias("source"))
    for r in mixing.mixing_plan(df).groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.05


# 4 substrings


def test_matching_statistics_against_counting():
    rng = np.random.default_rng(1)
    for _ in range(40):
        symbols = int(rng.integers(1, 6))
        texts = [rng.integers(1, symbols + 1, int(rng.integers(1, 25))) for _ in range(int(rng.integers(1, 9)))]
        weights = rng.integers(1, 3, len(texts))
        count = lambda p: sum(w * sum((t[j : j + len(p)] == p).all() for j in range(len(t) - len(p) + 1)) for w, t in zip(weights, texts))
        found = fmindex.FMIndex(texts, weights, symbols).matching_statistics(texts, 2)
        for t, got in zip(texts, np.split(found, np.cumsum([len(t) for t in texts])[:-1])):
            for j in range(len(t)):
                assert got[j] == max([n for n in range(1, len(t) - j + 1) if count(t[j : j + n]) >= 2], default=0)


@pytest.mark.parametrize("words, stream", [(substring.SHARD_WORDS, substring.STREAM), (100, 2)])
def test_repeats_are_removed(spark, docs, small, monkeypatch, words, stream):
    """Also with most minimizers split over several shards, as very large ones are."""
    monkeypatch.setattr(substring, "SHARD_WORDS", words)
    monkeypatch.setattr(substring, "STREAM", stream)
    for df, window in ((docs, 35), (docs, 4), (small, 35), (docs.limit(0), 35)):
        rows = pairs(df)
        want = sorted((-1 if i is None else i, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)) for (i, _), (n, kept) in zip(rows, brute.without_repeats([t for _, t in rows], window)))
        got = substring.remove_repeats(df.withColumn("n_words", F.lit("own")), window).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_a_text_of_a_million_words(spark):
    """Two texts of 1.2 million words that differ in every hundredth: all windows between the differences repeat."""
    n = 1_200_000
    words = [f"w{i * 7919 % 1_000_003}" for i in range(n)]
    other = [f"x{i}" if i % 100 == 0 else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df, keep_text=False).collect()}
    assert got[3] == (0, 0) and got[2] == (n, n - n // 100)
    again = set(words[: n - 1_000_003])  # the words begin again after that many
    assert got[1][0] == n and n - n // 100 <= got[1][1] <= n - n // 100 + len(again)


# 5 packing


def test_best_fit_takes_the_tightest_room():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 500)
    got, offset, _ = packing.best_fit_decreasing(lengths, 64, 10)
    rooms, want = {}, {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(room, s) for s, room in rooms.items() if room >= lengths[i]]
        room, s = min(fits) if fits else (64, 10 + len(rooms))
        rooms[s], want[i] = room - lengths[i], (s, 64 - room)
    assert [(int(s), int(o)) for s, o in zip(got, offset)] == [(int(want[i][0]), int(want[i][1])) for i in range(500)]


def check_packed(rows, texts, path, end, capacity):
    """rows: pieces; texts: (doc_id, text). Every document's ids lie in its pieces, sequences are gapless."""
    plain, by_doc, by_sequence = Tokenizer.from_file(path), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == r["length"] and brute.crc(r["ids"]) == r["ids_crc32"]
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [end])
    assert by_doc.keys() == want.keys()
    for i, documents in want.items():
        pieces = sorted((r["doc_tokens"], r["start"], tuple(r["ids"])) for r in by_doc[i])
        assert pieces == sorted((len(d), a, tuple(d[a : a + capacity])) for d in documents for a in range(0, len(d), capacity))
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return sum(r["length"] for r in rows) / max(1, len(by_sequence) * capacity)


def test_packing(spark, docs, small, monkeypatch):
    monkeypatch.setattr(packing, "ROWS", 7)  # reaches the workers where they share the module: several batches a flush
    check_packed(packing.pack(docs.withColumn("length", F.lit("own")), BYTE, 0).collect(), pairs(docs), BYTE, 0, 1024)
    assert check_packed(packing.pack(small.coalesce(1), BYTE, 0).collect(), pairs(small), BYTE, 0, 1024) > 0.98
    assert packing.pack(docs.limit(0), BYTE, 0).count() == 0


# 6 near-duplicates


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_are_those_of_all_pairs(spark, docs, small, size):
    for df in (docs, small):
        rows = pairs(df)
        component, n = brute.components(rows, size)
        want = sorted((-1 if i is None else i, k, -1 if c is None else c, i is None or i == c) for (i, _), c, k in zip(rows, component, n))
        got = minhash.near_duplicates(df.withColumn("kept", F.lit("own")), size).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in got) == want
    assert minhash.near_duplicates(docs.limit(0), size).count() == 0


@pytest.mark.parametrize("stream, held", [(minhash.STREAM, minhash.HELD_BYTES), (0.25, 1000)])
def test_a_group_without_a_centre_is_found_whole(spark, monkeypatch, stream, held):
    """A chain whose ends differ, beside texts of the same bucket that are alike but not alike enough; also with leads and
    buckets dealt over many tasks."""
    monkeypatch.setattr(minhash, "STREAM", stream)
    monkeypatch.setattr(minhash, "HELD_BYTES", held)
    words = text_of(9, 100, 10_000).split()
    chain = [" ".join(words[k : 60 + k]) for k in range(0, 36, 3)]
    r = random.Random(4)
    near = [" ".join(f"z{i}x{k}" if r.random() < 0.05 else w for i, w in enumerate(words[:60])) for k in range(60)]
    rows = list(enumerate(chain + near))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = [(i, c) for (i, _), c in zip(rows, brute.components(rows, 4)[0])]
    assert len({c for _, c in want}) > 1
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df, 4).collect()) == want


def test_signatures_estimate_similarity():
    a, b = text_of(1, 2000, 10**6).split(), text_of(2, 2000, 10**6).split()
    mixed = minhash.shingle_set(" ".join(a[:1000] + b[:1000]).encode(), 1), minhash.shingle_set(" ".join(a[:1000] + b[1000:]).encode(), 1)
    same = (minhash.signature(mixed[0]) == minhash.signature(mixed[1])).mean()
    assert abs(same - 1 / 3) < 0.12 and len(minhash.signature(mixed[0])) == minhash.COORDINATES


def test_one_document_of_each_group_stays(spark, docs):
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16, 17] and ids.count(None) == 2


# 10 secrets


def test_trigram_queries_hold_for_every_match():
    assert secrets.trigram_query(r"[0-9a-f]+") is None and secrets.trigram_query("ab|cdef") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [{"aki", "kia"}]
    assert set(secrets.trigram_query("(abc|bcde)x?[0-9]")) == {frozenset({"abc"}), frozenset({"bcd", "cde"})}
    assert secrets.trigram_query("x(foobar)+y*") == [{"foo", "oob", "oba", "bar"}]
    examples = {"assign": "api_key='AAAAAAAA'", "access": "AKIA" + "A" * 12, "github": "ghp_" + "a" * 36, "slack": "xoxb-1234567890", "stripe": "sk_live_" + "a" * 16, "google": "AIza" + "b" * 35, "jwt": "eyJa.eyJb.c", "pem": "-----BEGIN RSA PRIVATE KEY-----"}
    for rule in secrets.RULES:
        if rule.kind in examples:
            assert any(conj <= secrets.trigrams(examples[rule.kind].lower()) for conj in secrets.trigram_query(rule.pattern))


def test_secrets(spark, docs, small):
    r = random.Random(8)
    pieces = ["PassWord", "secret", "tokenapi_key", " = ", ":", "'", "abcdefgh", "abcdefg", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "😀", "é", " ", "\n", "Kİſ", "ghp_" + "a" * 36, "=", "api_", "key"]
    made = spark.createDataFrame([(i, "".join(r.choices(pieces, k=12))) for i in range(400)], "doc_id long, text string").withColumn("spans", F.lit("own"))
    for df in (docs, small, made, docs.limit(0)):
        for row in secrets.find_secrets(df).collect():
            base = [(s["start"], s["kind_no"], s["kind"], s["end"]) for s in row["spans"] if s["kind_no"] < 3]
            assert base == brute.secrets(row["text"]), row["text"]
    found = secrets.find_secrets(spark.createDataFrame([(1, "ghp_" + "g" * 36 + " xoxb-1234567890")], "doc_id long, text string")).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in found] == [("github", 0, 40), ("slack", 41, 56)]


def test_a_text_full_of_secrets(spark):
    """A hundred thousand matches of one rule in one text, found and masked, over chunks and in between."""
    text = ("é" + "0f" * 16 + "x") * 100_000
    df = spark.createDataFrame([(1, text), (2, "y" * 5000 + " token=abcdefgh " + "z" * 9000)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df).collect()}
    assert len(spans[1]) == 100_000 and [tuple(s) for s in spans[1][::33_333]] == [(34 * i + 1, 2, "hex", 34 * i + 33) for i in range(0, 100_000, 33_333)]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[1] == "é[SECRET]x" * 100_000 and clean[2] == "y" * 5000 + " [SECRET] " + "z" * 9000


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_the_candidate_filter_loses_nothing(spark, small, monkeypatch, bits):
    monkeypatch.setattr(secrets, "FILTER_BITS", bits)
    for row in secrets.find_secrets(small).collect():
        assert [(s["start"], s["kind_no"], s["kind"], s["end"]) for s in row["spans"] if s["kind_no"] < 3] == brute.secrets(row["text"])


def test_redaction_leaves_clean_texts_alone(spark, docs):
    text = "é token=abcdefgh AKIA" + "B" * 14 + " end " + "0f" * 20
    df = docs.unionByName(spark.createDataFrame([(99, text, "en", "a", len(text))], SCHEMA))
    got = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert got[99]["text"] == "é [SECRET] [SECRET] end [SECRET]" and got[99]["n_chars"] == len(got[99]["text"])
    assert got[1]["text"] == BASE and got[5]["text"] is None and got[13]["text"] == "密码 [SECRET]' x"
