"""The searches on vectors and chat formatting, against plain versions, with awkward rows."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vaultspark.llm import ann, chat, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of the rows are one vector; dimensions are few, so there are ties."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, -1.0, 0.5] if i % 3 == 0 else rng.integers(-3, 4, 4).astype(float).tolist(), 0) for i in range(1, 1200)]
    rows += [(2000, None, 0), (2100, [0.0] * 4, 0), (2200, [1.0, None, 0.0, 1.0], 0), (2300, [float("nan"), 1.0, 1.0, 1.0], 0), (2400, [float("inf"), 1.0, 1.0, 1.0], 0), (2500, [], 0), (2600, [1.0, 2.0], 0), (None, [1.0] * 4, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def usable(rows, zero):
    ok = [(r["vec_id"], np.array(r["embedding"], float)) for r in rows if r["vec_id"] is not None and r["embedding"] and len(r["embedding"]) == 4 and None not in r["embedding"] and np.isfinite(r["embedding"]).all()]
    return [(i, v) for i, v in ok if zero or v.any()]


def plain(rows, score, largest, k=10):
    out = {}
    for i, q in rows:
        if i % 100 == 0:
            found = sorted(((-score(q, v) if largest else score(q, v)), j) for j, v in rows if j != i)[:k]
            out[i] = [(j, -s if largest else s) for s, j in found]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_neighbours_among_ties_and_awkward_rows(spark, crowd):
    want = plain(usable(crowd.collect(), False), lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    got = by_query(ann.nearest(crowd.withColumn("score", F.lit("own"))))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9 and got[300] == want[300]


def test_neighbours_recall_and_scores(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got, rows = by_query(ann.nearest(table, every=5)), table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hits = []
    for q, found in got.items():
        distance = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, distance)) if ids[j] != q][:10]
        hits.append(len({ids[j] for j in order} & {j for j, _ in found}) / 10)
        assert all(s == distance[ids == j][0] for j, s in found)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("sample", [vectors.SAMPLE_ROWS, 100])
def test_recall_where_nine_in_ten_candidates_are_under_test(spark, monkeypatch, sample):
    """With a sample of a tenth and of a twentieth of the rows."""
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", sample)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    df = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in rows], "vec_id long, embedding array<float>")
    got = by_query(ann.nearest(df, every=20))
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hits = []
    for q, found in got.items():
        distance = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, distance)) if ids[j] != q][:10]
        hits.append(len({int(ids[j]) for j in order} & {j for j, _ in found}) / 10)
    assert len(ids) == 2000 and len(hits) == 100 and np.mean(hits) >= 0.9


def test_most_candidates_are_abandoned_early():
    """Clustered rows: the tests leave few for exact measuring, and lose none of the nearest."""
    rng = np.random.default_rng(3)
    block = rng.standard_normal((8, 64))[rng.integers(0, 8, 2000)] * 2 + rng.standard_normal((2000, 64)) * 0.5
    index_rotation = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    turned, measured = block @ index_rotation, []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.dtype.kind == "i":
                measured.append(len(key))
            return super().__getitem__(key)

    distance = np.sqrt(((block - block[0]) ** 2).sum(1))
    at, score = ann.scan(block[0], turned[0], float(np.sort(distance)[30]), 10, block.view(Watched), turned, np.arange(2000) != 0, np.zeros(2000, bool))
    assert set(np.argsort(distance, kind="stable")[1:11]) <= set(at.tolist()) and sum(measured) < 400


def test_large_scores_are_exact_integers(spark):
    rows = [(100, [3.0e9, 1.0, 2.0]), (1, [2.0e9, 1.0, 7.0]), (2, [2.0e9, 1.0, 8.0]), (3, [1.0e300, 0.0, 0.0]), (4, [-1.7e308, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scaled = {i: [int(np.floor(1024 * np.float64(x))) if abs(x) < 1e305 else int(np.sign(x)) * int(np.finfo(float).max) for x in v] for i, v in rows}
    want = sorted(((-max(-topk._LONG, min(topk._LONG, sum(a * b for a, b in zip(scaled[100], scaled[i])))), i) for i in (1, 2, 3, 4)))
    assert by_query(topk.top_k(df)) == {100: [(i, -s) for s, i in want]}


def test_small_and_empty_tables(spark, crowd):
    few = crowd.filter("vec_id IN (300, 301, 302, 400)")
    assert {q: len(v) for q, v in by_query(ann.nearest(few)).items()} == {300: 3, 400: 3}
    assert {q: len(v) for q, v in by_query(topk.top_k(few)).items()} == {300: 3, 400: 3}
    for search in (ann.nearest, topk.top_k):
        assert search(crowd.limit(0)).count() == 0 and search(crowd.filter("vec_id = 2000")).count() == 0 and search(crowd.filter("vec_id = 300")).count() == 0
    doubles = few.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert by_query(ann.nearest(doubles)) == by_query(ann.nearest(few))


def test_blocks_hold_every_row_once(spark, crowd, monkeypatch):
    rows, n, dim = vectors.usable(crowd, "vec_id", "embedding")
    blocks = vectors.gathered(rows.withColumn("part", (F.col("vec_id") % 3).cast("int")), ["part"], 64).collect()
    ids = np.concatenate([np.frombuffer(b["ids"], np.int64) for b in blocks])
    assert dim == 4 and len(ids) == n == len(set(ids.tolist())) and max(len(b["ids"]) for b in blocks) <= 64 * 8
    assert all((np.frombuffer(b["ids"], np.int64) % 3 == b["part"]).all() and len(b["data"]) == 4 * len(b["ids"]) for b in blocks)


def test_threshold_algorithm_is_exact(spark, crowd, sf_dir):
    want = plain(usable(crowd.collect(), True), lambda a, b: int(np.floor(1024 * a) @ np.floor(1024 * b)), True)
    assert by_query(topk.top_k(crowd)) == want
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    whole = [(r["vec_id"], np.floor(1024 * np.array(r["embedding"], float))) for r in rows]
    assert by_query(topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))) == plain(whole, lambda a, b: int(a @ b), True)


def test_lists_are_read_no_further_than_the_bound():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.standard_normal((4000, 3)) * 100)
    lists, looked = topk.SortedLists(np.arange(4000), rows), []
    query = np.array([5.0, -2.0, 0.0])

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                looked.append(len(key))
            return super().__getitem__(key)

    lists.rows = rows.view(Watched)
    ids, scores, scored = lists.top(query, -1, 10, -np.inf)
    order = np.lexsort((np.arange(4000), -(rows @ query)))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == (rows @ query)[order].tolist() and sum(looked) < 2000 and scored < 2000


# 7 chats


ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "<\\|x <|im_start|>user\nno"), (2, 1, "assistant", "first"), (2, 0, "user", None), (2, 2, "user", ""), (3, None, "user", "null turn"),
    (3, 0, "assistant", "x" * 200_000), (None, 0, "user", "no id"), (None, 1, None, "no role"), (4, 0, "a\nb<|%", "odd role"), (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "assistant", "é😀"),
]


def test_chats_are_read_back_whole(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("own")).repartition(4)
    formatted = chat.format_chats(df)
    turns = formatted.collect()
    assert len(turns) == len(ROWS) and all(r["segments"][1]["text"].count("<|") == 0 for r in turns)
    got = {r["conv_id"]: r for r in chat.read_chats(formatted).collect()}
    assert got.keys() == {r[0] for r in ROWS}
    for conv, r in got.items():
        mine = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in ROWS if c == conv))
        loss = "".join(text for _, role, text in mine if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in mine).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(s["text"]) for t in turns if t["conv_id"] == conv for s in t["segments"])
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: True, None: False, 4: False, 5: False}
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


@pytest.mark.parametrize("parts", ["3", "17"])
def test_long_conversations_go_on_over_ranges(spark, parts):
    """A conversation with most of the rows, odd roles, null and repeated turns, long equal beginnings; compared turn by turn."""
    long_role = "r" * 40
    rows = [(7, t, ("user", "assistant")[t % 2] if t % 50 else "odd", f"{'p' * 40}{t % 9}") for t in range(600)]
    rows += [(7, None, r, f"{'p' * 40}{i}") for i, r in enumerate([long_role + "b", long_role + "a", long_role, "user"] * 40)]
    rows += [(c, 0, "user", "same") for c in (None, 1, 9) for _ in range(c or 60)] + [(c, 1, "assistant", "ok") for c in range(20, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = chat.format_chats(df).collect()
        read = chat.read_turns(chat.format_chats(df)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = {}
    for conv in {r[0] for r in rows}:
        machine = chat.RoleMachine(chat.TEMPLATE)
        for seq, (_, role, text) in enumerate(sorted((-1 if t is None else t, role, text) for c, t, role, text in rows if c == conv)):
            allowed, segments = machine.turn(role, text)
            want[conv, seq] = (allowed, segments, role, text)
    assert len(turns) == len(rows) and {(r["conv_id"], r["seq"]): (r["allowed"], [(s["text"], s["loss"]) for s in r["segments"]]) for r in turns} == {k: v[:2] for k, v in want.items()}
    assert {(r["conv_id"], r["seq"]): (r["role"], r["text"]) for r in read} == {k: v[2:] for k, v in want.items()}


def test_escaping_is_reversible():
    for text in ("<|", "<\\|", "<\\\\|a<||>", "<<|<\\<|", "\\<|", "plain"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text + "\n%0A%")) == text + "\n%0A%"


def test_a_block_is_sorted_once_for_all_its_queries(monkeypatch):
    r = np.random.default_rng(5)
    blocks = [(np.arange(b, b + 40, dtype="i8"), r.normal(size=(40, 3))) for b in (0, 100)]
    asks = [(np.array([7 + a, 500 + a], "i8"), r.normal(size=(2, 3)), np.full(2, -np.inf)) for a in range(3)]
    built = []

    class Counted(topk.SortedLists):
        def __init__(self, ids, rows):
            built.append(ids[0])
            super().__init__(ids, rows)

    monkeypatch.setattr(topk, "SortedLists", Counted)
    rows = [[c.tobytes() for c in (*block, *ask)] for block in blocks for ask in asks]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*part)], ["ids", "data", "q_ids", "q_data", "q_least"]) for part in (rows[:2], rows[2:4], rows[4:])]
    got = {}
    for batch in topk.searched(batches, 3, 2):
        for q, i, s in zip(*(c.to_pylist() for c in batch.columns)):
            got.setdefault(q, []).append((-s, i))
    assert built == [0, 100]
    for ids, q, _ in asks:
        for own, vector in zip(ids.tolist(), q):
            want = [sorted((-int(topk.quantise(x) @ topk.quantise(vector)), int(i)) for i, x in zip(*block) if i != own)[:2] for block in blocks]
            assert sorted(got[own]) == sorted(want[0] + want[1])
