"""The exact Jaccard join against a plain version, with hot n-grams, chains, many blocks and awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import components, shingles
from vaultspark.llm import ngram_join
from vaultspark.llm.ngram_join import GROUPS, CountTree
from vaultspark.llm.queries import QUERIES


def text_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    """Groups of copies and of near copies around the limit, a chain, passages that many texts share, short and odd texts."""
    rng, texts = random.Random(seed), []
    passage = text_of(rng, 40)
    for _ in range(12):
        base = text_of(rng, rng.randrange(30, 120))
        texts += [base, base] + [edited(rng, base, rng.randrange(1, 4)) for _ in range(rng.randrange(5))]
    chain = text_of(rng, 150)
    for _ in range(12):
        texts.append(chain)
        chain = edited(rng, chain[1:], 1)
    texts += [passage + text_of(rng, rng.randrange(0, 30)) for _ in range(25)]
    texts += [[f"only{i}"] for i in (1, 1, 2)] + [["a", "b", "c"], ["A", "b", "C"], [], ["x"] * 50, ["x"] * 9]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " \t"), (None, " ".join(texts[0])), (3, " ".join(texts[40]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, similarity, held", [(5, 80, 4096), (5, 80, 3), (2, 60, 7)])
def test_join_finds_every_link(spark, monkeypatch, size, similarity, held):
    monkeypatch.setattr(ngram_join, "HELD", held)
    monkeypatch.setattr(ngram_join, "HELD_BYTES", held * 800)
    rows = corpus(size + held)
    docs = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(rows)], "doc_id long, n long, text string").repartition(4)
    clashing = docs.select("*", *[F.lit("own").alias(c) for c in ("class", "counts", "first", "h", "root", "group", "set", "token")])
    roots, sizes = components(rows, size, similarity)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(clashing, size, similarity).collect()), key=str)
    assert got == sorted(((i, n, c) for (i, _), n, c in zip(rows, sizes, roots)), key=str)


def test_query_agrees_with_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    roots, sizes = components(rows, 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op13_ngram_join"](spark, sf_dir).collect()}
    assert got == {i: (n, c) for (i, _), n, c in zip(rows, sizes, roots)} and any(i != c for (i, _), c in zip(rows, roots))


def test_trees_find_what_bounds_allow():
    rng = np.random.default_rng(2)
    base = rng.poisson(2.0, (20, GROUPS))
    points = np.maximum(base[rng.integers(0, 20, 700)] + rng.integers(-1, 2, (700, GROUPS)) * (rng.random((700, GROUPS)) < 0.2), 0)
    sizes = points.sum(1)
    tree = CountTree(points, sizes, 80)
    assert sorted(tree.order) == list(range(700))
    met = 0
    for i in range(0, 700, 7):
        live = rng.random(700) < 0.8
        bound = np.minimum(tree.points, points[i]).sum(1)
        small, large = np.minimum(tree.sizes, sizes[i]), np.maximum(tree.sizes, sizes[i])
        want = np.flatnonzero((9 * bound >= 4 * (tree.sizes + sizes[i])) & (5 * small >= 4 * large) & live)
        assert sorted(tree.search(points[i], int(sizes[i]), live)) == want.tolist()
        met += len(want)
    assert met > 200


def test_vectors_of_two_levels_meet():
    rng = np.random.default_rng(5)
    assert [ngram_join.level_of(n) for n in (0, 1023, 1024, 4095, 4096)] == [0, 0, 1, 1, 2]
    for n in (10, 1023, 1024, 4095, 4096, 20_000):
        tokens = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        counts, level = ngram_join.counted(tokens), ngram_join.level_of(n)
        assert len(counts) == GROUPS * 4**level and n < 26 * len(counts)
        for lower in range(level + 1):
            assert (ngram_join.point_of(counts.tobytes(), lower) == np.bincount((tokens % (GROUPS * 4**lower)).astype(int), minlength=GROUPS * 4**lower)).all()
    assert ngram_join.point_of(ngram_join.counted(np.arange(0, 64 * 1000, 64, dtype=np.uint64)).tobytes(), 0)[0] >= 1000


def test_a_group_of_near_copies_and_a_long_text(spark):
    rng = random.Random(9)
    base, long = text_of(rng, 60, 10**6), text_of(rng, 300_000, 10**6)
    rows = [(i, " ".join(edited(rng, base, 1 + i % 2))) for i in range(1500)] + [(5000, " ".join(long)), (5001, " ".join(long[:-900] + ["z"] * 900)), (5002, " ".join(edited(rng, long, 40_000)))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5001] == 5000 and got[5002] == 5002
    small = [(i, t) for i, t in rows if i < 1500]
    sets = {i: shingles(t, 5) for i, t in small}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in sets:
        for j in range(i):
            if find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: got[i] for i in sets} == {i: find(i) for i in sets}


def test_empty_tables_and_texts_without_links(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0
    got = sorted((tuple(r)[0], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs.filter("doc_id IS NOT NULL")).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 2, 3)]
    assert {r["component_id"] for r in ngram_join.ngram_join(docs.filter("doc_id IS NULL")).collect()} == {None}
