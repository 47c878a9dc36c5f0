"""Runs against a search of every period, and the query against a plain version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import WORD
from vaultspark.llm import periodic
from vaultspark.llm.queries import QUERIES


def plain_runs(w, least=24, exponent=3):
    """Every stretch whose words are alike a period on, for every period; of equal stretches the smallest period counts."""
    found = {}
    for p in range(1, len(w) // exponent + 1):
        a = None
        for i in range(len(w) - p + 1):
            if i + p < len(w) and w[i] == w[i + p]:
                a = i if a is None else a
            elif a is not None:
                length, start, a = i + p - a, a, None
                if length >= max(least, exponent * p) and all(p % q for q in found.get((start, length), [])):
                    found.setdefault((start, length), []).append(p)
    return sorted(((s, n, p) for (s, n), ps in found.items() for p in ps), key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(told), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_grouping_gives_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(600):
        s = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(40))]
        s = [sorted(set(s)).index(x) for x in s]
        want = [next((j - i for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s) - i) for i in range(len(s))]
        assert periodic.lyndon_array(s) == want


@pytest.mark.parametrize("least, exponent", [(24, 3), (6, 3), (8, 4)])
def test_runs_are_all_runs(least, exponent):
    rng, found = random.Random(least), 0
    for _ in range(400):
        w = []
        while len(w) < rng.randrange(20, 160):
            w += rng.choices([b"a", b"b", b"c"][: rng.randrange(1, 4)], k=rng.randrange(1, 12)) * rng.randrange(1, 7)
        want = plain_runs(w, least, exponent)
        found += len(want)
        assert periodic.runs_of(w, least, exponent) == want
    assert found > 100
    with pytest.raises(ValueError):
        periodic.runs_of([b"a"] * 9, 9, 2)


def test_a_run_within_a_run_and_long_texts():
    inner = ([b"x", b"y"] * 15 + [b"z"]) * 3
    assert periodic.runs_of(inner) == [(0, 30, 2), (0, 93, 31), (31, 30, 2), (62, 30, 2)]
    assert periodic.runs_of([b"a"] * 1_200_000) == [(0, 1_200_000, 1)]
    words = [str(i % 333).encode() for i in range(200_000)]
    assert periodic.runs_of([b"-"] + words) == [(1, 200_000, 333)]


def test_query_agrees_with_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_runs"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    rows = [r for r in rows if len(r["text"] or "") < 20_000]
    for doc_id, text in rows:
        assert got[doc_id] == plain(doc_id, text), doc_id
    assert sum(got[i][0] > 0 for i, _ in rows) > 5


def test_awkward_rows(spark):
    """Nulls and blanks have no run, repeated rows are rows of their own, clashing columns are left alone, kept words are the text's."""
    text = "ab cd " * 20 + "end"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "é " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("runs", "n_words", "longest", "collapsed", "words")])
    found = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(docs).collect()), key=str)
    one = (41, [(0, 40, 2)], "ab cd end")
    assert found == sorted([(1, *one), (1, *one), (None, *one), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 1, [], "one"), (6, 30, [(0, 30, 1)], "é")], key=str)
    assert periodic.find_runs(docs.limit(0)).count() == 0
