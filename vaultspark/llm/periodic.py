"""Periodic runs of words: stretches that repeat a period at least `exponent` times, and texts with the repeats dropped.

Grouping. The first phase of Baier's suffix sorter keeps suffixes in ordered groups that share a Lyndon prefix, the group's
context. Groups are processed from the largest down; every suffix points to the nearest suffix before it that is in a
smaller group, and suffixes that l members of a group point to leave their group for a new one just above it, whose context is
the old one followed by l times the processed one. A suffix's context at the time its group is processed is the longest
Lyndon word that starts there, so one pass gives the Lyndon array; a second one under the reverse order of words gives the other.

Runs. Every run has a Lyndon root under one of the two orders: a place whose longest Lyndon word is as long as the run's period.
Roots that are followed by a copy of themselves are extended in both directions by the longest common extensions of
the two copies, which are told from the places where words a period apart differ.

Only stretches covered by sequences of GRAM words that occur twice in a text are searched: a run of at least three periods
is covered by such sequences, and so would be the word after its end if it kept the period, so runs lie inside stretches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm.common import table
from vaultspark.llm.minhash import _MULTIPLIERS, WordHash

#: A run has at least LEAST words and at least EXPONENT times its period.
LEAST, EXPONENT, GRAM = 24, 3, 8

_words = WordHash()


def lyndon_array(symbols: list[int]) -> list[int]:
    """The length of the longest Lyndon word at each place, by grouping. symbols are 0 to k - 1, each used; the end is smaller than all."""
    n = len(symbols)
    k = max(symbols, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(k)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    group, length, size = list(symbols), [1] * k, [len(m) for m in members]
    below, above = list(range(-1, k - 1)), list(range(1, k + 1))
    before, done, out = [-1] * n, [False] * n, [0] * n
    at = k - 1
    while at >= 0:
        mine, own = [i for i in members[at] if group[i] == at], length[at]
        members[at] = []
        for i in mine:
            done[i] = True
        pointed: dict[int, int] = {}
        for i in mine:
            out[i] = own
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            moves: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                moves.setdefault((times, group[j]), []).append(j)
            for times, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
                leaving = moves[times, old]
                if len(leaving) == size[old]:  # nobody stays: the group itself gets the longer context
                    length[old] += times * own
                    continue
                size[old] -= len(leaving)
                new = len(members)
                members.append(leaving)
                length.append(length[old] + times * own)
                size.append(len(leaving))
                for j in leaving:
                    group[j] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up < len(below):
                    below[up] = new
        at = below[at]
    return out


def _repeated(words: np.ndarray, gram: int) -> np.ndarray:
    """Which words are covered by a sequence of gram words that occurs twice."""
    n = len(words) - gram + 1
    covered = np.zeros(len(words), bool)
    if n < 2:
        return covered
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total += words[k : k + n] * _MULTIPLIERS[k]
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    if same.any():
        starts = np.zeros(len(words) + 1, np.int64)
        np.add.at(starts, order[1:][same], 1)
        np.add.at(starts, order[:-1][same], 1)
        depth = np.cumsum(starts)[:-1]
        covered = depth - np.concatenate([np.zeros(gram, np.int64), depth])[: len(words)] > 0
    return covered


def _prefix_hashes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of keyed symbols, and the powers that they were multiplied with, modulo 2^64."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(symbols), np.uint64(0x9E3779B97F4A7C15 | 1)))
        keys = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
        keys ^= keys >> np.uint64(29)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(keys * powers)]), powers


def _roots(symbols: np.ndarray, sums: np.ndarray, powers: np.ndarray, exponent: int) -> list[tuple[np.ndarray, int]]:
    """By period, the first places of Lyndon roots that a copy follows. Copies are told by sums; what they say is confirmed later."""
    n, found = len(symbols), []
    for order in (symbols, symbols.max() - symbols):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        i = np.flatnonzero(np.arange(n) + 2 * period <= n)
        i = i[exponent * period[i] <= n]
        p = period[i]
        alike = (sums[i + p] - sums[i]) * powers[i + p] == (sums[i + 2 * p] - sums[i + p]) * powers[i]
        found.append(p[alike] * n + i[alike])
    periods, places = np.divmod(np.unique(np.concatenate(found)), n)
    cuts = np.flatnonzero(np.diff(periods)) + 1
    return [(i, int(p[0])) for p, i in zip(np.split(periods, cuts), np.split(places, cuts)) if len(p)]


def _stretch_runs(words: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    symbols = np.unique(words, return_inverse=True)[1].astype(np.int64)
    n, runs = len(symbols), []
    sums, powers = _prefix_hashes(symbols)
    with np.errstate(over="ignore"):
        by_period = _roots(symbols, sums, powers, exponent)
    for roots, p in by_period:
        odd = np.flatnonzero(symbols[:-p] != symbols[p:])  # places that differ from the one a period on
        cut = np.searchsorted(odd, roots)
        start = np.where(cut > 0, odd[np.maximum(cut - 1, 0)] + 1, 0) if len(odd) else np.zeros(len(roots), np.int64)
        end = (np.where(cut < len(odd), odd[np.minimum(cut, len(odd) - 1)], n - p) if len(odd) else np.full(len(roots), n - p)) + p
        ok = end - start >= max(least, exponent * p)
        runs += [(s, e - s, p) for s, e in {*zip(start[ok].tolist(), end[ok].tolist())}]
    return runs


def runs_of(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least least words and exponent periods, by start, then period."""
    if exponent < 3 or least < 3:
        raise ValueError("only runs of at least three periods have a root that is followed by a whole copy")
    if len(words) < least:
        return []
    gram = min(GRAM, least - least // exponent)
    with np.errstate(over="ignore"):
        hashes = _words.hashes(words)
        covered = _repeated(hashes, gram)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    runs = []
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a >= least:
            runs += [(a + s, length, p) for s, length, p in _stretch_runs(hashes[a:b], least, exponent)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def split(doc_id: int | None, text: bytes) -> list[bytes]:
    """Words, parted by ASCII white space."""
    return text.split()


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, words_of: Callable[[int | None, bytes], list[bytes]] = split, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), longest (the run with the greatest length / period, ties to the smaller
    start, then period; null without runs), runs_sha256 and collapsed_sha256 (lines `start,length,period`; kept words joined
    by one space), and if with_text collapsed (those words), for each row of docs.

    Words are counted from 0; runs keep their smallest period, can't be extended and may overlap. Null, empty and blank texts have
    no words and no run. Rows are taken one by one, so null or repeated doc_ids do no harm; other columns are ignored. An
    empty table gives an empty result. A text is held in one task, whatever its length; its grouping takes linear time.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows = batch.slice(at, 128), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = words_of(doc_id, text or b"")
                    runs = runs_of(words, least, exponent)
                    kept = b" ".join(collapsed(words, runs))
                    told = "".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()
                    top = None
                    for r in runs:  # in order of start and period, so only a greater one replaces
                        if top is None or r[1] * top[2] > top[1] * r[2]:
                            top = r
                    row = {
                        "n_words": len(words),
                        "runs": [dict(zip(("start", "length", "period"), r)) for r in runs],
                        "longest": top and dict(zip(("start", "length", "period"), top)),
                        "runs_sha256": hashlib.sha256(told).hexdigest(),
                        "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
                    }
                    rows.append(row | ({"collapsed": kept.decode("utf-8", "replace")} if with_text else {}))
                columns = [part.column("doc_id"), *(pa.array([r[f.name] for r in rows], f.type) for f in fields)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f.name for f in fields)])

    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = [pa.field("n_words", pa.int64()), pa.field("runs", pa.list_(kind)), pa.field("longest", kind), pa.field("runs_sha256", pa.string()), pa.field("collapsed_sha256", pa.string())]
    one, schema = "struct<start: bigint, length: bigint, period: bigint>", "doc_id long, n_words long, runs array<{0}>, longest {0}, runs_sha256 string, collapsed_sha256 string"
    if with_text:
        fields.append(pa.field("collapsed", pa.string()))
        schema += ", collapsed string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema.format(one))


def looped(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text; of a document whose crc32 is divisible by ten, from a place of its own on a period repeats to the end.
    Without doc_id nothing is repeated."""
    words = text.split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, a tenth of the documents with a period of their own."""
    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), words_of=looped, with_text=False)
    top = F.col("longest")
    exponent = F.expr("(1000 * longest.length) div longest.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
