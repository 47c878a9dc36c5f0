"""Substring dedup: words covered by a window of WINDOW words whose word sequence starts anywhere else are removed.

A compressed FM-index is built per shard, and documents are streamed against it by backward search over wavelet trees, whose
matching statistics give the intervals above the threshold. What makes this scale is which pieces meet in a shard:

1. The windows of a document are cut into segments, runs of windows with the same minimizer (the smallest hash of SEED_WORDS
   words in a window). Equal windows have equal minimizers, so comparing segments of one minimizer is enough. Only
   segments whose minimizer occurs again go on; texts don't move for this.
2. Segments that are equal as a whole are kept once, with their number as weight, so the copies of a document cost one segment
   each, however many there are. The index counts what a match weighs, and every window is decided by it.
3. The texts of the distinct segments are fetched once. All segments of a minimizer go to one shard, where each is
   streamed against the index. A minimizer with more than SHARD_WORDS words, such as the edge of a very common passage, is split
   by content over as many shards as it needs: each of its segments is part of one index and streamed against all of them (one
   that occurs twice, against its own). A window repeats if it occurs twice in its own shard or once in another.
4. Intervals go back to all occurrences of a segment and are joined with their documents.

Texts are compressed before they are shuffled. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm.common import row_hash, stored, table
from vaultspark.llm.fmindex import FMIndex
from vaultspark.llm.minhash import _mix, _words

WINDOW, SEED_WORDS, SEED = 35, 6, 3
#: Windows of a segment at most; words of a shard's index after which the next shard begins; segments streamed at once.
LONGEST, SHARD_WORDS, STREAM = 64, 150_000, 512
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class RangeHash:
    """Hashes of any range of a word sequence, from sums of words times powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n)[:n], dtype=np.uint64)])
        self.inverse = _powers(_INVERSE, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def segments(words: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """start, windows, minimizer, content hash and repeats (whether the minimizer occurs again in this document) of the
    segments of one document, which has at least `window` words."""
    seed = min(SEED_WORDS, window)
    n = len(words) - window + 1
    hashes = RangeHash(words)
    at = np.arange(len(words) - seed + 1)
    seeds = hashes.of(at, at + seed)
    low, width = seeds, 1
    wide = window - seed + 1
    while 2 * width <= wide:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < wide:
        low = np.minimum(low[: n], low[wide - width : wide - width + n])
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    start = np.concatenate([[0], change])
    size = np.diff(np.concatenate([start, [n]]))
    pieces = -(-size // LONGEST)
    if pieces.max() > 1:
        run = np.repeat(np.arange(len(start)), pieces)
        no = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = start[run] + no * LONGEST, np.minimum(LONGEST, size[run] - no * LONGEST)
    minimizer = low[start]
    order = np.sort(seeds)
    repeats = np.searchsorted(order, minimizer, "right") - np.searchsorted(order, minimizer) > 1
    return start, size, minimizer, hashes.of(start, start + size + window - 1), repeats


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", row_hash(SEED, "doc_id", "text"))


def _compressed(docs: DataFrame) -> DataFrame:
    """docs with `zip`, the text's bytes under zstandard, in place of text."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).schema.add("zip", "binary")

    def run(batches):
        import zstandard

        zc = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([zc.compress(t or b"") for t in texts], pa.binary())], [*rest, "zip"])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def document_segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_key, start, n, mini, content, repeats) of every segment of docs (_key, text)."""
    names = ["_key", "start", "n", "mini", "content", "repeats"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()):
                    words = (text or b"").split()
                    if len(words) >= window:
                        start, size, mini, content, repeats = segments(_words.hashes(words), window)
                        out.append((np.full(len(start), key), start.astype(np.int32), size.astype(np.int16), mini.view(np.int64), content.view(np.int64), repeats))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return docs.select("_key", "text").mapInArrow(run, "_key long, start int, n short, mini long, content long, repeats boolean")


class Shard:
    """An index of segments (mini, content, weight, n, words)."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.words, flat = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
        self.symbols = np.split(flat.astype(np.int64) + 1, np.cumsum([len(r[4]) for r in rows])[:-1])
        self.index = FMIndex(self.symbols, np.array([r[2] for r in rows]), len(self.words) + 1)  # the last symbol is in no text

    def _intervals(self, rows: list[tuple], symbols: list[np.ndarray], least: int, window: int) -> list[np.ndarray]:
        if not rows:
            return [np.zeros(0, np.int64)] * 4
        lengths = np.array([len(s) for s in symbols])
        first = np.cumsum(lengths) - lengths
        hit = np.concatenate([self.index.matching_statistics(symbols, least) >= window, [False]])
        text = np.repeat(np.arange(len(rows)), lengths)
        begins, ends = hit[:-1].copy(), hit[:-1] & ~hit[1:]
        begins[1:] &= ~hit[:-2]
        begins[first], ends[first[1:] - 1] = hit[first], hit[first[1:] - 1]  # no run goes from one text to the next
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        of = text[a]
        mini, content = (np.array([r[c] for r in rows], np.int64)[of] for c in (0, 1))
        return [mini, content, a - first[of], b - first[of]]

    def own(self, window: int) -> list[np.ndarray]:
        """(mini, content, a, b): the windows of its segments that occur twice in it."""
        return self._intervals(self.rows, self.symbols, 2, window)

    def others(self, rows: list[tuple], window: int) -> list[np.ndarray]:
        """The windows of segments of other shards that occur in it."""
        symbols = []
        for row in rows:
            at = np.minimum(np.searchsorted(self.words, row[4]), len(self.words) - 1)
            symbols.append(np.where(self.words[at] == row[4], at, len(self.words)) + 1)
        return self._intervals(rows, symbols, 1, window)


def _index_shards(texts: DataFrame, window: int) -> DataFrame:
    """(mini, content, a, b): intervals of repeated windows, from rows (mini, content, weight, n, shards, words as bytes)."""
    own = F.pmod(F.xxhash64("content"), F.col("shards").cast("long")).cast("int")
    searched = F.when(F.col("weight") == 1, F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(F.array(own))
    dealt = texts.select("*", F.explode(searched).alias("shard")).withColumn("other", F.col("shard") != own)
    columns = ("mini", "content", "weight", "n", "words", "shards", "shard", "other")

    def run(batches):
        held, size, now, seen, shard, waiting, several = [], 0, None, set(), None, [], False

        def emit(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["mini", "content", "a", "b"])

        def ended():
            """What the shard finds for the rows held or, if it has been asked, for those that wait."""
            return emit(shard.others(waiting, window) if shard else Shard(held).own(window))

        for batch in batches:
            for *row, words, shards, number, other in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (row[0], number) != now:
                    if held and (several or shards > 1 or size >= SHARD_WORDS):
                        yield ended()
                        held, size, shard, waiting = [], 0, None, []
                    now, seen, several = (row[0], number), set(), shards > 1
                row = (*row, np.frombuffer(words, np.uint64))
                if not other and row[1] not in seen:
                    seen.add(row[1])
                    held.append(row)
                    size += len(row[4]) + 1
                elif other and held:
                    if shard is None:
                        shard = Shard(held)
                        yield emit(shard.own(window))
                    waiting.append(row)
                    if len(waiting) >= STREAM:
                        yield emit(shard.others(waiting, window))
                        waiting = []
        if held:
            yield ended()

    ordered = dealt.select(*columns).repartition("mini", "shard").sortWithinPartitions("mini", "shard", "other")
    return ordered.mapInArrow(run, "mini long, content long, a int, b int")


def repeated_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_key, a, b): the windows a to b - 1 of a document repeat. docs has _key and text."""
    all_ = stored(document_segments(docs, window), "sub-segments")
    known = all_.groupBy("mini").agg(F.sum(F.when(F.col("repeats"), 2).otherwise(1)).alias("_n")).filter("_n > 1").select("mini")
    known = stored(known, "sub-minimizers")
    found = stored(all_.join(known.hint("merge"), "mini").select("_key", "start", "n", "mini", "content"), "sub-candidates")
    distinct = found.groupBy("mini", "content").agg(F.count("*").alias("weight"), F.min(F.struct("_key", "start", "n")).alias("at"))
    distinct = stored(distinct.select("mini", "content", "weight", "at.*"), "sub-distinct")
    words = F.sum(F.col("n") + window)
    sizes = stored(distinct.groupBy("mini").agg(F.ceil(words / SHARD_WORDS).cast("int").alias("shards")), "sub-groups")

    # fetch the texts of the segments, once per document
    entry = F.struct("mini", "content", "weight", "start", "n", "shards")
    wanted = distinct.join(sizes, "mini").groupBy("_key").agg(F.collect_list(entry).alias("entries"))
    packed = _compressed(docs.select("_key", "text")).join(wanted.hint("merge"), "_key").select("_key", "zip", "entries")
    names = ["mini", "content", "weight", "n", "shards", "words"]

    def fetch(batches):
        import zstandard

        zd, last = zstandard.ZstdDecompressor(), None

        def emit(entries, kept, found):
            """The entries at the places kept, with their words."""
            kept = pa.array(np.concatenate(kept), pa.int64())
            return pa.RecordBatch.from_arrays([*(entries.field(c).take(kept) for c in names[:-1]), pa.array(found, pa.binary())], names)

        for batch in batches:
            column = batch.column(2)
            at, entries = column.offsets.to_numpy(), column.values
            start, n = (entries.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
            kept, found, size = [], [], 0
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key == last:  # a row that is repeated; they follow one another
                    continue
                last, words = key, _words.hashes(zd.decompress(batch.column(1)[i].as_py()).split())
                own = np.arange(at[i], at[i + 1])
                begin, end = start[own], start[own] + n[own] + window - 1
                for a in range(0, len(own), STREAM):
                    kept.append(own[a : a + STREAM])
                    found += [words[x:y].tobytes() for x, y in zip(begin[a : a + STREAM].tolist(), end[a : a + STREAM].tolist())]
                    size += int((end - begin)[a : a + STREAM].sum())
                    if size > SHARD_WORDS:
                        yield emit(entries, kept, found)
                        kept, found, size = [], [], 0
            if found:
                yield emit(entries, kept, found)

    texts = packed.mapInArrow(fetch, "mini long, content long, weight long, n short, shards int, words binary")
    intervals = stored(_index_shards(texts, window), "sub-intervals")
    return found.join(intervals.hint("merge"), ["mini", "content"]).select("_key", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (hex digest of the kept words joined by one space) and, if asked for,
    kept_text, one row per row of docs.

    docs needs doc_id and text; other columns are ignored. A null text has no words, and texts shorter than a window keep all.
    A row that occurs twice (the same doc_id, null included, and text) repeats itself. An empty table gives an empty result.
    """
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = stored(repeated_intervals(docs, window), "sub-found")
    covered = found.distinct().groupBy("_key").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    joined = _compressed(docs).join(covered.hint("merge"), "_key", "left").select("doc_id", "zip", "runs")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        import zstandard

        zd = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, packed, runs in zip(*(batch.column(c).slice(at, 256).to_pylist() for c in range(3))):
                    words = zd.decompress(packed).split()
                    kept = words
                    if runs:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, [r["a"] for r in runs], 1)
                        np.add.at(edge, [r["b"] + window - 1 for r in runs], -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    text = b" ".join(kept)
                    out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*out), types))[: len(names)]], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return joined.mapInArrow(run, schema)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
