"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts (orders 0 to ORDER) is counted on a bounded sample and frozen.
A byte that was seen in its context c costs -log2(n / (total + distinct)) bits, any other byte first pays the escape
-log2(distinct / (total + distinct)) and is then coded in the next shorter context, at last as one of 256 (method C without
exclusion). A text's language is the one whose tree codes it in the fewest bits.

All trees share one set of nodes, so scoring walks a text once: the node of the longest known string that ends at a byte
gives its bits in every language. What a byte costs through the contexts that it escapes from is a difference of sums
along the suffix chain, so each byte adds one table row, and the exact code length is a sum of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm.common import row_hash, table

#: Longest context in bytes.
ORDER = 4
#: The sample: about so many documents of each language, pieces of those that are longer than so many bytes, cut off at so many bytes
#: a language; with more than FULL_LANGS languages at so many bytes of all, shared equally.
SAMPLE_DOCS, SAMPLE_DOC_BYTES, SAMPLE_BYTES, FULL_LANGS = 240, 1 << 18, 1 << 19, 64
#: Strings of three bytes and more are in a language's tree if its sample holds them so often.
LEAST_COUNT = 2
SEED = 11
#: Bytes scored at once.
BLOCK = 1 << 17


@dataclass
class LanguageModel:
    langs: list[str]
    symbol: np.ndarray  # byte -> 1..., 0 if not in the sample
    child: np.ndarray  # node * symbols + symbol -> node, 0 if none
    bits: np.ndarray  # node x language, see code_lengths()
    tail: np.ndarray  # node x language: escapes of the context that a node leaves
    first: np.ndarray  # children of the root

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        n = len(texts)
        if not n or not self.langs:
            return np.zeros((n, len(self.langs)))
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        out, wide = np.zeros((n, len(self.langs))), len(self.first)
        for a in range(0, len(data), BLOCK):
            b, lo = min(a + BLOCK, len(data)), max(0, a - ORDER)
            sym = self.symbol[data[lo:b]]
            gaps = ends[np.searchsorted(ends, lo) : np.searchsorted(ends, b)] - lo
            sym[gaps] = 0  # no context reaches into the next text
            level = self.first[sym]
            node = level.copy()
            for _ in range(ORDER):
                up = np.zeros_like(level)
                up[1:] = self.child[level[:-1] * wide + sym[1:]]
                np.maximum(node, up, out=node)
                level = up
            node = node[a - lo :]
            sums = np.zeros((len(node) + 1, len(self.langs)))
            np.cumsum(self.bits[node], axis=0, out=sums[1:])
            i, j = np.searchsorted(ends, a), np.searchsorted(starts, b)
            out[i:j] += sums[np.minimum(ends[i:j], b) - a] - sums[np.maximum(starts[i:j], a) - a]
            last = (ends[i:j] > a) & (ends[i:j] <= b) & (ends[i:j] > starts[i:j])
            at = ends[i:j][last] - 1 - a
            out[i:j][last] -= self.tail[node[at]]
        out[np.array([len(t) > 0 for t in texts], bool)] += self.tail[0]
        return out


def _codes(data: np.ndarray, gap: np.ndarray, size: int) -> np.ndarray:
    """The strings of `size` bytes, packed, that lie within one text."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(size):
        code = (code << np.uint64(8)) | data[k : k + n]
        bad |= gap[k : k + n]
    return code[~bad]


def build_model(samples: dict[str, list[bytes]], order: int = ORDER) -> LanguageModel:
    langs = sorted(samples)
    arrays = {}
    for lang in langs:
        data = np.frombuffer(b"\0".join(samples[lang]) + b"\0", np.uint8)
        gap = np.zeros(len(data), bool)
        gap[np.cumsum([len(t) + 1 for t in samples[lang]]) - 1] = True
        arrays[lang] = (data.astype(np.uint64), gap)
    levels, counts = [np.zeros(1, np.uint64)], [np.zeros((1, len(langs)), np.int64)]
    for size in range(1, order + 2):
        each = [np.unique(_codes(*arrays[x], size), return_counts=True) for x in langs]
        keys = np.unique(np.concatenate([k for k, _ in each])) if each else np.zeros(0, np.uint64)
        table_ = np.zeros((len(keys), len(langs)), np.int64)
        for i, (k, c) in enumerate(each):
            table_[np.searchsorted(keys, k), i] = c
        if size > 2:  # each tree by its own sample; a string that stays has its prefixes and suffixes there too
            table_[table_ < LEAST_COUNT] = 0
        keep = table_.any(1)
        levels.append(keys[keep])
        counts.append(table_[keep])
    base = np.concatenate([[0], np.cumsum([len(x) for x in levels])])
    total_nodes, n_lang = int(base[-1]), len(langs)
    total, distinct = np.zeros((total_nodes, n_lang)), np.zeros((total_nodes, n_lang))
    parent, suffix = np.zeros(total_nodes, np.int64), np.zeros(total_nodes, np.int64)
    depth, count = np.zeros(total_nodes, np.int64), np.concatenate(counts)
    for d in range(1, order + 2):
        ids = np.arange(base[d], base[d + 1])
        up = base[d - 1] + np.searchsorted(levels[d - 1], levels[d] >> np.uint64(8)) if d > 1 else np.zeros(len(ids), np.int64)
        mask = np.uint64((1 << (8 * (d - 1))) - 1)
        down = base[d - 1] + np.searchsorted(levels[d - 1], levels[d] & mask) if d > 1 else np.zeros(len(ids), np.int64)
        parent[ids], suffix[ids], depth[ids] = up, down, d
        np.add.at(total, up, counts[d])
        np.add.at(distinct, up, counts[d] > 0)
    whole = total + distinct
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, -np.log2(np.where(total > 0, distinct / whole, 1)), 0.0)
        seen = np.where(count > 0, -np.log2(np.where(count > 0, count / whole[parent], 1)), np.nan)
    chain = escape.copy()  # escapes of a context and all its suffixes
    full = np.full((total_nodes, n_lang), 8.0)  # bits of a node's last byte after the rest
    for d in range(1, order + 2):
        ids = slice(base[d], base[d + 1])
        chain[ids] = escape[ids] + chain[suffix[ids]]
        lower = full[suffix[ids]] if d > 1 else 8.0
        full[ids] = np.where(np.isnan(seen[ids]), escape[parent[ids]] + lower, seen[ids])
    context = np.where(depth == order + 1, suffix, np.arange(total_nodes))
    tail = chain[context]
    bits = np.where((depth == 0)[:, None], 8.0, full - chain[parent]) + tail
    used = np.unique((levels[1]).astype(np.int64))
    symbol = np.zeros(256, np.int32)
    symbol[used] = np.arange(1, len(used) + 1)
    wide = len(used) + 1
    child = np.zeros(int(base[order + 1]) * wide, np.int32)
    for d in range(2, order + 2):
        ids = np.arange(base[d], base[d + 1])
        child[parent[ids] * wide + symbol[(levels[d] & np.uint64(255)).astype(np.int64)]] = ids
    first = np.zeros(wide, np.int32)
    first[1:] = np.arange(base[1], base[2])
    return LanguageModel(langs, symbol, child, bits, tail, first)


def train(docs: DataFrame) -> LanguageModel:
    """A model of the labelled rows of docs (doc_id, text, lang), fitted on a bounded sample: rows are drawn by a hash of doc_id
    and text, with a rate for each language that gives about SAMPLE_DOCS rows and twice SAMPLE_BYTES at most, and only the first
    of the drawn texts reach the driver. Every language is learned, from at least its first row in order of the hash; of a text longer
    than SAMPLE_DOC_BYTES a piece at a place of its own stands for it. Rows without text or lang teach nothing. One row per
    language is broadcast, and the model grows with the number of languages."""
    draw = F.pmod(row_hash(SEED, "doc_id", "text"), F.lit(1 << 40))
    most = SAMPLE_DOC_BYTES // 4  # characters have up to four bytes
    at = F.pmod(row_hash(SEED + 1, "doc_id", "text"), F.greatest(F.length("text") - most, F.lit(1)).cast("long")).cast("int") + 1
    piece = F.when(F.octet_length("text") <= SAMPLE_DOC_BYTES, F.col("text")).otherwise(F.substring("text", at, F.lit(most)))
    known = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", draw.alias("draw"), piece.alias("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("draw").alias("least")).collect()
    if not sizes:
        return build_model({})
    budget = SAMPLE_BYTES * FULL_LANGS // max(FULL_LANGS, len(sizes))
    limits = [(r["lang"], max(int(min(1.0, SAMPLE_DOCS / r["n"], 2 * budget / r["bytes"]) * (1 << 40)), r["least"] + 1)) for r in sizes]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, below long"))  # one row per language
    drawn = known.join(wanted, "lang").filter("draw < below").select("lang", "draw", F.col("text").cast("binary").alias("text")).orderBy("draw", "lang", "text")
    samples: dict[str, list[bytes]] = {}
    for r in drawn.limit((2 * SAMPLE_DOCS + 1) * len(sizes)).collect():
        texts = samples.setdefault(r["lang"], [])
        if not texts or sum(map(len, texts)) + len(r["text"]) <= budget:
            texts.append(bytes(r["text"]))
    return build_model(samples)


def scored(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """row (the caller's), lang_pred, score and bits_per_byte; see identify()."""
    nested = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = nested.select("row").schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = pc.struct_field(part.column("row"), text).cast(pa.large_binary())
                pred, score, bpb = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
                todo = [i for i, ok in enumerate(part.column("letters").to_pylist()) if ok and model.langs]
                known = texts.take(pa.array(todo, pa.int64())).to_pylist()
                bits = model.code_lengths(known)
                best = bits.argmin(1) if len(todo) else []
                for i, k, row, whole in zip(todo, best, bits, known):
                    pred[i], bpb[i] = model.langs[k], row[k] / len(whole)
                    score[i] = float(1 / np.exp2(np.maximum(row[k] - row, -1000)).sum())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(pred), pa.array(score), pa.array(bpb, pa.float64())], ["row", "lang_pred", "score", "bits_per_byte"])

    return nested.mapInArrow(run, schema)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the share of the best language in 2^-bits, 0 to 1) and bits_per_byte (of the best).

    Null, empty and letterless texts get `und`, 0.0 and null, and so does every text if the model knows no language. Ties
    go to the smaller language. Columns of docs with these names are replaced; others, whatever their names, and all rows stay.
    """
    own = docs.drop("lang_pred", "score", "bits_per_byte")
    return scored(own, model, text).select("row.*", "lang_pred", "score", "bits_per_byte")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
