"""Token ids: encoding with a public tokenizer, and a binary format of short documents compressed one by one.

Encoding. A text's words repeat, so the ids of a chunk (one white-space character and the word after it) are kept per
Python worker. The tokenizers used here never let a token reach over the start of such a chunk, so ids of chunks joined
are the ids of the text; texts with runs of white space are cut more carefully, and every chunk is encoded by the
tokenizers library. An encoder first tries this on probe texts; a tokenizer for which it doesn't hold encodes whole texts.

Format. A block holds consecutive documents: a header (magic, dictionary hash, number of documents, ids before the block in
its shard), an index (doc_id, ids, offset of each document) and one zstandard frame per document, compressed with a shared
dictionary that was trained on serialized id arrays of a bounded sample. Blocks are rows of a Parquet table, so any store
that Spark reaches will do and Spark commits them; the dictionary is a table beside it. One document is read from its
block alone: find it in the index and decompress its frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultspark.llm.common import row_hash, shared_folder, table

#: White space as tokenizers see it, without line feed and space, which most texts have alone.
_ODD_SPACE = "\\t\\v\\f\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_W = f"{_ODD_SPACE}\\n "
_ODD = re.compile(f"[{_ODD_SPACE}]")
_CHUNK = re.compile(f"[{_W}]?[^{_W}]+|[{_W}]+(?=[{_W}][^{_W}])|[{_W}]+")


def _odd(text: str) -> bool:
    if text.isascii():
        return "\t" in text or "\r" in text or "\v" in text or "\f" in text
    return _ODD.search(text) is not None


#: A worker sets its chunks aside beyond so many and forgets those set aside before; only speed depends on it.
CACHED = 500_000


#: What chunks, words, cases, letters and spaces of every kind have to get right.
_PROBES = ("The cat sat.", "a", " a", "A b  c\n\nd\n e \n", "naïve Straße, été (12) x.y don't it's", "ÀÉ ß ñandú über;", "1234 5 67.8", "tab\tx\r\ny", "漢字 かな ok", "e\u0301 \u00a0z\u2003", "word, word. word! \"q\"", "\nline\nLINE Line", "a" * 300 + " b")


def _visible_bytes() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder(dict):
    """Maps a chunk to its ids as little-endian unsigned 32-bit bytes. Keys: a word stands for itself after one space, a
    word after a line feed starts with it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.visible = self.tokenizer.model, _visible_bytes()
        self.space = self.visible[32]
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = getattr(self.model, "end_of_word_suffix", None) or ""  # then spaces are dropped and case is folded
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.exact: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        self.whole = not isinstance(self.model, models.BPE)
        self.whole = self.whole or any(self.encode(text) != self._ids(text) for text in _PROBES)
        self.clear()

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, key: str) -> bytes:
        if (found := self.aside.get(key)) is not None:
            self[key] = found
            return found
        if key[:1] == "\n":
            found = self.chunk("\n") + self.bare(key[1:])
        elif key[-1:] in (".", ",") and self._plain(key[:-1]):
            found = self[key[:-1]] + self.chunk(key[-1])
        elif self._plain(key):
            found = self._word(key if self.words else " " + key)
        else:
            found = self.chunk(" " + key)
        self[key] = found
        return found

    def bare(self, text: str) -> bytes:
        """A word after nothing or a line feed."""
        if (found := self.exact.get(text)) is None:
            if text[-1:] in (".", ",") and self._plain(text[:-1]):
                found = self.bare(text[:-1]) + self.chunk(text[-1])
            else:
                found = self._word(text) if self._plain(text) else self.chunk(text)
            self.exact[text] = found
        return found

    def _word(self, word: str) -> bytes:
        if self.words:
            word = word.lower()
        if not word.isascii() or word[0] == " ":
            word = "".join([self.visible[b] for b in word.encode()]) if not word.isascii() else self.space + word[1:]
        table = self.packed
        return b"".join([table[t.id] for t in self.model.tokenize(word)])

    @staticmethod
    def _plain(word: str) -> bool:
        """Letters that any version of Unicode knows, composed: one word to every tokenizer."""
        return word.isalpha() and (word.isascii() or max(word) < "Ā" and unicodedata.is_normalized("NFC", word))

    def chunk(self, text: str) -> bytes:
        if (found := self.exact.get(text)) is None:
            found = self.exact[text] = self._ids(text)
        return found

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED:
            self.aside = dict(self)
            self.clear()
        if len(self.exact) > CACHED // 4:
            self.exact.clear()
        if not text:
            return b""
        if self.whole or any(t in text for t in self.added):  # they end the text before them, also for runs of white space
            return self._ids(text)
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] in " \n" or _odd(text):
            return b"".join(map(self.chunk, _CHUNK.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.bare(first) + b"".join(map(self.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Documents a block holds at most, and bytes after which it ends.
BLOCK_DOCS, BLOCK_BYTES = 4096, 1 << 20
#: The dictionary's size, and its sample: about so many documents, none with more bytes of text.
DICT_BYTES, DICT_DOCS, DICT_DOC_BYTES = 1 << 16, 2000, 1 << 14
MAGIC, LEVEL, SEED = b"IDZ1", 3, 5
_HEAD, _ENTRY = struct.Struct("<4s32sIq"), np.dtype([("doc_id", "<i8"), ("null", "?"), ("n", "<u4"), ("at", "<u8")])


def _narrow(ids: bytes) -> bytes:
    return np.frombuffer(ids, "<u2")[::2].tobytes()


@dataclass
class Dictionary:
    data: bytes

    @property
    def hash(self) -> bytes:
        return hashlib.sha256(self.data).digest()

    def _zstd(self):
        import zstandard

        return zstandard.ZstdCompressionDict(self.data, dict_type=zstandard.DICT_TYPE_FULLDICT)

    def compressor(self):
        import zstandard

        kind = self._zstd()
        kind.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=kind)

    def decompressor(self):
        import zstandard

        return zstandard.ZstdDecompressor(dict_data=self._zstd())


def trained(samples: list[bytes], vocabulary: int, wide: bool) -> Dictionary:
    """A dictionary trained on serialized id arrays. Where they are too few to train on, all ids in order are more of them."""
    import zstandard

    try:
        return Dictionary(zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes())
    except zstandard.ZstdError:
        ids = np.arange(vocabulary).astype("<u4" if wide else "<u2")
        return Dictionary(zstandard.train_dictionary(DICT_BYTES, samples + [ids[a : a + 64].tobytes() for a in range(0, len(ids), 64)], level=LEVEL).as_bytes())


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> Dictionary:
    """A dictionary from the serialized ids of a bounded sample: rows drawn by a hash of doc_id and text at a rate that gives about
    DICT_DOCS, twice as many at most, of texts up to DICT_DOC_BYTES."""
    short = docs.filter(F.octet_length("text") <= DICT_DOC_BYTES)
    rate = min(1.0, DICT_DOCS / max(1, short.select("doc_id").count()))
    draw = F.pmod(row_hash(SEED, "doc_id", "text"), F.lit(1 << 40))
    drawn = short.select("text", draw.alias("draw")).filter(F.col("draw") < int(rate * (1 << 40))).orderBy("draw", "text")
    enc = encoder(path)
    wide = max(end_id, enc.tokenizer.get_vocab_size()) > 65535
    texts = [r["text"] for r in drawn.limit(2 * DICT_DOCS).collect()]
    return trained([ids if wide else _narrow(ids) for ids in (enc.encode(t) + end_id.to_bytes(4, "little") for t in texts)], enc.tokenizer.get_vocab_size(), wide)


def pack_block(dictionary: Dictionary, zc, before: int, docs: list[tuple[int | None, bytes]], wide: bool) -> bytes:
    """docs: doc_id and ids (unsigned 32-bit bytes; stored as 16-bit unless wide)."""
    frames, index, at = [], np.zeros(len(docs), _ENTRY), 0
    for i, (doc_id, ids) in enumerate(docs):
        frame = (b"\4" if wide else b"\2") + zc.compress(ids if wide else _narrow(ids))
        index[i] = (0 if doc_id is None else doc_id, doc_id is None, len(ids) // 4, at)
        frames.append(frame)
        at += len(frame)
    return _HEAD.pack(MAGIC, dictionary.hash, len(docs), before) + index.tobytes() + b"".join(frames)


def open_block(block: bytes, dictionary: Dictionary) -> tuple[int, np.ndarray, int]:
    """Ids before it in its shard, the index, and where the frames begin."""
    magic, hash_, n, before = _HEAD.unpack_from(block)
    if magic != MAGIC or hash_ != dictionary.hash:
        raise ValueError("not a block of this dictionary")
    return before, np.frombuffer(block, _ENTRY, n, _HEAD.size), _HEAD.size + n * _ENTRY.itemsize


def read_document(block: bytes, i: int, zd, index: np.ndarray, frames: int) -> np.ndarray:
    """The ids of the block's document i, from its own frame only."""
    begin = frames + int(index["at"][i])
    end = frames + int(index["at"][i + 1]) if i + 1 < len(index) else len(block)
    kind, raw = block[begin], zd.decompress(block[begin + 1 : end])
    return np.frombuffer(raw, "<u4" if kind == 4 else "<u2").astype("<u4")


def write_tokens(docs: DataFrame, path: str, end_id: int, out: str) -> None:
    """Writes docs (doc_id, text) to the folder out: `blocks` (shard, block, n_docs, n_tokens, data) and `dictionary`.

    Ascending doc_id order over shards, blocks and places in a block; a null doc_id comes first, rows with the same doc_id
    follow their text's hash. A null or empty text is the end id alone. An empty table gives an empty blocks table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, path, end_id)
    spark.createDataFrame([(bytearray(dictionary.data), bytearray(dictionary.hash))], "data binary, hash binary").write.parquet(f"{out}/dictionary")
    end = end_id.to_bytes(4, "little")

    def run(batches):
        enc, zc, shard = encoder(path), dictionary.compressor(), TaskContext.get().partitionId()
        block, before, held, size, number = [], 0, 0, 0, 0
        wide = max(end_id, enc.tokenizer.get_vocab_size()) > 65535

        def row():
            data = pack_block(dictionary, zc, before, block, wide)
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [number], "n_docs": [len(block)], "n_tokens": [held], "data": [data]}, schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = enc.encode(text) + end
                    block.append((doc_id, ids))
                    size, held = size + len(ids), held + len(ids) // 4
                    if len(block) >= BLOCK_DOCS or size >= 4 * BLOCK_BYTES:
                        yield row()
                        before, number, block, held, size = before + held, number + 1, [], 0, 0
        if block:
            yield row()

    by_text = F.xxhash64("text")
    ordered = docs.withColumn("_h", by_text).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    blocks = ordered.mapInArrow(run, "shard int, block int, n_docs long, n_tokens long, data binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{out}/blocks")


def read_tokens(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids. Starts are sums over
    shards (one row per writing task) plus what the blocks say."""
    dictionary = Dictionary(bytes(spark.read.parquet(f"{out}/dictionary").first()["data"]))
    blocks = spark.read.parquet(f"{out}/blocks")
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    starts = totals.select("shard", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    placed = blocks.join(F.broadcast(starts), "shard").select("_start", "data")  # a row per writing task: small at any size

    def run(batches):
        zd = dictionary.decompressor()
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before, index, frames = open_block(data, dictionary)
                start = base + before
                for at in range(0, len(index), 512):
                    rows = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
                    for i in range(at, min(at + 512, len(index))):
                        ids = read_document(data, i, zd, index, frames)
                        rows["doc_id"].append(None if index["null"][i] else int(index["doc_id"][i]))
                        rows["start"].append(start)
                        rows["n_tokens"].append(len(ids))
                        rows["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                        if with_ids:
                            rows["ids"].append(ids)
                        start += len(ids)
                    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(rows, types)], [*rows][: len(types)])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_folder(spark)}/llm/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, out)
    return read_tokens(spark, out, with_ids=False)
