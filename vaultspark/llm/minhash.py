"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard verification, connected components.

Signatures. The first permutation, a bijection of 64 bits, sends a shingle to a place (its upper bits) in a circle of PLACES
and a rank within the place (the other bits); the second permutes the places and is shifted circularly by k for coordinate
k. Shingles are ordered by (permuted place, rank), and coordinate k is the first one. The values of one place for all
coordinates lie next to each other in the second permutation's table, so the places are minima over table slices.

Classes. Documents with the same shingle set are one class, kept by its 128-bit digest; only classes are compared, so
copies are never paired. Each band of ROWS coordinates puts a class in a bucket. At similarity 0.8 all BANDS bands differ
with probability (1 - 0.8^4)^32 = 5e-8.

Links. In each bucket first the member that meets most others in its buckets, the lead, is compared with all. Members that are
then in the lead's component need no comparison with one another; all other pairs of the bucket are compared. Every pair
is compared on the full shingle sets. Since only pairs inside a component are skipped, components are those of all pairs that
share a bucket. Both comparisons stream members past a few held sets; hot leads and buckets are salted over many tasks.

Components. A member hangs on one lead that it is linked with, so links between leads are all that has to be connected; links
found later connect the roots found before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm.common import stored, table
from vaultspark.llm.graph import components

PLACE_BITS, BANDS, ROWS, SEED = 20, 32, 4, 6
PLACES, COORDINATES = 1 << PLACE_BITS, BANDS * ROWS
SHINGLE, SIMILARITY = 5, 80
#: About so many members stream past one copy of a lead.
STREAM = 512
#: About so many bytes of sets are held at once where a bucket's members are compared with one another.
HELD_BYTES = 1 << 22
#: A worker forgets its word hashes beyond so many; only speed depends on it.
CACHED = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_words = WordHash()
_MULTIPLIERS = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of `size` words as sorted 64-bit hashes, already under the first permutation; of a shorter text its
    whole sequence; without words none. A-Z is lower-cased; words are parted by ASCII white space."""
    words = _words.hashes(text.lower().split())
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _MULTIPLIERS[k]
    return np.unique(_mix(total))


_tables: list[np.ndarray] = []


def _second_permutation() -> list[np.ndarray]:
    """Table slices by place, and the place of each value."""
    if not _tables:
        values = np.random.default_rng(SEED).permutation(PLACES).astype(np.uint32)
        inverse = np.empty(PLACES, np.int64)
        inverse[values] = np.arange(PLACES)
        _tables.extend([np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: COORDINATES - 1]]), COORDINATES), inverse])
    return _tables


def signature(shingles: np.ndarray) -> np.ndarray:
    """The COORDINATES first shingles of a non-empty sorted set."""
    slices, inverse = _second_permutation()
    low = np.full(COORDINATES, PLACES, np.uint32)
    rank_bits = np.uint64(64 - PLACE_BITS)
    places = (shingles >> rank_bits).astype(np.int64)
    for a in range(0, len(places), 4096):
        np.minimum(low, slices[places[a : a + 4096]].min(0), out=low)
    first = (inverse[low] - np.arange(COORDINATES)) % PLACES  # the place that took each value, before the shift
    return shingles[np.searchsorted(shingles, first.astype(np.uint64) << rank_bits)]


def band_keys(signature_: np.ndarray) -> np.ndarray:
    rows = signature_.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = _mix(key + rows[:, k] * _MULTIPLIERS[k])
    return key.view(np.int64)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (digest of the shingle set, null if empty) and bands, for each row of docs."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, key, bands = [], [], []
                for text in part.column(2).to_pylist():
                    s = shingle_set(text or b"", size)
                    n.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bands.append(band_keys(signature(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "class", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class binary, bands array<long>")


def leads_of(classes: DataFrame) -> DataFrame:
    """class, doc_id, text_hash, n, bands, degree and buckets (band, members, lead, lead_degree, lead_n) of the classes that share a bucket.

    A class's degree is how many members its shared buckets have in all, a bucket's lead the member with the largest degree.
    Buckets are only counted and joined, never gathered; a class's own list has at most BANDS entries.
    """
    entries = classes.select("class", F.explode("bands").alias("band"))
    several = entries.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    shared = entries.join(several.hint("merge"), "band").groupBy("class").agg(F.collect_list(F.struct("band", "members")).alias("shared"))
    degree = F.aggregate("shared", F.lit(0).cast("long"), lambda s, x: s + x["members"])
    known = stored(classes.join(shared.hint("merge"), "class").withColumn("degree", degree), "minhash-shared")
    members = known.select("class", "n", "degree", F.explode("shared").alias("b")).select("class", "n", "degree", "b.*")
    lead = members.groupBy("band").agg(F.max(F.struct("degree", "class", "n")).alias("lead"))
    led = members.select("class", "band", "members").join(lead.hint("merge"), "band")
    bucket = F.struct("band", "members", F.col("lead.class").alias("lead"), F.col("lead.degree").alias("lead_degree"), F.col("lead.n").alias("lead_n"))
    buckets = led.groupBy("class").agg(F.collect_list(bucket).alias("buckets"))
    return stored(known.drop("shared").join(buckets.hint("merge"), "class"), "minhash-leads")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (class, doc_id, text_hash, and others) with each class's set, from a document that doc_id and text_hash name. Rows
    that repeat it follow one another and are passed over."""
    names = [c for c in wanted.columns if c not in ("doc_id", "text_hash")]

    def run(batches):
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, keep, sets = batch.slice(at, 128), [], []
                for i, (k, text) in enumerate(zip(part.column("class").to_pylist(), part.column("text").to_pylist())):
                    if k != last:
                        last = k
                        keep.append(i)
                        sets.append(shingle_set(text or b"", size).tobytes())
                rows = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "set"])

    key = ["doc_id", "text_hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    found = rows.join(wanted.hint("merge"), key).select(*names, "text")
    return found.mapInArrow(run, wanted.select(*names).schema.add("set", "binary"))


def near(own: np.ndarray, sets: list[np.ndarray], similarity: int) -> np.ndarray:
    """Which sorted sets meet 100 * |A and B| >= similarity * |A or B| with own."""
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
    return 100 * shared >= similarity * (size + len(own) - shared)


def alike(x, y, similarity: int):
    """Sets of other sizes can't be similar enough."""
    return 100 * F.least(x, y) >= similarity * F.greatest(x, y)


def _sets(batch, rows) -> list[np.ndarray]:
    column = batch.column("set")
    return [np.frombuffer(column[i].as_buffer(), np.uint64) for i in rows]


def _runs(batch, names: list[str]):
    """(start, end) of runs of rows that agree in the columns, of at most 128 rows."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start] or i - start == 128:
            yield keys[start], start, i
            start = i


def lead_links(sets: DataFrame, similarity: int) -> DataFrame:
    """(class, lead) that are similar enough. sets: class, degree, leading (whether it is a lead), leads (array of lead and
    lead_degree) and set. Each lead goes to as many salts as its degree asks for, each member to one salt of its leads, and
    members stream past their lead's set."""
    salts = lambda degree: F.ceil(degree / (STREAM * 8)).cast("int")  # noqa: E731  most members meet in several bands
    own = F.when(F.col("leading"), F.transform(F.sequence(F.lit(0), salts(F.col("degree")) - 1), lambda s: F.struct(F.col("class").alias("lead"), s.alias("salt"), F.lit(0).alias("streamed"))))
    part = lambda x: F.pmod(F.xxhash64("class"), salts(x["lead_degree"]).cast("long")).cast("int")
    others = F.transform("leads", lambda x: F.struct(x["lead"].alias("lead"), part(x).alias("salt"), F.lit(1).alias("streamed")))
    meeting = sets.select("class", "set", F.explode(F.concat(F.coalesce(own, F.array()), others)).alias("m")).select("m.*", "class", "set")

    def run(batches):
        now, held = None, None
        for batch in batches:
            found = ([], [])
            for (lead, salt, streamed), a, b in _runs(batch, ["lead", "salt", "streamed"]):
                if not streamed:
                    now, held = (lead, salt), np.array(_sets(batch, [a])[0])
                elif now == (lead, salt):
                    hits = np.flatnonzero(near(held, _sets(batch, range(a, b)), similarity))
                    found[0].extend(batch.column("class").slice(a, b - a).take(pa.array(hits)).to_pylist())
                    found[1].extend([lead] * len(hits))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in found], ["class", "lead"])

    ordered = meeting.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "streamed")
    return ordered.mapInArrow(run, "class binary, lead binary")


def rest_links(members: DataFrame, similarity: int) -> DataFrame:
    """(a, b), the roots of pairs of a bucket that are similar enough, one of them apart and their roots unlike. members: band,
    blocks, class, root, apart, bands and set.

    A bucket's apart members are dealt over its blocks and held; every member streams past each block. A pair that meets in several
    buckets is compared in the first.
    """
    at = F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int")
    held = F.when(F.col("apart"), F.array(F.struct(at.alias("block"), F.lit(0).alias("streamed"))))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("streamed")))
    meeting = members.select("band", "class", "root", "apart", "bands", "set", F.explode(F.concat(F.coalesce(held, F.array()), every)).alias("m"))
    meeting = meeting.select("band", "m.*", "class", "root", "apart", "bands", "set")

    def bands_of(batch, a, b):
        return batch.column("bands").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)

    def run(batches):
        now, block = None, []
        for batch in batches:
            found = set()
            for (band, number, streamed), a, b in _runs(batch, ["band", "block", "streamed"]):
                if (band, number) != now:
                    now, block = (band, number), []
                name, root, apart = (batch.column(c).slice(a, b - a).to_pylist() for c in ("class", "root", "apart"))
                sets, bands = _sets(batch, range(a, b)), bands_of(batch, a, b)
                if not streamed:
                    block += [(*x, np.array(s), np.array(y)) for x, s, y in zip(zip(name, root), sets, bands)]
                    continue
                size = np.array([len(s) for s in sets])
                names, roots, aparts = np.array(name, object), np.array(root, object), np.array(apart)
                for own_name, own_root, own, own_bands in block:
                    first = (bands == own_bands).argmax(1)
                    ok = (bands[np.arange(b - a), first] == band) & (own_bands[first] == band) & (roots != own_root) & (~aparts | (names > own_name))
                    ok &= 100 * np.minimum(size, len(own)) >= similarity * np.maximum(size, len(own))
                    if len(which := np.flatnonzero(ok)):
                        for i in which[near(own, [sets[j] for j in which], similarity)]:
                            found.add((max(own_root, root[i]), min(own_root, root[i])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (list(zip(*found)) or [[], []])], ["a", "b"])

    ordered = meeting.repartition("band", "block").sortWithinPartitions("band", "block", "streamed")
    return ordered.mapInArrow(run, "a binary, b binary")


def rooted(df: DataFrame, node: str, roots: DataFrame | None, name: str) -> DataFrame:
    """df with the root of a node, which is the node itself where roots (node, root) doesn't know it."""
    if roots is None:
        return df.withColumn(name, F.col(node))
    return df.join(roots.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, similarity: int) -> DataFrame:
    """(class, component_id) of the classes that share a bucket: the smallest doc_id reachable over links."""
    led = leads_of(classes)
    leading = F.exists("buckets", lambda x: x["lead"] == F.col("class"))
    meets = F.filter("buckets", lambda x: (x["lead"] != F.col("class")) & alike(F.col("n"), x["lead_n"], similarity))
    wanted = led.select("class", "doc_id", "text_hash", "bands", "degree", leading.alias("leading"), F.array_distinct(F.transform(meets, lambda x: F.struct(x["lead"].alias("lead"), x["lead_degree"].alias("lead_degree")))).alias("leads"))
    sets = stored(shingle_sets(docs, wanted, size), "minhash-sets")
    linked = lead_links(sets, similarity).groupBy("class").agg(F.array_sort(F.collect_set("lead")).alias("linked"))
    hangs = F.when(leading, F.col("class")).otherwise(F.coalesce(F.get("linked", F.lit(0)), F.col("class")))
    more = F.filter("buckets", lambda x: (x["members"] > 2) & (x["lead"] != F.col("class")))
    placed = led.join(linked.hint("merge"), "class", "left").select("class", "doc_id", "n", hangs.alias("on"), "linked", F.transform(more, lambda x: F.struct("class", x["band"].alias("band"), x["lead"].alias("lead"))).alias("open"))
    placed = stored(placed, "minhash-placed")
    between = placed.select("on", F.explode("linked").alias("b")).filter(F.col("on") != F.col("b")).select(F.col("on").alias("a"), "b")
    roots = components(between)
    placed = rooted(placed, "on", roots, "root")

    # what the leads left apart: members of a bucket that are not in its lead's component meet all members of other components
    open_ = rooted(placed.select("n", "root", F.explode("open").alias("o")).select("n", "root", "o.*"), "lead", roots, "lead_root")
    open_ = open_.select("band", "class", "n", "root", (F.col("root") != F.col("lead_root")).alias("apart"))
    held = F.sum(F.when(F.col("apart"), 8 * F.col("n")))
    several = open_.groupBy("band").agg(F.ceil(held / HELD_BYTES).cast("int").alias("blocks"), F.count("*").alias("_n")).filter("blocks > 0 AND _n > 1").drop("_n")
    others = stored(open_.join(several.hint("merge"), "band"), "minhash-open")
    if not others.isEmpty():
        met = others.join(sets.select("class", "bands", "set").hint("merge"), "class")
        later = components(rest_links(met, similarity))
        if later is not None:
            placed = rooted(placed.drop("on").withColumnRenamed("root", "on"), "on", later, "root")
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.select("class", "root").join(lowest, "root").select("class", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, text_hash (64 bits, of the text), n_shingles, component_id (the smallest doc_id reachable over links, itself included) and kept (doc_id is its
    component_id), one row per row of docs.

    docs needs doc_id and text; other columns are ignored. Null, empty and blank texts have an empty set and link with
    nothing. A row without doc_id keeps a null component_id, links with nothing and is kept. Rows that share a doc_id
    are compared by their own texts. An empty table gives an empty result.
    """
    rows = stored(signed(docs, size), "minhash-rows")
    live = rows.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(live.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).select("class", "at.*", "n", "bands"), "minhash-classes")
    linked = linked_classes(docs, classes, size, similarity)
    ids = classes.select("class", "doc_id").join(linked, "class", "left").select("class", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.join(ids, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest doc_id, once if the row is repeated. Rows
    with an empty set or without doc_id stay. docs may have any other columns."""
    keep = near_duplicates(docs.select("doc_id", "text"), size, similarity).filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "text_hash").distinct()
    nested = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row"))
    stay = nested.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text_hash"]).join(keep.hint("merge"), ["doc_id", "text_hash"], "left_semi")
    return stay.unionByName(nested.filter(F.col("doc_id").isNull())).select("row.*")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4).drop("text_hash")
