"""Exact Jaccard self-join of texts on word n-grams, by R-trees over count vectors.

Points. Every n-gram is hashed to one of GROUPS groups, and a text's set becomes the vector of how many of its n-grams fall in
each. Two sets share at most the sum over groups of the smaller count, so that sum bounds their similarity; a tree node that knows the
greatest count per group and the range of set sizes below it bounds the similarity of all its points at once.

Where trees are built. Vectors of many groups lie far apart but fill every box of a large tree, so one tree over a corpus would
prune nothing near its root. Sets that are similar enough share an n-gram among the first |A| - ceil(0.8 |A|) + 1 of each, in any
order of n-grams that both follow; so a tree is built for each n-gram that several sets have among their first, and no pair
is lost. The order takes n-grams that are frequent in the corpus last, by a table of counts of fixed size. N-grams with the
same sets get one tree. Sets with many members are dealt over blocks: each block holds its members in a tree, those of later blocks
stream past it.

Links. Texts with the same set are one class. In a first round the trees tell which classes may be similar enough, as links that
connect them into groups. In each group the member that met most others, the lead, is compared with all on full sets. Members that are
not linked with it are held in trees again, and the group's members stream past; what a tree leaves is compared on full sets,
unless links that are known connect the two. So links are never listed pair by pair, and components are those of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultspark.llm.common import stored, table
from vaultspark.llm.graph import components
from vaultspark.llm.minhash import HELD_BYTES, SHINGLE, SIMILARITY, lead_links, near, rooted, shingle_set, shingle_sets

#: Groups of the count vectors of sets below LARGE n-grams; with every fourfold size, groups are four times as many, as vectors of
#: sets without a common n-gram differ by more than similar sets may only while a set has less than about 26 n-grams a group.
GROUPS, LARGE = 64, 1024
#: Cells of the table that tells frequent n-grams, and the rows that it travels in.
CELL_BITS, SLICES = 20, 16
#: Points that a leaf holds, leaves or nodes that a node holds, and points of a tree.
LEAF, FAN, HELD = 16, 8, 4096
#: A count of FULL or more is stored as FULL and taken for UNBOUNDED, so that bounds stay bounds.
FULL, UNBOUNDED = 255, 1 << 40


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """The binary logarithm of how often the n-grams of each cell occur in all texts: a table of 2^CELL_BITS bytes."""
    cells, part = 1 << CELL_BITS, (1 << CELL_BITS) // SLICES

    def count(batches):
        total, held, n = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = shingle_set(text or b"", size)
                held.append((tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64))
                n += len(tokens)
                if n > cells:
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=cells)
        if total.any():
            data = np.minimum(total, 65535).astype(np.uint16)  # an order of n-grams needs no exact counts
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([data[i * part : (i + 1) * part].tobytes() for i in range(SLICES)], pa.binary())], ["slice", "data"])

    def add(batches):
        total = {}
        for batch in batches:
            for row in batch.to_pylist():
                total[row["slice"]] = total.get(row["slice"], 0) + np.frombuffer(row["data"], np.uint16).astype(np.int64)
        levels = [np.log2(t + 1).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["slice", "data"])

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "slice int, data binary")
    rows = counts.repartition(SLICES, "slice").mapInArrow(add, "slice int, data binary").collect()  # SLICES rows, 2^CELL_BITS bytes in all
    table_ = np.zeros(cells, np.uint8)
    for r in rows:
        table_[r["slice"] * part : (r["slice"] + 1) * part] = np.frombuffer(r["data"], np.uint8)
    return table_


def first_tokens(tokens: np.ndarray, levels: np.ndarray, similarity: int) -> np.ndarray:
    """The n-grams of a set, rarest cells first, of which similar sets have to share one."""
    n = len(tokens)
    wanted = n - (similarity * n + 99) // 100 + 1
    order = np.lexsort((tokens, levels[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))
    return tokens[order[:wanted]]


def level_of(n: int) -> int:
    """How many times a set of n n-grams has its groups multiplied by four."""
    level = 0
    while n >= LARGE << 2 * level:
        level += 1
    return level


def counted(tokens: np.ndarray) -> np.ndarray:
    groups = GROUPS << 2 * level_of(len(tokens))
    return np.minimum(np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups), FULL).astype(np.uint8)


def point_of(counts: bytes, level: int) -> np.ndarray:
    """A count vector at its own level or a lower one, where groups are sums of groups."""
    point = np.frombuffer(counts, np.uint8).astype(np.int64)
    point[point == FULL] = UNBOUNDED
    return point.reshape(-1, GROUPS << 2 * level).sum(0)


def signed(docs: DataFrame, levels: np.ndarray, size: int, similarity: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (digest of the set, null if empty), levels (at which it meets others, the own one first),
    counts and first (n-grams), for each row of docs."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, key, at_levels, counts, first = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingle_set(text or b"", size)
                    n.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    # a smaller set that is similar enough may be of the level below
                    at_levels.append(sorted({level_of(len(s)), level_of((similarity * len(s) + 99) // 100)}, reverse=True))
                    counts.append(counted(s).tobytes() if len(s) else None)
                    first.append(first_tokens(s, levels, similarity).view(np.int64) if len(s) else None)
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(at_levels, pa.list_(pa.int32())), pa.array(counts, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "class", "levels", "counts", "first"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class binary, levels array<int>, counts binary, first array<long>")


class CountTree:
    """A packed R-tree over count vectors: points split at medians into leaves of LEAF, leaves and nodes packed by FAN."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, similarity: int):
        self.similarity = similarity
        order, todo = [], [np.arange(len(points))]
        while todo:
            some = todo.pop()
            if len(some) <= LEAF:
                order.append(some)
                continue
            inside = points[some]
            by = inside[:, np.argmax(inside.max(0) - inside.min(0))]
            halves = np.argsort(by, kind="stable")
            todo += [some[halves[len(some) // 2 :]], some[halves[: len(some) // 2]]]
        self.order = np.concatenate(order)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.starts = np.cumsum([0] + [len(o) for o in order])[:-1]
        self.ends = np.append(self.starts[1:], len(points))
        #: by level, leaves first: greatest counts, least and greatest size
        self.levels = [(np.maximum.reduceat(self.points, self.starts), np.minimum.reduceat(self.sizes, self.starts), np.maximum.reduceat(self.sizes, self.starts))]
        while len(self.levels[-1][0]) > FAN:
            top, least, most = self.levels[-1]
            at = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def _may(self, point: np.ndarray, size: int, top: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a set of the size and a set in a box can be similar enough."""
        s, shared = self.similarity, np.minimum(top, point).sum(1)
        return ((100 + s) * shared >= s * (size + least)) & (100 * size >= s * least) & (100 * most >= s * size)

    def search(self, point: np.ndarray, size: int, live: np.ndarray) -> np.ndarray:
        """Places, in the order of the tree, of live points whose sets can be similar enough to the given one."""
        leaves = np.logical_or.reduceat(live, self.starts)
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[depth]
            if depth == 0:
                nodes = nodes[leaves[nodes]]
            nodes = nodes[self._may(point, size, top[nodes], least[nodes], most[nodes])]
            if not len(nodes):
                return nodes
            if depth:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        if len(nodes) == 1:
            found = np.arange(self.starts[nodes[0]], self.ends[nodes[0]])
        else:
            found = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[nodes].tolist(), self.ends[nodes].tolist())])
        found = found[live[found]]
        return found[self._may(point, size, self.points[found], self.sizes[found], self.sizes[found])]


class Block:
    """The members that a block holds, in a tree, and which of them links have connected so far."""

    def __init__(self, roots: list, sizes: np.ndarray, points: np.ndarray, sets: list | None, similarity: int):
        self.similarity = similarity
        self.tree = CountTree(points, sizes, similarity)
        self.roots = [roots[i] for i in self.tree.order]
        self.sets = sets and [sets[i] for i in self.tree.order]
        self.first = {r: i for i, r in reversed(list(enumerate(self.roots)))}
        self.part = np.array([self.first[r] for r in self.roots])

    def part_of(self, root) -> int:
        """The part that members with this root belong to, -1 if none is held."""
        return int(self.part[self.first[root]]) if root in self.first else -1

    def links(self, root, size: int, point: np.ndarray, own: np.ndarray | None) -> list[tuple]:
        """Links of a member with held members that it is not connected with yet, one for each part that it reaches. Connects those parts."""
        part = self.part_of(root)
        found = self.tree.search(point, size, self.part != part)
        out = []
        while len(found):
            some = found[:LEAF]
            hits = some if own is None else some[near(own, [self.sets[i] for i in some], self.similarity)]
            if not len(hits):
                found = found[LEAF:]
                continue
            i = int(hits[0])
            out.append((root, self.roots[i]))
            other = self.part[i]
            if part < 0:
                part = other
            else:
                self.part[self.part == other] = part
            found = found[self.part[found] != part]
        return out

    def within(self) -> list[tuple]:
        out, tree = [], self.tree
        for i, name in enumerate(self.roots):
            if (self.part == self.part[i]).all():
                break  # one part is left
            out += self.links(name, int(tree.sizes[i]), tree.points[i], self.sets and self.sets[i])
        return out


def tree_links(members: DataFrame, keys: list[str], similarity: int, exact: bool) -> DataFrame:
    """(a, b): links between roots of members that meet under the keys, enough to connect all that are linked. members: keys (level among them),
    blocks, apart, class, root, n, counts, and set if exact: then links are confirmed on sets, else they say what can be similar enough.

    Members that are apart are dealt over a key's blocks and held; each streams past the blocks before its own, and members that
    are not apart past all. Pairs of members that are not apart are not compared.
    """
    own = F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int")
    held = F.array(F.struct(own.alias("block"), F.lit(0).alias("streamed")))
    past = lambda upto: F.transform(F.slice(F.sequence(F.lit(0), F.col("blocks")), F.lit(1), upto), lambda b: F.struct(b.alias("block"), F.lit(1).alias("streamed")))
    places = F.when(F.col("apart"), F.concat(held, past(own))).otherwise(past(F.col("blocks")))
    names, at_level = ["class", "root", "n", "counts"] + ["set"] * exact, keys.index("level")
    meeting = members.select(*keys, *names, F.explode(places).alias("m")).select(*keys, "m.*", *names)

    def run(batches):
        now, waiting, block = None, [], None

        def built():
            nonlocal block, waiting
            if waiting and block is None:
                points = np.stack([point_of(r[3], now[at_level]) for r in waiting])
                sets = [np.frombuffer(r[4], np.uint64) for r in waiting] if exact else None
                block = Block([r[1] for r in waiting], np.array([r[2] for r in waiting], np.int64), points, sets, similarity)
                waiting = []
                return block.within()
            return []

        def told(links):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (list(zip(*links)) or [[], []])], ["a", "b"])

        for batch in batches:
            links = []
            heads = list(zip(*(batch.column(c).to_pylist() for c in [*keys, "block"])))
            streamed = batch.column("streamed").to_pylist()
            columns = [batch.column(c).to_pylist() for c in names]
            for i, head in enumerate(heads):
                if head != now:
                    links += built()
                    now, waiting, block = head, [], None
                row = [c[i] for c in columns]
                if not streamed[i]:
                    waiting.append(row)
                    continue
                links += built()
                if block is not None:
                    links += block.links(row[1], row[2], point_of(row[3], now[at_level]), np.frombuffer(row[4], np.uint64) if exact else None)
            yield told(links)
        yield told(built())

    ordered = meeting.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "streamed")
    return ordered.mapInArrow(run, "a binary, b binary")


def candidate_links(classes: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of classes that can be similar enough, and h (a hash of the class) with degree (how many members its shared n-grams have).
    classes: class, h, n, levels, counts, first."""
    entries = classes.select(F.explode("first").alias("token"), "h").repartition("token")
    shared = stored(entries.withColumn("members", F.count("*").over(Window.partitionBy("token"))).filter("members > 1"), "join-shared")
    alike = shared.groupBy("token").agg(F.first("members").alias("members"), F.bit_xor("h").alias("x"), F.min("h").alias("low"), F.bit_xor(F.xxhash64(F.lit(GROUPS), "h")).alias("y"))
    trees = alike.groupBy("members", "x", "y", "low").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("members") / HELD).cast("int").alias("blocks"))
    met = shared.select("token", "h").join(stored(trees, "join-trees").hint("merge"), "token").join(classes.select("h", "class", "n", "counts", F.explode("levels").alias("level")).hint("merge"), "h")
    links = tree_links(met.withColumn("apart", F.lit(True)).withColumn("root", F.col("class")), ["token", "level"], similarity, exact=False)
    return links, shared.groupBy("h").agg(F.sum("members").alias("degree"))


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, similarity: int) -> DataFrame | None:
    """(class, component_id) of the classes that may have a link: the smallest doc_id reachable over links. None if there are none."""
    links, degrees = candidate_links(classes, similarity)
    groups = components(links)
    if groups is None:
        return None
    members = groups.select(F.col("node").alias("class"), F.col("root").alias("group")).join(classes.drop("first").hint("merge"), "class").join(degrees.hint("merge"), "h", "left")
    members = stored(members.drop("h"), "join-groups")
    sizes = members.groupBy("group").agg(F.count("*").alias("members"), F.min(F.element_at("levels", -1)).alias("level"), F.max(F.struct("degree", "class", "n")).alias("lead"))
    led = members.drop("degree").join(sizes.select("group", "level", "members", F.col("lead.class").alias("lead"), F.col("lead.n").alias("lead_n")).hint("merge"), "group")
    # lead_links() deals a lead's members over salts by its degree; each member here meets it once
    degree = F.col("members") * 8
    meets = (F.col("lead") != F.col("class")) & (100 * F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n"))
    lead = F.when(meets, F.array(F.struct("lead", degree.alias("lead_degree")))).otherwise(F.array().cast("array<struct<lead:binary,lead_degree:bigint>>"))
    wanted = led.select("class", "doc_id", "text_hash", "group", "level", "members", "n", "counts", degree.alias("degree"), (F.col("lead") == F.col("class")).alias("leading"), lead.alias("leads"))
    sets = stored(shingle_sets(docs, wanted, size), "join-sets")
    linked = lead_links(sets, similarity).select("class", F.col("lead").alias("root")).distinct()
    placed = stored(sets.drop("set", "leads", "degree", "counts").join(linked.hint("merge"), "class", "left").withColumn("root", F.coalesce("root", "class")), "join-placed")
    apart = ~F.col("leading") & (F.col("root") == F.col("class"))
    open_ = placed.filter(F.col("members") > 2).groupBy("group").agg(F.ceil(F.sum(F.when(apart, 8 * F.col("n"))) / HELD_BYTES).cast("int").alias("blocks")).filter("blocks > 0")
    rest = placed.select("class", "group", "level", "root", apart.alias("apart")).join(stored(open_, "join-open").hint("merge"), "group").join(sets.select("class", "n", "counts", "set").hint("merge"), "class")
    later = components(tree_links(rest, ["group", "level"], similarity, exact=True))
    placed = rooted(placed.select("class", F.col("root").alias("on")), "on", later, "root").join(classes.select("class", "doc_id").hint("merge"), "class")
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.select("class", "root").join(lowest, "root").select("class", "component_id")


def ngram_join(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, text_hash (64 bits, of the text), n_shingles (size of the set of n-grams) and component_id (the smallest doc_id reachable over links,
    itself included), one row per row of docs. A link is a Jaccard similarity of at least `similarity` percent; none is missed.

    docs needs doc_id and text; other columns are ignored. A text of fewer than `size` words is one n-gram; null, empty and blank texts
    have none and link with nothing. A row without doc_id keeps a null component_id and links with nothing. Rows that share a
    doc_id are compared by their own texts. An empty table gives an empty result.
    """
    rows = stored(signed(docs, frequencies(docs, size), size, similarity), "join-rows")
    live = rows.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    firsts = [F.first(c).alias(c) for c in ("levels", "counts", "first")]
    classes = live.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n_shingles").alias("n"), *firsts)
    classes = stored(classes.select("class", F.xxhash64("class").alias("h"), "at.*", "n", "levels", "counts", "first"), "join-classes")
    linked = linked_classes(docs, classes, size, similarity)
    ids = classes.select("class", "doc_id")
    if linked is not None:
        ids = ids.join(linked, "class", "left").select("class", F.coalesce("component_id", "doc_id").alias("doc_id"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "class").join(ids.select("class", F.col("doc_id").alias("_of")), "class", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_of", "doc_id")).alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")
