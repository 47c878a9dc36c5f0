"""Vault loaders: which rows of a batch are new to a hub, link or satellite. Pure functions of batch and target.

A target of None is one that does not exist yet: all rows are new. Which of several rows with one key is taken is decided by
an order over all columns, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.sources.scratch import stored


def load_time(fixed=None) -> Column:
    """The current time, or a fixed one for reproducible runs."""
    return F.current_timestamp() if fixed is None else F.lit(fixed).cast("timestamp")


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, so that it is never broadcast: the optimizer goes by the size of compressed files and
    counts a hash of 64 or 128 characters as 20 bytes, and what it takes for 10 MB may be some hundred in the driver."""
    return df.hint("merge")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key: the first by order, then by all other columns. Aggregated, not windowed, so partial results are
    combined before the shuffle and a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    lead = [c.alias(f"_o{i}") for i, c in enumerate(order or [])]
    best = df.groupBy(*keys).agg(F.min(F.struct(*lead, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def new_by_key(batch: DataFrame, target: DataFrame | None, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of batch, one per key, whose key the target lacks: loader of hubs, of links (keys: the hub hashes) and of
    transaction satellites, where the first write wins. Rows with a null key are dropped from no side: a null key is never
    found in the target, as in any equality."""
    one = first_per_key(batch, keys, order)
    return one if target is None else one.join(growing(target.select(*keys)), keys, "left_anti")


#: Words of 64 bits in the table of a batch's keys: 16 MB as rows, whatever the batch holds.
KEY_WORDS = 1 << 20


def _word_and_bit(h: Column, words: int) -> tuple[Column, Column]:
    """Of a hash of 64 bits, its place in the table."""
    return F.pmod(F.shiftright(h, 6), F.lit(words)).alias("_word"), F.pmod(h, F.lit(64)).cast("int").alias("_bit")


def may_have_keys(target: DataFrame, batch: DataFrame, keys: list[str], words: int = KEY_WORDS) -> DataFrame:
    """The key columns of target's rows whose key may be in batch: all that are, and few others while batch has fewer keys than a few
    million. The batch's keys become bits of a table of at most `words` rows, which is broadcast, so the target is read past it
    and what is left is all that a join has to move."""
    word, bit = _word_and_bit(F.xxhash64(*keys), words)
    bits = batch.select(word, bit).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    held = target.select(*keys, word, bit).join(F.broadcast(bits), "_word")  # at most `words` rows
    return held.filter(F.getbit("_bits", F.col("_bit")) == 1).select(*keys)


def new_by_key_pruned(batch: DataFrame, target: DataFrame | None, keys: list[str], order: list[Column] | None = None, words: int = KEY_WORDS) -> DataFrame:
    """As new_by_key(), for a target much larger than the batch: the target's keys are pruned by the batch's before anything is
    shuffled, so a load moves about as many rows as the batch has. The batch is reduced to one row per key once, and stored."""
    if target is None:
        return new_by_key(batch, None, keys, order)
    one = stored(first_per_key(batch, keys, order), "batch-keys")
    return one.join(may_have_keys(target, one, keys, words), keys, "left_anti")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key by order (ascending columns, null first), ties to the larger of all other columns. Aggregated like
    first_per_key."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*lead, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def preceding(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "_before") -> DataFrame:
    """df with a struct of columns of the row before each row, by order among rows of the same keys (nulls are one key), null for a key's first
    row. Rows are range-partitioned by keys and order, so a key of any size is spread over tasks; what a range needs of the one
    before it is that one's last row, and there is one such row per range."""
    by = [*keys, *(c for c in order if c not in keys)]
    placed = stored(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    row = F.struct(F.struct(*keys).alias("key"), F.struct(*columns).alias("row"))
    last = placed.groupBy("_range").agg(F.max_by(row, F.struct(*by)).alias("_last"))
    last = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))  # one row per range
    before = F.coalesce(F.lag(row).over(Window.partitionBy("_range").orderBy(*by)), F.col("_carried"))
    out = placed.join(F.broadcast(last), "_range").withColumn("_found", before)  # one row per range
    same = F.col("_found.key").eqNullSafe(F.struct(*keys))
    return out.withColumn(name, F.when(same, F.col("_found.row"))).drop("_range", "_carried", "_found")


def changed_rows(batch: DataFrame, target: DataFrame | None, key: str, change: str = "Hash_Diferenciador", time: str = "FechaRegistro", sequence: str | None = None) -> DataFrame:
    """State-satellite loader: rows of batch that differ from the version the target holds last.

    Rows with the same key and change hash are one. Without sequence every distinct version is compared with the target's
    latest. With sequence (a column that orders the batch) a version is new if it differs from the one before it, the first
    from the target's latest, so A, B, A within a batch gives three rows; only a key's first row meets the target, so a key
    with most of the batch's rows is no burden.
    """
    now = None if target is None else target.groupBy(key).agg(F.max_by(change, F.struct(time, change)).alias("_now"))
    differs = F.col("_now").isNull() | (F.col("_now") != F.col(change))
    if sequence is None:
        rows = first_per_key(batch, [key, change])
        return rows if now is None else rows.join(growing(now), key, "left").filter(differs).drop("_now")
    rows = preceding(batch, [key], [sequence, change], [change])
    rows = rows.filter(F.col("_before").isNull() | ~F.col(f"_before.{change}").eqNullSafe(F.col(change)))
    if now is None:
        return rows.drop("_before")
    first = rows.filter(F.col("_before").isNull()).join(growing(now), key, "left").filter(differs).drop("_now")
    return rows.filter(F.col("_before").isNotNull()).unionByName(first).drop("_before")


def split_by_repeats(df: DataFrame, keys: list[str], words: int = KEY_WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key no other row has, and those that may share theirs. Only hashes of the keys are moved; those that repeat become bits of a table
    of at most `words` rows, which is broadcast."""
    one, h = F.expr("shiftleft(1L, _bit)"), F.xxhash64(*keys)
    repeated = df.groupBy(h.alias("_h")).agg(F.count("*").alias("_n")).filter("_n > 1")
    bits = stored(repeated.select(*_word_and_bit(F.col("_h"), words)).groupBy("_word").agg(F.bit_or(one).alias("_bits")), "repeat-bits")
    told = df.select("*", *_word_and_bit(h, words)).join(F.broadcast(bits), "_word", "left")  # at most `words` rows
    inside = F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))
    return told.filter(~inside).select(*df.columns), told.filter(inside).select(*df.columns)


def _digest(key: str) -> Column:
    return F.unhex(F.md5(F.col(key).cast("string")))


def _version(key: str, change: str) -> tuple[Column, Column]:
    text = F.col(change).cast("string")
    return _digest(key), F.concat(F.rpad(text, 16, " ").cast("binary"), F.unhex(F.md5(text)))


def version_digests(df: DataFrame, key: str, change: str, *more: str) -> DataFrame:
    """Versions without their rows, key and change hash in short, under their names: 16 bytes of a key, 32 of a change hash, in the order of the change hashes'
    first 16 characters. Nulls stay null; different texts are taken for equal with a chance of 2^-128."""
    return df.select(*[c.alias(n) for c, n in zip(_version(key, change), (key, change))], *more)


def changed_rows_pruned(batch: DataFrame, target: DataFrame | None, key: str, change: str = "Hash_Diferenciador", time: str = "FechaRegistro", words: int = KEY_WORDS) -> DataFrame:
    """As changed_rows() without sequence, for wide rows that lie in a table: they are decided upon by digests, and nearly all of them stay where they are."""
    held = None if target is None else version_digests(target, key, change, time).groupBy(key).agg(F.max_by(change, F.struct(time, change)).alias(change))
    return changed_from_digests(batch, held, key, change, words)


def changed_from_digests(batch: DataFrame, held: DataFrame | None, key: str, change: str, words: int = KEY_WORDS, watched: DataFrame | None = None) -> DataFrame:
    """As changed_rows_pruned(); held: version_digests() of each key's latest version. Digests tell which keys have one row in the batch and a new
    version, one row and the version that is held, or several rows. They become bits of a table of at most `words` rows, which is broadcast: rows
    under a bit of the first kind alone are taken, those under one of the second alone left, and only the others are moved whole, with what is held of
    them, and compared. watched: the batch again, as quality.watching() gives it; it is read once and whole."""
    one, columns = F.expr("shiftleft(1L, _bit)"), batch.columns
    if held is None:
        keys = batch.groupBy(F.xxhash64(_digest(key)).alias("_h")).agg(F.count("*").alias("_n")).filter("_n > 1")
        bits = keys.select(*_word_and_bit(F.col("_h"), words)).groupBy("_word").agg(F.bit_or(one).alias("_unsure"))
    else:
        nothing, plain = F.lit(None).cast("binary"), F.col(key).isNotNull() & F.col(change).isNotNull()
        same = F.substring(change, -16, 16)  # what tells versions apart, without what orders them
        rows = version_digests(batch, key, change).select(F.col(key).alias("_k"), same.alias("_c"), nothing.alias("_o"), F.when(plain, 1).otherwise(2).alias("_n"))
        keys = rows.unionAll(held.select(key, nothing, same, F.lit(0))).groupBy("_k").agg(F.max("_c").alias("_c"), F.max("_o").alias("_o"), F.sum("_n").alias("_n"))
        new = F.col("_o").isNull() | (F.col("_o") != F.col("_c"))
        kinds = {"_new": (F.col("_n") == 1) & new, "_old": (F.col("_n") == 1) & ~new, "_several": F.col("_n") > 1}
        told = keys.select(*_word_and_bit(F.xxhash64("_k"), words), *[k.alias(n) for n, k in kinds.items()])
        bits = told.groupBy("_word").agg(*[F.coalesce(F.bit_or(F.when(F.col(n), one)), F.lit(0)).alias(n) for n in kinds])
        bits = bits.selectExpr("_word", "_several | (_new & _old) AS _unsure", "_new & ~_old & ~_several AS _sure").filter("_unsure <> 0 OR _sure <> 0")
    bits = stored(bits, "version-bits")

    def under(df: DataFrame, name: str, digest: Column, keep: bool = True) -> DataFrame:
        """The rows whose key has the bit, or has it not."""
        told = df.select("*", *_word_and_bit(F.xxhash64(digest), words)).join(F.broadcast(bits), "_word", "left")  # at most `words` rows
        inside = F.coalesce(F.getbit(name, F.col("_bit")) == 1, F.lit(False))
        return told.filter(inside if keep else ~inside).select(*df.columns)

    sure = batch if watched is None else watched
    unsure = first_per_key(under(batch, "_unsure", _digest(key)), [key, change])
    if held is None:
        return under(sure, "_unsure", _digest(key), False).unionByName(unsure)
    near = under(held, "_unsure", F.col(key)).select(F.col(key).alias("_k"), F.col(change).alias("_now"))
    short = unsure.select("*", *[c.alias(n) for c, n in zip(_version(key, change), ("_k", "_c"))])
    compared = short.join(growing(near), "_k", "left").filter(F.col("_now").isNull() | (F.col("_now") != F.col("_c")))
    return under(sure, "_sure", _digest(key)).unionByName(compared.select(*columns))
