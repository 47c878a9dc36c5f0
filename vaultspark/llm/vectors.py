"""What the two vector searches share: usable vectors, a bounded sample, and vectors gathered into blocks of rows."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import row_hash

#: The sample that thresholds and the index are fitted on: a tenth of the vectors (of very few: LEAST_SAMPLE), so many vectors at
#: most, and so many components.
SAMPLE_ROWS, SAMPLE_VALUES, SAMPLE_SHARE, LEAST_SAMPLE, SEED = 8192, 1 << 21, 0.1, 32, 8
#: Vectors of a block at most.
BLOCK = 2048
#: Queries of a block.
QUERY_BLOCK = 256


def finite(vector: str) -> Column:
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~odd


def usable(df: DataFrame, id_: str, vector: str, nonzero: bool = True) -> tuple[DataFrame, int, int]:
    """vec_id (long) and embedding of the rows that take part, how many, and their dimension. Rows with a null id, a null or
    empty vector, null or non-finite components, or, if nonzero, only zeros are left out; so are vectors of another
    dimension than the most frequent (the smaller at a tie), and a warning tells how many those are."""
    ok = F.col(id_).isNotNull() & finite(vector)
    if nonzero:
        ok = ok & F.exists(F.col(vector), lambda x: x != 0)
    rows = df.filter(ok).select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("dim")).alias("dim"))).alias("most")).first()
    if found["most"] is None:
        return rows, 0, 0
    n, dim = found["most"]["n"], -found["most"]["dim"]
    if found["all"] > n:
        warnings.warn(f"{found['all'] - n} vectors don't have the {dim} dimensions of most and take no part", stacklevel=2)
    return rows.filter(F.size("embedding") == dim), n, dim


def sample(rows: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors (double) of a sample drawn by a hash, in order of id."""
    wanted = min(SAMPLE_ROWS, max(LEAST_SAMPLE, SAMPLE_VALUES // max(1, dim)), max(LEAST_SAMPLE, int(SAMPLE_SHARE * n)))
    draw = F.pmod(row_hash(SEED, "vec_id"), F.lit(1 << 40)) < int(min(1.0, 0.95 * wanted / max(1, n)) * (1 << 40))
    got = sorted((r["vec_id"], r["embedding"]) for r in (rows if n <= wanted else rows.filter(draw)).limit(wanted).collect())
    return np.array([i for i, _ in got], np.int64), np.array([v for _, v in got], np.float64).reshape(len(got), dim)


def queries(rows: DataFrame, every: int) -> DataFrame:
    """Rows whose vec_id is divisible by every; rows that share an id count as one query, with the smallest vector."""
    return rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, of lists of one length, as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def gathered(rows: DataFrame, keys: list[str], most: int, extra: str | None = None) -> DataFrame:
    """Blocks of up to `most` rows that agree in the int columns keys: keys, ids, data (doubles) and, if named, extra
    (doubles), as bytes. Rows are streamed in order of the keys; a block is never larger, whatever a key holds."""
    names = [*keys, "ids", "data"] + ["extra"] * bool(extra)
    types = [pa.int32()] * len(keys) + [pa.binary()] * (2 + bool(extra))

    def run(batches):
        now, parts, held = None, [], 0

        def block():
            cols = [np.concatenate(x).tobytes() for x in zip(*parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*now, *cols], types)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in keys], 1)
            ids, data = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"))
            more = [batch.column(extra).to_numpy()] if extra else []
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if now is not None and now != tuple(key[a].tolist()):
                    yield block()
                    parts, held = [], 0
                now = tuple(key[a].tolist())
                while a < b:
                    end = min(b, a + most - held)
                    parts.append([x[a:end] for x in (ids, data, *more)])
                    held, a = held + end - a, end
                    if held >= most:
                        yield block()
                        parts, held = [], 0
                        now = now if a < b else None
        if parts:
            yield block()

    schema = ", ".join([f"{k} int" for k in keys] + ["ids binary", "data binary"] + ["extra binary"] * bool(extra))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "vec_id").mapInArrow(run, schema)


def best(found: DataFrame, k: int, largest: bool, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of found, ties to the smaller vec_id."""
    from pyspark.sql import Window

    order = F.desc("score") if largest else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast(score).alias("score"))
