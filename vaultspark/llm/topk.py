"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are quantised to integers and spread over blocks by a hash. In a block every dimension has its list of rows sorted
by component. For a query the lists are read in step, from the end where the query's weight makes products largest;
each row met is scored in full at once, and reading stops when the sum of the products at the current depth, which no
unmet row exceeds, is below the k-th score so far (or below the query's k-th score within the sample), or when no row is
unmet. At equality it reads on, as an unmet row could tie with a smaller id.

A query goes once to each group of blocks, in which it meets them one by one. The join hands over a block with one block of
queries after the other, so a task sorts each block's lists once and holds one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import vectors
from vaultspark.llm.common import row_hash, table

SCALE, FIRST_DEPTH, SEED = 1024, 8, 9
#: Vectors of a block, about; groups of blocks that a table is cut into before groups grow, and blocks of a group at most.
LIST_BLOCK, LEAST_GROUPS, GROUP = 4096, 64, 32
_LONG = (1 << 63) - 1


def quantise(x: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles; what leaves the doubles' range becomes the largest of them."""
    return np.nan_to_num(np.floor(SCALE * x))


def exact(rows: np.ndarray, queries: np.ndarray) -> bool:
    """Whether every inner product, and every sum on the way to it, is a whole number that doubles hold."""
    return bool(np.abs(rows).max(initial=0) * np.abs(queries).sum(-1).max(initial=0) < 1 << 53)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with a query; beyond the range of long they are its largest and smallest but one."""
    if exact(rows, query):
        return (rows @ query).astype(np.int64)
    whole = [int(q) for q in query]
    return np.array([max(-_LONG, min(_LONG, sum(int(x) * q for x, q in zip(row, whole)))) for row in rows], np.int64)


class SortedLists:
    """A block's rows with, per dimension, their places in ascending order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.order = ids, rows, np.argsort(rows, axis=0, kind="stable")

    def top(self, query: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k best rows of this block that score at least `least`, and how many rows were scored."""
        n, used = len(self.ids), np.flatnonzero(query)
        met = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        up, down = used[query[used] < 0], used[query[used] > 0]
        sure = 0.0 if exact(self.rows, query) else float("inf")  # what rounding may hide in the bound; then all is read
        depth, step = 0, FIRST_DEPTH
        while True:
            end = min(n, depth + step)
            fresh = met.copy()
            fresh[self.order[depth:end, up].ravel()] = True
            fresh[self.order[n - end : n - depth, down].ravel()] = True
            if not len(used):
                fresh[:] = True  # no list is read for a zero query: every row scores 0
            new = np.flatnonzero(fresh & ~met)
            met = fresh
            score = products(self.rows[new], query)
            keep = (self.ids[new] != own) & (score >= least)
            ids, scores = np.concatenate([ids, self.ids[new[keep]]]), np.concatenate([scores, score[keep]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            bound = (self.rows[self.order[end - 1, up], up] * query[up]).sum() + (self.rows[self.order[n - end, down], down] * query[down]).sum() + sure
            if met.all() or bound < least or len(ids) == k and bound < scores[-1]:
                return ids, scores, int(met.sum())
            depth, step = end, 2 * step


def searched(batches, dim: int, k: int):
    """Batches of (query_id, vec_id, score) from batches of (ids, data, q_ids, q_data, q_least), a block and a block of queries
    a row. Lists are sorted anew only where the block is not that of the row before."""
    held, lists = (b"", b""), None
    for batch in batches:
        for i in range(batch.num_rows):
            block = tuple(batch.column(c)[i].as_buffer().to_pybytes() for c in ("ids", "data"))
            if lists is None or block != held:
                held, lists = block, SortedLists(np.frombuffer(block[0], "i8"), quantise(np.frombuffer(block[1], "f8").reshape(-1, dim)))
            q_ids, q_data, least = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("q_ids", "i8"), ("q_data", "f8"), ("q_least", "f8")))
            asks = quantise(q_data.reshape(-1, dim))
            out = [(own, *lists.top(asks[j], own, k, least[j])) for j, own in enumerate(q_ids)]
            cols = [np.concatenate([np.full(len(f), own) for own, f, *_ in out]), np.concatenate([f for _, f, *_ in out]), np.concatenate([s for _, _, s, _ in out])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product of the quantised vectors): the k best of every row whose id is
    divisible by every, among all other rows; all candidates if fewer, ties to the smaller id.

    Vectors null, empty or with null or non-finite components take no part, nor does a null id; zero vectors do. A table
    without usable vectors gives an empty result. Scores are exact integers; beyond the range of long they stay at its ends.
    Other columns are ignored, and so, with a warning, are vectors of another dimension than most have.
    """
    rows, n, dim = vectors.usable(df, id_, vector, nonzero=False)
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-n // LIST_BLOCK)
    per = min(GROUP, max(1, blocks // LEAST_GROUPS))
    ids, x = vectors.sample(rows, n, dim)
    shared = spark.sparkContext.broadcast((ids, quantise(x)))

    def bound(batches):
        sample_ids, seen = shared.value
        for batch in batches:
            own, q = batch.column(0).to_numpy(), quantise(vectors.matrix(batch.column(1)))
            for a in range(0, len(own), 256):
                score = q[a : a + 256] @ seen.T if exact(seen, q[a : a + 256]) else np.full((len(own[a : a + 256]), 0), 0.0)
                if score.shape[1]:
                    score[own[a : a + 256, None] == sample_ids] = -np.inf
                least = -np.partition(-score, k - 1, 1)[:, k - 1] if score.shape[1] >= k else np.full(len(score), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 256]), batch.column(1).slice(a, 256), pa.array(least)], ["vec_id", "embedding", "least"])

    kind = rows.schema["embedding"].dataType.simpleString()
    salted = rows.select(F.pmod(row_hash(SEED, "vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding")
    stored = vectors.gathered(salted, ["block"], 2 * LIST_BLOCK).withColumn("group", F.floor(F.col("block") / per).cast("int"))
    per_block = -(-n // every) // vectors.QUERY_BLOCK + 1
    asked = vectors.queries(rows, every).mapInArrow(bound, f"vec_id long, embedding {kind}, least double")
    asked = asked.withColumn("part", F.pmod(row_hash(SEED, "vec_id"), F.lit(per_block)).cast("int"))
    asked = vectors.gathered(asked, ["part"], 2 * vectors.QUERY_BLOCK, "least").select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("extra").alias("q_least"))
    # every block of queries goes once to every group of blocks: the searches that the query set asks for, and no rows are paired
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // per))))

    def search(batches):
        return searched(batches, dim, k)

    # queries grow with the table, so they are never broadcast
    met = stored.join(asked.hint("merge"), "group").select("ids", "data", "q_ids", "q_data", "q_least")
    return vectors.best(met.mapInArrow(search, "query_id long, vec_id long, score long"), k, True, "long")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
