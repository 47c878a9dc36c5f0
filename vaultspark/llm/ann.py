"""Approximate nearest neighbours by adaptive dimension scan.

An inverted index of lists (k-means on a bounded sample) holds every vector in blocks. Vectors are rotated by a random
orthogonal matrix, so the first d of D rotated components are a random projection: sqrt(D/d) times the partial distance
estimates the whole. Within a probed list a candidate is abandoned as soon as the estimate exceeds (1 + EPSILON/sqrt(d))
times the query's threshold; components are read in column blocks. Those that stay are measured exactly on the original
vectors. A query's threshold begins as its k-th distance within the part of the sample that lies in its probed lists and
falls as nearer rows are found; the k rows of the sample that gave it are not abandoned, so k rows are found. The sample is
a tenth of the vectors at most, so nine in ten candidates or more are under test at every size.

How many lists a query probes is fitted too: the fewest with which sample queries find TARGET of their neighbours within
the sample. Where vectors have no structure, that is most lists, and the scan is what saves work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import vectors
from vaultspark.llm.common import table

COLUMNS, EPSILON, TARGET, SEED = 16, 2.1, 0.97, 4
MOST_LISTS, ROUNDS, CALIBRATE = 1024, 10, 256
#: Rows that are scanned before the threshold is taken anew.
CHUNK = 256


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    salts: np.ndarray  # blocks that each list is spread over
    sample_ids: np.ndarray
    sample: np.ndarray
    near: np.ndarray  # the list of each sample row

    def distances(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Squared, by the dot product: for lists and thresholds, not for results."""
        return np.maximum(0, (rows**2).sum(1)[:, None] + (to**2).sum(1) - 2 * rows @ to.T)


def fit(rows: DataFrame, n: int, dim: int, k: int) -> Index:
    ids, x = vectors.sample(rows, n, dim)
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    lists = int(np.clip(np.sqrt(n), 1, min(MOST_LISTS, max(1, len(x) // 4))))
    centroids = x[rng.choice(len(x), lists, replace=False)] if len(x) else np.zeros((1, dim))
    index = Index(rotation, centroids, lists, np.ones(lists, np.int64), ids, x, np.zeros(len(x), np.int64))
    for _ in range(ROUNDS):
        near = index.distances(x, index.centroids).argmin(1)
        sums, count = np.zeros_like(index.centroids), np.bincount(near, minlength=lists)
        np.add.at(sums, near, x)
        index.centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], index.centroids)
    index.near = near = index.distances(x, index.centroids).argmin(1)
    index.salts = np.ceil(np.bincount(near, minlength=lists) / max(1, len(x)) * n / vectors.BLOCK).astype(np.int64).clip(1)
    if len(x) > k:
        asked = x[:: max(1, len(x) // CALIBRATE)]
        true = index.distances(asked, x).argsort(1, kind="stable")[:, 1 : k + 1]
        place = index.distances(asked, index.centroids).argsort(1).argsort(1)  # of each list, for each query
        rank = np.sort(np.take_along_axis(place, near[true], 1).ravel())
        index.probes = int(rank[min(len(rank) - 1, int(np.ceil(TARGET * len(rank))) - 1)]) + 1
    return index


def scan(query: np.ndarray, turned: np.ndarray, limit: float, k: int, block: np.ndarray, block_turned: np.ndarray, able: np.ndarray, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block, and their exact distances, of what the hypothesis tests leave. Rows not marked in able are no
    candidates, rows marked in stays are not tested. The threshold is the k-th distance so far, or limit while that is less."""
    places, scores, dim = np.zeros(0, np.int64), np.zeros(0), len(query)
    for start in range(0, len(block), CHUNK):
        alive = start + np.flatnonzero(able[start : start + CHUNK])
        part = np.zeros(len(alive))
        for a in range(0, dim, COLUMNS):
            b = min(a + COLUMNS, dim)
            part = part + ((block_turned[alive, a:b] - turned[a:b]) ** 2).sum(1)
            if b < dim and np.isfinite(limit):
                keep = stays[alive] | (part * (dim / b) <= (limit * (1 + EPSILON / np.sqrt(b))) ** 2)
                alive, part = alive[keep], part[keep]
            if not len(alive):
                break
        if len(alive):
            exact = np.sqrt(((block[alive] - query) ** 2).sum(1))
            fits = exact <= limit
            places, scores = np.concatenate([places, alive[fits]]), np.concatenate([scores, exact[fits]])
            if len(scores) > k:
                kth = np.partition(scores, k - 1)[k - 1]
                fits, limit = scores <= kth, min(limit, kth)  # all ties stay
                places, scores = places[fits], scores[fits]
    return places, scores


def nearest(df: DataFrame, k: int = 10, every: int = 100, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found of every row whose id is divisible by every,
    among all other rows; all candidates if fewer. Rows with the query's own id are no candidates.

    Vectors null, empty, zero or with null or non-finite components take no part, nor does a null id; a table without
    usable vectors gives an empty result. Equal distances go to the smaller id, so copies of one vector are ranked alike
    everywhere. Other columns are ignored, and so, with a warning, are vectors of another dimension than most have.
    """
    rows, n, dim = vectors.usable(df, id_, vector)
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(fit(rows, n, dim, k))

    def assign(batches):
        index = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), vectors.matrix(batch.column(1))
            if len(ids):
                near = index.distances(x, index.centroids).argmin(1)
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                salt = (mixed % index.salts[near].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(salt), *batch.columns], ["list", "salt", "vec_id", "embedding"])

    def probe(batches):
        index = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), vectors.matrix(batch.column(1))
            for a in range(0, len(ids), 256):
                own, q = ids[a : a + 256], x[a : a + 256]
                lists = index.distances(q, index.centroids).argsort(1, kind="stable")
                own_row = own[:, None] == index.sample_ids
                member = np.zeros((len(q), len(index.centroids)), np.int64)  # of the sample, without the query itself
                for j, hit in enumerate(~own_row):
                    member[j] = np.bincount(index.near[hit], minlength=member.shape[1])
                enough = (np.take_along_axis(member, lists, 1).cumsum(1) < k).sum(1) + 1
                count = np.minimum(np.maximum(index.probes, enough), lists.shape[1])
                place = lists.argsort(1)
                seen = index.distances(q, index.sample)
                seen[own_row | (place[:, index.near] >= count[:, None])] = np.inf
                kth = np.partition(seen, k - 1, 1)[:, k - 1] if seen.shape[1] >= k else np.full(len(q), np.inf)
                limit = np.sqrt(kth) * (1 + 1e-6) + 1e-6
                probed = np.arange(lists.shape[1]) < count[:, None]
                at, lists = np.nonzero(probed)[0], lists[probed]
                salts = index.salts[lists]  # a crowded list is searched in as many places as it is spread over
                at, lists, salt = np.repeat(at, salts), np.repeat(lists, salts), np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(own[at]), batch.column(1).slice(a, 256).take(pa.array(at)), pa.array(limit[at])], ["list", "salt", "vec_id", "embedding", "limit"])

    kind = rows.schema["embedding"].dataType.simpleString()
    stored = vectors.gathered(rows.mapInArrow(assign, f"list int, salt int, vec_id long, embedding {kind}"), ["list", "salt"], vectors.BLOCK)
    probing = vectors.queries(rows, every).mapInArrow(probe, f"list int, salt int, vec_id long, embedding {kind}, limit double")
    asked = vectors.gathered(probing, ["list", "salt"], vectors.QUERY_BLOCK, "limit").select("list", "salt", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("extra").alias("q_limit"))

    def search(batches):
        index = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, data, q_ids, q_data, limits = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("ids", "i8"), ("data", "f8"), ("q_ids", "i8"), ("q_data", "f8"), ("q_limit", "f8")))
                block, asks = data.reshape(-1, dim), q_data.reshape(-1, dim)
                block_turned, turned = block @ index.rotation, asks @ index.rotation
                known, out = np.flatnonzero(np.isin(ids, index.sample_ids)), []
                seen = index.distances(asks, block[known])
                for j, own in enumerate(q_ids):
                    stays = np.zeros(len(ids), bool)
                    stays[known[seen[j] <= limits[j] ** 2]] = True  # of the sample, the k nearest
                    at, score = scan(asks[j], turned[j], limits[j], k, block, block_turned, ids != own, stays)
                    order = np.lexsort((ids[at], score))[:k]
                    out.append((np.full(len(order), own), ids[at[order]], score[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

    # queries grow with the table, so they are never broadcast
    met = stored.select("list", "salt", "ids", "data").join(asked.hint("merge"), ["list", "salt"])
    return vectors.best(met.mapInArrow(search, "query_id long, vec_id long, score double"), k, False, "double")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
