"""Whitening of embeddings along their principal axes, by Chebyshev-filtered subspace iteration.

A block of WIDER columns more than components are wanted is multiplied by the covariance again and again. One product is one pass
over the vectors: every task centres its rows, multiplies them with the block and their transpose with that, and the tasks'
sums are added in two steps, in order, so that only a few matrices of dimension times block width reach the driver. The
covariance itself is never formed.

A three-term Chebyshev recurrence of such products damps the part of the spectrum that is not wanted: all between its lower end, for
which a Lanczos vector that rides along in the same passes gives an estimate, and the block's smallest Ritz value. Its degree is
held so low that the block keeps its weakest directions. QR and Rayleigh-Ritz follow on the driver, whose product opens the
next recurrence. The iteration ends when the residuals certify every wanted pair and get no smaller; a block that is not
certified after some rounds is widened, at last to the whole space, where Rayleigh-Ritz is exact.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vaultspark.llm.common import stored, table
from vaultspark.llm.vectors import finite

COMPONENTS, WIDER, SEED = 32, 16, 11
#: An entry c becomes floor(SCALE * c) + SHIFT; beyond LARGEST, either way, it is held there.
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 1 << 52
#: Bytes of a block of vectors, as doubles.
BLOCK_BYTES = 1 << 22
#: A pair is certified by a residual of TOLERANCE times its value, or LEAST times the largest one.
TOLERANCE, LEAST = 1e-12, 1e-14
#: Degrees of one recurrence at most; how far apart, as a logarithm, it may pull the block; rounds before the block is widened.
DEGREE, PULL, ROUNDS = 12, 18.0, 16
#: Lanczos steps, and how many before an estimate; groups that the tasks' sums are added in; components below this share of the largest value are none.
STEPS, FIRST, GROUPS, NOTHING = 24, 6, 8, 1e-11


@dataclass
class Whitening:
    """What is fitted: n rows with sums (exact), variances (falling) and axes (columns), the trace of the covariance, passes over the
    vectors and the largest residual over the largest variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    passes: int
    residual: float


def blocked(df: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """Blocks (ids, data) of the usable rows, and their dimension. A row with a null vector, a null or non-finite entry or none at all
    is left out, as are vectors of another dimension than the most frequent (the smaller at a tie), of which a warning
    tells the number. Rows without id take part."""
    rows = df.filter(finite(vector)).select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("dim")).alias("dim"))).alias("most")).first()
    dim = -found["most"]["dim"] if found["most"] else 0
    if dim and found["all"] > found["most"]["n"]:
        warnings.warn(f"{found['all'] - found['most']['n']} vectors don't have the {dim} dimensions of most and take no part", stacklevel=2)
    kind = np.float64 if isinstance(df.schema[vector].dataType.elementType, DoubleType) else np.float32
    most = max(1, BLOCK_BYTES // (8 * max(1, dim)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                data = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["ids", "data"])

    packed = rows.filter(F.size("vector") == dim).withColumn("vector", F.col("vector").cast("array<double>" if kind is np.float64 else "array<float>"))
    return stored(packed.mapInArrow(run, "ids array<long>, data binary").withColumn("wide", F.lit(kind is np.float64)), "whitening"), dim


def _scaled(block: dict, dim: int) -> np.ndarray:
    x = np.frombuffer(block["data"], np.float64 if block["wide"] else np.float32).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _summed(blocks: DataFrame, of, size: int, dtype=np.float64) -> np.ndarray:
    """The sum over all blocks of an array of `size` entries that of(block) gives. One array a task, added in GROUPS groups in order of
    the tasks, so that a rerun adds in the same order."""
    kind = np.dtype(dtype)

    def part(batches):
        total = np.zeros(size, kind)
        for batch in batches:
            for block in batch.to_pylist():
                total += of(block)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "data"])

    def add(batches):
        total, first = np.zeros(size, kind), None
        for batch in batches:
            for row in batch.to_pylist():
                first = row["task"] if first is None else first
                total += np.frombuffer(row["data"], kind)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "data"])

    schema = "task int, data binary"
    parts = blocks.mapInArrow(part, schema).repartition(GROUPS, "task").sortWithinPartitions("task").mapInArrow(add, schema)
    rows = sorted(parts.collect(), key=lambda r: r["task"])  # GROUPS arrays, whatever the number of rows
    return np.sum([np.frombuffer(r["data"], kind) for r in rows], 0) if rows else np.zeros(size, kind)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers, and the rest that is left of the sums: small numbers, so centring loses no digits."""
    whole = [round(s / n) if abs(s) < 1 << 50 else (2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([s - n * w for s, w in zip(sums, whole)], np.int64)


def _centred(block: dict, dim: int, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (_scaled(block, dim) - whole).astype(np.float64) - rest / n


class _Lanczos:
    """The lower end of a spectrum, estimated from products with one vector at a time, which ride along in passes made for others:
    the smallest Ritz value less its residual, from FIRST steps on. Too high an estimate costs passes, not results."""

    def __init__(self, dim: int, rng):
        v = rng.standard_normal(dim)
        self.basis, self.diagonal, self.beside, self.low = [v / np.linalg.norm(v)], [], [], 0.0

    @property
    def going(self) -> bool:
        return len(self.diagonal) < min(STEPS, len(self.basis[0]))

    def take(self, product: np.ndarray) -> None:
        """The product with the last vector; the next one and the estimate follow."""
        v = self.basis[-1]
        self.diagonal.append(float(v @ product))
        left = product
        for _ in range(2):
            for u in self.basis:
                left = left - (u @ left) * u
        norm = float(np.linalg.norm(left))
        small = np.diag(self.diagonal) + np.diag(self.beside, 1) + np.diag(self.beside, -1)
        values, vectors = np.linalg.eigh(small)
        if len(self.diagonal) >= FIRST:
            self.low = max(float(values[0] - norm * abs(vectors[-1, 0])), 0.0)
        if norm <= 1e-13 * max(abs(values[-1]), 1e-300):
            self.basis.append(np.zeros_like(v))  # an invariant space: nothing more to learn
            self.diagonal += [self.diagonal[-1]] * STEPS
            return
        self.beside.append(norm)
        self.basis.append(left / norm)


def fit(blocks: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The axes of greatest variance of the blocks' scaled rows, as many as components asks for and there are; None of no rows.

    Axes whose variance is below NOTHING times the largest are left out, since there is nothing to divide by. Each axis has its
    largest entry (the first of them) positive. Equal variances leave the choice of axes among them open.
    """

    def counted(block):
        x = _scaled(block, dim)
        return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    count = _summed(blocks, counted, 1 + 2 * dim, np.int64)
    n = int(count[0])
    if not n:
        return None
    sums = [(int(h) << 32) + int(w) for h, w in zip(count[1 : dim + 1], count[dim + 1 :])]
    whole, rest = _centre(n, sums)
    passes = 0

    def times(block_of: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times a block of columns, and its trace."""
        nonlocal passes
        passes += 1
        width = block_of.shape[1]

        def product(block):
            y = _centred(block, dim, n, whole, rest)
            return np.concatenate([(y.T @ (y @ block_of)).ravel(), [(y * y).sum()]])

        total = _summed(blocks, product, dim * width + 1)
        return total[:-1].reshape(dim, width) / n, float(total[-1]) / n

    rng = np.random.default_rng(SEED)
    wanted, width = min(components, dim), min(dim, components + WIDER)
    lanczos = _Lanczos(dim, rng)

    def product(columns: np.ndarray) -> np.ndarray:
        if not lanczos.going:
            return times(columns)[0]
        both = times(np.column_stack([columns, lanczos.basis[-1]]))[0]
        lanczos.take(both[:, -1])
        return both[:, :-1]

    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    w, trace = times(q)
    before, rounds = np.inf, 0
    while True:
        small = q.T @ w
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = np.maximum(theta[::-1], 0.0), turn[:, ::-1]
        q, w = q @ turn, w @ turn
        left = np.linalg.norm(w - q * theta, axis=0)[:wanted]
        allowed = np.maximum(TOLERANCE * theta[:wanted], LEAST * theta[0])
        worst = float((left / np.maximum(allowed, 1e-300)).max(initial=0.0)) if theta[0] > 0 else 0.0
        if worst <= 1 and (width == dim or worst > before / 2 or worst < 1e-2):
            break
        before, rounds = worst, rounds + 1
        if rounds % ROUNDS == 0 and width < dim:
            more = rng.standard_normal((dim, min(dim, 2 * width) - width))
            q = np.linalg.qr(np.column_stack([q, more]))[0]
            width, w = q.shape[1], product(q)
            continue
        if width == dim:  # the whole space: only rounding is left, and another orthonormal basis takes it away
            if rounds > 4 * ROUNDS:
                raise RuntimeError(f"principal axes not certified: residual {left.max()} of {theta[0]}")
            q = np.linalg.qr(q)[0]
            w = product(q)
            continue
        # the filter: values between low and cut stay small, those above grow
        cut = float(theta[-1])
        low = min(lanczos.low, 0.999 * cut)
        half, middle = max((cut - low) / 2, 1e-12 * theta[0]), (cut + low) / 2
        reach = lambda value: float(np.arccosh(max(1.0, (value - middle) / half)))
        spread = reach(theta[0]) - reach(theta[wanted - 1])
        degree = int(np.clip(PULL / max(spread, 1e-9), 2, DEGREE))
        sigma = half / (theta[0] - middle) if theta[0] > middle else 1.0
        twice = 2 / sigma
        old, now = q, (w - middle * q) * (sigma / half)
        for _ in range(degree - 1):
            later = 1 / (twice - sigma)
            old, now = now, (product(now) - middle * now) * (2 * later / half) - (sigma * later) * old
            sigma = later
        q = np.linalg.qr(now)[0]
        w = product(q)
    kept = int((theta[:wanted] > NOTHING * theta[0]).sum()) if theta[0] > 0 else 0
    axes = q[:, :kept]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(kept)])
    return Whitening(n, sums, theta[:kept], axes, trace, passes, float(left.max(initial=0.0) / theta[0]) if theta[0] > 0 else 0.0)


def identity_error(blocks: DataFrame, dim: int, model: Whitening) -> float:
    """The largest entry, in size, of the whitened rows' covariance minus the identity, from one pass."""
    whole, rest = _centre(model.n, model.sums)
    turn, k, n = model.axes / np.sqrt(model.values), len(model.values), model.n

    def moments(block):
        z = _centred(block, dim, n, whole, rest) @ turn
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    total = _summed(blocks, moments, k + k * k) / n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whitened(blocks: DataFrame, dim: int, model: Whitening) -> DataFrame:
    """id, deviation (decimal: the sum over dimensions of (n * x - sum)^2, exact) and whitened (array of double, one entry a component) of each
    row of the blocks."""
    whole, rest = _centre(model.n, model.sums)
    turn, n = model.axes / np.sqrt(model.values), model.n

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                off = _scaled(block, dim) - whole
                z = (off.astype(np.float64) - rest / n) @ turn
                most = n * int(np.abs(off).max(initial=0)) + n
                if dim * most * most < 1 << 63:
                    deviation = pa.array(((n * off - rest) ** 2).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([sum((n * o - r) ** 2 for o, r in zip(row, rest.tolist())) for row in off.tolist()], pa.decimal128(38, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(block["ids"], pa.int64()), deviation, lists], ["id", "deviation", "whitened"])

    return blocks.mapInArrow(run, "id long, deviation decimal(38,0), whitened array<double>")


def whiten(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """id, deviation and whitened of df's usable rows, and what was fitted (None of no rows).

    Which rows are usable blocked() tells. Repeated rows count as often as they occur and each gets its values; other columns are
    ignored. An empty table, or one without usable rows, gives an empty result. Where all rows are equal there is no
    component, and whitened is an empty list.
    """
    blocks, dim = blocked(df, id_, vector)
    model = fit(blocks, dim, components)
    if model is None:
        return df.sparkSession.createDataFrame([], "id long, deviation decimal(38,0), whitened array<double>"), None
    return whitened(blocks, dim, model), model


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every usable vector; a deviation that no long can hold is null."""
    blocks, dim = blocked(table(spark, sf_dir, "embeddings"))
    model = fit(blocks, dim)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(blocks, dim, model)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    each = whitened(blocks, dim, model).select("id", "deviation", F.posexplode("whitened").alias("at", "z"))
    return each.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
                       F.col("z").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
