"""Whitening against a dense eigensolver, with awkward rows and spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultspark.llm import whitening
from vaultspark.llm.queries import QUERIES


def scaled(vectors):
    return np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000


def dense(x):
    y = x - x.mean(0)
    values, axes = np.linalg.eigh(y.T @ y / len(y))
    return values[::-1], axes[:, ::-1], y


def frame(spark, x, kind="double"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>")


def test_query_agrees_with_a_dense_solver(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = scaled([r["embedding"] for r in table])
    values, axes, y = dense(x)
    got = QUERIES["op11_whitening"](spark, sf_dir).collect()
    assert len(got) == 32 * len(table)
    z = y @ axes[:, :32] / np.sqrt(values[:32])
    at = {r["vec_id"]: i for i, r in enumerate(table)}
    ours = np.zeros_like(z)
    sums = x.sum(0)
    deviation = ((len(x) * x - sums) ** 2).sum(1)
    for r in got:
        ours[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == len(x) and r["deviation"] == deviation[at[r["vec_id"]]] and r["identity_error"] < 1e-10
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-10
    sign = np.sign((ours * z).sum(0))
    assert np.abs(ours * sign - z).max() < 1e-8


@pytest.mark.parametrize("name", ["falling", "flat", "few rows", "few dimensions", "ties"])
def test_axes_of_other_spectra(spark, name):
    rng = np.random.default_rng(3)
    x = {
        "falling": rng.standard_normal((600, 80)) * np.logspace(3, -1, 80),
        "flat": rng.standard_normal((400, 70)),
        "few rows": rng.standard_normal((9, 60)) * 20,
        "few dimensions": rng.standard_normal((50, 3)) * [5, 2, 1],
        "ties": np.vstack([np.eye(60), -np.eye(60)]) * 4,
    }[name]
    blocks, dim = whitening.blocked(frame(spark, x))
    model = whitening.fit(blocks, dim)
    values, axes, _ = dense(scaled(x))
    k = {"few rows": 8, "few dimensions": 3}.get(name, 32)
    assert len(model.values) == k and np.abs(model.values / values[:k] - 1).max() < 1e-7
    assert model.residual < 1e-11 and whitening.identity_error(blocks, dim, model) < 1e-6
    assert abs(model.trace / values.sum() - 1) < 1e-10
    if name == "falling":
        assert np.abs(np.abs((model.axes * axes[:, :k]).sum(0)) - 1).max() < 1e-10


def test_awkward_rows(spark):
    """Unusable vectors are left out, repeated rows and null ids count, huge entries are held, other columns are ignored."""
    good = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [4.0, -1.0, 0.5]), (None, [0.0, 0.0, 0.0]), (3, [2.0, 2.0, -7.0])]
    odd = [(4, None), (5, []), (6, [1.0, None, 1.0]), (7, [float("nan")] * 3), (8, [float("inf"), 0.0, 0.0]), (9, [1.0, 2.0])]
    docs = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").select("*", *[F.lit("own").alias(c) for c in ("id", "vector", "ids", "data", "task", "whitened")])
    with pytest.warns(UserWarning, match="1 vectors"):
        rows, model = whitening.whiten(docs)
    x = scaled([v for _, v in good])
    assert model.n == 5 and model.sums == x.sum(0).tolist()
    got = sorted(((r["id"], int(r["deviation"]), len(r["whitened"])) for r in rows.collect()), key=str)
    assert got == sorted(((i, int(d), 3) for (i, _), d in zip(good, ((5 * x - x.sum(0)) ** 2).sum(1))), key=str)
    for none in (docs.limit(0), docs.filter("vec_id = 4"), docs.filter("vec_id = 5")):
        rows, model = whitening.whiten(none)
        assert model is None and rows.count() == 0
    rows, model = whitening.whiten(docs.filter("vec_id = 1"))
    assert len(model.values) == 0 and [(int(r["deviation"]), r["whitened"]) for r in rows.collect()] == [(0, [])] * 2
    huge, _ = whitening.whiten(frame(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 5.0]]))
    held = whitening.LARGEST
    x = [[held + 10**6, 10**6], [-held + 10**6, 64 + 10**6], [10**6, 320 + 10**6]]
    want = [sum((3 * a - s) ** 2 for a, s in zip(r, map(sum, zip(*x)))) for r in x]
    assert [int(r["deviation"]) for r in sorted(huge.collect(), key=lambda r: r["id"])] == want


def test_lanczos_finds_the_lower_end():
    rng = np.random.default_rng(4)
    for d in (1, 2, 8, 30):
        half = rng.standard_normal((d, 2 * d))
        matrix, lanczos = half @ half.T, whitening._Lanczos(d, rng)
        while lanczos.going:
            lanczos.take(matrix @ lanczos.basis[-1])
        assert lanczos.low <= np.linalg.eigvalsh(matrix)[0] * (1 + 1e-6)
        assert d != 30 or lanczos.low > 0
