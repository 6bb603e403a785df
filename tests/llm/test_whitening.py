"""Whitening against numpy's eigensolver, and odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm import bidiagonal, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x array<long>, n int"


def _plain(vectors, k=4):
    """(n, sums, eigenvalues, components, trace) of the distinct integer vectors."""
    x = np.unique(np.array(vectors), axis=0)
    n, s = len(x), x.sum(0)
    c = (x * n - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1][:k], u[:, ::-1][:, :k], float((c**2).sum() / n)


def _hold(got, rows, k=4):
    """rows: (vec_id, integer vector) of all that take part."""
    n, s, e, u, trace = _plain([x for _, x in rows], k)
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == k * len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = {}
    for i, x in rows:
        want = (np.array(x) - s / n) @ u / np.sqrt(np.maximum(e, 1e-300))
        for c in range(1, k + 1):
            r = by_id[i][c]
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
            assert math.isclose(r["explained"], e[c - 1] / trace, rel_tol=1e-9) and 0 <= r["identity_error"] < 1e-9
            if abs(want[c - 1]) > 1e-6:
                signs.setdefault(c, np.sign(r["whitened"] / want[c - 1]))
            assert abs(r["whitened"] * signs.get(c, 1) - want[c - 1]) < 1e-8
    return n


def test_query_equals_numpy_on_the_given_vectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r["vec_id"], [math.floor(256 * float(c)) for c in r["embedding"]]) for r in table if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    assert _hold(queries.op11_whitening(spark, sf).collect(), rows) > 100


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-900, 900, (300, 6)) / 256
    rows = [(i, [float(c) for c in x], [1], 7) for i, x in enumerate(v)] + [(1000 + i, [float(c) for c in v[5]], None, None) for i in range(200)]
    bad = [(5000, None, None, 0), (5001, [1.0, None, 1.0, 1.0, 1.0, 1.0], None, 0), (5002, [float("nan")] * 6, None, 0), (5003, [float("inf")] * 6, None, 0), (5004, [], None, 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(70)  # more parts than merge at once
    assert _hold(whitening.whiten(df).collect(), [(i, [math.floor(256 * c) for c in x]) for i, x, _, _ in rows]) == 300
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows[-200:], SCHEMA)).count() == 0  # one distinct vector
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0, 0.0], None, None) for i in range(9)] + [(None, [3.0, 6.0, 1.0, 0.0], None, None)], SCHEMA)
    got = whitening.whiten(flat).collect()
    assert len(got) == 10 and {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got) and sum(r["vec_id"] is None for r in got) == 1


def test_dimensions_apart_and_large_entries(spark):
    rows = [(i, [float(i % 5), float(i % 3)], None, None) for i in range(30)] + [(100 + i, [float(i), 1.0, float(i * i)], None, None) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    for pick in (lambda i: i < 100, lambda i: i >= 100):
        own = [(i, [math.floor(256 * c) for c in v]) for i, v, _, _ in rows if pick(i)]
        _hold([r for r in got if pick(r["vec_id"])], own)
    big = spark.createDataFrame([(i, [1e9 * i, 3.0 * i * i, 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    ints = [[math.floor(256 * c) for c in (1e9 * i, 3.0 * i * i, 1.0)] for i in range(50)]
    total = [sum(c) for c in zip(*ints, strict=True)]
    for r in whitening.whiten(big).filter("component = 1").collect():
        exact = sum((50 * a - b) ** 2 for a, b in zip(ints[r["vec_id"]], total, strict=True))
        assert r["deviation"] == (exact if exact < 2**63 else None) and r["identity_error"] < 1e-9
    assert whitening.whiten(big).filter(F.col("whitened").isNull()).isEmpty()


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "clustered", "low rank", "wide", "bidiagonal", "one"])
def test_solver_against_dense_svd(kind):
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.standard_normal((80, 24)))[0]
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    x = {
        "plain": rng.standard_normal((300, 24)), "graded": rng.standard_normal((300, 24)) * 0.5 ** np.arange(24), "equal": np.diag([3.0, 3, 3, 2, 2, 1]),
        "clustered": (q * np.where(np.arange(24) < 12, 5 + 1e-10 * np.arange(24), 1)) @ turn, "low rank": rng.standard_normal((50, 3)) @ rng.standard_normal((3, 24)),
        "wide": rng.standard_normal((4, 24)), "bidiagonal": np.diag(np.arange(1.0, 9)) + np.eye(8, k=1), "one": rng.standard_normal((9, 1)),
    }[kind]
    e, u = bidiagonal.principal(np.linalg.qr(x, mode="r"), x.shape[1])
    s = np.linalg.svd(x, compute_uv=False) ** 2
    assert len(e) == {"low rank": 3, "wide": 4}.get(kind, x.shape[1])
    assert np.allclose(e, s[: len(e)], rtol=1e-9) and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
    assert np.abs(x.T @ (x @ u) - u * e).max() < 1e-12 * s[0]
    assert bidiagonal.principal(np.zeros((3, 3)), 3)[0].size == 0
