import math

import numpy as np
import pytest

from graphjobs.llm import whitening

KIND = "vec_id long, embedding array<float>, label int"


def check(rows, out, k=4):
    """out: result rows; against numpy over the distinct vectors."""
    sound = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-9 * values[0]).sum()))
    assert len(out) == k * len(sound)
    for j in range(k):
        mine = sorted((r for r in out if r.component == j + 1), key=lambda r: (r.vec_id, r.deviation, abs(r.whitened)))
        want = sorted(((i, sum((n * c - int(t)) ** 2 for c, t in zip(x, s, strict=True)), (np.array(x) - s / n) @ axes[:, j] / math.sqrt(values[j])) for i, x in sound), key=lambda t: (t[0], t[1], abs(t[2])))
        sign = np.sign(sum(r.whitened * t[2] for r, t in zip(mine, want, strict=True)))
        for r, (i, deviation, w) in zip(mine, want, strict=True):
            assert (r.vec_id, r.n, r.deviation) == (i, n, deviation)
            assert r.whitened == pytest.approx(sign * w, abs=1e-7)
            assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_random_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) @ np.diag([9, 5, 3, 2, 1, 1, 1, 0.5, 0.5, 0.1, 0.1, 0.1]) + 40
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900 + i, rows[0][1]) for i in range(500)]  # repeats weigh nothing
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 10), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12)]
    df = spark.createDataFrame([(*r, 0) for r in rows], KIND).repartition(7)
    check(rows, whitening.whiten(df).collect())


def test_few_directions_and_edge_cases(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    out = whitening.whiten(spark.createDataFrame([(*r, 0) for r in rows], KIND).selectExpr("*", "1 AS x", "2 AS n", "3 AS component")).collect()
    assert {r.component for r in out} == {1}
    check(rows, out)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame([(*r, 0) for r in rows], KIND)).collect() == []
    mixed = whitening.whiten(spark.createDataFrame([(1, [1.0], 0), (None, [1.0, 2.0], 0), (3, [], 0)], KIND)).collect()
    assert {r.vec_id for r in mixed} == {1, None, 3} and {r.n for r in mixed} == {3}
    big = whitening.whiten(spark.createDataFrame([(1, [1e15], 0), (2, [-1e15], 0)], KIND)).collect()
    assert [r.deviation for r in big] == [None, None]


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    b = rng.normal(size=(200, 20)) @ np.diag(np.geomspace(1e-3, 1e3, 20))
    a = b.T @ b
    factor = whitening.pivoted_cholesky(a)
    assert np.abs(factor @ factor.T - a).max() < 1e-12 * a.max()
    values, axes = whitening.jacobi(factor)
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ axes - axes * values).max() < 1e-12 * a.max()
