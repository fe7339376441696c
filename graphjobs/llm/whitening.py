"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

A vector's entries c become whole numbers x = floor(256 c); the fit list holds each distinct x once. Sums are taken exactly,
the scatter over x less its mean, a partial one a partition, added by rows of the matrix. Only numbers of the model pass
the driver: d sums and the d x d matrix. Its pivoted Cholesky factor L (A = L L') has its columns rotated in pairs until they
are orthogonal: their squared norms are the eigenvalues of A and the normalised columns its unit eigenvectors.

Defined cases: a row whose vector is null or holds null or non-finite entries is left out. Vectors shorter than the longest
count as zero beyond their end; empty ones count as zero, and have no components where all are empty. Directions without
variance (an eigenvalue below ``d`` rounding errors of the largest) are no components, so a table with one distinct vector
gives no rows. Repeated rows and ids are rows of their own; a null id stays null. A deviation beyond 64 bits is null. Other
columns are ignored. No vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, stage, unstage

COMPONENTS, SCALE = 4, 256
#: Rows of a block that is multiplied at once.
BLOCK = 4096


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = a, for a symmetric matrix without negative eigenvalues; as many columns as pivots above rounding.

    The largest remaining diagonal entry is the next pivot. Rows keep a's order, so L is triangular up to that order."""
    d = len(a)
    left, rows = np.diag(a).astype(np.float64).copy(), []
    least = d * np.finfo(np.float64).eps * max(left.max(initial=0.0), 0.0)
    for _ in range(d):
        p = int(left.argmax())
        if left[p] <= least:
            break
        done = np.stack(rows) if rows else np.zeros((0, d))
        row = (a[p] - done[:, p] @ done) / np.sqrt(left[p])
        rows.append(row)
        left -= row * row
        left[p] = 0.0
    return np.stack(rows, axis=1) if rows else np.zeros((d, 0))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of factor factor', by rotating pairs of columns until all are
    orthogonal to rounding."""
    u = np.array(factor.T, np.float64)  # a column of the factor in each row
    k = len(u)
    for _ in range(sweeps):
        still = True
        for i in range(k - 1):
            for j in range(i + 1, k):
                a, b, c = u[i] @ u[i], u[j] @ u[j], u[i] @ u[j]
                if c * c <= (np.finfo(np.float64).eps ** 2) * a * b:
                    continue
                still = False
                half = (b - a) / (2 * c)
                tan = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(1.0, half))
                cos = 1 / np.hypot(1.0, tan)
                sin = cos * tan
                u[i], u[j] = cos * u[i] - sin * u[j], sin * u[i] + cos * u[j]
        if still:
            break
    values = np.einsum("ij,ij->i", u, u)
    order = np.argsort(-values, kind="stable")
    values, u = values[order], u[order]
    held = values > len(factor) * np.finfo(np.float64).eps * max(values.max(initial=0.0), 0.0)
    return values[held], (u[held] / np.sqrt(values[held])[:, None]).T


def _whole(own: pd.Series, d: int) -> np.ndarray:
    """x of each row, shorter ones with zeros behind."""
    out = np.zeros((len(own), d), np.int64)
    for at, x in enumerate(own):
        out[at, : len(x)] = x
    return out


def _fits(x: np.ndarray, times: int, power: int = 1) -> bool:
    """Whether times |x|^power stays in 64 bits."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return times * top**power < 2**63


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and S, exactly: a partial sum a partition as text, since it may pass 64 bits."""

    def partial(pdfs):
        n, total = 0, [0] * d
        for pdf in pdfs:
            x = _whole(pdf["x"], d)
            each = x.sum(axis=0) if _fits(x, max(1, len(x))) else x.astype(object).sum(axis=0)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, each, strict=True)]
        if n:
            yield pd.DataFrame({"n": [n], "s": [[str(t) for t in total]]})

    parts = fit.mapInPandas(partial, "n long, s array<string>")
    cells = parts.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    held = {r.i: (int(r.s), r.n) for r in cells.collect()}
    return (held[0][1] if held else 0), [held[i][0] for i in range(d)] if held else [0] * d


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - S/n: the whole part is taken off exactly, then the fraction."""
    whole, rest = np.array([v // n for v in s], np.int64), np.array([(v % n) / n for v in s])
    return (x - whole).astype(np.float64) - rest


def _scatter(fit: DataFrame, d: int, n: int, s: list[int]) -> np.ndarray:
    """Sum over the fit list of (x - S/n)(x - S/n)', partial a partition, rows of the matrix added apart."""

    def partial(pdfs):
        total, seen = np.zeros((d, d)), False
        for pdf in pdfs:
            for at in range(0, len(pdf), BLOCK):
                y = centred(_whole(pdf["x"].iloc[at : at + BLOCK], d), n, s)
                total, seen = total + y.T @ y, True
        if seen:
            yield pd.DataFrame({"i": np.arange(d), "part": TaskContext.get().partitionId(), "row": list(total)})

    def add(pdf):
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf.sort_values("part")["row"].to_numpy()), axis=0)]})

    rows = fit.mapInPandas(partial, "i int, part int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>")
    return np.stack([np.array(r.row) for r in sorted(rows.collect())])


def _identity_error(fit: DataFrame, d: int, n: int, s: list[int], turn: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance less the identity: partitions' centred sums, merged."""
    k = turn.shape[1]

    def partial(pdfs):
        held = [centred(_whole(pdf["x"].iloc[at : at + BLOCK], d), n, s) @ turn for pdf in pdfs for at in range(0, len(pdf), BLOCK)]
        if held:
            w = np.concatenate(held)
            mean = w.mean(axis=0)
            yield pd.DataFrame({"m": [len(w)], "mean": [mean], "c": [((w - mean).T @ (w - mean)).ravel()]})

    m, mean, c = 0, np.zeros(k), np.zeros((k, k))
    for r in fit.mapInPandas(partial, "m long, mean array<double>, c array<double>").toLocalIterator():
        off = np.array(r["mean"]) - mean
        c = c + np.array(r["c"]).reshape(k, k) + np.outer(off, off) * (m * r["m"] / (m + r["m"]))
        m, mean = m + r["m"], mean + off * (r["m"] / (m + r["m"]))
    return float(np.abs(c / m - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each sound row of vectors and component."""
    vec_id, own = columns(vectors, id_col, vector_col)
    sound = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = vectors.select(vec_id.cast("long").alias("vec_id"), own.cast("array<double>").alias("v")).where(sound)
    rows = stage(given.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x")), "vectors")
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    fit = stage(rows.select(padded.alias("x")).distinct(), "fit")
    n, s = _sums(fit, d)
    covariance = _scatter(fit, d, n, s) / n if n and d else np.zeros((d, d))
    values, axes = jacobi(pivoted_cholesky(covariance))
    k = min(components, len(values))
    if not k:
        unstage(fit)
        return rows.sparkSession.createDataFrame([], kind)
    turn = axes[:, :k] / np.sqrt(values[:k])
    error = _identity_error(fit, d, n, s, turn)
    unstage(fit)
    explained = values[:k] / np.trace(covariance)

    def project(pdfs):
        for pdf in pdfs:
            for at in range(0, len(pdf), BLOCK):
                some = pdf.iloc[at : at + BLOCK]
                x = _whole(some["x"], d)
                w = centred(x, n, s) @ turn
                off = x.astype(object) * n - np.array(s, object)
                if _fits(off, 2 * d, 2):
                    small = off.astype(np.int64)
                    deviation = (small * small).sum(axis=1).tolist()
                else:
                    deviation = [t if t < 2**63 else None for t in (off * off).sum(axis=1).tolist()]
                yield pd.DataFrame({
                    "vec_id": np.repeat(some["vec_id"].astype("Int64").to_numpy(dtype=object), k), "component": np.tile(np.arange(1, k + 1), len(some)), "n": n,
                    "deviation": pd.array(np.repeat(np.array(deviation, object), k), dtype="Int64"), "whitened": w.ravel(),
                    "explained": np.tile(explained, len(some)), "identity_error": error,
                })

    return rows.mapInPandas(project, kind)
