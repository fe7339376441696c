"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Vectors that are alike bit for bit make one class. A class vector is rotated (three rounds of random signs and a Hadamard
transform) and hashed to the nearest signed axis; ``hashes`` such values name its bucket in each of ``tables`` tables.
Multiprobe: it also goes to the buckets where its least certain value is replaced by the next nearest axis. The vectors of
a bucket are compared by a matrix product in double precision, and pairs that meet in several buckets are counted in the
least of them, which both sides tell from the hashes they carry. A task reads its buckets one after the other and gives back
link counts and a forest, not pairs.

A bucket over ``BLOCK`` vectors is cut into blocks and each two blocks meet in a group of their own, so no task grows with
the bucket and nothing is dropped. Buckets with the same members are compared once. More values are combined as the number of vectors grows, so buckets stay small where
vectors aren't alike. Recall is measured against brute force in the tests.

Defined cases: a vector that is null, zero or empty, or holds null or non-finite components links with nothing; so do rows
without id. Vectors of each length are hashed and compared among themselves. Repeated rows count as other vectors. Other
columns are ignored. No vectors give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import afresh, columns, connected_components, local_roots, stage

COSINE, TABLES, PROBES, BLOCK = 0.95, 8, 3, 2048
#: Pairs that a task holds before it counts them.
PAIRS = 200_000


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 5) -> np.ndarray:
    """The buckets of each row, as (rows, tables, probes) of numbers; the same for a row whatever rows stand beside it."""
    n, dim = len(x), 1 << max(2, (x.shape[1] - 1).bit_length())  # at least as many axes as probes
    rng, padded = np.random.default_rng(seed), np.zeros((n, dim))
    padded[:, : x.shape[1]] = x
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        code, second, gap = np.zeros((n, hashes), np.int64), np.zeros((n, hashes, probes), np.int64), np.zeros((n, hashes, probes))
        for h in range(hashes):
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], dim))
            axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
            value = np.take_along_axis(y, axes, axis=1)
            named = 2 * axes + (value < 0)
            code[:, h], second[:, h], gap[:, h] = named[:, 0], named, np.abs(value[:, :1]) - np.abs(value)
        weights = (2 * dim) ** np.arange(hashes, dtype=np.int64)
        home = code @ weights
        out[:, t, 0] = home
        # the changes that cost least, over all values and next axes
        change = (second[:, :, 1:] - code[:, :, None]) * weights[None, :, None]
        cost = gap[:, :, 1:].reshape(n, -1)
        cheapest = np.argsort(cost, axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 1:] = home[:, None] + np.take_along_axis(change.reshape(n, -1), cheapest, axis=1)
    return out


class _Links:
    """Link counts and a forest over the rows of some whole buckets; pairs are forgotten once counted."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, sizes: np.ndarray, cosine: float):
        self.x, self.codes, self.sizes, self.cosine = x, codes, sizes, cosine
        self.links, self.root = np.zeros(len(x), np.int64), np.arange(len(x))
        self.pairs, self.held = [], 0

    def compare(self, left: np.ndarray, right: np.ndarray, same: bool, table: int, bucket: int) -> None:
        """Every left row with every right one; with the later ones of its own block where both sides are ``same``."""
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            i, j = np.nonzero(self.x[rows] @ self.x[right].T >= self.cosine)
            i, j = rows[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                self.pairs.append((i, j, np.full(len(i), table), np.full(len(i), bucket)))
                self.held += len(i)
            if self.held > PAIRS:
                self.count()

    def count(self) -> None:
        """Count the pairs whose bucket is the least that both rows are in."""
        if not self.pairs:
            return
        i, j, table, bucket = (np.concatenate(p) for p in zip(*self.pairs, strict=True))
        self.pairs, self.held = [], 0
        for t in range(int(table.max()) + 1):
            a, b = self.codes[i, t], self.codes[j, t]
            met = a[:, :, None] == b[:, None, :]
            met &= ((t < table)[:, None] | ((t == table)[:, None] & (a < bucket[:, None])))[:, :, None]
            mine = ~met.any(axis=(1, 2))
            i, j, table, bucket = i[mine], j[mine], table[mine], bucket[mine]
        np.add.at(self.links, i, self.sizes[j])
        np.add.at(self.links, j, self.sizes[i])
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        self.root = local_roots(np.concatenate((i, at)), np.concatenate((j, self.root[at])), len(self.root))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, hash, v) and classes (key, hash, v, n, least) of sound vectors that are alike bit for bit; both staged.

    key: a number of the class's own. Two classes may share a hash, so a row finds its class by the vector where they do."""
    vec_id, own = columns(vectors, "vec_id", "embedding")
    kind = "array<float>" if dict(vectors.dtypes).get("embedding") == "array<float>" else "array<double>"
    rows = vectors.select(vec_id.cast("long").alias("vec_id"), own.cast(kind).alias("v"))
    sound = F.col("vec_id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound &= F.exists("v", lambda c: c != 0)
    rows = stage(rows.withColumn("hash", F.when(sound, F.xxhash64("v"))), "vectors")
    classes = rows.where("hash is not null").groupBy("hash", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return rows, stage(classes.withColumn("key", F.monotonically_increasing_id()), "classes")


def _groups(met: DataFrame) -> DataFrame:
    """(d, t, bucket, lo, hi, own, key): the members of each bucket with more than one, by pairs of blocks.

    Buckets with the same members need comparing once: of those with the same count and sums of hashes the least stays."""
    name = ["d", "t", "bucket"]
    held = met.groupBy(*name).agg(F.count("*").alias("held"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(2))).alias("y"))
    least = held.where("held > 1").groupBy("held", "x", "y").agg(F.min(F.struct(*name)).alias("b"))
    full = least.select("b.d", "b.t", afresh(F.col("b.bucket")).alias("bucket"), F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    within = met.join(full, name).withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = within.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*name, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    rows, classes = _classes(vectors)
    count = max(2, classes.count())

    def unit(vs) -> np.ndarray:
        x = np.stack(vs.to_numpy()).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # neither squares nor sums leave the range
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def hashes(d: int) -> int:
        """How many values name a bucket of vectors of this length: as many as make a million buckets, three at most unless
        there are very many vectors, so that vectors which aren't alike seldom meet."""
        bits = 1 + max(2, (d - 1).bit_length())
        return max(min(3, math.ceil(20 / bits)), math.ceil(math.log2(count / 512) / bits))

    def hashed(pdfs):
        for pdf in pdfs:
            for d, some in pdf.groupby(pdf["v"].str.len()):
                codes = buckets(unit(some["v"]), tables, hashes(d), probes)
                yield some.assign(d=d, codes=list(codes.reshape(len(some), -1)))

    kind = dict(classes.dtypes)["v"]
    coded = stage(classes.select("key", "v", "n").mapInPandas(hashed, f"key long, v {kind}, n long, d int, codes array<long>"), "buckets")
    met = coded.select("key", "d", F.posexplode("codes").alias("slot", "bucket")).select("key", "d", F.expr(f"slot div {probes}").cast("int").alias("t"), "bucket")
    group = ["d", "t", "bucket", "lo", "hi"]
    # each group, of two blocks at most, lies in one partition and its rows follow one another
    laid = _groups(met).join(coded.drop("d"), "key").repartition(*group).sortWithinPartitions(*group)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links within the groups that pdf holds whole; all of vectors of one length."""
        codes = np.stack(pdf["codes"].to_numpy()).reshape(len(pdf), tables, probes)
        found = _Links(unit(pdf["v"]), codes, pdf["n"].to_numpy().astype(np.int64), cosine)
        names, side = pdf[group].to_numpy().astype(np.int64), pdf["own"].to_numpy()
        ends = np.flatnonzero(np.append((names[1:] != names[:-1]).any(axis=1), True)) + 1
        for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            _, t, bucket, lo, hi = names[s].tolist()
            if e - s > 1:
                at = np.arange(s, e)
                left = at if lo == hi else at[side[s:e] == lo]
                found.compare(left, at if lo == hi else at[side[s:e] == hi], lo == hi, t, bucket)
        found.count()
        ids, at = pdf["key"].to_numpy().astype(np.int64), np.flatnonzero(found.links)
        return pd.DataFrame({"key": ids[at], "links": found.links[at], "root": ids[found.root[at]]})

    def compare(pdfs):
        held = None
        for pdf in pdfs:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
            names = pdf[group].to_numpy().astype(np.int64)
            last = int((names != names[-1]).any(axis=1).sum())  # the last group may go on
            held = pdf.iloc[last:]
            for _, some in pdf.iloc[:last].groupby("d"):
                yield compared(some)
        if held is not None:
            yield compared(held)

    found = stage(laid.mapInPandas(compare, "key long, links long, root long"), "links", coded)
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    each = classes.select("key", "n", "least").join(counted, "key", "left").join(roots, "key", "left")
    each = stage(each.select("key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root")), "named")
    named = each.groupBy("root").agg(F.min("least").alias("component")).select(afresh(F.col("root")).alias("root"), "component")
    final = stage(each.join(named, "root").select("key", (F.col("links") + F.col("n") - 1).alias("links"), "component"), "final", each, found)
    # a hash that one class has needs no vector to tell it
    alone = classes.groupBy("hash").agg(F.count("*").alias("k"), F.min("key").alias("one"))
    twins = classes.join(alone.where("k > 1").select("hash"), "hash", "left_semi").select("hash", F.col("v").alias("w"), F.col("key").alias("of"))
    by_hash = alone.where("k = 1").select("hash", F.col("one").alias("key"))
    simple = rows.select("vec_id", "hash").join(by_hash, "hash", "left").select("vec_id", "hash", "key")
    if twins.head(1):
        met_twin = rows.join(twins, "hash").where(F.col("v") == F.col("w")).select("vec_id", "hash", "of")
        simple = simple.join(twins.select("hash").distinct(), "hash", "left_anti").select("vec_id", "hash", "key").union(met_twin)
    component = F.coalesce("component", "vec_id")
    return simple.select("vec_id", "key").join(final, "key", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )


#: All pairs, by brute force: for small tables.
ORACLE_SQL = f"""
WITH RECURSIVE units AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM units UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT u.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = u.vec_id) AS n_links, l.component_id, u.vec_id = l.component_id AS kept
FROM units u JOIN least l ON l.a = u.vec_id"""
