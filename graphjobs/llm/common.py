"""What several operators of this subpackage share: staged tables, components, ranks."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are long, so few of them make an Arrow batch; a Python worker holds one batch at a time.
BATCH_ROWS = 256
#: Whether Spark deletes a query's shuffle files once it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text in a batch; cut into words it takes about ten times as much.
BATCH_BYTES = "8m"


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a folder of this machine
    serves a local session; on a cluster executors wouldn't see it, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master: {master})")
    return _own_dir()


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch of whole texts; a lower number of rows or a set number of bytes stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_open = threading.local()


@contextlib.contextmanager
def recorded() -> Iterator[dict[str, DataFrame]]:
    """Path → table of what this thread stages in the block and doesn't delete."""
    made: dict[str, DataFrame] = {}
    _open.blocks = [*getattr(_open, "blocks", []), made]
    try:
        yield made
    finally:
        _open.blocks = _open.blocks[:-1]


def stage(df: DataFrame, label: str, *spent: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it.
    spent: staged tables that nothing reads after this one; they are deleted."""
    path, spark = new_folder(df.sparkSession, label), df.sparkSession
    # nothing but this write reads its shuffles, so their files go with it and don't add up over a job's stages
    held = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, held)
    for gone in spent:
        unstage(gone)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for made in getattr(_open, "blocks", ()):
        made[path] = out
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    for made in getattr(_open, "blocks", ()):
        made.pop(df._staged_at, None)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its columns are called."""
    name, held = f"_{name}", {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, label: str = "rows") -> tuple[DataFrame, str]:
    """df, staged, with a number for each row, and that column's name. Staging fixes the numbers."""
    name = own_name(df, "row")
    return stage(df.withColumn(name, F.monotonically_increasing_id()), label), name


def columns(df: DataFrame, *names: str) -> list[Column]:
    """The named columns; those that df lacks are null."""
    return [df[n] if n in df.columns else F.lit(None).alias(n) for n in names]


def afresh(key: Column) -> Column:
    """The same number under an expression of its own. An aggregate joined on it is dealt again, and only a join
    with two plain exchanges below it can have its large partitions split at run time."""
    return key + F.lit(0).cast("long")


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One pass over edges (u > v): the neighbours of each node move to the smallest of them."""
    near = edges.union(edges.select("v", "u")) if both_ways else edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(afresh(F.col("u")).alias("k"), F.least("u", "m").alias("m"))
    met = near.join(low, near.u == low.k)
    if both_ways:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pair = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        moved = met.select(pair).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b: long) that isn't the smallest of its component.

    Large-star and small-star passes alternate until nothing changes. A pass costs aggregates and joins on the edges
    alone and is staged; a node with very many edges is aggregated before the shuffle, and its join partition splits.
    """
    first = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, mark = stage(first, "components"), None
    while True:
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor("v")).first()
        if now == mark or now[0] == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, last = now, cur
        cur = stage(_star(_star(cur, True), False), "components")
        unstage(last)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of 0..n-1 reaches by the edges a-b; within one task's block."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def ranked(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """df with ``rank``, from 1 within each value of the non-null column ``by``, by ``order``; staged.

    The rows are dealt by range over (by, order), numbered within their partition, and each partition adds the rows
    before it: no task holds a whole group, however large.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    laid = stage(laid.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))  # df is a table of our own
    seen = laid.groupBy("_part", by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = seen.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    base = base.select("_part", F.col(by), "_first", "_before")
    out = laid.join(base, ["_part", by])
    rank = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return out.select(*[c for c in df.columns], rank.alias("rank"))


def kth_largest(df: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counting: each round splits the range that holds it in 4096."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k < 1:
        return None
    if k >= n:
        return lo
    while lo < hi:
        width = (hi - lo) // 4096 + 1
        cell = F.expr(f"({col} - {lo}L) div {width}L").alias("cell")
        held = df.where(F.col(col).between(lo, hi)).groupBy(cell).count().collect()
        for cell, count in sorted(((r[0], r[1]) for r in held), reverse=True):
            if k <= count:
                lo, hi = lo + cell * width, min(hi, lo + (cell + 1) * width - 1)
                break
            k -= count
    return lo


def bits_of(rows: int, most: int) -> int:
    """Leading bits of a hash that deal this many rows into ranges of about ``most``."""
    return int(np.clip(np.ceil(np.log2(max(1, rows) / most)), 0, 30))


def dealt(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, start, end) of each hash range, by leading bits, that some sorted unsigned hashes fall in."""
    if not len(hashes):
        return []
    part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return list(zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True))
