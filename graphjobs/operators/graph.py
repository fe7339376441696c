"""A graph as three tables, and what orders them.

Order is data: nearly every rule keeps the first or the last row in file order, so tables carry shard_no and row_no.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("shard_no", "row_no")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    relations: DataFrame
    edges: DataFrame


def order_key(df: DataFrame) -> Column:
    held = [F.col(c) for c in ORDER if c in df.columns]
    return F.struct(*held) if held else F.lit(0)


def keep_first(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key in file order. One aggregate, combined before the shuffle: a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_key(df)).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank. Spark keeps k rows a partition before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("name"))


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoints-")


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine serves a local session only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master: {master})")
    return named or _own_dir()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share."""
    return f"{_shared(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: written to the shared folder and read back, so its size is known to what joins it."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a cut table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each end of links (a, b): the least node that it reaches.

    Each round a node takes the least root among its neighbours' and then its root's root; it ends when none changes."""
    both = cut(links.union(links.select("b", "a")).distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        met = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        up = met.select(F.col("node").alias("new"), F.col("new").alias("up"))
        moved = cut(met.join(up, "new").select("node", "root", F.least("new", "up").alias("new")))
        roots = moved.select("node", F.col("new").alias("root"))
        if not moved.where("new < root").head(1):
            return roots
