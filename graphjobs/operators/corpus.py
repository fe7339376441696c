"""Shards of documents, and what a corpus holds. docs: (title, content, idx), idx the global place from 0."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import render_passage


def shard_equal(docs: DataFrame, shards: int = 4) -> DataFrame:
    """Document k goes to shard k mod shards; a title that the shard already has gets " (k)"."""
    placed = docs.withColumn("shard", F.pmod("idx", F.lit(shards)).cast("int"))
    again = F.row_number().over(Window.partitionBy("shard", "title").orderBy("idx")) > 1
    return placed.withColumn("title", F.when(again, F.concat("title", F.lit(" ("), F.col("idx").cast("string"), F.lit(")"))).otherwise(F.col("title")))


def shard_ladder(docs: DataFrame, ladder: list | None = None, shards: int = 4, seed: int = 42) -> DataFrame:
    """Disjoint rungs of 16·4^j documents in a seeded order, the last takes the rest; or explicit sizes with "rest".

    The order is that of a hash of the title. Ranks come from counts by the hash's leading bits, so no task sorts all."""
    n = docs.count()
    sizes = list(ladder) if ladder else [16 * 4**j for j in range(shards - 1)] + ["rest"]
    fixed = sum(s for s in sizes if s != "rest")
    if fixed > n:
        raise ValueError(f"the rungs take {fixed} documents; there are {n}")
    keyed = docs.withColumn("_h", F.xxhash64("title", "idx", F.lit(seed))).withColumn("_cell", F.shiftrightunsigned("_h", 52))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "idx")) - 1
    ranked = keyed.join(F.broadcast(cells.drop("_n")), "_cell").withColumn("_place", place)  # at most 4,096 cells
    rung, upto = F.lit(len(sizes) - 1), 0
    bounds = []
    for s in sizes:
        upto += (n - fixed) if s == "rest" else s
        bounds.append(upto)
    for j in range(len(sizes) - 2, -1, -1):
        rung = F.when(F.col("_place") < bounds[j], j).otherwise(rung)
    return ranked.withColumn("shard", rung).drop("_h", "_cell", "_before", "_place")


def shard_balanced(docs: DataFrame, max_docs: int = 700) -> DataFrame:
    """Contiguous chunks of equal size, none above max_docs; of equal titles in a shard the last stays."""
    n = docs.count()
    per = math.ceil(n / max(1, math.ceil(n / max_docs))) if n else 1
    placed = docs.withColumn("shard", F.floor(F.col("idx") / per).cast("int"))
    rest = [c for c in placed.columns if c not in ("shard", "title")]
    last = placed.groupBy("shard", "title").agg(F.max_by(F.struct(*rest), "idx").alias("r"))
    return last.select("shard", "title", "r.*").select(*placed.columns)


def corpus_accounting(register: DataFrame) -> DataFrame:
    """(rows, docs, skipped)"""
    docs = render_passage(register).select(F.lit(1).alias("d"), F.lit(0).alias("r"))
    both = docs.union(register.select(F.lit(0), F.lit(1)))
    got = both.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("rows"), F.coalesce(F.sum("d"), F.lit(0)).alias("docs"))
    return got.withColumn("skipped", F.col("rows") - F.col("docs"))


def pending_passages(docs: DataFrame, done: DataFrame) -> DataFrame:
    """docs whose passage has no result; passages meet by hash and text."""
    seen = done.select(F.xxhash64("passage").alias("_h"), "passage").distinct()
    return docs.withColumn("_h", F.xxhash64("passage")).join(seen, ["_h", "passage"], "left_anti").select(*docs.columns)
