"""Shards by extendible hashing.

A directory is indexed by the leading bits of a document's hash. A bucket is a shard once it fits the byte limit; only one
that doesn't splits on another bit. The sizes of all buckets down to a depth come from one aggregate over leading bits,
of which each is rolled up to its ancestors; documents in buckets that are too large even there are summed again, deeper.

The hash covers the id and the text, so null or repeated ids spread. Defined cases: a null text has no bytes; a document
above the limit has a shard of its own that is marked ``oversize``, as have rows that are alike in id and text and
together above it, since no bit tells them apart. No documents give no shards. Rows keep no other column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, new_folder, own_name, stage

#: Bytes of text in a shard at most.
SHARD_BYTES = 16 << 20
BITS = 60
#: Bits beyond the expected depth that the first aggregate reaches, and each later one.
DEEPER = 5


def hashed(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, bits, n_bytes, shard, depth, shard_bytes, shard_docs, oversize) for each row.

    shard: the leading bits that its documents share, as 0s and 1s; the empty string if there is one shard only.
    """
    doc_id, text, *_ = columns(docs, "doc_id", "text")
    size = F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long")
    rows = stage(docs.select(doc_id.alias("doc_id"), hashed(doc_id, text.cast("string")).alias("bits"), size.alias("n_bytes")), "sized")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    top, depth, open_rows, done = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + DEEPER), rows, []
    while True:
        leaf = F.shiftright("bits", BITS - depth).alias("leaf")
        fine = stage(open_rows.groupBy(leaf).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "leaves")
        level = F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("d")
        up = fine.select("leaf", "b", "n", level).withColumn("prefix", F.expr(f"shiftright(leaf, {depth} - d)"))
        sums = up.groupBy("d", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = F.col("shard_bytes") <= limit
        parents = sums.where(~fits).select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        last = (F.col("d") == BITS) if depth == BITS else F.lit(False)
        reached = sums.join(parents, ["d", "prefix"], "left_semi")
        if top == 0:
            reached = reached.union(sums.where("d = 0"))
        elif done:  # all ancestors of the open buckets are too large
            reached = reached.union(sums.where(F.col("d") == top)).distinct()
        leaves = reached.where(fits | last)
        directory = up.select("leaf", "d", "prefix").join(leaves, ["d", "prefix"])
        bit_text = F.expr("substring(lpad(conv(prefix, 10, 2), 64, '0'), 65 - d, d)")
        directory = stage(directory.select("leaf", bit_text.alias("shard"), F.col("d").alias("depth"), "shard_bytes", "shard_docs"), "directory")
        with_leaf = open_rows.withColumn("leaf", F.shiftright("bits", BITS - depth))
        done.append(with_leaf.join(directory, "leaf").select(*rows.columns, "shard", "depth", "shard_bytes", "shard_docs"))
        if depth == BITS or directory.agg(F.sum(F.lit(1))).first()[0] == fine.count():
            break
        open_rows = stage(with_leaf.join(directory, "leaf", "left_anti").select(*rows.columns), "open")
        top, depth = depth + 1, min(BITS, depth + 1 + DEEPER)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.withColumn("oversize", F.col("shard_bytes") > limit)


def write_shards(docs: DataFrame, path: str | None = None, limit: int = SHARD_BYTES) -> DataFrame:
    """Write docs with a folder for each shard; rows that share an id and a text go together. Returns what was written: the
    columns of docs and the shard, in column ``shard``, or ``_shard`` and so on where docs has that one."""
    path = path or new_folder(docs.sparkSession, "shards")
    where = shards(docs, limit).select("bits", "shard").distinct()
    key, shard = own_name(docs, "bits"), "shard" if "shard" not in map(str.lower, docs.columns) else own_name(docs, "shard")
    doc_id, text = columns(docs, "doc_id", "text")
    keyed = docs.withColumn(key, hashed(doc_id, text.cast("string")))
    met = where.select(F.col("bits").alias(key), F.concat(F.lit("b"), "shard").alias(shard))
    keyed.join(met, key).drop(key).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS bits,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
sums AS (
  SELECT d, bits >> ({BITS} - d) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
  FROM sized, (SELECT CAST(unnest(range(0, {BITS + 1})) AS INTEGER) AS d) GROUP BY 1, 2),
levels AS (
  SELECT s.doc_id, s.bits, s.n_bytes, u.*, row_number() OVER (PARTITION BY s.doc_id, s.bits ORDER BY u.d) AS k
  FROM sized s JOIN sums u ON s.bits >> ({BITS} - u.d) = u.prefix WHERE u.shard_bytes <= {SHARD_BYTES} OR u.d = {BITS})
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), d) END AS shard,
       d AS depth, shard_bytes, shard_docs, shard_bytes > {SHARD_BYTES} AS oversize
FROM levels WHERE k = 1"""
