"""Exact duplicates by counting quotient filters.

Each partition of the fingerprint table builds one filter: the leading bits of a fingerprint are its quotient, the others
its remainder; the filter keeps, block by block of quotients, how many remainders each quotient has, the remainders in
order and a count for each. Filters merge without loss, since quotient and remainder give the fingerprint back: sorted
remainders are merged two filters at a time, and equal ones add their counts. Only texts whose merged fingerprint has a
count above one are grouped and compared byte by byte, combined before the shuffle; the others are known to be alone.

Defined cases: a null text counts as empty. Texts are equal when identical after lower-casing A-Z only. Of equal texts
the largest doc_id stays; rows that repeat that doc_id share its flag, and where all ids are null all rows share it.
``exact_dedup`` keeps one row of each text: of rows that repeat id and text, the one whose other columns come first as JSON.
An empty table gives no rows. Other columns are ignored by ``exact_duplicates`` and kept by ``exact_dedup``.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, own_name, stage

#: Fingerprints a merged block is to hold, and bits of remainder below the quotient.
BLOCK, REMAINDER = 50_000, 32
#: Fingerprints that a task gathers before it counts them into its filter.
GATHER = 1 << 20


def normal(text: Column) -> Column:
    """The bytes of a text with A-Z in lower case."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    each = F.translate(own, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(own) == F.length(own), F.lower(own)).otherwise(each).cast("binary")  # ASCII alone: lower does the same, faster


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)


def merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of (keys, counts) as one; equal keys add their counts."""
    (ka, ca), (kb, cb) = a, b
    keys, counts = np.empty(len(ka) + len(kb), ka.dtype), np.empty(len(ka) + len(kb), np.int64)
    at = np.searchsorted(ka, kb, "right") + np.arange(len(kb))
    rest = np.ones(len(keys), bool)
    rest[at] = False
    keys[at], counts[at], keys[rest], counts[rest] = kb, cb, ka, ca
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def quotient_filter(keys: np.ndarray, counts: np.ndarray, block_bits: int) -> pd.DataFrame:
    """The filter of some sorted distinct fingerprints (unsigned): a row for each block, with runs, remainders and counts."""
    quotients = (keys >> np.uint64(REMAINDER)).astype(np.uint32)
    remainders = (keys & np.uint64((1 << REMAINDER) - 1)).astype(np.uint32)
    blocks = quotients >> np.uint32(32 - block_bits) if block_bits else np.zeros(len(keys), np.uint32)
    rows, starts = [], np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
    for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
        occupied, runs = np.unique(quotients[s:e], return_counts=True)
        rows.append((int(blocks[s]), occupied.tobytes(), runs.astype(np.int32).tobytes(), remainders[s:e].tobytes(), counts[s:e].tobytes()))
    return pd.DataFrame(rows, columns=["block", "occupied", "runs", "remainders", "counts"])


def fingerprints_of(row) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of one block of a filter, in order."""
    quotients = np.repeat(np.frombuffer(row.occupied, np.uint32), np.frombuffer(row.runs, np.int32)).astype(np.uint64)
    return quotients << np.uint64(REMAINDER) | np.frombuffer(row.remainders, np.uint32), np.frombuffer(row.counts, np.int64)


def merge_all(filters: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of the filters of one block, merged two at a time."""
    runs = [fingerprints_of(r) for r in filters.itertuples()]
    while len(runs) > 1:
        runs = [merged(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def partition_filter(pdfs, bits: int):
    """The one filter of a partition, whose rows come in batches."""
    runs, gathered, n = [], [], 0
    for pdf in pdfs:
        gathered.append(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64))
        n += len(pdf)
        if n >= GATHER:
            runs, gathered, n = [functools.reduce(merged, [*runs, counted(np.concatenate(gathered))])], [], 0
    if n:
        runs.append(counted(np.concatenate(gathered)))
    if runs:
        yield quotient_filter(*functools.reduce(merged, runs), bits)


def repeated(fps: DataFrame) -> DataFrame:
    """(fp) of those that column fp holds more than once, by merging the filters of its partitions."""
    bits = int(np.clip(np.ceil(np.log2(max(1, fps.count()) / BLOCK)), 0, 24))

    def merge(pdf):
        keys, counts = merge_all(pdf)
        return pd.DataFrame({"fp": keys[counts > 1].view(np.int64)})

    held = "block long, occupied binary, runs binary, remainders binary, counts binary"
    return fps.select("fp").mapInPandas(lambda pdfs: partition_filter(pdfs, bits), held).groupBy("block").applyInPandas(merge, "fp long")


def _verified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Each row's (doc_id, text_sha256), and (text_sha256, group_size, keep_id) of the texts that several rows have."""
    doc_id, text = columns(docs, id_col, text_col)
    chosen = docs.select(doc_id.cast("long").alias("doc_id"), normal(text).alias("own"))
    rows = stage(chosen.select("doc_id", F.xxhash64("own").alias("fp"), F.sha2("own", 256).alias("text_sha256")), "digests")
    twice = stage(repeated(rows), "repeated")
    suspects = chosen.withColumn("fp", F.xxhash64("own")).join(twice, "fp", "left_semi")
    # equal bytes make a group; each task combines its own before the shuffle
    groups = suspects.groupBy("own").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1")
    return rows, stage(groups.select(F.sha2("own", 256).alias("text_sha256"), "group_size", "keep_id"), "groups", twice)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs."""
    rows, groups = _verified(docs, id_col, text_col)
    keep = F.when(F.col("met"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.join(groups.withColumn("met", F.lit(True)), "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each text. Rows are told apart by id and text, so a repeated id loses no other text."""
    rows, groups = _verified(docs, "doc_id", "text")
    key = lambda doc_id, sha: F.concat(sha, F.lit(":"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("")))
    met = rows.join(groups, "text_sha256").select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"))
    marked = stage(met.groupBy("key").agg(F.first("stays").alias("stays"), F.count("*").alias("n")), "marked", rows, groups)
    name = own_name(docs, "key")
    doc_id, text = columns(docs, "doc_id", "text")
    keyed = docs.withColumn(name, key(doc_id, F.sha2(normal(text), 256)))
    # always a merge: what goes has no bound, so neither the plan nor its disk turns with its size
    alone = keyed.hint("merge").join(marked.where("not stays or n > 1").select(F.col("key").alias(name)), name, "left_anti").select(*docs.columns)
    if not marked.where("stays and n > 1").head(1):
        return alone
    # rows that repeat id and text: one of each, combined before the shuffle
    again = keyed.join(marked.where("stays and n > 1").select(F.col("key").alias(name)), name, "left_semi")
    one = again.groupBy(name).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row"))
    return alone.unionByName(one.select("row.*"))
