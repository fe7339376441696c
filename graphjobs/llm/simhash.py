"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits have a common variant within two bits of each, so every fingerprint
stands for all its variants within half the radius and equal variants meet. There are 2,081 variants a fingerprint.
They are dealt out by their leading bits, and a row (leading bits, fingerprint) stands for all variants of the
fingerprint that begin so: with eight leading bits 37 rows travel instead of 2,081, and the receiving task writes the
variants out, sorts them and finds the equal ones. All fingerprints that share a variant lie within the radius of each
other, so a chain through them loses no link and no group is expanded into its pairs.

Defined cases: a null or empty text, or one without words, has fingerprint zero, linked like any other. Fewer words than
the shingle takes make one shingle. Repeated rows each get a row. A null doc_id has a fingerprint and a component, but
never names one unless all ids of the component are null. Other columns are ignored by ``fingerprints`` and kept by
``near_dedup``.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import afresh, columns, connected_components, local_roots, numbered, small_batches, stage

BITS = 64
SEED = 42
#: Leading bits by which variants are dealt out at least; more where a group would hold over GROUP fingerprints.
LEAD, GROUP = 8, 8192
#: Fingerprints that a group may hold before it is dealt on, and by how many bits.
CROWD, STEP = 1 << 19, 4
#: Variants that one task sorts at a time.
BLOCK = 4_000_000


def _fingerprint(text: str | None, words: int) -> int:
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.fromiter(map(len, found), np.int64, len(found)).cumsum() + np.arange(len(found))
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(found) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: long) for each row; fp holds the 64 bits."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = pa.array([_fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    doc_id, text = columns(docs, id_col, text_col)
    return docs.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


@functools.cache
def _masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most ``most`` ones."""
    return np.array([sum(1 << i for i in at) for r in range(most + 1) for at in combinations(range(bits), r)], np.uint64)


def _meet(fps: np.ndarray, left: np.ndarray, rest: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints that share a variant of their low ``rest`` bits; left: flips that each still has."""
    size = sum(int((left == r).sum()) * len(_masks(rest, r)) for r in range(left.max(initial=0) + 1))
    if size > BLOCK and rest > 8:
        found = []
        lead = (fps >> np.uint64(rest - 4)) & np.uint64(15)
        for p in range(16):  # by four bits more, one part after the other
            still = left - np.bitwise_count(lead ^ np.uint64(p)).astype(np.int64)
            at = np.flatnonzero(still >= 0)
            if len(at) > 1:
                a, b = _meet(fps[at], still[at], rest - 4, radius)
                found.append(at[np.stack((a, b))])
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    else:
        low = fps & np.uint64((1 << rest) - 1)
        at = [np.flatnonzero(left == r) for r in range(left.max(initial=0) + 1)]
        masks = [_masks(rest, r) for r in range(len(at))]
        variants = np.concatenate([(low[i][:, None] ^ m).ravel() for i, m in zip(at, masks, strict=True)])
        owner = np.concatenate([np.repeat(i, len(m)) for i, m in zip(at, masks, strict=True)])
        order = np.argsort(variants)
        same = np.flatnonzero(variants[order[1:]] == variants[order[:-1]])
        a, b = owner[order[same]], owner[order[same + 1]]
        a, b = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(a * len(fps) + b)
    a, b = pairs // len(fps), pairs % len(fps)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius
    return a[near], b[near]


def _dealt(fps: DataFrame, half: int, lead: int) -> DataFrame:
    """(depth, lead, fp): each fingerprint in every group of variants with the same ``depth`` leading bits that it can reach
    with half the radius. A group of over CROWD fingerprints, which lie closely together, is dealt on by STEP bits more."""
    flips = lambda n: F.explode(F.array(*[F.lit(int(m)) for m in _masks(n, half)])).alias("flip")
    top = F.shiftrightunsigned("fp", BITS - lead)
    sizes = fps.groupBy(top.alias("own")).agg(F.count("*").alias("n")).select("own", "n", flips(lead))
    sizes = sizes.groupBy(F.col("own").bitwiseXOR(F.col("flip")).alias("lead")).agg(F.sum("n").alias("n"))
    rows = fps.select("fp", flips(lead)).select(top.bitwiseXOR(F.col("flip")).alias("lead"), "fp", (half - F.bit_count("flip")).alias("left"))
    depth, done = lead, None
    while True:
        crowded = stage(sizes.where(F.col("n") > CROWD).select("lead"), "crowded")
        any_crowd = depth + STEP <= BITS and bool(crowded.head(1))
        calm = (rows.join(crowded, "lead", "left_anti") if any_crowd else rows).select(F.lit(depth).alias("depth"), "lead", "fp")
        done = calm if done is None else done.union(calm)
        if not any_crowd:
            return done
        depth += STEP
        bits = F.shiftrightunsigned("fp", BITS - depth).bitwiseAND(F.lit((1 << STEP) - 1))
        on = rows.join(crowded, "lead", "left_semi").select("lead", "fp", "left", flips(STEP)).where(F.bit_count("flip") <= F.col("left"))
        deeper = F.shiftleft("lead", STEP).bitwiseOR(bits.bitwiseXOR(F.col("flip"))).alias("lead")
        rows = stage(on.select(deeper, "fp", (F.col("left") - F.bit_count("flip")).alias("left")), "deeper")
        sizes = rows.groupBy("lead").agg(F.count("*").alias("n"))


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b) over distinct fingerprints (column fp): a chain within ``bits`` differing bits through every linked set."""
    half, count = bits // 2, max(1, fps.count())
    if bits % 2:
        raise ValueError("the radius must be even to be met in the middle")
    lead = max(LEAD, int(np.ceil(np.log2(count / GROUP))))

    def meet(key, pdf):
        depth, own = int(key[0]), np.unique(pdf["fp"].to_numpy().astype(np.int64)).view(np.uint64)
        used = np.bitwise_count((own >> np.uint64(BITS - depth)) ^ np.int64(key[1]).astype(np.uint64)).astype(np.int64)
        a, b = _meet(own, half - used, BITS - depth, half)
        root = local_roots(a, b, len(own))
        at = np.flatnonzero(root != np.arange(len(own)))
        return pd.DataFrame({"a": own[at].view(np.int64), "b": own[root[at]].view(np.int64)})

    return _dealt(fps, half, lead).groupBy("depth", "lead").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    prints = stage(fingerprints(docs, words, id_col, text_col), "fingerprints")
    each = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(each, bits)).withColumnRenamed("node", "fp")
    rooted = each.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select(afresh(F.col("root")).alias("root"), "component_id")
    by_print = stage(rooted.join(named, "root").select("fp", "component_id"), "named")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(by_print, "fp").select("doc_id", text, "component_id")


def near_dedup(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, rows without id last, then the first row."""
    rows, row = numbered(docs)
    doc_id, text = columns(rows, "doc_id", "text")
    own = rows.select(F.col(row).alias("row"), doc_id.cast("long").alias("doc_id"), text.alias("text"))
    each = near_duplicates(own, bits, words, "row").select(F.col("doc_id").alias("row"), "component_id")
    members = stage(each.join(own.select("row", "doc_id"), "row"), "members")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stays = members.groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    stays = stays.select(afresh(F.col("component_id")).alias("component_id"), F.col("first.row").alias("least"))
    gone = members.join(stays, "component_id").where("row <> least").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)
