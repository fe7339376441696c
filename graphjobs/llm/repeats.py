"""Repeated passages by suffix sorting with a difference cover: bytes of strings that also start earlier go.

Documents are laid in order of doc_id and gathered in units of a few MB; a unit's number and a byte's place in it give the order of all bytes.
The cover takes those starts whose remainder by ``PERIOD`` is in ``COVER``: any two starts have an offset below the period
at which both are in it, so two equal strings of ``LENGTH`` bytes hold a sample each at one offset, with ``NAME`` = LENGTH -
PERIOD + 1 equal bytes from there. Suffixes are dealt to buckets by the leading bits of their key and a task sorts one
bucket at a time; equal keys are neighbours and the earliest start is the first. Order among unequal strings doesn't matter
here, so a key is a fingerprint of the bytes in place of the bytes.

1. Sample suffixes are sorted by their first NAME bytes: a start none of whose samples repeats has no equal.
2. Repeated samples are ranked: by those NAME bytes, then by all bytes of the strings that hold the sample. A sample that is not
   the first of its rank settles the long ties: each string of LENGTH bytes around it also starts earlier, with no more bytes read.
3. What is left are starts beside samples that share a name but not a rank, at the edges of repeats. These alone are sorted
   by all LENGTH bytes.

A unit sends each key once, so a passage in every document is one row a unit, and each bucket answers with bits in the order sent. Ranks
and strings are told apart by 128 bits. Nothing passes the driver but the number of bytes.

Defined cases: a null text counts as empty; texts below LENGTH bytes keep all. Null ids come first; rows that repeat an id are in
order of their bytes, equal rows in either order (the results are the same). Other columns are ignored. No rows give no rows. A task holds
a unit, or one document where that is longer, with about 20 times its bytes in arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_of, columns, dealt, small_batches, stage

LENGTH, PERIOD = 100, 31
#: A perfect difference set: every remainder is a difference of two of these.
COVER = (1, 5, 11, 24, 25, 27)
NAME = LENGTH - PERIOD + 1
UNIT, UNIT_ROWS = 2 << 20, 1 << 16
#: Keys that a bucket is to hold.
BUCKET = 1 << 20
_GAP = LENGTH + 8
_SEED = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mixed(h: np.ndarray, word: np.ndarray, lane: int) -> np.ndarray:
    h = (h ^ word) * _ODD[lane]
    return h ^ (h >> np.uint64(32))


class Unit:
    """Documents side by side with zeros between, so that no word read for one holds bytes of another."""

    def __init__(self, lengths: np.ndarray, raw: bytes):
        self.lengths = lengths.astype(np.int64)
        self.ends = np.cumsum(self.lengths + _GAP)
        self.starts = self.ends - self.lengths
        self.size = int(self.ends[-1] if len(self.ends) else 0) + _GAP
        self.bytes = np.zeros(self.size, np.uint8)
        self.inside = np.zeros(self.size + 1, np.int8)
        self.inside[self.starts] += 1
        np.subtract.at(self.inside, self.ends, 1)
        self.inside = np.cumsum(self.inside[:-1], dtype=np.int8).astype(bool)
        self.bytes[self.inside] = np.frombuffer(raw, np.uint8)
        self.words = np.ndarray((self.size - 7,), "<u8", self.bytes, 0, (1,))

    def key(self, at: np.ndarray, length: int, lane: int, h: np.ndarray | None = None) -> np.ndarray:
        """A fingerprint of the bytes from each place; read in words of eight, the last one overlapping."""
        h = np.full(len(at), _SEED[lane]) if h is None else h
        for step in [*range(0, length - 8, 8), length - 8]:
            h = _mixed(h, self.words[at + step], lane)
        return h

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and document of each sample with NAME bytes behind it, in order."""
        room = np.maximum(self.lengths - NAME + 1, 0)
        most = int(room.max(initial=0)) // PERIOD + 1
        pattern = (np.arange(most)[:, None] * PERIOD + np.array(COVER)).ravel()
        n = np.searchsorted(pattern, room)
        of = np.repeat(np.arange(len(n)), n)
        return self.starts[of] + pattern[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)], of

    def around(self, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the strings that hold the sample at an offset below the period; last < first: none."""
        return np.maximum(self.starts[of], at - PERIOD + 1), np.minimum(at, self.ends[of] - LENGTH)

    def context(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """A fingerprint of all bytes of those strings, and of where the document cuts them."""
        first, _ = self.around(at, of)
        end = np.minimum(at + LENGTH, self.ends[of])
        h = np.full(len(at), _SEED[1]) ^ ((at - first) << 8 | (end - at)).astype(np.uint64)
        return self.key(at - PERIOD + 1, LENGTH + PERIOD - 1, 1, h)


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _order(one: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Places sorted by ``one``, and those that share it by the rest. Few share it in a unit, so all keys sort only those."""
    order = np.argsort(one)
    same = np.flatnonzero(one[order[1:]] == one[order[:-1]])
    at = np.union1d(same, same + 1)
    tied = order[at]
    order[at] = tied[np.lexsort((*[k[tied] for k in reversed(then)], one[tied]))]
    return order


def _told(cuts: list, told, field: str, n: int) -> np.ndarray:
    """The bits that the buckets gave back for n keys."""
    by_part, out = {t["part"]: t[field] for t in told} if told is not None else {}, np.zeros(n, bool)
    for p, s, e in cuts:
        out[s:e] = np.unpackbits(np.frombuffer(by_part[p], np.uint8), count=e - s)
    return out


class Names:
    """Step 1 in a unit: its samples by name."""

    def __init__(self, unit: Unit, bits: int):
        self.at, self.of = unit.samples()
        name = unit.key(self.at, NAME, 0)
        self.order = np.argsort(name)  # Ranks puts equal names in order
        self.name = name[self.order]
        starts = _runs(self.name)
        self.own, self.sizes = self.name[starts], np.diff(np.append(starts, len(name)))
        self.cuts = dealt(self.own, bits)


class Ranks:
    """Step 2 in a unit: its repeated samples by name and context; ``first`` is the earliest of each rank here."""

    def __init__(self, unit: Unit, bits: int, told):
        names = Names(unit, bits)
        held = np.repeat(_told(names.cuts, told, "a", len(names.own)) | (names.sizes > 1), names.sizes)
        at, name = names.order[held], names.name[held]
        of, at = names.of[at], names.at[at]
        context = unit.context(at, of)
        order = _order(name, context, at)
        self.at, self.of, name, context = at[order], of[order], name[order], context[order]
        self.first = _runs(name, context)
        self.name, self.context = name[self.first], context[self.first]
        self.cuts = dealt(self.name, bits)


class Strings:
    """Step 3 in a unit: the starts around samples first of their rank whose name has other ranks, by all LENGTH bytes."""

    def __init__(self, unit: Unit, bits: int, ranks: Ranks, told):
        self.earlier = _told(ranks.cuts, told, "a", len(ranks.first))
        edge = ranks.first[~self.earlier & _told(ranks.cuts, told, "b", len(ranks.first))]
        first, last = unit.around(ranks.at[edge], ranks.of[edge])
        at = np.flatnonzero(covered(first, last + 1, unit.size))
        one, two = unit.key(at, LENGTH, 0), unit.key(at, LENGTH, 1)
        order = _order(one, two, at)
        self.at, one, two = at[order], one[order], two[order]
        self.first = _runs(one, two)
        self.one, self.two = one[self.first], two[self.first]
        self.cuts = dealt(self.one, bits)


def covered(first: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the intervals [first, end); empty ones count for nothing."""
    real = end > first
    step = np.bincount(first[real], minlength=size + 1) - np.bincount(end[real], minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def removed(unit: Unit, bits: int, told_names, told_ranks, told_strings) -> np.ndarray:
    """Whether each byte of a unit goes."""
    ranks = Ranks(unit, bits, told_names)
    strings = Strings(unit, bits, ranks, told_ranks)
    later = np.ones(len(ranks.at), bool)
    later[ranks.first] = strings.earlier  # the first of a rank here, where an earlier unit has it
    first, last = unit.around(ranks.at[later], ranks.of[later])
    again = np.ones(len(strings.at), bool)
    again[strings.first] = _told(strings.cuts, told_strings, "a", len(strings.first))
    at = strings.at[again]
    end = np.where(last >= first, last + LENGTH, first)
    return covered(np.concatenate((first, at)), np.concatenate((end, at + LENGTH)), unit.size)


def _gathered(pdfs, size: int):
    """Units of a partition's documents."""
    made, ids, texts, n = 0, [], [], 0

    def flush():
        nonlocal made, ids, texts, n
        number = TaskContext.get().partitionId() << 33 | made
        known = np.array([i is not None for i in ids])
        own = np.array([0 if i is None else i for i in ids], np.int64)
        row = {"unit": [number], "ids": [own.tobytes()], "known": [known.tobytes()], "lengths": [[len(t) for t in texts]], "bytes": [b"".join(texts)]}
        made, ids, texts, n = made + 1, [], [], 0
        return pd.DataFrame(row)

    for pdf in pdfs:
        for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
            ids.append(None if doc_id is pd.NA else int(doc_id))
            texts.append(text)
            n += len(text)
            if n >= size or len(texts) >= UNIT_ROWS:
                yield flush()
    if texts:
        yield flush()


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of names: a bit for each of every unit, set where another unit has it too."""
    keys = [np.frombuffer(k, np.uint64) for k in pdf["one"]]
    _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return _bits(pdf, keys, n[at] > 1)


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of double keys: (a) set where an earlier unit has the key, (b) where the first half has other second halves."""
    pdf = pdf.sort_values("unit")
    keys = [np.frombuffer(k, np.uint64) for k in pdf["one"]]
    one, two = np.concatenate(keys), np.concatenate([np.frombuffer(k, np.uint64) for k in pdf["two"]])
    order = np.lexsort((two, one))  # keeps the order of units among equals
    one, two = one[order], two[order]
    earlier, first, names = np.ones(len(one), bool), _runs(one, two), _runs(one)
    earlier[first] = False
    kinds = np.searchsorted(first, np.append(names, len(one)))
    several = np.repeat(np.diff(kinds) > 1, np.diff(np.append(names, len(one))))
    a, b = np.empty(len(one), bool), np.empty(len(one), bool)
    a[order], b[order] = earlier, several
    return _bits(pdf, keys, a, b)


def _bits(pdf: pd.DataFrame, keys: list, *flags: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum([len(k) for k in keys])
    out = {"unit": pdf["unit"].to_numpy(), "part": pdf["part"].to_numpy(), "a": None, "b": None}
    for name, flag in zip("ab", flags, strict=False):
        out[name] = [np.packbits(flag[e - len(k) : e]).tobytes() for k, e in zip(keys, ends, strict=True)]
    return pd.DataFrame(out)


_TOLD = "unit long, part long, a binary, b binary"
_KEYS = "unit long, part long, one binary, two binary"


def _rows(unit: int, cuts: list, one: np.ndarray, two: np.ndarray | None) -> pd.DataFrame:
    return pd.DataFrame({"unit": unit, "part": [p for p, _, _ in cuts], "one": [one[s:e].tobytes() for _, s, e in cuts], "two": [None if two is None else two[s:e].tobytes() for _, s, e in cuts]})


def _joined(units: DataFrame, **told: DataFrame) -> DataFrame:
    """units with a list of what the buckets told it for each step; always a merge, whatever the sizes."""
    each = None
    for name, df in told.items():
        one = df.select("unit", F.lit(name).alias("step"), "part", "a", "b")
        each = one if each is None else each.union(one)
    lists = [F.collect_list(F.when(F.col("step") == name, F.struct("part", "a", "b"))).alias(name) for name in told]
    return units.hint("merge").join(each.groupBy("unit").agg(*lists), "unit", "left")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = UNIT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs: removed runs as (start, end) in bytes, and the bytes that stay."""
    spark = docs.sparkSession
    small_batches(spark)
    doc_id, text = columns(docs, id_col, text_col)
    given = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = given.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    units = stage(laid.mapInPandas(lambda pdfs: _gathered(pdfs, size), "unit long, ids binary, known binary, lengths array<int>, bytes binary"), "units")
    total = units.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    bits = bits_of(total * len(COVER) // PERIOD, bucket)

    def names(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                found = Names(Unit(r.lengths, r.bytes), bits)
                yield _rows(r.unit, found.cuts, found.own, None)

    def ranks(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                found = Ranks(Unit(r.lengths, r.bytes), bits, r.names)
                yield _rows(r.unit, found.cuts, found.name, found.context)

    def strings(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                unit = Unit(r.lengths, r.bytes)
                found = Strings(unit, bits, Ranks(unit, bits, r.names), r.ranks)
                yield _rows(r.unit, found.cuts, found.one, found.two)

    def cut(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                unit = Unit(r.lengths, r.bytes)
                gone = removed(unit, bits, r.names, r.ranks, r.strings)
                turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                first, end = turn[::2], turn[1::2]
                of = np.searchsorted(unit.ends, first, "right")
                at = np.searchsorted(of, np.arange(len(unit.ends) + 1))
                out = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
                for i, (s, e) in enumerate(zip(unit.starts.tolist(), unit.ends.tolist(), strict=True)):
                    mine = slice(at[i], at[i + 1])
                    own = unit.bytes[s:e]
                    out["spans"].append([{"start": a - s, "end": b - s} for a, b in zip(first[mine].tolist(), end[mine].tolist(), strict=True)])
                    out["kept"].append((own[~gone[s:e]] if at[i + 1] > at[i] else own).tobytes())
                    out["n_bytes"].append(e - s)
                out["doc_id"] = pd.arrays.IntegerArray(np.frombuffer(r.ids, np.int64).copy(), ~np.frombuffer(r.known, bool))
                yield pd.DataFrame(out)

    slim = units.select("unit", "lengths", "bytes")
    told_names = stage(slim.mapInPandas(names, _KEYS).groupBy("part").applyInPandas(_repeated, _TOLD), "names")
    told_ranks = stage(_joined(slim, names=told_names).mapInPandas(ranks, _KEYS).groupBy("part").applyInPandas(_sorted, _TOLD), "ranks")
    edges = _joined(slim, names=told_names, ranks=told_ranks)
    told_strings = stage(edges.mapInPandas(strings, _KEYS).groupBy("part").applyInPandas(_sorted, _TOLD), "strings")
    whole = _joined(units, names=told_names, ranks=told_ranks, strings=told_strings)
    return whole.mapInPandas(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeated_spans(docs, **how).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
