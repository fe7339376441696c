"""Packing into fixed-length sequences by shortest-pack-first over the length histogram.

A document's ids are cut every ``size``; full pieces are sequences of their own. What is left of each document is packed
whole: the driver takes the histogram of the remaining lengths (at most ``size`` numbers), places lengths longest first
into the pattern with the most room, which is the one packed shortest, and counts how often each pattern is used. A pattern
used n times takes n consecutive ranks of each of its lengths, so a piece finds its sequence by the rank that it has among
pieces of its length. Ranks come from per-partition counts; no task holds all pieces of a length.

Few patterns are left badly filled, the last ones. A sequence whose length is a power of two needs no padding, so pieces of
patterns with more than ``slack`` padding are cut into powers of two, each a sequence. Their checksums are taken when the
text is tokenised; ids are never kept.

Defined cases: a null or empty text has the end id alone. Repeated rows are packed each. No documents give no pieces.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, small_batches, stage

SIZE, END, SLACK = 4096, 2, 64
#: Ids of about so many text parts are remembered by a worker; longer parts aren't.
CACHE, LONGEST = 400_000, 48
#: How the pre-tokenizer cuts ASCII letters, digits and signs.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def _powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class Encoder(dict):
    """Part of a text → its ids as bytes; parts lie between spaces and line ends, which the tokenizer drops and never joins across.

    A worker keeps one encoder for its tasks, so frequent parts are encoded once. A printable ASCII part is changed by the
    normalizer to lower case alone and is cut by the pre-tokenizer as by _PIECE; other parts go through both. The pieces go to
    the tokenizer's model, and a part that may hold a special token goes through the whole tokenizer."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.own, self.pieces = Tokenizer.from_str(tokenizer), {}
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.own.get_vocab_size())]
        self.model = self.own.model

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = b"".join([self.as_bytes[t.id] for t in self.model.tokenize(piece)])
            if len(self.pieces) < CACHE:
                self.pieces[piece] = ids
        return ids

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            ids = self._piece(part.lower())
        elif "<|" in part:
            ids = np.array(self.own.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        elif part.isascii() and part.isprintable():
            ids = b"".join(map(self._piece, _PIECE.findall(part.lower())))
        else:
            cut = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(part))
            ids = b"".join([self._piece(piece) for piece, _ in cut])
        if len(self) < CACHE and len(part) <= LONGEST:  # what comes early is what comes often
            self[part] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


def _pieces(docs: DataFrame, tokenizer: str, size: int, end: int) -> DataFrame:
    """A row a document: its length, the checksums of its full pieces, of the rest, and of the rest cut into powers of two;
    ``at``: its place among the rests of that length in its partition; ``alone``: pieces before it there that may be sequences
    of their own."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())  # bounded by the vocabulary

    def run(pdfs):
        from pyspark import TaskContext

        encoder, last, part, seen, alone = _encoder(model.value), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId(), defaultdict(int), 0
        for pdf in pdfs:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"].tolist(), strict=True):
                ids = encoder.ids(text) + last
                n = len(ids) // 4
                full = [zlib.crc32(ids[4 * s : 4 * (s + size)]) for s in range(0, n - size + 1, size)]
                rest, cuts, s = n % size, [], n - n % size
                for p in _powers(rest):
                    cuts.append(zlib.crc32(ids[4 * s : 4 * (s + p)]))
                    s += p
                rows.append((i, n, full, rest, zlib.crc32(ids[4 * (n - rest) :]), cuts, part, alone, seen[rest]))
                seen[rest] += 1
                alone += len(full) + len(cuts)
            out = pd.DataFrame(rows, columns=["doc_id", "n", "full", "rest", "crc", "cuts", "part", "alone", "at"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    doc_id, text = columns(docs, "doc_id", "text")
    chosen = docs.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, n long, full array<long>, rest int, crc long, cuts array<long>, part int, alone long, at long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times used) of each pattern; histogram: pieces of each length below ``size``."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # by what is left
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            most = max((r for r in room if r >= length), default=None)
            if most is None:
                room[size - length][(length,)] += todo
                break
            pattern = min(room[most])
            n = min(todo, room[most][pattern])
            room[most][pattern] -= n
            if not room[most][pattern]:
                del room[most][pattern]
                if not room[most]:
                    del room[most]
            room[most - length][(*pattern, length)] += n
            todo -= n
    return [(pattern, n) for left in sorted(room) for pattern, n in sorted(room[left].items())]


def _placed(patterns: list, size: int, slack: int) -> tuple[pd.DataFrame, int]:
    """For ranges of ranks of each length: the first sequence and the offset there, or -1 where pieces are cut."""
    taken, rows, sequences = defaultdict(int), [], 0
    for pattern, n in patterns:
        filled = sum(pattern)
        whole = size - filled <= slack or filled & (filled - 1) == 0
        offset = 0
        for length in pattern:
            # a length that a pattern has twice takes two ranges
            rows.append((length, taken[length], sequences if whole else -1, offset))
            taken[length] += n
            offset += length
        sequences += n if whole else 0
    return pd.DataFrame(rows, columns=["rest", "least", "sequence", "offset"]).sort_values(["rest", "least"], ignore_index=True), sequences


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, slack: int = SLACK) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = stage(_pieces(docs, tokenizer, size, end), "pieces")
    histogram = {r[0]: r[1] for r in rows.where("rest > 0").groupBy("rest").count().collect()}  # at most ``size`` rows
    table, sequences = _placed(shortest_pack_first(histogram, size), size, slack)
    places = spark.sparkContext.broadcast((table["rest"].to_numpy().astype(np.int64) << 48 | table["least"].to_numpy().astype(np.int64), table["sequence"].to_numpy(), table["least"].to_numpy(), table["offset"].to_numpy()))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = rows.groupBy("rest", "part").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    joined = rows.join(bases.select("rest", "part", "before"), ["rest", "part"])

    def run(pdfs):
        keys, first, least, offset = places.value
        for pdf in pdfs:
            rank = (pdf["before"] + pdf["at"]).to_numpy().astype(np.int64)
            rest = pdf["rest"].to_numpy().astype(np.int64)
            slot = np.searchsorted(keys, rest << 48 | rank, "right") - 1
            out = []
            for i, n, full, r, crc, cuts, part, alone, k, s in zip(pdf["doc_id"], pdf["n"], pdf["full"], rest.tolist(), pdf["crc"], pdf["cuts"], pdf["part"], pdf["alone"], rank.tolist(), slot.tolist(), strict=True):
                # sequences of one piece are numbered after the packed ones, counted within their partition
                own = sequences + (int(part) << 40) + int(alone)
                out += [(i, j * size, size, c, n, own + len(cuts) + j, 0) for j, c in enumerate(full)]
                if r and first[s] >= 0:
                    out.append((i, n - r, r, crc, n, int(first[s] + k - least[s]), int(offset[s])))
                elif r:
                    start = n - r
                    for j, (p, c) in enumerate(zip(_powers(r), cuts, strict=True)):
                        out.append((i, start, p, c, n, own + j, 0))
                        start += p
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return joined.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
