"""Near duplicates by verified similarity: texts whose five-word shingle sets are alike to 0.8 or more (Jaccard).

Candidates meet by SimHash and ball hashing: a set has seeded fingerprints of 32 bits, a table each, and two sets meet where
those of one table differ in at most 2 * HALF bits, since both reach a common variant within HALF bits (see ``simhash``). At 0.8 about
15 % of the bits differ; two sets then meet in a table with a chance of 0.46 and in one of 18 with 0.9999. In sets below
SMALL shingles one vote decides more bits (19 % between four and five shingles), so they have 32 tables; sets too small to be alike to
another one have none. Unlike sets meet by chance too, a pair in 100,000, so a check fingerprint of 128 bits must lie within FAR bits:
36 % of them, five standard deviations beyond what 0.8 brings. What so meets in a table by chains shares a key, one a table and set.

Texts with one and the same set stand for each other. The others that keys chain together form a candidate group, laid out by set size and cut into blocks of BLOCK texts. First each block is verified within itself and
against the next, on whole sets; what links so chain together is a kin, and pairs within a kin need no more work. In a group
of several blocks the pairs across kins are left. Shingles are ordered by how many texts and kins of the group hold them, the rarest first: alike
sets share one among the first fifth of the larger and the first ninth of the smaller, and its places bound what else
they can share. Shingles that no second kin holds are left out. Every pair that these bounds allow is verified, so no pair is left out for the size
of its group; texts that are unlike for what each has alone, or linked by then, are not paired, whatever passage they share. A
large group of near copies then costs its size, not its square; what costs a product is texts near a kin that nearly reach it.

Defined cases: words are those of ``simhash``; a null text or one without words has the empty shingle, so such texts are
alike. Fewer words than the shingle takes make one shingle. Of each group that links chain together one row stays: the one
with the smallest doc_id, rows without id last, then the first row. Rows that share a doc_id are told apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import afresh, bits_of, columns, connected_components, dealt, local_roots, numbered, ranked, recorded, small_batches, stage, unstage
from .simhash import _masks

SEED = 42
#: Tables of a set, and of one below SMALL shingles; each has a fingerprint of 32 bits.
TABLES, SMALL_TABLES, SMALL = 18, 32, 32
#: Half of the bits in which fingerprints that meet may differ, and the most by which their check fingerprints may.
HALF, FAR = 2, 46
#: Fingerprints of a table in a group, beyond which the table is dealt out by leading bits.
GROUP = 1 << 21
#: Variants that one task sorts at a time; sets under one variant that are checked pair by pair, more are taken as met.
VARIANTS, CROWD = 4_000_000, 16
#: Texts in a block of a candidate group; a unit holds two blocks.
BLOCK = 128
#: Shingles of a group that one task counts; texts on either side that hold one and meet in one task; pairs that it compares at a time.
TOKENS, PLACES, PAIRS = 1 << 21, 1 << 15, 1 << 20
#: Shingles whose values are drawn at a time.
_CHUNK = 4096

_WORDS = 2 + SMALL_TABLES // 2  # the check fingerprint, then two tables a word
_draw = np.random.default_rng(SEED)
_ODD = _draw.integers(0, 1 << 63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD, _TIES = _draw.integers(0, 1 << 64, (2, _WORDS), dtype=np.uint64)
#: A fingerprint of a table: its row, the row's check fingerprint, and the flips that it has left.
_ENTRY = np.dtype([("row", "<i8"), ("check", "<u8", 2), ("fp", "<u4"), ("left", "u1")])
#: A shingle's place, from 1, among those of a set of n, the rarest first, and what the text is to it (see ``_open_pairs``).
_PLACE = np.dtype([("token", "<u8"), ("row", "<i8"), ("kin", "<i8"), ("n", "<i4"), ("at", "<i4"), ("role", "u1")])
_INDEX, _ODD_ONE, _ANY = 1, 2, 4
#: In how many texts of a kin a shingle is; and of a group, with the kin that holds it most and the number of texts outside it.
_HELD = np.dtype([("token", "<u8"), ("kin", "<i8"), ("n", "<i4")])
_COUNT = np.dtype([("token", "<u8"), ("kin", "<i8"), ("n", "<i8"), ("odd", "<i8")])


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    found = (text or "").encode().lower().split()
    spans = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spans), np.uint64, len(spans)))


def _ones(votes: np.ndarray) -> np.ndarray:
    """How many rows have each bit set: full adders bring three words to a sum and a carry until few rows are left to unpack."""
    total, weight = np.zeros(votes.shape[1] * 64, np.int64), 1
    while len(votes):
        carries = [votes[:0]]
        while len(votes) > 48:
            k = len(votes) // 3
            a, b, c = votes[:k], votes[k : 2 * k], votes[2 * k : 3 * k]
            odd = a ^ b
            carries.append(a & b | odd & c)
            votes = np.concatenate((odd ^ c, votes[3 * k :]))
        total += weight * np.unpackbits(votes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8).astype(np.int64)
        votes, weight = np.concatenate(carries), 2 * weight
    return total


def prints(own: np.ndarray, similarity: float) -> bytes:
    """The check fingerprint of a set and those of its tables; a tie of votes is decided by the place of the bit."""
    if len(own) * (1 - similarity) < similarity - 1e-9:
        return b""  # one shingle more or less is too much
    words = 2 + (SMALL_TABLES if len(own) < SMALL else TABLES) // 2
    twice = np.zeros(words * 64, np.int64)
    for at in range(0, len(own), _CHUNK):
        votes = (own[at : at + _CHUNK, None] ^ _ADD[:words]) * _ODD[:words]
        twice += 2 * _ones(votes ^ votes >> np.uint64(32))
    ties = np.unpackbits(_TIES[:words].view(np.uint8), bitorder="little")
    return np.packbits(twice + ties > len(own), bitorder="little").tobytes()


def _met(own: np.ndarray, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of entries that chain together all that share a variant of their low ``rest`` bits and pass the check."""
    if sum(int((own["left"] == r).sum()) * len(_masks(rest, r)) for r in range(HALF + 1)) > VARIANTS and rest > 8:
        found, lead = [], own["fp"] >> np.uint32(rest - 4) & np.uint32(15)
        for p in range(16):  # by four bits more, one part after the other
            still = own["left"].astype(np.int64) - np.bitwise_count(lead ^ np.uint32(p))
            at = np.flatnonzero(still >= 0)
            part = own[at]
            part["left"] = still[at]
            found.append(at[np.stack(_met(part, rest - 4))])
        a, b = np.concatenate(found, axis=1)
    else:
        low = own["fp"].astype(np.uint64) & np.uint64((1 << rest) - 1)
        at = [np.flatnonzero(own["left"] == r) for r in range(HALF + 1)]
        held = [((low[i][:, None] ^ _masks(rest, r)) << np.uint64(32) | i[:, None].astype(np.uint64)).ravel() for r, i in enumerate(at)]
        held = np.sort(np.concatenate(held))
        variant = held >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate((variant[:1] == variant[:1], variant[1:] != variant[:-1])))
        sizes = np.diff(np.append(starts, len(held)))
        sizes = np.repeat(sizes, sizes)
        found, few = [], (sizes > 1) & (sizes <= CROWD)
        for some, most in ((sizes > CROWD, 2), (few, CROWD)):
            variant, owner = held[some] >> np.uint64(32), (held[some] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for k in range(1, most):
                same = np.flatnonzero(variant[k:] == variant[:-k])
                x, y = owner[same], owner[same + k]
                if some is few:
                    near = np.bitwise_count(own["check"][x] ^ own["check"][y]).sum(axis=1) <= FAR
                    x, y = x[near], y[near]
                found.append(np.stack((x, y)))
        a, b = np.concatenate(found, axis=1)
    pairs = np.unique(np.minimum(a, b) * len(own) + np.maximum(a, b))
    return pairs // max(1, len(own)), pairs % max(1, len(own))


def _keys(one: DataFrame) -> DataFrame:
    """(row, h): a key for each set and table in which it meets another one, the same for all that it meets by chains."""
    lead = max(0, int(np.ceil(np.log2(max(1, one.count()) / GROUP))))

    def deal(pdfs):
        for pdf in pdfs:
            pdf = pdf[pdf["prints"].map(len) > 0]
            for size, some in pdf.groupby(pdf["prints"].map(len)):
                words = np.frombuffer(b"".join(some["prints"]), np.uint64).reshape(len(some), -1)
                own = np.zeros(len(some), _ENTRY)
                own["row"], own["check"] = some["row"], words[:, :2]
                out = {"t": [], "part": [], "own": []}
                for t, fp in enumerate(np.ascontiguousarray(words[:, 2:]).view(np.uint32).T):
                    own["fp"] = fp
                    top = fp.astype(np.uint64) >> np.uint64(32 - lead)
                    for flip in _masks(lead, HALF):  # each part that half of the radius reaches
                        own["left"] = HALF - int(flip).bit_count()
                        for part in np.unique(top ^ flip):
                            out["t"].append(t)
                            out["part"].append(int(part))
                            out["own"].append(own[top ^ flip == part].tobytes())
                yield pd.DataFrame(out)

    def meet(key, pdf):
        own = np.frombuffer(b"".join(pdf["own"]), _ENTRY)
        root = local_roots(*_met(own, 32 - lead), len(own))
        at = np.flatnonzero(np.bincount(root, minlength=len(own))[root] > 1)
        return pd.DataFrame({"t": key[0], "part": key[1], "root": own["row"][root[at]], "row": own["row"][at]})

    dealt = one.select("row", "prints").mapInPandas(deal, "t int, part int, own binary")
    return dealt.groupBy("t", "part").applyInPandas(meet, "t int, part int, root long, row long").select("row", F.xxhash64("t", "part", "root").alias("h"))


def alike(a: pd.Series, b: pd.Series | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets that are alike: within a, or between a and b, which is then numbered on from a."""
    sets = [*a, *(b if b is not None else ())]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], sizes.cumsum()[:-1]))
    own, ids = np.unique(np.concatenate(sets), return_inverse=True)
    found, marked = [], np.zeros(len(own), np.int64)
    for i in range(len(a)):
        first = len(a) if b is not None else i + 1
        if first == len(sets):
            break
        mine = ids[starts[i] : starts[i] + sizes[i]]
        marked[mine] = 1
        both = np.add.reduceat(marked[ids[starts[first] :]], starts[first:] - starts[first])
        marked[mine] = 0
        near = first + np.flatnonzero(both >= similarity * (sizes[i] + sizes[first:] - both) - 1e-9)
        found.append(np.stack((np.full(len(near), i), near)))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sketches(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """(row, doc_id, same, n, prints): digest and size of each row's set, and its fingerprints."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([prints(s, similarity) for s in sets], pa.binary()),
                ],
                ["row", "doc_id", "same", "n", "prints"],
            )

    return rows.mapInArrow(run, "row long, doc_id long, same string, n long, prints binary")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(row, g): the set of each row."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["row", "g"])

    return rows.select("_row", "text").mapInArrow(run, "row long, g array<long>")


def _laid(members: DataFrame) -> DataFrame:
    """(root, block, row, n): members (root, row, n) in blocks of BLOCK rows of a root, by size."""
    laid = ranked(members.select("root", "row", "n"), "root", [F.col("n").asc(), F.col("row").asc()])
    return stage(laid.select("root", F.floor((F.col("rank") - 1) / BLOCK).alias("block"), "row", "n"), "laid")


def _near_units(laid: DataFrame) -> DataFrame:
    """(root, i, j): each block with itself and with the next."""
    blocks = laid.select("root", F.col("block").alias("j")).distinct()
    return blocks.select("root", F.col("j").alias("i"), F.explode(F.array("j", F.col("j") + 1)).alias("j")).join(blocks, ["root", "j"])


def _counted(held: np.ndarray) -> np.ndarray:
    """One _HELD for each shingle and kin, in order."""
    held = held[np.lexsort((held["kin"], held["token"]))]
    starts = np.flatnonzero(np.concatenate((held[:1] == held[:1], (held["token"][1:] != held["token"][:-1]) | (held["kin"][1:] != held["kin"][:-1]))))
    out = held[starts]
    if len(out):
        out["n"] = np.add.reduceat(held["n"], starts)
    return out


def _shared(held: np.ndarray) -> np.ndarray:
    """One _COUNT for each shingle that several kins hold, in order."""
    held = _counted(held)
    held = held[np.lexsort((held["n"], held["token"]))]  # of a shingle's kins the one that holds it most comes last
    last = np.flatnonzero(np.concatenate((held["token"][1:] != held["token"][:-1], held[:1] == held[:1])))
    out = np.zeros(len(last), _COUNT)
    if len(out):
        out["token"], out["kin"] = held["token"][last], held["kin"][last]
        out["n"] = np.add.reduceat(held["n"].astype(np.int64), np.concatenate(([0], last[:-1] + 1)))
        out["odd"] = out["n"] - held["n"][last]
    return out[out["odd"] > 0]


def _first_places(row: int, kin: int, g: np.ndarray, shared: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shared shingles among the first of a set, and their numbers in ``shared``."""
    n, at = len(g), np.searchsorted(shared["token"], g)
    at[at == len(shared)] = 0
    known = shared["token"][at] == g
    cost = np.where(known, shared["odd"][at].astype(float) * shared["n"][at], 0)
    first = np.lexsort((g, cost))[: n - int(np.ceil(similarity * n - 1e-6)) + 1]
    index = n - int(np.ceil(2 * similarity / (1 + similarity) * n - 1e-6)) + 1
    found = np.flatnonzero(known[first])
    out, at = np.zeros(len(found), _PLACE), at[first[found]]
    out["token"], out["row"], out["kin"], out["n"], out["at"] = g[first[found]], row, kin, n, found + 1
    out["role"] = _INDEX * (found < index)
    return out, at


def _cells(places: np.ndarray, of: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places, given roles and copied to each cell of their shingle, and the cells. A shingle's texts outside its main kin meet all
    of its texts; a side of over ``most`` is cut, and a cell has one part of each."""
    down, across = 1 + of["odd"] // most, 1 + of["n"] // most
    odd, one = places["kin"] != of["kin"], down * across == 1
    out, cells = [places[one]], [np.zeros(one.sum(), np.int64)]
    out[0]["role"] += np.where(odd[one], _ODD_ONE + _ANY, _ANY).astype(np.uint8)
    for role, some, copies in ((_ODD_ONE, ~one & odd, across), (_ANY, ~one, down)):
        at = np.repeat(np.flatnonzero(some), copies[some])
        k = np.arange(len(at)) - np.repeat(np.cumsum(copies[some]) - copies[some], copies[some])
        i, j = (places["row"][at] % down[at], k) if role == _ODD_ONE else (k, places["row"][at] % across[at])
        out.append(places[at])
        out[-1]["role"] += np.uint8(role)
        cells.append(1 + i * across[at] + j)
    return np.concatenate(out), np.concatenate(cells)


def _bounded(own: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs of places of one shingle, one outside its main kin, whose texts are of different kins and may be alike."""
    own = own[np.lexsort((own["n"], own["token"]))]
    rows, row = np.unique(own["row"], return_inverse=True)
    share, found, size = similarity / (1 + similarity), [np.zeros(0, np.int64)], 0

    def keep(i, j):
        nonlocal size
        x, y = own[i], own[j]
        least, most = np.minimum(x["n"], y["n"]), np.maximum(x["n"], y["n"])
        index = (x["n"] == least) & (x["role"] & _INDEX > 0) | (y["n"] == least) & (y["role"] & _INDEX > 0)
        most_shared = 1 + np.minimum(x["n"] - x["at"], y["n"] - y["at"])
        ok = index & (x["kin"] != y["kin"]) & (least >= similarity * most - 1e-6) & (most_shared >= share * (least + most) - 1e-6)
        i, j = np.broadcast_arrays(row[i], row[j])
        found.append(np.minimum(i, j)[ok] * len(rows) + np.maximum(i, j)[ok])
        size += len(found[-1])
        if size > VARIANTS:
            found[:] = [np.unique(np.concatenate(found))]
            size = 0

    starts = np.flatnonzero(np.concatenate((own[:1] == own[:1], own["token"][1:] != own["token"][:-1])))
    ends = np.append(starts[1:], len(own))
    few = np.repeat(ends - starts <= CROWD, ends - starts)
    for k in range(1, CROWD):
        i = np.flatnonzero(few[k:] & (own["token"][k:] == own["token"][:-k]))
        x, y = own["role"][i], own["role"][i + k]
        meet = (x & _ODD_ONE > 0) & (y & _ANY > 0) | (y & _ODD_ONE > 0) & (x & _ANY > 0)
        keep(i[meet], i[meet] + k)
    for s, e in zip(starts, ends, strict=True):
        if e - s > CROWD:
            role = own["role"][s:e]
            odd, any_ = s + np.flatnonzero(role & _ODD_ONE), s + np.flatnonzero(role & _ANY)
            step = max(1, PAIRS // max(1, len(any_)))
            for at in range(0, len(odd), step):  # either side lies by size, so those that sizes allow are a run
                i, n = odd[at : at + step], own["n"][any_]
                low, high = similarity * own["n"][i[0]] - 1e-6, own["n"][i[-1]] / similarity + 1e-6
                keep(i[:, None], any_[np.searchsorted(n, low) : np.searchsorted(n, high, "right")][None, :])
    pairs = np.unique(np.concatenate(found))
    return rows[pairs // max(1, len(rows))], rows[pairs % max(1, len(rows))]


def _open_pairs(held: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of texts of a group and of different kins, all that are alike among them; held: (root, block, row, kin, total, g)."""

    def count(key, pdf):
        own = np.zeros(pdf["g"].map(len).sum(), _HELD)
        own["token"], own["n"] = np.concatenate(list(pdf["g"])).view(np.uint64), 1
        own["kin"] = np.repeat(pdf["kin"], pdf["g"].map(len))
        own = _counted(own)
        parts = dealt(own["token"], bits_of(int(pdf["total"].iloc[0]), TOKENS))
        return pd.DataFrame({"root": key[0], "block": key[1], "part": [p for p, _, _ in parts], "own": [own[s:e].tobytes() for _, s, e in parts]})

    def spread(key, pdf):  # to each block the counts of the whole group for what it holds
        each = [np.frombuffer(o, _HELD) for o in pdf["own"]]
        shared, out = _shared(np.concatenate(each)), []
        for own in each:
            at = np.searchsorted(shared["token"], own["token"])
            at = at[at < len(shared)]
            out.append(shared[np.unique(at[shared["token"][at] == own["token"][: len(at)]])].tobytes())
        return pd.DataFrame({"root": key[0], "block": pdf["block"], "shared": out})

    def place(key, pdf, marks):
        shared = np.frombuffer(b"".join(marks["shared"]), _COUNT)
        shared = shared[np.argsort(shared["token"])]
        out = {"root": [], "part": [], "cell": [], "own": []}
        if len(shared) and len(pdf):
            bits = bits_of(int(pdf["total"].iloc[0]), TOKENS)
            found = [_first_places(r, k, g.view(np.uint64), shared, similarity) for r, k, g in zip(pdf["row"], pdf["kin"], pdf["g"], strict=True)]
            own, cell = _cells(np.concatenate([f[0] for f in found]), shared[np.concatenate([f[1] for f in found])], PLACES)
            order = np.lexsort((own["token"], cell))
            own, cell = own[order], cell[order]
            ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
            for first, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                for part, s, e in dealt(own["token"][first:end], bits):
                    out["part"].append(part)
                    out["cell"].append(int(cell[first]))
                    out["own"].append(own[first + s : first + e].tobytes())
            out["root"] = [key[0]] * len(out["part"])
        return pd.DataFrame(out)

    def meet(key, pdf):
        a, b = _bounded(np.frombuffer(b"".join(pdf["own"]), _PLACE), similarity)
        return pd.DataFrame({"a": a, "b": b})

    counted = held.select("root", "block", "kin", "total", "g").groupBy("root", "block").applyInPandas(count, "root long, block long, part int, own binary")
    shared = counted.groupBy("root", "part").applyInPandas(spread, "root long, block long, shared binary")
    placed = held.groupBy("root", "block").cogroup(shared.groupBy("root", "block"))
    placed = placed.applyInPandas(place, "root long, part int, cell long, own binary")
    return placed.groupBy("root", "part", "cell").applyInPandas(meet, "a long, b long").distinct()


def _alike(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """(a, b): those of the pairs whose whole sets are alike."""
    sides = [own.select(F.col("row").alias(c), F.col("g").alias(f"g_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("both", F.size(F.array_intersect("g_a", "g_b")))
    return both.where(F.col("both") >= similarity * (F.size("g_a") + F.size("g_b") - F.col("both")) - 1e-9).select("a", "b")


def _verified(units: DataFrame, laid: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a chain through every set of rows that alike pairs of a unit link."""
    dealt = units.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    held = dealt.join(laid, ["root", "block"]).join(own, "row")

    def verify(key, pdf):
        left, right = pdf[pdf["block"] == key[1]], pdf[pdf["block"] == key[2]]
        pair = key[1] != key[2]
        ids = np.concatenate((left["row"], right["row"])) if pair else left["row"].to_numpy()
        a, b = alike(left["g"], right["g"] if pair else None, similarity)
        root = local_roots(a, b, len(ids))
        at = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[root[at]], "b": ids[at]})

    return stage(held.select("root", "i", "j", "block", "row", "g").groupBy("root", "i", "j").applyInPandas(verify, "a long, b long"), "links")


def links(rows: DataFrame, sketches: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b) over row numbers: a chain through every set of rows that alike pairs link."""
    one = stage(sketches.groupBy("same").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min_by("prints", "row").alias("prints")), "sets")
    twins = sketches.select("same", F.col("row").alias("b")).join(one.select("same", F.col("row").alias("a")), "same").where("a <> b").select("a", "b")
    keyed = stage(_keys(one), "keyed")
    lead = keyed.groupBy("h").agg(F.min("row").alias("a")).select(afresh(F.col("h")).alias("h"), "a")
    groups = connected_components(keyed.join(lead, "h").where("a <> row").select("a", F.col("row").alias("b")))
    members = groups.select(F.col("node").alias("row"), "root").union(groups.select("root", "root").distinct())
    laid = _laid(members.join(one.select("row", "n"), "row"))
    own = stage(_sets(rows.join(laid.select(F.col("row").alias("_row")), "_row", "left_semi"), words), "members")
    near = _verified(_near_units(laid), laid, own, similarity)

    # A group of one block is done. In the others what is linked by now is one kin, and pairs of different kins are left to verify.
    large = laid.where("block > 0").select("root").distinct()
    wide = laid.join(large, "root", "left_semi")
    kin = connected_components(near.join(wide.select(F.col("row").alias("a")), "a", "left_semi")).select(F.col("node").alias("row"), F.col("root").alias("kin"))
    total = wide.groupBy("root").agg(F.sum("n").alias("total")).select(afresh(F.col("root")).alias("root"), "total")
    known = wide.join(kin, "row", "left").join(total, "root").withColumn("kin", F.coalesce("kin", "row"))
    held = stage(known.join(own, "row").select("root", "block", "row", "kin", "total", "g"), "held")
    pairs = stage(_open_pairs(held, similarity), "pairs")
    return near.union(stage(_alike(pairs, held, similarity), "links")).union(twins)


def near_dedup(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """docs with one row of each group that pairs of texts alike to ``similarity`` chain together."""
    small_batches(docs.sparkSession)
    rows, row = numbered(docs)
    doc_id, text = columns(rows, "doc_id", "text")
    slim = rows.select(F.col(row).alias("_row"), doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    with recorded() as made:
        sketches = stage(_sketches(slim, similarity, words), "sketches")
        groups = connected_components(links(slim, sketches, similarity, words))
        members = groups.select(F.col("node").alias("row"), "root").union(groups.select("root", "root").distinct())
        members = stage(members.join(sketches.select("row", "doc_id"), "row"), "groups")
        for own in [t for t in made.values() if t is not members]:
            unstage(own)
    stays = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("s")).select("s.row")
    gone = members.join(stays, "row", "left_anti").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)
