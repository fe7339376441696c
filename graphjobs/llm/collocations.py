"""Phrase collocations from an FM-index a shard.

A partition's documents are cut into shards of about ``SHARD`` words; a shard holds its words as numbers of a vocabulary of its
own, kept by language. Words are counted over all shards; those below ``least`` can be in no candidate and end a phrase
like a separator. Each shard is then indexed in both directions: rows sorted by their next words as far as phrases go, with
the words before them (the Burrows-Wheeler transform) and the way back to those words. An interval of rows stands for a
phrase; extending it by every word that stands before, or behind, gives the intervals and counts of all longer phrases at
once. Words are extended to the right, and the pairs that are frequent over all shards to the left.

Pair counts travel as sorted runs by hash range; each range adds the runs of all shards and tells each shard, by a bit a pair,
which are frequent. So triples are only counted where both their pairs are frequent, which loses none. Scores are exact
(decimals of 38 digits); a product beyond them is an error, not a rounded number.

Defined cases: a null text counts as empty, a null lang as ``und`` (together with that name). A-Z alone are lower-cased.
Repeated rows count again, and ids aren't read. Other columns are ignored. No words give no rows. A task holds one shard, or
one document where that is longer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import afresh, bits_of, columns, dealt, ranked, small_batches, stage, unstage

LEAST, TOP, SHARD = 10, 2000, 1 << 19
#: Words of a phrase at most, so the depth to which an index is sorted.
DEPTH = 3
#: Pairs that a hash range is to hold.
RANGE = 1 << 20

_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


class _Words(dict):
    """A number for each word met, from a count that the languages of a shard share."""

    def __init__(self, lang: str, names: list):
        super().__init__({b"": -1, b"\n": 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = len(self.names)
        return len(self.names)


class FMIndex:
    """Both directions of a sequence of word numbers in which 0 ends a phrase, for phrases of ``DEPTH`` words at most.

    Rows with the same next ``DEPTH`` words stand in any order, which no interval of a phrase that short can see."""

    def __init__(self, words: np.ndarray):
        framed = np.concatenate(([0], words, [0])).astype(np.int32)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(framed))))
        self.before, self.back = self._side(framed)
        self.behind, self.back_r = self._side(framed[::-1])

    @staticmethod
    def _side(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each row, and the row of the suffix that starts with it (backward steps)."""
        wide = int(seq.max()) + 1
        if wide**DEPTH < 2**63:
            key = np.zeros(len(seq), np.int64)
            for i in range(DEPTH):
                key *= wide
                key[: len(seq) - i] += seq[i:]
            order = np.argsort(key)
        else:
            order = np.lexsort([np.concatenate((seq[i:], np.zeros(i, np.int32))) for i in range(DEPTH)][::-1])
        before = seq[order - 1]
        back = np.empty(len(seq), np.int64)
        back[np.argsort(before, kind="stable")] = np.arange(len(seq))
        return before, back

    def words(self) -> tuple[np.ndarray, ...]:
        """(phrases, lo, lo_r, n): each word with its interval in both directions."""
        n = np.diff(self.start)
        held = np.flatnonzero(n[1:]) + 1
        return held[:, None], self.start[held], self.start[held], n[held]

    @staticmethod
    def _extend(side, back, lo, other, n):
        """Every interval by every word on that side: (parent, word, new lo, new other lo, count)."""
        of = np.repeat(np.arange(len(n)), n)
        row = np.arange(len(of)) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        wide = int(side.max(initial=0)) + 1
        key, first, count = np.unique(of * wide + side[row], return_index=True, return_counts=True)
        parent, word = key // wide, key % wide
        # on the other side the words stand in order, each as often as it was met
        smaller = np.cumsum(count) - count
        begin = np.searchsorted(parent, np.arange(len(n)))
        inner = smaller - smaller[begin[parent]] if len(parent) else smaller
        real = word > 0
        return parent[real], word[real], back[row[first[real]]], (other[parent] + inner)[real], count[real]

    def left(self, phrases, lo, lo_r, n):
        parent, word, lo, lo_r, n = self._extend(self.before, self.back, lo, lo_r, n)
        return np.column_stack((word, phrases[parent])), lo, lo_r, n

    def right(self, phrases, lo, lo_r, n):
        parent, word, lo_r, lo, n = self._extend(self.behind, self.back_r, lo_r, lo, n)
        return np.column_stack((phrases[parent], word)), lo, lo_r, n


def tokenised(pdfs, size: int = SHARD):
    """Shards of a partition's (lang, text bytes)."""
    made, names, langs, parts, n = 0, [], {}, [], 0

    def flush():
        nonlocal made, names, langs, parts, n
        words = np.concatenate(parts)
        counts = np.bincount(words, minlength=len(names) + 1)[1:]
        shard = TaskContext.get().partitionId() << 33 | made
        made, own = made + 1, names
        names, langs, parts, n = [], {}, [], 0
        return pd.DataFrame({"shard": [shard], "words": [words.tobytes()], "langs": [[lang for lang, _ in own]], "spelt": [[word for _, word in own]], "counts": [counts]})

    for pdf in pdfs:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            own = langs.get(lang)
            if own is None:
                own = langs[lang] = _Words(lang, names)
            found = text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
            words = np.fromiter(map(own.__getitem__, found), np.int32, len(found))
            parts += [words[words >= 0], np.zeros(1, np.int32)]
            n += len(parts[-2])
            if n >= size:
                yield flush()
    if n:
        yield flush()


def _vocabulary(shards: DataFrame) -> DataFrame:
    """(shard, at, lang, word, n) of each shard's words."""
    own = F.posexplode(F.arrays_zip("langs", "spelt", "counts")).alias("i", "w")
    return shards.select("shard", own).select("shard", (F.col("i") + 1).alias("at"), F.col("w.langs").alias("lang"), F.col("w.spelt").alias("word"), F.col("w.counts").alias("n"))


def _densely(df: DataFrame, label: str) -> DataFrame:
    """df, staged, with numbers from 1 without gaps as ``id``."""
    laid = stage(df.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    return laid.withColumn("_part", part).join(base, "_part").select(*df.columns, (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("id"))


def _coded(shards: DataFrame, words: DataFrame) -> DataFrame:
    """(shard, ids, words): each shard's words as places in its list of frequent words' ids, 0 for the others."""
    known = _vocabulary(shards).join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy(afresh(F.col("shard")).alias("shard"))
    known = known.agg(F.collect_list(F.struct("at", "id")).alias("known")).select("shard", "known.at", "known.id")

    def code(pdfs):
        for pdf in pdfs:
            for shard, raw, at, ids in zip(pdf["shard"], pdf["words"], pdf["at"], pdf["id"], strict=True):
                own, words = np.argsort(ids), np.frombuffer(raw, np.int32)
                place = np.zeros(int(words.max()) + 1, np.int32)  # every known word occurs
                place[at[own]] = np.arange(1, len(ids) + 1)
                yield pd.DataFrame({"shard": [shard], "ids": [ids[own].tobytes()], "words": [place[words].tobytes()]})

    met = shards.select("shard", "words").hint("merge").join(known, "shard")
    return stage(met.mapInPandas(code, "shard long, ids binary, words binary"), "coded", shards)


def _pairs(raw_ids: bytes, raw_words: bytes):
    """A shard's index, its ids, its pairs in order of their hash, and their hashes and keys (first id, second id)."""
    ids, index = np.frombuffer(raw_ids, np.int64), FMIndex(np.frombuffer(raw_words, np.int32))
    pairs = index.right(*index.words())
    phrases = pairs[0]
    key = (ids[phrases[:, 0] - 1] << 32 | ids[phrases[:, 1] - 1]) if len(phrases) else np.zeros(0, np.int64)
    mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # odd: one hash a key
    order = np.argsort(mixed)
    return index, ids, [p[order] for p in pairs], mixed[order], key[order]


def _frequent(coded: DataFrame, bits: int, least: int) -> DataFrame:
    """Two kinds of rows, staged: (key, n) of each pair that occurs ``least`` times, and (shard, part, held): a bit for each of
    the shard's pairs in that hash range, set for the frequent ones."""

    def deal(pdfs):
        for pdf in pdfs:
            for shard, ids, words in zip(pdf["shard"], pdf["ids"], pdf["words"], strict=True):
                _, _, pairs, mixed, key = _pairs(ids, words)
                cuts = dealt(mixed, bits)
                count = pairs[3].astype(np.int32)
                yield pd.DataFrame({"shard": shard, "part": [p for p, _, _ in cuts], "keys": [key[s:e].tobytes() for _, s, e in cuts], "counts": [count[s:e].tobytes() for _, s, e in cuts]})

    def add(pdf):
        keys = [np.frombuffer(k, np.int64) for k in pdf["keys"]]
        own, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, np.concatenate([np.frombuffer(c, np.int32) for c in pdf["counts"]]))
        ends = np.cumsum([len(k) for k in keys])
        held = [np.packbits(total[at[e - len(k) : e]] >= least).tobytes() for k, e in zip(keys, ends, strict=True)]
        told = pd.DataFrame({"shard": pdf["shard"], "part": pdf["part"], "held": held})
        frequent = total >= least
        return pd.concat((told, pd.DataFrame({"key": own[frequent], "n": total[frequent]})), ignore_index=True).astype({"shard": "Int64", "part": "Int64", "key": "Int64", "n": "Int64"})[["shard", "part", "held", "key", "n"]].replace({np.nan: None})

    runs = coded.mapInPandas(deal, "shard long, part long, keys binary, counts binary")
    return stage(runs.groupBy("part").applyInPandas(add, "shard long, part long, held binary, key long, n long"), "pairs")


def _triples(coded: DataFrame, told: DataFrame, bits: int, least: int) -> DataFrame:
    """(ab, bc, n) of each triple of words that occurs ``least`` times."""
    known = told.groupBy(afresh(F.col("shard")).alias("shard")).agg(F.collect_list(F.struct("part", "held")).alias("told"))

    def extend(pdfs):
        for pdf in pdfs:
            for raw_ids, words, told in zip(pdf["ids"], pdf["words"], pdf["told"], strict=True):
                index, ids, pairs, mixed, key = _pairs(raw_ids, words)
                by_part, held = {t["part"]: t["held"] for t in told}, np.zeros(len(key), bool)
                for p, s, e in dealt(mixed, bits):
                    held[s:e] = np.unpackbits(np.frombuffer(by_part[p], np.uint8), count=e - s)
                frequent = np.sort(key[held])
                phrases, _, _, n = index.left(*[p[held] for p in pairs])
                if not len(n):
                    continue
                a, b, c = (ids[phrases[:, i] - 1] for i in range(3))
                ab = a << 32 | b
                real = frequent[np.minimum(np.searchsorted(frequent, ab), len(frequent) - 1)] == ab
                yield pd.DataFrame({"ab": ab[real], "bc": (b << 32 | c)[real], "n": n[real]})

    met = coded.hint("merge").join(known, "shard")
    each = met.mapInPandas(extend, "ab long, bc long, n long")
    return stage(each.groupBy("ab", "bc").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "triples")


def _scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(ids, a, l, r, score) of the candidates that no longer one takes the place of."""
    one, two = words.select("id", F.col("f").alias("f")), pairs.select(F.col("key"), F.col("n").alias("f"))
    first, second = F.shiftright("key", 32), F.col("key").bitwiseAND((1 << 32) - 1)

    def f_of(df, table, at, on, name):
        return df.join(table.select(F.col(on).alias(at), F.col("f").alias(name)), at)

    def score(left, right):
        wide = [F.col(c).cast("decimal(38,0)") for c in ("a", "a", left, right)]
        return F.call_function("div", F.lit(1000000).cast("decimal(38,0)") * wide[0] * wide[1], wide[2] * wide[3])

    inside = triples.select(F.explode(F.array("ab", "bc")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))
    left = pairs.join(inside.select(afresh(F.col("key")).alias("key"), "longer"), "key", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * 50))
    left = left.select(first.alias("w1"), second.alias("w2"), F.col("n").alias("a"))
    left = f_of(f_of(left, one, "w1", "id", "l"), one, "w2", "id", "r")
    of_two = left.select(F.array("w1", "w2").alias("ids"), "a", "l", "r", score("l", "r").alias("score"))

    right = triples.select("ab", "bc", F.shiftright("ab", 32).alias("w1"), F.col("bc").bitwiseAND((1 << 32) - 1).alias("w3"), F.col("n").alias("a"))
    for table, at, on, name in ((one, "w1", "id", "l1"), (two, "bc", "key", "r1"), (two, "ab", "key", "l2"), (one, "w3", "id", "r2")):
        right = f_of(right, table, at, on, name)
    right = right.withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
    low = F.col("s1") <= F.col("s2")  # ties go to the shorter first part
    ids = F.array("w1", F.col("ab").bitwiseAND((1 << 32) - 1), "w3")
    return of_two.union(right.select(ids, "a", F.when(low, F.col("l1")).otherwise(F.col("l2")), F.when(low, F.col("r1")).otherwise(F.col("r2")), F.least("s1", "s2")))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of two and three words."""
    small_batches(docs.sparkSession)
    text, lang = columns(docs, "text", "lang")
    given = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("text"))
    shards = stage(given.mapInPandas(lambda pdfs: tokenised(pdfs, shard), "shard long, words binary, langs array<string>, spelt array<binary>, counts array<long>"), "shards")
    counted = stage(_vocabulary(shards).groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = _densely(counted.where(F.col("f") >= least), "frequent")
    size, highest = counted.agg(F.sum("f")).first()[0] or 0, words.agg(F.max("id")).first()[0] or 0
    if highest >= 1 << 31:
        raise ValueError(f"{highest} frequent words: two of them don't fit a key of 64 bits")
    coded = _coded(shards, words)
    bits = bits_of(size, RANGE)
    found = _frequent(coded, bits, least)
    triples = _triples(coded, found.where("shard is not null").select("shard", "part", "held"), bits, least)
    unstage(coded)
    scored = stage(_scored(words, found.where("key is not null").select("key", "n"), triples), "scored", triples, found)

    named = scored.withColumn("c", F.monotonically_increasing_id())
    named = stage(named.join(words.select("id", "lang").withColumnRenamed("id", "first"), F.element_at("ids", 1) == F.col("first")).drop("first"), "langs", scored)
    # all that tie with the last one stay until the phrases are read
    placed = ranked(named, "lang", [F.desc("score"), F.desc("a")])
    last = placed.where(F.col("rank") == top).select("lang", F.struct("score", "a").alias("last"))
    near = placed.drop("rank").join(last, "lang", "left").where(F.col("last").isNull() | (F.struct("score", "a") >= F.col("last")))
    near = stage(near.drop("last"), "near", named)
    spelt = near.select("c", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("c")
    spelt = spelt.agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("parts"))
    whole = near.join(spelt.select(afresh(F.col("c")).alias("c"), F.concat_ws(" ", "parts.word").alias("phrase")), "c").join(totals, "lang")
    best = ranked(whole, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")]).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: Phrases by the words that follow one another in a piece.
ORACLE_SQL = f"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
lists AS MATERIALIZED (SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
words AS (SELECT lang, piece, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM lists),
runs AS MATERIALIZED (SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
one AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
two AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
three AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, concat_ws(' ', t.w1, t.w2) AS phrase, 1 AS cut, t.f AS a, x.f AS l, y.f AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  LEFT JOIN longer g ON g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2
  WHERE t.f >= {LEAST} AND (g.f IS NULL OR 100 * g.f < 50 * t.f)
  UNION ALL
  SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), 1, t.f, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), 2, t.f, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS s FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY s, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, s::BIGINT AS score
FROM lowest JOIN totals USING (lang) QUALIFY rank <= {TOP}"""
