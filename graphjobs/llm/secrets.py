"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern names.

Three patterns give the base spans. The battery tests every run of 20 or more signs of an encoding, letters alone included, as
draws from each alphabet that holds all its signs (hexadecimal, base32 and base36 of either case, base62, base64): chi-squared
for uniformity, runs above and below the middle symbol, and serial correlation, combined by Fisher's method. A string is drawn
from one of the alphabets or from none, so its p-value is the greatest of theirs, which needs no correction for the choice.

False discoveries are controlled twice, over all strings tested, with weights in proportion to length that average 1 over
them: longer strings tell more. First Benjamini and Hochberg's step-up rule on the weighted p-values finds the strings that aren't
random: at most MISS of those set aside are random by chance. Then ordinary identifiers that pass are told from secrets by
a likelihood ratio, uniform symbols (an even mixture of the alphabets) against a chain over letter case, digits and signs that
seldom switches and whose letters are as frequent as in prose. Under that chain the ratio averages 1 at most, so it is an e-value, as it is when set to 0 for those set aside, and
the step-up rule on weighted e-values bounds the share of ordinary strings among the added spans by FDR.

DataFrame functions only. Spans are in code points, the end exclusive. Defined cases: a null text counts as empty and has no
spans; rows repeat as they stand; other columns are ignored. The rule depends on all documents, so added spans may differ
between corpora; base spans depend on their text alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, stage

#: The base patterns, and the shortest match or value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Symbols of each encoding by value; - and _ stand for + and /.
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "hex upper": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base32 lower": _LOWER + "234567",
    "base36": _DIGITS + _LOWER, "base36 upper": _DIGITS + _UPPER, "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/",
}
#: An ordinary string's steps from lower case, upper case, digits or signs (rows) to each of them.
STEPS = ((0.90, 0.04, 0.02, 0.04), (0.50, 0.44, 0.02, 0.04), (0.05, 0.05, 0.80, 0.10), (0.50, 0.20, 0.25, 0.05))
#: Shares of a to z in English text, in percent; they serve other languages in Latin letters nearly as well.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Share of ordinary strings among the added spans; share of random ones among those that the battery sets aside.
FDR, MISS = 0.001, 0.001
_CELLS = 3000

#: Matches of a text that are folded into one list.
RUN = 256

_SPAN = "array<struct<start:int,kind:int,end:int,own:string>>"


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Leftmost non-overlapping matches as spans. Each match is read with the gap before it, from where the last ended."""
    from_last = r"\G([\s\S]*?)(" + pattern + ")"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(from_last), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(from_last), F.lit(2)).alias("own"))
    empty = F.from_json(F.lit("[]"), _SPAN)

    def add(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["own"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["own"].alias("own"))
        good = F.lit(True) if keep is None else keep(pair["own"])
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def fold(all_pairs):
        # a fold that appends to one list costs the square of its length, so runs of matches have lists of their own
        def run(acc, i):
            inner = F.aggregate(F.slice(all_pairs, i * RUN + 1, F.lit(RUN)), F.struct(acc["at"].alias("at"), empty.alias("spans")), add)
            return F.transform(F.array(inner), lambda own: F.struct(own["at"].alias("at"), F.concat(acc["runs"], F.array(own["spans"])).alias("runs")))[0]

        first = F.struct(F.lit(0).alias("at"), F.array(empty).alias("runs"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor(F.size(all_pairs) / RUN).cast("int")), first, run)["runs"])

    found = F.get(F.transform(F.array(pairs), fold), F.lit(0))
    return F.when(text.rlike(pattern), found).otherwise(empty).cast(_SPAN)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans of the three patterns; a match that is too short is used up but dropped."""
    long_value = lambda own: F.length(F.regexp_extract(own, ASSIGN, 2)) >= ASSIGN_LEAST
    return _matches(text, ASSIGN, 0, long_value), _matches(text, ACCESS, 1), _matches(text, HEX, 2)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _two_sided(z: Column) -> Column:
    """The chance of a standard normal beyond ±z (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.lit(1e-300), poly * F.exp(-x * x))


def tested(candidates: DataFrame) -> DataFrame:
    """(row, s, n, encoding, p_random, log_e) of candidates (row, s: a span with its string as ``own``): the battery's p-value,
    the encoding that gives it, and the log likelihood ratio against ordinary strings."""
    bare = F.regexp_replace("s.own", "=+$", "")
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("encoding"), F.lit(a).alias("alphabet")) for k, a in ALPHABETS.items()])).alias("e")
    df = candidates.select("row", "s", bare.alias("bare"), F.translate(bare, "-_", "+/").alias("plain"), named).select("row", "s", "bare", "plain", "e.*")
    df = df.where(F.expr("plain rlike concat('^[', alphabet, ']+$')"))
    df = df.withColumn("x", F.transform(F.split("plain", ""), lambda c: F.instr(F.col("alphabet"), c) - 1))
    df = df.withColumn("c", F.transform(F.split("bare", ""), lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)))
    df = df.withColumn("n", F.size("x").cast("double")).withColumn("m", F.length("alphabet").cast("double"))
    pairs = lambda name: F.arrays_zip(F.slice(name, F.lit(1), F.size(name) - 1).alias("a"), F.slice(name, F.lit(2), F.size(name) - 1).alias("b"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v).cast("double"))
    n, m = F.col("n"), F.col("m")
    squares = total(F.split("alphabet", ""), lambda s: F.pow(n - F.length(F.replace(F.col("plain"), s, F.lit(""))), 2))
    chi, k = squares * m / n - n, m - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / k) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    high = total("x", lambda v: (v >= m / 2).cast("int"))
    runs = 1 + total(pairs("x"), lambda p: ((p["a"] >= m / 2) != (p["b"] >= m / 2)).cast("int"))
    both = 2 * F.col("high") * (n - F.col("high"))
    spread = F.sqrt(F.greatest(F.lit(1e-9), both * (both - n) / (n * n * (n - 1.0))))
    z_runs = (F.col("runs") - (both / n + 1)) / spread
    mid, var = (m - 1) / 2, (m * m - 1) / 12
    z_serial = total(pairs("x"), lambda p: (p["a"] - mid) * (p["b"] - mid)) / (var * F.sqrt(n - 1.0))
    df = df.withColumn("high", high).withColumn("runs", runs).withColumn("z", F.array(z_chi, z_runs, z_serial))
    df = df.withColumn("fisher", -2 * total("z", lambda z: F.log(_two_sided(z))))
    half = F.col("fisher") / 2
    p = F.exp(-half) * (1 + half + half * half / 2)  # chi-squared with six degrees of freedom
    # the first sign, then each step: to its class, and to the sign within the class
    steps = F.array(*[F.array(*[F.lit(math.log(p)) for p in row]) for row in STEPS])
    letters = F.array(*[F.lit(math.log(p / sum(LETTERS))) for p in LETTERS])
    sign = F.transform(F.split(F.lower("bare"), ""), lambda c: F.when(c.rlike("[a-z]"), F.element_at(letters, F.ascii(c) - 96)).when(c.rlike("[0-9]"), -math.log(10)).otherwise(-math.log(4)))
    ordinary = -F.lit(math.log(4)) + total(sign, lambda v: v) + total(pairs("c"), lambda p: F.get(F.get(steps, p["a"]), p["b"]))
    each = df.select("row", "s", "n", "encoding", "m", p.alias("p"), ordinary.alias("ordinary"))
    best = each.groupBy("row", "s").agg(F.first("n").alias("n"), F.max_by("encoding", F.struct("p", -F.col("m"), "encoding")).alias("encoding"), F.max("p").alias("p_random"), F.min("m").alias("m"), F.first("ordinary").alias("ordinary"))
    # the mixture is at least the densest alphabet's share of it
    log_e = -F.col("n") * F.log(F.col("m").cast("double")) - math.log(len(ALPHABETS)) - F.col("ordinary")
    return best.select("row", "s", "n", "encoding", "p_random", log_e.alias("log_e"))


def _cells(evidence: Column) -> Column:
    """Natural logs of weighted evidence in tenths of a power of ten, rounded down and from 0 to _CELLS."""
    return F.least(F.lit(_CELLS), F.greatest(F.lit(0), F.floor(evidence / math.log(10) * 10))).cast("int")


def _cut(cells: DataFrame, level: float) -> int:
    """The least cell that the step-up rule takes; beyond all where it takes none. cells: (cell, n), at most _CELLS of them."""
    whole, above = Window.partitionBy(), Window.orderBy(F.desc("cell"))
    held = cells.withColumn("upto", F.sum("n").over(above)).withColumn("all", F.sum("n").over(whole))
    fits = F.pow(F.lit(10.0), -F.col("cell") / 10.0) <= F.col("upto") * level / F.col("all")
    found = held.where(fits).agg(F.min("cell")).first()[0]
    return _CELLS + 1 if found is None else found


def step_up(each: DataFrame) -> DataFrame:
    """each (n, p_random, log_e and more) with ``aside`` and ``secret``, by both rules over all its rows."""
    mean = each.agg(F.avg("n")).first()[0] or 1.0
    weight = F.log(F.col("n") / mean)
    count = lambda df: df.groupBy("cell").agg(F.count("*").alias("n"))
    odd = each.withColumn("cell", _cells(weight - F.log(F.greatest("p_random", F.lit(1e-300)))))
    odd = odd.withColumn("aside", F.col("cell") >= _cut(count(odd), MISS))
    told = odd.withColumn("cell", F.when(F.col("aside"), 0).otherwise(_cells(weight + F.col("log_e"))))
    return told.withColumn("secret", F.col("cell") >= _cut(count(told), FDR)).drop("cell")


def _alone(found: DataFrame) -> DataFrame:
    """(row, s): the spans of odd that no span of base meets; found: (row, base, odd). In order of where candidates end and
    base spans start, a candidate meets one before it that ends beyond its start."""
    base = found.select("row", F.explode("base").alias("b")).select("row", F.col("b.start").alias("at"), F.lit(1).alias("is_base"), F.col("b.end").alias("end"), F.lit(None).cast(_SPAN[6:-1]).alias("s"))
    odd = found.select("row", F.explode("odd").alias("s")).select("row", F.col("s.end").alias("at"), F.lit(0).alias("is_base"), F.lit(None).cast("int").alias("end"), "s")
    before = Window.partitionBy("row").orderBy("at", "is_base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = base.unionByName(odd).withColumn("reach", F.max("end").over(before))
    return met.where((F.col("is_base") == 0) & (F.col("reach").isNull() | (F.col("reach") <= F.col("s.start")))).select("row", "s")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans, n_assign, n_access, n_hex): base and all spans of each row's text, as arrays of
    (start, kind, end, own); kind: a place in KINDS."""
    doc_id, text = columns(docs, "doc_id", "text")
    text = F.coalesce(text.cast("string"), F.lit(""))
    assign, access, hexes = base_spans(text)
    odd = _matches(text, CANDIDATE, 3, lambda own: own.rlike("[A-Za-z0-9]"))
    found = docs.select(doc_id.alias("doc_id"), assign.alias("assign"), access.alias("access"), hexes.alias("hex"), odd.alias("odd"))
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "spans")
    base = F.concat("assign", "access", "hex")
    each = stage(tested(_alone(found.where(F.size("odd") > 0).select("row", base.alias("base"), "odd"))), "tested")
    secret = step_up(each).where("secret")
    added = secret.groupBy("row").agg(F.collect_list("s").alias("added"))  # spans of one text
    out = found.join(added, "row", "left").withColumn("base", base)
    spans = F.concat("base", F.coalesce("added", F.from_json(F.lit("[]"), _SPAN)))
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return out.select("doc_id", "base", F.array_sort(spans).alias("spans"), count("assign"), count("access"), count("hex"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs."""
    found = scan(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
