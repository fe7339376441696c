"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document of a source is expected as often as the source's target divided by its size. The documents of a source are
laid out by size, the expected copies are summed up along that order, one random offset a source is added, and a document
is emitted once for each integer that the sum crosses at it. Ordered by size, neighbours stand in for each other, so a
source's taken words miss its target by less than its largest document. The sum is the rank times a constant, and ranks
come from a range shuffle with per-partition counts, so a source with a third of all rows is spread like the others.

Defined cases: a null text has size 0; a source without words has target 0 and gives nothing; null is a source of its own,
the last one. No documents give no rows. Rows of one source, size and doc_id are laid out by their place in the table; each
counts for itself. The offset depends on source name and seed alone, so reruns agree. Texts are read once for their sizes.
Other columns are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns, numbered, own_name, ranked, stage

#: Weights of the sources by code point, repeating.
WEIGHTS = (3, 1, 2)
#: All sources together give so many times the words there are; none gives more than CAP times its own.
SHARE, CAP = 1.5, 2


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(named, source_size, target) for each source of (named, size); staged.

    A source's target is the smaller of cap times its size and its weight times a common level. The level is what remains of
    the share for each unit of weight once the full sources are taken out; taking out those that it overfills raises it, until
    it overfills no other. Each round is one aggregate over the sources, of which a few numbers reach the driver."""
    sources = sizes.groupBy("named").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit("all"))
    placed = ranked(sources, "all", [F.col("named").asc()])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    weighed = stage(placed.select("named", "source_size", weight.alias("weight")), "sources")
    full = F.col("source_size") * cap
    least, level = None, None
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > full
        words, held, left, now = weighed.agg(
            F.sum("source_size"), F.sum(F.when(over, full).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count(F.when(over, 1))
        ).first()
        if not left or now == least:  # every source is full, or the level stands
            break
        least, level = now, (words * float(share) - held) / left
    target = full.cast("double") if level is None or not left else F.least(full.cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select("named", "source_size", target.alias("target"))


def _taken(rows: DataFrame, row: str, weights, share, cap, seed) -> DataFrame:
    """(row, doc_id, named, size, source_size, target, copies) for each row of docs that carries its number in column row."""
    doc_id, text, source = columns(rows, "doc_id", "text", "source")
    named = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("z"))  # not null, and null is the last
    sized = stage(rows.select(F.col(row).alias("row"), doc_id.alias("doc_id"), named.alias("named"), word_count(text.cast("string")).alias("size")), "sized")
    laid = ranked(sized, "named", [F.col("size").desc(), F.col("doc_id").asc(), F.col("row").asc()])
    whole = laid.join(targets(sized, weights, share, cap), "named")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.col("named"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    summed = lambda rank: F.floor(rate * rank + offset)
    copies = F.least(summed(F.col("rank")) - summed(F.col("rank") - 1), F.lit(cap)).cast("long")
    return whole.select("row", "doc_id", "named", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs."""
    row = own_name(docs, "row")
    taken = _taken(docs.withColumn(row, F.monotonically_increasing_id()), row, weights, share, cap, seed)
    source = F.when(F.col("named") != "z", F.expr("substring(named, 2)"))
    return taken.select("doc_id", source.alias("source"), "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 7) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows are numbered, so those that share an id are taken apart."""
    rows, row = numbered(docs)
    copies = _taken(rows, row, weights, share, cap, seed).where("copies > 0").select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("n"))
    times = own_name(docs, "times")
    return rows.join(copies.withColumnRenamed("n", times), row).withColumn(times, F.explode(times)).select(*docs.columns)


def _cte(weights=WEIGHTS, share=SHARE, cap=CAP, seed=7) -> str:
    weight = "CASE (row_number() OVER (ORDER BY named) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)) + " END"
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS named,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT named, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY named),
weighed AS (SELECT *, CAST({weight} AS BIGINT) AS weight FROM sources),
filled AS (
  SELECT *, (sum(source_size) OVER () * {share}::DOUBLE - coalesce(sum({cap} * source_size) OVER w, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY {cap} * source_size / weight::DOUBLE, named ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT named, source_size, CASE WHEN level * weight > {cap} * source_size THEN ({cap} * source_size)::DOUBLE
    ELSE least(({cap} * source_size)::DOUBLE, max(CASE WHEN NOT level * weight > {cap} * source_size THEN level END) OVER () * weight) END AS target
  FROM filled),
laid AS (SELECT *, row_number() OVER (PARTITION BY named ORDER BY size DESC, doc_id NULLS FIRST) AS rank FROM sized),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5(named || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM laid JOIN goals USING (named))
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(rate * rank + shift) - floor(rate * (rank - 1) + shift), {cap}) AS BIGINT) AS taken
FROM rated"""


ORACLE_SQL = _cte()
