"""Edges of which some are stated by groups: in a kin every head has an edge to every tail of another name.

Such edges grow with the square of a kin, so what can be told from heads and tails is told from them: counts, first rows, walks
and what a few names touch. Where the edges themselves are the result, they are written out by a join of blocks and not
shuffled after that.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, ends, keep_first, top

EDGE = ("source", "relation", "target", "shard_no", "row_no")
#: Heads of a kin that meet its tails at once.
BLOCK = 2048


@dataclass(frozen=True)
class KinEdges:
    """listed: edges one by one (``EDGE``). heads: (kin, name, base) and tails: (kin, name, shard_no, place) stand for an edge of
    ``relation`` for each head and each tail of its kin with another name, in row base + place of the tail's shard. Rows that
    repeat stand for edges that repeat; kin, name, base and place are never null."""

    listed: DataFrame
    heads: DataFrame
    tails: DataFrame
    relation: str

    def pairs(self) -> DataFrame:
        """The edges of the kins, one by one."""
        n = int(self.heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = self.heads.groupBy("kin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = self.heads.join(blocks, "kin").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")).drop("blocks")
        each = self.tails.join(blocks, "kin").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        left = own.repartition(n, "kin", "block").withColumnRenamed("name", "source")  # so many tasks: the result is larger than what comes in
        right = each.repartition(n, "kin", "block").withColumnRenamed("name", "target")
        met = left.join(right.hint("shuffle_hash"), ["kin", "block"]).where("source <> target")
        extra = [c for c in (*self.heads.columns, *self.tails.columns) if c not in ("kin", "name", "base", "shard_no", "place")]
        return met.select("source", F.lit(self.relation).alias("relation"), "target", "shard_no", (F.col("base") + F.col("place")).alias("row_no"), *extra)

    def every(self) -> DataFrame:
        return self.listed.select(*EDGE).union(self.pairs().select(*EDGE))

    def among(self, relations) -> DataFrame:
        """The edges of some relations, as they are written."""
        own = self.listed.where(F.col("relation").isin(*relations))
        return own.union(self.pairs()) if self.relation in relations else own

    def from_sources(self, names: DataFrame) -> DataFrame:
        """The edges joined with names (source)."""
        own = replace(self, heads=self.heads.join(names.withColumnRenamed("source", "name"), "name").select(*self.heads.columns))
        return self.listed.join(names, "source").select(*EDGE).union(own.pairs())

    def into(self, names: DataFrame) -> DataFrame:
        """The edges whose target is among names (name)."""
        own = replace(self, tails=self.tails.join(names.select("name"), "name", "left_semi").select(*self.tails.columns))
        return self.listed.join(names.select(F.col("name").alias("target")), "target", "left_semi").select(*EDGE).union(own.pairs())

    def sources_into(self, names: DataFrame) -> DataFrame:
        """(name) of the sources of those edges, some more than once."""
        near = self.tails.join(names.select("name"), "name", "left_semi")
        own = self.listed.join(names.select(F.col("name").alias("target")), "target", "left_semi").select(F.col("source").alias("name"))
        return own.union(_met(self.heads, near).select("name"))

    def from_heads(self) -> DataFrame:
        """(kin, name, n, and the heads' other columns): the edges of each head."""
        return _others(self.heads, self.tails)

    def to_tails(self) -> DataFrame:
        return _others(self.tails, self.heads)

    def shards_of_heads(self) -> DataFrame:
        """(shard_no, name) of heads with an edge there."""
        return _met(self.heads, self.tails, "shard_no").select("shard_no", "name").distinct()

    def shards_of_tails(self) -> DataFrame:
        return _met(self.tails.select("kin", "name", F.col("shard_no").alias("_s")), self.heads, rest=("_s",)).select(F.col("_s").alias("shard_no"), "name").distinct()

    def first_from(self) -> DataFrame:
        """(name, shard_no, row_no): the first edge of each head."""
        met = _least(self.heads, self.tails, F.struct("shard_no", "place"))
        return met.select("name", "key.shard_no", (F.col("base") + F.col("key.place")).alias("row_no"))

    def first_rows(self) -> DataFrame:
        """(relation, row_no): the first row of each head's pairs."""
        return _least(self.heads, self.tails, F.col("place")).select(F.lit(self.relation).alias("relation"), F.col("base") + F.col("key"))

    def named_rows(self) -> DataFrame:
        """(name, row_no): the ends of all edges, with the least row of each head and tail for those of its edges."""
        own = self.listed.select("source", "target", "row_no")
        out = own.select(F.col("source").alias("name"), "row_no").union(own.select("target", "row_no"))
        out = out.union(_least(self.heads, self.tails, F.col("place")).select("name", F.col("base") + F.col("key")))
        return out.union(_least(self.tails, self.heads, F.col("base")).select("name", F.col("place") + F.col("key")))

    def spread(self, front: DataFrame) -> DataFrame:
        """(target, mass): what front (node, mass) sends along the pairs. A tail gets the sum of its kin's heads but its own, to the
        precision of that sum: counts of walks are whole numbers, so exact as far as doubles hold them."""
        sent = self.heads.join(front.withColumnRenamed("node", "name"), "name")
        sums = lambda *by: sent.groupBy(*by).agg(F.sum("mass").alias(f"m{len(by)}"), F.count("*").alias(f"c{len(by)}"))
        met = self.tails.join(sums("kin"), "kin").join(sums("kin", "name"), ["kin", "name"], "left")
        return met.where("c1 > coalesce(c2, 0)").select(F.col("name").alias("target"), (F.col("m1") - F.coalesce("m2", F.lit(0.0))).alias("mass"))

    def first_pairs(self, without: DataFrame, k: int) -> DataFrame:
        """Pairs that don't touch names (without: name), among them the first k of each head: those with the first tails of a kin.

        Of a name's own tails k at most are before the k-th of another name."""
        heads, tails = (df.join(without.select("name"), "name", "left_anti").select(*df.columns) for df in (self.heads, self.tails))
        order = [F.asc("shard_no"), F.asc("place")]
        some = top(top(tails, ["kin", "name"], order, k).drop("rank"), ["kin"], [*order, F.asc("name")], 2 * k).select(*tails.columns)
        return replace(self, heads=heads, tails=some).pairs()

    def cut(self) -> KinEdges:
        return replace(self, listed=cut(self.listed), heads=cut(self.heads), tails=cut(self.tails))

    def loosened(self, names: DataFrame) -> KinEdges:
        """The same edges, those that touch names (name) listed."""
        names = cut(names.select("name").distinct())
        apart = lambda df, how: df.join(names, "name", how).select(*df.columns)
        touched, rest = apart(self.heads, "left_semi"), replace(self, heads=apart(self.heads, "left_anti"), tails=apart(self.tails, "left_anti"))
        out = self.listed.select(*EDGE).union(replace(self, heads=touched).pairs()).union(replace(self, heads=rest.heads, tails=apart(self.tails, "left_semi")).pairs())
        return replace(rest, listed=out)

    def doubtful(self) -> DataFrame:
        """(name): those in several kins or at an end of a listed edge of the relation, whose pairs may be told twice."""
        held = self.heads.select("kin", "name").union(self.tails.select("kin", "name"))
        lo, hi = F.min("kin").alias("lo"), F.max("kin").alias("hi")
        return held.groupBy("name").agg(lo, hi).where("lo <> hi").select("name").union(ends(self.listed.where(F.col("relation") == self.relation)))

    def united(self) -> KinEdges:
        """The first row of each edge (source, relation, target)."""
        own = self.loosened(self.doubtful())
        heads = own.heads.groupBy("kin", "name").agg(F.min("base").alias("base"))
        tails = own.tails.groupBy("kin", "name").agg(F.min(F.struct("shard_no", "place")).alias("r")).select("kin", "name", "r.*")
        return replace(own, listed=keep_first(own.listed, "source", "relation", "target"), heads=heads, tails=tails)


def _others(rows: DataFrame, against: DataFrame) -> DataFrame:
    """rows with n, how many rows of the other side their kin has under other names; those without go."""
    all_ = against.groupBy("kin").agg(F.count("*").alias("_all"))
    own = against.groupBy("kin", "name").agg(F.count("*").alias("_own"))
    met = rows.join(all_, "kin").join(own, ["kin", "name"], "left").withColumn("n", F.col("_all") - F.coalesce("_own", F.lit(0)))
    return met.where("n > 0").select(*rows.columns, "n")


def _met(rows: DataFrame, against: DataFrame, *by: str, rest: tuple = ()) -> DataFrame:
    """(kin, name, by …, rest …) of rows that meet another name on the other side, for each value of its columns by."""
    names = against.groupBy("kin", *by).agg(F.min("name").alias("_lo"), F.max("name").alias("_hi"))
    return rows.join(names, "kin").where("_lo <> name OR _hi <> name").select("kin", "name", *by, *rest)


def _least(rows: DataFrame, against: DataFrame, key: Column) -> DataFrame:
    """rows with the least key of the other side's rows of their kin with other names."""
    keyed = against.select("kin", F.col("name").alias("_n"), key.alias("_k"))
    best = keyed.groupBy("kin").agg(F.min_by("_n", "_k").alias("_first"), F.min("_k").alias("_k1"))
    next_ = keyed.join(best, "kin").where("_n <> _first").groupBy("kin").agg(F.min("_k").alias("_k2"))
    met = rows.join(best, "kin").join(next_, "kin", "left").withColumn("key", F.when(F.col("name") == F.col("_first"), F.col("_k2")).otherwise(F.col("_k1")))
    return met.where("key is not null").select(*rows.columns, "key")


def count_by(edges: DataFrame | KinEdges, *by: str) -> DataFrame:
    """(by …, n): edges by source or target, and relation."""
    if not isinstance(edges, KinEdges):
        return edges.groupBy(*by).agg(F.count("*").alias("n"))
    side = edges.to_tails() if "target" in by else edges.from_heads()
    named = {"relation": F.lit(edges.relation), "source": F.col("name"), "target": F.col("name")}
    both = edges.listed.groupBy(*by).agg(F.count("*").alias("n")).union(side.select(*[named[c].alias(c) for c in by], "n"))
    return both.groupBy(*by).agg(F.sum("n").alias("n"))


def counted_ends(edges: DataFrame | KinEdges) -> DataFrame:
    """(name, n): at how many ends of edges a name is."""
    if not isinstance(edges, KinEdges):
        return ends(edges).groupBy("name").agg(F.count("*").alias("n"))
    own = ends(edges.listed).groupBy("name").agg(F.count("*").alias("n"))
    both = own.union(edges.from_heads().select("name", "n")).union(edges.to_tails().select("name", "n"))
    return both.groupBy("name").agg(F.sum("n").alias("n"))


def among(edges: DataFrame | KinEdges, relations) -> DataFrame:
    return edges.among(relations) if isinstance(edges, KinEdges) else edges.where(F.col("relation").isin(*relations))
