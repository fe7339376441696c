"""Union of shards, canonical names by business number, pruning and profiles.

The canonical map is joined without a hint: Spark broadcasts it while it is small and shuffles beyond that. Edges are a table, or
``KinEdges`` where a part of them is stated by groups; the results are the same.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import abn_checksum, norm_abn
from .graph import ORDER, Graph, keep_first, order_key, top
from .kin import EDGE, KinEdges, among, count_by, counted_ends

EQUIVALENT = "equivalent"
ABN_RELATIONS = ("has abn", "abn")
#: Relations whose targets are literals (matched as written).
ATTRIBUTE_RELATIONS = ("has revenue band", "has annual revenue band", "covers reporting period", "headquartered in", "operates in sector", "has abn", "abn", "register entry")
#: Which relations give a company's fields, the first present one wins.
PRIORITIES = {
    "abn": ("has abn", "has a b n"),
    "sector": ("operates in sector", "received sector", "registered sector"),
    "revenue": ("has annual revenue band", "annual revenue band", "received annual revenue band", "registered revenue band"),
    "hq": ("headquartered in", "is headquartered in", "received headquartered in"),
}


def union_documents(docs: DataFrame) -> DataFrame:
    """Of equal titles the last content, with how many rows fell together."""
    return docs.groupBy("title").agg(F.max_by("content", order_key(docs)).alias("content"), (F.count("*") - 1).alias("collapsed"))


def union_nodes(nodes: DataFrame) -> DataFrame:
    return keep_first(nodes, "name")


union_relations = union_nodes


def union_edges(edges: DataFrame | KinEdges) -> DataFrame | KinEdges:
    return edges.united() if isinstance(edges, KinEdges) else keep_first(edges, "source", "relation", "target")


def missing_endpoints(edges: DataFrame | KinEdges, nodes: DataFrame) -> DataFrame:
    """(missing): edge ends that aren't nodes, sources and targets counted apart."""
    lost = counted_ends(edges).join(nodes.select("name"), "name", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing"))


def _abns(edges: DataFrame | KinEdges, relations, validate_checksum: bool) -> DataFrame:
    """(name, n, abn): names with their number of distinct business numbers and one of them."""
    if isinstance(edges, KinEdges):
        edges = edges.every() if edges.relation.strip().lower() in relations else edges.listed
    own = edges.where(F.lower(F.regexp_replace("relation", r"^\s+|\s+$", "")).isin(*relations)).select(F.col("source").alias("name"), norm_abn("target").alias("abn"))
    own = own.where(F.col("abn").isNotNull() & (abn_checksum("abn") if validate_checksum else F.lit(True))).distinct()
    return own.groupBy("name").agg(F.count("*").alias("n"), F.min("abn").alias("abn"))


def canonical_map(edges: DataFrame | KinEdges, abn_rels=ABN_RELATIONS, validate_checksum: bool = False) -> DataFrame:
    """(variant, leader): names that share a business number and have no other follow the most frequent, longest, least."""
    one = _abns(edges, abn_rels, validate_checksum).where("n = 1")
    often = counted_ends(edges).withColumnRenamed("n", "f")
    ranked = one.join(often, "name").groupBy("abn").agg(F.count("*").alias("k"), F.min_by("name", F.struct(-F.col("f"), -F.length("name"), "name")).alias("leader"))
    led = one.join(ranked.where("k > 1").select("abn", "leader"), "abn")
    return led.where("name <> leader").select(F.col("name").alias("variant"), "leader")


def abn_conflicts(edges: DataFrame | KinEdges, abn_rels=ABN_RELATIONS, validate_checksum: bool = False) -> DataFrame:
    """(abns_seen, conflicts); numbers count where a name has them alone."""
    own = _abns(edges, abn_rels, validate_checksum)
    return own.agg(F.count_distinct(F.when(F.col("n") == 1, F.col("abn"))).alias("abns_seen"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("conflicts"))


def _renamed(df: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    to = mapping.select(F.col("variant").alias(col), F.col("leader").alias("_to"))
    return df.join(to, col, "left").withColumn(col, F.coalesce("_to", col)).select(*df.columns)


def _moved(edges: DataFrame | KinEdges, mapping: DataFrame) -> DataFrame | KinEdges:
    """Edges with their ends renamed; pairs of kins that a renaming touches are listed."""
    if isinstance(edges, KinEdges):
        loose = edges.loosened(mapping.select(F.col("variant").alias("name")).union(mapping.select("leader")))
        return replace(loose, listed=_moved(loose.listed, mapping))
    return _renamed(_renamed(edges, mapping, "source"), mapping, "target")


def canonicalise_graph(graph: Graph, mapping: DataFrame) -> Graph:
    """Names replaced by their leaders; first rows stay, self-loops go, then duplicates."""
    nodes = keep_first(_renamed(graph.nodes, mapping, "name"), "name")
    edges = _moved(graph.edges, mapping)
    if isinstance(edges, KinEdges):
        return Graph(nodes, graph.relations, union_edges(replace(edges, listed=edges.listed.where("source <> target"))))
    return Graph(nodes, graph.relations, union_edges(edges.where("source <> target")))


def canonicalise_stats(before: Graph, mapping: DataFrame) -> DataFrame:
    """One row of counts of a canonicalisation of ``before``."""
    after = canonicalise_graph(before, mapping)
    moved = _moved(before.edges, mapping)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    size = lambda edges, name: count_by(edges, "relation").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    met = moved.listed if isinstance(moved, KinEdges) else moved  # the pairs that are left in kins have two names
    loops = met.agg(F.coalesce(F.sum((F.col("source") == F.col("target")).cast("long")), F.lit(0)).alias("self_loops_dropped"))
    parts = [one(mapping, "variants_folded"), abn_conflicts(before.edges), one(before.nodes, "nodes_in"), one(after.nodes, "nodes_out"), size(before.edges, "edges_in"), loops, size(after.edges, "edges_out")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("duplicates_dropped", F.col("edges_in") - F.col("self_loops_dropped") - F.col("edges_out"))


def literal_nodes(edges: DataFrame | KinEdges, attr_rels=ATTRIBUTE_RELATIONS) -> DataFrame:
    return among(edges, attr_rels).select(F.col("target").alias("name")).distinct()


def prune_equivalent(edges: DataFrame | KinEdges, literals: DataFrame, cap: int = 10) -> DataFrame | KinEdges:
    """edges without synonyms that touch a literal, and with the first cap synonyms of each source."""
    if isinstance(edges, KinEdges) and edges.relation != EQUIVALENT:
        return replace(edges, listed=prune_equivalent(edges.listed, literals, cap))
    if isinstance(edges, KinEdges):
        held = edges.first_pairs(literals, cap)
        edges = edges.listed.select(*EDGE).union(held)
    same = edges.where("relation = 'equivalent'")
    for end in ("source", "target"):
        same = same.join(literals.select(F.col("name").alias(end)), end, "left_anti")
    held = top(same, ["source"], [F.col(c).asc() for c in ORDER if c in edges.columns] + [F.asc("target")], cap).select(*edges.columns)
    return edges.where("relation <> 'equivalent'").unionByName(held)


def equivalent_degree(edges: DataFrame | KinEdges, caps=(5, 10, 20, 50), ps=(0.5, 0.9, 0.99)) -> DataFrame:
    """(metric, value) of source degrees over synonym edges; percentile p is place int(n·(1−p)) of the descending degrees."""
    degrees = count_by(edges, "source", "relation").where("relation = 'equivalent'").select("source", F.col("n").alias("d"))
    # by degree, not by node: how many sources have each degree and how many have more
    counts = degrees.groupBy("d").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    table = counts.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = lambda p: F.floor(F.col("all") * F.lit(1 - p))
    pct = [F.max(F.when((at(p) >= F.col("before")) & (at(p) < F.col("before") + F.col("n")), F.col("d"))).cast("double").alias(f"p{round(p * 100)}") for p in ps]
    kept = [F.sum(F.least("d", F.lit(c)) * F.col("n")).cast("double").alias(f"kept_{c}") for c in caps]
    got = table.agg(F.sum(F.col("d") * F.col("n")).cast("double").alias("n"), F.max("d").cast("double").alias("max"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean"), *pct, *kept)
    share = count_by(edges, "relation").agg((F.sum(F.when(F.col("relation") == "equivalent", F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    wide = got.crossJoin(share)  # one row each
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in wide.columns])).alias("m")).select("m.*")


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def relation_counts(edges: DataFrame | KinEdges, k: int = 25) -> DataFrame:
    return count_by(edges, "relation").orderBy(F.desc("n"), "relation").limit(k)


def relation_top_targets(edges: DataFrame | KinEdges, relations: list[str] | None = None, k: int = 8) -> DataFrame:
    """(relation, target, n, edges, rank): the most common targets of each relation, and its edges."""
    each, total = count_by(edges, "relation", "target"), count_by(edges, "relation").withColumnRenamed("n", "edges")
    each = each.where(F.col("relation").isin(*relations)) if relations else each
    return top(each, ["relation"], [F.desc("n"), F.asc("target")], k).join(total, "relation")


def hub_degree(edges: DataFrame | KinEdges, k: int = 10) -> DataFrame:
    return counted_ends(edges).withColumnRenamed("n", "degree").orderBy(F.desc("degree"), "name").limit(k)


def enrich_company(companies: DataFrame, edges: DataFrame, priorities=PRIORITIES) -> DataFrame:
    """(company, abn, sector, revenue, hq): each the first target over its relations by priority, or —."""
    own = edges.where(F.col("relation").isin(*[r for rels in priorities.values() for r in rels]))

    def field(name):
        rank = F.lit(None)
        for i, rel in enumerate(priorities[name]):
            rank = F.when(F.col("relation") == rel, i).otherwise(rank)
        return F.min_by(F.when(rank.isNotNull(), F.col("target")), F.when(rank.isNotNull(), F.struct(rank.alias("p"), *[c for c in ORDER if c in edges.columns], "target"))).alias(name)

    got = own.groupBy(F.col("source").alias("company")).agg(*map(field, priorities))
    return companies.join(got, "company", "left").select("company", *[F.coalesce(n, F.lit("—")).alias(n) for n in priorities])
