"""Integer ids, encoded edges and training samples."""

from __future__ import annotations

import difflib
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attributes_to_text
from .graph import cut, order_key, top
from .kg import MENTIONED
from .kin import KinEdges


def placed(df: DataFrame, order: Column, name: str) -> DataFrame:
    """df with its global place by an order, from 0: rows are dealt by range and each partition adds those before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.withColumn("_o", order).repartitionByRange(n, "_o").sortWithinPartitions("_o").withColumn("_at", F.monotonically_increasing_id())
    laid = cut(laid)  # read twice below: another run could deal other ranges
    laid = laid.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.expr("_at & ((1L << 33) - 1)"))
    sizes = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return laid.join(F.broadcast(bases), "_part").withColumn(name, F.col("_before") + F.col("_in")).select(*df.columns, name)


def assign_ids(nodes: DataFrame) -> DataFrame:
    """nodes with id in row order and type_id by a type's first appearance."""
    own = placed(nodes, F.struct(order_key(nodes), "name"), "id")
    types = own.groupBy("type").agg(F.min("id").alias("first"))
    types = types.select("type", (F.row_number().over(Window.orderBy("first")) - 1).alias("type_id"))  # a row a type
    return own.join(F.broadcast(types), "type")


def relation_ids(relations: DataFrame) -> DataFrame:
    return placed(relations, F.struct(order_key(relations), "name"), "id")


def encode_edges(edges: DataFrame, node_ids: DataFrame, rel_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, r) of edges whose ends and relation are known, and the edges set aside."""
    met = edges
    for col, ids, out in (("source", node_ids, "u"), ("target", node_ids, "v"), ("relation", rel_ids, "r")):
        met = met.join(ids.select(F.col("name").alias(col), F.col("id").alias(out)), col, "left")
    whole = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("r").isNotNull()
    return met.where(whole).select("u", "v", "r"), met.where(~whole).select(*edges.columns)


def counted_edges(edges: DataFrame | KinEdges, node_ids: DataFrame, rel_ids: DataFrame) -> DataFrame:
    """(u, v, r, n): how often each encoded edge occurs."""
    if not isinstance(edges, KinEdges):
        return encode_edges(edges, node_ids, rel_ids)[0].groupBy("u", "v", "r").agg(F.count("*").alias("n"))
    own = edges.loosened(edges.doubtful())
    known, rel = node_ids.select("name", "id"), rel_ids.where(F.col("name") == edges.relation).select(F.col("id").alias("r"))
    sides = [df.groupBy("kin", "name").agg(F.count("*").alias(n)).join(known, "name").select("kin", F.col("id").alias("name"), n) for df, n in ((own.heads, "_h"), (own.tails, "_t"))]
    heads, tails = sides[0].withColumn("base", F.lit(0)), sides[1].withColumn("shard_no", F.lit(0)).withColumn("place", F.lit(0))
    pairs = replace(own, heads=heads, tails=tails).pairs().crossJoin(F.broadcast(rel))  # one row, or none
    listed = counted_edges(own.listed, node_ids, rel_ids)
    return listed.union(pairs.select(F.col("source").alias("u"), F.col("target").alias("v"), "r", (F.col("_h") * F.col("_t")).alias("n")))


def inverse_edges(encoded: DataFrame, rel_ids: DataFrame, n_relations: int) -> tuple[DataFrame, DataFrame]:
    """Edges with their inverses (v, u, r + R); ids of relations with inverse names for those that occur."""
    both = encoded.union(encoded.select("v", "u", F.col("r") + n_relations))
    used = rel_ids.join(encoded.select(F.col("r").alias("id")).distinct(), "id", "left_semi")
    names = rel_ids.select("name", "id").union(used.select(F.concat(F.lit("inverse_"), "name"), F.col("id") + n_relations))
    return both, names


def nodes_by_type(node_ids: DataFrame) -> DataFrame:
    """(type, id), a row a node: filter on a type rather than collecting its ids."""
    return node_ids.select("type", "id")


def restrict_to_type(encoded: DataFrame, node_ids: DataFrame, type: str = "entity") -> DataFrame:
    own = node_ids.where(F.col("type") == type)
    return encoded.join(own.select(F.col("id").alias("u")), "u", "left_semi").join(own.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v", "r")


def target_to_other(encoded: DataFrame, node_ids: DataFrame, type: str = "entity") -> DataFrame:
    """(other_type, u, v, weight): edges from a type to each other one, with multiplicity."""
    own = encoded.join(node_ids.where(F.col("type") == type).select(F.col("id").alias("u")), "u", "left_semi")
    other = own.join(node_ids.where(F.col("type") != type).select(F.col("id").alias("v"), F.col("type").alias("other_type")), "v")
    return other.groupBy("other_type", "u", "v").agg(F.count("*").alias("weight"))


def embedding_inputs(node_ids: DataFrame, rel_ids: DataFrame, n_relations: int, inverse: str = "text", edges: DataFrame | None = None) -> DataFrame:
    """(kind, id, text, sign): texts to embed, of name, type and attributes (a map, where a table has it). Inverse relations as a
    text of their own, or (``inverse``) as the negated vector of the relation. edges: (id, attributes), with attributes alone."""
    def rows(df, kind, id_, sign=1, **given):
        own = F.col("attributes") if "attributes" in df.columns else F.create_map().cast("map<string,string>")
        return df.select(F.lit(kind).alias("kind"), id_.cast("long").alias("id"), attributes_to_text(own, **given).alias("text"), F.lit(sign).alias("sign"))

    back, name = F.col("id") + n_relations, F.col("name")
    out = rows(node_ids, "node", F.col("id"), name=name, type=F.col("type")).union(rows(rel_ids, "relation", F.col("id"), name=name))
    out = out.union(rows(rel_ids, "relation", back, name=F.concat(F.lit("inverse_"), name)) if inverse == "text" else rows(rel_ids, "relation", back, -1, name=name))
    return out if edges is None else out.union(rows(edges, "edge", F.col("id")))


def qa_masks(samples: DataFrame, node_ids: DataFrame, skip_empty_target: bool = True) -> DataFrame:
    """(id, role, node_id); samples: (id, start_nodes, target_nodes: map of type to names). Unknown names go, and samples
    left without a start, or without a target if asked."""
    spread = lambda c: samples.select("id", F.lit(c.split("_")[0]).alias("role"), F.explode(F.flatten(F.map_values(c))).alias("name"))
    met = spread("start_nodes").union(spread("target_nodes")).join(node_ids.select("name", F.col("id").alias("node_id")), "name").select("id", "role", "node_id").distinct()
    has = met.groupBy("id").agg(F.max((F.col("role") == "start").cast("int")).alias("s"), F.max((F.col("role") == "target").cast("int")).alias("t"))
    good = has.where((F.col("s") == 1) & ((F.col("t") == 1) | F.lit(not skip_empty_target)))
    return met.join(good.select("id"), "id", "left_semi").select("id", "role", "node_id")


def doc_entities_map(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relation") == MENTIONED).groupBy(F.col("target").alias("doc")).agg(F.array_sort(F.collect_set("source")).alias("entities"))


def _sample(samples: DataFrame, starts: DataFrame, entities: DataFrame, docs: DataFrame | None) -> DataFrame:
    names = lambda df, c: df.groupBy("id").agg(F.array_sort(F.collect_set("node")).alias(c))
    out = samples.select("id").join(names(starts, "start"), "id", "left").join(names(entities, "entity"), "id", "left")
    out = out.join(names(docs, "document"), "id", "left") if docs is not None else out.withColumn("document", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    filled = {c: F.coalesce(c, empty) for c in ("start", "entity", "document")}
    return out.select("id", F.create_map(F.lit("entity"), filled["start"]).alias("start_nodes"), F.create_map(F.lit("entity"), filled["entity"], F.lit("document"), filled["document"]).alias("target_nodes"))


def samples_entity_docs(samples: DataFrame, linked: DataFrame, edges: DataFrame) -> DataFrame:
    """Starts: linked question entities; targets: supporting documents and their entities.

    samples: (id, supporting_documents); linked: (id, node)."""
    docs = samples.select("id", F.explode(F.array_distinct("supporting_documents")).alias("node"))
    held = edges.where(F.col("relation") == MENTIONED).select(F.col("target").alias("doc"), "source").distinct()
    entities = docs.join(held, docs.node == held.doc).select("id", F.col("source").alias("node"))
    return _sample(samples, linked, entities, docs)


def samples_answer(samples: DataFrame, linked_q: DataFrame, linked_a: DataFrame) -> DataFrame:
    """Targets: linked answer entities; mentions count once."""
    return _sample(samples, linked_q.distinct(), linked_a.distinct(), None)


def fact_start_nodes(chosen: DataFrame, facts: DataFrame, edges: DataFrame, nodes: DataFrame, dense_docs: DataFrame, link_top_k: int = 5, passage_node_weight: float = 0.05, limit: int = 30) -> DataFrame:
    """(query_id, node, score). chosen: (query_id, fact_id, score); facts: (fact_id, source, target); nodes: (name);
    dense_docs: (query_id, id, score).

    Phrases are lower-cased, and only those that are nodes count. A phrase's score is the sum of its facts' scores over its documents, divided by how often it occurs; documents enter with a
    small weight, in place of an equal key, and the best stay."""
    links = edges.where(F.col("relation") == MENTIONED).groupBy(F.col("source").alias("node")).agg(F.count_distinct("target").alias("docs"))
    phrases = chosen.join(facts, "fact_id").select("query_id", F.explode(F.array(F.lower("source"), F.lower("target"))).alias("node"), "score")
    phrases = phrases.join(nodes.select(F.col("name").alias("node")).distinct(), "node", "left_semi").join(links, "node", "left")
    each = phrases.groupBy("query_id", "node").agg(F.avg(F.col("score") / F.greatest(F.coalesce("docs", F.lit(1)), F.lit(1))).alias("score"))
    best = top(each, ["query_id"], [F.desc("score"), F.asc("node")], link_top_k).select("query_id", "node", "score", F.lit(0).alias("p"))
    docs = dense_docs.select("query_id", F.col("id").alias("node"), F.col("score") * passage_node_weight, F.lit(1))
    both = best.union(docs).groupBy("query_id", "node").agg(F.max_by("score", "p").alias("score"))
    return top(both, ["query_id"], [F.desc("score"), F.asc("node")], limit).select("query_id", "node", "score")


def samples_fact_link(samples: DataFrame, starts: DataFrame, dense: DataFrame, answers: DataFrame, topk: int = 5) -> DataFrame:
    """Starts from facts, or the dense neighbours where a sample has no facts; targets: the best answer entity, supporting documents.

    starts: (id, node, score); dense: (id, node, score); answers: (id, node, rank)."""
    fallback = dense.join(starts.select("id"), "id", "left_anti")
    chosen = top(starts.unionByName(fallback), ["id"], [F.desc("score"), F.asc("node")], topk)
    docs = samples.select("id", F.explode(F.array_distinct("supporting_documents")).alias("node"))
    return _sample(samples, chosen.select("id", "node"), answers.where("rank = 1").select("id", "node"), docs)


def match_filtered_facts(generated: DataFrame, candidates: DataFrame, len_after_rerank: int = 5) -> DataFrame:
    """(query_id, place, fact): for each generated fact the closest candidate, in order, repeats included. Few candidates a query."""
    kind = dict(generated.dtypes)["query_id"]

    def run(key, left, right):
        own, out = right["fact"].tolist(), []
        for fact in left.sort_values("place")["fact"]:
            close = difflib.get_close_matches(fact, own, 1, 0.0)
            out += close
        out = out[:len_after_rerank]
        return pd.DataFrame({"query_id": [key[0]] * len(out), "place": range(len(out)), "fact": out})

    return generated.groupBy("query_id").cogroup(candidates.groupBy("query_id")).applyInPandas(run, f"query_id {kind}, place int, fact string")
