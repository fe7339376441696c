"""Edges in kins: the same results as of the edges one by one, and of large kins without writing their pairs out."""

import random
import re
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphjobs.operators import analytics, index, resolve
from graphjobs.operators.graph import Graph, cut
from graphjobs.operators.kin import KinEdges

DATA = Path("/root/testdata/sf0.001")
PARTS = 600


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def kins(spark, seed, relation="equivalent"):
    """Small kins with names in two of them, rows that repeat, kins of one, and listed edges that are also pairs."""
    pick = random.Random(seed)
    heads, tails, listed = [], [], []
    for kin in range(4):
        for i in pick.sample(range(12), pick.choice([1, 3, 5])):
            heads += [(kin, f"n{i}", 1000 * i)] * pick.choice([0, 1, 1, 2])
            tails += [(kin, f"n{i}", s, i) for s in pick.sample(range(3), pick.choice([0, 1, 2]))]
    for k in range(60):
        listed.append((f"n{pick.randrange(12)}", pick.choice([relation, "has abn", "r", "operates in sector"]), pick.choice([f"n{pick.randrange(12)}", "53102443916", "88000014675"]), k % 3, k))
    return KinEdges(
        spark.createDataFrame(listed, "source string, relation string, target string, shard_no long, row_no long"),
        spark.createDataFrame(heads, "kin long, name string, base long"),
        spark.createDataFrame(tails, "kin long, name string, shard_no long, place long"), relation).cut()


@pytest.mark.parametrize("seed", range(3))
def test_kins_count_like_their_edges(spark, seed):
    held = kins(spark, seed)
    flat = cut(held.every())
    nodes = flat.select(F.col("source").alias("name")).distinct().where("name <> 'n3'").withColumns({"shard_no": F.lit(0), "row_no": F.lit(0)})
    mapping = spark.createDataFrame([("n1", "n2"), ("n5", "n0")], "variant string, leader string")
    literals = spark.createDataFrame([("n7",)], "name string")
    flatten = lambda e: e.every() if isinstance(e, KinEdges) else e.select("source", "relation", "target", "shard_no", "row_no")
    ids = spark.createDataFrame([(f"n{i}", i) for i in range(11)], "name string, id long")
    rels = spark.createDataFrame([("equivalent", 0), ("r", 1)], "name string, id long")
    for own in (
        lambda e: resolve.canonicalise_stats(Graph(nodes, nodes, e), mapping),
        lambda e: resolve.canonical_map(e),
        lambda e: resolve.literal_nodes(e, ("equivalent", "r")),
        lambda e: flatten(resolve.union_edges(e)),
        lambda e: flatten(resolve.canonicalise_graph(Graph(nodes, nodes, e), mapping).edges),
        lambda e: index.counted_edges(e, ids, rels),
        lambda e: resolve.relation_top_targets(e, k=50),
        lambda e: resolve.union_nodes(e.select(F.col("source").alias("name"), "shard_no", "row_no") if e is flat else e.listed.select(F.col("source").alias("name"), "shard_no", "row_no").union(e.first_from())),
        lambda e: resolve.missing_endpoints(e, nodes),
        lambda e: analytics.khop_reach(e, nodes.select(F.col("name").alias("node")).where("name < 'n4'")),
        lambda e: resolve.prune_equivalent(e, literals, 2),
        lambda e: resolve.equivalent_degree(e),
        lambda e: resolve.hub_degree(e),
        lambda e: resolve.relation_counts(e),
    ):
        assert rows(own(held)) == rows(own(flat))


@pytest.fixture(scope="session")
def one_kin(tmp_path_factory):
    """Tables whose parts are of one brand and type."""
    at = tmp_path_factory.mktemp("tables")
    for path in DATA.iterdir():
        shutil.copy(path, at / path.name)
        (at / path.name).chmod(0o644)
    duckdb.sql(f"COPY (SELECT i AS p_partkey, p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, p_size, p_retailprice FROM (SELECT * FROM '{DATA}/part.parquet' LIMIT 1), (SELECT unnest(range({PARTS})) AS i)) TO '{at}/part.parquet' (FORMAT parquet)")
    return at


def made(spark, run):
    """The rows of run's result, and the most that an operator made for it."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    out = [tuple(r) for r in run().collect()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, all_ = 0, store.executionsList()
    for i in range(seen, all_.size()):
        x = all_.apply(i).executionId()
        values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.size()):
                if metrics.apply(k).name() == "number of output rows" and (said := values.get(metrics.apply(k).accumulatorId())).isDefined():
                    most = max(most, int(re.sub(r"\D", "", said.get()) or 0))
    return out, most


@pytest.mark.parametrize("name", ["canonicalise_stats", "missing_facts", "verify_facts", "type_counts", "relation_counts", "assign_ids", "hub_degree", "canonical_map", "equivalent_degree", "prune_equivalent", "khop_reach", "fact_gate", "missing_endpoints", "is_company_name", "union_nodes_relations", "topk_paths", "render_paths", "relation_top_targets", "canonical_pruned_counts"])
def test_large_kins_are_not_written_out(spark, one_kin, name):
    got, most = made(spark, lambda: entry.queries()[name](spark, str(one_kin)))
    assert most < PARTS * PARTS / 4  # a join of all pairs makes twice as many and more
    if name in entry.oracle_sql():
        db = duckdb.connect()
        for path in one_kin.iterdir():
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        want = db.execute(entry.oracle_sql()[name]).fetchall()
        assert sorted(map(str, got)) == sorted(map(str, want))
