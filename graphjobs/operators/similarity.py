"""Vector joins and entity linking. Vectors are arrays; scores are inner products.

Up to BLOCK queries are broadcast and meet the corpus batch by batch, a matrix product a tile, and a task keeps k rows a query.
More queries, and synonyms, go by pivots (``pivots.py``): blocks of the corpus that can't reach a query's k-th score are skipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pivots import maxsim_topk, pruned_topk, ranked  # noqa: F401
from .transport import sinkhorn_align  # noqa: F401

BLOCK = 20_000
#: Queries whose scores against one batch of the corpus are held at a time.
TILE = 500


def _kept(scores: np.ndarray, ids: np.ndarray, k: int):
    n = scores.shape[1]
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), scores.shape)
    # ties at the k-th score stay, so that the id decides between them
    least = np.take_along_axis(scores, at, 1).min(1)
    i, j = np.nonzero(scores >= least[:, None])
    return i, ids[j], scores[i, j]


def _tiles(names: np.ndarray, q: np.ndarray, pdf: pd.DataFrame, k: int):
    """The k best of pdf for each query, TILE queries at a time."""
    x, ids = np.stack(pdf["vec"].to_numpy()).astype(np.float64), pdf["id"].to_numpy()
    for at in range(0, len(q), TILE):
        i, own, s = _kept(q[at : at + TILE] @ x.T, ids, k)
        yield pd.DataFrame({"query_id": names[at : at + TILE][i], "id": own, "score": s})


def _block_topk(asked: pd.DataFrame, corpus: DataFrame, k: int, kinds: tuple[str, str]) -> DataFrame:
    spark = corpus.sparkSession
    held = spark.sparkContext.broadcast((asked["id"].to_numpy(), np.stack(asked["vec"].to_numpy()).astype(np.float64)))

    def run(pdfs):
        names, q = held.value
        for pdf in pdfs:
            if len(pdf):
                yield from _tiles(names, q, pdf, k)

    return corpus.select("id", "vec").mapInPandas(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 1) -> DataFrame:
    """(query_id, id, score, norm_score, rank): the k best of corpus (id, vec) for each of queries (id, vec)."""
    queries, corpus = queries.where("vec is not null"), corpus.where("vec is not null")
    kinds = (dict(queries.dtypes)["id"], dict(corpus.dtypes)["id"])
    asked = queries.count()
    if not asked:
        return corpus.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, norm_score double, rank int")
    if asked > BLOCK:
        return pruned_topk(queries, corpus, k)
    return ranked(_block_topk(queries.select("id", "vec").toPandas(), corpus, k, kinds), k)


def link_entities(queries: DataFrame, mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node): the best node of each mention, or of the whole query where it has no mention.

    queries, mentions: (query_id, vec); nodes: (name, vec)."""
    whole = queries.join(mentions.select("query_id"), "query_id", "left_anti")
    asked = mentions.select("query_id", "vec").unionByName(whole.select("query_id", "vec")).withColumn("id", F.xxhash64("query_id", "vec"))
    best = dense_topk(asked.select("id", "vec").dropDuplicates(["id"]), nodes.select(F.col("name").alias("id"), "vec"), 1)
    return asked.select("query_id", F.col("id").alias("m")).join(best.select(F.col("query_id").alias("m"), F.col("id").alias("node")), "m").select("query_id", "node").distinct()


def flat_retrieval(queries: DataFrame, nodes: DataFrame, k: int = 8, type: str = "document") -> DataFrame:
    """Cosine top-k over the nodes of a type; nodes: (id, type, vec)."""
    from ..functions.text import truncate_normalise

    unit = lambda df: df.select("id", truncate_normalise("vec").alias("vec"))
    return dense_topk(unit(queries), unit(nodes.where(F.col("type") == type)), k)


def topk_overlap(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, overlap) of the first k ids of two systems; both: (query_id, id, rank)."""
    cut = lambda df: df.where(F.col("rank") <= k).select("query_id", "id").distinct()
    both = cut(a).join(cut(b), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    return a.select("query_id").distinct().join(both, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("overlap"))


def min_max_scale(df: DataFrame, by: str, col: str) -> DataFrame:
    """df with col scaled to 0..1 within by; 1 where all are equal. The bounds are aggregated before they are joined."""
    bounds = df.groupBy(by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(bounds, by).withColumn(col, scaled).drop("_lo", "_hi").select(*df.columns)


def fact_candidates(queries: DataFrame, facts: DataFrame, k: int = 20) -> DataFrame:
    return min_max_scale(dense_topk(queries, facts, k).select("query_id", F.col("id").alias("fact_id"), "score"), "query_id", "score")
