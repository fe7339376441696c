"""Answer, retrieval and link-prediction metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_answer

PLAIN = ("yes", "no", "noanswer")


def exact_match(pred, gold) -> Column:
    return (normalise_answer(pred) == normalise_answer(gold)).cast("int")


def _tokens(c) -> Column:
    return F.filter(F.split(normalise_answer(c), " "), lambda t: t != "")


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _overlap(a: Column, b: Column) -> Column:
    """Shared tokens, repeats counted: those of both in order, a's before b's, and each of b takes one of a's that is left."""
    marked = lambda tokens, side: F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))

    def meet(acc, x):
        left = F.when(acc["t"] == x["t"], acc["left"]).otherwise(0)
        takes = (x["side"] == 1) & (left > 0)
        step = F.when(x["side"] == 0, 1).when(takes, -1).otherwise(0)
        return F.struct(x["t"].alias("t"), (left + step).alias("left"), (acc["same"] + takes.cast("int")).alias("same"))

    first = F.struct(F.lit("").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("same"))
    return F.aggregate(F.array_sort(F.concat(marked(a, 0), marked(b, 1))), first, meet, lambda acc: acc["same"])


def _counted(pred, gold, f) -> Column:
    """f of (same, a, b): shared tokens and the tokens of either."""
    tokens = F.struct(_tokens(pred).alias("a"), _tokens(gold).alias("b"))
    counts = lambda s: F.struct(_overlap(s["a"], s["b"]).alias("same"), F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b"))
    return _bound(_bound(tokens, counts), lambda n: f(n["same"], n["a"], n["b"]))


def _f1(same, a, b) -> Column:
    p, r = same / F.greatest(a, F.lit(1)), same / F.greatest(b, F.lit(1))
    zero = F.lit(0.0)
    one = lambda f, p_, r_: F.struct(f.alias("f1"), p_.alias("p"), r_.alias("r"))
    return F.when(same == 0, one(zero, zero, zero)).otherwise(one(2.0 * same / (a + b), p, r))


def token_f1(pred, gold) -> Column:
    """(f1, p, r) of shared tokens; 0 where either is a plain yes or no and they differ."""
    zero, both = F.lit(0.0), F.struct(normalise_answer(pred).alias("a"), normalise_answer(gold).alias("b"))
    apart = _bound(both, lambda s: (s["a"].isin(*PLAIN) | s["b"].isin(*PLAIN)) & (s["a"] != s["b"]))
    return F.when(apart, F.struct(zero.alias("f1"), zero.alias("p"), zero.alias("r"))).otherwise(_counted(pred, gold, _f1))


def token_f1_lenient(pred, gold) -> Column:
    def f1(same, a, b):
        whole = ((a == 0) & (b == 0)).cast("double")
        return F.when((a == 0) | (b == 0), F.struct(whole.alias("f1"), whole.alias("p"), whole.alias("r"))).otherwise(_f1(same, a, b))

    return _counted(pred, gold, f1)


def _means(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.avg("p").alias("precision"), F.avg("r").alias("recall"))


def eval_single(df: DataFrame) -> DataFrame:
    """One row (em, f1, precision, recall) of (pred, gold)."""
    return _means(df.select(exact_match("pred", "gold").alias("em"), token_f1("pred", "gold").alias("m")).select("em", "m.*"))


def _golds(df: DataFrame, metric) -> DataFrame:
    each = df.select("id", "pred", F.posexplode(F.concat(F.array("gold"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "g"))
    return each.select("id", "pos", exact_match("pred", "g").alias("em"), metric("pred", "g").alias("m")).select("id", "pos", "em", "m.*")


def eval_max_each(df: DataFrame) -> DataFrame:
    """Each metric's best over answer and aliases, apart; df: (id, pred, gold, aliases)."""
    return _means(_golds(df, token_f1).groupBy("id").agg(*[F.max(c).alias(c) for c in ("em", "f1", "p", "r")]))


def eval_best_f1(df: DataFrame) -> DataFrame:
    """Precision and recall at the answer with the best f1, the first on ties."""
    best = _golds(df, token_f1_lenient).groupBy("id").agg(F.max("em").alias("em"), F.max_by(F.struct("f1", "p", "r"), F.struct("f1", -F.col("pos"))).alias("m"))
    return _means(best.select("em", "m.*"))


def retrieval_recall(predictions: DataFrame, gold: DataFrame, k=(1, 2, 5, 10)) -> DataFrame:
    """One row recall@k; predictions: (id, name, score, place), gold: (id, name). A gold name without rows counts."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "place"))
    best = predictions.withColumn("rank", rank).where(F.col("rank") <= max(k)).groupBy("id", "name").agg(F.min("rank").alias("rank"))
    met = gold.select("id", "name").distinct().join(best, ["id", "name"], "left")
    per = met.groupBy("id").agg(*[F.avg(F.coalesce((F.col("rank") <= n).cast("double"), F.lit(0.0))).alias(f"recall@{n}") for n in k])
    return per.agg(*[F.avg(f"recall@{n}").alias(f"recall@{n}") for n in k])


def ranking_metrics(scores: DataFrame, targets: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """One row: mrr and hits@k on filtered ranks, recall@k on plain ranks, by query and then over queries."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node")))
    own = ranked.join(targets.select("query", "node").distinct(), ["query", "node"])
    better = F.row_number().over(Window.partitionBy("query").orderBy("rank")) - 1
    own = own.withColumn("filtered", F.col("rank") - better)
    hit = lambda c, k: F.avg((F.col(c) <= k).cast("double"))
    per = own.groupBy("query").agg(F.avg(1.0 / F.col("filtered")).alias("mrr"), *[hit("filtered", k).alias(f"hits@{k}") for k in ks], *[hit("rank", k).alias(f"recall@{k}") for k in ks])
    return per.agg(*[F.avg(c).alias(c) for c in per.columns if c != "query"])


def cardinality_error(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(mape): how far the sum of probabilities above a half is from the number of targets."""
    p = 1 / (1 + F.exp(-F.col("score")))
    said = scores.groupBy("query").agg(F.sum(F.when(p > 0.5, p).otherwise(0.0)).alias("said"))
    n = targets.groupBy("query").agg(F.count_distinct("node").alias("n"))
    return n.join(said, "query", "left").agg(F.avg(F.abs(F.coalesce("said", F.lit(0.0)) - F.col("n")) / F.col("n")).alias("mape"))


def link_prediction_ranks(scores: DataFrame, positives: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, side, rank, num_negative): one more than the negatives that score as high as the true node.

    scores: (qid, side, node, score); positives: (qid, side, node); known true nodes (qid, side, node) don't count."""
    true = scores.join(positives, ["qid", "side", "node"]).select("qid", "side", F.col("score").alias("t"))
    negatives = scores.join(known.union(positives.select(*known.columns)).distinct(), ["qid", "side", "node"], "left_anti")
    counted = negatives.join(true, ["qid", "side"]).groupBy("qid", "side").agg(F.sum((F.col("score") >= F.col("t")).cast("long")).alias("above"), F.count("*").alias("num_negative"))
    return true.join(counted, ["qid", "side"], "left").select("qid", "side", (1 + F.coalesce("above", F.lit(0))).alias("rank"), F.coalesce("num_negative", F.lit(0)).alias("num_negative"))


def _sampled_hits(k: int, n: int) -> Column:
    """Chance of fewer than k above the true node among n − 1 sampled negatives, which with it make n."""
    p = F.when(F.col("num_negative") > 0, (F.col("rank") - 1) / F.col("num_negative")).otherwise(0.0)
    return sum((math.comb(n - 1, i) * F.pow(p, i) * F.pow(1 - p, n - 1 - i) for i in range(k)), F.lit(0.0))


def link_prediction_metrics(ranks: DataFrame, ks=(1, 3, 10), sampled=((10, 50),)) -> DataFrame:
    """(side, mr, mrr, hits@k, hits@k_n) over both sides and the tails alone."""
    aggs = [F.avg("rank").alias("mr"), F.avg(1 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits@{k}") for k in ks], *[F.avg(_sampled_hits(k, n)).alias(f"hits@{k}_{n}") for k, n in sampled]]
    each = ranks.withColumn("part", F.explode(F.when(F.col("side") == "tail", F.array(F.lit("both"), F.lit("tail"))).otherwise(F.array(F.lit("both")))))
    return each.groupBy(F.col("part").alias("side")).agg(*aggs)


def metrics_by_query_type(per_query: DataFrame) -> DataFrame:
    """(part, value): means of (type, value) over types: all, those without negation (no n), those with it."""
    types = per_query.groupBy("type").agg(F.avg("value").alias("value"))
    part = F.array(F.lit("all"), F.when(F.col("type").contains("n"), "negation").otherwise("epfo"))
    return types.select(F.explode(part).alias("part"), "value").groupBy("part").agg(F.avg("value").alias("value"))


def rank_auc(ranks: DataFrame) -> DataFrame:
    """(query, auc): chance that a hard answer ranks below an easy one; ranks: (query, rank, is_hard), ranks distinct."""
    easy_before = F.sum((~F.col("is_hard")).cast("long")).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    own = ranks.withColumn("b", easy_before)
    out = own.groupBy("query").agg(F.sum(F.when(F.col("is_hard"), F.col("b")).otherwise(0)).alias("w"), F.sum(F.col("is_hard").cast("long")).alias("h"), F.count("*").alias("n"))
    pairs = F.col("h") * (F.col("n") - F.col("h"))
    return out.where(pairs > 0).select("query", (F.col("w") / pairs).alias("auc"))


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, rho): correlation of average ranks."""
    def ranked(c):
        tie = F.count("*").over(Window.partitionBy(by, c))
        return F.rank().over(Window.partitionBy(by).orderBy(c)) + (tie - 1) / 2
    return df.select(by, ranked(x).alias("rx"), ranked(y).alias("ry")).groupBy(by).agg(F.corr("rx", "ry").alias("rho"))


def average_over_datasets(metrics: DataFrame, watched: str = "document_mrr") -> DataFrame:
    """(dataset, value) of the watched metric, and its mean as dataset "average"."""
    own = metrics.where(F.col("metric") == watched).groupBy("dataset").agg(F.avg("value").alias("value"))
    return own.union(own.agg(F.lit("average"), F.avg("value")))
