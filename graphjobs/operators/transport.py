"""Entropic transport between the rows and columns of cost tables.

A problem of up to CELLS cells is solved in a task. A larger one is cut into blocks of whole rows, each a dense matrix of about
CELLS cells. One job a round: a block takes the potentials of the columns, finds those of its own rows, and gives for each
column the largest exponent and the sum of the others beside it. Such pairs are merged twice, first some of a problem's blocks,
then the rest, so a task holds a block, or the columns of about as many blocks as the square root of their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut, discard

CELLS = 1 << 20
#: Cost of a cell that isn't given or is null: its mass is 0 wherever another cell of its row and column has a cost.
FAR = 1e6
_PAIRS = "top array<double>, rest array<double>"


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top, rest = _pair(x, axis)
    return top + np.log(rest)


def _pair(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest of x, and the sum of exponentials beside it."""
    top = x.max(axis, keepdims=True)
    return top.squeeze(axis), np.exp(x - top).sum(axis)


def _logs(given: dict | None, names, count: int) -> np.ndarray:
    """Logs of the marginals of names, each of count if not given."""
    return np.full(len(names), -np.log(count)) if given is None else np.log(np.maximum([given[x] for x in names], 1e-12))


def sinkhorn(cost: np.ndarray, reg: float, iterations: int, log_r: np.ndarray, log_c: np.ndarray) -> np.ndarray:
    """Entropic transport plan of a small cost matrix; log_r, log_c: logs of the marginals."""
    kernel, f, g = -cost / reg, np.zeros(cost.shape[0]), np.zeros(cost.shape[1])
    for _ in range(iterations):
        f = log_r - _lse(kernel + g[None, :], 1)
        g = log_c - _lse(kernel + f[:, None], 0)
    return np.exp(kernel + f[:, None] + g[None, :])


def _rows_of(group, i, j, mass: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"group_id": [group] * mass.size, "i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "mass": mass.ravel()})


def _one_row_batches(spark: SparkSession) -> None:
    """A block is a row of some MB, so Arrow batches are bounded by bytes; a bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "16m")


def _in_a_task(costs: DataFrame, kind: str, reg: float, rounds: int, r: dict | None, c: dict | None) -> DataFrame:
    def run(pdf):
        wide = pdf.pivot(index="i", columns="j", values="cost").fillna(FAR)
        i, j = wide.index.to_numpy(), wide.columns.to_numpy()
        return _rows_of(pdf["group_id"].iloc[0], i, j, sinkhorn(wide.to_numpy(float), reg, rounds, _logs(r, i, len(i)), _logs(c, j, len(j))))

    return costs.groupBy("group_id").applyInPandas(run, f"group_id {kind}, i long, j long, mass double")


def _blocks(costs: DataFrame, sizes: DataFrame, kind: str, cells: int) -> DataFrame:
    """(group_id, block, part, n, i, cost): the rows i of a block and their costs, in order of i and j; n rows in the problem."""
    counts = sizes.select("group_id", F.ceil(F.col("n") * F.col("m") / cells).alias("blocks"))
    dealt = costs.join(counts, "group_id").withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")))
    # the columns' names go along once a block
    first = dealt.select("group_id", "block", "blocks").distinct().join(sizes.select("group_id", "n", "js"), "group_id")
    heads = first.select("group_id", "block", "js", "n", "blocks", *[F.lit(None).cast(t).alias(x) for x, t in (("i", "long"), ("j", "long"), ("cost", "double"))])
    body = dealt.select("group_id", "block", F.lit(None).cast("array<long>").alias("js"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("blocks"), "i", "j", "cost")

    def run(pdf):
        head, own = pdf[pdf["js"].notna()].iloc[0], pdf[pdf["i"].notna()]
        names, at = np.unique(own["i"].to_numpy(np.int64), return_inverse=True)
        js = np.asarray(head["js"], np.int64)
        cost = np.full((len(names), len(js)), FAR)
        cost[at, np.searchsorted(js, own["j"].to_numpy(np.int64))] = own["cost"].fillna(FAR)
        part = int(head["block"]) % max(1, int(float(head["blocks"]) ** 0.5))
        return pd.DataFrame({"group_id": [head["group_id"]], "block": [head["block"]], "part": [part], "n": [int(head["n"])], "i": [names], "cost": [cost.ravel()]})

    kinds = f"group_id {kind}, block long, part long, n long, i array<long>, cost array<double>"
    return cut(heads.unionByName(body).groupBy("group_id", "block").applyInPandas(run, kinds))


def _in_blocks(costs: DataFrame, sizes: DataFrame, kind: str, reg: float, rounds: int, r: dict | None, c: dict | None, cells: int) -> DataFrame:
    _one_row_batches(costs.sparkSession)
    blocks = _blocks(costs, sizes, kind, cells)
    zeros = F.transform("js", lambda _: F.lit(0.0))
    g = cut(sizes.select("group_id", "js", zeros.alias("before"), zeros.alias("now")))

    def solved(row, name):
        """Kernel, potentials of rows and of columns, from the columns' potentials of that name."""
        kernel = -np.asarray(row["cost"]).reshape(len(row["i"]), -1) / reg
        return kernel, _logs(r, row["i"], row["n"]) - _lse(kernel + np.asarray(row[name])[None, :], 1)

    def halve(pdfs):
        for pdf in pdfs:
            for _, row in pdf.iterrows():
                kernel, f = solved(row, "now")
                top, rest = _pair(kernel + f[:, None], 0)
                yield pd.DataFrame({"group_id": [row["group_id"]], "part": [row["part"]], "top": [top], "rest": [rest]})

    def merged(pdf):
        tops = np.stack(pdf["top"].to_numpy())
        top = tops.max(0)
        return top, (np.stack(pdf["rest"].to_numpy()) * np.exp(tops - top)).sum(0)

    def some(pdf):
        top, rest = merged(pdf)
        return pd.DataFrame({"group_id": pdf["group_id"].iloc[:1], "top": [top], "rest": [rest]})

    def all_(key, pdf, old):
        top, rest = merged(pdf)
        js = old["js"].iloc[0]
        now = _logs(c, js, len(js)) - top - np.log(rest)
        return pd.DataFrame({"group_id": old["group_id"].iloc[:1], "js": [js], "before": old["now"].iloc[:1], "now": [now]})

    def masses(pdfs):
        for pdf in pdfs:
            for _, row in pdf.iterrows():
                kernel, f = solved(row, "before")
                yield _rows_of(row["group_id"], np.asarray(row["i"]), np.asarray(row["js"]), np.exp(kernel + f[:, None] + np.asarray(row["now"])[None, :]))

    for _ in range(rounds):
        pairs = blocks.join(g.select("group_id", "now"), "group_id").mapInPandas(halve, f"group_id {kind}, part long, {_PAIRS}")
        pairs = pairs.groupBy("group_id", "part").applyInPandas(some, f"group_id {kind}, {_PAIRS}")
        last, g = g, cut(pairs.groupBy("group_id").cogroup(g.groupBy("group_id")).applyInPandas(all_, g.schema))
        discard(last)
    return blocks.join(g, "group_id").mapInPandas(masses, f"group_id {kind}, i long, j long, mass double")


def sinkhorn_align(costs: DataFrame, reg: float = 0.05, num_iters: int = 50, r: dict | None = None, c: dict | None = None, cells: int = CELLS) -> DataFrame:
    """(group_id, i, j, mass) of each row with each column of a problem, for costs (group_id, i, j, cost).

    r, c: marginals by i and j, even if not given; those below 1e-12 count as that. A problem of more than ``cells`` cells is
    solved in blocks. Defined cases: a cell that isn't given, or whose cost is null, costs FAR; of repeated cells the cheapest
    counts; rows without group_id, i or j are no cells; no costs give no rows."""
    kind = dict(costs.dtypes)["group_id"]
    if num_iters < 1:
        raise ValueError("num_iters must be at least 1")
    known = costs.where("group_id is not null and i is not null and j is not null")
    held = cut(known.groupBy("group_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.min(F.col("cost").cast("double")).alias("cost")))
    rows = held.select("group_id", "i").distinct().groupBy("group_id").agg(F.count("*").alias("n"))
    across = held.select("group_id", "j").distinct().groupBy("group_id").agg(F.count("*").alias("m"))
    sizes = cut(rows.join(across, "group_id"))
    large = sizes.where(F.col("n") * F.col("m") > cells)
    small = _in_a_task(held.join(large.select("group_id"), "group_id", "left_anti"), kind, reg, num_iters, r, c)
    if not large.head(1):
        return small
    names = held.join(large, "group_id", "left_semi").groupBy("group_id").agg(F.sort_array(F.collect_set("j")).alias("js"))
    named = cut(large.join(names, "group_id"))
    return small.union(_in_blocks(held.join(large.select("group_id"), "group_id", "left_semi"), named, kind, reg, num_iters, r, c, cells))
