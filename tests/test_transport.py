"""Transport in blocks against a dense loop of its own."""

import numpy as np

from graphjobs.operators import transport


def dense(cost, reg, rounds, r, c):
    kernel = np.exp(np.longdouble(-cost / reg))
    v = np.ones(len(c), np.longdouble)
    for _ in range(rounds):
        u = r / (kernel @ v)
        v = c / (kernel.T @ u)
    return (u[:, None] * kernel * v[None, :]).astype(float)


def check(got, cost, reg, rounds, r, c, rows, cols):
    want = dense(cost, reg, rounds, r, c)
    held = {(x.i, x.j): x.mass for x in got}
    assert len(held) == len(got) == cost.size
    assert max(abs(held[i, j] - want[a, b]) for a, i in enumerate(rows) for b, j in enumerate(cols)) < 1e-9


def test_blocks_equal_a_dense_loop(spark):
    rng = np.random.default_rng(4)
    rows, cols = np.arange(0, 260, 5), np.arange(100, 100 + 37 * 3, 3)
    cost = rng.random((len(rows), len(cols))) * 3
    r, c = rng.dirichlet(np.ones(len(rows))), rng.dirichlet(np.ones(len(cols)))
    cells = [("large", int(i), int(j), float(cost[a, b])) for a, i in enumerate(rows) for b, j in enumerate(cols)]
    cells += [("small", int(i), int(j), float(cost[a, b])) for a, i in enumerate(rows[:3]) for b, j in enumerate(cols[:2])]
    df = spark.createDataFrame(cells, "group_id string, i long, j long, cost double")
    got = transport.sinkhorn_align(df, 0.2, 4, cells=150).collect()
    parts = {g: [x for x in got if x.group_id == g] for g in ("large", "small")}
    even = lambda k: np.full(k, 1 / k)
    check(parts["large"], cost, 0.2, 4, even(len(rows)), even(len(cols)), rows, cols)
    check(parts["small"], cost[:3, :2], 0.2, 4, even(3), even(2), rows[:3], cols[:2])
    large = df.where("group_id = 'large'")
    given = (dict(zip(rows.tolist(), r.tolist())), dict(zip(cols.tolist(), c.tolist())))
    check(transport.sinkhorn_align(large, 0.2, 3, *given, cells=150).collect(), cost, 0.2, 3, r, c, rows, cols)


def test_edges_are_alike_in_blocks_and_in_a_task(spark):
    """Cells not given, null and repeated, exponents far beyond what exp bears; a cell alone; no cells."""
    cells = [(1, 0, 0, 900.0), (1, 0, 1, None), (1, 1, 1, 800.0), (1, 1, 1, 5.0), (1, 2, 0, 0.0), (1, 2, 2, 1.0), (1, 3, 2, 700.0)]
    cells += [(1, None, 0, 1.0), (None, 0, 0, 1.0), (2, 7, 7, 3.0)]
    df = spark.createDataFrame(cells, "group_id long, i long, j long, cost double")
    one, many = ({tuple(x)[:3]: x.mass for x in transport.sinkhorn_align(df, 0.5, 5, cells=n).collect()} for n in (100, 3))
    assert one.keys() == many.keys() and len(one) == 4 * 3 + 1
    assert all(abs(one[k] - many[k]) < 1e-9 for k in one) and one[2, 7, 7] == 1.0 and one[1, 0, 1] == 0.0
    assert transport.sinkhorn_align(df.where("false")).collect() == []
