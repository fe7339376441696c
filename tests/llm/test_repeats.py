import hashlib

import numpy as np
import pytest

from graphjobs.llm import repeats

from .conftest import EDGE


def brute(rows, length=100):
    """Contract by a set of all strings met; rows: (doc_id, text) with ids that differ, or equal rows."""
    met, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            own = raw[i : i + length]
            if own in met:
                gone[i : i + length] = True
            met.add(own)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **how):
    return sorted((tuple(r) for r in repeats.digest(df, **how).collect()), key=str)


def test_cover_has_every_difference():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


@pytest.mark.parametrize("unit", [600, 4 << 20])
def test_planted_passages(spark, unit):
    rng = np.random.default_rng(unit)
    letters = list("abcdefghij é\n")
    fresh = lambda n: "".join(rng.choice(letters, n))
    passages = [fresh(int(n)) for n in (60, 99, 100, 101, 131, 170, 400)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            p = passages[int(rng.integers(len(passages)))]
            parts.append(p if rng.random() < 0.6 else p[int(rng.integers(0, 40)) :])
            parts.append(fresh(int(rng.integers(0, 50))))
        rows.append((i * 7, "".join(parts)))
    rows += [(3, rows[5][1]), (1, "ab" * 300), (2, "\0" * 250), (4, "\0" * 180 + "x" + "\0" * 150), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, size=unit, bucket=300) == brute(rows)


def test_edge_cases(spark, make_docs):
    rows = [(i, t) for i, t, _ in EDGE]
    assert got(make_docs(EDGE, extra=True)) == brute(rows)
    assert got(make_docs([])) == []
    assert got(make_docs(EDGE).drop("text")) == brute([(i, None) for i, _ in rows])


def test_sample(spark, sample):
    assert got(sample) == brute([(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()])


def test_spans_and_kept(spark):
    text = "0123456789" * 12
    rows = repeats.repeated_spans(spark.createDataFrame([(1, "x" + text + "y"), (2, "abc" + text + "z")], "doc_id long, text string")).collect()
    second = next(r for r in rows if r.doc_id == 2)
    assert [tuple(s) for s in second.spans] == [(3, 123)] and bytes(second.kept) == b"abcz"


def test_order_is_that_of_all_keys():
    rng = np.random.default_rng(5)
    for n, most in ((0, 1), (1, 1), (5000, 1 << 60), (5000, 4000), (5000, 3)):
        one, two, at = rng.integers(0, most, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64), rng.permutation(n)
        assert repeats._order(one, two, at).tolist() == np.lexsort((at, two, one)).tolist()
