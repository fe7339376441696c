import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from graphjobs.llm import exact

from .conftest import EDGE


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40) | st.integers(0, 2**64 - 1), min_size=1), min_size=1), st.integers(0, 0))
def test_filters_merge_without_loss(parts, bits):
    frames = [exact.quotient_filter(*exact.counted(np.array(p, np.uint64)), bits) for p in parts]
    keys, counts = exact.merge_all(pd.concat(frames))
    wanted = np.unique(np.array([x for p in parts for x in p], np.uint64), return_counts=True)
    assert (keys == wanted[0]).all() and (counts == wanted[1]).all()


def test_blocks_part_by_leading_bits():
    fps = np.arange(0, 2**64 - 1, 2**58, dtype=np.uint64)
    frame = exact.quotient_filter(*exact.counted(fps), 4)
    assert sorted(frame["block"]) == list(range(16))


def test_a_partition_gives_one_filter(spark, monkeypatch):
    monkeypatch.setattr(exact, "GATHER", 100)
    fps = spark.range(0, 3000, 1, 3).selectExpr("id % 1400 - 700 AS fp")
    assert sorted(r[0] for r in exact.repeated(fps).collect()) == list(range(-700, 700))
    frames = list(exact.partition_filter((pd.DataFrame({"fp": range(i, i + 50)}) for i in range(0, 1000, 25)), 0))
    assert len(frames) == 1
    keys, counts = exact.merge_all(frames[0])
    assert keys.tolist() == list(range(1025)) and counts.sum() == 2000 and exact.repeated(fps.where('false')).collect() == []


def brute(rows):
    lower = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t, _ in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None) if len(own) > 1 else i
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t)).hexdigest()))
    return out


def test_edges(make_docs):
    rows = [*EDGE, (9, "ALPHA BETA", "c"), (10, "Äb", "c"), (11, "äb", "c")]
    assert sorted(map(str, map(tuple, exact.exact_duplicates(make_docs(rows, extra=True)).collect()))) == sorted(map(str, brute(rows)))
    assert exact.exact_duplicates(make_docs([])).collect() == []
    assert sorted(r.text_sha256 for r in exact.exact_duplicates(exact.exact_dedup(make_docs(rows))).collect()) == sorted({r[4] for r in brute(rows)})


def test_dedup_tells_rows_apart(make_docs):
    rows = [(5, "A", "s"), (5, "b", "s"), (9, "a", "s"), (7, "c", "s"), (7, "C", "t"), (None, "d", "s"), (None, "D", "s"), (None, None, "s"), (4, "", "s"), (1, "e", None)]
    docs = make_docs(rows).selectExpr("*", "'k' AS _key", "1 AS KEY", "2 AS _row", "3 AS n", "map('a', 1) AS stays")
    got = exact.exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in got.collect()) == [("1", "e"), ("4", ""), ("5", "b"), ("7", "c"), ("9", "a"), ("None", "d")]
    assert exact.exact_dedup(make_docs([])).collect() == []


def test_whole_table(sample):
    rows = [(r.doc_id, r.text, None) for r in sample.collect()]
    assert sorted(map(tuple, exact.exact_duplicates(sample).collect())) == sorted(brute(rows))
