import random

import pytest

from graphjobs.operators import needles, verify


@pytest.mark.parametrize("set_bytes", [60, 1 << 20])
def test_contained_and_containing(spark, set_bytes):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abl é") for _ in range(rng.randint(1, 4)))
    asked = [(rng.randint(0, 2), word() + (" ltd" if rng.random() < 0.5 else "")) for _ in range(60)] + [(0, ""), (1, None), (None, "a"), (7, "a")]
    texts = [(rng.randint(0, 2), " ".join(word() for _ in range(rng.randint(0, 9))) + " ltd") for _ in range(80)] + [(0, None), (None, "a"), (8, "a")]
    n, t = spark.createDataFrame(asked, "scope int, needle string"), spark.createDataFrame(texts, "scope int, text string")
    met = lambda s, w: any(a == s and b is not None and w in b for a, b in texts)
    want = {(s, w) for s, w in asked if w == "" or (s is not None and w and met(s, w))}
    assert {tuple(r) for r in needles.contained(n, t, set_bytes).collect()} == want
    want = {(s, x) for s, x in texts if s is not None and x and any(a == s and w and w in x for a, w in asked)}
    assert {tuple(r) for r in needles.containing(t, n, set_bytes).collect()} == want


def test_no_needles_or_texts(spark):
    n, t = spark.createDataFrame([], "scope int, needle string"), spark.createDataFrame([(0, "a")], "scope int, text string")
    assert needles.contained(n, t).count() == needles.containing(t, n).count() == 0
    one = spark.createDataFrame([(0, "a"), (0, "")], "scope int, needle string")
    assert [r.needle for r in needles.contained(one, t.where("false")).collect()] == [""]


def test_missing_facts(spark):
    facts = spark.createDataFrame([(0, "1", "abn", ["111", "1 1 1"]), (0, "2", "hq", ["nowhere"]), (1, "3", "hq", ["perth"])], "shard int, idx string, kind string, needles array<string>")
    nodes = spark.createDataFrame([(0, "Perth")], "shard int, name string")
    edges = spark.createDataFrame([(0, "X Ltd", "has abn", "1 1 1")], "shard int, source string, relation string, target string")
    assert sorted(r.idx for r in verify.missing_facts(facts, nodes, edges).collect()) == ["2", "3"]
    assert {(r.kind, r.found, r.expected) for r in verify.verify_facts(facts, nodes, edges).collect()} == {("abn", 1, 1), ("hq", 0, 2)}
