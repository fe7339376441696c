import re

import numpy as np

import corpus_pipeline
from graphjobs.llm import shingles, simhash

from .conftest import EDGE


def brute_kept(rows):
    """Places of the rows that stay, by all pairs of five-word shingle sets."""
    sets = []
    for _, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        key = (doc_id is None, doc_id or 0, i)
        best[find(i)] = min(best.get(find(i), key), key)
    return sorted(k[2] for k in best.values())


def story(changed=(), n=100):
    return " ".join("other" + str(i) if i in changed else f"w{i}" for i in range(n))


def test_near_copies_beyond_four_bits_go(spark, make_docs):
    rows = [(1, story()), (2, story({7, 55})), (3, story({5, 30, 60, 90})), (4, story({0}).upper()), (5, "else")]
    kept = corpus_pipeline.drop_near_copies(spark, make_docs([(i, t, "s") for i, t in rows]), "").collect()
    assert sorted(r.doc_id for r in kept) == [rows[i][0] for i in brute_kept(rows)] == [1, 3, 5]
    # two fingerprints of 6 differing bits, which the rule of op1 leaves apart
    assert 2 in {r.doc_id for r in simhash.near_dedup(make_docs([(i, t, "s") for i, t in rows[:2]])).collect()}


def test_whole_tables_against_brute_force(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert sorted(r.doc_id for r in shingles.near_dedup(sample).collect()) == sorted(rows[i][0] for i in brute_kept(rows))


def test_large_group_is_verified_block_by_block(make_docs, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 8)
    rows = [(i, story({i % 50, 50 + i // 2})) for i in range(40)] + [(100 + i, story(range(i, 40 + i))) for i in range(40)]
    kept = shingles.near_dedup(make_docs([(i, t, "s") for i, t in rows]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[i][0] for i in brute_kept(rows))


def test_edges(make_docs):
    kept = shingles.near_dedup(make_docs(EDGE, extra=True)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(str(EDGE[i][:2]) for i in brute_kept([e[:2] for e in EDGE]))
    assert "fp" in kept[0].asDict() and shingles.near_dedup(make_docs([])).collect() == []


def rows_moved(spark):
    """Rows that Spark has written to shuffles so far."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_texts_that_share_a_passage_are_not_verified_by_pairs(spark, make_docs, monkeypatch):
    """Texts with one passage that each differ too much to be alike, beside a kin of near copies: their number costs, not its square."""
    monkeypatch.setattr(shingles, "BLOCK", 4)
    spent = []
    for n in (60, 180):
        rows = [(i, story(n=60) + "".join(f" own{i}x{k}" for k in range(12 + i % 9))) for i in range(n)]
        rows += [(1000 + i, story({i % 60}, n=60)) for i in range(n // 3)]
        before = rows_moved(spark)
        kept = sorted(r.doc_id for r in shingles.near_dedup(make_docs([(i, t, "s") for i, t in rows])).collect())
        spent.append(rows_moved(spark) - before)
        assert kept == sorted(rows[i][0] for i in brute_kept(rows))
    assert spent[1] < 4.5 * spent[0], spent


def test_pairs_across_kins_lose_no_alike_pair(spark, monkeypatch):
    """In one task and in parts and cells: every alike pair of a group's different kins is among the open pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, (2, 40))
    sets = []
    for i in range(120):
        own = base[i % 2][rng.random(40) < rng.uniform(0.8, 1)]
        own = np.concatenate((own, base[1 - i % 2][: rng.integers(0, 4)], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 9))))
        sets.append(np.unique(own.view(np.uint64)).view(np.int64))
    kin = [i if i % 3 else i % 2 for i in range(120)]  # two kins of many beside texts of their own
    rows = [(1 + i % 7 // 6, i // 9, i, kin[i], sum(map(len, sets)), s.tolist()) for i, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "root long, block long, row long, kin long, total long, g array<long>")
    true = set()
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if rows[i][0] == rows[j][0] and kin[i] != kin[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                true.add((j, i))
    found = []
    for tokens, places in ((1 << 21, 1 << 15), (700, 1 << 15), (700, 5)):
        monkeypatch.setattr(shingles, "TOKENS", tokens)
        monkeypatch.setattr(shingles, "PLACES", places)
        pairs = shingles._open_pairs(held, 0.8)
        found.append({(r.a, r.b) for r in pairs.collect()})
        assert true and {(r.a, r.b) for r in shingles._alike(pairs, held, 0.8).collect()} == true
    assert found[0] == found[1] == found[2]
