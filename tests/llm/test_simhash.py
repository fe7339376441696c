import re

import numpy as np
import pytest
import xxhash

from graphjobs.llm import simhash

from .conftest import EDGE


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_whole_table_against_brute_force(spark, sample):
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(sample).collect()}
    prints = {r.doc_id: brute_print(r.text) for r in sample.collect()}
    parts = brute_components(prints)
    assert got == {i: (f"{p:016x}", parts[i]) for i, p in prints.items()}
    assert len(set(parts.values())) < len(parts)


@pytest.mark.parametrize(("block", "crowd"), [(4_000_000, 1 << 19), (20_000, 1 << 19), (20_000, 40)])
def test_all_links_within_radius_are_found(spark, block, crowd, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(4):
            for at in rng.choice(64, rng.integers(1, 7), replace=False):
                b ^= 1 << int(at)
            prints.add(b)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CROWD", crowd)  # 40: crowded groups are dealt on, down to all bits
    own = np.array(sorted(prints), np.uint64)
    a, b = simhash._meet(own, np.full(len(own), 2), 64, 2)
    from graphjobs.llm.common import local_roots

    root = local_roots(a, b, len(own))
    assert [own[r] for r in root] == list(brute_components({int(p): int(p) for p in own}).values())
    fps = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in own], "fp long")
    from graphjobs.llm.common import connected_components

    edges = connected_components(simhash.links(fps)).collect()
    moved = {r[0]: r[1] for r in edges}
    signed = own.view(np.int64).tolist()
    groups = {}
    for p in signed:
        groups.setdefault(moved.get(p, p), set()).add(p)
    wanted = {}
    for p, r in zip(signed, root, strict=True):
        wanted.setdefault(int(r), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_edges(make_docs):
    got = simhash.near_duplicates(make_docs(EDGE, extra=True)).collect()
    assert len(got) == len(EDGE)
    by = {(r[0], r[1]): r[2] for r in got}
    for i, t, _ in EDGE:
        assert (i, f"{brute_print(t):016x}") in by
    assert by[(2, "0" * 16)] == 1
    assert simhash.near_duplicates(make_docs([])).collect() == []
    kept = simhash.near_dedup(make_docs([(1, "a b c d e f", "s"), (2, "A b c d e f", "s"), (3, "other", "s")], extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and "fp" in kept.columns
    rows = [(5, "a b c d e f", "s"), (9, "A b c d e f", "s"), (9, "a text of its own", "s"), (None, "a B c d e f", "s")]
    kept = simhash.near_dedup(make_docs(rows).selectExpr("*", "1 AS _row", "2 AS row", "3 AS component_id")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(5, "a b c d e f"), (9, "a text of its own")]
