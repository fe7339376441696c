import numpy as np
import pytest

from graphjobs.llm import shingles
from graphjobs.llm.common import local_roots

from .test_shingles import brute_kept, story


def drawn(rng, n):
    return rng.integers(0, 1 << 64, n, dtype=np.uint64)


def words(own):
    return np.frombuffer(shingles.prints(np.sort(own), 0.8), np.uint64)


def test_fingerprints_are_majorities():
    own = np.sort(drawn(np.random.default_rng(1), 5001))
    votes = (own[:, None] ^ shingles._ADD[:11]) * shingles._ODD[:11]
    votes ^= votes >> np.uint64(32)
    ones = np.unpackbits(votes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    assert (np.unpackbits(words(own).view(np.uint8), bitorder="little") == (2 * ones > len(own))).all()
    assert [len(shingles.prints(own[:n], 0.8)) // 4 - 4 for n in (4, 31, 32)] == [32, 32, 18] and not shingles.prints(own[:3], 0.8)


@pytest.mark.parametrize(("n", "m", "both"), [(4, 5, 4), (5, 6, 5), (8, 10, 8), (12, 15, 12), (28, 35, 28), (31, 34, 29), (39, 42, 36), (200, 205, 180), (2000, 2000, 1778)])
def test_chance_to_meet_at_the_limit(n, m, both):
    """Pairs at Jaccard 0.8: the share that no table has meet, from the share of tables that do; and the check holds them."""
    rng, missed, far = np.random.default_rng(n), [], 0
    for _ in range(300):
        a = drawn(rng, n + m - both)
        x, y = words(a[:n]), words(a[n - both :])
        x, y = x[: len(y)], y[: len(x)]
        met = np.bitwise_count((x ^ y)[2:].view(np.uint32)) <= 2 * shingles.HALF
        missed.append(met.mean())
        far = max(far, np.bitwise_count((x ^ y)[:2]).sum())
        tables = len(met)
    assert (1 - np.mean(missed)) ** tables < 3e-4 and far <= shingles.FAR


@pytest.mark.parametrize(("variants", "crowd"), [(4_000_000, 16), (3_000, 16), (3_000, 2)])
def test_all_pairs_within_the_radius_are_met(monkeypatch, variants, crowd):
    monkeypatch.setattr(shingles, "VARIANTS", variants)
    monkeypatch.setattr(shingles, "CROWD", crowd)
    rng = np.random.default_rng(3)
    own = np.zeros(400, shingles._ENTRY)
    own["row"], own["left"], own["check"] = np.arange(400), shingles.HALF, 5
    base = drawn(rng, 40) >> np.uint64(32)
    own["fp"] = [int(base[i % 40]) ^ sum(1 << int(b) for b in rng.choice(32, i % 6, replace=False)) for i in range(400)]
    own["check"][::40, 0] = np.uint64(0xFFFFFFFFFFFFFFFF)  # 62 bits from the others
    a, b = shingles._met(own, 32)
    assert (np.bitwise_count(own["fp"][a] ^ own["fp"][b]) <= 4).all()
    x, y = np.triu_indices(400, 1)
    near = np.bitwise_count(own["fp"][x] ^ own["fp"][y]) <= 4
    if crowd > 2:  # a crowd's pairs are taken unchecked
        near &= np.bitwise_count(own["check"][x] ^ own["check"][y]).sum(axis=1) <= shingles.FAR
        assert local_roots(a, b, 400).tolist() == local_roots(x[near], y[near], 400).tolist()
    root = local_roots(a, b, 400)
    assert (root[x[near]] == root[y[near]]).all()


def test_dealt_tables_and_groups_met_once(make_docs, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 4)
    monkeypatch.setattr(shingles, "GROUP", 16)  # tables are dealt by two or three leading bits
    rows = [(i, story({i % 30, 30 + i // 2, 70 + i % 7})) for i in range(40)] + [(100 + i, story(range(3 * i, 40 + i))) for i in range(20)]
    kept = shingles.near_dedup(make_docs([(i, t, "s") for i, t in rows]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[i][0] for i in brute_kept(rows))
