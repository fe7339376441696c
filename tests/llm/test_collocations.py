import re
from collections import Counter

import numpy as np

from graphjobs.llm import collocations

from .conftest import EDGE


def brute(rows, least, top):
    """Contract by counting every phrase; rows: (lang, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        held = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if any(len(q) > len(p) and (q[:2] == p or q[1:] == p) and 100 * b >= 50 * a for q, b in held.items()):
                continue
            score, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df, **how):
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_random_texts_in_several_shards(spark):
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "the", "of", "é", "tab\tbed", "x.", "y,", "end\r", "日本", "N"]
    rows = [(str(rng.choice(["a", "b"])), " ".join(rng.choice(words, int(rng.integers(0, 60))))) for _ in range(300)]
    rows += [(None, "one two three one two three"), ("und", "one two three"), ("a", None), ("a", "")]
    for least, top in ((10, 2000), (2, 40), (3, 5)):
        assert got(frame(spark, rows), least=least, top=top, shard=500) == brute(rows, least, top)


def test_ties_and_overlaps(spark):
    rows = [("a", "a a a a a a a a a a a a"), ("a", "b c. c b; b c! c b? b c: b c"), ("b", "z y\nz y\x0bz y\x0cz y")]
    assert got(frame(spark, rows), least=2, top=3, shard=3) == brute(rows, 2, 3)


def test_edge_cases(spark, make_docs):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [("a", None), (None, "..., ")])) == []
    docs = make_docs(EDGE, extra=True)
    assert got(docs) == brute([("en", t) for _, t, _ in EDGE], 10, 2000)
    assert got(docs.drop("lang", "text")) == []


def test_index_intervals():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 6, 400)
    index = collocations.FMIndex(words)
    seen = Counter(tuple(words[i : i + 3]) for i in range(398) if 0 not in words[i : i + 3])
    for grown in (index.left(*index.right(*index.words())), index.right(*index.right(*index.words())), index.right(*index.left(*index.words()))):
        assert {tuple(p): n for p, n in zip(grown[0].tolist(), grown[3].tolist(), strict=True)} == seen
