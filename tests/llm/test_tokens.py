import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphjobs.llm import packing, tokencount

from .conftest import EDGE

VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, pieces):
    n = at = 0
    longest = max(map(len, pieces))
    while at < len(word):
        at += next(s for s in range(min(longest, len(word) - at), 0, -1) if word[at : at + s] in pieces)
        n += 1
    return n


def brute_counts(text, pieces):
    words = (text or "").encode().split()
    return len(words), sum(greedy(b" " + w, pieces) for w in words)


def test_counts_against_greedy(sample, make_docs):
    pieces = set(tokencount.read_vocabulary(VOCAB))
    got = sorted(map(tuple, tokencount.token_counts(sample, VOCAB).collect()))
    assert got == sorted((r.doc_id, *brute_counts(r.text, pieces)) for r in sample.collect())
    short = [e for e in EDGE if e[0] != 6]
    got = sorted(map(str, map(tuple, tokencount.token_counts(make_docs(short, extra=True), VOCAB).collect())))
    assert got == sorted(str((i, *brute_counts(t, pieces))) for i, t, _ in short)
    assert tokencount.token_counts(make_docs([]), VOCAB).collect() == []


def test_automaton_falls_back_over_several_nodes():
    pieces = [bytes([c]) for c in range(256)] + [b"abcdef", b"bc", b"cdex", b"de", b"abcx"]
    words = [b"abcdeg", b"abcde", b"abcdef", b"cdeabcdex", b"", b"abc"]
    assert tokencount.Automaton(pieces).counts(words).tolist() == [greedy(w, set(pieces)) for w in words]
    with pytest.raises(ValueError):
        tokencount.Automaton([b"a"])


def test_long_words_are_walked(make_docs):
    import time

    auto = tokencount.Automaton(tokencount.read_vocabulary(VOCAB))
    words = [b" " + b"AbC/9+xyz" * n for n in (7, 8, 30)] + [bytes(range(256)) * 2]
    assert [auto._walk(w) for w in words] == auto._side_by_side(words).tolist() == auto.counts(words).tolist()
    began = time.process_time()
    got = tokencount.token_counts(make_docs([(1, "ab9/" * 500_000, "a")]), VOCAB).collect()[0]
    assert got.n_words == 1 and auto.counts([b" " + b"ab9/" * 500_000])[0] == got.n_tokens and time.process_time() - began < 10


def check_packing(rows, pieces, size=packing.SIZE):
    own = Tokenizer.from_file(WORDS)
    left = defaultdict(int)
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[i] = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        left[i] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        assert p.doc_tokens == len(ids[p.doc_id])
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, n in left.items():
        covered = np.zeros(len(ids[i]) + 1, int)
        for p in by_doc[i]:
            covered[p.start] += 1
            covered[p.start + p.length] -= 1
        assert (covered.cumsum()[:-1] == n).all()
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(1, total)


def test_packing_round_trip(sample, make_docs):
    rows = [(r.doc_id, r.text, None) for r in sample.collect()]
    assert check_packing(rows, packing.pack(sample, WORDS).collect()) < 0.02
    odd = [*EDGE, (20, "<|endoftext|> it's  o'clock\r\n\x0b 12345   İSTANBUL é", "a")]
    check_packing([r for r in odd], packing.pack(make_docs(odd, extra=True), WORDS).collect())
    assert packing.pack(make_docs([]), WORDS).collect() == []


def test_shortest_pack_first_places_all():
    histogram = {10: 7, 9: 3, 5: 4, 1: 2}
    patterns = packing.shortest_pack_first(dict(histogram), 16)
    placed = defaultdict(int)
    for pattern, n in patterns:
        assert sum(pattern) <= 16
        for length in pattern:
            placed[length] += n
    assert placed == histogram
