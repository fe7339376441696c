"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary's pieces make a trie over bytes. Each node knows how many pieces are popped when the match can't go on from
it, and the node from which it then goes on (its failure link); both are computed once, from the root down. A word is read
once, byte by byte, and its pieces are counted without being built. Words begin with the space that the vocabulary's
word-initial pieces carry. The arrays are bounded by the vocabulary; the driver makes and broadcasts them. A task runs its
new words through the automaton side by side and remembers a bounded number of counts.

Defined cases: a null or empty text has no words and no tokens. The vocabulary must hold every single byte; then each word
has a greedy segmentation. Words of any length are read to their end, in time linear in their length. Repeated rows and null
ids each get a row; other columns are ignored. No documents give no rows.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, small_batches

#: Counts of words that a task remembers, and bytes of a word that it remembers at most.
CACHE, LONGEST = 200_000, 64


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie transitions as a hash table over (node, byte), failure links and popped-piece counts."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    is_piece.append(False)
                node = nxt
            is_piece[node] = True
        if len(children[0]) < 256 or not all(is_piece[children[0][c]] for c in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        n = len(children)
        self.fail, self.popped = np.zeros(n, np.int32), np.zeros(n, np.int32)
        layer = [0]
        while layer:
            below = []
            for u in layer:
                for c, v in children[u].items():
                    if is_piece[v]:
                        self.fail[v], self.popped[v] = 0, 1
                    else:
                        z, more = int(self.fail[u]), 0
                        while c not in children[z]:
                            more, z = more + int(self.popped[z]), int(self.fail[z])
                        self.fail[v], self.popped[v] = children[z][c], self.popped[u] + more
                    below.append(v)
            layer = below
        keys = np.array([(u << 8) | c for u in range(n) for c in children[u]], np.int64)
        heads = np.array([v for u in range(n) for v in children[u].values()], np.int32)
        self.bits = int(np.ceil(np.log2(len(keys)))) + 2
        self.keys, self.heads = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.heads[slot[placed]] = heads[placed]
            keys, heads, slot = keys[~placed], heads[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFF) >> 7) & ((1 << self.bits) - 1)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node by each byte; -1 if there is none."""
        keys = (nodes.astype(np.int64) << 8) | chars
        out, at, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(at):
            held = self.keys[slot]
            hit = held == keys[at]
            out[at[hit]] = self.heads[slot[hit]]
            on = ~hit & (held != -1)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word: the few over LONGEST bytes one after the other, the others side by side."""
        short = np.fromiter((len(w) <= LONGEST for w in words), bool, len(words))
        out = np.empty(len(words), np.int64)
        out[short] = self._side_by_side([w for w in words if len(w) <= LONGEST])
        out[~short] = [self._walk(w) for w in words if len(w) > LONGEST]
        return out

    @functools.cached_property
    def _moves(self) -> tuple[dict, list, list]:
        """Transitions, failure links and popped counts for walking byte by byte."""
        held = np.flatnonzero(self.keys >= 0)
        return dict(zip(self.keys[held].tolist(), self.heads[held].tolist(), strict=True)), self.fail.tolist(), self.popped.tolist()

    def _walk(self, word: bytes) -> int:
        moves, fail, popped = self._moves
        node = total = 0
        for c in word:
            nxt = moves.get(node << 8 | c)
            while nxt is None:
                total, node = total + popped[node], fail[node]
                nxt = moves.get(node << 8 | c)
            node = nxt
        while node:
            total, node = total + popped[node], fail[node]
        return total

    def _side_by_side(self, words: list[bytes]) -> np.ndarray:
        """All words at the same place at a time, the longest first."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths, data = lengths[order], np.frombuffer(b"".join(words), np.uint8)
        node, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        longest = int(lengths[0]) if len(words) else 0
        alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # words with more than i bytes
        for i in range(longest):
            live = alive[i]
            at, char = np.arange(live), data[starts[:live] + i]
            while len(at):
                nxt = self.step(node[at], char[at])
                stuck = nxt < 0
                node[at[~stuck]] = nxt[~stuck]
                at = at[stuck]
                total[at] += self.popped[node[at]]
                node[at] = self.fail[node[at]]
        at = np.flatnonzero(node)
        while len(at):
            total[at] += self.popped[node[at]]
            node[at] = self.fail[node[at]]
            at = at[node[at] > 0]
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


class _Counts(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row; vocabulary: a file on the driver (see ``read_vocabulary``)."""
    spark = docs.sparkSession
    small_batches(spark)
    automaton = spark.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))

    def run(batches):
        auto, held = automaton.value, _Counts()
        for b in batches:
            texts = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            if len(held) > CACHE:
                held.clear()
            new = list({w for words in texts for w in words if w not in held})
            now = dict(zip(new, auto.counts([b" " + w for w in new]).tolist(), strict=True))
            held.update((w, n) for w, n in now.items() if len(w) <= LONGEST)
            count = lambda w: n if (n := held[w]) >= 0 else now[w]
            tokens = [sum(map(held.__getitem__, words)) if all(len(w) <= LONGEST for w in words) else sum(map(count, words)) for words in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    doc_id, text = columns(docs, id_col, text_col)
    return docs.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
