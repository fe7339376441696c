"""Many strings looked for in many texts, by a multi-pattern automaton.

Needles are dealt to sets of a measured size; each set is broadcast and a task reads its texts once for it, whatever the
needles are: a frequent word or a short needle costs its matches and nothing else. Matches are made distinct in a task's
batch before they are shuffled. The work is texts times sets, so ``SET_BYTES`` bounds memory and not results.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Bytes of needles that are broadcast at once; the automaton of a worker takes some ten times as much.
SET_BYTES = 8 << 20


def _automaton(needles) -> ahocorasick.Automaton:
    """needles: (needle, scopes)."""
    found = ahocorasick.Automaton()
    for needle, scopes in needles:
        found.add_word(needle, (needle, frozenset(scopes)))
    found.make_automaton()
    return found


class _Scan:
    """Reads the texts of a partition for one broadcast set; built in the worker, once a partition."""

    def __init__(self, held, side: str, scopes: str, texts: str):
        self.held, self.side, self.kinds = held, side, (scopes, texts)

    def __call__(self, pdfs):
        found = _automaton(self.held.value)
        for pdf in pdfs:
            met = set()
            for scope, text in zip(pdf["scope"], pdf["text"], strict=True):
                if self.side == "text":
                    if any(scope in scopes for _, (_, scopes) in found.iter(text)):
                        met.add((scope, text))
                else:
                    met.update((scope, needle) for _, (needle, scopes) in found.iter(text) if scope in scopes)
            yield pd.DataFrame(sorted(met), columns=["scope", self.side])


def _matches(needles: DataFrame, texts: DataFrame, side: str, set_bytes: int) -> DataFrame:
    spark = texts.sparkSession
    scope = dict(texts.dtypes)["scope"]
    own = cut(needles.where("needle <> ''").groupBy("needle").agg(F.collect_set("scope").alias("scopes")))
    read = cut(texts.select("scope", "text").where("scope is not null and text <> ''").distinct())
    total = own.agg(F.sum(F.octet_length("needle") + 16 * F.size("scopes"))).first()[0] or 0
    sets, out = max(1, -(-total // set_bytes)), None
    for i in range(sets):
        mine = own.where(F.pmod(F.xxhash64("needle"), F.lit(sets)) == i).collect()  # about set_bytes
        if mine:
            held = spark.sparkContext.broadcast([(r.needle, r.scopes) for r in mine])
            one = read.mapInPandas(_Scan(held, side, scope, "string"), f"scope {scope}, {side} string").distinct()
            out = one if out is None else out.unionByName(one)
    return out.distinct() if out is not None else spark.createDataFrame([], f"scope {scope}, {side} string")


def contained(needles: DataFrame, texts: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """(scope, needle) of those that some text of their scope contains; both: (scope, needle) and (scope, text), normalised.
    An empty needle is always found; a null one, and a null scope, never."""
    empty = needles.where("needle = ''").select("scope", "needle").distinct()
    return _matches(needles, texts, "needle", set_bytes).unionByName(empty)


def containing(texts: DataFrame, needles: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """(scope, text) of those that contain some needle, not empty, of their scope."""
    return _matches(needles, texts, "text", set_bytes)
