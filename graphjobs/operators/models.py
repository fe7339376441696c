"""Jobs around models that the caller brings: fn takes and gives batches of series; a row that fails gets nothing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise_phrase
from .corpus import pending_passages

Model = Callable[[pd.Series], pd.Series]


def _safely(fn: Model, texts: pd.Series) -> list:
    """fn over a batch; if the batch fails, over its rows one by one, None for those that fail."""
    try:
        return list(fn(texts))
    except Exception:
        out = []
        for t in texts:
            try:
                out.append(next(iter(fn(pd.Series([t])))))
            except Exception:
                out.append(None)
        return out


def extract_documents(docs: DataFrame, fn: Model, done: DataFrame | None = None) -> DataFrame:
    """(passage, title, extracted_entities, extracted_triples) of pending docs (title, passage); fn gives (entities, triples)."""
    todo = docs if done is None else pending_passages(docs, done)

    def run(pdfs: Iterator[pd.DataFrame]):
        for pdf in pdfs:
            got = [g if g is not None else ([], []) for g in _safely(fn, pdf["passage"])]
            yield pd.DataFrame({"passage": pdf["passage"], "title": pdf["title"], "extracted_entities": [list(g[0]) for g in got], "extracted_triples": [[list(t) for t in g[1]] for g in got]})

    return todo.select("passage", "title").mapInPandas(run, "passage string, title string, extracted_entities array<string>, extracted_triples array<array<string>>")


def extract_question_entities(samples: DataFrame, fn: Model, done: DataFrame | None = None) -> DataFrame:
    """(id, entities) of samples (id, question) that done lacks."""
    todo = samples if done is None else samples.join(done.select("id"), "id", "left_anti")
    kind = dict(samples.dtypes)["id"]

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"id": pdf["id"], "entities": [list(g) if g is not None else [] for g in _safely(fn, pdf["question"])]})

    got = todo.select("id", "question").mapInPandas(run, f"id {kind}, entities array<string>")
    return got.select("id", F.filter(F.transform("entities", normalise_phrase), lambda e: e != "").alias("entities"))


def embed_texts(df: DataFrame, fn: Model, is_query: bool = False, instruct: str = "") -> DataFrame:
    """df with vec of its text; queries carry the instruction before them."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(_safely(fn, texts))

    own = F.concat(F.lit(f"Instruct: {instruct}\nQuery: "), "text") if is_query and instruct else F.col("text")
    return df.withColumn("vec", vectors(own))


def generate_answers(contexts: DataFrame, fn: Model) -> DataFrame:
    """(query, response) of contexts (query, context); failed rows are left out."""
    kind = dict(contexts.dtypes)["query"]

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"query": pdf["query"], "response": _safely(fn, pdf["context"])}).dropna(subset=["response"])

    return contexts.select("query", "context").mapInPandas(run, f"query {kind}, response string")


def toy_extractor(texts: pd.Series) -> pd.Series:
    """A stand-in for a model: capitalised words are entities, neighbours among them are related."""
    def one(text):
        names = [w.strip(".,!?") for w in text.split() if w[:1].isupper()]
        return names, [[a, "precedes", b] for a, b in zip(names, names[1:], strict=False)]
    return texts.map(one)


def toy_embedder(texts: pd.Series) -> pd.Series:
    """Letter counts."""
    return texts.map(lambda t: [float(t.lower().count(chr(97 + i))) for i in range(26)])


def toy_answer(contexts: pd.Series) -> pd.Series:
    return contexts.map(lambda c: f"Answer: {json.dumps(c[:20])}")
