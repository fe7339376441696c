import re

from graphjobs.plans import catalog


def brute(text):
    return None if text is None else re.sub("[^A-Za-z0-9 ]", " ", text.lower()).strip(" ")


def test_normalise_phrase_reads_whole_texts_of_all_documents(spark):
    rows = [(1, "a-B " * 60_000 + "The End!", "en"), (2, "Über Straße, ÉTÉ", "de"), (3, "¿Qué? Ñandú", "es"), (4, "", None), (5, None, "fr"), (6, "\U0001f600 x\ty", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.phrase for r in catalog.normalise_phrase_whole(lambda _: docs).collect()}
    assert got == {i: brute(t) for i, t, _ in rows} and got[1].endswith("the end")
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.phrase for r in catalog.queries()["normalise_phrase_whole"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: brute(r.text) for r in whole.collect()}
