import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
        return df.selectExpr("*", "'x' AS fp", "1 AS n", "2 AS size", "'y' AS key", "0 AS rank") if extra else df

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table, read whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


EDGE = [(1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (None, "alpha beta", "b"), (5, "x" * 300_000, "b"), (6, "word " * 60_000, "b"), (7, "Alpha beta", None), (7, "Alpha beta", None), (8, "é ü 日本   tail", "a")]
