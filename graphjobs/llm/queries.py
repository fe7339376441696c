"""One query an operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, embeddings, exact, mixing, packing, quality, repeats, secrets, sharding, simhash, tokencount, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_secrets(spark, sf_dir):
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op4_exact(spark, sf_dir):
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_tokencount(spark, sf_dir):
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_embeddings(spark, sf_dir):
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_warc(spark, sf_dir):
    return warc.archived(_table(spark, sf_dir, "pages"))


def op8_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_mixing(spark, sf_dir):
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken)


def op10_sharding(spark, sf_dir):
    return sharding.shards(_table(spark, sf_dir, "documents")).drop("bits")


def op11_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_repeats(spark, sf_dir):
    return repeats.digest(_table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP1_SQL = None  # no XXH64 in SQL: tests/llm compares with brute force

OP4_SQL = """
WITH normal AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM normal WINDOW w AS (PARTITION BY text_sha256)"""


def queries():
    names = (
        op1_simhash, op2_quality, op3_secrets, op4_exact, op5_tokencount, op6_embeddings, op7_warc, op8_packing, op9_mixing, op10_sharding,
        op11_whitening, op12_repeats, op13_collocations,
    )
    return {f.__name__: f for f in names}


def oracle_sql():
    return {
        "op4_exact": OP4_SQL, "op6_embeddings": embeddings.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL,
        "op10_sharding": sharding.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL,
    }
