"""Edge counts kept as deltas: a batch writes its own counts, and full levels are merged into the next.

A folder ``level=l/span=s`` holds the counts of the ``FAN``^l batches from s · FAN^l on, cut into buckets by edge. When a batch completes a
span of the next level, its ``FAN`` folders are merged into one; so a count is rewritten once a level, and a reader merges at most
``FAN`` - 1 folders a level. A folder counts once its write has succeeded. A replayed batch writes its folder again, or nothing
where a merged one covers it; folders that a merged one covers stay until the next merge of that level, for readers that began before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN, BUCKETS = 8, 16
COUNTS = "source string, relation string, target string, n long"
_KEY = ("source", "relation", "target")


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _at(path: str, level: int, span: int) -> str:
    return f"{path}/level={level}/span={span}"


def _names(spark: SparkSession, path: str, key: str) -> list[int]:
    fs, folder = _fs(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{key}="))


def whole_folders(spark: SparkSession, path: str) -> set[tuple[int, int]]:
    """(level, span) of the folders whose write succeeded."""
    found = [(level, span) for level in _names(spark, path, "level") for span in _names(spark, f"{path}/level={level}", "span")]
    return {f for f in found if (p := _fs(spark, f"{_at(path, *f)}/_SUCCESS"))[0].exists(p[1])}


def live(folders: set[tuple[int, int]], version: int | None = None, fan: int = FAN) -> list[tuple[int, int]]:
    """The folders that make up the store after batch ``version``, or after the last: each batch in one of them, the widest."""
    last = max((fan**level * (span + 1) for level, span in folders), default=0) - 1
    last, at, out = last if version is None else min(version, last), 0, []
    while at <= last:
        fits = [(level, span) for level, span in folders if fan**level * span == at and fan**level * (span + 1) - 1 <= last]
        if fits:
            out.append(max(fits))
            at = fan ** out[-1][0] * (out[-1][1] + 1)
        elif any(fan**level * span <= at < fan**level * (span + 1) for level, span in folders):
            raise ValueError(f"batch {at} is merged with later ones than {version}")
        else:
            at += 1  # a batch without rows
    return out


def _read(spark: SparkSession, path: str, folders: list[tuple[int, int]]) -> DataFrame:
    parts = [spark.read.schema(COUNTS).parquet(_at(path, *f)).select("source", "relation", "target", "n") for f in folders]
    out = spark.createDataFrame([], COUNTS) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*_KEY).agg(F.sum("n").alias("n"))


def _write(counts: DataFrame, path: str) -> None:
    bucket = F.pmod(F.xxhash64(*_KEY), F.lit(BUCKETS)).cast("int")
    counts.withColumn("bucket", bucket).repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def add_batch(batch: DataFrame, path: str, batch_id: int, fan: int = FAN) -> None:
    """Add a batch of edges under its id; ids count up from 0. The same id twice counts once."""
    spark = batch.sparkSession
    folders = whole_folders(spark, path)
    if not any(level and fan**level * span <= batch_id < fan**level * (span + 1) for level, span in folders):
        _write(batch.groupBy(*_KEY).agg(F.count("*").alias("n")), _at(path, 0, batch_id))
        folders.add((0, batch_id))
    level, done = 1, batch_id + 1
    while done % fan**level == 0:
        span = done // fan**level - 1
        if (level, span) not in folders:
            _write(_read(spark, path, sorted((lower, s) for lower, s in folders if lower == level - 1 and s // fan == span)), _at(path, level, span))
            folders.add((level, span))
        for old in [f for f in folders if f[0] == level - 1 and f[1] // fan < span and (level, f[1] // fan) in folders]:
            fs, folder = _fs(spark, _at(path, *old))
            fs.delete(folder, True)
            folders.discard(old)
        level += 1


def read_store(spark: SparkSession, path: str, version: int | None = None, fan: int = FAN) -> DataFrame:
    """(source, relation, target, n) after batch ``version``, by default the last; empty before the first."""
    return _read(spark, path, live(whole_folders(spark, path), version, fan))
