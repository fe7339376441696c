import random
from collections import Counter
from pathlib import Path

import pytest

from graphjobs.streaming import increment, store

KIND = "source string, relation string, target string"


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_batches_merges_and_replays(spark, tmp_path):
    rng, path, seen, versions = random.Random(1), str(tmp_path / "s"), Counter(), {}
    assert store.read_store(spark, path).count() == 0
    for b in range(10):
        rows = [(f"s{rng.randint(0, 3)}", "r", f"t{rng.randint(0, 2)}") for _ in range(rng.randint(1, 20))]
        batch = spark.createDataFrame(rows, KIND)
        seen.update(rows)
        versions[b] = dict(seen)
        for _ in range(1 + b % 2):  # every other batch comes twice
            store.add_batch(batch, path, b, fan=3)
        assert {tuple(r)[:3]: r.n for r in store.read_store(spark, path, fan=3).collect()} == seen
    folders = store.whole_folders(spark, path)
    assert {(2, 0), (0, 9)} <= folders and (0, 0) not in folders
    assert store.live(folders, fan=3) == [(2, 0), (0, 9)]
    assert {tuple(r)[:3]: r.n for r in store.read_store(spark, path, 8, fan=3).collect()} == versions[8]
    with pytest.raises(ValueError, match="merged"):
        store.read_store(spark, path, 1, fan=3)


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    store.add_batch(spark.range(5000).selectExpr("uuid() AS source", "'r' AS relation", "uuid() AS target"), path, 0)
    large = size(path)
    store.add_batch(spark.createDataFrame([("a", "r", "b")], KIND), path, 1)
    assert size(path) - large < 3000 < large / 20


def test_an_unfinished_folder_is_not_read(spark, tmp_path):
    path = str(tmp_path / "s")
    for b in range(2):
        store.add_batch(spark.createDataFrame([("a", "r", "b")], KIND), path, b)
    Path(store._at(path, 0, 1), "_SUCCESS").unlink()
    assert [r.n for r in store.read_store(spark, path).collect()] == [1]
    store.add_batch(spark.createDataFrame([("a", "r", "b")], KIND), path, 1)
    assert [r.n for r in store.read_store(spark, path).collect()] == [2]


def test_windows_of_a_stream(spark, tmp_path):
    """Late rows within the watermark count; those of final windows are dropped."""
    kind = KIND + ", ts timestamp"
    sent = [["2024-01-01 10:00", "2024-01-20 10:00"], ["2024-01-12 09:00", "2024-01-05 09:00"], ["2026-01-01 00:00"]]
    for times in sent:
        rows = spark.createDataFrame([("a", "r", "b", t) for t in times], KIND + ", ts string").selectExpr("source", "relation", "target", "CAST(ts AS timestamp) AS ts")
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        increment.stream_windows(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "1 day", "10 days").awaitTermination()
    got = sorted((str(r.start)[:10], r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01", 1), ("2024-01-12", 1), ("2024-01-20", 1)]
