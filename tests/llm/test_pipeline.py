from pathlib import Path

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from graphjobs.llm import common, packing

from .conftest import EDGE
from .test_exact import brute
from .test_shingles import brute_kept
from .test_tokens import WORDS, check_packing


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, step in corpus_pipeline.STAGES:
        tables.append(common.stage(step(spark, tables[-1], sf), name))
    quality, exact, near, mixed, packed = tables[1:]
    assert all(t.columns == docs.columns for t in (quality, exact, near, mixed))
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    rows = [(r.doc_id, r.text, None) for r in quality.collect()]
    assert ids(exact) == sorted(i for i, _, _, kept, _ in brute(rows) if kept)
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    assert ids(near) == sorted(rows[i][0] for i in brute_kept(rows))
    assert set(ids(mixed)) <= set(ids(near)) and max(ids(mixed).count(i) for i in set(ids(mixed))) <= 2
    assert check_packing([(r.doc_id, r.text, None) for r in mixed.collect()], packed.collect()) < 0.02
    assert set(packed.columns) == set(packing.pack(docs, WORDS).columns)


def test_stages_on_odd_rows(spark, make_docs, tmp_path):
    """Null and repeated ids, null, empty and long texts, repeated rows, clashing columns; and an empty table."""
    clash = ["'a' AS _row", "1 AS row", "2 AS _key", "3 AS key", "4 AS log_weight", "5 AS keyed", "6 AS _times", "7 AS copies", "8 AS fp", "9 AS n"]
    odd = [*EDGE, *EDGE, (7, "another text under a known id", "b"), (None, "no id either", None)]
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd, []):
        docs = make_docs(rows).selectExpr("*", *clash)
        texts = {(t or "").lower() for _, t, _ in rows}
        for name, step in corpus_pipeline.STAGES:
            out = common.stage(step(spark, docs, str(tmp_path)), name)
            if name in ("exact_dedup", "near_dedup"):  # no text is lost, and none stays twice
                left = [(r.text or "").lower() for r in out.collect()]
                assert len(left) == len(set(left)) and (name != "exact_dedup" or set(left) == texts)
            if name == "packing":
                check_packing([(r.doc_id, r.text, None) for r in docs.collect() if r.doc_id is not None and r.doc_id != 7], [p for p in out.collect() if p.doc_id is not None and p.doc_id != 7])
            else:
                assert out.columns == docs.columns
            docs = out


def test_stages_leave_each_others_results(spark, make_docs):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.keep_quality(spark, docs, sf)
    other = corpus_pipeline.mix_sources(spark, make_docs([(1, "a b", "x"), (2, "c", "y")]), sf)
    second = corpus_pipeline.drop_copies(spark, docs, sf)
    assert first.count() > 0 and second.count() > 0 and other.count() > 0


def test_run_deletes_what_it_wrote(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:2] * 2)
    with common.recorded() as made:
        out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
        assert list(made.values()) == [out] and out.count() > 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster())
    Cluster.sparkContext.master = "local[4]"
    assert common.shared_dir(Cluster())
    staged = common.stage(spark.range(3), "gone")
    after = common.stage(staged.selectExpr("id + 1 AS id"), "after", staged)
    assert after.count() == 3 and not Path(staged._staged_at).exists()


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
