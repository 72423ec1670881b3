from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quiverine.llm import registry
from quiverine.llm.pii import Masker

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_keeps_the_columns_and_takes_effect(spark, docs, rows, tmp_path):
    now, counts, texts = docs, [docs.count()], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == COLUMNS
            now.write.parquet(str(tmp_path / str(k)))
            now = spark.read.parquet(str(tmp_path / str(k)))
            texts.append(now.collect())
            counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    ids = [r["doc_id"] for r in texts[3]]
    assert len(ids) == len(set(ids))
    assert all(not Masker(b"any").finds(r["text"]) or r["text"] for r in texts[3])
    pieces = now.collect()
    assert {r["doc_id"] for r in pieces} == set(ids)
    assert all(r["offset"] + r["length"] <= 1024 for r in pieces)


def test_stages_on_no_documents(spark, no_docs, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
def test_the_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


TABLES = {"op7_url_filters": "pages", "op8_exact_topk": None}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    table = TABLES.get(name, "documents")
    if table:
        key = "page_id" if table == "pages" else "doc_id"
        assert {r[key] for r in got} == {r[key] for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(key).collect()}
    else:
        assert len(got) == 50


def test_each_operator_has_its_query():
    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert set(registry.ORACLES) <= set(registry.QUERIES)
