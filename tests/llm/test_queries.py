"""The registered queries against SQL or their row counts, and the pipeline on odd rows."""

import pytest

import corpus_pipeline
from envlake.checks.compare import compare
from envlake.llm import queries as Q
from tests.llm.conftest import frame


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, sf, name):
    r = compare(spark, name, Q.QUERIES[name], Q.SQL[name], sf)
    assert r.get("match"), r


def test_pipeline_stages(spark, sf, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.columns == ["doc_id", "ids"]


def test_pipeline_on_an_empty_table(spark, sf, none, tmp_path):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.columns == ["doc_id", "ids"] and docs.count() == 0


def test_near_copies_leave_one_of_each_group(spark, sf, documents):
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, documents.unionAll(documents.limit(5)), sf).select("doc_id").collect()}
    rows = corpus_pipeline.near_copies(spark, documents.unionAll(documents.limit(5)), sf).count()
    from envlake.llm.ngram_join import jaccard_components
    assert rows == len(kept) and kept == {r["component_id"] for r in jaccard_components(documents, 5, 80).collect()}


def test_near_copies_of_rows_with_null_and_repeated_ids(spark, sf):
    def text(name, edit=""):
        return " ".join([f"{name}{k}" for k in range(80)] + [edit])
    rows = [(None, text("a"), "en", "s"), (None, text("a", "x"), "en", "s"), (None, text("a"), "en", "s"), (None, text("n"), "en", "s"),
            (None, text("b", "y"), "en", "s"), (2, text("b"), "en", "s"),
            (3, text("c"), "en", "s"), (3, text("b", "z"), "en", "s"), (4, text("c", "q"), "en", "s"), (3, text("c"), "en", "s")]
    kept = sorted((r["doc_id"] or 0, r["text"][0]) for r in corpus_pipeline.near_copies(spark, frame(spark, rows), sf).collect())
    assert kept == [(0, "a"), (0, "n"), (2, "b"), (3, "c")]
