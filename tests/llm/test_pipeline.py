"""The pipeline against its rules on the smallest tables, and stage columns."""

import os

import pytest

import corpus_pipeline
from pipeweave.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        now = docs.count()
        assert 0 < now <= left, name
        if name != "byte_level_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        left = now
    tokens = docs.collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in tokens)


def test_every_operator_is_registered():
    names = set(registry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{i}" for i in range(1, 14)}
    assert set(registry.oracle_sql()) <= names


def test_hard_tables(spark, tmp_path):
    """Nulls in any column, repeated ids, clashing names, and no rows at all, through every stage."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, lost string, own string, leak_1 bigint, bucket int, rest string"
    copy = "one two three four\nfive six\nseven eight"  # lines too short to be dropped
    long = " ".join(f"w{i % 7}" for i in range(30_000))
    rows = [(1, copy, "en", "s", 27), (1, copy, None, None, None), (2, copy, "en", "s", 27), (None, copy, "en", "s", 27), (None, None, None, None, None),
            (3, None, "en", "s", 0), (4, "", "en", "s", 0), (4, "other words under the same id stand here", "en", "s", 9), (5, long, "en", "s", 9)]
    labels = [(1, 1, 0), (2, None, None), (None, 1, 1), (77, 0, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (None, "no such item in any of the documents")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for content in (rows, []):
        docs = spark.createDataFrame([(*r, *["clash"] * 2, 1, 1, "clash") for r in content], schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        got = sorted((repr(r.doc_id), len(r.text)) for r in docs.collect())
        # Document 2 is a copy of document 1; rows without an id are linked with nothing.
        assert got == sorted((repr(i), len(t or "")) for i, t, *_ in content if i != 2)
