"""Registry and pipeline."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from prevalens.llm.common import saved, shared_dir
from prevalens.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_columns(spark, name):
    first = {"op9": "page_id", "op13": "lang"}.get(name.split("_")[0], "doc_id")
    assert QUERIES[name](spark, SF).columns[0] == first


def test_stages_keep_columns_and_decisions(spark, edge):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    real = spark.read.parquet(f"{SF}/documents.parquet")
    docs = real.select(columns).unionByName(edge.select(columns).withColumn("doc_id", F.col("doc_id") + 100_000))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()} \
            if "text" in docs.columns else set()
        docs = saved(stage(spark, docs, SF), f"test-{name}")
        seen.append(name)
        if name == "pack":
            break
        assert docs.columns == columns
        now = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "language":
            assert set(now) < before and all(any(c.isalpha() for c in t) for _, t in now)
        if name == "near_duplicates":
            assert set(now) < before and max(Counter(i for i, _ in now if i is not None).values()) == 1
            ids = {i for i, _ in now}
            assert 100_008 in ids and 100_009 not in ids
        if name == "personal_data":
            assert len(now) == len(before) and not any("a.b@c.de" in t for _, t in now)
    assert seen == ["language", "near_duplicates", "personal_data", "mix", "pack"]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_saved_tables_are_shared_and_separate(spark):
    a, b = (saved(spark.range(n), "twice") for n in (3, 4))
    assert a.count() == 3 and b.count() == 4
    assert shared_dir(spark).removeprefix("file:").lstrip("/") in a.inputFiles()[0]
