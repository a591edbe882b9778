"""The pipeline's decontamination runs no Python on the executors, and drops the same rows as the filter in Python."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from evidra.llm import decontam


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_decontamination_stage_is_native(spark, tmp_path, threshold):
    words = " ".join(f"w{k}" for k in range(40))
    spark.createDataFrame([("b", " ".join(f"W{k}" for k in range(7, 19))), ("c", "short one")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, words, "x"), (2, "some other words", None), (3, words, "y"), (4, None, "z"), (5, "", "z"), (None, "a Short, One of them", "z"), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in ("MapInArrow", "MapInPandas", "Python", "Pandas") if x in plan] and "Union" in plan
        assert sorted(got.collect(), key=str) == sorted(decontam.remove(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect(), key=str)
        assert [r.doc_id for r in got.orderBy("doc_id").collect()] == [2, 4, 5, 7] and got.dtypes == docs.dtypes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("words", [1, 1 << 17])
def test_rows_cleared(spark, monkeypatch, words):
    """Whatever the filter lets through, only the rows with a key of ``gone`` go."""
    monkeypatch.setattr(decontam, "FILTER_WORDS", words)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit("text").alias("text")).unionByName(spark.createDataFrame([(None, None)], "k string, text string"))
    for gone in ([], [7, 8, 999], list(range(1000))):
        got = decontam.cleared(rows, spark.createDataFrame([(str(k),) for k in gone], "k string"), "k").collect()
        assert sorted(int(r.k) for r in got if r.k is not None) == [k for k in range(1000) if k not in set(gone)] and sum(r.k is None for r in got) == 1
