"""Rows that go by their ids: whole texts are not shuffled for the few that do."""

from pyspark.sql import functions as F

from evidra.llm import decontam, resemblance, substring


def test_rows_without_ids(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("text").alias("text"), (F.col("id") % 3).cast("int").alias("other"))
    rows = rows.unionByName(spark.createDataFrame([(None, None, None)], "k long, text string, other int"))
    for gone in ([], [7, 8, 999], list(range(1000))):
        got = substring.without(rows, spark.createDataFrame([(k,) for k in gone], "k long"), "k").collect()
        assert sorted(r.k for r in got if r.k is not None) == [k for k in range(1000) if k not in set(gone)] and sum(r.k is None for r in got) == 1


def test_texts_are_cleared_before_the_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = " ".join(f"w{k}" for k in range(40))
        docs = spark.createDataFrame([(1, words), (2, "something else in a few words of its own"), (3, words)], "doc_id int, text string")
        one = resemblance.keep_one(docs)
        assert sorted(r.doc_id for r in one.collect()) == [1, 2] and one.dtypes == docs.dtypes
        item = spark.createDataFrame([("b", " ".join(f"w{k}" for k in range(12)))], "item_id string, text string")
        clean = decontam.remove(docs, item)
        assert [r.doc_id for r in clean.collect()] == [2]
        for df in (one, clean):
            assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
