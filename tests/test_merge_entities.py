"""Entities of many rows: one row a source is gathered, and the spans are read once."""

from pyspark.sql import functions as F

from evidra.operators import entities
from evidra.plans import bundle
from evidra.sources import adapters

SF = "/root/testdata/sf0.001"


def test_rows_of_one_source(spark):
    """Three million rows of one entity and twelve sources; the first kind decides, in order of place."""
    rows = spark.range(3_000_000).select(F.lit("e").alias("id"), F.when(F.col("id") % 3 == 0, "pod").otherwise("host").alias("kind"), F.concat(F.lit("s"), (F.col("id") % 12).cast("string")).alias("source"), (F.col("id") % 7 / 10).alias("confidence"), (F.col("id") % 12 + 1).alias("seq"))
    plan = entities.merge_entities(rows)
    got = plan.first()
    assert (got.id, got.kind, got.confidence, got.sources) == ("e", "pod", 0.6, [f"s{i}" for i in range(12)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "source" in text[text.rindex("HashAggregate") :]  # put together by source before anything is collected


def test_spans_are_read_once(spark):
    import os

    import pytest

    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    plan = bundle.resolve_entities(adapters.incident_tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey") and plan.count("/lineitem.parquet") + sum("l_orderkey" in x and "Relation" in x for x in plan.splitlines()) == 1
