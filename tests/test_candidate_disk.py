"""Candidates of whole incidents: what is stored and shuffled on the way stays small and is not kept."""

import os

import pytest
from pyspark.sql import functions as F

from evidra.operators import entities, evidence, store
from evidra.plans import whole
from evidra.plans.lineage import shared_folder

SF = "/root/testdata/sf0.01"


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def _blocks(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_bytes_stored_a_span(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    folder = shared_folder(spark).removeprefix("file://")
    before, spans = _bytes(folder), spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert whole.incident_candidates(spark, SF).count() > 0
    assert _bytes(folder) - before < 100 * spans


def test_ranked_deals_rows_once(spark):
    """Places across tasks and partitions, with shuffles dropped and no second exchange of the rows."""
    rows = spark.range(5000).select(F.concat(F.lit("i"), (F.col("id") % 3).cast("string")).alias("incident_id"), (F.col("id") * 7919 % 5000).alias("k"), F.lit("wide").alias("text"))
    blocks = _blocks(spark)
    out = store.ranked(rows, ["incident_id"], [F.desc("k")], "position")
    assert _blocks(spark) <= blocks
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in x and "text" in x for x in plan.splitlines()) and plan.count("Window") <= 2
    assert "row_number" not in plan
    by = {f"i{m}": sorted((i * 7919 % 5000 for i in range(m, 5000, 3)), reverse=True) for m in range(3)}
    assert {(r.incident_id, r.k): r.position for r in out.collect()} == {(n, k): p for n, ks in by.items() for p, k in enumerate(ks, 1)}


def test_only_missing_references_are_gathered(spark):
    refs = spark.createDataFrame([("i", "c1", "a"), ("i", "c1", "b"), ("i", "c2", "a"), ("j", "c1", "a")], "incident_id string, candidate_id string, key string")
    known = spark.createDataFrame([("i", "a"), ("i", "a"), ("j", "x")], "incident_id string, key string")
    assert {(r.incident_id, r.candidate_id): r.missing for r in evidence.unresolved(refs, known).collect()} == {("i", "c1"): ["b"], ("j", "c1"): ["a"]}


def test_siblings_that_missed(spark):
    rows = [("t", 1, None, False), ("t", 2, 1, True), ("t", 3, 1, False), ("t", 4, 3, True), ("t", 5, None, True), ("u", 2, 1, True), ("u", 3, 1, True)]
    s = spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long, miss boolean")
    got = {(r.trace_id, r.span_id) for r in entities.beside_misses(s, s.where("miss")).where("_miss").collect()}
    assert got == {(r.trace_id, r.span_id) for r in entities.with_miss_sibling(s, s.where("miss")).collect()} == {("t", 1), ("t", 3), ("u", 2), ("u", 3)}


def test_traces_are_not_made_anew_from_lines(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    i = whole._incidents(spark, SF)
    plan = i.traces._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "l_orderkey" not in plan
    assert i.traces.count() == i.spans.select("incident_id", "trace_id").distinct().count()
