"""Validation of a corpus of incident files: what is wrong where, and what the corpus covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import quality, rules
from evidra.operators.rules import Rule
from evidra.sources import expected, incidents

_MANIFEST = f"{incidents.MANIFEST}, version LONG, title STRING, difficulty STRING, inputs ARRAY<STRING>, expected ARRAY<STRING>, ground_truth STRUCT<primary_cause_entity: STRING, cause_ref: STRING, cause_kind: STRING>"
_CLASSES = ("deploy", "dependency-degradation", "retry-storm", "config-change", "traffic-shift", "resource-exhaustion", "schema-change", "downstream-outage", "recurring-incident", "missing-data", "coincidental-correlation", "entity-ambiguity")
# The rules of a corpus.
RULES = (
    Rule("needed", "scenario.id"), Rule("safe", "scenario.id"), Rule("needed", "scenario.title"), Rule("needed", "scenario.question"), Rule("needed", "scenario.start"), Rule("needed", "scenario.end"),
    Rule("one_of", "scenario.failure_class", values=_CLASSES), Rule("one_of", "scenario.difficulty", values=("baseline", "hard")), Rule("refers", "scenario.folder", "scenario.id"), Rule("refers", "scenario.window", "scenario.ordered"),
    Rule("refers", "scenario.cause_ref", "record"),
    *(Rule(kind, f"input.{name}") for name in ("resources.id", "traces.id", "logs.id", "changes.id", "prior_incidents.id", "telemetry_gaps.id") for kind in ("needed", "unique")),
    Rule("unique", "input.metrics.id"), Rule("needed", "input.spans.id"), Rule("unique", "input.spans.id"), Rule("refers", "input.spans.parent", "input.spans.id", scoped=True), Rule("refers", "input.spans.resource", "input.resources.id"),
    Rule("one_of", "input.spans.status", values=("OK", "ERROR", "UNSET")), Rule("one_of", "input.logs.severity", values=("DEBUG", "INFO", "WARN", "ERROR", "FATAL")), Rule("refers", "input.telemetry_gaps.cause", "input.changes.id"), Rule("refers", "input.metrics.gap", "input.telemetry_gaps.id"),
    Rule("refers", "expected.timeline.source_ref", "record"), Rule("refers", "expected.related.window", "expected.anomaly_windows.id"), Rule("refers", "expected.exemplars", "input.logs.id"), Rule("unique", "expected.anomaly_windows.id"), Rule("unique", "expected.entities.id"),
)


def _facts(file: str, field: str, rows: Column, value, scope=None, path: str = "") -> Column:
    """Facts of a list's elements: ``value`` and ``scope`` are functions of an element."""
    name = path or f"$.{field.split('.', 1)[1].rsplit('.', 1)[0]}"
    leaf = field.rsplit(".", 1)[1]
    own = lambda x, i: F.struct(F.lit(file).alias("file"), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{leaf}")).alias("path"), i.cast("long").alias("position"), F.lit(field).alias("field"), (scope(x) if scope else F.lit(None).cast("string")).alias("scope"), value(x).cast("string").alias("value"))
    return F.coalesce(F.transform(rows, own), F.array().cast("array<struct<file:string,path:string,position:bigint,field:string,scope:string,value:string>>"))


def _one(file: str, field: str, value: Column, path: str = "") -> Column:
    leaf = path or f"$.{field.split('.', 1)[1]}"
    return F.array(F.struct(F.lit(file).alias("file"), F.lit(leaf).alias("path"), F.lit(0).cast("long").alias("position"), F.lit(field).alias("field"), F.lit(None).cast("string").alias("scope"), value.cast("string").alias("value")))


def _exploded(df: DataFrame, *parts: Column) -> DataFrame:
    return df.select(F.col("incident_id").alias("case"), F.explode(F.concat(*parts)).alias("x")).select("case", "x.*")


def facts(manifests: DataFrame, inputs: DataFrame, gold: DataFrame) -> DataFrame:
    """The facts of scenario, input and expected rows (incident_id and each file's columns), each file read and exploded once."""
    c, s = F.col, "scenario.json"
    ordered = c("time_window.start") < c("time_window.end")
    m = _exploded(
        manifests, _one(s, "scenario.id", c("id")), _one(s, "scenario.title", c("title")), _one(s, "scenario.question", c("question")), _one(s, "scenario.start", c("time_window.start"), "$.time_window.start"), _one(s, "scenario.end", c("time_window.end"), "$.time_window.end"),
        _one(s, "scenario.failure_class", c("failure_class")), _one(s, "scenario.difficulty", c("difficulty")), _one(s, "scenario.folder", c("incident_id"), "$.id"), _one(s, "scenario.cause_ref", c("ground_truth.cause_ref"), "$.ground_truth.cause_ref"),
        _one(s, "scenario.window", F.lit("start before end"), "$.time_window"), F.when(F.coalesce(ordered, F.lit(True)), _one(s, "scenario.ordered", F.lit("start before end"), "$.time_window")).otherwise(_one(s, "scenario.ordered", F.lit(None), "$.time_window")),
    )
    f = "input.json"
    spans = F.flatten(F.transform("traces", lambda t: F.transform(t["spans"], lambda x: F.struct(t["trace_id"].alias("trace_id"), x["span_id"].alias("span_id"), x["parent_id"].alias("parent_id"), x["resource"].alias("resource"), x["status"].alias("status")))))
    metric = lambda x: F.concat_ws("@", x["name"], x["entity"])
    trace = lambda x: x["trace_id"]
    ids = [("resources", "id"), ("traces", "trace_id"), ("logs", "id"), ("changes", "id"), ("prior_incidents", "id"), ("telemetry_gaps", "id")]
    records = [_facts(f, "record.id", c(name), lambda x, k=key: x[k], path=f"$.{name}") for name, key in ids] + [_facts(f, "record.id", c("metrics"), metric, path="$.metrics"), _facts(f, "record.id", spans, lambda x: F.concat_ws("/", x["trace_id"], x["span_id"]), path="$.spans")]
    i = _exploded(
        inputs, *(_facts(f, f"input.{name}.id", c(name), lambda x, k=key: x[k]) for name, key in ids), _facts(f, "input.metrics.id", c("metrics"), metric), _facts(f, "input.metrics.gap", c("metrics"), lambda x: x["_gap"]["ref"]),
        _facts(f, "input.spans.id", spans, lambda x: x["span_id"], trace), _facts(f, "input.spans.parent", spans, lambda x: x["parent_id"], trace), _facts(f, "input.spans.resource", spans, lambda x: x["resource"], trace), _facts(f, "input.spans.status", spans, lambda x: x["status"], trace),
        _facts(f, "input.logs.severity", c("logs"), lambda x: x["severity"]), _facts(f, "input.telemetry_gaps.cause", c("telemetry_gaps"), lambda x: x["cause"]), *records,
    )
    i = i.withColumn("field", F.when(F.col("field") == "record.id", "record").otherwise(F.col("field")))
    g = "expected.json"
    exemplars = F.flatten(F.transform("log_patterns", lambda x: x["exemplars"]))
    e = _exploded(
        gold, _facts(g, "expected.timeline.source_ref", c("timeline"), lambda x: x["source_ref"]), _facts(g, "expected.related.window", c("related_anomalies.related"), lambda x: x["window"]), _facts(g, "expected.exemplars", exemplars, lambda x: x, path="$.log_patterns.exemplars"),
        _facts(g, "expected.anomaly_windows.id", c("anomaly_windows"), lambda x: x["id"]), _facts(g, "expected.entities.id", c("entities"), lambda x: x["id"]), _facts(g, "record.id", c("anomaly_windows"), lambda x: x["id"], path="$.anomaly_windows"),
    )
    e = e.withColumn("field", F.when(F.col("field") == "record.id", "record").otherwise(F.col("field")))
    return m.unionByName(i).unionByName(e)


def _keys(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = spark.read.text(f"{folder}/*/{name}", wholetext=True).select(F.regexp_extract(F.input_file_name(), rf"([^/]+)/{name}$", 1).alias("case"), F.lit(name).alias("file"), F.col("value"))
    return text.select("case", "file", F.explode(F.json_object_keys("value")).alias("key"))


def validate(spark: SparkSession, folder: str) -> DataFrame:
    """(case, file, path, rule, value): every breach of :data:`RULES` in a folder of incidents, files that are no JSON, and keys that a manifest declares and a file lacks or the other way round."""
    shapes = {"scenario.json": _MANIFEST, "input.json": incidents.INPUT, "expected.json": expected.EXPECTED}
    read = {name: incidents.files(spark, folder, name, shape) for name, shape in shapes.items()}
    good = {name: df.where("_bad is null").drop("_bad") for name, df in read.items()}
    m = good["scenario.json"]
    own = m.withColumnRenamed("incident_id", "case")
    out = rules.violations(facts(m, good["input.json"], good["expected.json"]), RULES)
    for name, df in read.items():
        out = out.unionByName(df.where("_bad is not null").select(F.col("incident_id").alias("case"), F.lit(name).alias("file"), F.lit("$").alias("path"), F.lit("malformed").alias("rule"), F.lit(None).cast("string").alias("value")))
    declared = own.select("case", F.lit("input.json").alias("file"), F.explode("inputs").alias("key")).unionByName(own.select("case", F.lit("expected.json").alias("file"), F.explode("expected").alias("key")))
    there = _keys(spark, folder, "input.json").unionByName(_keys(spark, folder, "expected.json")).join(own.select("case").distinct(), "case", "left_semi")
    return out.unionByName(rules.key_sets(declared, there))


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """(dimension, value, n): how many incidents have each class, difficulty and capability."""
    m = incidents.files(spark, folder, "scenario.json", _MANIFEST).where("_bad is null")
    own = quality.coverage(m, "failure_class", "difficulty")
    return own.unionByName(m.select(F.lit("capability").alias("dimension"), F.explode("capabilities").alias("value")).groupBy("dimension", "value").agg(F.count("*").alias("n")))
