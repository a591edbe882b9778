"""Incident files (manifest and telemetry JSON) as typed tables, one leading ``incident_id`` on each.

A folder holds one sub-folder per incident with ``scenario.json`` and ``input.json``; expected
results, where a corpus has them, are never read here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text, times

_SPAN = "STRUCT<span_id: STRING, parent_id: STRING, resource: STRING, name: STRING, kind: STRING, start: STRING, `end`: STRING, status: STRING, attributes: MAP<STRING, STRING>>"
INPUT = f"""
resources ARRAY<STRUCT<id: STRING, attributes: MAP<STRING, STRING>>>,
traces ARRAY<STRUCT<trace_id: STRING, exemplar_of: STRING, spans: ARRAY<{_SPAN}>>>,
metrics ARRAY<STRUCT<name: STRING, entity: STRING, unit: STRING, points: ARRAY<STRUCT<t: STRING, v: DOUBLE>>, _gap: STRUCT<start: STRING, `end`: STRING, ref: STRING>>>,
logs ARRAY<STRUCT<id: STRING, t: STRING, entity: STRING, severity: STRING, body: STRING, attributes: MAP<STRING, STRING>>>,
changes ARRAY<STRUCT<id: STRING, t: STRING, kind: STRING, entity: STRING, summary: STRING, attributes: MAP<STRING, STRING>>>,
prior_incidents ARRAY<STRUCT<id: STRING, first_seen: STRING, title: STRING, summary: STRING, mitigation: STRING, signature: STRUCT<primary_entity: STRING, symptom: STRING, trigger: STRING, upstream_impact: STRING>>>,
telemetry_gaps ARRAY<STRUCT<id: STRING, start: STRING, `end`: STRING, affected_entities: ARRAY<STRING>, affected_signals: ARRAY<STRING>, cause: STRING, note: STRING>>
"""
MANIFEST = "id STRING, failure_class STRING, question STRING, capabilities ARRAY<STRING>, time_window STRUCT<start: STRING, `end`: STRING>"


@dataclass
class Incidents:
    """Typed tables of any number of incidents."""

    manifests: DataFrame
    resources: DataFrame
    spans: DataFrame
    traces: DataFrame
    points: DataFrame
    series_gaps: DataFrame
    logs: DataFrame
    changes: DataFrame
    priors: DataFrame
    gaps: DataFrame

    def records(self) -> DataFrame:
        """All raw records as (incident_id, key, kind): what references resolve to."""
        rows = [
            self.resources.select("incident_id", F.col("resource_id").alias("key"), F.lit("resource").alias("kind")),
            self.traces.select("incident_id", F.col("trace_id").alias("key"), F.lit("trace").alias("kind")),
            self.spans.select("incident_id", F.concat_ws("/", "trace_id", "span_id").alias("key"), F.lit("span").alias("kind")),
            self.points.select("incident_id", F.concat_ws("@", "name", "entity").alias("key"), F.lit("metric_series").alias("kind")).distinct(),
            self.logs.select("incident_id", F.col("log_id").alias("key"), F.lit("log").alias("kind")),
            self.changes.select("incident_id", F.col("change_id").alias("key"), F.lit("change").alias("kind")),
            self.priors.select("incident_id", F.col("prior_id").alias("key"), F.lit("prior_incident").alias("kind")),
            self.gaps.select("incident_id", F.col("gap_id").alias("key"), F.lit("telemetry_gap").alias("kind")),
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def persist(self) -> Incidents:
        for f in fields(self):
            getattr(self, f.name).persist()
        return self


def typed(manifests: DataFrame, inputs: DataFrame) -> Incidents:
    """Tables from manifests (MANIFEST) and inputs (incident_id and the INPUT columns)."""
    m = manifests.select(F.col("id").alias("incident_id"), "failure_class", "question", "capabilities", times.parse(F.col("time_window.start")).alias("start"), times.parse(F.col("time_window.end")).alias("end"))

    def rows(name: str) -> DataFrame:
        return inputs.select("incident_id", F.posexplode(name).alias("seq", "x"))

    r = rows("resources").select("incident_id", "seq", F.col("x.id").alias("resource_id"), F.col("x.attributes").alias("attributes"))
    t = rows("traces")
    traces = t.select("incident_id", "seq", F.col("x.trace_id").alias("trace_id"), F.col("x.exemplar_of").alias("exemplar_of"))
    s = t.select("incident_id", F.col("x.trace_id").alias("trace_id"), F.posexplode("x.spans").alias("seq", "s")).select(
        "incident_id", "trace_id", "seq", "s.span_id", "s.parent_id", F.col("s.resource").alias("resource_id"), "s.name", "s.kind", times.parse(F.col("s.start")).alias("start"), times.parse(F.col("s.end")).alias("end"), "s.status", F.col("s.attributes").alias("attributes")
    )
    mt = rows("metrics")
    p = mt.select("incident_id", "seq", F.col("x.name").alias("name"), F.col("x.entity").alias("entity"), F.col("x.unit").alias("unit"), F.posexplode("x.points").alias("i", "p"))
    points = p.select("incident_id", "name", "entity", "unit", times.parse(F.col("p.t")).alias("t"), F.col("p.v").alias("v"), (F.col("seq") * 1_000_000 + F.col("i")).cast("long").alias("ord"))
    sg = mt.where("x._gap is not null").select("incident_id", "seq", F.col("x.name").alias("name"), F.col("x.entity").alias("entity"), times.parse(F.col("x._gap.start")).alias("start"), times.parse(F.col("x._gap.end")).alias("end"), F.col("x._gap.ref").alias("gap_id"))
    logs = rows("logs").select("incident_id", "seq", F.col("x.id").alias("log_id"), times.parse(F.col("x.t")).alias("t"), F.col("x.entity").alias("entity"), F.col("x.severity").alias("severity"), F.col("x.body").alias("body"))
    ch = rows("changes").select("incident_id", "seq", F.col("x.id").alias("change_id"), times.parse(F.col("x.t")).alias("t"), F.col("x.kind").alias("kind"), F.col("x.entity").alias("entity"), F.col("x.summary").alias("summary"))
    pr = rows("prior_incidents").select("incident_id", "seq", F.col("x.id").alias("prior_id"), times.parse(F.col("x.first_seen")).alias("first_seen"), F.col("x.signature.primary_entity").alias("primary_entity"), F.col("x.signature.symptom").alias("symptom"), F.col("x.signature.trigger").alias("trigger"))
    entity = F.coalesce(F.get(F.col("x.affected_entities"), 0), F.lit("unknown"))
    g = rows("telemetry_gaps").select("incident_id", "seq", F.col("x.id").alias("gap_id"), times.parse(F.col("x.start")).alias("start"), times.parse(F.col("x.end")).alias("end"), entity.alias("entity"), F.when(F.size("x.affected_entities") > 0, F.col("x.affected_entities")).otherwise(F.array(F.lit("unknown"))).alias("entities"), F.col("x.affected_signals").alias("signals"), F.col("x.cause").alias("cause"))
    # Rows that lack what identifies or places them are dropped.
    need = lambda df, *c: df.where(" and ".join(f"{x} is not null" for x in c))
    return Incidents(m, need(r, "resource_id"), need(s, "span_id", "resource_id"), need(traces, "trace_id"), need(points, "name", "entity", "t", "v"), need(sg, "name", "entity"), need(logs, "log_id", "t", "body").withColumn("severity", F.coalesce(text.blank_to_null(F.col("severity")), F.lit("INFO"))), need(ch, "change_id", "t", "entity"), need(pr, "prior_id"), need(g, "gap_id", "start"))


def files(spark: SparkSession, folder: str, name: str, shape: str) -> DataFrame:
    """Files of one name below a folder, one row each with their incident; ``_bad`` holds the text of those that are no JSON."""
    rows = spark.read.text(f"{folder}/*/{name}", wholetext=True).select(F.regexp_extract(F.input_file_name(), rf"([^/]+)/{name}$", 1).alias("incident_id"), F.col("value"))
    parsed = rows.withColumn("x", F.from_json("value", f"{shape}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("incident_id", "x.*", F.when(F.col("x").isNull() | F.col("x._corrupt").isNotNull(), F.col("value")).alias("_bad")).drop("_corrupt")


def read(spark: SparkSession, folder: str) -> Incidents:
    """Every incident below a folder whose two files can be read; :func:`issues` names the others."""
    manifests, inputs = files(spark, folder, "scenario.json", MANIFEST), files(spark, folder, "input.json", INPUT)
    good = manifests.where("_bad is null").select("incident_id").join(inputs.where("_bad is null").select("incident_id"), "incident_id")
    return typed(manifests.where("_bad is null").drop("_bad", "incident_id"), inputs.join(good, "incident_id").drop("_bad"))


#: What a row of each kind must have to be named and placed; rows within rows after a dot.
NEEDED = {
    "resources": ("id",), "traces": ("trace_id",), "traces.spans": ("span_id", "resource"), "metrics": ("name", "entity"), "metrics.points": ("t", "v"), "logs": ("id", "t", "body"), "changes": ("id", "t", "entity"),
    "prior_incidents": ("id",), "telemetry_gaps": ("id", "start"),
}
TIMES = ("t", "start")  #: of these, what must be a time
_PROBLEMS = "array<struct<place:string,problem:string>>"


def _lacking(x: Column, at: Column, names: tuple[str, ...]) -> Column:
    """What a row lacks, with its place; a time that cannot be read is lacking."""
    given = lambda n: times.parse(x[n]) if n in TIMES else x[n]
    return F.array_compact(F.array(*(F.when(given(n).isNull(), F.struct(at.alias("place"), F.lit(n).alias("problem"))) for n in names)))


def _each(rows: Column, at: Column, found: Callable[[Column, Column], Column]) -> Column:
    """What ``found`` says of every row of an array, given the row and its place."""
    own = F.flatten(F.transform(rows, lambda x, k: found(x, F.concat(at, F.lit("["), k.cast("string"), F.lit("]")))))
    return F.coalesce(own, F.array().cast(_PROBLEMS))


def _problems(kind: str, names: tuple[str, ...]) -> Column:
    outer, _, inner = kind.partition(".")
    if not inner:
        return _each(F.col(outer), F.lit(outer), lambda x, at: _lacking(x, at, names))
    return _each(F.col(outer), F.lit(outer), lambda x, at: _each(x[inner], F.concat(at, F.lit(f".{inner}")), lambda y, where: _lacking(y, where, names)))


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """(incident_id, place, problem): files that are no JSON, and rows that lack what they need and so stay out of the tables.

    All kinds are looked at in one pass over the files.
    """
    inputs = files(spark, folder, "input.json", INPUT)
    malformed = lambda name: F.array(F.struct(F.lit(name).alias("place"), F.lit("malformed").alias("problem")))
    scenarios = files(spark, folder, "scenario.json", MANIFEST).where("_bad is not null").select("incident_id", F.inline(malformed("scenario.json")))
    found = F.when(F.col("_bad").isNotNull(), malformed("input.json")).otherwise(F.concat(*(_problems(kind, names) for kind, names in NEEDED.items())))
    return scenarios.unionByName(inputs.select("incident_id", F.inline(found)))
