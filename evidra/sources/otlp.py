"""OTLP JSON ingest: resource, span, metric and log envelopes to typed rows and issue rows.

Documents are parsed with one schema and exploded with positions, so issues name their place.
Every step is a projection or an explode; the only shuffles deduplicate resources and count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import arrays, json_text, scores, text

_ATTRS = "attributes ARRAY<STRUCT<key: STRING, value: STRING>>"
_SCOPE = "scope STRUCT<name: STRING, version: STRING>"
_POINT = f"STRUCT<timeUnixNano: STRING, asDouble: DOUBLE, asInt: STRING, {_ATTRS}>"
_RESOURCE = f"resource STRUCT<{_ATTRS}>"
SCHEMA = f"""
resourceSpans ARRAY<STRUCT<{_RESOURCE}, scopeSpans: ARRAY<STRUCT<{_SCOPE}, spans: ARRAY<STRUCT<traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING, kind: STRING,
  startTimeUnixNano: STRING, endTimeUnixNano: STRING, {_ATTRS}, status: STRING>>>>>>,
resourceMetrics ARRAY<STRUCT<{_RESOURCE}, scopeMetrics: ARRAY<STRUCT<{_SCOPE}, metrics: ARRAY<STRUCT<name: STRING, unit: STRING, gauge: STRUCT<dataPoints: ARRAY<{_POINT}>>, sum: STRUCT<dataPoints: ARRAY<{_POINT}>>>>>>>>,
resourceLogs ARRAY<STRUCT<{_RESOURCE}, scopeLogs: ARRAY<STRUCT<{_SCOPE}, logRecords: ARRAY<STRUCT<timeUnixNano: STRING, observedTimeUnixNano: STRING, severityText: STRING, severityNumber: INT, body: STRING, traceId: STRING, spanId: STRING, {_ATTRS}>>>>>>
""".replace("resource STRUCT", "resource: STRUCT").replace("attributes ARRAY", "attributes: ARRAY").replace("scope STRUCT", "scope: STRUCT")


@dataclass
class Ingest:
    """Typed tables of an ingest, and its issues (doc, place, problem, signal)."""

    resources: DataFrame
    spans: DataFrame
    points: DataFrame
    logs: DataFrame
    issues: DataFrame

    def counters(self) -> DataFrame:
        """(signal, accepted, rejected)."""
        rows = None
        for signal, df in (("resource", self.resources), ("span", self.spans), ("metric_point", self.points), ("log", self.logs)):
            n = df.agg(F.count("*").alias("accepted")).select(F.lit(signal).alias("signal"), "accepted")
            rows = n if rows is None else rows.unionByName(n)
        bad = self.issues.groupBy("signal").agg(F.count("*").alias("rejected"))
        return rows.join(bad, "signal", "left").select("signal", "accepted", F.coalesce("rejected", F.lit(0).cast("long")).alias("rejected"))


def any_value(json: Column) -> Column:
    """An attribute value's JSON text as plain text: scalars as they are, lists and maps of any depth as canonical JSON of texts."""

    def plain(j: Column) -> Column:
        may = lambda k: j.contains(k) | j.contains("\\")  # a name may be escaped
        scalar = F.coalesce(*(F.when(may(k), F.get_json_object(j, f"$.{k}")) for k in ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue")))
        return F.coalesce(scalar, json_text.unwrapped(j), j)

    return arrays.let(json, plain)


def attribute_map(attrs: Column) -> Column:
    """A list of attributes as a map; entries without key or value are left out, the last of equal keys counts."""
    good = F.filter(attrs, lambda a: a["key"].isNotNull() & a["value"].isNotNull())
    placed = F.array_sort(F.transform(good, lambda a, i: F.struct(a["key"].alias("key"), i.alias("i"), a["value"].alias("value"))))

    def last(p: Column) -> Column:
        own = F.filter(p, lambda a, i: F.coalesce(F.get(p, i + 1)["key"] != a["key"], F.lit(True)))
        return F.map_from_entries(F.transform(own, lambda a: F.struct(a["key"], any_value(a["value"]))))

    return F.coalesce(arrays.let(placed, last), F.create_map().cast("map<string,string>"))


def canonical(attrs: Column) -> Column:
    """A map as JSON with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attrs))))


def resource_identity(attrs: Column, place: Column) -> tuple[Column, Column, Column]:
    """(resource id, entity, quality): by name and instance, by name, by attributes, or by place."""
    name, instance = text.blank_to_null(attrs["service.name"]), text.blank_to_null(attrs["service.instance.id"])
    full = F.concat(name, F.lit("@"), instance)
    hashed = F.concat(F.lit("resource:"), scores.fnv1a64(F.when(F.size(attrs) > 0, canonical(attrs)).otherwise(place)))
    rid = F.when(full.isNotNull(), F.concat(F.lit("resource:"), full)).when(name.isNotNull(), F.concat(F.lit("resource:"), name)).otherwise(hashed)
    entity = F.when(name.isNotNull(), F.concat(F.lit("service:"), name)).otherwise(hashed)
    quality = F.when(name.isNotNull(), "high").when(F.size(attrs) > 0, "low").otherwise("missing")
    return rid, entity, quality


def hex_id(c: Column, digits: int) -> Column:
    """An id of so many hex digits in lower case, else null."""
    return F.when(c.rlike(rf"^[0-9a-fA-F]{{{digits}}}$"), F.lower(c))


def nanos(c: Column) -> Column:
    """Unix nanoseconds as a number, null if blank, not a number or beyond the year 2262."""
    return F.when(c.rlike("^[0-9]{1,19}$"), c.try_cast("bigint"))


def nano_time(c: Column) -> Column:
    """Unix nanoseconds as a timestamp (microseconds); what is cut off stays in the ``_ns`` columns."""
    n = nanos(c)
    return F.timestamp_micros(F.floor(n.cast("decimal(20,0)") / 1000).cast("bigint"))


def _exploded(docs: DataFrame, envelope: str, scopes: str, rows: str) -> DataFrame:
    d = docs.select("doc", F.posexplode(F.col(f"d.{envelope}")).alias("i", "r"))
    place = F.concat(F.lit(f"$.{envelope}["), F.col("i").cast("string"), F.lit("]"))
    d = d.select("doc", place.alias("resource_place"), attribute_map(F.col("r.resource.attributes")).alias("resource_attributes"), F.posexplode(F.col(f"r.{scopes}")).alias("j", "s"))
    d = d.select("doc", "resource_place", "resource_attributes", "j", F.col("s.scope").alias("scope"), F.posexplode(F.col(f"s.{rows}")).alias("k", "x"))
    where = F.concat("resource_place", F.lit(f".{scopes}["), F.col("j").cast("string"), F.lit(f"].{rows}["), F.col("k").cast("string"), F.lit("]"))
    rid, entity, quality = resource_identity(F.col("resource_attributes"), F.col("resource_place"))
    return d.select("doc", where.alias("place"), rid.alias("resource_id"), entity.alias("entity"), quality.alias("entity_quality"), "resource_attributes", "scope", "x", "j", "k")


def _issue(df: DataFrame, signal: str, **problems: Column) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in problems.items())))
    return df.select("doc", "place", F.explode(found).alias("problem"), F.lit(signal).alias("signal"))


def ingest(documents: DataFrame) -> Ingest:
    """Typed tables from documents (doc, json)."""
    docs = documents.select("doc", F.from_json("json", SCHEMA).alias("d"))
    s = _exploded(docs, "resourceSpans", "scopeSpans", "spans")
    s = s.withColumns({"trace_id": hex_id(F.col("x.traceId"), 32), "span_id": hex_id(F.col("x.spanId"), 16), "start": nano_time(F.col("x.startTimeUnixNano")), "end": nano_time(F.col("x.endTimeUnixNano"))})
    good_span = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    status = F.coalesce(F.get_json_object("x.status", "$.code"), F.col("x.status"))
    spans = s.where(good_span).select(
        "doc", "trace_id", "span_id", hex_id(F.col("x.parentSpanId"), 16).alias("parent_id"), F.col("x.name").alias("name"), F.col("x.kind").alias("kind"), "start", "end",
        F.when(status.isin("2", "STATUS_CODE_ERROR"), "ERROR").otherwise("OK").alias("status"), "resource_id", "entity", "entity_quality", attribute_map(F.col("x.attributes")).alias("attributes"),
        nanos(F.col("x.startTimeUnixNano")).alias("start_ns"), nanos(F.col("x.endTimeUnixNano")).alias("end_ns"),
    )
    issues = _issue(s, "span", trace_id=F.col("trace_id").isNull(), span_id=F.col("span_id").isNull(), start=F.col("start").isNull(), end=F.col("end").isNull())

    m = _exploded(docs, "resourceMetrics", "scopeMetrics", "metrics")
    points = F.coalesce(F.col("x.gauge.dataPoints"), F.col("x.sum.dataPoints"))
    kind = F.when(F.col("x.gauge.dataPoints").isNotNull(), "gauge").when(F.col("x.sum.dataPoints").isNotNull(), "sum")
    bad_metric = m.where(points.isNull() | text.blank_to_null(F.col("x.name")).isNull())
    issues = issues.unionByName(_issue(bad_metric, "metric_point", points=points.isNull(), name=text.blank_to_null(F.col("x.name")).isNull()))
    p = m.where(points.isNotNull() & text.blank_to_null(F.col("x.name")).isNotNull()).select("doc", "place", "resource_id", "entity", "entity_quality", "resource_attributes", F.col("x.name").alias("name"), F.col("x.unit").alias("unit"), kind.alias("aggregation"), F.posexplode(points).alias("ord", "pt"))
    p = p.withColumns({"t": nano_time(F.col("pt.timeUnixNano")), "v": F.coalesce(F.col("pt.asDouble"), F.col("pt.asInt").try_cast("double"))})
    rows = p.where("t is not null and v is not null").select("doc", "name", "entity", "entity_quality", "unit", "aggregation", "resource_id", "t", "v", "ord", nanos(F.col("pt.timeUnixNano")).alias("t_ns"))
    issues = issues.unionByName(_issue(p, "metric_point", time=F.col("t").isNull(), value=F.col("v").isNull()))

    g = _exploded(docs, "resourceLogs", "scopeLogs", "logRecords")
    g = g.withColumns({"t": nano_time(F.coalesce(F.col("x.timeUnixNano"), F.col("x.observedTimeUnixNano"))), "attributes": attribute_map(F.col("x.attributes"))})
    body = any_value(F.col("x.body"))
    own = text.blank_to_null(F.coalesce(F.col("attributes")["log.id"], F.col("attributes")["log.record.uid"]))
    # A generated id carries the record's place, which is unique in its document.
    made = F.concat_ws(":", F.lit("log"), F.coalesce(hex_id(F.col("x.traceId"), 32), F.lit("none")), F.coalesce(hex_id(F.col("x.spanId"), 16), F.lit("none")), F.unix_micros("t").cast("string"), F.col("doc").cast("string"), F.col("place"))
    logs = g.where("t is not null").select(
        "doc", F.coalesce(own, made).alias("log_id"), "t", "entity", "entity_quality", "resource_id", F.col("x.severityText").alias("severity"), body.alias("body"), "attributes",
        hex_id(F.col("x.traceId"), 32).alias("trace_id"), hex_id(F.col("x.spanId"), 16).alias("span_id"), nanos(F.coalesce(F.col("x.timeUnixNano"), F.col("x.observedTimeUnixNano"))).alias("t_ns"),
    )
    issues = issues.unionByName(_issue(g, "log", time=F.col("t").isNull()))
    empty = docs.where("d.resourceSpans is null and d.resourceMetrics is null and d.resourceLogs is null").select("doc", F.lit("$").alias("place"), F.lit("envelope").alias("problem"), F.lit("document").alias("signal"))

    # Resources: the first payload of a key counts; other attributes under the same key are an issue.
    r = None
    for x in (s, m, g):
        y = x.select("doc", "place", "resource_id", "entity", "entity_quality", canonical(F.col("resource_attributes")).alias("attributes"))
        r = y if r is None else r.unionByName(y)
    one = r.groupBy("resource_id").agg(F.min_by(F.struct("entity", "entity_quality", "attributes"), F.struct("doc", "place")).alias("x"), F.countDistinct("attributes").alias("n"), F.min(F.struct("doc", "place")).alias("at"))
    resources = one.select("resource_id", "x.*")
    clash = one.where("n > 1").select(F.col("at.doc").alias("doc"), F.col("at.place").alias("place"), F.lit("attributes").alias("problem"), F.lit("resource").alias("signal"))
    return Ingest(resources, spans, rows, logs, issues.unionByName(empty).unionByName(clash))


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole JSON files as (doc, json)."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("json"))
