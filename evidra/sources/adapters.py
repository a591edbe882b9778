"""Typed evidence tables from the driver's business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.incidents import Incidents

INCIDENT = "driver"
INCIDENT_CLASSES = ("deploy", "missing-data", "resource-exhaustion", "entity-ambiguity", "retry-storm")
CASE_START, CASE_END, HOLE = "2024-01-01 00:00:00", "2024-01-30 00:00:00", ("2024-01-10 00:00:00", "2024-01-12 00:00:00")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value_series(events: DataFrame, name: str = "events.value.avg") -> DataFrame:
    """Hourly mean value of each event type."""
    t = F.date_trunc("hour", "ts")
    g = events.groupBy(F.concat(F.lit("type:"), "event_type").alias("entity"), t.alias("t")).agg(F.avg("value").alias("v"))
    return g.select(F.lit(INCIDENT).alias("incident_id"), F.lit(name).alias("name"), "entity", "t", "v", F.unix_timestamp("t").alias("ord"))


def error_series(events: DataFrame) -> DataFrame:
    """Hourly share of errors of each of ten groups of users."""
    t = F.date_trunc("hour", "ts")
    g = events.groupBy(F.concat(F.lit("bucket:"), (F.col("user_id") % 10).cast("string")).alias("entity"), t.alias("t")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("v"))
    return g.select(F.lit(INCIDENT).alias("incident_id"), F.lit("events.error_rate").alias("name"), "entity", "t", "v", F.unix_timestamp("t").alias("ord"))


def logs(events: DataFrame) -> DataFrame:
    """Events as log lines of retry attempts."""
    severity = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    body = F.concat(F.lit("retrying attempt "), (F.col("event_id") % 5 + 1).cast("string"), F.lit("/5 ("), F.get_json_object("props", "$.k"), F.lit(")"))
    return events.select(
        F.lit(INCIDENT).alias("incident_id"), F.format_string("log-%09d", "event_id").alias("log_id"), F.col("ts").alias("t"),
        F.concat(F.lit("user:"), (F.col("user_id") % 20).cast("string")).alias("entity"), severity.alias("severity"), body.alias("body"), F.col("event_id").alias("seq"),
    )


def changes(events: DataFrame) -> DataFrame:
    """Sign-ups as change events."""
    return events.where("event_type = 'signup'").select(
        F.lit(INCIDENT).alias("incident_id"), F.concat(F.lit("change:"), F.col("event_id").cast("string")).alias("change_id"), F.col("ts").alias("t"),
        F.lit("deploy").alias("kind"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity"),
    )


def spans(conversations: DataFrame) -> DataFrame:
    """Conversation turns as spans: each turn is the child of the one before; assistants are dependencies."""
    endpoint = F.when(F.col("role") == "assistant", "dependency").otherwise("service")
    return conversations.select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"),
        endpoint.alias("endpoint"), F.concat_ws(":", endpoint, "role").alias("entity"), F.length("text").alias("size"),
    )


def resources(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Suppliers as resources that share a service name per nation; only even ones know their version."""
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.concat(F.lit("resource:"), F.col("s_suppkey").cast("string")).alias("resource_id"), F.col("n_name").alias("service_name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("v"), (F.col("s_suppkey") % 3).cast("string"))).alias("version"), F.col("s_suppkey").alias("seq"),
    )


def traces_of(spans: DataFrame) -> DataFrame:
    """A trace for each trace id of the spans, in order of its start."""
    return spans.groupBy("incident_id", "trace_id", F.lit(None).cast("string").alias("exemplar_of")).agg(F.min(F.unix_seconds("start")).alias("seq"))


def incident_tables(spark: SparkSession, sf_dir: str) -> Incidents:
    """Five incidents from the business tables: suppliers are resources, line items spans, events series, changes and logs, nations earlier incidents.

    A supplier belongs to the incident of its key modulo five, an order to that of its own; every seventh line names a resource that is nowhere.
    """
    c, lit, s = F.col, F.lit, lambda x: x.cast("string")
    named = lambda key: F.concat(lit("r"), s(key % 5))
    attributes = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (lit(k.replace("__", ".")), v)]), lambda _, v: v.isNotNull())

    classes = F.array(*map(lit, INCIDENT_CLASSES))
    region = table(spark, sf_dir, "region").select(c("r_regionkey").alias("k")).where("k < 5")
    none = F.array().cast("array<string>")
    manifests = region.select(named(c("k")).alias("incident_id"), F.get(classes, c("k")).alias("failure_class"), lit("what happened").alias("question"), F.when(c("k") == 1, F.array(lit("cluster_logs"))).when(c("k") == 2, F.array(lit("resolve_entities"))).otherwise(none).alias("capabilities"), F.to_timestamp(lit(CASE_START)).alias("start"), F.to_timestamp(lit(CASE_END)).alias("end"))

    r = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), F.floor(c("s_suppkey") / 5).cast("long").alias("j"))
    j, k, store = c("j"), c("k"), c("j") % 4 == 1
    resources = r.select(
        named(k).alias("incident_id"), j.alias("seq"), F.concat(lit("resource:"), s(k)).alias("resource_id"),
        attributes(
            service__name=F.when(store, F.concat(lit("store"), s(j % 8))).otherwise(F.concat(lit("svc"), s(j % 3))), service__version=F.when(j % 4 != 2, F.concat(lit("v"), s(j % 5))), service__instance__id=F.when(j % 4 == 0, F.concat(lit("i"), s(k))),
            k8s__namespace__name=F.when(j % 4 == 3, lit("ns")), k8s__pod__name=F.when(j % 2 == 0, F.concat(lit("p"), s(k))), host__name=F.when(j % 3 == 0, F.concat(lit("h"), s(k % 3))), rollout=F.when(j == 15, lit("canary")),
            db__system=F.when(store, F.when(j % 8 == 5, lit("redis")).otherwise(lit("postgres"))), cluster__name=F.when(store & (j % 8 == 5), lit("c1")),
        ).alias("attributes"),
    )

    # Dealt by order, so that a trace's spans stand in one task.
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate").repartition("l_orderkey").groupBy(c("l_orderkey").alias("o"), c("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("u"), F.min("l_shipdate").cast("timestamp").alias("t"))
    o, n = c("o"), c("n")
    spans = line.select(
        named(o).alias("incident_id"), F.concat(lit("t"), s(o)).alias("trace_id"), n.cast("long").alias("seq"), s(n).alias("span_id"), F.when(n > 1, s(F.floor(n / 2))).alias("parent_id"),
        F.when(n == 7, lit("resource:none")).otherwise(F.concat(lit("resource:"), s(c("u") - c("u") % 5 + o % 5))).alias("resource_id"), F.when(n == 6, lit("charge card")).otherwise(lit("GET it")).alias("name"), lit("server").alias("kind"), c("t").alias("start"), c("t").alias("end"), lit("OK").alias("status"),
        attributes(
            http__route=F.when(n % 2 == 1, lit("/it")), db__statement=F.when(n % 3 == 0, lit("UPDATE it")), peer__service=F.when(n == 5, lit("svc1")).when(n == 6, lit("outside")), cache__hit=F.when(n % 2 == 0, lit("false")),
            orders__shard=F.when(n == 4, s(o % 3)), tenant__id=F.when(n == 2, s(o % 7)),
        ).alias("attributes"),
    )

    ev = table(spark, sf_dir, "events")
    third = F.floor(c("user_id") / 5).cast("long") % 3
    service = F.concat(lit("service:svc"), s(third), F.get(F.array(lit("@canary"), lit("@stable"), lit("")), third.cast("int")))
    t = F.date_trunc("hour", c("ts").cast("timestamp"))
    points = ev.groupBy(named(c("user_id")).alias("incident_id"), service.alias("entity"), t.alias("t")).agg(F.avg((c("event_type") == "error").cast("double")).alias("v"))
    points = points.select("incident_id", lit("http.server.error_rate").alias("name"), "entity", lit("1").alias("unit"), "t", "v", F.unix_timestamp("t").alias("ord"))
    own = ev.select(named(c("user_id")).alias("incident_id"), c("event_id").alias("seq"), c("ts").cast("timestamp").alias("ts"), service.alias("entity"), "event_type", s(c("event_id")).alias("id"), s(c("user_id") % 20).alias("user"))
    changes = own.where("event_type = 'signup'").select("incident_id", "seq", F.concat(lit("change:"), "id").alias("change_id"), c("ts").alias("t"), lit("deploy").alias("kind"), "entity", lit("rollout").alias("summary"))
    errors = own.where("event_type = 'error'").select("incident_id", "seq", F.concat(lit("log:"), "id").alias("log_id"), c("ts").alias("t"), F.concat(lit("user:"), "user").alias("entity"), lit("ERROR").alias("severity"), lit("failed").alias("body"))

    nation = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("k"))
    trigger = F.when(k % 2 == 0, F.concat(lit("service:svc"), s(k % 3), lit(" nightly job"))).otherwise(lit("host:h1 restart"))
    priors = nation.select(named(k).alias("incident_id"), k.alias("seq"), F.concat(lit("prior:"), s(k)).alias("prior_id"), F.to_timestamp(lit(CASE_START)).alias("first_seen"), F.concat(lit("db:store"), s(k % 8)).alias("primary_entity"), lit("slow").alias("symptom"), trigger.alias("trigger"))
    hole = region.where("k = 1").select(named(k).alias("incident_id"), lit(0).alias("seq"), lit("gap:1").alias("gap_id"), F.to_timestamp(lit(HOLE[0])).alias("start"), F.to_timestamp(lit(HOLE[1])).alias("end"))
    gaps = hole.select("*", lit("service:svc0@canary").alias("entity"), F.array(lit("service:svc0@canary"), lit("host:h9"), lit("odd")).alias("entities"), F.array(lit("metric")).alias("signals"), lit("outage").alias("cause"))
    series_gaps = hole.select("incident_id", "seq", lit("http.server.error_rate").alias("name"), lit("service:svc0@canary").alias("entity"), "start", "end", "gap_id")
    return Incidents(manifests, resources, spans, traces_of(spans), points, series_gaps, errors, changes, priors, gaps)
