"""What an incident's failure class asks for: its timeline, its related anomalies, its window comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import scores, times
from evidra.operators import picks, series, store, timeline
from evidra.plans.lineage import cut
from evidra.sources.incidents import Incidents


def _cases(i: Incidents, *columns: str) -> DataFrame:
    return i.manifests.select("incident_id", "failure_class", *columns)


def asked_of(cases: DataFrame, capability: str) -> DataFrame:
    """The cases that declare a capability, or declare none at all."""
    own = F.coalesce("capabilities", F.array().cast("array<string>"))
    return cases.where((F.size(own) == 0) | F.array_contains(own, capability))


def _named_logs(logs: DataFrame, changes: DataFrame) -> DataFrame:
    """(incident_id, log_id) of logs with a word that is the name of something outside that changed."""
    outside = changes.where("kind = 'external_event'").select("incident_id", F.lower(F.substring_index("entity", ":", -1)).alias("word")).distinct()
    words = logs.join(outside.select("incident_id").distinct(), "incident_id", "left_semi").select("incident_id", "log_id", F.explode(F.array_distinct(F.split(F.lower("body"), r"[^a-z0-9_.-]+"))).alias("word"))
    return words.join(outside, ["incident_id", "word"], "left_semi").select("incident_id", "log_id").distinct()


def events(i: Incidents, windows: DataFrame, edges: DataFrame, points: DataFrame, own_entity: DataFrame) -> DataFrame:
    """The typed event stream of incidents whose class has picks.

    ``own_entity`` is (incident_id, resource_id, entity), ``points`` the merged series.
    """
    c, keys = F.col, ["incident_id", "name", "entity"]
    cases = cut(asked_of(_cases(i, "capabilities").where(c("failure_class").isin(*picks.CLASSES)), "build_timeline").drop("capabilities"))
    changes, logs, spans, gaps, w = (df.join(cases, "incident_id") for df in (i.changes, i.logs, i.spans, i.gaps, windows))

    starts = w.where("start is not null")
    onset = starts.select("incident_id", c("start").alias("t")).unionByName(logs.where("severity = 'ERROR'").select("incident_id", "t")).groupBy("incident_id").agg(F.min("t").alias("onset"))
    active = starts.select("incident_id", "entity").distinct().withColumn("_active", F.lit(True))
    ch = changes.join(onset, "incident_id", "left").join(active, ["incident_id", "entity"], "left")
    late = F.coalesce((c("t") > c("onset")) & c("_active").isNull(), F.lit(False))
    ch = ch.select("incident_id", "failure_class", F.lit("change").alias("source"), "entity", "kind", "t", "seq", c("change_id").alias("ref"), F.when(late, "non-causal-change").otherwise("change").alias("marker"), F.coalesce("summary", F.lit("")).alias("text"))

    named = _named_logs(logs, changes).withColumn("named", F.lit(True))
    lg = logs.join(named, ["incident_id", "log_id"], "left").select("incident_id", "failure_class", F.lit("log").alias("source"), "entity", "severity", "body", "t", "seq", c("log_id").alias("ref"), F.coalesce("named", F.lit(False)).alias("named"), times.floor_minute(c("t")).alias("minute"), c("body").alias("text"))

    sp = spans.join(own_entity, ["incident_id", "resource_id"])
    above = sp.select("incident_id", "trace_id", c("span_id").alias("parent_id"), c("entity").alias("other_entity"))
    sp = sp.join(above, ["incident_id", "trace_id", "parent_id"], "left").select(
        "incident_id", "failure_class", F.lit("span").alias("source"), "entity", "kind", "name", "status", c("attributes")["error.type"].alias("error_type"), c("parent_id").isNull().alias("root"), c("start").alias("t"), "seq", F.concat_ws("/", "trace_id", "span_id").alias("ref"), "other_entity", c("name").alias("text")
    )

    cause = i.changes.select("incident_id", c("change_id").alias("cause"), c("entity").alias("other_entity"))
    first = gaps.groupBy("incident_id", "failure_class").agg(F.min_by(F.struct("gap_id", "entity", "cause", "start", "end", "seq"), "seq").alias("g")).select("incident_id", "failure_class", "g.*")
    gp = first.join(cause, ["incident_id", "cause"], "left").select("incident_id", "failure_class", F.lit("gap").alias("source"), "entity", c("start").alias("t"), c("end").alias("until"), "seq", c("gap_id").alias("ref"), "other_entity")

    marks = timeline.window_events(w, edges).select("incident_id", c("source_ref").alias("series_ref"), "marker")
    known = points.join(starts.select(*keys).distinct(), keys, "left_semi")
    near = series.near_limit(known).select(*keys, "near_t", "peak_t")
    wn = w.withColumn("series_ref", F.concat_ws("@", "name", "entity")).join(marks, ["incident_id", "series_ref"]).join(series.first_material(known), keys, "left").join(near, keys, "left")
    wn = wn.select("incident_id", "failure_class", F.lit("window").alias("source"), "entity", "name", c("start").alias("t"), store.number_in(c("id")).alias("seq"), c("id").alias("ref"), "series_ref", "material_t", "near_t", "peak_t", "recovery", "marker", F.concat_ws(" ", "name", F.lit("anomaly")).alias("text"))
    out = picks.conform(ch)
    for df in (lg, sp, gp, wn):
        out = out.unionByName(picks.conform(df))
    return out


# --- related anomalies --------------------------------------------------------

# Fixed value: how alike an incident is to an earlier one whose signature it matches.
SIGNATURE_SIMILARITY = 0.93


def class_related(i: Incidents, windows: DataFrame, edges: DataFrame) -> DataFrame:
    """(incident_id, seed, position, window, relation, lag_seconds, prior_incident, similarity, note) by each case's class.

    The seed is the first window (in their numbering) that shows the class's sign: a slow service that reads from something
    anomalous, a failing one that depends on something outside, the victim of retries, the database of an earlier incident.
    """
    c = F.col
    cases = asked_of(_cases(i, "capabilities"), "find_related_anomalies").drop("capabilities")
    w = windows.join(cases, "incident_id").withColumn("_n", store.number_in(c("id")))
    sick = w.select("incident_id", c("entity").alias("dst")).distinct()
    reads = edges.where("type = 'reads-from'").join(sick, ["incident_id", "dst"], "left_semi").select("incident_id", c("src").alias("entity")).distinct()
    outside = edges.where("type = 'depends-on' and dst like 'external-api:%'").select("incident_id", c("src").alias("entity")).distinct()
    retry = edges.where("type = 'retries'").groupBy("incident_id").agg(F.min(F.struct("src", "dst")).alias("r")).select("incident_id", c("r.src").alias("src"), c("r.dst").alias("entity"))
    first_prior = i.priors.where("primary_entity is not null").groupBy("incident_id").agg(F.min_by("primary_entity", "seq").alias("entity"))
    of = lambda kind, name: w.where((c("failure_class") == kind) & (c("name") == name))
    seeds = [
        of("dependency-degradation", "http.server.duration_p95_ms").join(reads, ["incident_id", "entity"], "left_semi"), of("downstream-outage", "http.server.error_rate").join(outside, ["incident_id", "entity"], "left_semi"),
        of("retry-storm", "http.server.error_rate").join(retry, ["incident_id", "entity"], "left_semi"), of("recurring-incident", "db.query.duration_p95_ms").join(first_prior, ["incident_id", "entity"], "left_semi"),
    ]
    all_seeds = seeds[0]
    for s in seeds[1:]:
        all_seeds = all_seeds.unionByName(s)
    s = cut(all_seeds.groupBy("incident_id", "failure_class").agg(F.min_by(F.struct("id", "entity", "name", "start"), "_n").alias("s")).select("incident_id", "failure_class", c("s.id").alias("seed"), c("s.entity").alias("seed_entity"), c("s.name").alias("seed_name"), c("s.start").alias("seed_start")))
    target = w.select("incident_id", c("id").alias("window"), "entity", "name", "start")
    lag = times.lag_seconds(c("seed_start"), c("start"))
    none = F.lit(None)

    def row(df: DataFrame, relation: str, lag_seconds: Column, note: Column, window: Column, prior: Column = none, similarity: Column = none) -> DataFrame:
        return df.select("incident_id", "seed", F.lit(relation).alias("relation"), window.cast("string").alias("window"), lag_seconds.cast("long").alias("lag_seconds"), prior.cast("string").alias("prior_incident"), similarity.cast("double").alias("similarity"), note.alias("note"))

    down = edges.where(c("type").isin("reads-from", "depends-on")).select("incident_id", c("src").alias("seed_entity"), "type", c("dst").alias("entity"))
    below = s.where(c("failure_class").isin("dependency-degradation", "downstream-outage")).join(down, ["incident_id", "seed_entity"]).join(target, ["incident_id", "entity"]).where("window <> seed")
    note = F.concat(c("seed_entity"), F.lit(" "), c("type"), F.lit(" "), c("entity"), F.lit("; "), c("entity"), F.lit(" precedes "), c("seed_entity"))
    storm = s.where("failure_class = 'retry-storm'").join(retry.select("incident_id", c("entity").alias("seed_entity"), c("src").alias("_src")), ["incident_id", "seed_entity"])
    amplifier = storm.join(target.where("name = 'client.retry.rate_rps'").withColumnRenamed("entity", "_src"), ["incident_id", "_src"])
    load = storm.join(target.where("name = 'request.rate_rps'").withColumnRenamed("entity", "seed_entity"), ["incident_id", "seed_entity"])
    told = i.priors.select("incident_id", "prior_id", c("primary_entity").alias("seed_entity"), F.coalesce("symptom", F.lit("")).alias("symptom"), F.coalesce("trigger", F.lit("")).alias("trigger"))
    again = s.where("failure_class = 'recurring-incident'").join(told, ["incident_id", "seed_entity"]).where(c("symptom").contains(c("seed_name")) & c("symptom").contains("db.locks.waiting") & F.lower("trigger").contains("vacuum"))
    rows = row(below, "downstream-dependency", lag, note, c("window"))
    rows = rows.unionByName(row(amplifier, "amplifier", lag, F.lit("retrying caller amplifies downstream load"), c("window")))
    rows = rows.unionByName(row(load, "load-amplification", F.lit(0), F.lit("victim request rate rises with retry fan-out"), c("window")))
    rows = rows.unionByName(row(again, "recurring-signature", none, F.lit("same primary entity, metric signature, and trigger pattern"), none, c("prior_id"), F.lit(SIGNATURE_SIMILARITY)))
    order = Window.partitionBy("incident_id").orderBy(timeline.relation_rank(c("relation")), F.asc_nulls_first("window"), F.asc_nulls_first("prior_incident"), "note")
    return rows.withColumn("position", F.row_number().over(order))  # one seed an incident, and a row for each of its neighbours' windows


# --- window comparison --------------------------------------------------------


@dataclass(frozen=True)
class Compared:
    """Which series of a class are compared, and their place in the list."""

    kind: str
    names: str
    place: int
    entities: str = ""


# The series that a class compares.
COMPARED = (
    Compared("deploy", r"^http\.server\.error_rate$", 0), Compared("deploy", r"^http\.server\.duration_p95_ms$", 1), Compared("deploy", r"^db\.query\.duration_p95_ms$", 2),
    Compared("dependency-degradation", r"^db\.query\.duration_p95_ms$", 0), Compared("dependency-degradation", r"^db\.locks\.waiting$", 1), Compared("dependency-degradation", r"^http\.server\.error_rate$", 2),
    Compared("config-change", r"^http\.server\.error_rate$", 0), Compared("config-change", r"^http\.server\.duration_p95_ms$", 1, "^service:"),
    Compared("coincidental-correlation", r"^cache\.hit_ratio$", 0), Compared("coincidental-correlation", r"^http\.server\.error_rate$", 1, "^service:"),
    Compared("traffic-shift", r"^http\.server\.duration_p95_ms$", 0, "^shard:"), Compared("traffic-shift", r"^http\.server\.duration_p95_ms$", 1, "^service:"), Compared("traffic-shift", r"^request\.rate_rps$", 2, "^tenant:"),
)
TEN_MINUTES = ("dependency-degradation", "config-change")
FLAT_FACTOR = 0.05


def comparison_bounds(cases: DataFrame, windows: DataFrame, points: DataFrame) -> DataFrame:
    """(incident_id, healthy_start, healthy_end, anomalous_start, anomalous_end) of cases (incident_id, failure_class, start, end) with an onset.

    Healthy: from the case's start to a minute before the onset.  Anomalous: from a minute after it (for a traffic shift from the next
    point) for ten minutes or, by class, to the last point of the case.  ``points`` are those that are compared, with failure_class.
    """
    c = F.col
    onset = windows.groupBy("incident_id").agg(F.min("start").alias("onset"))
    j = cases.join(onset.where("onset is not null"), "incident_id")
    begins = points.join(j.select("incident_id", "onset"), "incident_id").where("t > onset").groupBy("incident_id").agg(F.min("t").alias("_next"))
    j = j.join(begins, "incident_id", "left").withColumn("anomalous_start", F.when(c("failure_class") == "traffic-shift", c("_next")).otherwise(times.shift_minutes(c("onset"), 1)))
    ends = points.join(j.select("incident_id", "anomalous_start", c("end").alias("_end")), "incident_id").where("t between anomalous_start and _end").groupBy("incident_id").agg(F.max("t").alias("_last"))
    j = j.join(ends, "incident_id", "left").withColumn("anomalous_end", F.when(c("failure_class").isin(*TEN_MINUTES), times.shift_minutes(c("onset"), 10)).otherwise(c("_last")))
    return j.select("incident_id", c("start").alias("healthy_start"), times.shift_minutes(c("onset"), -1).alias("healthy_end"), "anomalous_start", "anomalous_end").where("anomalous_start is not null and anomalous_end is not null")


def class_comparison(cases: DataFrame, windows: DataFrame, points: DataFrame) -> DataFrame:
    """(incident_id, position, entity, signal, from_v, to_v, factor, note, the four bounds) of cases of the classes that compare."""
    c = F.col
    place = F.lit(None).cast("int")
    for x in reversed(COMPARED):
        place = F.when((c("failure_class") == x.kind) & c("name").rlike(x.names) & c("entity").rlike(x.entities), x.place).otherwise(place)
    p = cut(points.join(cases.select("incident_id", "failure_class"), "incident_id").withColumn("place", place).where("place is not null"))
    bounds = comparison_bounds(cases, windows, p)
    v = series.compare_windows(p, bounds).select("incident_id", "name", "entity", "from_v", "to_v")
    about = p.groupBy("incident_id", "name", "entity").agg(F.min("place").alias("place"), F.min("ord").alias("_ord"), F.first("failure_class").alias("failure_class"))
    base = windows.where("name = 'db.query.duration_p95_ms'").select("incident_id", "name", "entity", c("baseline").alias("_base"))
    j = v.join(about, ["incident_id", "name", "entity"]).join(base, ["incident_id", "name", "entity"], "left")
    j = j.withColumn("from_v", F.when(c("failure_class") == "dependency-degradation", F.coalesce("_base", "from_v")).otherwise(c("from_v")))
    j = j.withColumn("factor", F.when(c("from_v") != 0, c("to_v") / c("from_v")))
    flat = scores.near(c("to_v"), c("from_v")) | F.coalesce(F.abs(c("factor") - 1) <= FLAT_FACTOR, F.lit(False))
    j = j.withColumn("note", F.when(flat, "flat")).join(bounds, "incident_id")
    order = Window.partitionBy("incident_id").orderBy("place", "_ord", "entity")
    return j.withColumn("position", F.row_number().over(order)).select("incident_id", "position", "entity", c("name").alias("signal"), "from_v", "to_v", "factor", "note", "healthy_start", "healthy_end", "anomalous_start", "anomalous_end")
