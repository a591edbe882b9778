"""Registered queries that run whole steps of the bundle over incidents made of the given tables, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evidra.operators import evidence, logs, series, store, timeline
from evidra.plans import bundle
from evidra.plans.catalogue import _s, _t, query
from evidra.plans.lineage import cut, stored
from evidra.sources import adapters, otlp
from evidra.sources.adapters import CASE_END, CASE_START, HOLE, table

# --- resources, spans, entities -----------------------------------------------

_RESOURCES = """res0 AS (SELECT s_suppkey AS k, s_suppkey // 5 AS j, 'r' || CAST(s_suppkey % 5 AS VARCHAR) AS inc FROM supplier),
res1 AS (SELECT k, j, inc, 'resource:' || CAST(k AS VARCHAR) AS rid, j % 4 = 1 AS store, CASE WHEN j % 4 = 1 THEN 'store' || CAST(j % 8 AS VARCHAR) ELSE 'svc' || CAST(j % 3 AS VARCHAR) END AS name,
  CASE WHEN j % 4 <> 2 THEN 'v' || CAST(j % 5 AS VARCHAR) END AS version, j % 4 IN (0, 3) AS placed, CASE WHEN j % 4 = 0 THEN 'instance:i' || CAST(k AS VARCHAR) END AS instance,
  CASE WHEN j % 2 = 0 THEN 'pod:p' || CAST(k AS VARCHAR) END AS pod, CASE WHEN j % 3 = 0 THEN 'host:h' || CAST(k % 3 AS VARCHAR) END AS host, j = 15 AS rolled FROM res0),
said AS (SELECT inc, name, count(*) AS n, count(version) AS told, max(version) AS latest, bool_or(rolled) AS any_rolled FROM res1 WHERE NOT store GROUP BY 1, 2),
res2 AS (SELECT res1.*, CASE WHEN store OR NOT (n > 1 AND told BETWEEN 1 AND n - 1) THEN NULL WHEN rolled THEN 'canary' WHEN version IS NULL THEN 'unresolved' WHEN NOT any_rolled AND version = latest THEN 'canary' ELSE 'stable' END AS role FROM res1 LEFT JOIN said USING (inc, name)),
res AS (SELECT *, CASE WHEN store AND j % 8 = 5 THEN 'infra:' || name WHEN store THEN 'db:' || name ELSE 'service:' || name || coalesce('@' || role, '') END AS entity,
  CASE role WHEN 'canary' THEN 0.96 WHEN 'stable' THEN 0.95 WHEN 'unresolved' THEN 0.40 ELSE CASE WHEN store THEN CASE WHEN j % 8 = 5 THEN 0.97 ELSE 0.98 END WHEN version IS NULL THEN CASE WHEN placed THEN 0.95 ELSE 0.90 END WHEN placed THEN 0.99 ELSE 0.98 END END AS sure FROM res2)"""

# A span whose resource is not of its incident is in no edge and no entity.
_SPANS = """line AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_suppkey) AS u FROM lineitem GROUP BY 1, 2),
sp AS (SELECT o, n, r.inc, r.rid, r.name, r.entity, r.store, 't' || CAST(o AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS ref, CASE WHEN n = 4 THEN 'shard:' || r.name || '-shard-' || CAST(o % 3 AS VARCHAR) END AS shard,
  CASE WHEN n = 2 THEN 'tenant:' || CAST(o % 7 AS VARCHAR) END AS tenant FROM line JOIN res r ON r.k = u - u % 5 + o % 5 WHERE n <> 7)"""

_EVENTS = """ev AS (SELECT 'r' || CAST(user_id % 5 AS VARCHAR) AS inc, ts, event_type, event_id, 'user:' || CAST(user_id % 20 AS VARCHAR) AS person,
  CASE (user_id // 5) % 3 WHEN 0 THEN 'service:svc0@canary' WHEN 1 THEN 'service:svc1@stable' ELSE 'service:svc2' END AS entity FROM events)"""

_ENTITIES = f"""{_RESOURCES}, {_SPANS}, {_EVENTS},
hinted AS (SELECT inc, entity AS id, 'service' AS kind, 'change:' || CAST(event_id AS VARCHAR) AS source FROM ev WHERE event_type = 'signup' UNION SELECT inc, entity, 'service', 'http.server.error_rate@' || entity FROM ev
  UNION SELECT inc, person, 'tenant', 'log:' || CAST(event_id AS VARCHAR) FROM ev WHERE event_type = 'error'),
each_one AS (SELECT inc, entity AS id, CASE WHEN store THEN 'dependency' ELSE 'service' END AS kind, rid AS source, sure, 0 AS place FROM res
  UNION ALL SELECT inc, pod, 'pod', rid, CASE WHEN host IS NULL THEN 0.98 ELSE 0.99 END, 1 FROM res WHERE pod IS NOT NULL UNION ALL SELECT inc, host, 'host', rid, 0.95, 1 FROM res WHERE host IS NOT NULL UNION ALL SELECT inc, instance, 'instance', rid, 0.95, 1 FROM res WHERE instance IS NOT NULL
  UNION ALL SELECT inc, 'route:' || name || '/GET /it', 'route', rid, 0.95, 2 FROM sp WHERE n % 2 = 1 UNION ALL SELECT inc, shard, 'shard', rid, 0.90, 2 FROM sp WHERE shard IS NOT NULL UNION ALL SELECT inc, tenant, 'tenant', rid, 0.90, 2 FROM sp WHERE tenant IS NOT NULL
  UNION ALL SELECT inc, id, kind, source, 0.80, 3 FROM hinted UNION ALL SELECT 'r1', x, CASE x WHEN 'host:h9' THEN 'host' ELSE 'service' END, 'gap:1', 0.80, 3 FROM (SELECT unnest(['service:svc0@canary', 'host:h9']) AS x) WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = 1)),
ents AS (SELECT inc AS incident_id, id, arg_min(kind, place) AS kind, max(sure)::DOUBLE AS confidence, count(DISTINCT source) AS n_sources FROM each_one GROUP BY 1, 2)"""


def _incidents(spark, sf_dir):
    """The incidents with the tables that many steps read computed once, as a deployment reads them from storage."""
    i = adapters.incident_tables(spark, sf_dir)
    spans = stored(i.spans.sortWithinPartitions("trace_id", "seq"))
    return replace(i, resources=cut(i.resources), spans=spans, traces=stored(adapters.traces_of(spans)), points=cut(i.points), changes=cut(i.changes))


def _entities(i):
    return cut(bundle.resolve_entities(i))


@query(f"WITH {_ENTITIES} SELECT * FROM ents")
def incident_entities(spark, sf_dir):
    return _entities(adapters.incident_tables(spark, sf_dir)).select("incident_id", "id", "kind", "confidence", F.size("sources").cast("long").alias("n_sources"))


@query(f"WITH {_RESOURCES} SELECT inc AS incident_id, rid AS resource_id, entity, CASE WHEN store THEN 'dependency' ELSE 'service' END AS endpoint, role, entity LIKE 'db:%' AS is_database FROM res")
def resources_as_entities(spark, sf_dir):
    return bundle.resource_entities(adapters.incident_tables(spark, sf_dir)).select("incident_id", "resource_id", "entity", "endpoint", "role", F.coalesce("is_database", F.lit(False)).alias("is_database"))


@query(f"WITH {_ENTITIES} SELECT incident_id, kind, count(*) AS n_entities FROM ents WHERE incident_id <> 'r1' GROUP BY 1, 2")
def entities_where_declared(spark, sf_dir):
    i = _incidents(spark, sf_dir)
    ents = _entities(i)
    found = bundle.derived_for(i, "resolve_entities", bundle.Derived(ents, *[ents.limit(0)] * 5))
    return found.groupBy("incident_id", "kind").agg(F.count("*").alias("n_entities"))


# --- relationships ------------------------------------------------------------

_EDGES = f"""{_ENTITIES},
climb AS (SELECT a.o, a.n, b.n AS at_n, NOT b.store AS hit FROM sp a JOIN sp b ON a.o = b.o AND b.n = a.n // 2 AND a.n > 1
  UNION ALL SELECT c.o, c.n, b.n, NOT b.store FROM climb c JOIN sp b ON b.o = c.o AND b.n = c.at_n // 2 AND c.at_n > 1 WHERE NOT c.hit),
up AS (SELECT c.o, c.n, b.entity AS caller FROM climb c JOIN sp b ON b.o = c.o AND b.n = c.at_n WHERE c.hit),
first_named AS (SELECT inc, name, arg_min(entity, j) AS entity FROM res WHERE NOT store GROUP BY 1, 2),
beside AS (SELECT a.o, a.n FROM sp a JOIN sp b ON a.o = b.o AND b.n = a.n - 1 WHERE a.n % 2 = 1 AND a.n > 1),
pri AS (SELECT 'r' || CAST(n_nationkey % 5 AS VARCHAR) AS inc, n_nationkey AS k, 'store' || CAST(n_nationkey % 8 AS VARCHAR) AS name FROM nation WHERE n_nationkey % 2 = 0),
raw_edges AS (
  SELECT inc, caller AS src, 'calls' AS type, entity AS dst, 0.98 AS sure, ref FROM sp JOIN up USING (o, n) WHERE NOT store
  UNION ALL SELECT inc, caller, CASE WHEN n % 3 = 0 THEN 'writes-to' ELSE 'reads-from' END, entity, CASE WHEN n % 3 = 0 THEN 0.96 WHEN entity LIKE 'infra:%' THEN 0.97 WHEN beside.n IS NOT NULL THEN 0.96 ELSE 0.97 END, ref FROM sp JOIN up USING (o, n) LEFT JOIN beside USING (o, n) WHERE store
  UNION ALL SELECT sp.inc, sp.entity, 'calls', coalesce(f.entity, 'none'), 0.98, ref FROM sp JOIN first_named f ON f.inc = sp.inc AND f.name = 'svc1' WHERE n = 5 AND NOT store
  UNION ALL SELECT sp.inc, sp.entity, 'depends-on', 'external-api:svc1', 0.95, ref FROM sp LEFT JOIN first_named f ON f.inc = sp.inc AND f.name = 'svc1' WHERE n = 5 AND NOT store AND f.inc IS NULL
  UNION ALL SELECT inc, entity, 'depends-on', 'external-api:outside', 0.95, ref FROM sp WHERE n = 6 AND NOT store
  UNION ALL SELECT inc, entity, 'fans-out-to', shard, 0.90, ref FROM sp WHERE shard IS NOT NULL AND NOT store UNION ALL SELECT inc, tenant, 'calls', entity, 0.90, ref FROM sp WHERE tenant IS NOT NULL AND NOT store
  UNION ALL SELECT inc, entity, 'deployed-as', instance, 0.98, rid FROM res WHERE instance IS NOT NULL AND NOT store UNION ALL SELECT inc, entity, 'deployed-as', pod, 0.99, rid FROM res WHERE pod IS NOT NULL AND NOT store
  UNION ALL SELECT inc, pod, 'runs-on', host, 0.95, rid FROM res WHERE pod IS NOT NULL AND host IS NOT NULL
  UNION ALL SELECT p.inc, 'service:svc' || CAST(p.k % 3 AS VARCHAR), 'writes-to', 'db:' || p.name, 0.95, 'prior:' || CAST(p.k AS VARCHAR) FROM pri p WHERE (p.inc, p.name) IN (SELECT (inc, name) FROM res)),
once AS (SELECT inc, src, type, dst, max(sure) AS sure, count(DISTINCT ref) AS n FROM raw_edges WHERE src <> dst GROUP BY 1, 2, 3, 4),
both_ways AS (SELECT r.inc, r.src, 'shares-resource-with' AS type, w.src AS dst, 0.80 AS sure, count(DISTINCT r.dst) AS n FROM once r JOIN once w ON r.inc = w.inc AND r.dst = w.dst AND r.type = 'reads-from' AND w.type = 'writes-to' AND w.sure >= 0.96 AND r.src <> w.src GROUP BY 1, 2, 3, 4),
edges AS (SELECT e.inc AS incident_id, src, type, dst, CASE WHEN coalesce(a.confidence, 1.0) < 0.5 OR coalesce(b.confidence, 1.0) < 0.5 THEN greatest(sure - 0.20, 0.30) ELSE sure END::DOUBLE AS confidence, n AS n_evidence
  FROM (SELECT * FROM once UNION ALL SELECT * FROM both_ways) e LEFT JOIN ents a ON a.incident_id = e.inc AND a.id = src LEFT JOIN ents b ON b.incident_id = e.inc AND b.id = dst)"""


@query(f"WITH RECURSIVE {_EDGES} SELECT incident_id, src, type, dst, round(confidence, 6) AS confidence, n_evidence FROM edges")
def incident_relationships(spark, sf_dir):
    i = _incidents(spark, sf_dir)
    return bundle.resolve_relationships(i, _entities(i)).select("incident_id", "src", "type", "dst", F.round("confidence", 6).alias("confidence"), F.size("evidence").cast("long").alias("n_evidence"))


# --- windows by class ---------------------------------------------------------

_CLASS = """CASE inc WHEN 'r0' THEN 'deploy' WHEN 'r1' THEN 'missing-data' WHEN 'r2' THEN 'resource-exhaustion' WHEN 'r3' THEN 'entity-ambiguity' ELSE 'retry-storm' END"""
_NOTE = "window boundaries and true peak are uncertain: metrics are missing 00:00-00:00"
_WINDOWS = f"""{_EVENTS}, pts AS (SELECT inc, entity, date_trunc('hour', ts) AS t, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS v FROM ev GROUP BY 1, 2, 3),
base AS (SELECT inc, entity, arg_min(v, t) AS b, max(v) AS peak, max(t) AS last_t FROM pts GROUP BY 1, 2), odd AS (SELECT inc, entity, t, v >= b + 0.015 AND v >= b * 4 AS bad FROM pts JOIN base USING (inc, entity)),
onset AS (SELECT inc, entity, min(t) AS on_t, max(t) AS off_t FROM odd WHERE bad GROUP BY 1, 2), calm AS (SELECT inc, entity, min(t) AS back_t FROM odd JOIN onset USING (inc, entity) WHERE NOT bad AND t > on_t GROUP BY 1, 2),
win AS (SELECT inc, entity, {_CLASS} AS class, CASE WHEN inc = 'r3' AND entity LIKE '%@stable' THEN NULL ELSE on_t END AS on_t, off_t, back_t, b, peak, last_t, inc = 'r1' AND entity LIKE '%@canary' AS hidden
  FROM base LEFT JOIN onset USING (inc, entity) LEFT JOIN calm USING (inc, entity)),
kept AS (SELECT * FROM win WHERE CASE inc WHEN 'r3' THEN entity LIKE '%@stable' OR (on_t IS NOT NULL AND entity LIKE '%@canary') WHEN 'r1' THEN on_t IS NOT NULL AND hidden ELSE on_t IS NOT NULL END),
near AS (SELECT k.inc, k.entity, date_trunc('minute', max(e.ts)) AS change_t FROM kept k JOIN ev e ON e.inc = k.inc AND e.event_type = 'signup' AND e.ts <= k.on_t AND date_trunc('minute', e.ts) >= date_trunc('minute', k.on_t) - INTERVAL 3 MINUTE GROUP BY 1, 2),
past AS (SELECT inc, entity, min(t) AS after_t FROM pts WHERE t >= TIMESTAMP '{HOLE[1]}' GROUP BY 1, 2),
ends AS (SELECT k.*, CASE WHEN class = 'deploy' AND change_t IS NOT NULL THEN change_t WHEN inc = 'r3' THEN on_t - INTERVAL 2 MINUTE ELSE on_t END AS a,
  CASE WHEN on_t IS NULL THEN NULL WHEN hidden AND after_t IS NOT NULL THEN after_t WHEN class = 'resource-exhaustion' THEN off_t + INTERVAL 1 MINUTE ELSE coalesce(back_t - INTERVAL 1 MINUTE, TIMESTAMP '{CASE_END}') END AS z
  FROM kept k LEFT JOIN near USING (inc, entity) LEFT JOIN past USING (inc, entity)),
before AS (SELECT inc, entity, CASE WHEN any_value(class) = 'deploy' AND count(*) >= 2 THEN avg(v) ELSE arg_min(v, t) END AS b2 FROM ends JOIN pts USING (inc, entity) WHERE t < a GROUP BY 1, 2),
told AS (SELECT *, coalesce(b2, b) AS bb, CASE WHEN on_t IS NULL THEN 'no anomaly: stable fleet is healthy' WHEN hidden THEN '{_NOTE}' END AS note FROM ends LEFT JOIN before USING (inc, entity)),
class_win AS (SELECT inc AS incident_id, entity, a AS start, z AS "end", bb AS baseline, abs(peak - bb) / greatest(abs(bb), 0.01) AS m, CASE WHEN on_t IS NULL THEN 0.10 WHEN hidden THEN 0.35 ELSE 0.90 END::DOUBLE AS sure, note FROM told)"""


def _windows(i):
    return series.class_windows(cut(i.points), i.manifests, i.changes, i.series_gaps)


@query(f"""WITH {_WINDOWS} SELECT incident_id, entity, {_t("start")} AS start, {_t('"end"')} AS "end", round(baseline, 6)::DOUBLE AS baseline, round(m / (m + 1), 6)::DOUBLE AS magnitude, sure AS detector_confidence, note FROM class_win""")
def incident_windows(spark, sf_dir):
    w = _windows(adapters.incident_tables(spark, sf_dir))
    return w.select("incident_id", "entity", _s("start").alias("start"), _s("end").alias("end"), F.round("baseline", 6).alias("baseline"), F.round("magnitude", 6).alias("magnitude"), "detector_confidence", "note")


# --- write-back ---------------------------------------------------------------


@query(f"""WITH RECURSIVE {_EDGES}, {_WINDOWS.replace(_EVENTS + ", ", "", 1)}, n AS (SELECT 'entity' AS kind, count(*) AS inserted, 0 AS refused FROM ents UNION ALL SELECT 'relationship', count(*), 0 FROM edges UNION ALL SELECT 'anomaly_window', count(DISTINCT (incident_id, entity)), count(*) - count(DISTINCT (incident_id, entity)) FROM class_win
  UNION ALL SELECT 'log_pattern', count(DISTINCT (inc, person)), count(*) - count(DISTINCT (inc, person)) FROM ev WHERE event_type = 'error' UNION ALL SELECT 'timeline_event', count(*), 0 FROM ev WHERE event_type = 'signup' UNION ALL SELECT 'related_anomaly', count(*), 0 FROM class_win)
SELECT kind, inserted, refused::BIGINT AS refused FROM n WHERE inserted > 0""")
def derived_written_back(spark, sf_dir):
    # Log patterns are told apart by who logged, so that most of them are refused.
    i = _incidents(spark, sf_dir)
    ents, w = _entities(i), cut(_windows(i).withColumn("id", F.col("entity")))
    timeline = i.changes.select("incident_id", "t", F.lit("change").alias("marker"), "entity", F.col("change_id").alias("source_ref"))
    d = bundle.Derived(ents, bundle.resolve_relationships(i, ents), w, i.logs.select("incident_id", F.col("entity").alias("id")), timeline, w.select("incident_id", F.lit("all").alias("seed"), F.lit("same").alias("relation"), "id"))
    stored, refused = bundle.written_back(i, d)
    n = stored.where("seq = 1").select("kind", F.lit(1).alias("ok")).unionByName(refused.select("kind", F.lit(0).alias("ok")))
    return n.groupBy("kind").agg(F.sum("ok").cast("long").alias("inserted"), F.count_if(F.col("ok") == 0).alias("refused"))


# --- envelopes ----------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS doc, c_custkey % 5 AS k FROM customer)
SELECT doc, '$' AS place, 'envelope' AS problem, 'document' AS signal FROM c WHERE k IN (3, 4) UNION ALL SELECT doc, '$.resourceSpans[0].scopeSpans[0].spans[0]', p, 'span' FROM c, (SELECT unnest(['trace_id', 'span_id', 'end']) AS p) WHERE k IN (0, 2)
UNION ALL SELECT doc, '$.resourceMetrics[0].scopeMetrics[0].metrics[0]', 'points', 'metric_point' FROM c WHERE k = 1 UNION ALL SELECT doc, '$.resourceLogs[0].scopeLogs[0].logRecords[0]', 'time', 'log' FROM c WHERE k = 2""")
def otlp_envelopes(spark, sf_dir):
    """Documents with spans, with metrics, with spans and logs, with none of these and with something else."""
    of = lambda signal, scopes, rows, row: f'"resource{signal}": [{{"resource": {{}}, "{scopes}": [{{"{rows}": [{row}]}}]}}]'
    spans, metrics, logs = of("Spans", "scopeSpans", "spans", '{"traceId": "x", "startTimeUnixNano": "1000"}'), of("Metrics", "scopeMetrics", "metrics", '{"name": "m"}'), of("Logs", "scopeLogs", "logRecords", '{"severityText": "INFO"}')
    bodies = [f"{{{spans}}}", f"{{{metrics}}}", f"{{{spans}, {logs}}}", "{}", '{"resourceProfiles": []}']
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.get(F.array(*map(F.lit, bodies)), (F.col("c_custkey") % 5).cast("int")).alias("json"))
    return otlp.ingest(docs).issues.select("doc", "place", "problem", "signal")


# --- candidates ---------------------------------------------------------------

_PLACED = ", ".join(f"'{x}'" for x in evidence.SOURCES)
_CANDIDATES = f"""{_EDGES}, {_WINDOWS.replace(_EVENTS + ", ", "", 1)},
begun AS (SELECT incident_id, min(start) AS onset FROM class_win GROUP BY 1),
signed AS (SELECT ev.inc, ev.entity, coalesce(ev.ts > onset AND c.entity IS NULL, false) AS late FROM ev LEFT JOIN begun b ON b.incident_id = ev.inc LEFT JOIN class_win c ON c.incident_id = ev.inc AND c.entity = ev.entity WHERE event_type = 'signup'),
trips AS (SELECT 'r' || CAST(o % 5 AS VARCHAR) AS inc, o, count(DISTINCT sp.entity) AS n FROM line LEFT JOIN sp USING (o, n) GROUP BY 1, 2),
seen AS (SELECT p.inc, p.entity, any_value(onset) AS onset, coalesce(max_by(v, t) FILTER (t <= onset - INTERVAL 1 MINUTE AND t >= TIMESTAMP '{CASE_START}'), max_by(v, t) FILTER (t <= onset - INTERVAL 1 MINUTE)) AS x,
  coalesce(max_by(v, t) FILTER (t BETWEEN onset + INTERVAL 1 MINUTE AND TIMESTAMP '{CASE_END}'), max_by(v, t) FILTER (t <= TIMESTAMP '{CASE_END}')) AS y FROM pts p JOIN begun b ON b.incident_id = p.inc GROUP BY 1, 2),
cand AS (
  SELECT incident_id, 'metric_anomaly' AS source, CASE WHEN sure < 0.40 THEN 'counter_evidence' ELSE 'metric_anomaly' END AS kind, CASE WHEN sure < 0.40 THEN 'weakens' ELSE 'supports' END AS direction, 1 AS n_entities, 2 AS n_refs, sure * 0.35 + m / (m + 1) * 0.25 + 0.40 AS strength FROM class_win
  UNION ALL SELECT inc, 'log_pattern', 'log_cluster', 'supports', 1, CASE WHEN count(*) >= 3 THEN 3 ELSE 2 END, 0.95 * 0.35 + greatest(0.3, least(1.0, count(*) / 3.0)) * 0.25 + 0.40 FROM ev WHERE event_type = 'error' GROUP BY inc, person
  UNION ALL SELECT inc, 'change_event', 'change_event', CASE WHEN late THEN 'weakens' ELSE 'supports' END, 1, 1, 0.95 * 0.45 + 0.40 + CASE WHEN late THEN 0.90 ELSE 0.75 END * 0.15 FROM signed
  UNION ALL SELECT inc, 'trace_exemplar', 'trace_exemplar', 'supports', n, 1, 0.65 * 0.40 + greatest(0.45, least(1.0, n / 3.0)) * 0.30 + 0.30 FROM trips
  UNION ALL SELECT incident_id, 'dependency_edge', 'dependency_edge', 'neutral', 2, n_evidence, confidence * 0.70 + 0.30 FROM edges WHERE type IN ('calls', 'reads-from', 'writes-to', 'depends-on', 'retries')
  UNION ALL SELECT 'r' || CAST(n_nationkey % 5 AS VARCHAR), 'previous_incident', 'previous_incident', 'neutral', 1, 1, 0.70 * 0.45 + 0.85 * 0.25 + 0.30 FROM nation
  UNION ALL SELECT 'r1', 'missing_data', 'missing_data', 'neutral', 3, 2, 0.90 * 0.45 + 0.80 * 0.25 + 0.5 * 0.30 FROM region WHERE r_regionkey = 1
  UNION ALL SELECT s.inc, 'counter_evidence', 'counter_evidence', 'weakens', 1, 1, 0.90 * 0.65 + 0.35 FROM seen s ANTI JOIN class_win w ON w.incident_id = s.inc AND w.entity = s.entity
    WHERE x IS NOT NULL AND y IS NOT NULL AND (abs(y - x) <= 0.05 * greatest(abs(x), 1e-9) OR (x <> 0 AND y / x <= 1.20) OR abs(y - x) <= 0.1 * greatest(abs(x), 1.0)))"""


def _candidates(spark, sf_dir):
    i = _incidents(spark, sf_dir)
    ents = _entities(i)
    w = cut(store.numbered(_windows(i), ["incident_id"], ["start", "entity", "name"], "id", "aw-%d"))
    events = cut(timeline.ordered(timeline.change_events(i.changes, w)))
    d = bundle.Derived(ents, stored(bundle.resolve_relationships(i, ents)), w, cut(logs.log_patterns(i.logs)), events, timeline.related(w, ents.limit(0).select("incident_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.col("kind").alias("type")), w))
    return bundle.candidates(i, d)


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT incident_id, source, kind, direction, n_entities::BIGINT AS n_entities, n_refs::BIGINT AS n_refs, round(strength, 6)::DOUBLE AS strength FROM cand")
def incident_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("incident_id", "source", "kind", "direction", F.col("n_entities").cast("long").alias("n_entities"), "n_refs", F.round("strength", 6).alias("strength"))


@query(f"""WITH RECURSIVE {_CANDIDATES}, n AS (SELECT incident_id, source, list_position([{_PLACED}], source) AS place, count(*) AS n FROM cand GROUP BY 1, 2),
upto AS (SELECT *, sum(n) OVER (PARTITION BY incident_id ORDER BY place) AS last FROM n) SELECT incident_id, source, (last - n + 1)::BIGINT AS first_number, last::BIGINT AS last_number FROM upto""")
def candidate_numbers(spark, sf_dir):
    """The generators stand one after the other in a fixed order, without holes."""
    number = F.regexp_extract("candidate_id", "([0-9]+)$", 1).cast("long")
    return _candidates(spark, sf_dir).groupBy("incident_id", "source").agg(F.min(number).alias("first_number"), F.max(number).alias("last_number"))
