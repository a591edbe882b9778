"""Registered queries of the evidence engine and their SQL twins.

Each query applies operators to adapters of the driver's tables; its oracle says the same in DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import scores, text, times
from evidra.operators import entities, logs, series, store
from evidra.sources import adapters
from evidra.sources.adapters import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _s(c) -> F.Column:
    """A timestamp as text, the same in every engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _t(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# --- shared SQL ---------------------------------------------------------------

_E1 = "e1 AS (SELECT 'type:' || event_type AS entity, date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2)"
_E2 = "e2 AS (SELECT 'bucket:' || CAST(user_id % 10 AS VARCHAR) AS entity, date_trunc('hour', ts) AS t, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS v FROM events GROUP BY 1, 2)"
_LOGS = """logs AS (SELECT 'log-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS log_id, ts AS t, 'user:' || CAST(user_id % 20 AS VARCHAR) AS entity,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS severity,
  'retrying attempt ' || CAST(event_id % 5 + 1 AS VARCHAR) || '/5 (' || json_extract_string(props, '$.k') || ')' AS body, event_id AS seq FROM events)"""


def _windows_sql(source: str, rule: str, cte: str, drop: bool = False) -> str:
    """Anomaly windows over a (entity, t, v) relation by a rule on v and baseline b."""
    return f"""
WITH {cte},
base AS (SELECT entity, arg_min(v, t) AS b, max(v) AS peak, min(v) AS trough, max(t) AS last_t FROM {source} GROUP BY entity),
j AS (SELECT x.entity, t, v, b, peak, trough, last_t, ({rule}) AS bad FROM {source} x JOIN base USING (entity)),
f AS (SELECT entity, min(t) AS on_t, max(t) AS off_t, count(*) AS n, any_value(b) AS b, any_value(peak) AS peak, any_value(trough) AS trough, any_value(last_t) AS last_t FROM j WHERE bad GROUP BY entity),
r AS (SELECT j.entity, min(t) AS recovery FROM j JOIN f ON j.entity = f.entity AND NOT bad AND t > on_t GROUP BY j.entity)
SELECT f.entity, {_t("on_t")} AS start_at, {_t("off_t")} AS last_at,
  {_t("CASE WHEN recovery IS NULL THEN last_t ELSE date_trunc('minute', recovery) - INTERVAL 1 MINUTE END")} AS end_at,
  round(f.b, 6) AS baseline, round({"trough" if drop else "peak"}, 6) AS extreme, n AS n_anomalous,
  round({"CASE WHEN abs(f.b) <= 1 THEN (m * 1.5) / (m * 1.5 + 1) ELSE m2 / (m2 + 1) END" if drop else "m / (m + 1)"}, 6) AS magnitude
FROM (SELECT *, {"abs(b - trough) / greatest(abs(b), 0.01) AS m, abs(b - trough) / greatest(abs(b), 1.0) AS m2" if drop else "abs(peak - b) / greatest(abs(b), 0.01) AS m"} FROM f) f LEFT JOIN r USING (entity)"""


def _windows(points: DataFrame, drop: bool = False) -> DataFrame:
    w = series.anomaly_windows(points)
    return w.select(
        "entity", _s("start").alias("start_at"), _s("last_anomalous").alias("last_at"), _s("end").alias("end_at"), F.round("baseline", 6).alias("baseline"),
        F.round("trough" if drop else "peak", 6).alias("extreme"), "n_anomalous", F.round("magnitude", 6).alias("magnitude"),
    )


# --- store --------------------------------------------------------------------

_RECORDS = f"""{_LOGS},
records AS (
  SELECT log_id AS key, 'log' AS kind, t AS s, t AS e, [entity] AS entities FROM logs
  UNION ALL SELECT 'change:' || CAST(event_id AS VARCHAR), 'change', ts, ts, ['user:' || CAST(user_id % 20 AS VARCHAR)] FROM events WHERE event_type = 'signup'
  UNION ALL SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), 'span', NULL, NULL, ['conv:' || CAST(conv_id AS VARCHAR)] FROM conversations)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    lg = adapters.logs(ev).select(F.col("log_id").alias("key"), F.lit("log").alias("kind"), store.point_window(F.col("t")).alias("win"), F.array("entity").alias("entities"))
    ch = ev.where("event_type = 'signup'").select(F.concat(F.lit("change:"), F.col("event_id").cast("string")).alias("key"), F.lit("change").alias("kind"), store.point_window(F.col("ts")).alias("win"), F.array(F.concat(F.lit("user:"), (F.col("user_id") % 20).cast("string"))).alias("entities"))
    sp = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.lit("span").alias("kind"), F.lit(None).cast("struct<start:timestamp,end:timestamp>").alias("win"), F.array(F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))).alias("entities"))
    return lg.unionByName(ch).unionByName(sp)


@query(f"""WITH {_RECORDS} SELECT key, kind FROM records
WHERE s <= TIMESTAMP '2024-01-12 00:00:00' AND e >= TIMESTAMP '2024-01-05 00:00:00' AND list_has_any(entities, ['user:3', 'user:7']) AND kind IN ('log', 'change')""")
def select_window_entity_kind(spark, sf_dir):
    import datetime as dt

    return store.select(_records(spark, sf_dir), (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12)), ("user:3", "user:7"), ("log", "change")).select("key", "kind")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_key_violations(spark, sf_dir):
    return store.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query(f"WITH {_E1} SELECT 'events.value.avg' AS name, entity, count(*) AS n_points, {_t('min(t)')} AS first_t, {_t('max(t)')} AS last_t FROM e1 GROUP BY entity")
def series_accumulate(spark, sf_dir):
    return store.accumulate_series(adapters.value_series(table(spark, sf_dir, "events"))).select("name", "entity", "n_points", _s("first_t").alias("first_t"), _s("last_t").alias("last_t"))


_REFS = """refs AS (
  SELECT event_id AS ref_id, CASE event_id % 5 WHEN 0 THEN 'change' WHEN 1 THEN 'log' WHEN 2 THEN 'trace' WHEN 3 THEN 'profile' ELSE 'log' END AS signal,
    CASE event_id % 5 WHEN 0 THEN 'change:' || CAST(event_id AS VARCHAR) WHEN 1 THEN 'change:' || CAST(event_id AS VARCHAR)
      WHEN 2 THEN 'trace:' || CAST(event_id % 50 AS VARCHAR) || '/' || CAST(event_id % 6 AS VARCHAR) ELSE 'log-' || lpad(CAST(event_id AS VARCHAR), 9, '0') END AS ref
  FROM events)"""


def _refs(spark, sf_dir):
    i = F.col("event_id")
    n = (i % 5).cast("int")
    s = i.cast("string")
    signal = F.when(n == 0, "change").when(n == 1, "log").when(n == 2, "trace").when(n == 3, "profile").otherwise("log")
    ref = F.when(n <= 1, F.concat(F.lit("change:"), s)).when(n == 2, F.concat(F.lit("trace:"), (i % 50).cast("string"), F.lit("/"), (i % 6).cast("string"))).otherwise(F.format_string("log-%09d", i))
    return table(spark, sf_dir, "events").select(i.alias("ref_id"), signal.alias("signal"), ref.alias("ref"))


@query(f"""WITH {_RECORDS}, {_REFS},
l AS (SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM records x WHERE x.key = r.ref) AND starts_with(ref, 'trace:') THEN substr(ref, 7) ELSE ref END AS k FROM refs r),
c AS (SELECT ref_id, signal, ref, count(kind) AS n, count(CASE WHEN kind = signal OR (signal = 'trace' AND kind = 'span') THEN 1 END) AS ok FROM l LEFT JOIN records ON key = k GROUP BY ALL)
SELECT ref_id, signal, ref, CASE WHEN signal = 'profile' THEN 'unsupported' WHEN n = 0 THEN 'missing' WHEN ok = 0 THEN 'signal_mismatch' WHEN ok = 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM c""")
def resolve_refs_outcome(spark, sf_dir):
    return store.resolve_refs(_refs(spark, sf_dir), _records(spark, sf_dir))


@query(f"""WITH {_RECORDS}, {_REFS} SELECT ref_id, ref, CASE count(key) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM refs LEFT JOIN records ON key = ref GROUP BY ALL""")
def resolve_scalar_refs(spark, sf_dir):
    return store.resolve_scalars(_refs(spark, sf_dir), _records(spark, sf_dir))


@query(f"""WITH {_REFS} SELECT ref_id, CASE WHEN starts_with(r, 'aw-') THEN 'anomaly_window' WHEN starts_with(r, 'change:') THEN 'change' WHEN starts_with(r, 'log-') THEN 'log' WHEN contains(r, '@') THEN 'metric'
  WHEN starts_with(r, 'trace:') OR contains(r, '/') THEN 'trace' END AS inferred FROM (SELECT ref_id, CASE WHEN ref_id % 7 = 0 THEN 'm@' || ref ELSE ref END AS r FROM refs)""")
def infer_signal(spark, sf_dir):
    r = _refs(spark, sf_dir).withColumn("ref", F.when(F.col("ref_id") % 7 == 0, F.concat(F.lit("m@"), "ref")).otherwise(F.col("ref")))
    return r.select("ref_id", text.signal_of_ref(F.col("ref")).alias("inferred"))


@query(f"WITH {_RECORDS} SELECT key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS categories FROM records GROUP BY key")
def reference_index(spark, sf_dir):
    return store.reference_index(_records(spark, sf_dir)).select("key", F.array_join("categories", ",").alias("categories"))


@query("SELECT conv_id AS trace_id, min(turn) AS start_at, max(turn + length(text)) AS end_at, count(*) AS n_spans FROM conversations GROUP BY conv_id")
def trace_window(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("start"), (F.col("turn") + F.length("text")).alias("end"))
    return store.trace_windows(s).select("trace_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "n_spans")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, c_nationkey AS nation, c_mktsegment AS segment, rank = 1 AND s_nationkey IS NULL AS inserted FROM (
  SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS rank FROM customer)
  LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = c_nationkey AND c_mktsegment = 'BUILDING'""")
def insert_unique(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_nationkey").alias("nation"), F.lit("BUILDING").alias("segment"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("boolean").alias("inserted"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("seq"), F.lit(True).alias("inserted"))
    merged, refused = store.insert_unique(old, new, "nation", "segment")
    return merged.where("inserted").unionByName(refused.withColumn("inserted", F.lit(False))).select("key", "nation", "segment", "inserted")


# --- series -------------------------------------------------------------------


@query(_windows_sql("e1", "CASE WHEN b = 0 THEN v > 0 ELSE v >= b * 3 END", _E1))
def anomaly_windows(spark, sf_dir):
    return _windows(adapters.value_series(table(spark, sf_dir, "events")))


@query(_windows_sql("e1", "v <= b * 0.75", _E1, drop=True))
def drop_anomaly(spark, sf_dir):
    return _windows(adapters.value_series(table(spark, sf_dir, "events"), "cache.hit_ratio"), drop=True)


@query(_windows_sql("e2", "v >= b + 0.015 AND v >= b * 4", _E2))
def error_rate_anomaly(spark, sf_dir):
    return _windows(adapters.error_series(table(spark, sf_dir, "events")))


@query(f"""WITH {_E1}, base AS (SELECT entity, arg_min(v, t) AS b, min(t) AS t0 FROM e1 GROUP BY entity)
SELECT entity, count(CASE WHEN v >= 1.8 * b THEN 1 END) AS n_high, count(CASE WHEN v <= 0.4 * b AND t > t0 THEN 1 END) AS n_low,
  count(*) >= 5 AND count(CASE WHEN v >= 1.8 * b THEN 1 END) >= 2 AND count(CASE WHEN v <= 0.4 * b AND t > t0 THEN 1 END) >= 2 AS is_sawtooth FROM e1 JOIN base USING (entity) GROUP BY entity""")
def sawtooth(spark, sf_dir):
    p = adapters.value_series(table(spark, sf_dir, "events"), "memory.rss_bytes")
    return series.sawtooth(p, series.baselines(p)).select("entity", "n_high", "n_low", "is_sawtooth")


@query(f"""WITH {_E1}, base AS (SELECT entity, arg_min(v, t) AS b, max(v) AS peak FROM e1 GROUP BY entity)
SELECT entity, {_t("min(t)")} AS material_at FROM e1 JOIN base USING (entity) WHERE (CASE WHEN b = 0 THEN v > 0 ELSE v >= b * 3 END) AND v >= 0.5 * peak GROUP BY entity""")
def first_material_point(spark, sf_dir):
    return series.first_material(adapters.value_series(table(spark, sf_dir, "events"))).select("entity", _s("material_t").alias("material_at"))


@query(f"""WITH {_E1}, base AS (SELECT entity, max(v) AS peak FROM e1 GROUP BY entity)
SELECT entity, {_t("min(CASE WHEN v >= 0.95 * peak THEN t END)")} AS near_at, {_t("max(CASE WHEN v = peak THEN t END)")} AS peak_at FROM e1 JOIN base USING (entity) GROUP BY entity""")
def near_limit_point(spark, sf_dir):
    return series.near_limit(adapters.value_series(table(spark, sf_dir, "events"))).select("entity", _s("near_t").alias("near_at"), _s("peak_t").alias("peak_at"))


@query("""SELECT 'svc:' || CAST(user_id % 4 AS VARCHAR) AS entity, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, max(value) AS v, count(*) AS n_merged FROM (
  SELECT user_id, date_trunc('day', ts) AS ts, max(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1, 2""")
def series_merge_max(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    p = ev.groupBy(F.concat(F.lit("instance:"), F.col("user_id").cast("string")).alias("entity"), F.date_trunc("day", "ts").alias("t")).agg(F.max("value").alias("v"))
    p = p.select(F.lit("x").alias("incident_id"), F.lit("m").alias("name"), "entity", "t", "v", F.lit(0).cast("long").alias("ord"))
    mapping = ev.select("user_id").distinct().select(F.concat(F.lit("instance:"), F.col("user_id").cast("string")).alias("instance"), F.concat(F.lit("svc:"), (F.col("user_id") % 4).cast("string")).alias("service"))
    mapped = series.instance_entities(p, mapping)
    n = mapped.groupBy("entity", "t").agg(F.count("*").alias("n_merged"))
    return series.merge_max(mapped).join(n, ["entity", "t"]).select("entity", F.date_format("t", "yyyy-MM-dd").alias("day"), "v", "n_merged")


_BOUNDS = ("2024-01-01 00:00:00", "2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-20 00:00:00")


@query(f"""WITH {_E1},
w AS (SELECT entity, coalesce(arg_max(v, t) FILTER (t BETWEEN TIMESTAMP '{_BOUNDS[0]}' AND TIMESTAMP '{_BOUNDS[1]}'), arg_max(v, t) FILTER (t <= TIMESTAMP '{_BOUNDS[1]}')) AS f,
  coalesce(arg_max(v, t) FILTER (t BETWEEN TIMESTAMP '{_BOUNDS[2]}' AND TIMESTAMP '{_BOUNDS[3]}'), arg_max(v, t) FILTER (t <= TIMESTAMP '{_BOUNDS[3]}')) AS g FROM e1 GROUP BY entity)
SELECT entity, round(f, 6) AS from_v, round(g, 6) AS to_v, round(g - f, 6) AS delta, round(g / nullif(f, 0), 6) AS factor,
  (abs(g - f) <= 0.05 * greatest(abs(f), 1e-9)) OR coalesce(g / nullif(f, 0) <= 1.2, false) OR abs(g - f) <= 0.1 * greatest(abs(f), 1.0) AS is_counter FROM w WHERE f IS NOT NULL AND g IS NOT NULL""")
def window_compare(spark, sf_dir):
    b = spark.createDataFrame([(adapters.INCIDENT, *_BOUNDS)], "incident_id string, a string, b string, c string, d string").select("incident_id", *(F.to_timestamp(c).alias(n) for c, n in zip("abcd", ("healthy_start", "healthy_end", "anomalous_start", "anomalous_end"), strict=True)))
    w = series.compare_windows(adapters.value_series(table(spark, sf_dir, "events")), b)
    return w.select("entity", *(F.round(c, 6).alias(c) for c in ("from_v", "to_v", "delta", "factor")), "is_counter")


@query(f"""WITH {_E1}, n AS (SELECT entity, t, lead(t) OVER (PARTITION BY entity ORDER BY t) AS nt FROM e1)
SELECT entity, {_t("t")} AS start_at, {_t("nt")} AS end_at, CAST(date_diff('second', t, nt) / 3600.0 AS DOUBLE) AS hours FROM n WHERE date_diff('second', t, nt) > 2 * 3600""")
def telemetry_gaps(spark, sf_dir):
    return series.gaps(adapters.value_series(table(spark, sf_dir, "events")), 2).select("entity", _s("start").alias("start_at"), _s("end").alias("end_at"), "hours")


@query(f"""SELECT l.event_id AS id, {_t("date_trunc('minute', max(r.ts))")} AS nearest_at FROM events l LEFT JOIN (SELECT ts FROM events WHERE event_type = 'signup') r
  ON r.ts <= l.ts AND date_diff('minute', date_trunc('minute', r.ts), date_trunc('minute', l.ts)) <= 180 WHERE l.event_type = 'error' GROUP BY l.event_id""")
def nearest_change_asof(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    left = ev.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("t"))
    return series.nearest_before(left, adapters.changes(ev).select("t"), 180).select("id", _s("nearest_t").alias("nearest_at"))


# --- logs and text ------------------------------------------------------------


@query(f"""WITH {_LOGS}, k AS (SELECT *, regexp_replace(regexp_replace(body, 'attempt [0-9]+/', 'attempt <n>/'), '\\([0-9]+\\)', '(<n>)', 'g') AS template FROM logs WHERE severity <> 'INFO'),
g AS (SELECT entity, severity, template, count(*) AS n, min(t) AS a, max(t) AS z, arg_min(log_id, (t, log_id)) AS fa, arg_max(log_id, (t, log_id)) AS fz FROM k GROUP BY ALL)
SELECT entity, severity, template, n AS count, {_t("a")} AS first_seen, {_t("z")} AS last_seen, CASE WHEN fa <> fz THEN fa || ',' || fz ELSE fa END AS exemplars, 'new-since-incident' AS stability,
  'lp-' || CAST(row_number() OVER (ORDER BY a, entity, severity, template) AS VARCHAR) AS id FROM g""")
def log_patterns(spark, sf_dir):
    p = logs.log_patterns(adapters.logs(table(spark, sf_dir, "events")))
    return p.select("entity", "severity", "template", "count", _s("first_seen").alias("first_seen"), _s("last_seen").alias("last_seen"), F.array_join("exemplars", ",").alias("exemplars"), "stability", "id")


@query("""SELECT doc_id, sha256(regexp_replace(text, '\\([0-9]+\\)', '(<n>)', 'g')) AS template FROM documents WHERE text IS NOT NULL""")
def log_template(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(text.log_template(F.col("text")), 256).alias("template"))


@query("""SELECT event_id, CASE WHEN event_type IN ('purchase', 'view') THEN upper(event_type) END AS verb, regexp_extract('service:api-shard-' || CAST(user_id AS VARCHAR), '-shard-([0-9]+)$', 1) AS shard,
  'svc' || CAST(user_id % 3 AS VARCHAR) AS service, event_type IN ('purchase', 'signup') AS writes, CASE WHEN event_type <> 'view' THEN event_type END AS present FROM events""")
def text_helpers(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    statement = F.when(F.col("event_type").isin("purchase", "signup"), F.lit("  insert into t")).otherwise(F.lit("select 1"))
    span_name = F.when(F.col("event_type") == "purchase", F.lit("POST /x")).when(F.col("event_type") == "view", F.lit("GET /x")).otherwise(F.lit("handle"))
    verb = F.when(text.method_of(span_name).isNotNull(), F.upper("event_type"))
    return ev.select(
        "event_id", verb.alias("verb"), text.shard_number(F.concat(F.lit("service:api-shard-"), u)).alias("shard"),
        text.service_name(F.concat(F.lit("service:svc"), (F.col("user_id") % 3).cast("string"), F.lit("@canary"))).alias("service"),
        text.is_write(statement).alias("writes"), text.blank_to_null(F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("event_type"))).alias("present"),
    )


@query(f"""SELECT event_id, {_t("date_trunc('minute', ts)")} AS floored, {_t("date_trunc('minute', ts) - INTERVAL 2 MINUTE")} AS shifted, date_diff('minute', TIMESTAMP '2024-01-01 00:00:30', ts) AS minutes,
  abs(date_diff('second', TIMESTAMP '2024-01-10 00:00:00', date_trunc('second', ts))) AS lag, strftime(ts, '%H:%M') AS hhmm, {_t("date_trunc('second', ts)")} AS parsed FROM events""")
def time_functions(spark, sf_dir):
    t = F.col("ts")
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf_dir, "events").select(
        "event_id", _s(times.floor_minute(t)).alias("floored"), _s(times.shift_minutes(t, -2)).alias("shifted"), times.minutes_between(F.to_timestamp(F.lit("2024-01-01 00:00:30")), t).alias("minutes"),
        times.lag_seconds(F.to_timestamp(F.lit("2024-01-10 00:00:00")), t).alias("lag"), times.hhmm(t).alias("hhmm"), _s(times.parse(iso)).alias("parsed"),
    )


@query("""WITH RECURSIVE b AS (SELECT n_name, 0 AS i, 14695981039346656037::UHUGEINT AS h FROM nation
  UNION ALL SELECT n_name, i + 1, (xor(h::HUGEINT, ascii(substr(n_name, i + 1, 1))::HUGEINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM b WHERE i < length(n_name))
SELECT n_name, lpad(lower(to_hex(h::UBIGINT)), 16, '0') AS hash FROM b WHERE i = length(n_name)""")
def stable_hash(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", scores.fnv1a64(F.col("n_name")).alias("hash"))


# --- entities and relationships -----------------------------------------------

_RES = "res AS (SELECT s_suppkey AS seq, n_name AS service_name, CASE WHEN s_suppkey % 2 = 0 THEN 'v' || CAST(s_suppkey % 3 AS VARCHAR) END AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_AMB = "amb AS (SELECT service_name, count(*) AS n_resources FROM res GROUP BY 1 HAVING count(*) > 1 AND bool_or(version IS NOT NULL) AND bool_or(version IS NULL))"


def _resources(spark, sf_dir):
    return adapters.resources(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))


@query(f"WITH {_RES}, {_AMB} SELECT * FROM amb")
def ambiguous_services(spark, sf_dir):
    return entities.ambiguous_services(_resources(spark, sf_dir))


@query(f"""WITH {_RES}, {_AMB}, l AS (SELECT service_name, max(version) AS latest FROM res GROUP BY 1),
r AS (SELECT service_name, CASE WHEN version IS NULL THEN 'unresolved' WHEN version = latest THEN 'canary' ELSE 'stable' END AS role FROM res JOIN amb USING (service_name) JOIN l USING (service_name))
SELECT 'service:' || service_name || '@' || role AS entity, role, count(*) AS n_resources, CASE role WHEN 'canary' THEN 0.96 WHEN 'stable' THEN 0.95 ELSE 0.40 END::DOUBLE AS confidence FROM r GROUP BY service_name, role""")
def split_ambiguous(spark, sf_dir):
    return entities.split_ambiguous(_resources(spark, sf_dir))


@query("""SELECT 'user:' || CAST(user_id AS VARCHAR) AS entity, round(count(*) / (SELECT count(*) FROM events), 2)::DOUBLE AS share FROM events WHERE event_type = 'error' GROUP BY user_id""")
def unresolved_share(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return entities.unresolved_share(ev, F.when(F.col("event_type") == "error", F.concat(F.lit("user:"), F.col("user_id").cast("string"))))


@query("""SELECT CASE WHEN s.n IS NULL THEN 'external-api:' || p.peer ELSE s.dst END AS dst, s.n IS NULL AS is_external, count(*) AS n_calls
FROM (SELECT n_name AS peer FROM customer JOIN nation ON c_nationkey = n_nationkey) p
LEFT JOIN (SELECT n_name AS n, 'service:' || CAST(min(s_suppkey) AS VARCHAR) AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) s ON s.n = p.peer GROUP BY 1, 2""")
def peer_services(spark, sf_dir):
    spans = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("peer"))
    services = _resources(spark, sf_dir).select("service_name", F.concat(F.lit("service:"), F.col("seq").cast("string")).alias("entity"), "seq")
    hit, miss = entities.peers(spans, services)
    both = hit.select("dst", F.lit(False).alias("is_external")).unionByName(miss.select("dst", F.lit(True).alias("is_external")))
    return both.groupBy("dst", "is_external").agg(F.count("*").alias("n_calls"))


_SPANS = """spans AS (SELECT conv_id AS trace_id, turn AS span_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_id, CASE WHEN role = 'assistant' THEN 'dependency' ELSE 'service' END AS endpoint,
  CASE WHEN role = 'assistant' THEN 'dependency:' ELSE 'service:' END || role AS entity, length(text) AS size FROM conversations)"""
_UP = """up AS (SELECT s.trace_id, s.span_id, p.span_id AS at, 1 AS depth, p.endpoint = 'service' AS hit FROM spans s JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id
  UNION ALL SELECT u.trace_id, u.span_id, g.span_id, u.depth + 1, g.endpoint = 'service' FROM up u JOIN spans p ON p.trace_id = u.trace_id AND p.span_id = u.at JOIN spans g ON g.trace_id = p.trace_id AND g.span_id = p.parent_id WHERE NOT u.hit),
anc AS (SELECT u.trace_id, u.span_id, u.at AS ancestor_id, CAST(u.depth AS INTEGER) AS depth, a.entity AS ancestor FROM up u JOIN spans a ON a.trace_id = u.trace_id AND a.span_id = u.at WHERE u.hit)"""


def _spans(spark, sf_dir):
    return adapters.spans(table(spark, sf_dir, "conversations"))


@query(f"WITH RECURSIVE {_SPANS}, {_UP} SELECT * FROM anc")
def nearest_service_ancestor(spark, sf_dir):
    return entities.nearest_service(_spans(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SPANS}, {_UP} SELECT ancestor AS src, entity AS dst, 0.98::DOUBLE AS confidence, count(DISTINCT span_id) AS n_evidence FROM spans JOIN anc USING (trace_id, span_id) WHERE ancestor <> entity GROUP BY 1, 2""")
def call_edges(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return entities.call_edges(s, entities.nearest_service(s)).select("src", "dst", "confidence", F.size("evidence").cast("long").alias("n_evidence"))


_SIBS = "sib AS (SELECT conv_id AS trace_id, turn AS span_id, CASE WHEN turn >= 2 THEN turn // 2 END AS parent_id, role = 'assistant' AND turn % 3 = 0 AS miss FROM conversations)"


@query(f"WITH {_SIBS} SELECT a.trace_id, a.span_id FROM sib a WHERE EXISTS (SELECT 1 FROM sib b WHERE b.miss AND b.trace_id = a.trace_id AND b.parent_id IS NOT DISTINCT FROM a.parent_id AND b.span_id <> a.span_id)")
def cache_miss_sibling(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.when(F.col("turn") >= 2, F.floor(F.col("turn") / 2)).alias("parent_id"), ((F.col("role") == "assistant") & (F.col("turn") % 3 == 0)).alias("miss"))
    return entities.with_miss_sibling(s.drop("miss"), s.where("miss")).select("trace_id", "span_id")


@query("""WITH r AS (SELECT DISTINCT 'c:' || CAST(o_custkey % 40 AS VARCHAR) AS src, l_partkey % 200 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
w AS (SELECT DISTINCT 's:' || CAST(l_suppkey % 40 AS VARCHAR) AS other, l_partkey % 200 AS dst FROM lineitem WHERE 0.9 + l_discount >= 0.96)
SELECT src, other, count(*) AS n_shared FROM r JOIN w USING (dst) WHERE src <> other GROUP BY src, other""")
def shared_resource_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    dst = (F.col("l_partkey") % 200).alias("dst")
    reads = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c:"), (F.col("o_custkey") % 40).cast("string")).alias("src"), dst)
    writes = li.select(F.concat(F.lit("s:"), (F.col("l_suppkey") % 40).cast("string")).alias("src"), dst, (F.lit(0.9) + F.col("l_discount")).alias("confidence"))
    return entities.shared_resource_edges(reads, writes)


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'))) AS stem FROM part),
s AS (SELECT lower(p_type) AS stem, min(p_partkey) AS seq FROM part GROUP BY 1 UNION ALL SELECT DISTINCT regexp_split_to_array(lower(p_name), '[^a-z0-9]+')[1], 1000000 FROM part)
SELECT p_partkey AS change_id, arg_min(stem, (seq, stem)) AS stem FROM w JOIN s USING (stem) WHERE stem <> '' GROUP BY 1""")
def change_text_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stems = p.groupBy(F.lower("p_type").alias("stem")).agg(F.min("p_partkey").alias("seq")).unionByName(p.select(F.get(F.split(F.lower("p_name"), "[^a-z0-9]+"), 0).alias("stem"), F.lit(1000000).cast("long").alias("seq")).distinct())
    stems = stems.withColumn("seq", F.struct("seq", "stem"))
    return entities.named_in_text(p.select(F.col("p_partkey").alias("change_id"), F.col("p_name").alias("summary")), stems)


@query("""SELECT o_custkey % 100 AS trace_id, 'c:' || CAST(o_custkey % 100 AS VARCHAR) AS src, o_orderstatus AS dst, count(*) AS n, max(o_orderkey % 4) AS max_attempt, 0.95::DOUBLE AS confidence FROM orders GROUP BY 1, 2, 3 HAVING count(*) >= 60 OR max(o_orderkey % 4) >= 60""")
def retry_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("trace_id"), F.concat(F.lit("c:"), (F.col("o_custkey") % 100).cast("string")).alias("src"), F.col("o_orderstatus").alias("dst"), (F.col("o_orderkey") % 4).alias("attempt"))
    return entities.retry_edges(o, 60)


@query("""WITH f AS (SELECT 'e:' || CAST(l_suppkey AS VARCHAR) AS id, l_returnflag AS kind, l_shipdate AS d, l_discount AS confidence, l_linenumber AS ln, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
k AS (SELECT id, arg_min(kind, seq) AS fk FROM f GROUP BY id)
SELECT id, fk AS kind, max(CASE WHEN kind = fk THEN confidence END) AS confidence, count(DISTINCT ln) AS n_sources, CAST(arg_min(ln, seq) AS VARCHAR) AS first_source FROM f JOIN k USING (id) GROUP BY id, fk""")
def entity_merge(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("e:"), F.col("l_suppkey").cast("string")).alias("id"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").cast("string").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    m = entities.merge_entities(f)
    return m.select("id", "kind", "confidence", F.size("sources").cast("long").alias("n_sources"), F.element_at("sources", 1).alias("first_source"))


@query("""SELECT 'c:' || CAST(o_custkey % 25 AS VARCHAR) AS src, 'reads-from' AS type, 's:' || CAST(l_suppkey % 25 AS VARCHAR) AS dst, max(l_discount) AS confidence, count(DISTINCT l_linenumber) AS n_evidence, arg_min(o_orderpriority, (l_orderkey, l_linenumber)) AS attributes
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""")
def relationship_merge(spark, sf_dir):
    e = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("c:"), (F.col("o_custkey") % 25).cast("string")).alias("src"), F.lit("reads-from").alias("type"), F.concat(F.lit("s:"), (F.col("l_suppkey") % 25).cast("string")).alias("dst"),
        F.col("l_discount").alias("confidence"), F.col("l_linenumber").cast("string").alias("evidence"), F.col("o_orderpriority").alias("attributes"), F.struct("l_orderkey", "l_linenumber").alias("seq"),
    )
    return entities.merge_edges(e).select("src", "type", "dst", "confidence", F.size("evidence").cast("long").alias("n_evidence"), "attributes")


@query("""SELECT c.c_custkey AS id, round(CASE WHEN coalesce(s.q, 1.0) < 0.5 OR coalesce(d.q, 1.0) < 0.5 THEN greatest(0.75, 0.30) ELSE 0.95 END, 6)::DOUBLE AS confidence
FROM customer c LEFT JOIN (SELECT s_suppkey, s_suppkey % 10 / 10.0 AS q FROM supplier) s ON s.s_suppkey = c_custkey LEFT JOIN (SELECT s_suppkey, s_suppkey % 10 / 10.0 AS q FROM supplier) d ON d.s_suppkey = c_nationkey""")
def damped_edges(spark, sf_dir):
    ent = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), ((F.col("s_suppkey") % 10) / 10.0).alias("confidence"))
    edges = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("src"), F.col("c_nationkey").cast("string").alias("dst"), F.lit(0.95).alias("confidence"))
    return entities.edge_confidence(edges, ent).select(F.col("c_custkey").alias("id"), F.round("confidence", 6).alias("confidence"))


from evidra.plans import answers as _answers, context as _context, more as _more, whole as _whole  # noqa: E402,F401  register the rest
