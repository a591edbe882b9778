"""Further registered queries: timeline, evidence, ingest, replay, validation, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import scores, text
from evidra.operators import evidence, quality, series, timeline
from evidra.plans.catalogue import _E1, _E2, _s, _t, _windows_sql, query
from evidra.sources import adapters, otlp, replay
from evidra.sources.adapters import table
from evidra.streaming import incremental

_W1 = f"w AS (SELECT entity, start_at, end_at, last_at FROM ({_windows_sql('e1', 'CASE WHEN b = 0 THEN v > 0 ELSE v >= b * 3 END', _E1)}))"
_W2 = f"w AS (SELECT entity, start_at, end_at FROM ({_windows_sql('e2', 'v >= b + 0.015 AND v >= b * 4', _E2)}))"
_NEXT = "ed AS (SELECT 'bucket:' || CAST(i AS VARCHAR) AS src, 'bucket:' || CAST((i + 1) % 10 AS VARCHAR) AS dst FROM range(10) r(i))"
_TYPES = "ed AS (SELECT DISTINCT 'type:' || a.event_type AS src, 'type:' || b.event_type AS dst FROM (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT event_type FROM events) b WHERE a.event_type > b.event_type)"


def _bucket_edges(spark):
    i = F.col("id")
    return spark.range(10).select(F.lit(adapters.INCIDENT).alias("incident_id"), F.concat(F.lit("bucket:"), i.cast("string")).alias("src"), F.lit("depends-on").alias("type"), F.concat(F.lit("bucket:"), ((i + 1) % 10).cast("string")).alias("dst"))


def _type_edges(spark, sf_dir):
    k = table(spark, sf_dir, "events").select("event_type").distinct()
    pairs = k.select(F.col("event_type").alias("a")).join(k.select(F.col("event_type").alias("b")), F.col("a") > F.col("b"))  # five event types
    return pairs.select(F.lit(adapters.INCIDENT).alias("incident_id"), F.concat(F.lit("type:"), "a").alias("src"), F.lit("calls").alias("type"), F.concat(F.lit("type:"), "b").alias("dst"))


@query(f"WITH {_W1}, {_TYPES} SELECT DISTINCT w.entity, w.start_at FROM w JOIN ed ON src = w.entity JOIN w d ON d.entity = dst AND d.start_at < w.start_at")
def earlier_downstream_semi(spark, sf_dir):
    w = series.anomaly_windows(adapters.value_series(table(spark, sf_dir, "events"), "events.latency"))
    return timeline.propagated(w, _type_edges(spark, sf_dir)).select("entity", _s("start").alias("start_at"))


@query(f"""WITH {_W1}, {_TYPES} SELECT w.entity, w.start_at, CASE WHEN EXISTS (SELECT 1 FROM ed JOIN w d ON d.entity = dst WHERE src = w.entity AND d.start_at < w.start_at) THEN 'propagation' ELSE 'symptom' END AS marker FROM w""")
def marker_classify(spark, sf_dir):
    w = series.anomaly_windows(adapters.value_series(table(spark, sf_dir, "events"), "events.latency"))
    return timeline.window_events(w, _type_edges(spark, sf_dir)).select("entity", _s("t").alias("start_at"), "marker")


@query(f"""WITH {_W2}, o AS (SELECT min(start_at) AS onset FROM w),
c AS (SELECT {_t("ts")} AS at_time, ts AS t, 'bucket:' || CAST(user_id % 14 AS VARCHAR) AS entity, 'change:' || CAST(event_id AS VARCHAR) AS source_ref FROM events WHERE event_type = 'signup'),
ev AS (SELECT at_time, t, CASE WHEN t > CAST(onset AS TIMESTAMP) AND entity NOT IN (SELECT entity FROM w) THEN 'non-causal-change' ELSE 'change' END AS marker, entity, source_ref FROM c, o
  UNION ALL SELECT start_at, CAST(start_at AS TIMESTAMP), 'symptom', entity, 'events.error_rate@' || entity FROM w)
SELECT at_time, marker, entity, source_ref, CAST(row_number() OVER (ORDER BY date_trunc('minute', t), CASE marker WHEN 'change' THEN 0 WHEN 'symptom' THEN 2 ELSE 5 END, t, entity, source_ref) AS INTEGER) AS position FROM ev""")
def timeline_sorted(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    w = series.anomaly_windows(adapters.error_series(ev))
    ch = ev.where("event_type = 'signup'").select(F.lit(adapters.INCIDENT).alias("incident_id"), F.concat(F.lit("change:"), F.col("event_id").cast("string")).alias("change_id"), F.col("ts").alias("t"), F.lit("deploy").alias("kind"), F.concat(F.lit("bucket:"), (F.col("user_id") % 14).cast("string")).alias("entity"))
    events = timeline.change_events(ch, w).unionByName(timeline.window_events(w, _bucket_edges(spark)))
    return timeline.ordered(events).select(_s("t").alias("at_time"), "marker", "entity", "source_ref", "position")


@query(f"""WITH {_W2}, {_NEXT} SELECT a.entity AS seed, b.entity AS related, 'downstream-dependency' AS relation, abs(date_diff('second', CAST(a.start_at AS TIMESTAMP), CAST(b.start_at AS TIMESTAMP))) AS lag_seconds
FROM w a JOIN ed ON src = a.entity JOIN w b ON b.entity = dst WHERE a.entity <> b.entity""")
def related_lag(spark, sf_dir):
    w = series.anomaly_windows(adapters.error_series(table(spark, sf_dir, "events"))).withColumn("id", F.col("entity"))
    r = timeline.related(w, _bucket_edges(spark), w)
    return r.select("seed", F.col("id").alias("related"), "relation", "lag_seconds")


def _candidates(spark, sf_dir):
    """Synthetic candidates: every order line is one, its numbers stand for confidences."""
    x = F.col
    n = (x("l_linenumber") % 8).cast("int")
    d, tax = x("l_discount"), x("l_tax")
    source = F.element_at(F.array(*map(F.lit, evidence.SOURCES)), n + 1)
    direction = F.when(n == 7, F.when(x("l_returnflag") == "R", "contradicts").otherwise("weakens")).when(n.isin(4, 6), "neutral").otherwise("supports")
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("inc-"), x("l_orderkey").cast("string")).alias("incident_id"), F.format_string("cand-%03d", x("l_linenumber")).alias("candidate_id"), source.alias("source"),
        direction.alias("direction"), source.alias("kind"), F.array(F.concat(F.lit("service:"), (x("l_partkey") % 10).cast("string"))).alias("entities"), F.lit(1).alias("n_entities"), F.lit(2).alias("n_refs"),
        (0.3 + d * 5).alias("detector"), (d * 8).alias("magnitude"), F.lit(1.0).alias("coverage"), F.lit(0.95).alias("severity_score"), (tax * 10).alias("volume"), F.lit(1.0).alias("exemplar_quality"),
        (0.2 + tax * 9).alias("time_alignment"), F.lit(0.65).alias("span_specificity"), F.lit(0.9).alias("edge_confidence"), (0.5 + d * 4).alias("similarity"), F.lit(0).alias("has_missing"),
        F.when(x("l_linestatus") == "O", "flat").alias("note"), (1 - tax).alias("ref_quality"), F.lit(True).alias("has_window"), F.lit("http.server.error_rate").alias("signal"), "l_quantity",
    )


_CAND = """cand AS (SELECT 'inc-' || CAST(l_orderkey AS VARCHAR) AS incident_id, 'cand-' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS candidate_id, l_linenumber % 8 AS n, 'service:' || CAST(l_partkey % 10 AS VARCHAR) AS entity,
  l_discount AS d, l_tax AS tax, 1 - l_tax AS q, l_returnflag AS rf, l_linestatus AS ls, l_quantity FROM lineitem),
st AS (SELECT *, n = 0 AND 0.3 + d * 5 < 0.4 AS unsure,
  CASE n WHEN 7 THEN CASE rf WHEN 'R' THEN 'contradicts' ELSE 'weakens' END WHEN 4 THEN 'neutral' WHEN 6 THEN 'neutral' WHEN 0 THEN CASE WHEN 0.3 + d * 5 < 0.4 THEN 'weakens' ELSE 'supports' END ELSE 'supports' END AS dir,
  greatest(0.0, least(1.0, CASE n WHEN 0 THEN (0.3 + d * 5) * 0.35 + d * 8 * 0.25 + 0.2 + q * 0.2 WHEN 1 THEN 0.95 * 0.35 + tax * 10 * 0.25 + 0.2 + q * 0.2 WHEN 2 THEN (0.2 + tax * 9) * 0.45 + 0.2 + q * 0.2 + 0.75 * 0.15
   WHEN 3 THEN 0.65 * 0.4 + 0.45 * 0.3 + q * 0.3 WHEN 4 THEN 0.9 * 0.7 + q * 0.3 WHEN 5 THEN (0.5 + d * 4) * 0.45 + 0.85 * 0.25 + q * 0.3 WHEN 6 THEN 0.55 * 0.45 + 0.8 * 0.25 + q * 0.3
   ELSE CASE WHEN rf = 'R' THEN 0.95 WHEN ls = 'O' THEN 0.9 ELSE 0.75 END * 0.65 + q * 0.35 END)) AS strength FROM cand)"""


@query(f"WITH {_CAND} SELECT incident_id, candidate_id, dir AS direction, round(strength + 1e-9, 5) AS strength FROM st")
def candidates_scored(spark, sf_dir):
    return evidence.strengths(_candidates(spark, sf_dir)).select("incident_id", "candidate_id", "direction", F.round(F.col("strength") + 1e-9, 5).alias("strength"))


@query(f"""WITH {_CAND},
m AS (SELECT *, greatest(0.55, least(1.35, 1.12 - CASE WHEN dir <> 'supports' THEN 0.1 ELSE 0 END + CASE n WHEN 0 THEN 0.1 + CASE WHEN d * 8 >= 0.75 THEN 0.1 ELSE 0 END - CASE WHEN 0.3 + d * 5 < 0.4 THEN 0.2 ELSE 0 END
  WHEN 1 THEN 0.12 + CASE WHEN tax * 10 >= 0.75 THEN 0.06 ELSE 0 END WHEN 2 THEN CASE WHEN 0.2 + tax * 9 >= 0.8 THEN 0.12 WHEN 0.2 + tax * 9 >= 0.6 THEN 0.05 WHEN 0.2 + tax * 9 < 0.35 THEN -0.2 ELSE 0 END
  WHEN 4 THEN 0.04 WHEN 5 THEN CASE WHEN 0.5 + d * 4 >= 0.8 THEN 0.1 ELSE 0 END ELSE 0 END)) AS mult FROM st),
r AS (SELECT incident_id, entity, CASE WHEN dir = 'supports' THEN strength * mult * CASE n WHEN 0 THEN 0.6 WHEN 1 THEN 0.55 WHEN 2 THEN (0.2 + tax * 9) * 0.55 WHEN 3 THEN 0.45 WHEN 5 THEN 0.55 ELSE 0 END ELSE 0 END AS s,
  strength * mult * CASE dir WHEN 'contradicts' THEN 1.15 WHEN 'weakens' THEN 0.95 ELSE 0 END AS x FROM m
  UNION ALL SELECT incident_id, 'under-determined', 0.8 * strength, 0 FROM m WHERE n = 6),
g AS (SELECT incident_id, entity, sum(s) AS support, sum(x) AS counter FROM r GROUP BY ALL),
k AS (SELECT *, CASE WHEN support - 1.15 * counter <= 0 THEN greatest(0.0, least(0.18, 0.05 + 0.05 * support)) ELSE 1 - exp(-0.75 * (support - 1.15 * counter)) END AS score FROM g WHERE support >= 0.2 OR counter >= 0.45 OR entity = 'under-determined')
SELECT incident_id, entity, round(support + 1e-9, 5) AS support, round(counter + 1e-9, 5) AS counter, round(score + 1e-9, 5)::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY round(score, 9) DESC, entity) AS INTEGER) AS rank, counter >= greatest(support, 0.2) AS is_trap FROM k""")
def cause_rank(spark, sf_dir):
    s = evidence.suspects(evidence.strengths(_candidates(spark, sf_dir)))
    ranked = evidence.rank_causes(s)
    return ranked.select("incident_id", "entity", F.round(F.col("support") + 1e-9, 5).alias("support"), F.round(F.col("counter") + 1e-9, 5).alias("counter"), F.round(F.col("score") + 1e-9, 5).alias("score"), "rank", "is_trap")


@query(f"""WITH RECURSIVE {_CAND},
o AS (SELECT incident_id, candidate_id, CAST(l_quantity AS BIGINT) AS cost, row_number() OVER (PARTITION BY incident_id ORDER BY CASE WHEN dir = 'supports' AND n = 2 THEN 0 WHEN dir = 'supports' AND n = 0 THEN 1 WHEN dir = 'supports' AND n = 3 THEN 2 WHEN dir = 'supports' AND n = 1 THEN 3
  WHEN n = 7 OR dir IN ('weakens', 'contradicts') THEN 4 WHEN n = 6 THEN 5 WHEN n = 5 THEN 6 WHEN n = 4 THEN 7 ELSE 8 END, round(strength, 6) DESC, l_quantity, candidate_id) AS p FROM st),
w AS (SELECT incident_id, 0::BIGINT AS p, 0 AS n, 0::BIGINT AS tokens, false AS selected, NULL::VARCHAR AS reason FROM (SELECT DISTINCT incident_id FROM o)
  UNION ALL SELECT f.incident_id, f.p, w.n + CASE WHEN w.n < 3 AND w.tokens + cost <= 90 THEN 1 ELSE 0 END, w.tokens + CASE WHEN w.n < 3 AND w.tokens + cost <= 90 THEN cost ELSE 0 END, w.n < 3 AND w.tokens + cost <= 90,
    CASE WHEN w.n >= 3 THEN 'max_items' WHEN w.tokens + cost > 90 THEN 'max_tokens' END FROM w JOIN o f ON f.incident_id = w.incident_id AND f.p = w.p + 1)
SELECT incident_id, candidate_id, CAST(p AS INTEGER) AS position, selected, reason FROM w JOIN o USING (incident_id, p)""")
def greedy_select(spark, sf_dir):
    s = evidence.strengths(_candidates(spark, sf_dir)).withColumn("grp", evidence.selection_group(F.col("direction"), F.col("source"), F.col("kind")))
    order = ["grp", F.desc(F.round("strength", 6)), "l_quantity", "candidate_id"]
    picked = evidence.greedy_select(s, ["incident_id"], order, 3, 90, cost="l_quantity")
    return picked.select("incident_id", "candidate_id", "position", "selected", "reason")


@query("""WITH r AS (SELECT 'inc-' || CAST(o_custkey % 30 AS VARCHAR) AS incident_id, o_orderstatus AS expected_signal, o_orderpriority AS action, min(o_orderkey % 5) AS priority FROM orders GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY priority, expected_signal, action) AS rank FROM r) SELECT incident_id, expected_signal, action, priority, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def next_checks_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("inc-"), (F.col("o_custkey") % 30).cast("string")).alias("incident_id"), (F.col("o_orderkey") % 5).alias("priority"), F.col("o_orderstatus").alias("expected_signal"), F.col("o_orderpriority").alias("action"), F.lit("x").alias("rationale"))
    return evidence.next_checks(o).drop("rationale")


# --- validation, replay -------------------------------------------------------


@query("""SELECT 'c_mktsegment' AS dimension, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2""")
def coverage_counts(spark, sf_dir):
    return quality.coverage(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def dangling_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return quality.dangling(refs, table(spark, sf_dir, "part").where("p_size > 25"), "p_partkey")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT k, 'missing' AS side FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'extra' FROM a WHERE k NOT IN (SELECT k FROM b)""")
def missing_extra(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return quality.difference(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), ["k"])


@query("""WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS bal, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS bal, count(*) AS n FROM supplier GROUP BY 1)
SELECT k, 'n' AS field FROM a JOIN b USING (k) WHERE a.n <> b.n UNION ALL SELECT k, 'bal' FROM a JOIN b USING (k) WHERE abs(a.bal - b.bal) > greatest(abs(b.bal) * 0.05, 0.001)""")
def gold_compare(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("bal"), F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("bal"), F.count("*").alias("n"))
    return quality.compare(a, b, ["k"], exact=["n"], close=["bal"]).select("k", "field")


@query("""SELECT c_custkey AS key, 'balance' AS rule FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')""")
def validation_issues(spark, sf_dir):
    return quality.check(table(spark, sf_dir, "customer"), F.col("c_custkey"), balance=F.col("c_acctbal") >= 0, segment=F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"))


@query("""SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY user_id % 5 ORDER BY CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END, CASE WHEN event_id % 17 <> 0 THEN date_trunc('second', ts) END, event_id) - 1 AS INTEGER) AS sequence FROM events""")
def replay_order(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    iso = F.when(F.col("event_id") % 17 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    e = ev.select((F.col("user_id") % 5).alias("incident_id"), F.col("event_id").alias("input_order"), F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("key"), iso.alias("time"))
    return replay.plan(e).select("kind", "key", "sequence")


# --- ingest -------------------------------------------------------------------


def _otlp_documents(spark, sf_dir):
    """OTLP metric documents, one per user, from events."""
    ev = table(spark, sf_dir, "events")
    value = F.struct(F.col("user_id").cast("string").alias("stringValue"))
    point = F.struct((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    by = ev.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(point)).alias("points"))
    metric = F.struct(F.col("event_type").alias("name"), F.lit("1").alias("unit"), F.when(F.col("event_type") == "view", F.struct(F.col("points").alias("dataPoints"))).alias("sum"), F.when(F.col("event_type") != "view", F.struct(F.col("points").alias("dataPoints"))).alias("gauge"))
    d = by.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", metric.alias("m")))).alias("ms"))
    doc = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("service.name").alias("key"), value.alias("value"))).alias("attributes")).alias("resource"), F.array(F.struct(F.transform("ms", lambda x: x["m"]).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return d.select(F.col("user_id").cast("string").alias("doc"), F.to_json(doc).alias("json"))


@query("""SELECT 'service:' || CAST(user_id AS VARCHAR) AS entity, event_type AS name, CASE event_type WHEN 'view' THEN 'sum' ELSE 'gauge' END AS aggregation, count(*) AS n_points, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def otlp_metrics(spark, sf_dir):
    p = otlp.ingest(_otlp_documents(spark, sf_dir)).points
    return p.groupBy("entity", "name", "aggregation").agg(F.count("*").alias("n_points"), F.round(F.sum("v"), 4).alias("total"))


@query("""SELECT 'resource' AS signal, count(DISTINCT user_id) AS accepted, 0::BIGINT AS rejected FROM events UNION ALL SELECT 'span', 0, 0 UNION ALL SELECT 'metric_point', count(*), 0 FROM events UNION ALL SELECT 'log', 0, 0""")
def otlp_counters(spark, sf_dir):
    return otlp.ingest(_otlp_documents(spark, sf_dir)).counters()


# --- streaming ----------------------------------------------------------------


@query(f"SELECT event_type AS name, 'user:' || CAST(user_id % 10 AS VARCHAR) AS entity, count(*) AS n_points, {_t('min(ts)')} AS first_t, {_t('max(ts)')} AS last_t, max(value) AS peak FROM events GROUP BY 1, 2")
def streaming_series(spark, sf_dir):
    ev = incremental.stream_of(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.concat(F.lit("user:"), (F.col("user_id") % 10).cast("string")).alias("entity"), F.col("ts").alias("t"), F.col("value").alias("v"))
    done = incremental.run_to_end(incremental.series_prefix(ev), "complete", "series")
    return done.select("name", "entity", "n_points", _s("first_t").alias("first_t"), _s("last_t").alias("last_t"), "peak")


@query("""SELECT event_id % 50 AS slot, count(*) - 1 AS n_duplicates FROM events GROUP BY 1 HAVING count(*) > 1""")
def streaming_duplicates(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("slot"), "event_id")
    _, again = incremental.reject_duplicates(incremental.in_parts(ev, "slots", 3, "event_id"), ["slot"], "event_id", "slots")
    return again.groupBy("slot").agg(F.count("*").alias("n_duplicates"))


@query("SELECT event_id, 'metric_anomaly' AS evidence_kind, CASE replace(lower(trim(event_type)), '-', '_') WHEN 'signup' THEN 'change_event' ELSE lower(event_type) END AS signal, event_id % 2 = 0 AS is_safe FROM events")
def check_signals(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "signup", F.lit(" Code-Change ")).otherwise(F.upper("event_type"))
    safe = text.safe_id(F.when(F.col("event_id") % 2 == 0, F.lit("deploy-bad")).otherwise(F.lit("../x")))
    return ev.select("event_id", F.lit("metric_anomaly").alias("evidence_kind"), text.check_signal(raw).alias("signal"), safe.alias("is_safe"))


@query("SELECT doc_id, CAST(ceil(strlen(to_json({'text': text})) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_costs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", scores.token_cost(F.to_json(F.struct("text"))).alias("tokens"))
