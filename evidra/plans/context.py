"""Registered queries over entities, references, evidence links, ingest and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import scores, text
from evidra.operators import entities, evidence, quality, series, store, timeline
from evidra.plans.catalogue import _s, _t, query
from evidra.sources import adapters, otlp, replay
from evidra.sources.adapters import table
from evidra.streaming import incremental


def _one():
    return F.lit(adapters.INCIDENT).alias("incident_id")


# --- entities and relationships -----------------------------------------------


@query("SELECT 'resource:' || CAST(s_suppkey AS VARCHAR) AS resource_id, n_name AS service_name, count(*) OVER (PARTITION BY n_name) AS n_instances FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def instance_counts(spark, sf_dir):
    r = adapters.resources(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))
    return entities.instances(r).select("resource_id", "service_name", "n_instances")


def _ui_resources(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("svc"), (F.col("c_custkey") % 40).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "-ui").otherwise("-api"))
    return c.select(F.concat(F.lit("service:"), name).alias("entity"), name.alias("service_name"), F.col("c_custkey").alias("seq"))


@query("""WITH r AS (SELECT DISTINCT 'svc' || CAST(c_custkey % 40 AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN '-ui' ELSE '-api' END AS n FROM customer)
SELECT 'service:' || u.n AS src, 'service:' || a.n AS dst, 0.95::DOUBLE AS confidence FROM r u JOIN r a ON u.n LIKE '%-ui' AND a.n = replace(u.n, '-ui', '-api')""")
def named_pair_edges(spark, sf_dir):
    return entities.named_pairs(_ui_resources(spark, sf_dir)).select("src", "dst", "confidence")


@query("""SELECT 'service:' || split_part(r_name, ' ', 1) AS src, 'db:' || n_name AS dst, 'writes-to' AS type, 0.95::DOUBLE AS confidence, count(DISTINCT c_custkey) AS n_priors
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 3 = 0 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1, 2""")
def prior_trigger_edges(spark, sf_dir):
    # Earlier incidents on the database of a customer's nation; the trigger begins with a service, with something else, or is one word.
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey") % 3
    trigger = F.when(k == 0, F.concat(F.lit("service:"), F.substring_index("r_name", " ", 1), F.lit(" nightly "), "c_mktsegment")).when(k == 1, F.concat(F.lit("host:"), "r_name", F.lit(" restart"))).otherwise(F.concat(F.lit("service:"), F.substring_index("r_name", " ", 1)))
    priors = c.select(F.col("c_custkey").cast("string").alias("prior_id"), F.concat(F.lit("db:"), "n_name").alias("primary_entity"), trigger.alias("trigger"))
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("service_name"))
    return entities.trigger_edges(priors, names).select("src", "type", "dst", "confidence", F.size("evidence").cast("long").alias("n_priors"))


@query("""WITH g AS (SELECT event_id, unnest(['user:' || CAST(user_id AS VARCHAR), 'type:' || event_type, 'plain']) AS id FROM events WHERE event_type = 'error')
SELECT id, CASE WHEN id LIKE 'user:%' THEN 'tenant' ELSE 'route' END AS kind, count(*) AS n_gaps FROM g WHERE id <> 'plain' GROUP BY 1, 2""")
def gap_entities(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where("event_type = 'error'")
    g = ev.select(F.col("event_id").alias("gap_id"), F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("type:"), "event_type"), F.lit("plain")).alias("entities"))
    return entities.gap_entities(g).groupBy("id", "kind").agg(F.count("*").alias("n_gaps"))


@query("""WITH s AS (SELECT conv_id, turn, 'service:' || role AS entity, conv_id % 4 AS shard, CASE WHEN turn % 2 = 0 THEN conv_id % 7 END AS tenant FROM conversations),
e AS (SELECT entity AS src, 'fans-out-to' AS type, 'shard:' || CAST(shard AS VARCHAR) AS dst FROM s UNION ALL SELECT 'tenant:' || CAST(tenant AS VARCHAR), 'calls', entity FROM s WHERE tenant IS NOT NULL)
SELECT src, type, dst, 0.9::DOUBLE AS confidence FROM e GROUP BY ALL""")
def logical_edges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = lambda kind, n: F.concat(F.lit(f"{kind}:"), (F.col("conv_id") % n).cast("string"))
    spans = c.select(F.concat(F.lit("service:"), "role").alias("entity"), name("shard", 4).alias("shard"), F.when(F.col("turn") % 2 == 0, name("tenant", 7)).alias("tenant"), F.col("turn").alias("span_id"))
    return entities.logical_edges(spans).select("src", "type", "dst", "confidence")


@query("""WITH d AS (SELECT c.conv_id, c.turn, 'service:' || r.role AS src, CASE c.conv_id % 3 WHEN 0 THEN 'infra:kv' ELSE 'db:answers' END AS dst, c.turn % 5 = 3 AS w, c.turn % 3 = 1 AS beside
  FROM conversations c JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn - 1 AND r.role <> 'assistant' WHERE c.role = 'assistant'),
e AS (SELECT src, CASE WHEN w THEN 'writes-to' ELSE 'reads-from' END AS type, dst, conv_id * 1000 + turn AS seq, CASE WHEN w THEN 0.96 WHEN dst = 'infra:kv' THEN 0.97 WHEN beside THEN 0.96 ELSE 0.97 END AS sure, CASE WHEN dst = 'db:answers' AND beside THEN 'cache-miss-fallback' END AS role FROM d)
SELECT src, type, dst, max(sure)::DOUBLE AS confidence, arg_min(coalesce(role, ''), seq) AS role, count(*) AS n_evidence FROM e GROUP BY 1, 2, 3""")
def access_edges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    dep = F.when(F.col("role") == "assistant", "dependency").otherwise("service")
    store = F.when(F.col("conv_id") % 3 == 0, "infra:kv").otherwise("db:answers")
    s = c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"), dep.alias("endpoint"), F.when(dep == "service", F.concat(F.lit("service:"), "role")).otherwise(store).alias("entity"), F.when(F.col("turn") % 5 == 3, "INSERT INTO t").otherwise("SELECT 1").alias("statement"), F.concat_ws("/", "conv_id", "turn").alias("ref"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    up = s.where("endpoint = 'dependency'").select("trace_id", "span_id", "parent_id").join(s.where("endpoint = 'service'").select("trace_id", F.col("span_id").alias("parent_id"), F.col("entity").alias("ancestor")), ["trace_id", "parent_id"]).select("trace_id", "span_id", "ancestor")
    e = entities.access_edges(s, up, s.where("span_id % 3 = 1"))
    return e.select("src", "type", "dst", F.round("confidence", 2).alias("confidence"), F.coalesce("attributes", F.lit("")).alias("role"), F.size("evidence").cast("long").alias("n_evidence"))


@query("SELECT s_nationkey AS k, CASE count(DISTINCT s_suppkey % 3) WHEN 1 THEN '\"' || CAST(min(s_suppkey % 3) AS VARCHAR) || '\"' ELSE '[\"' || string_agg(DISTINCT CAST(s_suppkey % 3 AS VARCHAR), '\",\"' ORDER BY CAST(s_suppkey % 3 AS VARCHAR)) || '\"]' END AS value FROM supplier GROUP BY 1")
def discriminator_values(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.groupBy(F.col("s_nationkey").alias("k")).agg(entities.discriminator((F.col("s_suppkey") % 3).cast("string")).alias("value"))


# --- sets, series, store ------------------------------------------------------


@query("""WITH u AS (SELECT user_id, list(DISTINCT event_type) AS a FROM events GROUP BY 1)
SELECT user_id, len(list_filter(a, lambda x: NOT list_contains(['click', 'view', 'purchase', 'signup'], x))) = 0 AS subset, list_sort(a) = ['click', 'error', 'purchase', 'signup', 'view'] AS same FROM u""")
def set_relations(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("a"))
    some, every = F.array(*map(F.lit, ("click", "view", "purchase", "signup"))), F.array(*map(F.lit, ("view", "click", "purchase", "signup", "error", "view")))
    return u.select("user_id", quality.is_subset(F.col("a"), some).alias("subset"), quality.same_set(F.col("a"), every).alias("same"))


@query("""WITH p AS (SELECT o_custkey, list(o_orderkey % 10 ORDER BY o_orderdate, o_orderkey) AS ps FROM orders GROUP BY 1)
SELECT o_custkey, list_sort(ps) = ps AND len(list_distinct(ps)) = len(ps) AS ascends FROM p""")
def ordered_subsequence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"] % 10).alias("ps"))
    return o.select("o_custkey", quality.in_order(F.col("ps")).alias("ascends"))


@query("SELECT 'user:' || CAST(user_id % 10 AS VARCHAR) AS entity, list_sort(list(DISTINCT event_type)) AS names FROM events GROUP BY 1")
def metric_names_by_entity(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(_one(), F.col("event_type").alias("name"), F.concat(F.lit("user:"), (F.col("user_id") % 10).cast("string")).alias("entity"))
    return series.metric_names(ev).select("entity", "names")


@query(f"SELECT 'user:' || CAST(user_id % 10 AS VARCHAR) AS entity, event_type AS name, min(value) AS trough, {_t('arg_min(ts, (value, ts))')} AS trough_at FROM events GROUP BY 1, 2")
def trough_time(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(_one(), F.col("event_type").alias("name"), F.concat(F.lit("user:"), (F.col("user_id") % 10).cast("string")).alias("entity"), F.col("ts").alias("t"), F.col("value").alias("v"))
    return series.trough_times(ev).select("entity", "name", "trough", _s("trough_t").alias("trough_at"))


def _records(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "metric_series").when(F.col("event_type") == "error", "log").when(F.col("event_type") == "signup", "change").otherwise("anomaly_window")
    key = F.when(kind == "metric_series", F.concat(F.lit("m"), (F.col("user_id") % 9).cast("string"))).otherwise(F.concat(F.lit("k"), (F.col("event_id") % 700).cast("string")))
    return ev.select(_one(), F.col("event_id").alias("seq"), kind.alias("kind"), key.alias("key"), F.struct(F.col("ts").alias("start"), F.col("ts").alias("end")).alias("win"), F.array(F.concat(F.lit("user:"), (F.col("user_id") % 3).cast("string"))).alias("entities"))


_REC = """rec AS (SELECT event_id AS seq, ts, user_id % 3 AS e, CASE event_type WHEN 'view' THEN 'metric_series' WHEN 'error' THEN 'log' WHEN 'signup' THEN 'change' ELSE 'anomaly_window' END AS kind,
  CASE WHEN event_type = 'view' THEN 'm' || CAST(user_id % 9 AS VARCHAR) ELSE 'k' || CAST(event_id % 700 AS VARCHAR) END AS key FROM events)"""


@query(f"WITH {_REC} SELECT kind, count(*) AS n FROM rec WHERE kind <> 'anomaly_window' GROUP BY 1")
def raw_records(spark, sf_dir):
    return store.raw_only(_records(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_REC}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY seq) AS n FROM rec)
SELECT kind, key, min(seq) AS seq, {_t('min(ts)')} AS first_t, {_t('max(ts)')} AS last_t, count(DISTINCT e) AS n_entities FROM r WHERE kind = 'metric_series' OR n = 1 GROUP BY 1, 2""")
def ingest_upsert(spark, sf_dir):
    r = _records(spark, sf_dir)
    kept, _ = store.ingest(r.where("seq % 2 = 0 and seq < 0"), r)
    return kept.select("kind", "key", "seq", _s("win.start").alias("first_t"), _s("win.end").alias("last_t"), F.size("entities").cast("long").alias("n_entities"))


@query(f"WITH {_REC}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY seq) AS n FROM rec WHERE kind <> 'metric_series') SELECT kind, count(*) AS n_refused FROM r WHERE n > 1 GROUP BY 1")
def ingest_refused(spark, sf_dir):
    r = _records(spark, sf_dir)
    half = F.col("seq") % 2 == 0
    first = store.ingest(r.limit(0), r)[0]  # every key that is free
    _, again = store.ingest(first, r.where(half))
    _, more = store.ingest(first, r.where(~half))
    # Each row of the second passes is refused; the first of a key was once taken.
    return again.unionByName(more).groupBy("kind", "key").agg((F.count("*") - 1).alias("n")).groupBy("kind").agg(F.sum("n").alias("n_refused")).where("n_refused > 0")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, 'service:' || o_orderstatus AS src, 'calls' AS type, 'db:' || o_orderpriority AS dst FROM orders WHERE o_orderkey % 4 < 2")
def stored_relationships(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    good = F.to_json(F.struct(F.concat(F.lit("service:"), "o_orderstatus").alias("src"), F.lit("calls").alias("type"), F.concat(F.lit("db:"), "o_orderpriority").alias("dst"), F.lit(0.9).alias("confidence")))
    payload = F.when(F.col("o_orderkey") % 4 < 2, good).when(F.col("o_orderkey") % 4 == 2, '{"src": "x"}').otherwise("no json")
    r = o.select(F.col("o_orderkey").cast("string").alias("key"), F.lit("relationship").alias("kind"), payload.alias("payload"))
    return store.stored_edges(r).select("key", "src", "type", "dst")


@query("""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY date_trunc('second', ts), event_id) - 1 AS sequence, 'k' || CAST(event_id % 900 AS VARCHAR) AS key FROM events),
r AS (SELECT DISTINCT 'k' || CAST(user_id % 1000 AS VARCHAR) AS ref FROM events) SELECT ref, min(sequence)::INTEGER AS available_from FROM r LEFT JOIN p ON key = ref GROUP BY 1""")
def refs_available(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    plan = replay.plan(ev.select(_one(), F.col("event_id").alias("input_order"), F.lit("event").alias("kind"), F.concat(F.lit("k"), (F.col("event_id") % 900).cast("string")).alias("key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")))
    refs = ev.select(_one(), F.concat(F.lit("k"), (F.col("user_id") % 1000).cast("string")).alias("ref")).distinct()
    return store.available_from(refs, plan).select("ref", "available_from")


@query("""WITH e AS (SELECT user_id % 5 AS incident_id, event_type AS kind, event_id FROM events), r AS (SELECT DISTINCT user_id % 5 AS incident_id, event_id * 2 AS ref FROM events),
o AS (SELECT r.incident_id, count(*) AS n_open FROM r LEFT JOIN e ON e.incident_id = r.incident_id AND e.event_id = r.ref WHERE e.event_id IS NULL GROUP BY 1)
SELECT e.incident_id, kind, count(*) AS n_events, coalesce(any_value(n_open), 0) AS n_open FROM e LEFT JOIN o USING (incident_id) GROUP BY 1, 2""")
def replay_audit(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    e = ev.select((F.col("user_id") % 5).alias("incident_id"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("key"))
    refs = ev.select((F.col("user_id") % 5).alias("incident_id"), (F.col("event_id") * 2).cast("string").alias("ref")).distinct()
    return replay.audit(e, refs)


@query("SELECT event_id, regexp_replace(trim('  ' || event_type || '   of  ' || CAST(user_id AS VARCHAR) || ' '), ' +', ' ', 'g') AS shown, list_distinct(list_filter(['user:' || CAST(user_id AS VARCHAR), CASE WHEN event_id % 2 = 0 THEN 'type:' || event_type END, 'user:' || CAST(event_id % 50 AS VARCHAR)], lambda x: x IS NOT NULL)).list_sort() AS entities FROM events")
def entities_of_records(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    own, other = F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("user:"), (F.col("event_id") % 50).cast("string"))
    es = store.entity_set(F.array(own, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("type:"), "event_type"))), F.array(other))
    return ev.select("event_id", text.collapse_space(F.concat(F.lit("  "), "event_type", F.lit("   of  "), F.col("user_id").cast("string"), F.lit(" "))).alias("shown"), F.array_sort(es).alias("entities"))


@query("SELECT event_type AS severity, count(*) AS n, round(CASE WHEN event_type = 'error' THEN 0.82 ELSE 0.55 END + CASE WHEN count(*) >= 10 THEN 0.08 WHEN count(*) >= 3 THEN 0.04 ELSE 0 END, 2)::DOUBLE AS strength FROM events GROUP BY 1")
def pattern_strengths(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("severity")).agg(F.count("*").alias("n"))
    return g.select("severity", "n", F.round(scores.pattern_strength(F.upper("severity"), F.col("n")), 2).alias("strength"))


@query("""WITH p AS (SELECT 'user:' || CAST(c_custkey % 5 AS VARCHAR) AS entity, CASE c_custkey % 3 WHEN 0 THEN 'slow: latency' WHEN 1 THEN 'many errors' ELSE 'else' END AS symptom, CAST(c_custkey AS VARCHAR) AS prior_id FROM customer),
w AS (SELECT DISTINCT 'user:' || CAST(user_id % 9 AS VARCHAR) AS entity, CASE event_type WHEN 'error' THEN 'http.error_rate' ELSE 'http.duration' END AS name FROM events)
SELECT prior_id, entity, name FROM w JOIN p USING (entity) WHERE (name = 'http.duration' AND symptom LIKE '%latency%') OR (name = 'http.error_rate' AND symptom LIKE '%error%')""")
def recurring_signatures(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    user = lambda k: F.concat(F.lit("user:"), k.cast("string"))
    p = c.select(_one(), F.col("c_custkey").cast("string").alias("prior_id"), user(F.col("c_custkey") % 5).alias("primary_entity"), F.when(F.col("c_custkey") % 3 == 0, "Slow: latency").when(F.col("c_custkey") % 3 == 1, "many errors").otherwise("else").alias("symptom"))
    w = table(spark, sf_dir, "events").select(_one(), user(F.col("user_id") % 9).alias("entity"), F.when(F.col("event_type") == "error", "http.error_rate").otherwise("http.duration").alias("name")).distinct()
    return timeline.recurring(w, p).select("prior_id", "entity", "name")


@query("""WITH c AS (SELECT DISTINCT c_custkey AS k, c_mktsegment AS capability FROM customer), e AS (SELECT o_custkey AS k, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END AS capability FROM orders)
SELECT e.capability, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_kept, count(*) FILTER (WHERE c.k IS NULL) AS n_removed FROM e LEFT JOIN c ON c.k = e.k AND c.capability = e.capability GROUP BY 1""")
def capability_projection(spark, sf_dir):
    declared = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("incident_id"), F.col("c_mktsegment").alias("capability"))
    rule = F.when(F.col("o_orderkey") % 3 == 0, "BUILDING").when(F.col("o_orderkey") % 3 == 1, "MACHINERY").otherwise("FURNITURE")
    kept, removed = quality.within_capabilities(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident_id"), rule.alias("capability"), "o_orderkey"), declared)
    n = kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False)))
    return n.groupBy("capability").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_removed"))


# --- evidence links -----------------------------------------------------------


def _found(spark, sf_dir):
    """Suspects: an order each for a pod or service, with its lines as candidates."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    entity = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "pod:").otherwise("service:"), (F.col("o_custkey") % 20).cast("string"))
    ids = li.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("cand-"), F.col("l_linenumber").cast("string")).alias("c")).groupBy("o_orderkey").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    j = o.join(ids, "o_orderkey")
    return j.select(F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"), entity.alias("entity"), F.lit(0.5).alias("support"), F.lit(0.25).alias("counter"), F.col("cs").alias("supporting"), F.slice("cs", 1, 1).alias("counters"), F.array(F.lit("seen")).alias("reasons"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem WHERE l_quantity < 25 GROUP BY 1, 2), l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS k, (SELECT min(l_linenumber) FROM lineitem x WHERE x.l_orderkey = q.l_orderkey) AS least FROM q),
s AS (SELECT l_orderkey, list_sort(list('ev-' || CAST(k AS VARCHAR))) AS supporting, list('ev-' || CAST(k AS VARCHAR)) FILTER (WHERE l_linenumber = least) AS counters FROM l GROUP BY 1)
SELECT 'inc-' || CAST(o_orderkey AS VARCHAR) AS incident_id, coalesce(supporting, []::VARCHAR[]) AS supporting, coalesce(counters, []::VARCHAR[]) AS counters FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey)""")
def cause_links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity < 25").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    li = li.select(F.concat(F.lit("inc-"), F.col("l_orderkey").cast("string")).alias("incident_id"), F.concat(F.lit("cand-"), F.col("l_linenumber").cast("string")).alias("candidate_id"), "l_quantity", "l_linenumber")
    chosen = store.numbered(li, ["incident_id"], ["l_quantity", "l_linenumber"], "id", "ev-%d")
    return evidence.linked(_found(spark, sf_dir), chosen).select("incident_id", F.array_sort("supporting").alias("supporting"), "counters")


_POD_EDGES = "o_orderkey % 2 = 0 AND o_custkey % 20 < 15"


@query(f"""WITH f AS (SELECT 'inc-' || CAST(o_orderkey AS VARCHAR) AS incident_id, o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'pod:' ELSE 'service:' END || CAST(o_custkey % 20 AS VARCHAR) AS entity FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
SELECT incident_id, entity, 0.5::DOUBLE AS support, 0.25::DOUBLE AS counter, false AS rolled FROM f UNION ALL SELECT incident_id, 'service:' || CAST(o_custkey % 20 AS VARCHAR), 0.4, 0.2, true FROM f WHERE {_POD_EDGES}""")
def runtime_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(_POD_EDGES)
    k = (F.col("o_custkey") % 20).cast("string")
    edges = o.select(F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"), F.concat(F.lit("service:"), k).alias("src"), F.lit("deployed-as").alias("type"), F.concat(F.lit("pod:"), k).alias("dst"))
    return evidence.roll_up(_found(spark, sf_dir), edges).select("incident_id", "entity", "support", "counter", F.array_contains("reasons", "runtime_child_anomaly").alias("rolled"))


@query("""SELECT 'inc-' || CAST(o_custkey % 30 AS VARCHAR) AS incident_id, o_orderkey AS candidate, CASE WHEN o_custkey % 20 < 15 THEN 'service:' || CAST(o_custkey % 20 % 4 AS VARCHAR) ELSE 'pod:' || CAST(o_custkey % 20 AS VARCHAR) END AS entity FROM orders""")
def canonical_suspects(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    inc = F.concat(F.lit("inc-"), (F.col("o_custkey") % 30).cast("string"))
    pod = F.concat(F.lit("pod:"), (F.col("o_custkey") % 20).cast("string"))
    cand = o.select(inc.alias("incident_id"), F.col("o_orderkey").alias("candidate_id"), F.array(F.concat(pod, F.when(F.col("o_orderkey") % 2 == 0, "(aggregate)").otherwise("")), pod).alias("entities"))
    edges = o.where("o_custkey % 20 < 15").select(inc.alias("incident_id"), F.concat(F.lit("service:"), (F.col("o_custkey") % 20 % 4).cast("string")).alias("src"), F.lit("deployed-as").alias("type"), pod.alias("dst")).distinct()
    return evidence.canonical_entities(cand, edges).select("incident_id", F.col("candidate_id").alias("candidate"), F.explode("entities").alias("entity"))


@query("""WITH k AS (SELECT DISTINCT 'change:' || CAST(event_id AS VARCHAR) AS key FROM events WHERE event_type = 'signup')
SELECT event_id, list_filter(['gap:' || CAST(event_id AS VARCHAR), CASE WHEN k.key IS NOT NULL THEN k.key END], lambda x: x IS NOT NULL) AS refs, CASE WHEN k.key IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS quality
FROM events LEFT JOIN k ON k.key = 'change:' || CAST(event_id - 1 AS VARCHAR) WHERE event_type = 'error'""")
def gap_causes(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    gaps = ev.where("event_type = 'error'").select(_one(), F.col("event_id").alias("candidate_id"), F.array(F.concat(F.lit("gap:"), F.col("event_id").cast("string")), F.concat(F.lit("change:"), (F.col("event_id") - 1).cast("string"))).alias("refs"))
    known = ev.where("event_type = 'signup'").select(_one(), F.concat(F.lit("change:"), F.col("event_id").cast("string")).alias("key")).unionByName(gaps.select("incident_id", F.get("refs", F.lit(0)).alias("key")))
    r = evidence.resolvable(gaps.select("incident_id", "candidate_id", F.posexplode("refs").alias("_p", "key")), known)
    return r.select(F.col("candidate_id").alias("event_id"), "refs", (F.col("n_found") / F.col("n_refs")).alias("quality"))


# --- ingest -------------------------------------------------------------------


def _otlp_traces(spark, sf_dir):
    """OTLP span and log documents, one per user; every seventh span has a bad id, every eleventh log no time."""
    ev = table(spark, sf_dir, "events")
    nano = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    trace = F.lpad(F.hex("user_id"), 32, "0")
    span = F.struct(
        trace.alias("traceId"), F.when(F.col("event_id") % 7 == 0, "xyz").otherwise(F.lpad(F.hex("event_id"), 16, "0")).alias("spanId"), F.col("event_type").alias("name"), nano.alias("startTimeUnixNano"), nano.alias("endTimeUnixNano"),
        F.struct(F.when(F.col("event_type") == "error", "2").otherwise("1").alias("code")).alias("status"),
    )
    log = F.struct(F.when(F.col("event_id") % 11 != 0, nano).alias("timeUnixNano"), F.upper("event_type").alias("severityText"), F.struct(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("stringValue")).alias("body"))
    by = ev.groupBy("user_id").agg(F.collect_list(span).alias("spans"), F.collect_list(log).alias("logs"))
    name = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("user_id").cast("string").alias("stringValue")).alias("value"))).alias("attributes"))
    doc = F.struct(F.array(F.struct(name.alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"), F.array(F.struct(name.alias("resource"), F.array(F.struct(F.col("logs").alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return by.select(F.col("user_id").cast("string").alias("doc"), F.to_json(doc).alias("json"))


@query(f"""SELECT lpad(lower(to_hex(user_id::BIGINT)), 32, '0') AS trace_id, lpad(lower(to_hex(event_id::BIGINT)), 16, '0') AS span_id, event_type AS name, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'OK' END AS status, 'service:' || CAST(user_id AS VARCHAR) AS entity, {_t('ts')} AS start_at
FROM events WHERE event_id % 7 <> 0""")
def otlp_spans(spark, sf_dir):
    s = otlp.ingest(_otlp_traces(spark, sf_dir)).spans
    return s.select("trace_id", "span_id", "name", "status", "entity", _s("start").alias("start_at"))


@query(f"SELECT 'service:' || CAST(user_id AS VARCHAR) AS entity, upper(event_type) AS severity, 'event ' || CAST(event_id AS VARCHAR) AS body, {_t('ts')} AS at_time FROM events WHERE event_id % 11 <> 0")
def otlp_logs(spark, sf_dir):
    g = otlp.ingest(_otlp_traces(spark, sf_dir)).logs
    return g.select("entity", "severity", "body", _s("t").alias("at_time"))


@query("""SELECT 'resource' AS signal, count(DISTINCT user_id) AS accepted, 0::BIGINT AS rejected FROM events UNION ALL SELECT 'span', count_if(event_id % 7 <> 0)::BIGINT, count_if(event_id % 7 = 0)::BIGINT FROM events
UNION ALL SELECT 'metric_point', 0, 0 UNION ALL SELECT 'log', count_if(event_id % 11 <> 0)::BIGINT, count_if(event_id % 11 = 0)::BIGINT FROM events""")
def otlp_span_counters(spark, sf_dir):
    return otlp.ingest(_otlp_traces(spark, sf_dir)).counters()


# --- streams ------------------------------------------------------------------


@query("""WITH s AS (SELECT event_id % 50 AS slot, event_id FROM events) SELECT slot, event_id = min(event_id) OVER (PARTITION BY slot) AS is_new, event_id FROM s""")
def streaming_first_of_key(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("slot"), "event_id")
    fresh, again = incremental.reject_duplicates(incremental.in_parts(ev, "events", 3, "event_id"), ["slot"], "event_id", "duplicates")
    return fresh.withColumn("is_new", F.lit(True)).unionByName(again.withColumn("is_new", F.lit(False)))


@query(f"SELECT {_t('time_bucket(INTERVAL 6 HOURS, ts)')} AS start_at, event_type AS name, count(*) AS n_points, round(avg(value), 6) AS v FROM events GROUP BY 1, 2")
def streaming_windows(spark, sf_dir):
    ev = incremental.stream_of(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit("all").alias("entity"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("v"))
    w = incremental.run_to_end(incremental.windowed(ev, "6 hours", "1 hour"), "complete", "windows")
    return w.select(_s("window.start").alias("start_at"), "name", "n_points", F.round("v", 6).alias("v"))


@query(f"""WITH e AS (SELECT event_type AS name, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT name, ts, sum(fresh) OVER (PARTITION BY name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT name, {_t('min(ts)')} AS first_t, count(*) AS n_points FROM s GROUP BY name, k""")
def streaming_sessions(spark, sf_dir):
    ev = incremental.stream_of(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit("all").alias("entity"), F.col("ts").cast("timestamp").alias("t"))
    w = incremental.run_to_end(incremental.silences(ev, "30 minutes", "1 hour"), "complete", "sessions")
    return w.select("name", _s("session_window.start").alias("first_t"), "n_points")
