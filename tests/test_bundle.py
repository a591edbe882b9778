"""The whole plan over two invented incidents."""

import json

import pytest
from pyspark.sql import functions as F

from evidra.plans import bundle
from evidra.sources import incidents as src


def _points(base, bad, start=0, n=10, onset=5):
    return [{"t": f"2026-03-01T10:{start + k:02d}:00Z", "v": bad if k >= onset else base} for k in range(n)]


def case(name):
    bad = "2026-03-01T10:05:00Z"
    return {
        "resources": [{"id": "r-shop", "attributes": {"service.name": "shop", "k8s.pod.name": "shop-1"}}, {"id": "r-pay", "attributes": {"service.name": "pay"}}, {"id": "r-db", "attributes": {"service.name": "ledger", "db.system": "postgresql"}}],
        "traces": [{"trace_id": "t-1", "exemplar_of": "failure", "spans": [
            {"span_id": "a", "parent_id": None, "resource": "r-shop", "name": "POST /buy", "kind": "SERVER", "start": bad, "end": bad, "status": "ERROR", "attributes": {}},
            {"span_id": "b", "parent_id": "a", "resource": "r-pay", "name": "pay", "kind": "SERVER", "start": bad, "end": bad, "status": "ERROR", "attributes": {"peer.service": "bank"}},
            {"span_id": "c", "parent_id": "b", "resource": "r-db", "name": "select", "kind": "CLIENT", "start": bad, "end": bad, "status": "OK", "attributes": {"db.statement": "SELECT 1"}}]}],
        "metrics": [{"name": "http.server.error_rate", "entity": "service:shop", "unit": "ratio", "points": _points(0.01, 0.4)}, {"name": "http.server.error_rate", "entity": "service:pay", "unit": "ratio", "points": _points(0.01, 0.5, onset=4)}, {"name": "db.query.duration_p95_ms", "entity": "db:ledger", "unit": "ms", "points": _points(20.0, 20.5)}],
        "logs": [{"id": f"log-{k}", "t": f"2026-03-01T10:0{5 + k}:00Z", "entity": "service:pay", "severity": "ERROR", "body": f"charge failed, retrying attempt {k}/5 ({k})", "attributes": {}} for k in range(3)],
        "changes": [{"id": "change:1", "t": "2026-03-01T10:03:00Z", "kind": "deploy", "entity": "service:pay", "summary": "pay 2.0", "attributes": {}}, {"id": "change:2", "t": "2026-03-01T10:08:00Z", "kind": "deploy", "entity": "service:blog", "summary": "blog", "attributes": {}}],
        "prior_incidents": None,
        "telemetry_gaps": [{"id": "telemetry_gap:1", "start": "2026-03-01T10:02:00Z", "end": "2026-03-01T10:04:00Z", "affected_entities": ["service:shop", "service:pay"], "affected_signals": ["trace"], "cause": "change:1", "note": ""}] if name == "two" else None,
    }


def incidents(spark):
    names = ["one", "two"]
    manifests = spark.createDataFrame([json.dumps({"id": n, "failure_class": "deploy", "question": "why", "capabilities": [], "time_window": {"start": "2026-03-01T10:00:00Z", "end": "2026-03-01T10:10:00Z"}}) for n in names], "string")
    inputs = spark.createDataFrame([(n, json.dumps(case(n))) for n in names], "incident_id string, j string")
    m = manifests.select(F.from_json("value", src.MANIFEST).alias("m")).select("m.*")
    d = inputs.select("incident_id", F.from_json("j", src.INPUT).alias("d")).select("incident_id", "d.*")
    return src.typed(m, d).persist()


@pytest.fixture(scope="module")
def answer(spark):
    i = incidents(spark)
    d = bundle.derive(i)
    return i, d, bundle.get_evidence_bundle(i, bundle.EvidenceQuery(max_items=5, max_tokens=600), d)


def test_windows_and_edges(answer):
    _, d, _ = answer
    w = {(r.incident_id, r.entity) for r in d.windows.collect()}
    assert w == {(n, e) for n in ("one", "two") for e in ("service:shop", "service:pay")}
    e = {(r.src, r.type, r.dst) for r in d.edges.where("incident_id = 'one'").collect()}
    assert {("service:shop", "calls", "service:pay"), ("service:pay", "reads-from", "db:ledger"), ("service:pay", "depends-on", "external-api:bank"), ("service:shop", "deployed-as", "pod:shop-1")} <= e


def test_late_change_is_no_cause(answer):
    _, d, _ = answer
    m = {r.source_ref: r.marker for r in d.timeline.where("incident_id = 'one'").collect()}
    assert m["change:1"] == "change" and m["change:2"] == "non-causal-change"


def test_budget_and_ids(answer):
    _, _, b = answer
    for n in ("one", "two"):
        items = b.items.where(F.col("incident_id") == n).collect()
        assert 0 < len(items) <= 5 and sum(r.token_cost for r in items) <= 600
        assert sorted(r.id for r in items) == sorted(f"ev-{k + 1}" for k in range(len(items)))
    assert {r.reason for r in b.dropped.collect()} <= {"max_items", "max_tokens", "lower_priority"}


def test_causes_and_checks(answer):
    _, _, b = answer
    causes = {(r.incident_id, r.entity): r for r in b.causes.collect()}
    assert ("two", "under-determined") in causes and ("one", "under-determined") not in causes
    assert all(0 <= r.score <= 1 for r in causes.values())
    assert {"error_rate_spike", "deploy_origin"} <= set(causes[("one", "service:pay")].reasons)
    assert all(r.n <= 3 for r in b.checks.groupBy("incident_id").agg(F.count("*").alias("n")).collect()) and b.checks.count() > 0


def test_required_counter_evidence(answer):
    i, d, _ = answer
    b = bundle.get_evidence_bundle(i, bundle.EvidenceQuery(max_items=1, max_tokens=600, require_counter_evidence=True), d)
    assert {r.grp for r in b.items.collect()} == {4}


def test_bad_query():
    with pytest.raises(bundle.QueryError):
        bundle.EvidenceQuery(max_items=0).checked()
    with pytest.raises(bundle.QueryError):
        bundle.EvidenceQuery(max_tokens=10, reserve_tokens=10).checked()
    for bad in ({"scenario_id": "../x"}, {"start": "2026-03-01T10:00:00Z"}, {"start": "2026-03-01T11:00:00Z", "end": "2026-03-01T10:00:00Z"}, {"entities": (" ",)}, {"freshness": "old"}, {"question": " "}, {"start": "soon", "end": "late"}):
        with pytest.raises(bundle.QueryError) as e:
            bundle.EvidenceQuery(**bad).checked()
        assert e.value.code == "invalid_arguments"


def test_scenario_window_entities(answer):
    i, d, _ = answer
    ask = lambda **q: bundle.get_evidence_bundle(i, bundle.EvidenceQuery(**q), d)
    b = ask(scenario_id="two", start="2026-03-01T10:00:00Z", end="2026-03-01T10:10:00Z", entities=("service:pay",))
    assert {r.incident_id for r in b.items.collect()} == {"two"} == {r.incident_id for r in b.causes.collect()}
    wrong = [({"scenario_id": "none"}, "not_found", "none"), ({"entities": ("service:none",)}, "unsatisfied_requirement", "hot_context_entities"), ({"start": "2020-01-01T00:00:00Z", "end": "2020-01-02T00:00:00Z"}, "unsatisfied_requirement", "hot_context_time_window"), ({"max_items": 9, "min_counter_evidence_items": 9}, "unsatisfied_requirement", "counter_evidence")]
    for q, code, word in wrong:
        with pytest.raises(bundle.QueryError) as e:
            ask(**q)
        assert e.value.code == code and word in str(e.value)


def test_links_name_items(answer):
    _, _, b = answer
    items = {}
    for r in b.items.collect():
        items.setdefault(r.incident_id, set()).add(r.id)
    causes = b.causes.collect()
    assert all(set(r.supporting) | set(r.counters) <= items[r.incident_id] for r in causes) and any(r.supporting for r in causes)
    assert all("cand-" not in r.action for r in b.checks.collect())


def test_write_back(answer):
    i, d, b = answer
    records, refused = bundle.written_back(i, d, b)
    assert refused.count() == 0
    keys = {(r.incident_id, r.key) for r in records.collect()}
    assert all((r.incident_id, ref) in keys for r in b.items.collect() for ref in r.refs)
    again = bundle.store.insert_unique(records, records.where("seq = 1"), "incident_id", "kind", "key")[1]
    assert again.count() == records.where("seq = 1").count() > 20
    assert bundle.derived_for(i, "detect_anomalies", d).count() == d.windows.count()
    with pytest.raises(bundle.QueryError):
        bundle.derived_for(i, "guess")


def test_gap_names_its_cause(answer):
    i, d, _ = answer
    gap = {r.incident_id: r for r in bundle.candidates(i, d).where("source = 'missing_data'").collect()}["two"]
    assert gap.refs == ["telemetry_gap:1", "change:1"] and gap.entities == ["service:shop", "service:pay"]


def test_read_files_and_issues(spark, tmp_path):
    manifest = {"id": "one", "failure_class": "deploy", "question": "why", "capabilities": [], "time_window": {"start": "2026-03-01T10:00:00Z", "end": "2026-03-01T10:10:00Z"}}
    lacking = case("one")
    lacking["logs"].append({"id": "log-9", "t": None, "entity": "service:pay", "severity": "INFO", "body": None, "attributes": {}})
    lacking["logs"].append({"id": "log-10", "t": "soon", "entity": "service:pay", "severity": "INFO", "body": "x", "attributes": {}})
    lacking["traces"][0]["spans"].append({"span_id": None, "resource": "r-pay"})
    lacking["traces"].append({"trace_id": "t-2", "spans": [{"span_id": "z", "name": "no resource"}]})
    lacking["metrics"].append({"name": "queue.depth", "entity": None, "points": []})
    lacking["metrics"][0]["points"].append({"t": "2026-03-01T10:30:00Z", "v": None})
    for name, scenario, given in (("one", json.dumps(manifest), json.dumps(lacking)), ("bad", json.dumps(manifest | {"id": "bad"}), "{no json"), ("worse", "[", json.dumps(case("worse")))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "scenario.json").write_text(scenario)
        (tmp_path / name / "input.json").write_text(given)
    i = src.read(spark, str(tmp_path))
    assert {r.incident_id for r in i.logs.collect()} == {"one"} and i.logs.count() == 3
    got = {(r.incident_id, r.place, r.problem) for r in src.issues(spark, str(tmp_path)).collect()}
    assert got == {("one", "logs[3]", "t"), ("one", "logs[3]", "body"), ("one", "logs[4]", "t"), ("one", "traces[0].spans[3]", "span_id"), ("one", "traces[1].spans[0]", "resource"), ("one", "metrics[3]", "entity"), ("one", "metrics[0].points[10]", "v"), ("bad", "input.json", "malformed"), ("worse", "scenario.json", "malformed")}


def test_children_roll_up_and_flows(spark):
    found = spark.createDataFrame([("i", "pod:a", 1.0, 0.5, ["c1"], ["c2"], ["oom_logs"]), ("i", "service:b", 0.5, 0.0, ["c3"], [], ["x"])], bundle.evidence.SUSPECT)
    edges = spark.createDataFrame([("i", "service:a", "runs-on", "pod:a", None)], "incident_id string, src string, type string, dst string, attributes string")
    got = {r.entity: r for r in bundle.evidence.roll_up(found, edges).collect()}
    assert (got["service:a"].support, got["service:a"].counter, got["service:a"].reasons) == (0.8, 0.4, ["oom_logs", "runtime_child_anomaly"]) and got["pod:a"].support == 1.0
    suspect = lambda s, x=0.0, *why: {"support": s, "counter": x, "supporting": ["c"], "counters": [], "reasons": set(why)}
    fold = bundle.evidence.fold_edges
    edge = lambda kind, role=None: [{"src": "a", "type": kind, "dst": "b", "attributes": role}]
    t = fold({"b": suspect(1.0)}, edge("retries"))
    assert t["b"]["counter"] == 0.9 and abs(t["b"]["support"] - 0.45) < 1e-9 and t["a"]["support"] == 0.55 and "retry_fanout_trace" in t["a"]["reasons"]
    t = fold({"b": suspect(1.0)}, edge("reads-from", "cache-miss-fallback"))
    assert t["b"]["counter"] == 0.8 and t["b"]["support"] == 0.65 and "a" not in t
    t = fold({"a": suspect(1.0)}, edge("depends-on"))
    assert t["b"]["support"] == 1.2 and abs(t["a"]["support"] - 0.2) < 1e-9
    assert "b" not in fold({"a": suspect(1.0, 0.0, "oom_logs")}, edge("depends-on"))
    assert fold({"a": suspect(1.0), "b": suspect(0.1, 0.2)}, edge("writes-to"))["b"]["support"] == 0.1
    assert "b" not in fold({"a": suspect(1.0)}, edge("calls"))


def test_deep_and_cyclic_traces(spark):
    from evidra.operators import entities

    rows = [("t", k, k - 1 if k else None, "service" if k == 0 else "dependency", f"e{k}") for k in range(150)] + [("c", 0, 1, "dependency", "x"), ("c", 1, 0, "dependency", "y")]
    got = {(r.trace_id, r.span_id): (r.ancestor_id, r.depth, r.ancestor) for r in entities.nearest_service(spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long, endpoint string, entity string")).collect()}
    assert got == {("t", k): (0, k, "e0") for k in range(1, 150)}


def test_entities_and_edges(spark):
    bad = "2026-03-01T10:05:00Z"
    span = lambda k, parent, resource, name, **attributes: {"span_id": k, "parent_id": parent, "resource": resource, "name": name, "kind": "SERVER", "start": bad, "end": bad, "status": "OK", "attributes": attributes}
    named = lambda k, **attributes: {"id": k, "attributes": {a.replace("_", "."): v for a, v in attributes.items()}}
    dots = lambda **a: {k.replace("_", "."): v for k, v in a.items()}
    spans = [span("a", None, "r-ui", "GET /buy"), span("b", "a", "r-api", "POST /orders", **dots(http_route="/orders", orders_shard="3", tenant_id="t9")), span("c", "b", "r-db", "select", **dots(db_statement="SELECT 1")), span("d", "b", "r-cache", "get", **dots(cache_hit="false")),
             span("e", "b", "r-api", "charge card", **dots(peer_service="bank")), span("f", "a", "r-job", "work"), span("g", "f", "r-db", "insert", **dots(db_statement="INSERT INTO t"))]
    given = case("one") | {
        "resources": [named("r-ui", service_name="shop-ui", k8s_pod_name="ui-1", host_name="h1"), named("r-api", service_name="shop-api"), named("r-job", service_name="job"), named("r-db", service_name="orders-pg", db_system="postgresql"), named("r-cache", service_name="kv", db_system="redis", cluster_name="kv1"),
                      named("r-x1", service_name="x", service_version="v2"), named("r-x2", service_name="x"), named("r-x3", service_name="x", service_version="v1")],
        "traces": [{"trace_id": "t-1", "exemplar_of": "failure", "spans": spans}], "metrics": [], "logs": [],
        "changes": [{"id": "change:v", "t": bad, "kind": "job_start", "entity": "service:job", "summary": "VACUUM of orders started", "attributes": {}}],
        "prior_incidents": [{"id": "prior:1", "first_seen": bad, "title": "", "summary": "", "mitigation": "", "signature": {"primary_entity": "db:orders-pg", "symptom": "latency", "trigger": "service:report nightly run", "upstream_impact": ""}}],
        "telemetry_gaps": [{"id": "telemetry_gap:1", "start": bad, "end": bad, "affected_entities": ["service:y", "queue:z"], "affected_signals": ["trace"], "cause": None, "note": ""}],
    }
    manifests = spark.createDataFrame([json.dumps({"id": "one", "failure_class": "x", "question": "", "capabilities": [], "time_window": {"start": bad, "end": bad}})], "string").select(F.from_json("value", src.MANIFEST).alias("m")).select("m.*")
    inputs = spark.createDataFrame([("one", json.dumps(given))], "incident_id string, j string").select("incident_id", F.from_json("j", src.INPUT).alias("d")).select("incident_id", "d.*")
    i = src.typed(manifests, inputs)
    found = bundle.resolve_entities(i)
    ids = {r.id: (r.kind, r.confidence) for r in found.collect()}
    assert {"route:shop-api/POST /orders": ("route", 0.95), "shard:shop-api-shard-3": ("shard", 0.9), "tenant:t9": ("tenant", 0.9), "queue:z": ("queue", 0.8), "pod:ui-1": ("pod", 0.99), "host:h1": ("host", 0.95), "service:x@canary": ("service", 0.96), "service:x@stable": ("service", 0.95), "service:x@unresolved": ("service", 0.4)}.items() <= ids.items()
    edges = {(r.src, r.type, r.dst): (r.confidence, r.attributes) for r in bundle.resolve_relationships(i, found).collect()}
    api, db = "service:shop-api", "db:orders-pg"
    want = {
        ("service:shop-ui", "calls", api): (0.98, None), (api, "reads-from", db): (0.96, "cache-miss-fallback"), (api, "reads-from", "infra:kv"): (0.97, None), ("service:job", "writes-to", db): (0.96, None), (api, "depends-on", "external-api:bank"): (0.95, "payment-provider"),
        (api, "fans-out-to", "shard:shop-api-shard-3"): (0.9, None), ("tenant:t9", "calls", api): (0.9, "routed to shard:shop-api-shard-3"), ("service:shop-ui", "deployed-as", "pod:ui-1"): (0.99, None), ("pod:ui-1", "runs-on", "host:h1"): (0.95, None),
        ("service:report", "writes-to", db): (0.95, None), (api, "shares-resource-with", "service:job"): (0.8, None), ("service:shop-ui", "calls", "service:job"): (0.98, None),
    }
    assert edges == want


def test_series_of_instances(spark):
    at = lambda m: F.to_timestamp(F.lit(f"2026-03-01 10:{m:02d}:00"))
    one = lambda entity, unit, ord_, m: spark.range(1).select(F.lit("i").alias("incident_id"), F.lit("n").alias("name"), F.lit(entity).alias("entity"), at(m).alias("t"), F.lit(1.0).alias("v"), F.lit(ord_).cast("long").alias("ord"), F.lit(unit).cast("string").alias("unit"))
    points = one("instance:b", None, 5, 3).unionByName(one("instance:a", "ms", 7, 1)).unionByName(one("instance:b", "s", 9, 9)).unionByName(one("db:x", None, 1, 1))
    mapping = spark.createDataFrame([("i", "instance:a", "service:s"), ("i", "instance:b", "service:s"), ("j", "instance:a", "service:t")], "incident_id string, instance string, service string")
    holes = spark.range(2).select(F.lit("i").alias("incident_id"), F.lit("n").alias("name"), F.when(F.col("id") == 0, "instance:a").otherwise("instance:b").alias("entity"), at(1).alias("start"), at(2).alias("end"), F.concat(F.lit("g"), "id").alias("gap_id"), (9 - F.col("id")).alias("seq"))
    got = {r.entity: r for r in bundle.series.identities(points, mapping, holes).collect()}
    s, x = got["service:s"], got["db:x"]
    assert (s.refs, s.unit, s.units_differ, s.n_points, s.input_order, s.gap.gap_id) == (["n@instance:b", "n@instance:a"], "ms", True, 3, 5, "g1")
    assert (x.refs, x.unit, x.units_differ, x.gap) == (["n@db:x"], None, False, None)
    assert bundle.series.identities(points.limit(0), mapping, holes).count() == 0


def test_append_outcomes(spark):
    row = lambda seq, entity, unit, v=1.0: ("i", "n", entity, unit, "2026-03-01 10:00:00", v, seq)
    points = spark.createDataFrame([row(1, "new", None), row(2, "new", None), row(2, "new", "ms"), row(3, "known", "ms"), row(4, "known", "s"), row(5, None, "ms"), row(6, "bare", "ms", None), row(7, "bare", "s")], "incident_id string, name string, entity string, unit string, t string, v double, seq long")
    described = spark.createDataFrame([("i", "n", "known", "ms")], "incident_id string, name string, entity string, unit string")
    got = sorted((r.seq, r.outcome) for r in bundle.series.append(described, points).collect())
    assert got == [(1, "inserted"), (2, "conflict"), (2, "updated"), (3, "updated"), (4, "conflict"), (5, "rejected"), (6, "rejected"), (7, "inserted")]
    assert {r.outcome for r in bundle.series.append(described.limit(0), points.where("entity = 'known'")).collect()} == {"inserted", "conflict"}
