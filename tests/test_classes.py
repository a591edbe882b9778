"""An invented incident of each failure class: its timeline, its comparison with expected results, and the whole answer."""

import json

import pytest
from pyspark.sql import functions as F

from evidra.operators import compare, picks
from evidra.plans import bundle, judge
from evidra.sources import expected
from evidra.sources import incidents as src

DAY = "2026-05-04T"


def t(minute, second=0):
    return f"{DAY}07:{minute:02d}:{second:02d}Z"


def metric(name, entity, values, start=0, **more):
    return {"name": name, "entity": entity, "unit": "x", "points": [{"t": t(start + k), "v": float(v)} for k, v in enumerate(values)], **more}


def log(n, minute, entity, severity, body, second=0):
    return {"id": f"log-{n}", "t": t(minute, second), "entity": entity, "severity": severity, "body": body, "attributes": {}}


def change(id, minute, kind, entity, summary="it changed", second=0):
    return {"id": f"change:{id}", "t": t(minute, second), "kind": kind, "entity": entity, "summary": summary, "attributes": {}}


def span(id, parent, resource, minute, status="ERROR", kind="SERVER", second=0, **attributes):
    return {"span_id": id, "parent_id": parent, "resource": resource, "name": f"op {id}", "kind": kind, "start": t(minute, second), "end": t(minute, second), "status": status, "attributes": {k.replace("_", "."): v for k, v in attributes.items()}}


RESOURCES = [{"id": "r-edge", "attributes": {"service.name": "edge"}}, {"id": "r-cart", "attributes": {"service.name": "cart"}}, {"id": "r-db", "attributes": {"service.name": "stock-pg", "db.system": "postgresql"}}]
ERRORS, SLOW, QUERY = "http.server.error_rate", "http.server.duration_p95_ms", "db.query.duration_p95_ms"
CALLS = [span("a", None, "r-edge", 8, second=7), span("b", "a", "r-cart", 8, second=8), span("c", "b", "r-db", 8, "OK", "CLIENT", second=9, db_statement="SELECT 1")]
JUMP = [0.002, 0.003, 0.002, 0.002, 0.002, 0.1, 0.4, 0.42]
#: class -> (input, timeline as (minute, second, marker, entity, reference))
CASES = {
    "deploy": ({"changes": [change("v2", 3, "deploy", "service:cart"), change("late", 7, "deploy", "service:blog")], "logs": [log(1, 6, "service:cart", "ERROR", "boom"), log(2, 5, "service:cart", "ERROR", "boom", 30), log(3, 1, "db:stock-pg", "ERROR", "x")], "metrics": [metric(ERRORS, "service:cart", JUMP), metric(SLOW, "service:cart", [10] * 5 + [90] * 3)], "traces": CALLS},
               [(3, 0, "change", "service:cart", "change:v2"), (5, 30, "symptom", "service:cart", "log-2"), (6, 0, "symptom", "service:cart", f"{ERRORS}@service:cart"), (8, 7, "propagation", "service:edge", "t-1/a")]),
    "dependency-degradation": ({"changes": [change("job", 2, "job_start", "service:report")], "metrics": [metric(QUERY, "db:stock-pg", [20, 20, 20, 20, 100, 200, 200, 20]), metric(SLOW, "service:cart", [10, 10, 10, 10, 10, 90, 90, 90])], "traces": CALLS},
               [(2, 0, "change", "service:report", "change:job"), (3, 0, "symptom", "db:stock-pg", "aw-1"), (5, 0, "propagation", "service:cart", "aw-2"), (7, 0, "recovery", "db:stock-pg", f"{QUERY}@db:stock-pg"), (8, 7, "propagation", "service:edge", "t-1/a")]),
    "retry-storm": ({"logs": [log(1, 2, "service:pay", "WARN", "a transient error here"), log(2, 5, "service:pay", "ERROR", "request queue full")], "metrics": [metric("client.retry.rate_rps", "service:cart", [5, 5, 5, 5, 400, 900]), metric("request.rate_rps", "service:pay", [100, 100, 100, 100, 400, 1500]), metric(ERRORS, "service:pay", [0.004, 0.004, 0.004, 0.004, 0.3, 0.6])],
               "resources": [{"id": "r-cart", "attributes": {"service.name": "cart"}}, {"id": "r-pay", "attributes": {"service.name": "pay"}}], "traces": [span("a", None, "r-cart", 5, "OK"), *(span(f"p{k}", "a", "r-pay", 5, kind="CLIENT", second=k, retry_attempt=str(k)) for k in (1, 2, 3))]},
               [(2, 0, "trigger", "service:pay", "log-1"), (3, 0, "amplification", "service:cart", "aw-1"), (5, 0, "symptom", "service:pay", "aw-2"), (5, 0, "symptom", "service:pay", "log-2")]),
    "config-change": ({"changes": [change("limit", 3, "config_change", "service:edge")], "logs": [log(1, 4, "service:edge", "ERROR", "exceeded the deadline")], "metrics": [metric(ERRORS, "service:edge", JUMP), metric(SLOW, "service:cart", [50, 50, 51, 50, 50, 51, 50, 50])]},
               [(3, 0, "change", "service:edge", "change:limit"), (4, 0, "symptom", "service:edge", "log-1"), (6, 0, "symptom", "service:edge", "aw-1")]),
    "traffic-shift": ({"changes": [change("ramp", 2, "traffic_shift", "tenant:big")], "metrics": [metric(SLOW, "shard:s-3", [10, 10, 10, 10, 31, 90, 95]), metric("queue.depth", "shard:s-3", [2, 2, 2, 2, 20, 90, 80]), metric("request.rate_rps", "tenant:big", [50, 50, 50, 50, 400, 500, 500]), metric(SLOW, "shard:s-1", [10] * 7)]},
               [(2, 0, "change", "tenant:big", "change:ramp"), (5, 0, "symptom", "shard:s-3", "aw-1"), (5, 0, "symptom", "shard:s-3", "aw-2")]),
    "resource-exhaustion": ({"changes": [change("v3", 0, "deploy", "service:rec"), change("oom-1", 4, "infrastructure_event", "pod:rec-1"), change("oom-2", 7, "infrastructure_event", "pod:rec-1")], "metrics": [metric("memory.rss_bytes", "pod:rec-1", [100, 160, 200, 198, 30, 150, 199, 35])]},
               [(0, 0, "change", "service:rec", "change:v3"), (2, 0, "symptom", "pod:rec-1", "aw-1"), (4, 0, "symptom", "pod:rec-1", "change:oom-1"), (7, 0, "symptom", "pod:rec-1", "change:oom-2")]),
    "schema-change": ({"changes": [change("ddl", 3, "schema_migration", "db:stock-pg")], "logs": [log(1, 4, "service:cart", "ERROR", "column x does not exist")], "metrics": [metric(ERRORS, "service:cart", JUMP)]},
               [(3, 0, "change", "db:stock-pg", "change:ddl"), (4, 0, "symptom", "service:cart", "log-1"), (6, 0, "symptom", "service:cart", "aw-1")]),
    "downstream-outage": ({"changes": [change("out", 3, "external_event", "external-api:acmepay")], "logs": [log(1, 2, "service:cart", "ERROR", "other"), log(2, 4, "service:cart", "ERROR", "provider AcmePay, returned 503")], "metrics": [metric(ERRORS, "service:cart", JUMP), metric("dependency.error_rate", "external-api:acmepay", JUMP)], "traces": [CALLS[0], span("b", "a", "r-cart", 8, second=8, peer_service="acmepay")]},
               [(3, 0, "trigger", "external-api:acmepay", "change:out"), (4, 0, "symptom", "service:cart", "log-2"), (8, 7, "propagation", "service:edge", "t-1/a")]),
    "recurring-incident": ({"changes": [change("job", 2, "job_start", "service:report")], "logs": [log(1, 5, "service:cart", "ERROR", "timed out", 40)], "metrics": [metric(QUERY, "db:stock-pg", [20, 20, 20, 20, 70, 200, 200, 20]), metric("db.locks.waiting", "db:stock-pg", [0, 0, 0, 9, 9, 9, 0, 0])],
               "prior_incidents": [{"id": "prior:1", "first_seen": t(0), "title": "", "summary": "", "mitigation": "", "signature": {"primary_entity": "db:stock-pg", "symptom": f"{QUERY} with db.locks.waiting", "trigger": "service:report VACUUM", "upstream_impact": ""}}]},
               [(2, 0, "change", "service:report", "change:job"), (5, 0, "symptom", "db:stock-pg", "aw-2"), (5, 0, "propagation", "service:cart", "log-1"), (7, 0, "recovery", "db:stock-pg", f"{QUERY}@db:stock-pg")]),
    "missing-data": ({"changes": [change("restart", 4, "infrastructure_event", "service:collector")], "metrics": [metric(ERRORS, "service:cart", [0.004, 0.1, 0.1, 0.1, 0.1, 0.2, 0.004], _gap={"start": t(4), "end": t(5), "ref": "telemetry_gap:1"})], "traces": [span("a", None, "r-cart", 3), span("b", "a", "r-db", 3, second=1, kind="CLIENT", error_type="connection_refused")],
               "telemetry_gaps": [{"id": "telemetry_gap:1", "start": t(4), "end": t(5), "affected_entities": ["service:cart"], "affected_signals": ["metric"], "cause": "change:restart", "note": ""}]},
               [(3, 1, "symptom", "service:cart", "t-1/b"), (4, 0, "data-gap", "service:collector", "telemetry_gap:1"), (5, 0, "data-gap", "service:collector", "telemetry_gap:1")]),
    "coincidental-correlation": ({"changes": [change("node", 3, "infrastructure_event", "infra:kv"), change("ui", 6, "deploy", "service:ui")], "logs": [log(1, 5, "service:cart", "ERROR", "timed out")], "metrics": [metric("cache.hit_ratio", "infra:kv", [0.95, 0.95, 0.95, 0.95, 0.4, 0.4]), metric(ERRORS, "service:cart", [0.002, 0.002, 0.002, 0.002, 0.002, 0.3]), metric(ERRORS, "service:ui", [0.001] * 6)]},
               [(3, 0, "change", "infra:kv", "change:node"), (4, 0, "symptom", "infra:kv", "aw-1"), (5, 0, "symptom", "service:cart", "aw-2"), (6, 0, "non-causal-change", "service:ui", "change:ui")]),
    "entity-ambiguity": ({"metrics": [metric(ERRORS, "instance:p-1", JUMP)], "logs": [log(1, 6, "instance:p-1", "ERROR", "boom")], "resources": [{"id": "r1", "attributes": {"service.name": "pay", "service.version": "v2", "service.instance.id": "p-1"}}, {"id": "r2", "attributes": {"service.name": "pay"}}]},
               None),
}


@pytest.fixture(scope="module")
def incidents(spark):
    manifests, inputs = [], []
    for name, (given, _) in CASES.items():
        manifests.append((json.dumps({"id": name, "failure_class": name, "question": "why", "capabilities": [], "time_window": {"start": t(0), "end": t(9)}}),))
        spans = given.get("traces", [])
        whole = {"resources": RESOURCES, "metrics": [], "logs": [], "changes": [], "prior_incidents": None, "telemetry_gaps": None} | given | {"traces": [{"trace_id": "t-1", "exemplar_of": "failure", "spans": spans}] if spans else []}
        inputs.append((name, json.dumps(whole)))
    m = spark.createDataFrame(manifests, "j string").select(F.from_json("j", src.MANIFEST).alias("m")).select("m.*")
    d = spark.createDataFrame(inputs, "incident_id string, j string").select("incident_id", F.from_json("j", src.INPUT).alias("d")).select("incident_id", "d.*")
    return src.typed(m, d).persist()


@pytest.fixture(scope="module")
def derived(incidents):
    return bundle.derive(incidents)


@pytest.fixture(scope="module")
def timeline(incidents, derived):
    return bundle.build_timeline(incidents, derived).persist()


def test_timeline_of_each_class(timeline):
    got = {}
    for r in sorted(timeline.collect(), key=lambda r: r.position):
        got.setdefault(r.incident_id, []).append((r.t.minute, r.t.second, r.marker, r.entity, r.source_ref))
    for name, (_, want) in CASES.items():
        if want is not None:
            assert got.get(name) == want, name
    assert got["entity-ambiguity"]  # no picks: all events


def test_related_by_class(incidents, derived):
    got = {}
    for r in sorted(bundle.find_related_anomalies(incidents, derived).collect(), key=lambda r: r.position):
        got.setdefault(r.incident_id, []).append((r.seed, r.window, r.relation, r.lag_seconds, r.prior_incident, r.similarity))
    assert got == {
        "dependency-degradation": [("aw-2", "aw-1", "downstream-dependency", 120, None, None)],
        "downstream-outage": [("aw-2", "aw-1", "downstream-dependency", 0, None, None)],
        "retry-storm": [("aw-3", "aw-1", "amplifier", 60, None, None), ("aw-3", "aw-2", "load-amplification", 0, None, None)],
        "recurring-incident": [("aw-2", None, "recurring-signature", None, "prior:1", 0.93)],
    }


def test_comparison_by_class(incidents, derived):
    got = {}
    for r in sorted(bundle.compare_windows(incidents, d=derived).collect(), key=lambda r: r.position):
        got.setdefault(r.incident_id, []).append((r.entity, r.signal, r.from_v, r.to_v, r.note))
    assert set(got) == {"deploy", "dependency-degradation", "config-change", "coincidental-correlation", "traffic-shift"}
    assert got["deploy"] == [("service:cart", ERRORS, 0.002, 0.42, None), ("service:cart", SLOW, 10.0, 90.0, None)]
    assert got["config-change"] == [("service:edge", ERRORS, 0.002, 0.42, None), ("service:cart", SLOW, 51.0, 50.0, "flat")]
    assert got["coincidental-correlation"] == [("infra:kv", "cache.hit_ratio", 0.95, 0.4, None), ("service:cart", ERRORS, 0.002, 0.3, None), ("service:ui", ERRORS, 0.001, 0.001, "flat")]
    assert [x[:2] for x in got["traffic-shift"]] == [("shard:s-3", SLOW), ("shard:s-1", SLOW), ("tenant:big", "request.rate_rps")]


def test_whole_answer_of_each_class(incidents, derived):
    b = bundle.get_evidence_bundle(incidents, bundle.EvidenceQuery(max_items=6, max_tokens=1200), derived)
    items = b.items.collect()
    assert {r.incident_id for r in items} == set(CASES)
    top = {r.incident_id: r.entity for r in b.causes.where("rank = 1").collect()}
    assert set(top) == set(CASES)
    assert top["deploy"] == "service:cart" and top["config-change"] == "service:edge" and top["resource-exhaustion"] in ("pod:rec-1", "service:rec") and top["downstream-outage"] == "external-api:acmepay"


def said(incidents, derived, timeline):
    """The derived results as an expected file of each incident."""
    iso = lambda x: x.strftime("%Y-%m-%dT%H:%M:%SZ") if x else None
    out = {name: {"entities": [], "relationships": [], "anomaly_windows": [], "log_patterns": [], "timeline": []} for name in CASES}
    for r in derived.entities.collect():
        out[r.incident_id]["entities"].append({"id": r.id, "kind": r.kind, "confidence": r.confidence})
    for r in derived.edges.collect():
        out[r.incident_id]["relationships"].append({"src": r.src, "type": r.type, "dst": r.dst, "confidence": r.confidence})
    for r in derived.windows.collect():
        out[r.incident_id]["anomaly_windows"].append({"id": r.id, "entity": r.entity, "signal": r.name, "start": iso(r.start), "end": iso(r.end), "baseline": r.baseline, "peak": r.peak, "trough": r.trough, "detector_confidence": r.detector_confidence, "note": r.note})
    for r in derived.patterns.collect():
        out[r.incident_id]["log_patterns"].append({"id": r.id, "template": r.template, "entity": r.entity, "severity": r.severity, "first_seen": iso(r.first_seen), "last_seen": iso(r.last_seen), "count": r["count"], "exemplars": r.exemplars, "stability": r.stability})
    for r in sorted(timeline.collect(), key=lambda r: (r.incident_id, r.position)):
        out[r.incident_id]["timeline"].append({"t": iso(r.t), "marker": r.marker, "entity": r.entity, "text": r.text, "source_ref": r.source_ref})
    for r in sorted(bundle.find_related_anomalies(incidents, derived).collect(), key=lambda r: r.position):
        own = out[r.incident_id].setdefault("related_anomalies", {"seed": r.seed, "related": []})
        own["related"].append({"window": r.window, "relation": r.relation, "lag_seconds": r.lag_seconds, "prior_incident": r.prior_incident, "similarity": r.similarity, "note": r.note})
    for r in sorted(bundle.compare_windows(incidents, d=derived).collect(), key=lambda r: r.position):
        own = out[r.incident_id].setdefault("window_comparison", {"healthy": {"start": iso(r.healthy_start), "end": iso(r.healthy_end)}, "anomalous": {"start": iso(r.anomalous_start), "end": iso(r.anomalous_end)}, "deltas": []})
        own["deltas"].append({"entity": r.entity, "signal": r.signal, "from": r.from_v, "to": r.to_v, "factor": r.factor, "note": r.note})
    return out


def test_planted_differences_come_back_one_row_each(spark, incidents, derived, timeline, tmp_path):
    gold = said(incidents, derived, timeline)

    def differences(folder):
        for name, x in gold.items():
            (folder / name).mkdir(parents=True, exist_ok=True)
            (folder / name / "expected.json").write_text(json.dumps(x))
        (folder / "bad").mkdir()
        (folder / "bad" / "expected.json").write_text("{no json")
        rows = judge.context_differences(expected.read(spark, str(folder)), incidents, derived).collect()
        return sorted((r.incident_id, r.path, r.problem) for r in rows)

    assert differences(tmp_path / "same") == []
    deploy, dep = gold["deploy"], gold["dependency-degradation"]
    window = next(x for x in deploy["anomaly_windows"] if x["id"] == "aw-1")
    window["peak"] *= 1.02  # within the tolerance
    window["baseline"] += 5
    deploy["anomaly_windows"].append({"id": "aw-9", "entity": "e", "signal": "s"})
    deploy["timeline"][0], deploy["timeline"][1] = deploy["timeline"][1], deploy["timeline"][0]
    deploy["timeline"][3]["text"] = "  other words "
    deploy["log_patterns"][0]["exemplars"] = ["log-x"]
    dep["relationships"] = [x | {"confidence": x["confidence"] - 0.2} if x["type"] == "reads-from" else x for x in dep["relationships"]]
    dep["related_anomalies"]["related"][0]["lag_seconds"] = 7
    dep["window_comparison"]["deltas"].pop()
    dep["timeline"].pop(2)
    pattern, event, edge = deploy["log_patterns"][0], deploy["timeline"][3], next(x for x in dep["relationships"] if x["type"] == "reads-from")
    gone = bundle.compare_windows(incidents, d=derived).where("incident_id = 'dependency-degradation'").orderBy(F.desc("position")).first()
    when = lambda x: x.replace("T", " ").replace("Z", "")
    assert differences(tmp_path / "other") == sorted([
        ("deploy", "$.anomaly_windows[aw-1].baseline", "differs"), ("deploy", "$.anomaly_windows[aw-9]", "missing"), ("deploy", "$.timeline[1]", "order"),
        ("deploy", f"$.timeline[{when(event['t'])}|{event['marker']}|{event['entity']}|{event['source_ref']}].text", "wording"),
        ("deploy", f"$.log_patterns[{pattern['entity']}|{pattern['severity']}|{pattern['template']}].exemplars", "differs"),
        ("dependency-degradation", f"$.relationships[{edge['src']}|reads-from|{edge['dst']}].confidence", "differs"), ("dependency-degradation", "$.related_anomalies[aw-1|].lag_seconds", "differs"),
        ("dependency-degradation", f"$.window_comparison[{gone.entity}|{gone.signal}]", "extra"), ("dependency-degradation", f"$.timeline[2026-05-04 07:05:00|propagation|service:cart|aw-2]", "extra"),
    ])


def test_alignment_is_greedy(spark):
    def brute(want, have):
        start, gaps = 0, []
        for n, x in enumerate(want):
            if x in have[start:]:
                start += have[start:].index(x) + 1
            else:
                gaps.append((n, x, have[start] if start < len(have) else None))
        return gaps

    lists = {"a": ("xyz", "xyz"), "b": ("zxy", "xyz"), "c": ("xqyw", "yxwz"), "d": ("abc", ""), "e": ("", "abc"), "f": ("cbadb", "abcd")}
    rows = lambda side: spark.createDataFrame([(k, n, x) for k, v in lists.items() for n, x in enumerate(v[side], 1)], "incident_id string, position int, x string").repartition(3)
    got = {}
    for r in compare.out_of_order(rows(0), rows(1), "s", ["x"]).collect():
        got.setdefault(r.incident_id, []).append((int(r.path[4:-1]), r.expected, r.actual))
    assert {k: sorted(v) for k, v in got.items()} == {k: b for k, v in lists.items() if (b := brute(*v))}


def test_picks_that_follow(spark):
    p = picks.Pick
    rules = (p("open", ("c",), "log", {"body": "open"}), p("error", ("c",), "log", {"body": "error"}, "symptom", after="open"), p("each", ("c",), "log", {"body": "error"}, "symptom", take="all", after="open"))
    rows = [("i", k, f"log-{k}", body) for k, body in enumerate(["error", "open", "error", "open", "error"])] + [("j", 0, "log-0", "error")]
    ev = spark.createDataFrame(rows, "incident_id string, seq long, ref string, body string").withColumns({"t": F.timestamp_seconds(F.col("seq") * 60), "failure_class": F.lit("c"), "source": F.lit("log"), "entity": F.lit("e")})
    got = sorted((r.incident_id, r.rule, r.source_ref) for r in picks.pick(picks.conform(ev), rules).collect())
    assert got == [("i", "each", "log-2"), ("i", "each", "log-4"), ("i", "error", "log-2"), ("i", "open", "log-1")]
    with pytest.raises(ValueError):
        picks.pick(picks.conform(ev), (p("x", ("c",), "log", after="none"),))


def test_answer_differences(spark, incidents, derived):
    b = bundle.get_evidence_bundle(incidents, bundle.EvidenceQuery(), derived)
    top = b.causes.where("incident_id = 'deploy' and rank = 1").first()
    check = b.checks.where("incident_id = 'deploy'").first()
    ask = lambda causes, checks: spark.createDataFrame([("deploy", json.dumps({"suspected_causes": causes, "next_checks": checks}))], "incident_id string, j string").select("incident_id", F.from_json("j", expected.EXPECTED).alias("x")).select("incident_id", "x.*")
    same = ask([{"rank": 1, "entity": top.entity, "score": top.score}, {"rank": 2, "entity": "service:none", "score": 0.1}], [{"action": "x", "expected_signal": check.expected_signal}])
    assert judge.answer_differences(expected.typed(same), b).count() == 0
    other = ask([{"rank": 1, "entity": "service:none", "score": 1.0}, {"rank": 2, "entity": top.entity, "score": 0.0}], [{"action": "x", "expected_signal": "nothing of the kind"}])
    got = sorted((r.path, r.problem) for r in judge.answer_differences(expected.typed(other), b).collect())
    assert got == sorted([("$.next_checks", "missing"), ("$.suspected_causes[service:none]", "missing"), (f"$.suspected_causes[{top.entity}].rank", "differs"), (f"$.suspected_causes[{top.entity}].score", "differs")])


def test_many_questions_at_once(spark, incidents, derived):
    from datetime import datetime

    at = lambda m: datetime(2026, 5, 4, 7, m)
    q = spark.createDataFrame([("q1", "deploy", at(0), at(9), ["service:cart"], 2, 1000), ("q2", "deploy", at(0), at(2), None, 9, 1000), ("q3", "retry-storm", None, None, [], 3, 90)], "question_id string, incident_id string, start timestamp, end timestamp, entities array<string>, max_items int, max_tokens int")
    chosen, dropped = (x.collect() for x in bundle.answer_questions(incidents, derived, q))
    of = lambda rows, name: [r for r in rows if r.question_id == name]
    assert len(of(chosen, "q1")) == 2 and all("service:cart" in r.entities for r in chosen + dropped if r.question_id == "q1")
    assert all(r.r_start is None or r.r_start <= at(2) for r in of(chosen, "q2") + of(dropped, "q2")) and of(chosen, "q2")
    assert sum(r.token_cost for r in of(chosen, "q3")) <= 90 and {r.incident_id for r in of(dropped, "q3")} == {"retry-storm"}
    n = bundle.candidates(incidents, derived).where("incident_id = 'retry-storm'").count()
    assert len(of(chosen, "q3")) + len(of(dropped, "q3")) == n
