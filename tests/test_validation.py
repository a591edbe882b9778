"""A corpus with one planted fault of each kind."""

import copy
import json

from evidra.sources import validation

T = "2026-02-02T10:0%d:00Z"
SCENARIO = {"id": "x", "title": "t", "question": "q", "failure_class": "deploy", "difficulty": "baseline", "capabilities": ["build_timeline"], "time_window": {"start": T % 0, "end": T % 9}, "inputs": ["resources", "traces", "metrics", "logs", "changes", "telemetry_gaps"], "expected": ["timeline", "anomaly_windows", "log_patterns"], "ground_truth": {"cause_ref": "change:1"}}
INPUT = {
    "_note": "n", "resources": [{"id": "r1", "attributes": {}}], "traces": [{"trace_id": t, "spans": [{"span_id": "a", "parent_id": None, "resource": "r1", "status": "OK"}, {"span_id": "b", "parent_id": "a", "resource": "r1", "status": "ERROR"}]} for t in ("t1", "t2")],
    "metrics": [{"name": "m", "entity": "e", "points": [], "_gap": {"ref": "gap:1"}}], "logs": [{"id": "log-1", "t": T % 1, "severity": "INFO", "body": "b"}], "changes": [{"id": "change:1", "t": T % 1, "entity": "e"}], "telemetry_gaps": [{"id": "gap:1", "start": T % 1, "cause": "change:1"}],
}
GOLD = {"timeline": [{"t": T % 1, "source_ref": "change:1"}, {"t": T % 1, "source_ref": "t1/a"}, {"t": T % 2, "source_ref": "m@e"}, {"t": T % 2, "source_ref": "aw-1"}], "anomaly_windows": [{"id": "aw-1"}], "log_patterns": [{"id": "lp-1", "exemplars": ["log-1"]}]}


def test_corpus(spark, tmp_path):
    def write(name, change=lambda s, i, g: None):
        s, i, g = copy.deepcopy((SCENARIO | {"id": name}, INPUT, GOLD))
        change(s, i, g)
        (tmp_path / name).mkdir()
        for file, x in (("scenario", s), ("input", i), ("expected", g)):
            (tmp_path / name / f"{file}.json").write_text(x if isinstance(x, str) else json.dumps(x))

    def put(*path, value):
        def change(s, i, g):
            at = {"s": s, "i": i, "g": g}[path[0]]
            for p in path[1:-1]:
                at = at[p]
            at[path[-1]] = value

        return change

    write("fine")
    faults = {
        "class": (put("s", "failure_class", value="other"), ("scenario.json", "$.failure_class", "one_of")), "title": (put("s", "title", value=" "), ("scenario.json", "$.title", "needed")), "folder": (put("s", "id", value="elsewhere"), ("scenario.json", "$.id", "refers")),
        "order": (put("s", "time_window", value={"start": T % 9, "end": T % 1}), ("scenario.json", "$.time_window", "refers")), "cause": (put("s", "ground_truth", "cause_ref", value="none"), ("scenario.json", "$.ground_truth.cause_ref", "refers")),
        "twice": (lambda s, i, g: i["logs"].append(dict(i["logs"][0])), ("input.json", "$.logs[1].id", "unique")), "parent": (put("i", "traces", 1, "spans", 1, "parent_id", value="z"), ("input.json", "$.spans[3].parent", "refers")),
        "resource": (put("i", "traces", 0, "spans", 0, "resource", value="r9"), ("input.json", "$.spans[0].resource", "refers")), "severity": (put("i", "logs", 0, "severity", value="LOUD"), ("input.json", "$.logs[0].severity", "one_of")),
        "gap": (put("i", "metrics", 0, "_gap", "ref", value="gap:9"), ("input.json", "$.metrics[0].gap", "refers")), "key": (put("i", "surplus", value=[]), ("input.json", "$.surplus", "extra")), "lacks": (lambda s, i, g: g.pop("log_patterns"), ("expected.json", "$.log_patterns", "missing")),
        "ref": (put("g", "timeline", 0, "source_ref", value="nowhere"), ("expected.json", "$.timeline[0].source_ref", "refers")), "exemplar": (put("g", "log_patterns", 0, "exemplars", value=["log-1", "log-7"]), ("expected.json", "$.log_patterns.exemplars[1].exemplars", "refers")),
    }
    for name, (change, _) in faults.items():
        write(name, change)
    write("broken")
    (tmp_path / "broken" / "input.json").write_text("{no")
    got = {}
    for r in validation.validate(spark, str(tmp_path)).collect():
        got.setdefault(r.case, []).append((r.file, r.path, r.rule.split(" ")[0]))
    assert "fine" not in got
    assert {k: v for k, v in got.items() if k != "broken"} == {k: [v] for k, (_, v) in faults.items()}
    assert ("input.json", "$", "malformed") in got["broken"]
    n = {(r.dimension, r.value): r.n for r in validation.coverage(spark, str(tmp_path)).collect()}
    assert n[("difficulty", "baseline")] == len(faults) + 2 and n[("failure_class", "other")] == 1 and n[("capability", "build_timeline")] == len(faults) + 2
