"""Schemas, renderers and the line protocol."""

import json

import pytest
from pyspark.sql import functions as F

from evidra.plans import bundle, surface
from evidra.sources import replay


def ask(call=lambda a: [{"incident_id": "x"}], **message):
    return json.loads(surface.respond(json.dumps({"jsonrpc": "2.0", "id": 1} | message), call))


def test_protocol():
    assert surface.respond('{"jsonrpc": "2.0", "method": "initialize"}', None) is None
    assert json.loads(surface.respond("{", None))["error"]["code"] == surface.PARSE
    assert json.loads(surface.respond("[]", None))["error"]["code"] == surface.REQUEST
    assert ask(method="nope")["error"]["code"] == surface.METHOD
    assert ask(method="tools/call", params={"name": "other"})["error"]["code"] == surface.PARAMS
    assert ask(method="tools/list")["result"]["tools"][0]["name"] == surface.TOOL
    good = ask(method="tools/call", params={"name": surface.TOOL, "arguments": {"folder": "x"}})
    assert not good["result"]["isError"] and good["result"]["structuredContent"]["incidents"] == [{"incident_id": "x"}]


def test_argument_errors(spark):
    for bad in ({}, {"folder": "x", "more": 1}, {"folder": "x", "max_items": "3"}, {"folder": "x", "max_items": 0}, {"folder": "x", "intent": {}}, {"folder": "x", "intent": "why"}, {"folder": "x", "intent": {"question": " "}}, {"folder": "x", "intent": {"question": 3}}, {"folder": "x", "intent": {"goal": "y"}}, {"folder": "x", "question": "a", "intent": {"question": "b"}}):
        r = ask(lambda a: surface.answer(spark, a), method="tools/call", params={"name": surface.TOOL, "arguments": bad})
        assert r["result"]["isError"] and r["result"]["structuredContent"]["code"] == "invalid_arguments"
    with pytest.raises(bundle.QueryError) as e:
        surface.answer(spark, {"folder": "/no/such/folder"})
    assert e.value.code == "not_found"


def test_schema_files(spark, tmp_path):
    df = spark.range(1).select(F.lit("a").alias("s"), F.array(F.lit(1.0)).alias("xs"), F.lit(None).cast("timestamp").alias("t"))
    assert surface.write_schemas(str(tmp_path), item=df) == ["evidence-query", "item"]
    made = json.loads((tmp_path / "item.schema.json").read_text())
    assert made["properties"]["xs"] == {"type": "array", "items": {"type": "number"}} and made["properties"]["t"]["format"] == "date-time" and "t" not in made["required"]


def test_replay(spark):
    rows = [("i", 0, "log", "b", "2026-01-01T00:00:01.5Z"), ("i", 1, "log", "a", "2026-01-01T00:00:01Z"), ("i", 2, "resource", "r", None), ("i", 3, "log", "x", "late")]
    ev = spark.createDataFrame(rows, "incident_id string, input_order int, kind string, key string, time string")
    plan = replay.plan(ev)
    assert [json.loads(r.value)["key"] for r in surface.replay_lines(plan).collect()] == ["r", "a", "b"]
    assert surface.replay_text(plan).first().value == "i 000000 - resource r" and [r.key for r in replay.malformed(ev).collect()] == ["x"]


def test_serve_a_folder(spark, tmp_path):
    """The endpoint over files: an answer whose links resolve within it, and errors with codes."""
    import io

    from test_bundle import case

    manifest = {"id": "one", "failure_class": "deploy", "question": "why", "capabilities": [], "time_window": {"start": "2026-03-01T10:00:00Z", "end": "2026-03-01T10:10:00Z"}}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "scenario.json").write_text(json.dumps(manifest))
    (tmp_path / "one" / "input.json").write_text(json.dumps(case("one")))
    call = lambda k, **a: json.dumps({"jsonrpc": "2.0", "id": k, "method": "tools/call", "params": {"name": surface.TOOL, "arguments": {"folder": str(tmp_path)} | a}})
    out = io.StringIO()
    surface.serve(spark, [call(1, scenario_id="one", entities=["service:pay"], max_items=4), "\n", call(2, scenario_id="two"), call(3, entities=[1]), call(4, intent={"hypothesis": "the rollout did it"}, max_items=2)], out)
    good, missing, wrong, meant = map(json.loads, out.getvalue().splitlines())
    one = good["result"]["structuredContent"]["incidents"][0]
    ids = {x["id"] for x in one["items"]}
    assert 0 < len(ids) <= 4 and one["incident_id"] == "one"
    assert one["question"] == "why" and "hypothesis" not in one and one["time_window"]["start"].startswith("2026-03-01T10:00:00")
    assert one["budget"]["tokens_used"] == sum(x["token_cost"] for x in one["items"]) <= one["budget"]["max_tokens"] and one["budget"]["max_items"] == 4
    other = meant["result"]["structuredContent"]["incidents"][0]
    assert other["hypothesis"] == "the rollout did it" and "question" not in other and other["budget"]["items_dropped"] >= one["budget"]["items_dropped"] and len(other["items"]) <= 2
    assert all(set(c["supporting"]) | set(c["counters"]) <= ids for c in one["suspected_causes"])
    assert missing["result"]["structuredContent"]["code"] == "not_found" and wrong["result"]["structuredContent"]["code"] == "invalid_arguments"
