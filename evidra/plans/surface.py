"""What stands around the plans: JSON Schema of results, renderers, and a tool call over JSON-RPC lines."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.plans import bundle
from evidra.sources import incidents

TOOL = "get_evidence_bundle"
PLAIN = {T.StringType: "string", T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "number", T.FloatType: "number", T.BooleanType: "boolean"}
# Fixed values of the line protocol.
PARSE, REQUEST, METHOD, PARAMS = -32700, -32600, -32601, -32602

_WORD, _SIZE = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 0}
QUERY_SCHEMA = {
    "$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "additionalProperties": False, "required": ["folder"],
    "properties": {
        "folder": _WORD, "intent": {"type": "object", "additionalProperties": False, "minProperties": 1, "properties": {"question": _WORD, "hypothesis": _WORD}}, "scenario_id": _WORD, "question": _WORD, "hypothesis": _WORD, "start": {"type": "string", "format": "date-time"}, "end": {"type": "string", "format": "date-time"},
        "entities": {"type": "array", "items": _WORD}, "max_items": {"type": "integer", "minimum": 1}, "max_tokens": {"type": "integer", "minimum": 1}, "reserve_tokens": _SIZE, "min_counter_evidence_items": _SIZE,
        "require_counter_evidence": {"type": "boolean"}, "require_raw_refs": {"type": "boolean"}, "freshness": {"type": "string", "enum": list(bundle.FRESHNESS)}, "privacy_scope": _WORD,
    },
}


def json_schema(kind: T.DataType) -> dict:
    """A Spark type as JSON Schema; what may be null is not required."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "additionalProperties": False, "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    if isinstance(kind, T.TimestampType):
        return {"type": "string", "format": "date-time"}
    return {"type": PLAIN.get(type(kind), "string")}


def write_schemas(folder: str, **frames: DataFrame) -> list[str]:
    """Pretty JSON Schema files of results and of the query, on the driver's disk."""
    os.makedirs(folder, exist_ok=True)
    made = {name: {"$schema": "http://json-schema.org/draft-07/schema#", "title": name} | json_schema(df.schema) for name, df in frames.items()} | {"evidence-query": QUERY_SCHEMA}
    for name, schema in made.items():
        with open(os.path.join(folder, f"{name}.schema.json"), "w") as f:
            json.dump(schema, f, indent=2, sort_keys=True)
            f.write("\n")
    return sorted(made)


def bundle_json(b: bundle.Bundle) -> DataFrame:
    """(incident_id, json): what was asked of an incident, its items, causes and checks as one compact JSON text."""
    item = F.struct("id", "claim", "kind", "direction", F.round("strength", 6).alias("strength"), F.struct("start", "end").alias("time_window"), "entities", F.col("refs").alias("source_refs"), "token_cost", "note")
    items = b.items.groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("x")))), lambda r: r["x"]).alias("items"))
    causes = b.causes.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity", F.round("score", 6).alias("score"), "supporting", "counters", "reasons", "is_trap"))).alias("suspected_causes"))
    checks = b.checks.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("rank", "action", "rationale", "expected_signal"))).alias("next_checks"))
    budget = F.struct("max_items", "max_tokens", "tokens_used", "items_dropped").alias("budget")
    head = b.header.select("incident_id", "question", "hypothesis", F.struct("start", "end").alias("time_window"), budget)
    j = items.join(head, "incident_id").join(causes, "incident_id", "left").join(checks, "incident_id", "left")
    return j.select("incident_id", F.to_json(F.struct("incident_id", "question", "hypothesis", "time_window", "budget", "items", "suspected_causes", "next_checks")).alias("json"))


def replay_lines(plan: DataFrame) -> DataFrame:
    """A replay plan as JSON lines in sequence, for ``write.text``."""
    return plan.orderBy("incident_id", "sequence").select(F.to_json(F.struct("incident_id", "sequence", "kind", "key", "time")).alias("value"))


def replay_text(plan: DataFrame) -> DataFrame:
    """A replay plan as readable lines in sequence."""
    return plan.orderBy("incident_id", "sequence").select(F.format_string("%s %06d %s %s %s", "incident_id", F.col("sequence").cast("int"), F.coalesce("time", F.lit("-")), "kind", "key").alias("value"))


def summary_text(counters: Iterable) -> str:
    """Ingest counters (signal, accepted, rejected) as lines."""
    return "".join(f"{r.signal}: {r.accepted} accepted, {r.rejected} rejected\n" for r in sorted(counters))


def _with_intent(arguments: dict) -> dict:
    """``arguments`` with the parts of their intent: a question, a hypothesis or both, and said once."""
    if "intent" not in arguments:
        return arguments
    intent, rest = arguments["intent"], {k: v for k, v in arguments.items() if k != "intent"}
    known = QUERY_SCHEMA["properties"]["intent"]["properties"]
    if not isinstance(intent, dict) or not intent or set(intent) - set(known) or set(intent) & set(rest):
        raise bundle.QueryError("invalid_arguments", "intent must be an object with a question, a hypothesis or both, given once")
    return rest | intent


def answer(spark: SparkSession, arguments: dict) -> list[dict]:
    """The tool's result; raises :class:`evidra.plans.bundle.QueryError` with a code a caller can act on."""
    extra = set(arguments) - set(QUERY_SCHEMA["properties"])
    if extra or not isinstance(arguments.get("folder"), str) or not arguments["folder"].strip():
        raise bundle.QueryError("invalid_arguments", f"unknown or missing arguments: {sorted(extra) or ['folder']}")
    arguments = _with_intent(arguments)
    kinds = {"integer": int, "boolean": bool, "string": str, "array": list}
    for name, value in arguments.items():
        want = kinds[QUERY_SCHEMA["properties"][name]["type"]]
        if type(value) is not want:
            raise bundle.QueryError("invalid_arguments", f"{name} must be {want.__name__}")
        if want is list and not all(isinstance(x, str) for x in value):
            raise bundle.QueryError("invalid_arguments", f"{name} must be a list of str")
    query = bundle.EvidenceQuery(**{k: tuple(v) if isinstance(v, list) else v for k, v in arguments.items() if k != "folder"}).checked()
    try:
        found = incidents.read(spark, arguments["folder"])
        rows = bundle_json(bundle.get_evidence_bundle(found, query)).collect()  # one row an incident of the folder asked for
    except bundle.QueryError:
        raise
    except Exception as e:
        code = "not_found" if "PATH_NOT_FOUND" in str(e) else "malformed_input" if "FAILFAST" in str(e) or "MALFORMED" in str(e) else "internal"
        raise bundle.QueryError(code, str(e).splitlines()[0]) from e
    if not rows:
        raise bundle.QueryError("unsatisfied_requirement", "no evidence fits the budget")
    return [json.loads(r.json) for r in rows]


def respond(line: str, call: Callable[[dict], list[dict]]) -> str | None:
    """The response line to a request line; none to a notification."""
    try:
        message = json.loads(line)
    except ValueError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "not JSON"}})
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": REQUEST, "message": "not a request"}})
    if "id" not in message:
        return None
    method, params = message["method"], message.get("params") or {}
    out: dict = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        out["result"] = {"capabilities": {"tools": {}}, "serverInfo": {"name": "evidra"}}
    elif method == "tools/list":
        out["result"] = {"tools": [{"name": TOOL, "description": "Ranked causes and budgeted evidence of incidents.", "inputSchema": QUERY_SCHEMA}]}
    elif method != "tools/call":
        out["error"] = {"code": METHOD, "message": f"unknown method {method}"}
    elif not isinstance(params, dict) or params.get("name") != TOOL or not isinstance(params.get("arguments", {}), dict):
        out["error"] = {"code": PARAMS, "message": "unknown tool or arguments"}
    else:
        try:
            got = call(params.get("arguments", {}))
            out["result"] = {"content": [{"type": "text", "text": json.dumps(got)}], "structuredContent": {"incidents": got}, "isError": False}
        except bundle.QueryError as e:
            out["result"] = {"content": [{"type": "text", "text": str(e)}], "structuredContent": {"code": e.code}, "isError": True}
    return json.dumps(out)


def serve(spark: SparkSession, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if line.strip() and (reply := respond(line, lambda a: answer(spark, a))):
            print(reply, file=out, flush=True)
