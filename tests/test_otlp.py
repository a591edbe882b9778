"""OTLP ingest: a small document, and what must be refused."""

import json

from evidra.sources import otlp


def doc(**parts):
    return json.dumps(parts)


def attrs(**kv):
    return [{"key": k.replace("_", "."), "value": {"stringValue": v}} for k, v in kv.items()]


def test_ingest(spark):
    t, s = "a" * 32, "b" * 16
    good = doc(
        resourceSpans=[{"resource": {"attributes": attrs(service_name="shop")}, "scopeSpans": [{"spans": [{"traceId": t.upper(), "spanId": s, "name": "x", "kind": 2, "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000001000000000", "status": {"code": 2}}, {"traceId": "zz", "spanId": s, "name": "bad"}]}]}],
        resourceMetrics=[{"resource": {"attributes": attrs(service_name="shop")}, "scopeMetrics": [{"metrics": [{"name": "m", "sum": {"dataPoints": [{"timeUnixNano": "1700000000000000000", "asInt": "3"}, {"asDouble": 1.0}]}}, {"name": "h", "histogram": {}}]}]}],
        resourceLogs=[{"resource": {}, "scopeLogs": [{"logRecords": [{"observedTimeUnixNano": "1700000000000000000", "severityText": "ERROR", "body": {"stringValue": "no"}}]}]}],
    )
    r = otlp.ingest(spark.createDataFrame([("1", good), ("2", "{}")], "doc string, json string"))
    span = r.spans.collect()
    assert len(span) == 1 and span[0].trace_id == t and span[0].status == "ERROR" and span[0].entity == "service:shop"
    assert [(x.name, x.v) for x in r.points.collect()] == [("m", 3.0)]
    log = r.logs.first()
    assert log.body == "no" and log.severity == "ERROR" and log.entity_quality == "missing"
    problems = sorted((x.signal, x.problem) for x in r.issues.collect())
    assert problems == [("document", "envelope"), ("metric_point", "points"), ("metric_point", "time"), ("span", "end"), ("span", "start"), ("span", "trace_id")]


def test_attribute_values(spark):
    from pyspark.sql import functions as F

    cases = {'{"stringValue":"a"}': "a", '{"intValue":"5"}': "5", '{"boolValue":true}': "true", '{"arrayValue":{"values":[{"stringValue":"a"},{"intValue":1}]}}': '["a","1"]', '{"kvlistValue":{"values":[{"key":"k","value":{"stringValue":"v"}}]}}': '{"k":"v"}'}
    df = spark.createDataFrame(list(cases.items()), "j string, w string").select("j", "w", otlp.any_value(F.col("j")).alias("g"))
    assert [(r.j, r.g) for r in df.collect() if r.g != r.w] == []


def test_attribute_values_cost(spark):
    """A value's text is made once, however often its parts are looked at, and work is dealt by rows."""
    from pyspark.sql import functions as F

    def plan(c):
        return spark.range(5).select(c.alias("v"))._jdf.queryExecution().optimizedPlan().toString()

    assert plan(otlp.any_value(F.concat(F.lit("MADE"), F.col("id").cast("string")))).count("MADE") == 1
    escaped = spark.range(1).select(otlp.any_value(F.lit('{"string\\u0056alue":"a"}'))).first()[0]
    assert escaped == "a"
    from evidra.plans import catalogue

    assert catalogue.queries()["attribute_values"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_files_and_repeated_keys(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "a.json").write_text(doc(resourceLogs=[{"resource": {"attributes": attrs(service_name="x") + attrs(service_name="y") + [{"key": None, "value": {"stringValue": "z"}}]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "1700000000000000000", "body": {"stringValue": "b"}}]}]}]))
    (tmp_path / "b.json").write_text("{}")
    docs = otlp.read_files(spark, f"{tmp_path}/a.json", f"{tmp_path}/b.json")
    r = otlp.ingest(docs)
    assert [x.entity for x in r.logs.collect()] == ["service:y"]  # the last of equal keys counts
    assert {(x.signal, x.accepted, x.rejected) for x in r.counters().collect()} == {("resource", 1, 0), ("span", 0, 0), ("metric_point", 0, 0), ("log", 1, 0)}
    many = spark.createDataFrame([(1,)], "i int").select(otlp.attribute_map(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda k: F.struct((k % 1500).cast("string").alias("key"), F.concat(F.lit('{"intValue":"'), k.cast("string"), F.lit('"}')).alias("value")))).alias("m"))
    m = many.first().m
    assert len(m) == 1500 and m["7"] == "1507"


def test_values_of_any_depth(spark):
    from pyspark.sql import functions as F

    def wrap(v):
        if isinstance(v, list):
            return {"arrayValue": {"values": [wrap(x) for x in v]}}
        if isinstance(v, dict):
            return {"kvlistValue": {"values": [{"value": wrap(x), "key": k} for k, x in v.items()]}}
        return {"stringValue": v} if isinstance(v, str) else {"intValue": v}

    def plain(v):
        return [plain(x) for x in v] if isinstance(v, list) else {k: plain(x) for k, x in sorted(v.items())} if isinstance(v, dict) else str(v)

    deep = "x"
    for k in range(50):
        deep = [deep] if k % 2 else {"k": deep}
    values = [["a", 1], {"b": 1, "a": ["x,[{", 'y"q\\', "é \n"], "c": {}}, [], deep, {"key": {"value": "v", "values": []}}, [[], [[]]], {"long": ["n%d{" % k for k in range(9000)], "text": 'q"[\\' * 9000}, ["\ue000\ue005\ue009", "]}", {"\ue008": "{"}]]
    rows = [(json.dumps(wrap(v)), json.dumps(plain(v), separators=(",", ":"), ensure_ascii=False)) for v in values]
    rows += [(x, x) for x in ('{"arrayValue":{"values":[{"foo":[1]}]}}', '{"other":1}', '{"a":{"arrayValue":{}}}', "no json")] + [('{"arrayValue":{}}', "[]"), ('{"kvlistValue":{}}', "{}")]
    got = spark.createDataFrame(rows, "j string, w string").select("w", otlp.any_value(F.col("j")).alias("g")).collect()
    assert [(r.w, r.g) for r in got if r.w != r.g] == []


def test_one_nanosecond_apart(spark):
    t = "c" * 32
    spans = [{"traceId": t, "spanId": f"{k:016x}", "startTimeUnixNano": f"170000000000000000{k}", "endTimeUnixNano": f"170000000000000000{k}"} for k in (1, 2)]
    r = otlp.ingest(spark.createDataFrame([("1", doc(resourceSpans=[{"resource": {}, "scopeSpans": [{"spans": spans}]}]))], "doc string, json string"))
    got = sorted((x.start_ns, x.end_ns, x.start) for x in r.spans.collect())
    assert [x[:2] for x in got] == [(1700000000000000001,) * 2, (1700000000000000002,) * 2] and got[0][2] == got[1][2]


def test_canonical_json_and_its_cost(spark):
    from pyspark.sql import functions as F

    from evidra.functions import json_text, scores

    given = {"z": [{"b": 1, "a": {"d": 0.25, "c": None}}], "a": "é\"", "m": {"y": True, "x": []}}
    want = json.dumps(given, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    r = spark.createDataFrame([(json.dumps(given, indent=2),), ("{no",)], "j string").select(json_text.canonical_text(F.col("j")).alias("c")).withColumn("n", scores.token_cost(F.col("c"))).collect()
    assert (r[0].c, r[0].n) == (want, -(-len(want.encode()) // 4)) and r[1].c is None
