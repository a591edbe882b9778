"""Exact values of the text, time and scoring rules."""

import math

from pyspark.sql import functions as F

from evidra.functions import scores, text, times
from evidra.operators import evidence, store


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_templates(spark):
    cases = {
        "12 transactions waiting on lock": "<n> transactions waiting on lock",
        "attempt 1/5 then attempt 2/5 (7)": "attempt <n>/5 then attempt 2/5 (<n>)",
        "attempt x then attempt 2/5": "attempt x then attempt 2/5",
        "größe (12) (x)": "größe (<n>) (x)",
    }
    df = spark.createDataFrame(list(cases.items()), "b string, t string")
    assert [r for r in df.where(text.log_template(F.col("b")) != F.col("t")).collect()] == []


def test_fnv(spark):
    r = one(spark, scores.fnv1a64(F.lit("a")), scores.fnv1a64(F.lit("")), scores.fnv1a64(F.lit("foobar")))
    assert list(r) == ["af63dc4c8601ec8c", "cbf29ce484222325", "85944171f73967e8"]


def test_times(spark):
    t = F.to_timestamp(F.lit("2026-01-01 10:05:59"))
    r = one(spark, times.minutes_between(t, F.to_timestamp(F.lit("2026-01-01 10:07:01"))), times.iso_second(times.shift_minutes(t, -2)), times.parse(F.lit("2026-01-01")), times.replay_key(F.lit("2026-01-01T00:00:00.5Z")), times.replay_key(F.lit("2026-01-01T00:00:00.Z")))
    assert r.c0 == 2 and r.c1 == "2026-01-01T10:03:00Z" and r.c2 is None and r.c3.nanos == 500_000_000 and r.c4 is None


def test_scores(spark):
    r = one(spark, scores.suspicion(F.lit(1.0), F.lit(0.0)), scores.suspicion(F.lit(0.0), F.lit(1.0)), scores.token_cost(F.lit("x" * 486)), scores.weighted((F.lit(1.0), 1.0), (F.lit(0.0), 3.0)), scores.ref_quality(F.lit(2), F.lit(2), F.lit(2)))
    assert math.isclose(r.c0, 1 - math.exp(-0.75)) and r.c1 == 0.05 and r.c2 == 122 and r.c3 == 0.25 and r.c4 == 1.0


def test_greedy_skips_what_does_not_fit(spark):
    rows = [("i", k, c) for k, c in enumerate([50, 60, 30, 25, 10])]
    df = spark.createDataFrame(rows, "g string, k int, token_cost int")
    got = {r.k: (r.selected, r.reason) for r in evidence.greedy_select(df, ["g"], ["k"], 3, 100).collect()}
    assert got == {0: (True, None), 1: (False, "max_tokens"), 2: (True, None), 3: (False, "max_tokens"), 4: (True, None)}


def test_fold_is_sequential():
    start = lambda s: {"support": s, "counter": 0.0, "supporting": ["c"], "counters": [], "reasons": set()}
    edges = [{"src": "a", "type": "calls", "dst": "b"}, {"src": "a", "type": "depends-on", "dst": "b"}, {"src": "b", "type": "reads-from", "dst": "c"}]
    t = evidence.fold_edges({"a": start(1.0)}, edges)
    assert math.isclose(t["a"]["support"], 0.2) and math.isclose(t["b"]["support"], 1.2 * 0.2) and math.isclose(t["c"]["support"], 1.44)
    t = evidence.fold_edges({"b": start(1.0)}, [{"src": "a", "type": "retries", "dst": "b"}])
    assert math.isclose(t["b"]["counter"], 0.9) and math.isclose(t["a"]["support"], 0.55) and math.isclose(t["b"]["support"], 0.45)


def test_reference_outcomes(spark):
    records = spark.createDataFrame([("k1", "log"), ("k2", "change"), ("k3", "log"), ("k3", "log"), ("t/1", "span")], "key string, kind string")
    refs = spark.createDataFrame([(1, "log", "k1"), (2, "log", "k2"), (3, "log", "k3"), (4, "log", "no"), (5, "profile", "k1"), (6, "trace", "trace:t/1")], "ref_id int, signal string, ref string")
    got = {r.ref_id: r.outcome for r in store.resolve_refs(refs, records).collect()}
    assert got == {1: "found", 2: "signal_mismatch", 3: "ambiguous", 4: "missing", 5: "unsupported", 6: "found"}
