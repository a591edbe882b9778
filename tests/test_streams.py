"""Overlapping intervals against all pairs; keyed state, expiry, late rows and waiting references over crafted batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidra.operators import intervals
from evidra.streaming import incremental, stateful

T0 = datetime(2026, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def in_batches(spark, folder, schema, batches):
    """A stream with one file a batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(3)

    def some(n, name):
        rows = [(f"{name}{k}", rng.choice("ab"), at(s := rng.randrange(-3000, 3000)), at(s + rng.choice([0, 0, 1, 59, 60, 61, 240, 5000, 100_000]))) for k in range(n)]
        return rows + [(f"{name}n", "a", None, at(1)), (f"{name}m", "a", at(1), None), (f"{name}r", "a", at(10), at(5)), (f"{name}x", None, at(0), at(9)), (f"{name}0", "a", at(0), at(0))]

    left, right = some(120, "l"), some(150, "r")
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[1] and None not in (*a, *b) and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3])
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} string, k string, start timestamp, end timestamp").repartition(3)
    got = sorted((r.l, r.r) for r in intervals.overlap_join(df(left, "l"), df(right, "r"), ["k"]).collect())
    assert got == want and len(want) > 1000
    assert intervals.overlap_join(df(left, "l").limit(0), df(right, "r"), ["k"]).count() == 0
    binned = intervals._binned(df(right, "r").withColumnsRenamed({"start": "r_start", "end": "r_end"}), "r_start", "r_end", 3600, "r")
    assert binned.agg(F.max("_r")).first()[0] <= 8, "long intervals go to wide bins instead of into thousands of narrow ones"


def test_questions_without_windows_or_lists(spark):
    q = spark.createDataFrame([("w", "i", at(0), at(10), ["e"], None), ("all", "i", None, None, [], ["k"]), ("none", "j", at(0), at(1), None, None)], "question_id string, incident_id string, start timestamp, end timestamp, entities array<string>, kinds array<string>")
    r = spark.createDataFrame([(1, "i", at(5), at(5), ["e", "f"], "k"), (2, "i", at(50), at(60), ["e"], "x"), (3, "i", at(9), at(20), ["f"], "k"), (4, "i", at(0), at(90), None, "k")], "id long, incident_id string, start timestamp, end timestamp, entities array<string>, kind string")
    got = sorted((x.question_id, x.id) for x in intervals.asked(q, r, ["incident_id"]).collect())
    assert got == [("all", 1), ("all", 3), ("all", 4), ("w", 1)]


SCHEMA = "kind string, key string, payload string, grows boolean, seq long, t timestamp"


def test_outcomes_and_expiry(spark, tmp_path):
    batches = [
        [("series", "a", "ms", True, 2, at(2)), ("series", "a", "ms", True, 1, at(1)), ("log", "x", "p", False, 3, at(1)), ("log", "x", "p", False, 4, at(2)), ("log", None, "p", False, 5, at(2))],
        [("series", "a", "ms", True, 6, at(9)), ("series", "a", "s", True, 7, at(9)), ("log", "x", "q", False, 8, at(9)), ("log", None, "p", False, 9, at(9)), ("log", "y", None, False, 10, at(9)), ("log", "y", None, False, 11, at(9))],
        [("series", "b", "ms", True, 12, at(500))],
        [("series", "a", "s", True, 13, at(501)), ("series", "a", "s", True, 14, at(502))],
    ]
    with stateful.rocks(spark):
        out = incremental.run_to_end(stateful.ingest_outcomes(in_batches(spark, tmp_path / "in", SCHEMA, batches[:2])), "append", "plain")
    total = {(r.kind, r.key): (r.i, r.u, r.d, r.c) for r in out.groupBy("kind", "key").agg(F.sum("inserted").alias("i"), F.sum("updated").alias("u"), F.sum("duplicates").alias("d"), F.sum("conflicts").alias("c")).collect()}
    assert total == {("series", "a"): (1, 2, 0, 1), ("log", "x"): (1, 0, 1, 1), ("log", None): (1, 0, 1, 0), ("log", "y"): (1, 0, 1, 0)}
    widest = out.where("kind = 'series'").orderBy(F.desc("n")).first()
    assert (widest.n, widest.first_t, widest.last_t) == (3, at(1), at(9))
    with stateful.rocks(spark):
        out = incremental.run_to_end(stateful.ingest_outcomes(in_batches(spark, tmp_path / "idle", SCHEMA, batches), idle=3600), "append", "idle")
    gone = {(r.kind, r.key): (r.n, r.last_t) for r in out.where("expired = 1").collect()}
    assert gone[("series", "a")] == (3, at(9)) and ("series", "b") not in gone and len(gone) == 4
    again = out.where("kind = 'series' and key = 'a' and expired = 0").orderBy(F.desc("last_t")).first()
    assert (again.inserted, again.updated, again.n, again.first_t) == (1, 1, 2, at(501)), "a key that was closed begins anew"


def test_references_wait_and_are_given_up(spark, tmp_path):
    refs = in_batches(spark, tmp_path / "refs", "ref_id string, key string, ref_t timestamp", [[("early", "k1", at(0)), ("never", "k2", at(1))], [("later", "k3", at(100)), ("open", "k4", at(999))], [("end", "k9", at(1000))]])
    records = in_batches(spark, tmp_path / "records", "key string, record_id string, record_t timestamp", [[("k3", "r3", at(95))], [("k1", "r1", at(20)), ("k2", "far", at(300))], [("k8", "r8", at(1000))]])
    out = incremental.run_to_end(stateful.resolve_as_they_arrive(refs, records, "30 minutes", "300 minutes"), "append", "refs")
    assert sorted((r.ref_id, r.record_id) for r in out.collect()) == [("early", "r1"), ("later", "r3"), ("never", None)]


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    rows = lambda *minutes: [("n", "e", at(m), 1.0) for m in minutes]
    stream = in_batches(spark, tmp_path / "p", "name string, entity string, t timestamp, v double", [rows(1, 5, 70), rows(3, 61, 200), rows(2, 201, 400)])
    w = incremental.windowed(stream, "60 minutes", "10 minutes").select("window", "name", "entity", "n_points", "v")
    got = {(r.window.start, r.n_points) for r in incremental.run_to_end(w, "append", "late").collect()}
    # The first batch moves the watermark to minute 60, which closes a window with the batch after it: minute 3 is in time, minute 2 is not.
    assert got == {(at(0), 3), (at(60), 2), (at(180), 2)}
