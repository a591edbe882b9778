"""What many questions find, counted and chosen without the pairs, against the pairs."""

import random

from pyspark.sql import functions as F

from evidra.operators import intervals

Q = "question_id long, start timestamp_ntz, end timestamp_ntz, entities array<string>, kinds array<string>, max_items int, max_tokens int"
R = "id long, start timestamp_ntz, end timestamp_ntz, entities array<string>, kind string, token_cost long"


def tables(spark, n, seed):
    from datetime import datetime, timedelta

    r = random.Random(seed)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    some = lambda: r.choice([None, [], ["a"], ["b", "c"], ["a", "c"]])
    span = lambda longest: (s := r.randrange(40) * 1800, s + r.randrange(longest) * 900 - 900 * (r.random() < 0.1))
    q = [(i, *map(at, span(60)), some(), r.choice([None, [], ["x"], ["x", "y"]]), r.randrange(5), r.randrange(60)) for i in range(n)]
    rec = [(i * 7919 % 10007, *map(at, span(12)), some(), r.choice(["x", "y", None]), r.randrange(1, 40)) for i in range(n)]
    rec += [(20000 + i, None, at(0), ["a"], "x", 1) for i in range(2)] + [(30000, at(0), at(10**8), ["a"], "x", 30)]
    ts = lambda df: df.withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    return ts(spark.createDataFrame(q, Q)), ts(spark.createDataFrame(rec, R))


def test_as_the_pairs_say(spark):
    q, r = tables(spark, 300, 4)
    pairs = intervals.asked(q.drop("max_items", "max_tokens"), r)
    want = pairs.groupBy("question_id").agg(F.count("*"), F.sum("id"), F.count_distinct("kind")).collect()
    assert sorted(map(tuple, intervals.tallied(q, r, width=1800).collect())) == sorted(map(tuple, want))
    picked = intervals.budgeted(q.drop("kinds"), pairs, ["token_cost", "id"]).where("selected").select("question_id", "id", "token_cost").collect()
    assert sorted(map(tuple, intervals.chosen(q, r, ["token_cost", "id"], width=1800).collect())) == sorted(map(tuple, picked))
    later = intervals.budgeted(q.drop("kinds"), pairs, ["id"]).where("selected").select("question_id", "id", "token_cost").collect()
    assert sorted(map(tuple, intervals.chosen(q, r, ["id"]).collect())) == sorted(map(tuple, later))


def test_all_over_one_another(spark):
    """Four hundred million pairs, which are not made."""
    hour = lambda n: F.timestamp_seconds(F.lit(n * 3600))
    ids, every = spark.range(20_000), F.array().cast("array<string>")
    q = ids.select(F.col("id").alias("question_id"), hour(1).alias("start"), hour(3).alias("end"), every.alias("entities"), every.alias("kinds"), F.lit(3).alias("max_items"), F.lit(40).alias("max_tokens"))
    r = ids.select("id", hour(2).alias("start"), hour(4).alias("end"), every.alias("entities"), F.lit("x").alias("kind"), (20 - F.col("id") % 10).alias("token_cost"))
    t = intervals.tallied(q, r)
    assert t.agg(F.count("*"), F.min("n_records"), F.max("ids")).first()[:] == (20_000, 20_000, 199_990_000)
    got = intervals.chosen(q, r, ["id"]).groupBy("question_id").agg(F.sum("token_cost").alias("c"), F.array_sort(F.collect_list("id")).alias("i")).select("c", "i").distinct().collect()
    assert [tuple(x) for x in got] == [(39, [0, 1])]
