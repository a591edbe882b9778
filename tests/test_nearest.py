"""The as-of join against its definition, and where all rows share one bucket."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidra.operators import series


def test_nearest_before(spark):
    r = random.Random(8)
    at = lambda: datetime(2024, 1, 1) + timedelta(seconds=r.randrange(40_000) * 1.5)
    left = [(r.choice("ab"), i % 90, at() if i else None) for i in range(100)] * 2
    right = [(r.choice("ab"), at()) for _ in range(40)] + [("a", None), *((x[0], x[2]) for x in left[:5])]
    got = series.nearest_before(spark.createDataFrame(left, "k string, id long, t timestamp"), spark.createDataFrame(right, "k string, t timestamp"), 30, ["k"]).collect()
    floor = lambda t: t.replace(second=0, microsecond=0)
    near = lambda k, t: max((u for h, u in right if t and u and h == k and u <= t and (floor(t) - floor(u)).total_seconds() <= 1800), default=None)
    want = [(k, i, t, (n := near(k, t)) and floor(n)) for k, i, t in left]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_nearest_in_one_bucket(spark):
    """Forty thousand rows on each side of three hours: 1.6 billion pairs, which are not made."""
    rows = spark.range(40_000).select("id", F.timestamp_seconds(F.lit(10860 * 100) + F.col("id") % 10_000).alias("t"))
    assert series.nearest_before(rows, rows.select("t"), 180).where("nearest_t = date_trunc('minute', t)").count() == 40_000
