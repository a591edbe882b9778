"""Replay of an incident's records as one ordered stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import times
from evidra.operators import store


def plan(events: DataFrame) -> DataFrame:
    """Events (incident_id, input_order, kind, key, time) with ``sequence`` from 0: untimed ones first, then by time
    to the nanosecond, ties in input order.  A malformed time is an issue and has no place."""
    timed = events.withColumn("_key", times.replay_key(F.col("time")))
    good = timed.where(F.col("time").isNull() | F.col("_key").isNotNull())
    good = good.withColumns({"_base": F.col("_key.base"), "_nanos": F.col("_key.nanos")}).drop("_key")
    placed = store.ranked(good, ["incident_id"], [F.asc_nulls_first("_base"), F.asc_nulls_first("_nanos"), "input_order"], "sequence")
    return placed.withColumn("sequence", F.col("sequence") - 1).drop("_base", "_nanos")


def malformed(events: DataFrame) -> DataFrame:
    return events.where(F.col("time").isNotNull() & times.replay_key(F.col("time")).isNull())


def audit(events: DataFrame, refs: DataFrame) -> DataFrame:
    """Per incident how many events of each kind there are, and how many references they leave open."""
    n = events.groupBy("incident_id", "kind").agg(F.count("*").alias("n_events"))
    keys = events.select("incident_id", F.col("key").alias("ref")).distinct()
    dangling = refs.join(keys, ["incident_id", "ref"], "left_anti").groupBy("incident_id").agg(F.count("*").alias("n_open"))
    return n.join(dangling, "incident_id", "left").withColumn("n_open", F.coalesce("n_open", F.lit(0).cast("long")))
