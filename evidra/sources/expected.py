"""Expected results of incidents (``expected.json``) as tables.  Only comparisons read them; nothing is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import times
from evidra.sources import incidents

_WINDOW = "STRUCT<start: STRING, `end`: STRING>"
EXPECTED = f"""
entities ARRAY<STRUCT<id: STRING, kind: STRING, confidence: DOUBLE>>,
relationships ARRAY<STRUCT<src: STRING, type: STRING, dst: STRING, confidence: DOUBLE>>,
anomaly_windows ARRAY<STRUCT<id: STRING, entity: STRING, signal: STRING, start: STRING, `end`: STRING, baseline: DOUBLE, peak: DOUBLE, trough: DOUBLE, detector_confidence: DOUBLE, note: STRING>>,
log_patterns ARRAY<STRUCT<id: STRING, template: STRING, entity: STRING, severity: STRING, first_seen: STRING, last_seen: STRING, count: LONG, exemplars: ARRAY<STRING>, stability: STRING>>,
timeline ARRAY<STRUCT<t: STRING, marker: STRING, entity: STRING, text: STRING, source_ref: STRING>>,
related_anomalies STRUCT<seed: STRING, related: ARRAY<STRUCT<window: STRING, relation: STRING, lag_seconds: LONG, prior_incident: STRING, similarity: DOUBLE, note: STRING>>>,
window_comparison STRUCT<healthy: {_WINDOW}, anomalous: {_WINDOW}, deltas: ARRAY<STRUCT<entity: STRING, signal: STRING, `from`: DOUBLE, `to`: DOUBLE, factor: DOUBLE, note: STRING>>>,
suspected_causes ARRAY<STRUCT<rank: INT, entity: STRING, score: DOUBLE>>,
next_checks ARRAY<STRUCT<action: STRING, expected_signal: STRING>>
"""


@dataclass
class Expected:
    """Typed tables of what any number of incidents should give; ``cases`` are the incidents that say anything."""

    cases: DataFrame
    entities: DataFrame
    edges: DataFrame
    windows: DataFrame
    patterns: DataFrame
    timeline: DataFrame
    related: DataFrame
    comparison: DataFrame
    causes: DataFrame
    checks: DataFrame


def typed(rows: DataFrame) -> Expected:
    """Tables from rows of incident_id and the EXPECTED columns; places in lists count from 1."""

    def each(column: str) -> DataFrame:
        return rows.select("incident_id", F.posexplode(column).alias("_p", "x")).select("incident_id", (F.col("_p") + 1).alias("position"), "x.*")

    def at(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumns({c: times.parse(F.col(c)) for c in columns})

    bound = {f"{w}_{e}": times.parse(F.col(f"window_comparison.{w}.{e}")) for w in ("healthy", "anomalous") for e in ("start", "end")}
    deltas = rows.select("incident_id", *(v.alias(k) for k, v in bound.items()), F.posexplode("window_comparison.deltas").alias("_p", "x"))
    deltas = deltas.select("incident_id", *bound, "x.entity", "x.signal", F.col("x.from").alias("from_v"), F.col("x.to").alias("to_v"), "x.factor", "x.note")
    related = rows.select("incident_id", F.col("related_anomalies.seed").alias("seed"), F.explode("related_anomalies.related").alias("x")).select("incident_id", "seed", "x.*")
    return Expected(
        rows.select("incident_id").distinct(), each("entities"), each("relationships"), at(each("anomaly_windows"), "start", "end").withColumnRenamed("signal", "name"), at(each("log_patterns"), "first_seen", "last_seen"),
        at(each("timeline"), "t"), related, deltas, each("suspected_causes"), each("next_checks"),
    )


def read(spark: SparkSession, folder: str) -> Expected:
    """What every incident below a folder should give, of those with a readable ``expected.json``."""
    return typed(incidents.files(spark, folder, "expected.json", EXPECTED).where("_bad is null").drop("_bad"))
