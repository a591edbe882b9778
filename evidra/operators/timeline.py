"""Timeline events, their markers, and anomalies related to a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import times
from evidra.operators import store

# The order of markers within a minute, and of relations in a list.
MARKER_ORDER = {"change": 0, "trigger": 0, "amplification": 1, "symptom": 2, "propagation": 3, "recovery": 4, "non-causal-change": 5, "data-gap": 6}
RELATION_ORDER = {"amplifier": 0, "downstream-dependency": 1, "load-amplification": 2, "recurring-signature": 3}
TRIGGER_KINDS = ("traffic_shift", "job_start", "external_event", "infrastructure_event")


def _rank(column: Column, order: dict[str, int], other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), column), F.lit(other))


def relation_rank(relation: Column) -> Column:
    """The place of a relation in a list."""
    return _rank(relation, RELATION_ORDER, 4)


def propagated(windows: DataFrame, edges: DataFrame) -> DataFrame:
    """Latency windows of an entity that depends on one whose anomaly began earlier.

    The inequality is tested against each dependency's earliest start, so an entity's windows are never paired with all others.
    """
    down = edges.where(F.col("type").isin("calls", "reads-from", "depends-on")).select("incident_id", F.col("src").alias("entity"), F.col("dst"))
    first = windows.groupBy("incident_id", F.col("entity").alias("dst")).agg(F.min("start").alias("dst_start"))
    earliest = down.join(first, ["incident_id", "dst"]).groupBy("incident_id", "entity").agg(F.min("dst_start").alias("dst_start"))
    slow = windows.where(F.col("name").contains("duration") | F.col("name").contains("latency"))
    return slow.join(earliest, ["incident_id", "entity"]).where(F.col("dst_start") < F.col("start")).drop("dst_start")


def window_events(windows: DataFrame, edges: DataFrame) -> DataFrame:
    """A timeline event at each anomaly window's start: amplification before propagation before symptom."""
    keys = ["incident_id", "name", "entity"]
    retriers = edges.where("type = 'retries'").select("incident_id", F.col("src").alias("entity")).distinct().withColumn("_retries", F.lit(True))
    later = propagated(windows, edges).select(*keys).distinct().withColumn("_later", F.lit(True))
    j = windows.join(retriers, ["incident_id", "entity"], "left").join(later, keys, "left")
    marker = F.when(F.col("name").contains("retry") & F.col("_retries"), "amplification").when(F.col("_later"), "propagation").otherwise("symptom")
    return j.select("incident_id", F.col("start").alias("t"), marker.alias("marker"), "entity", F.concat_ws("@", "name", "entity").alias("source_ref"))


def change_events(changes: DataFrame, windows: DataFrame) -> DataFrame:
    """Changes as triggers or changes; one after the onset on an entity without an anomaly is no cause."""
    onset = windows.groupBy("incident_id").agg(F.min("start").alias("onset"))
    active = windows.select("incident_id", "entity").distinct().withColumn("_active", F.lit(True))
    j = changes.join(onset, "incident_id", "left").join(active, ["incident_id", "entity"], "left")
    late = (F.col("t") > F.col("onset")) & F.col("_active").isNull()
    marker = F.when(F.coalesce(late, F.lit(False)), "non-causal-change").when(F.col("kind").isin(*TRIGGER_KINDS), "trigger").otherwise("change")
    return j.select("incident_id", "t", marker.alias("marker"), "entity", F.col("change_id").alias("source_ref"))


def recovery_events(windows: DataFrame) -> DataFrame:
    return windows.where("recovery is not null").select("incident_id", F.col("recovery").alias("t"), F.lit("recovery").alias("marker"), "entity", F.concat_ws("@", "name", "entity").alias("source_ref"))


def gap_events(gaps: DataFrame) -> DataFrame:
    return gaps.select("incident_id", F.col("start").alias("t"), F.lit("data-gap").alias("marker"), "entity", F.col("gap_id").alias("source_ref"))


def error_log_events(logs: DataFrame) -> DataFrame:
    """The first ERROR of each entity, ties to the one stored first."""
    w = Window.partitionBy("incident_id", "entity").orderBy("t", "seq")
    first = logs.where("severity = 'ERROR'").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.select("incident_id", "t", F.lit("symptom").alias("marker"), "entity", F.col("log_id").alias("source_ref"))


def ordered(events: DataFrame) -> DataFrame:
    """Events by minute, marker, time, entity and reference, each once, with their position."""
    own = events.where("t is not null and trim(source_ref) <> ''").distinct()
    own = own.withColumns({"_minute": times.floor_minute(F.col("t")), "_rank": _rank(F.col("marker"), MARKER_ORDER, 9)})
    return store.ranked(own, ["incident_id"], ["_minute", "_rank", "t", "entity", "source_ref", "marker"], "position").drop("_minute", "_rank")


def related(windows: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Anomalies of entities a seed reads from or depends on, and those that amplify it; with the lag in seconds.

    ``windows`` and ``seeds`` are (incident_id, id, entity, name, start).
    """
    s = seeds.select("incident_id", F.col("id").alias("seed"), F.col("entity").alias("seed_entity"), F.col("start").alias("seed_start"))
    w = windows.select("incident_id", "id", "entity", "name", "start")
    down = edges.where(F.col("type").isin("reads-from", "depends-on")).select("incident_id", F.col("src").alias("seed_entity"), F.col("dst").alias("entity"))
    up = edges.where("type = 'retries'").select("incident_id", F.col("dst").alias("seed_entity"), F.col("src").alias("entity"))
    below = s.join(down, ["incident_id", "seed_entity"]).join(w, ["incident_id", "entity"]).where("id <> seed").withColumn("relation", F.lit("downstream-dependency"))
    above = s.join(up, ["incident_id", "seed_entity"]).join(w, ["incident_id", "entity"]).where(F.col("name").contains("retry")).withColumn("relation", F.lit("amplifier"))
    load = s.join(up.select("incident_id", "seed_entity").distinct(), ["incident_id", "seed_entity"]).withColumn("entity", F.col("seed_entity")).join(w, ["incident_id", "entity"]).where("name = 'request.rate_rps' and id <> seed").withColumn("relation", F.lit("load-amplification"))
    cols = ["incident_id", "seed", "id", "entity", "relation", "seed_start", "start"]
    rows = below.select(*cols).unionByName(above.select(*cols)).unionByName(load.select(*cols)).distinct()
    rows = rows.withColumn("lag_seconds", times.lag_seconds(F.col("seed_start"), F.col("start")))
    order = Window.partitionBy("incident_id", "seed").orderBy(_rank(F.col("relation"), RELATION_ORDER, 4), F.asc_nulls_first("id"))
    return rows.withColumn("position", F.row_number().over(order)).drop("seed_start", "start")


def recurring(windows: DataFrame, priors: DataFrame) -> DataFrame:
    """Windows whose entity and signal match the signature of an earlier incident."""
    p = priors.select("incident_id", "prior_id", F.col("primary_entity").alias("entity"), F.lower("symptom").alias("symptom"))
    low = F.lower("name")
    kind = F.when(low.contains("duration") | low.contains("latency"), "latency").when(low.contains("error"), "error").otherwise(low)
    return windows.join(p, ["incident_id", "entity"]).where(F.col("symptom").contains(kind)).select("incident_id", "prior_id", "entity", "name", F.lit("recurring-signature").alias("relation"))
