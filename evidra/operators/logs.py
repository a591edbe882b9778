"""Log patterns: templates clustered by entity and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import text
from evidra.operators import store

GROUP = ["incident_id", "entity", "severity", "template"]


def log_patterns(logs: DataFrame) -> DataFrame:
    """Clusters of logs (incident_id, log_id, t, entity, severity, body, seq): id, count, first and last time, exemplars, stability."""
    kept = logs.where(text.worth_a_pattern(F.col("severity"), F.col("body"))).withColumn("template", text.log_template(F.col("body")))
    g = kept.groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.min(F.struct("t", "log_id")).alias("a"), F.max(F.struct("t", "log_id")).alias("z"), F.min("seq").alias("first_seq")
    )
    stability = text.pattern_stability(F.col("template"), F.col("n"))
    with_last = (F.col("n") >= 3) | (stability == "recurring-each-cycle") | F.col("template").contains("attempt <n>/")
    exemplars = F.when(with_last & (F.col("a.log_id") != F.col("z.log_id")), F.array("a.log_id", "z.log_id")).otherwise(F.array("a.log_id"))
    out = g.select(*GROUP, F.col("n").alias("count"), F.col("a.t").alias("first_seen"), F.col("z.t").alias("last_seen"), exemplars.alias("exemplars"), stability.alias("stability"), "first_seq")
    return store.numbered(out, ["incident_id"], ["first_seen", "entity", "severity", "template", "first_seq"], "id", "lp-%d").drop("first_seq")
