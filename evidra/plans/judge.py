"""Whole answers against expected ones: every difference of every section is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import text
from evidra.operators import compare
from evidra.operators.compare import Field
from evidra.plans import bundle
from evidra.plans.lineage import cut
from evidra.sources.expected import Expected
from evidra.sources.incidents import Incidents

UNDER_DETERMINED = "under-determined"
#: Identity and compared columns of each section.
SECTIONS = {
    "entities": (["id"], [Field("kind"), Field("confidence", "unit")]),
    "relationships": (["src", "type", "dst"], [Field("confidence", "unit")]),
    "anomaly_windows": (["id"], [Field("entity"), Field("name"), Field("start"), Field("end"), Field("baseline", "number"), Field("peak", "number"), Field("trough", "number"), Field("detector_confidence", "unit"), Field("note", "text")]),
    "log_patterns": (["entity", "severity", "template"], [Field("id", "text"), Field("first_seen"), Field("last_seen"), Field("count"), Field("exemplars", "set"), Field("stability")]),
    "timeline": (["t", "marker", "entity", "source_ref"], [Field("text", "text")]),
    "related_anomalies": (["window", "prior_incident"], [Field("seed"), Field("relation"), Field("lag_seconds"), Field("similarity", "unit"), Field("note", "text")]),
    "window_comparison": (["entity", "signal"], [Field("from_v", "number"), Field("to_v", "number"), Field("factor", "number"), Field("healthy_start"), Field("healthy_end"), Field("anomalous_start"), Field("anomalous_end"), Field("note", "text")]),
}


def context_differences(x: Expected, i: Incidents, d: bundle.Derived) -> DataFrame:
    """(incident_id, path, problem, expected, actual) over what is derived: missing, extra, differs, wording or order."""
    timeline = cut(bundle.build_timeline(i, d))
    sides = {
        "entities": (x.entities, d.entities), "relationships": (x.edges, d.edges), "anomaly_windows": (x.windows, d.windows), "log_patterns": (x.patterns, d.patterns), "timeline": (x.timeline, timeline),
        "related_anomalies": (x.related, bundle.find_related_anomalies(i, d)), "window_comparison": (x.comparison, bundle.compare_windows(i, d=d)),
    }
    out = None
    for section, (keys, fields) in SECTIONS.items():
        expected, actual = sides[section]
        rows = compare.differences(expected, actual.join(x.cases, "incident_id", "left_semi"), section, keys, fields)
        out = rows if out is None else out.unionByName(rows)
    return out.unionByName(compare.out_of_order(x.timeline, timeline, "timeline", SECTIONS["timeline"][0]))


def answer_differences(x: Expected, b: bundle.Bundle) -> DataFrame:
    """Differences of ranked causes and next checks.

    A cause is missing only where it is the first expected and the answer is not that nothing can be told; further expected causes are
    examples.  Checks differ where no kind of check that is expected was suggested.
    """
    keys, fields = ["entity"], [Field("rank"), Field("score", "unit")]
    causes = compare.differences(x.causes, b.causes.join(x.cases, "incident_id", "left_semi"), "suspected_causes", keys, fields, extra=False)
    first = x.causes.where("rank = 1").select("incident_id", F.col("entity").alias("expected"))
    unsure = b.causes.where((F.col("rank") == 1) & (F.col("entity") == UNDER_DETERMINED)).select("incident_id").distinct()
    lacking = causes.where("problem = 'missing'").join(first, ["incident_id", "expected"], "left_semi").join(unsure, "incident_id", "left_anti")
    told = causes.where("problem <> 'missing'").unionByName(lacking)
    signal = text.check_signal(F.col("expected_signal")).alias("signal")
    wanted, given = x.checks.select("incident_id", signal).distinct(), b.checks.select("incident_id", signal).distinct()
    met = wanted.join(given, ["incident_id", "signal"], "left_semi").select("incident_id").distinct()
    none = wanted.join(met, "incident_id", "left_anti").groupBy("incident_id").agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("expected"))
    return told.unionByName(none.select("incident_id", F.lit("$.next_checks").alias("path"), F.lit("missing").alias("problem"), "expected", F.lit(None).cast("string").alias("actual")))
