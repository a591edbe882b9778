"""Timelines by failure class: ordered selectors over one typed event stream.

A :class:`Pick` says which events of a class count (a source and patterns of columns), which of them is taken (the first
or all), what time it stands at and how it is marked.  A table of picks is compiled to one projection: every event meets
every rule once, and its matches are rows of (incident, rule).  The first of each is one hash aggregation with partial
results, so an incident of any size is never sorted or gathered; picks that follow another pick take a second pass over the
events that can still match.

The stream is (incident_id, failure_class, source, entity, kind, name, body, severity, status, error_type, root, named,
t, seq, ref, series_ref, minute, material_t, near_t, peak_t, recovery, until, other_entity, marker, text); see :data:`STREAM`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators import timeline

#: Columns of the event stream, with their types; a source fills those it has.
STREAM = {
    "incident_id": "string", "failure_class": "string", "source": "string", "entity": "string", "kind": "string", "name": "string", "body": "string", "severity": "string", "status": "string",
    "error_type": "string", "root": "boolean", "named": "boolean", "t": "timestamp", "seq": "long", "ref": "string", "series_ref": "string", "minute": "timestamp", "material_t": "timestamp", "near_t": "timestamp",
    "peak_t": "timestamp", "recovery": "timestamp", "until": "timestamp", "other_entity": "string", "marker": "string", "text": "string",
}
CHOSEN = ("t", "marker", "entity", "source_ref", "text")


@dataclass(frozen=True)
class Pick:
    """One selector.  ``where`` maps columns to patterns (a flag column to true or false), ``at`` names the column of the time (the event's own where it is null)."""

    rule: str
    classes: tuple[str, ...]
    source: str
    where: dict[str, str | bool] = field(default_factory=dict)
    marker: str = ""  #: empty: the event's own
    take: str = "first"
    at: str = "t"
    strict: bool = False  #: without a time in ``at`` there is no event
    after: str = ""  #: only events later than what this rule picked
    entity: str = "entity"
    ref: str = "ref"
    text: str = ""  #: a format of the name; empty: the event's own

    def matches(self) -> Column:
        ok = F.col("failure_class").isin(*self.classes) & (F.col("source") == self.source)
        for column, pattern in self.where.items():
            ok = ok & ((F.col(column) == pattern) if isinstance(pattern, bool) else F.col(column).rlike(pattern))
        if self.strict:
            ok = ok & F.col(self.at).isNotNull()
        return F.coalesce(ok, F.lit(False))

    def chosen(self, number: int) -> Column:
        own = {
            "t": F.coalesce(self.at, "t"), "marker": F.lit(self.marker) if self.marker else F.col("marker"), "entity": F.coalesce(self.entity, "entity"), "source_ref": F.coalesce(self.ref, "ref"),
            "text": F.format_string(self.text, "name") if self.text else F.col("text"),
        }
        which = F.col("ref") if self.take == "all" else F.lit(None).cast("string")
        return F.struct(F.lit(number).alias("rule"), which.alias("which"), *(own[c].alias(c) for c in CHOSEN))


def conform(events: DataFrame) -> DataFrame:
    """Events with every column of the stream, in its order."""
    there = set(events.columns)
    return events.select(*((F.col(c) if c in there else F.lit(None)).cast(kind).alias(c) for c, kind in STREAM.items()))


def _first(matched: DataFrame) -> DataFrame:
    """Of each rule (and event, for rules that take all) the match that is earliest, then stored first."""
    best = matched.groupBy("incident_id", "m.rule", "m.which").agg(F.min_by("m", F.struct("t", "seq", "ref")).alias("m"), F.min("t").alias("_t"))
    return best.select("incident_id", "m.rule", "_t", *(F.col(f"m.{c}").alias(c) for c in CHOSEN))


def _matched(events: DataFrame, rules: list[tuple[int, Pick]], later: dict[int, int]) -> DataFrame:
    """Rows of (incident_id, m, t, seq, ref): each event with each rule it matches."""

    def one(number: int, pick: Pick) -> Column:
        ok = pick.matches()
        if number in later:
            ok = ok & F.coalesce(F.col("t") > F.col("_picked")[later[number]], F.lit(False))
        return F.when(ok, pick.chosen(number))

    found = F.array_compact(F.array(*(one(n, p) for n, p in rules)))
    return events.select("incident_id", "t", "seq", "ref", F.explode(found).alias("m"))


def pick(events: DataFrame, picks: tuple[Pick, ...]) -> DataFrame:
    """(incident_id, rule, t, marker, entity, source_ref, text): what each rule takes of each incident.

    Events without a time match nothing.  Of several events of one time the smaller ``seq``, then ``ref``, is the first.
    """
    number = {p.rule: n for n, p in enumerate(picks)}
    unknown = [p.after for p in picks if p.after and (p.after not in number or picks[number[p.after]].after)]
    if unknown:
        raise ValueError(f"a pick follows one that is not there or follows another itself: {', '.join(unknown)}")
    events = events.where("t is not null")
    got = _first(_matched(events, [(n, p) for n, p in enumerate(picks) if not p.after], {}))
    following = [(n, p) for n, p in enumerate(picks) if p.after]
    if following:
        # One row per incident, with at most a time per rule.
        picked = got.groupBy("incident_id", "rule").agg(F.min("_t").alias("_t")).groupBy("incident_id").agg(F.map_from_entries(F.collect_list(F.struct("rule", "_t"))).alias("_picked"))
        any_of = following[0][1].matches()
        for _, p in following[1:]:
            any_of = any_of | p.matches()
        got = got.unionByName(_first(_matched(events.where(any_of).join(picked, "incident_id"), following, {n: number[p.after] for n, p in following})))
    names = F.array(*(F.lit(p.rule) for p in picks))
    return got.select("incident_id", F.get(names, F.col("rule")).alias("rule"), *CHOSEN)


_ENTRY = {"kind": "^SERVER$", "status": "^ERROR$", "root": True}
# What the timeline of each failure class is made of.
PICKS = (
    Pick("deploy", ("deploy", "resource-exhaustion"), "change", {"kind": "^deploy$"}, "change"),
    Pick("job", ("dependency-degradation", "recurring-incident"), "change", {"kind": "^job_start$"}, "change"),
    Pick("config", ("config-change",), "change", {"kind": "^config_change$"}, "change"),
    Pick("shift", ("traffic-shift",), "change", {"kind": "^traffic_shift$"}, "change"),
    Pick("migration", ("schema-change",), "change", {"kind": "^schema_migration$"}, "change"),
    Pick("outside", ("downstream-outage",), "change", {"kind": "^external_event$"}, "trigger"),
    Pick("restarts", ("resource-exhaustion",), "change", {"kind": "^infrastructure_event$"}, "symptom", take="all"),
    Pick("changes", ("coincidental-correlation",), "change", take="all"),
    Pick("first-error", ("deploy",), "log", {"severity": "^ERROR$", "entity": "^service:"}, "symptom"),
    Pick("transient", ("retry-storm",), "log", {"body": "transient error"}, "trigger"),
    Pick("queue-full", ("retry-storm",), "log", {"body": "queue full"}, "symptom"),
    Pick("deadline", ("config-change",), "log", {"body": "deadline"}, "symptom"),
    Pick("no-such", ("schema-change",), "log", {"body": "does not exist"}, "symptom"),
    Pick("provider", ("downstream-outage",), "log", {"named": True}, "symptom"),
    Pick("caller-error", ("recurring-incident",), "log", {"severity": "^ERROR$", "entity": "^service:"}, "propagation", at="minute"),
    Pick("entry-error", ("deploy", "dependency-degradation", "downstream-outage"), "span", _ENTRY, "propagation"),
    Pick("refused", ("missing-data",), "span", {"error_type": "^connection_refused$"}, "symptom", entity="other_entity"),
    Pick("gap-begins", ("missing-data",), "gap", {}, "data-gap", entity="other_entity", text="telemetry gap begins"),
    Pick("gap-ends", ("missing-data",), "gap", {}, "data-gap", at="until", strict=True, entity="other_entity", text="telemetry gap ends"),
    Pick("errors", ("deploy",), "window", {"name": r"^http\.server\.error_rate$", "entity": "^service:"}, at="material_t", ref="series_ref"),
    Pick("failing", ("config-change", "schema-change"), "window", {"name": r"^http\.server\.error_rate$", "entity": "^service:"}, at="material_t"),
    Pick("failing-too", ("coincidental-correlation",), "window", {"name": r"^http\.server\.error_rate$", "entity": "^service:"}),
    Pick("slow-query", ("dependency-degradation",), "window", {"name": r"^db\.query\.duration_p95_ms$", "entity": "^db:"}),
    Pick("slow-again", ("recurring-incident",), "window", {"name": r"^db\.query\.duration_p95_ms$", "entity": "^db:"}, at="material_t"),
    Pick("recovers", ("dependency-degradation", "recurring-incident"), "window", {"name": r"^db\.query\.duration_p95_ms$", "entity": "^db:"}, "recovery", at="recovery", strict=True, ref="series_ref", text="%s returns toward baseline"),
    Pick("slow-caller", ("dependency-degradation",), "window", {"name": r"^http\.server\.duration_p95_ms$", "entity": "^service:"}),
    Pick("retries", ("retry-storm",), "window", {"name": r"^client\.retry\.rate_rps$", "entity": "^service:"}),
    Pick("load", ("retry-storm",), "window", {"name": r"^request\.rate_rps$", "entity": "^service:"}, at="material_t"),
    Pick("hot-shard", ("traffic-shift",), "window", {"name": r"^http\.server\.duration_p95_ms$", "entity": "^shard:"}, at="material_t"),
    Pick("queue", ("traffic-shift",), "window", {"name": r"^queue\.depth$", "entity": "^shard:"}, at="peak_t"),
    Pick("memory", ("resource-exhaustion",), "window", {"name": r"^memory\.rss_bytes$", "entity": "^pod:"}, at="near_t"),
    Pick("cache", ("coincidental-correlation",), "window", {"name": r"^cache\.hit_ratio$", "entity": "^(infra|cache):"}),
)
CLASSES = tuple(sorted({c for p in PICKS for c in p.classes}))


def class_timeline(events: DataFrame, picks: tuple[Pick, ...] = PICKS) -> DataFrame:
    """The timeline of every incident of a class that the picks know, ordered and each event once."""
    t = pick(events, picks).drop("rule")
    text = t.groupBy("incident_id", "t", "marker", "entity", "source_ref").agg(F.min("text").alias("text"))
    keys = ["incident_id", "t", "marker", "entity", "source_ref"]
    return timeline.ordered(text.select(*keys)).join(text, keys).select("incident_id", "position", *keys[1:], "text")
