"""Metric series: merging, baselines, anomaly windows and window comparison.

Points are (incident_id, name, entity, t, v, ord); ``ord`` breaks ties in time.  All
per-series work is one hash aggregation over series keys; nothing is collected per group
beyond what an aggregate function holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import scores, times
from evidra.plans.lineage import cut

SERIES = ["incident_id", "name", "entity"]


def merge_max(points: DataFrame) -> DataFrame:
    """Series that map to one entity are merged: the maximum of each time counts."""
    return points.groupBy(*SERIES, "t").agg(F.max("v").alias("v"), F.min("ord").alias("ord"))


def instance_entities(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """Instance entities replaced by their service where ``mapping`` (instance, service) knows one."""
    return points.join(mapping, points["entity"] == mapping["instance"], "left").withColumn("entity", F.coalesce("service", "entity")).select(*points.columns)


def identities(points: DataFrame, mapping: DataFrame, holes: DataFrame) -> DataFrame:
    """What each series is, once instances stand under their service by ``mapping`` (incident_id, instance, service).

    ``points`` carry a unit, ``holes`` are (incident_id, name, entity, start, end, gap_id, seq).  A row has the references of all
    stored series it is made of (the one stored first leads), the unit named first and whether others are named, how many points
    were stored, their span, and the hole declared first.  Points meet by their stored series before they meet by service, so a
    service with most of all points costs a row for each of its instances.
    """
    c, keys = F.col, SERIES
    under = lambda df: df.join(mapping.select("incident_id", c("instance").alias("entity"), "service"), ["incident_id", "entity"], "left").withColumn("own", c("entity")).withColumn("entity", F.coalesce("service", "entity"))
    stored = points.groupBy(*keys).agg(F.min("ord").alias("ord"), F.min(F.when(c("unit").isNotNull(), F.struct("ord", "unit"))).alias("named"), F.min("unit").alias("least"), F.max("unit").alias("most"), F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z"))
    ref = F.struct("ord", F.concat_ws("@", "name", "own").alias("ref"))
    g = under(stored).groupBy(*keys).agg(
        F.array_sort(F.collect_list(ref)).alias("_refs"), F.min("ord").alias("input_order"), F.min("named")["unit"].alias("unit"),
        F.coalesce(F.min("least") != F.max("most"), F.lit(False)).alias("units_differ"), F.sum("n").alias("n_points"), F.min("a").alias("first_t"), F.max("z").alias("last_t"),
    )
    hole = under(holes).groupBy(*keys).agg(F.min_by(F.struct("start", "end", "gap_id"), "seq").alias("gap"))
    refs = F.array_distinct(F.transform("_refs", lambda x: x["ref"]))
    return g.withColumn("refs", refs).drop("_refs").join(hole, keys, "left")


def append(described: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (incident_id, name, entity, unit, t, v, seq) with the ``outcome`` of adding them to the series ``described`` (incident_id, name, entity, unit).

    A new series is described by its first point, which is "inserted"; a point of a known series is "updated", or a "conflict" if it
    names another unit; one without name, entity, time or value is "rejected" and describes nothing.  Null units are equal.
    What a series is described by is one row, so a series with most of all points is no group anywhere.
    """
    c, whole = F.col, F.lit(True)
    for n in ("name", "entity", "t", "v"):
        whole = whole & c(n).isNotNull()
    first = points.where(whole).groupBy(*SERIES).agg(F.min_by(F.struct("unit", "seq"), "seq").alias("_first"))
    known = described.groupBy(*SERIES).agg(F.min(F.struct("unit")).alias("_known"))
    says = first.join(known, SERIES, "left").select(*SERIES, F.coalesce(c("_known"), F.struct(c("_first.unit"))).alias("_says"), F.when(c("_known").isNull(), c("_first.seq")).alias("_seq"))
    told = F.when(~c("unit").eqNullSafe(c("_says.unit")), "conflict").when(c("seq") == c("_seq"), "inserted").otherwise("updated")
    good = points.where(whole).join(says, SERIES).withColumn("outcome", told).drop("_says", "_seq")
    return good.unionByName(points.where(~whole).withColumn("outcome", F.lit("rejected")))


def baselines(points: DataFrame) -> DataFrame:
    """Per series the first point's value, the extremes and how many points there are; NaN never counts as an extreme."""
    good = F.when(~F.isnan("v"), F.col("v"))
    return points.groupBy(*SERIES).agg(
        F.min_by("v", F.struct("t", "ord")).alias("baseline"), F.max(good).alias("peak"), F.min(good).alias("trough"), F.count("*").alias("n_points"), F.max("t").alias("last_t"), F.min("t").alias("first_t")
    )


def sawtooth(points: DataFrame, base: DataFrame) -> DataFrame:
    """Per series whether it climbs and falls again: at least 5 points, 2 high ones, and 2 low ones after the first."""
    j = points.join(base.select(*SERIES, "baseline", "first_t"), SERIES)
    low = (F.col("v") <= scores.SAW_TROUGH * F.col("baseline")) & (F.col("t") > F.col("first_t"))
    n = j.groupBy(*SERIES).agg(F.count("*").alias("n"), F.count_if(F.col("v") >= scores.SAW_PEAK * F.col("baseline")).alias("n_high"), F.count_if(low).alias("n_low"))
    return n.select(*SERIES, ((F.col("n") >= 5) & (F.col("n_high") >= 2) & (F.col("n_low") >= 2)).alias("is_sawtooth"), "n_high", "n_low")


def judged(points: DataFrame) -> DataFrame:
    """Points with their series' baseline and extremes and whether each is anomalous."""
    base = baselines(points)
    saw = sawtooth(points, base).select(*SERIES, "is_sawtooth")
    j = points.join(base.join(saw, SERIES), SERIES)
    return j.withColumn("anomalous", scores.is_anomalous(F.col("name"), F.col("baseline"), F.col("v"), F.col("is_sawtooth")))


def anomaly_windows(points: DataFrame) -> DataFrame:
    """Series with an anomaly: onset, last anomalous time, recovery, peak or trough, magnitude and confidence."""
    j = judged(points)
    first = j.where("anomalous").groupBy(*SERIES).agg(
        F.min(F.struct("t", "ord")).alias("on"), F.max(F.struct("t", "ord")).alias("off"), F.count("*").alias("n_anomalous"),
        F.first("baseline").alias("baseline"), F.first("peak").alias("peak"), F.first("trough").alias("trough"), F.first("last_t").alias("series_end"),
    )
    calm = j.where(~F.col("anomalous")).join(first.select(*SERIES, F.col("on.t").alias("on_t")), SERIES).where(F.col("t") > F.col("on_t"))
    recovery = calm.groupBy(*SERIES).agg(F.min("t").alias("recovery"))
    out = first.join(recovery, SERIES, "left")
    drop = scores.is_drop(F.col("name"))
    peak = F.when(~drop, F.col("peak"))
    trough = F.when(drop, F.col("trough"))
    return out.select(
        *SERIES, "series_end", F.col("on.t").alias("start"), F.col("off.t").alias("last_anomalous"), F.coalesce(times.shift_minutes(F.col("recovery"), -1), F.col("series_end")).alias("end"), "recovery",
        "baseline", peak.alias("peak"), trough.alias("trough"), "n_anomalous",
        scores.magnitude(F.col("baseline"), peak, trough, F.lit(None).cast("string")).alias("magnitude"), F.lit(0.90).alias("detector_confidence"),
    )


@dataclass(frozen=True)
class Choice:
    """Which series of a failure class make windows: patterns of the metric's name and of the entity."""

    classes: tuple[str, ...]
    names: str
    entities: str = ""


# The series that tell of a failure class.  Of a class that is not listed every anomalous series does.
CHOICES = (
    Choice(("deploy",), r"^http\.server\.(error_rate|duration_p95_ms)$", "^service:"),
    Choice(("dependency-degradation", "recurring-incident"), r"^(db\.query\.duration_p95_ms|db\.locks\.waiting|http\.server\.duration_p95_ms)$"),
    Choice(("config-change",), r"^(http\.server\.error_rate|upstream\.timeout\.count)$"),
    Choice(("coincidental-correlation",), r"^(cache\.hit_ratio|http\.server\.error_rate|db\.query\.duration_p95_ms)$"),
    Choice(("downstream-outage",), r"^(dependency|http\.server)\.error_rate$"),
    Choice(("missing-data",), r"^http\.server\.error_rate$", "^service:"),
    Choice(("resource-exhaustion",), r"^(memory\.rss_bytes|pod\.restarts\.count|http\.server\.error_rate)$"),
    Choice(("retry-storm",), r"^(http\.server\.error_rate|request\.rate_rps|client\.retry\.rate_rps)$"),
    Choice(("schema-change",), r"^(http\.server|db\.query)\.error_rate$"),
    Choice(("traffic-shift",), r"^http\.server\.duration_p95_ms$", "^shard:"),
    Choice(("traffic-shift",), r"^queue\.depth$"),
    Choice(("traffic-shift",), r"^request\.rate_rps$", "^tenant:"),
    Choice(("entity-ambiguity",), r"^http\.server\.error_rate$", "@(canary|stable)$"),
)
# How the two ends of a window follow from the first anomaly and the recovery.
AT_CHANGE, CHANGE_MINUTES = ("deploy", "config-change", "schema-change", "traffic-shift"), 3
EARLIER = ("db.locks.waiting", "request.rate_rps", "client.retry.rate_rps")
STABLE_NOTE, WARM_UP = "no anomaly: stable fleet is healthy", 0.15


def class_windows(points: DataFrame, cases: DataFrame, changes: DataFrame, gaps: DataFrame) -> DataFrame:
    """:func:`anomaly_windows` by the rules of each case's failure class.

    ``cases`` is (incident_id, failure_class, start, end), ``gaps`` (incident_id, name, entity, start, end): declared holes in a series.
    Cases, changes and gaps are few beside points, and joined to windows, of which a series has one.
    """
    c, keys = F.col, ["incident_id", *SERIES[1:]]
    hole = gaps.groupBy(*SERIES).agg(F.min("start").alias("gap_start"), F.max("end").alias("gap_end"))
    case = cases.select("incident_id", c("failure_class").alias("class"), c("start").alias("case_start"), c("end").alias("case_end"))
    w = anomaly_windows(points).drop("magnitude", "detector_confidence")
    # The stable part of an ambiguous service has a window that says it is well.
    calm = baselines(points).join(case.where("class = 'entity-ambiguity'").select("incident_id"), "incident_id").where(c("entity").endswith("@stable") & (c("name") == "http.server.error_rate"))
    w = w.join(calm.select(*keys), keys, "left_anti").unionByName(calm.select(*keys, "baseline", "peak"), allowMissingColumns=True)
    j = w.join(case, "incident_id", "left").join(hole, keys, "left")
    is_class = lambda *names: F.coalesce(c("class").isin(*names), F.lit(False))
    listed = sorted({x for choice in CHOICES for x in choice.classes})
    chosen = ~is_class(*listed)
    for x in CHOICES:
        chosen = chosen | (is_class(*x.classes) & c("name").rlike(x.names) & c("entity").rlike(x.entities))
    j = cut(j.where(chosen & (~is_class("missing-data") | c("gap_end").isNotNull())))
    near = nearest_before(j.where("start is not null").select(*keys, c("start").alias("t")), changes.select("incident_id", "t"), CHANGE_MINUTES, by=["incident_id"]).select(*keys, "nearest_t")
    past = points.join(j.select(*keys, "gap_end"), keys).where("t >= gap_end").groupBy(*keys).agg(F.min("t").alias("after_gap"))
    j = j.join(near, keys, "left").join(past, keys, "left")

    back = lambda n: times.shift_minutes(c("start"), -n)
    slow = (c("name") == "db.query.duration_p95_ms") & is_class("dependency-degradation", "recurring-incident")
    start = (
        F.when(is_class("resource-exhaustion") & (c("name") == "memory.rss_bytes"), F.coalesce("case_start", "start"))
        .when(is_class(*AT_CHANGE) & c("nearest_t").isNotNull(), c("nearest_t"))
        .when(is_class("traffic-shift"), back(2))
        .when(is_class("entity-ambiguity") & c("entity").endswith("@canary"), back(2))
        .when(~is_class(*AT_CHANGE) & (slow | c("name").isin(*EARLIER)), back(1))
        .otherwise(c("start"))
    )
    calmed = times.shift_minutes(c("recovery"), F.when(is_class("recurring-incident"), -2).otherwise(-1))
    end = (
        F.when(c("start").isNull(), None).when(c("after_gap").isNotNull(), c("after_gap"))
        .when(is_class("resource-exhaustion") & (c("name") == "http.server.error_rate"), times.shift_minutes(c("last_anomalous"), 1))
        .when(is_class("resource-exhaustion"), c("case_end"))
        .otherwise(F.coalesce(calmed, "case_end", "series_end"))
    )
    j = cut(j.withColumns({"_start": start, "_end": end}).withColumn("start", c("_start")).withColumn("end", c("_end")).drop("_start", "_end", "nearest_t"))

    before = points.join(j.select(*keys, "class", c("start").alias("_on")), keys).where("t < _on").groupBy(*keys, "class").agg(
        F.count("*").alias("n"), F.min_by("v", F.struct("t", "ord")).alias("first"), F.max_by("v", F.struct("t", "ord")).alias("last"), F.avg("v").alias("mean")
    )
    blended = F.floor(c("first") * (1 - WARM_UP) + c("last") * WARM_UP + 0.5).cast("double")  # one point of warm-up before the onset counts little
    known = F.when(is_class("dependency-degradation") & (c("name") == "db.query.duration_p95_ms") & (c("n") >= 2), blended).when(is_class("deploy") & c("name").endswith("error_rate") & (c("n") >= 2), c("mean")).otherwise(c("first"))
    j = j.join(before.select(*keys, known.alias("_base")), keys, "left").withColumn("baseline", F.coalesce("_base", "baseline"))
    well = c("start").isNull()
    hidden = c("gap_end").isNotNull()
    note = F.when(well, STABLE_NOTE).when(hidden, F.concat(F.lit("window boundaries and true peak are uncertain: metrics are missing "), times.hhmm(c("gap_start")), F.lit("-"), times.hhmm(c("gap_end"))))
    return j.select(
        *keys, "start", "last_anomalous", "end", "recovery", "baseline", "peak", "trough", "n_anomalous", scores.magnitude(c("baseline"), c("peak"), c("trough"), note).alias("magnitude"),
        F.when(hidden, 0.35).when(well, 0.10).otherwise(0.90).alias("detector_confidence"), note.alias("note"),
    )


def first_material(points: DataFrame) -> DataFrame:
    """Per series the first anomalous time that reaches half of the way to its extreme."""
    j = judged(points).where("anomalous")
    drop = scores.is_drop(F.col("name"))
    material = F.when(drop, F.col("v") <= F.col("baseline") - 0.5 * (F.col("baseline") - F.col("trough"))).otherwise(F.col("v") >= 0.5 * F.col("peak"))
    return j.where(material).groupBy(*SERIES).agg(F.min("t").alias("material_t"))


def near_limit(points: DataFrame, share: float = 0.95) -> DataFrame:
    """Per series the first time at or above a share of its peak, and the last time of the peak itself."""
    j = points.join(baselines(points).select(*SERIES, "peak"), SERIES)
    return j.groupBy(*SERIES).agg(F.min(F.when(F.col("v") >= share * F.col("peak"), F.col("t"))).alias("near_t"), F.max(F.when(F.col("v") == F.col("peak"), F.col("t"))).alias("peak_t"))


def value_in_window(points: DataFrame, start: Column, end: Column) -> Column:
    """The last value inside a window, else the last at or before its end (an aggregate expression)."""
    order = F.struct("t", "ord")
    inside = F.max_by(F.when((F.col("t") >= start) & (F.col("t") <= end), F.col("v")), F.when((F.col("t") >= start) & (F.col("t") <= end), order))
    before = F.max_by(F.when(F.col("t") <= end, F.col("v")), F.when(F.col("t") <= end, order))
    return F.coalesce(inside, before)


def compare_windows(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per series its value in a healthy and an anomalous window (bounds: incident_id, healthy_*, anomalous_*), delta, factor and note."""
    j = points.join(bounds, "incident_id")
    v = j.groupBy(*SERIES).agg(
        value_in_window(j, F.col("healthy_start"), F.col("healthy_end")).alias("from_v"), value_in_window(j, F.col("anomalous_start"), F.col("anomalous_end")).alias("to_v")
    ).where("from_v is not null and to_v is not null")
    factor = F.when(F.col("from_v") != 0, F.col("to_v") / F.col("from_v"))
    note = F.when(F.abs(F.col("to_v") - F.col("from_v")) <= 0.05 * F.greatest(F.abs("from_v"), F.lit(1e-9)), "flat")
    out = v.withColumn("delta", F.col("to_v") - F.col("from_v")).withColumn("factor", factor).withColumn("note", note)
    return out.withColumn("is_counter", scores.is_counter_delta(F.col("note"), F.col("factor"), F.col("from_v"), F.col("to_v")))


def gaps(points: DataFrame, hours: float) -> DataFrame:
    """Silences between neighbouring points of a series longer than so many hours."""
    w = Window.partitionBy(*SERIES).orderBy("t", "ord")
    nxt = points.withColumn("next_t", F.lead("t").over(w))
    length = (F.unix_timestamp("next_t") - F.unix_timestamp("t")) / 3600
    return nxt.where(length > hours).select(*SERIES, F.col("t").alias("start"), F.col("next_t").alias("end"), length.alias("hours"))


def nearest_before(left: DataFrame, right: DataFrame, minutes: int, by: list[str] | None = None) -> DataFrame:
    """Backward as-of join: per left row (id, t) the latest right time at or before it, within so many whole minutes.

    Both sides stand in one order, a time bucket as wide as the tolerance at a time: the latest right time so far, or else the
    latest of the bucket before, is the nearest, so that no pairs are made.  The result is floored to its minute.
    """
    by = by or []
    width = 60 * (minutes + 1)
    bucket = F.floor(F.unix_timestamp("t") / width)
    r = right.dropna(subset=[*by, "t"]).select(*by, F.col("t").alias("_t"), bucket.alias("_b"))
    last = r.groupBy(*by, "_b").agg(F.max("_t").alias("_before")).withColumn("_b", F.col("_b") + 1)
    own = left.select(F.struct(*left.columns).alias("_own"), *by, F.col("t").alias("_t"), bucket.alias("_b"))
    both = own.unionByName(r.withColumn("_change", F.col("_t")), allowMissingColumns=True)
    # A right row comes before a left one of its time.
    so_far = F.max("_change").over(Window.partitionBy(*by, "_b").orderBy("_t", F.col("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_near", so_far).where("_own is not null").join(last, [*by, "_b"], "left")
    change = F.coalesce("_near", "_before")
    ok = (change <= F.col("_t")) & (times.minutes_between(change, F.col("_t")) <= minutes)
    return near.select("_own.*", times.floor_minute(F.when(ok, change)).alias("nearest_t"))


def trough_times(points: DataFrame) -> DataFrame:
    """Per series the time of its least value, the first of equals."""
    return points.groupBy(*SERIES).agg(F.min_by("t", F.struct("v", "t")).alias("trough_t"), F.min("v").alias("trough"))


def metric_names(points: DataFrame) -> DataFrame:
    """Per entity the names of its series, sorted."""
    return points.groupBy("incident_id", "entity").agg(F.array_sort(F.collect_set("name")).alias("names"))
