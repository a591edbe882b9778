"""Operators of the record store: selection, keyed writes, references, windows.

A record is (incident_id, seq, kind, key, win STRUCT<start, end>, entities ARRAY, payload);
``seq`` is the order of insertion.  Every operator is a pure function of DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import times
from evidra.plans.lineage import cut, stored

RAW_KINDS = ("resource", "trace", "span", "metric_series", "log", "change", "prior_incident", "telemetry_gap")
# Which categories a signal may refer to.
SIGNAL_CATEGORIES = {
    "trace": ("trace", "span"), "metric": ("metric_series",), "log": ("log",), "change": ("change",),
    "anomaly_window": ("anomaly_window",), "log_pattern": ("log_pattern",), "prior_incident": ("prior_incident",),
    "telemetry_gap": ("telemetry_gap",), "entity": ("entity",), "relationship": ("relationship",),
}
UNSUPPORTED = ("profile", "external")


def select(records: DataFrame, window: tuple | None = None, entities: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """Records that meet every given predicate; an absent one filters nothing.  Callers order by ``seq``."""
    out = records
    if window is not None:
        start, end = (F.lit(x) for x in window)
        out = out.where(times.overlaps(F.col("win.start"), F.col("win.end"), start, end))
    if entities:
        out = out.where(F.arrays_overlap("entities", F.array(*map(F.lit, entities))))
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    return out


def raw_only(records: DataFrame) -> DataFrame:
    return records.where(F.col("kind").isin(*RAW_KINDS))


def duplicate_keys(records: DataFrame, *by: str) -> DataFrame:
    """Keys written more than once, with how often: what a unique insert must refuse."""
    return records.groupBy(*by).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def insert_unique(records: DataFrame, new: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(records with the new rows whose key is free, refused rows).  Of new rows that share a key the first by seq wins."""
    order = Window.partitionBy(*by).orderBy("seq")
    ranked = new.withColumn("_rank", F.row_number().over(order))
    taken = records.select(*by).distinct().withColumn("_taken", F.lit(True))
    marked = ranked.join(taken, list(by), "left")
    free = F.col("_taken").isNull() & (F.col("_rank") == 1)
    return records.unionByName(marked.where(free).select(*records.columns)), marked.where(~free).select(*new.columns)


def accumulate_series(points: DataFrame) -> DataFrame:
    """Each series' size, widened window and total, with the number of conflicting descriptions of it."""
    meta = F.countDistinct("unit") if "unit" in points.columns else F.lit(1)
    return points.groupBy("name", "entity").agg(F.count("*").alias("n_points"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), meta.alias("n_meta"))


def point_window(t: Column) -> Column:
    return F.struct(t.alias("start"), t.alias("end"))


def trace_windows(spans: DataFrame) -> DataFrame:
    """Per trace the least start and the greatest end."""
    return spans.groupBy("trace_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_spans"))


def entity_set(*columns: Column) -> Column:
    """Distinct non-null entities in order of appearance."""
    return F.array_distinct(F.array_compact(F.flatten(F.array(*columns))))


def categories_of(signal: Column) -> Column:
    pairs = [x for s, c in SIGNAL_CATEGORIES.items() for x in (F.lit(s), F.array(*map(F.lit, c)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), signal), F.array().cast("array<string>"))


def resolve_refs(refs: DataFrame, records: DataFrame) -> DataFrame:
    """Outcome of every reference (ref_id, signal, ref): found, ambiguous, signal_mismatch, missing or unsupported.

    An exact key comes first; a ``trace:`` prefix is dropped only where that misses.
    """
    index = records.select(F.col("key").alias("_key"), F.col("kind").alias("_kind"))
    keys = records.select(F.col("key").alias("_key")).distinct().withColumn("_exact", F.lit(True))
    r = refs.join(keys, refs["ref"] == keys["_key"], "left").drop("_key")
    r = r.withColumn("_lookup", F.when(F.col("_exact").isNull() & F.col("ref").startswith("trace:"), F.expr("substring(ref, 7)")).otherwise(F.col("ref")))
    hit = r.join(index, r["_lookup"] == index["_key"], "left")
    ok = F.array_contains(categories_of(F.col("signal")), F.col("_kind"))
    counted = hit.groupBy("ref_id", "signal", "ref").agg(F.count("_kind").alias("n_any"), F.count_if(ok).alias("n_ok"))
    outcome = (
        F.when(F.size(categories_of(F.col("signal"))) == 0, "unsupported")
        .when(F.col("n_any") == 0, "missing")
        .when(F.col("n_ok") == 0, "signal_mismatch")
        .when(F.col("n_ok") == 1, "found")
        .otherwise("ambiguous")
    )
    return counted.select("ref_id", "signal", "ref", outcome.alias("outcome"))


def resolve_scalars(refs: DataFrame, records: DataFrame) -> DataFrame:
    """As :func:`resolve_refs` without signals: found, ambiguous or missing by key alone."""
    n = refs.join(records.select(F.col("key").alias("_key")), F.col("ref") == F.col("_key"), "left").groupBy("ref_id", "ref").agg(F.count("_key").alias("n"))
    return n.select("ref_id", "ref", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("outcome"))


def reference_index(records: DataFrame) -> DataFrame:
    """Each key with its set of categories, sorted."""
    return records.groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("categories"))


def first_by(df: DataFrame, partition: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each partition by a total order."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def ranked(df: DataFrame, partition: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """``df`` with each row's place (from 1) in a total order within its partition, however large that is.

    One range shuffle by partition and order, rows counted in order within its tasks as they are stored, and prefix sums
    over the tasks' counts: no task holds a whole partition, and rows are not dealt a second time.
    """
    spread = df.repartitionByRange(*partition, *order).sortWithinPartitions(*partition, *order)
    placed = stored(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.spark_partition_id()))
    counts = placed.groupBy("_task", *partition).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*partition).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select(F.col("_task").alias("_t"), *(F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)), (before - F.col("_first") + 1).alias("_shift"))
    j = placed.join(shift, (F.col("_task") == F.col("_t")) & _same(partition))
    return j.withColumn(name, (F.col("_at") + F.col("_shift")).cast("int")).drop("_at", "_task", "_t", "_shift", *(f"_p{i}" for i in range(len(partition))))


def running_max(df: DataFrame, partition: Sequence[str], order: Sequence, value: str, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` of the rows before each in a total order within its partition; null before the first.

    Dealt as in :func:`ranked`: maxima within the tasks of a range shuffle, then over the tasks before.
    """
    placed = cut(df.repartitionByRange(*partition, *order).withColumn("_task", F.spark_partition_id()))
    here = Window.partitionBy("_task", *partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy("_task", *partition).agg(F.max(value).alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.partitionBy(*partition).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)))
    j = placed.withColumn("_here", F.max(value).over(here)).join(before.select(F.col("_task").alias("_t"), *(F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)), "_before"), (F.col("_task") == F.col("_t")) & _same(partition))
    return j.withColumn(name, F.greatest("_here", "_before")).drop("_task", "_here", "_t", "_before", *(f"_p{i}" for i in range(len(partition))))


def number_in(id: Column) -> Column:
    """The number at the end of a dense id."""
    return F.regexp_extract(id, r"([0-9]+)$", 1).try_cast("long")


def _same(partition: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(partition):
        out = out & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    return out


def numbered(df: DataFrame, partition: Sequence[str], order: Sequence, name: str, form: str = "%d") -> DataFrame:
    """Dense ids by position in a total order within each partition."""
    return ranked(df, partition, order, name).withColumn(name, F.format_string(form, name))


def ingest(records: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the events of (incident_id, seq, kind, key, win, entities), events refused).

    Points of a series widen its record's window and entities; any other record whose key is taken is refused.
    """
    series = F.col("kind") == "metric_series"
    kept, refused = insert_unique(records.where(~series), events.where(~series), "incident_id", "kind", "key")
    rows = records.where(series).unionByName(events.where(series))
    widened = rows.groupBy("incident_id", "kind", "key").agg(
        F.min("seq").alias("seq"), F.struct(F.min("win.start").alias("start"), F.max("win.end").alias("end")).alias("win"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("entities")))).alias("entities")
    )
    return kept.unionByName(widened.select(*kept.columns)), refused


def stored_edges(records: DataFrame) -> DataFrame:
    """(key, src, type, dst, confidence) of the relationship records whose payload can be read; others are left out."""
    shape = "src STRING, type STRING, dst STRING, confidence DOUBLE"
    own = records.where("kind = 'relationship'").select("key", F.from_json("payload", shape).alias("x")).select("key", "x.*")
    return own.where("src is not null and type is not null and dst is not null")


def available_from(refs: DataFrame, plan: DataFrame) -> DataFrame:
    """``refs`` (incident_id, ref) with the place in the replay ``plan`` (incident_id, sequence, key) from which each resolves; null if never."""
    first = plan.groupBy("incident_id", F.col("key").alias("ref")).agg(F.min("sequence").alias("available_from"))
    return refs.join(first, ["incident_id", "ref"], "left")
