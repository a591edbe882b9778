"""Comparing what was expected with what was derived: difference rows with paths, tolerances and order.

Both sides are tables of one row per artifact.  A full outer join on the artifact's identity gives what is missing, what is
extra and which fields differ; lists whose order counts are aligned as a greedy subsequence.  Every difference is a row
(incident_id, path, problem, expected, actual).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import scores, text
from evidra.operators import store

OUT = ("incident_id", "path", "problem", "expected", "actual")
# Fixed value: how far two shares or confidences may lie apart.
UNIT_TOLERANCE = 0.05 + 1e-9


@dataclass(frozen=True)
class Field:
    """A compared column.  ``kind``: exact, number (within 5 % or 0.001), unit (within 0.05), set (any order) or text (but for spaces; a difference of wording)."""

    name: str
    kind: str = "exact"

    def same(self, e: Column, a: Column) -> Column:
        both_null = e.isNull() & a.isNull()
        if self.kind == "number":
            return both_null | F.coalesce(scores.near(a.cast("double"), e.cast("double")), F.lit(False))
        if self.kind == "unit":
            return both_null | F.coalesce(F.abs(e.cast("double") - a.cast("double")) <= UNIT_TOLERANCE, F.lit(False))
        if self.kind == "set":
            return F.array_sort(F.array_distinct(e)).eqNullSafe(F.array_sort(F.array_distinct(a)))
        if self.kind == "text":
            return text.collapse_space(e).eqNullSafe(text.collapse_space(a))
        return e.eqNullSafe(a)


def shown(c: Column, kind: str = "exact") -> Column:
    return F.to_json(c) if kind == "set" else c.cast("string")


def place(section: str, keys: Column, name: str = "") -> Column:
    return F.concat(F.lit(f"$.{section}["), keys, F.lit(f"].{name}" if name else "]"))


def differences(expected: DataFrame, actual: DataFrame, section: str, keys: list[str], fields: list[Field], extra: bool = True) -> DataFrame:
    """Difference rows of one section.  A null key is a key like any other; of rows with one identity on a side the greatest counts.

    ``extra``: whether artifacts that were not expected are differences.
    """
    on = ["incident_id", *(f"_k{n}" for n in range(len(keys)))]

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.select("incident_id", *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{n}") for n, k in enumerate(keys)), F.struct(F.lit(1).alias("_there"), *(f.name for f in fields)).alias(name))
        return own.groupBy(*on).agg(F.max(name).alias(name))

    j = side(expected, "_e").join(side(actual, "_a"), on, "full_outer")
    key = F.concat_ws("|", *on[1:])
    none = F.lit(None).cast("string")

    def found(problem: str, where: Column, e: Column = none, a: Column = none) -> Column:
        return F.struct(where.alias("path"), F.lit(problem).alias("problem"), e.alias("expected"), a.alias("actual"))

    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    rows = [F.when(F.col("_a").isNull(), found("missing", place(section, key), key))]
    if extra:
        rows.append(F.when(F.col("_e").isNull(), found("extra", place(section, key), none, key)))
    for f in fields:
        e, a = F.col(f"_e.{f.name}"), F.col(f"_a.{f.name}")
        rows.append(F.when(both & ~f.same(e, a), found("wording" if f.kind == "text" else "differs", place(section, key, f.name), shown(e, f.kind), shown(a, f.kind))))
    return j.select("incident_id", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("incident_id", "x.*")


def out_of_order(expected: DataFrame, actual: DataFrame, section: str, identity: list[str], by: str = "incident_id", position: str = "position") -> DataFrame:
    """Gap rows of a greedy alignment: expected entries that do not follow, in actual, the last entry that was found.

    Each expected entry, in order, is looked for behind the place where the last was found.  An entry stands at one place of
    actual (the first, if it repeats), so it is found exactly if that place lies behind those of all entries before it: entries
    that were not found lie before the running maximum and do not change it.  A gap row tells what stands in actual where the
    search began.  Positions count from 1.
    """
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity))
    e = expected.select(by, F.col(position).alias("_at"), key.alias("_key"))
    a = actual.select(by, F.col(position).alias("_there"), key.alias("_key"))
    first = a.groupBy(by, "_key").agg(F.min("_there").alias("_found"))
    j = store.running_max(e.join(first, [by, "_key"], "left"), [by], ["_at", "_key"], "_found", "_behind")
    begin = F.coalesce("_behind", F.lit(0))
    gaps = j.where(~F.coalesce(F.col("_found") > begin, F.lit(False))).withColumn("_there", begin + 1)
    there = gaps.join(a.select(by, "_there", F.col("_key").alias("actual")), [by, "_there"], "left")
    return there.select(by, F.format_string(f"$.{section}[%d]", (F.col("_at") - 1).cast("int")).alias("path"), F.lit("order").alias("problem"), F.col("_key").alias("expected"), "actual")
