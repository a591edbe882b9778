"""Validation as queries: issue rows, differences and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import scores


def dangling(refs: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """References that nothing answers."""
    return refs.join(keys.select(on).distinct(), on, "left_anti")


def difference(actual: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Rows by identity on one side only: ``missing`` in actual or ``extra`` there."""
    missing = expected.select(*by).distinct().join(actual.select(*by).distinct(), by, "left_anti").withColumn("side", F.lit("missing"))
    extra = actual.select(*by).distinct().join(expected.select(*by).distinct(), by, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def compare(actual: DataFrame, expected: DataFrame, by: list[str], exact: list[str] = (), close: list[str] = (), tolerance: float = 0.05) -> DataFrame:
    """Mismatch rows (by, field, actual, expected): null-safe equality of exact fields, relative tolerance of close ones."""
    a = actual.select(*by, *(F.col(c).alias(f"a_{c}") for c in (*exact, *close)))
    e = expected.select(*by, *(F.col(c).alias(f"e_{c}") for c in (*exact, *close)))
    j = a.join(e, by)
    bad = [(c, ~F.col(f"a_{c}").eqNullSafe(F.col(f"e_{c}"))) for c in exact]
    bad += [(c, ~F.coalesce(scores.near(F.col(f"a_{c}"), F.col(f"e_{c}"), tolerance), F.col(f"a_{c}").isNull() & F.col(f"e_{c}").isNull())) for c in close]
    rows = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").cast("string").alias("actual"), F.col(f"e_{c}").cast("string").alias("expected"))) for c, cond in bad)))
    return j.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")


def coverage(cases: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, value, n): how many cases have each value of each dimension, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    return cases.select(pairs.alias("x")).select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def check(df: DataFrame, key: Column, **rules: Column) -> DataFrame:
    """Issue rows (key, rule) for each rule a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(key.alias("key"), F.explode(broken).alias("rule"))


def in_order(positions: Column) -> Column:
    """Whether an array of positions ascends: an ordered subsequence."""
    return F.aggregate(positions, F.struct(F.lit(-1).cast("long").alias("last"), F.lit(True).alias("ok")), lambda a, x: F.struct(x.cast("long").alias("last"), (a["ok"] & (x > a["last"])).alias("ok")), lambda a: a["ok"])


def is_subset(a: Column, b: Column) -> Column:
    """Whether every element of array a is in b."""
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements, in any order and number."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def within_capabilities(expected: DataFrame, capabilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expected rows of a capability that their case declares, the others): rows are (incident_id, capability, ...)."""
    own = capabilities.select("incident_id", "capability").distinct()
    return expected.join(own, ["incident_id", "capability"], "left_semi"), expected.join(own, ["incident_id", "capability"], "left_anti")
