"""Validation rules as data over facts: one row for each field of each record of a corpus.

Facts are (case, file, path, position, field, scope, value): where a value stands, what it is, and within what it must be
unique or is referred to.  All rules of a kind are one operation whatever their number: needs and vocabularies are a
filter, uniqueness is an aggregation, references are an anti-join, key sets are a full outer join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = ("case", "file", "path", "position", "field", "scope", "value")
OUT = ("case", "file", "path", "rule", "value")


@dataclass(frozen=True)
class Rule:
    """``kind``: needed, unique (within case and scope), refers (to ``target`` within case and, with ``scoped``, scope), one_of (``values``), safe (a plain file name)."""

    kind: str
    field: str
    target: str = ""
    values: tuple[str, ...] = ()
    scoped: bool = False


def _among(rules: list[Rule]) -> Column:
    return F.col("field").isin(*(r.field for r in rules))


def _issue(facts: DataFrame, rule: Column) -> DataFrame:
    return facts.select("case", "file", "path", rule.alias("rule"), "value")


def violations(facts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (case, file, path, rule, value) of facts that break a rule; a null value breaks no rule but that it is needed."""
    of = lambda kind: [r for r in rules if r.kind == kind]
    blank = F.coalesce(F.trim("value") == "", F.lit(True))
    bad: Column = F.lit(None).cast("string")
    for r in of("one_of"):
        bad = F.when((F.col("field") == r.field) & ~F.col("value").isin(*r.values), f"one_of {'|'.join(r.values)}").otherwise(bad)
    if of("safe"):
        bad = F.when(_among(of("safe")) & ~F.col("value").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), "safe").otherwise(bad)
    if of("needed"):
        bad = F.when(_among(of("needed")) & blank, "needed").otherwise(bad)
    out = _issue(facts.withColumn("_bad", bad).where("_bad is not null"), F.col("_bad"))
    if of("unique"):
        own = facts.where(_among(of("unique")) & F.col("value").isNotNull())
        keys = ["case", "field", "scope", "value"]
        first = own.groupBy(*keys).agg(F.min("position").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        again = own.alias("f").join(first.alias("d"), [F.col(f"f.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]).where(F.col("f.position") != F.col("d._first")).select("f.*")
        out = out.unionByName(_issue(again, F.lit("unique")))
    if of("refers"):
        pairs = F.create_map(*(F.lit(x) for r in of("refers") for x in (r.field, r.target)))
        scoped = [r.field for r in of("refers") if r.scoped]
        by_scope = F.col("field").isin(*scoped) if scoped else F.lit(False)
        refs = facts.where(_among(of("refers")) & F.col("value").isNotNull()).withColumns({"_target": F.element_at(pairs, F.col("field")), "_in": F.when(by_scope, F.coalesce("scope", F.lit(""))).otherwise("")})
        told = facts.where(F.col("field").isin(*(r.target for r in of("refers"))) & F.col("value").isNotNull()).select("case", F.col("field").alias("_target"), "value", F.explode(F.array(F.lit(""), F.coalesce("scope", F.lit("")))).alias("_in")).distinct()
        out = out.unionByName(_issue(refs.join(told, ["case", "_target", "value", "_in"], "left_anti"), F.concat(F.lit("refers to "), "_target")))
    return out


def key_sets(declared: DataFrame, there: DataFrame) -> DataFrame:
    """Issues of (case, file, key) rows: keys that are declared and not there (``missing``), and the other way round (``extra``); keys that begin with an underscore are notes."""
    plain = lambda df, side: df.where(~F.col("key").startswith("_")).select("case", "file", "key").distinct().withColumn(side, F.lit(True))
    j = plain(declared, "_d").join(plain(there, "_t"), ["case", "file", "key"], "full_outer").where("_d is null or _t is null")
    return j.select("case", "file", F.concat(F.lit("$."), "key").alias("path"), F.when(F.col("_t").isNull(), "missing").otherwise("extra").alias("rule"), F.col("key").alias("value"))
