"""Closed intervals that overlap: a join by time bins, and questions asked of records, many at once.

What questions find together grows with the product of both sides.  :func:`tallied` counts it and :func:`chosen` picks from it
without making the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import times
from evidra.operators import evidence

WIDTH = 3600  #: seconds of the finest bins
GROWTH = 4  #: each level's bins are so many times as wide as those of the level below


def _level(start: Column, end: Column, width: int) -> Column:
    """The finest level at which an interval touches two bins at most."""
    steps = F.log(float(GROWTH), F.greatest((end - start) / width, F.lit(1.0)))
    return F.ceil(steps - 1e-12).cast("int")


def _binned(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    """Rows with their ends in whole seconds (floored and, for the end, raised) and their level; an interval without an end or in reverse overlaps nothing."""
    s, e = F.floor(F.unix_micros(start) / 1_000_000), F.ceil(F.unix_micros(end) / 1_000_000)
    own = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    own = own.withColumns({f"_{name}s": s, f"_{name}e": e})
    return own.withColumn(f"_{name}", _level(F.col(f"_{name}s"), F.col(f"_{name}e"), width))


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str] = (), width: int = WIDTH, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows whose closed intervals overlap and whose ``by`` columns are equal; the right side's bounds come as ``r_start`` and ``r_end``.

    Bins come in levels, each ``GROWTH`` times as wide as the one below.  An interval stands in at most two bins of the level
    that fits its length and of any coarser one; two intervals meet at the coarser of their two levels, in the first bin that both
    stand in, so each pair is found once.  A row is copied at most twice for each level that occurs on the other side (some
    twenty for a minute and a millennium), never once for each bin of a long interval.
    """
    r = right.withColumnsRenamed({start: "r_start", end: "r_end"})
    l, r = _binned(left, start, end, width, "l"), _binned(r, "r_start", "r_end", width, "r")
    levels = lambda df, c: sorted(x[0] for x in df.select(c).distinct().collect())  # noqa: E731  a few dozen numbers at most
    there = {"l": levels(r, "_r"), "r": levels(l, "_l")}

    def dealt(df: DataFrame, name: str) -> DataFrame:
        met = F.array_distinct(F.array(*(F.greatest(F.col(f"_{name}"), F.lit(x)) for x in there[name] or [0])))
        own = df.withColumn("_level", F.explode(met)).withColumn("_w", (F.lit(float(width)) * F.pow(F.lit(float(GROWTH)), "_level")).cast("long"))
        first, last = F.floor(F.col(f"_{name}s") / F.col("_w")), F.floor(F.col(f"_{name}e") / F.col("_w"))
        return own.withColumn(f"_{name}first", first).withColumn("_bin", F.explode(F.sequence(first, last))).drop("_w")

    j = dealt(l, "l").join(dealt(r, "r"), [*by, "_level", "_bin"])
    once = (F.col("_level") == F.greatest("_l", "_r")) & (F.col("_bin") == F.greatest("_lfirst", "_rfirst"))
    hit = j.where(once & times.overlaps(F.col(start), F.col(end), F.col("r_start"), F.col("r_end")))
    return hit.drop("_level", "_bin", "_lfirst", "_rfirst", "_l", "_r", "_ls", "_le", "_rs", "_re")


def asked(questions: DataFrame, records: DataFrame, by: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Records (id, start, end, entities, kind) that each question (question_id, start, end, entities, kinds) asks for.

    The windows overlap, an entity is shared and the kind is listed; an empty list or a null asks for all.  Every question has
    a window; those without one are joined by ``by`` alone (give at least one column then).
    """
    q = questions.withColumnsRenamed({"entities": "_entities", "kinds": "_kinds"})
    hit = overlap_join(q, records, by, width)
    open_ = q.where("start is null or end is null")
    if by:
        hit = hit.unionByName(open_.join(records.withColumnsRenamed({"start": "r_start", "end": "r_end"}), list(by)))
    return hit.where(_asks()).drop("_entities", "_kinds")


def _asks() -> Column:
    """Whether a question's ``_entities`` and ``_kinds`` ask for a record's ``entities`` and ``kind``."""
    any_of = lambda asked, ok: (F.size(F.coalesce(asked, F.array().cast("array<string>"))) == 0) | F.coalesce(ok, F.lit(False))
    return any_of(F.col("_entities"), F.arrays_overlap("_entities", "entities")) & any_of(F.col("_kinds"), F.array_contains("_kinds", F.col("kind")))


def _profiled(questions: DataFrame, records: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions and records with a window (``_s`` to ``_e`` in microseconds) and a profile (``_q``, ``_r``: what they ask for or are), and which profiles meet."""

    def own(df: DataFrame, name: str, *columns: str) -> DataFrame:
        d = df.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") <= F.col("end")))
        return d.withColumns({name: F.to_json(F.struct(*by, *columns)), "_s": F.unix_micros("start"), "_e": F.unix_micros("end")}).drop("start", "end")

    q, r = own(questions, "_q", "entities", "kinds"), own(records, "_r", "entities", "kind")
    asked_for = q.select("_q", *by, F.col("entities").alias("_entities"), F.col("kinds").alias("_kinds")).dropDuplicates(["_q"])
    there = r.select("_r", *by, "entities", "kind").dropDuplicates(["_r"])
    meet = (asked_for.join(there, list(by)) if by else asked_for.crossJoin(there)).where(_asks()).select("_q", "_r", "kind")
    return q.drop("entities", "kinds", *by), r.drop("entities", "kind", *by), meet


def tallied(questions: DataFrame, records: DataFrame, by: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Of each question the number of records (``n_records``), the sum of their ids (``ids``) and the number of their kinds that :func:`asked` finds; questions without a record or a window are left out.

    What overlaps a window has begun by its end and had not ended before its start.  Both are running sums over time: within a bin
    of ``width`` seconds over its rows, before it over the bins' totals.
    """
    q, r, meet = _profiled(questions, records, by)
    zero, none = F.lit(0).cast("long"), F.lit(None)
    c, us = F.col, F.lit(width * 1_000_000)
    row = lambda df, t, rank, n, ids, question, sign: df.select("_r", c(t).alias("_t"), F.lit(rank).alias("_rank"), n.alias("_n"), ids.alias("_ids"), question.alias("question_id"), F.lit(sign).alias("_sign"))
    met = q.join(meet.select("_q", "_r"), "_q")
    one, kind = F.lit(1).cast("long"), dict(questions.dtypes)["question_id"]
    # At one instant: questions that start there, then records that start or end, then questions that end there.
    rows = row(r, "_s", 1, one, c("id").cast("long"), none.cast(kind), 0).unionByName(row(r, "_e", 1, -one, -c("id").cast("long"), none.cast(kind), 0))
    rows = rows.unionByName(row(met, "_s", 0, zero, zero, c("question_id"), -1)).unionByName(row(met, "_e", 2, zero, zero, c("question_id"), 1)).withColumn("_bin", F.floor(c("_t") / us))
    begun, ended = lambda x: F.when(c("_n") > 0, c(x)).otherwise(zero), lambda x: F.when(c("_n") < 0, -c(x)).otherwise(zero)
    sums = {"_bn": begun("_n"), "_bi": begun("_ids"), "_en": ended("_n"), "_ei": ended("_ids")}
    before = Window.partitionBy("_r").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("_r", "_bin").agg(*(F.sum(x).alias(n) for n, x in sums.items()))
    bins = bins.select("_r", "_bin", *(F.coalesce(F.sum(n).over(before), zero).alias(f"{n}0") for n in sums))
    within = Window.partitionBy("_r", "_bin").orderBy("_t", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.select("_r", "_bin", "question_id", "_sign", *(F.sum(x).over(within).alias(n) for n, x in sums.items())).where("_sign <> 0").join(bins, ["_r", "_bin"])
    part = lambda n: F.when(c("_sign") > 0, c(f"_b{n}") + c(f"_b{n}0")).otherwise(-c(f"_e{n}") - c(f"_e{n}0"))
    each = told.groupBy("question_id", "_r").agg(F.sum(part("n")).alias("n"), F.sum(part("i")).alias("ids")).where("n > 0")
    kinds = meet.select("_r", "kind").distinct()
    return each.join(kinds, "_r").groupBy("question_id").agg(F.sum("n").alias("n_records"), F.sum("ids").alias("ids"), F.count_distinct("kind").alias("n_kinds"))


ROWS, AT_ONCE = 128, 4096  #: records that so many questions look at in one step


def _first_fit(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    """What each question takes of the records, read in their order until nothing more can be let in."""
    out, s, e, cost = [], r["_s"].to_numpy(), r["_e"].to_numpy(), r["_cost"].to_numpy()
    least = np.minimum.accumulate(cost[::-1])[::-1] if len(cost) else cost  # of what is still to come
    for at in range(0, len(q), AT_ONCE):
        some = q.iloc[at : at + AT_ONCE]
        qs, qe, items, tokens = (some[c].to_numpy().copy() for c in ("_s", "_e", "max_items", "max_tokens"))
        live = np.arange(len(some))
        for k in range(0, len(r), ROWS):
            live = live[(items[live] > 0) & (tokens[live] >= least[k])]
            if not len(live):
                break
            some_r = slice(k, k + ROWS)
            fits = (s[some_r] <= qe[live, None]) & (e[some_r] >= qs[live, None])
            who = np.arange(len(live))
            while len(who):  # each turn every question takes the first that it can
                own = live[who]
                fits[who] &= (cost[some_r] <= tokens[own, None]) & (items[own, None] > 0)
                first = fits[who].argmax(axis=1)
                hit = fits[who, first]
                who, own, first = who[hit], own[hit], first[hit]
                tokens[own] -= cost[k + first]
                items[own] -= 1
                fits[who, first] = False
                fits[who] &= np.arange(fits.shape[1]) > first[:, None]
                out.append(pd.DataFrame({"question_id": some["question_id"].to_numpy()[own], "_place": k + first}))
    taken = pd.concat(out) if out else pd.DataFrame({"question_id": q["question_id"].iloc[:0], "_place": np.zeros(0, np.int64)})
    return taken.assign(id=r["id"].to_numpy()[taken["_place"]], _cost=cost[taken["_place"]])[["question_id", "id", "_cost"]]


def chosen(questions: DataFrame, records: DataFrame, order: Sequence[str], cost: str = "token_cost", by: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """(question_id, id, cost) of the records that :func:`asked` finds and :func:`budgeted` would select, without the pairs that are not.

    A question stands in the bin where it starts, at the level whose bins are as long as its window; records stand in every bin whose
    questions they may overlap.  Bins are four times the records' mean length at the least, so that copies are few and most
    records of a bin fit: a question has read enough after a number of them that does not depend on how many there are.
    """
    q, r, meet = _profiled(questions, records, by)
    mean = r.agg(F.avg((F.col("_e") - F.col("_s")) / 1_000_000)).first()[0] or 0
    width = max(width, int(4 * mean))
    wide = lambda level: (F.lit(width * 1_000_000) * F.pow(F.lit(float(GROWTH)), level)).cast("long")
    q = q.withColumn("_level", _level(F.col("_s") / 1_000_000, F.col("_e") / 1_000_000, width)).withColumn("_bin", F.floor(F.col("_s") / wide("_level")))
    levels = q.select("_q", "_level").distinct()
    first, last = F.floor(F.col("_s") / wide("_level")) - 1, F.floor(F.col("_e") / wide("_level"))
    r = r.join(meet.select("_q", "_r").join(levels, "_q"), "_r").select("_q", "_level", F.explode(F.sequence(first, last)).alias("_bin"), "id", "_s", "_e", F.col(cost).cast("long").alias("_cost"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    ways = [f"_o{i}" for i in range(len(order))]
    key, kinds = ["_q", "_level", "_bin"], dict(questions.dtypes) | {"id": dict(records.dtypes)["id"]}

    def fit(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _first_fit(a, b.sort_values(ways, kind="stable"))

    a = q.select(*key, "question_id", "_s", "_e", F.col("max_items").cast("long").alias("max_items"), F.col("max_tokens").cast("long").alias("max_tokens"))
    r = r.withColumnsRenamed({c: f"{c}r" for c in key})
    return a.groupBy(*key).cogroup(r.groupBy(*(f"{c}r" for c in key))).applyInPandas(fit, f"question_id {kinds['question_id']}, id {kinds['id']}, _cost long").withColumnRenamed("_cost", cost)


def budgeted(questions: DataFrame, found: DataFrame, order: list, cost: str = "token_cost") -> DataFrame:
    """``found`` (question_id, ...) with what each question's own limits (max_items, max_tokens) let in: position, selected, tokens_before, reason."""
    q = questions.select("question_id", "max_items", "max_tokens")
    j = found.join(q, "question_id")
    return evidence.greedy_select(j, ["question_id"], order, F.col("max_items"), F.col("max_tokens"), cost).drop("max_items", "max_tokens")

