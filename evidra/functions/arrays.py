"""Scans over arrays as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 128  #: items that one step of a scan holds


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once, however often and wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, place: Callable[[Column, Column], tuple[Column, Column]], shape: str) -> Column:
    """The array (of type ``shape``) of what ``place(state, item)`` -> (state, out) gives from left to right.

    In steps, so that an array being built is short: a long one would be copied for every item.  An array of one step goes without slices.
    """

    def within(state: Column, some: Column) -> Column:
        start = F.struct(state.alias("s"), F.array().cast(shape).alias("out"))

        def add(acc: Column, x: Column) -> Column:
            s, out = place(acc["s"], x)
            return F.struct(s.alias("s"), F.concat(acc["out"], F.array(out)).alias("out"))

        return F.aggregate(some, start, add)

    def whole(items: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(STEP)), lambda i: F.slice(items, i + 1, STEP))
        first = F.array(F.struct(zero.alias("s"), F.array().cast(shape).alias("out")))
        done = F.aggregate(steps, first, lambda acc, some: F.concat(acc, F.array(within(F.element_at(acc, -1)["s"], some))))
        return F.flatten(F.transform(done, lambda x: x["out"]))

    def either(items: Column) -> Column:
        return F.when(F.size(items) <= STEP, within(zero, items)["out"]).otherwise(whole(items))

    return F.when(F.size(items) > 0, let(items, either)).otherwise(F.array().cast(shape))
