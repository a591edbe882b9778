"""Connected components as alternating star contractions over an edge table, cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.shared import discard, materialise


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """(node, root) of every node with an edge in ``edges`` (u, v: long), root being the least node it reaches.

    Both minima are pre-aggregated before their shuffle, and a hub's rows can be split by
    adaptive execution.  Rounds grow with the logarithm of the longest path.
    ``nodes``: how many there may be, if that is known; sizes the first table's files as the edges do those of the others.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows=nodes)
    mark = _mark(e)
    while mark[0]:
        new = materialise(_small(_large(e)), "edges", rows=mark[0])
        discard(e)
        e, before = new, mark
        mark = _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
