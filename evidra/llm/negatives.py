"""Hard negatives by a full score sort per anchor.

Every anchor is scored against every row by exact integer inner products.  Rows are dealt to blocks of about
``BLOCK`` and anchors to blocks of about ``ANCHORS`` by a hash of their number, so that a cell (a block of
anchors and a block of rows) is bounded whatever ids and labels repeat.  Within a cell the scores of each anchor are
sorted by score, then id (a lexsort: rows stand in id order before a stable sort by score).  The first pass
reads each anchor's best rows of its own label; the best of all cells are its positives.  The second sorts the rows
of other labels, finds each positive's upper limit by binary search and reads the next entries down to the lower
limit; the best of all cells are the negatives.  A cell returns at most k rows for an anchor or a positive, and the
k best of a sorted whole are among the k best of its parts, so nothing is lost.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part.
Vectors shorter than others count as filled up with zeros.  Every row is a row of its own: rows that share an
id are each an anchor where the id is one, and each other's candidates, so their results repeat.  A null id is no
anchor, keeps its label and comes last among ties.  Scores beyond the range of a long are the range's end.
Without anchors, or with an empty table, there are no rows.  Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm import shared, vectors

BLOCK = 8192  #: rows of a cell
ANCHORS = 8192  #: anchors of a cell
AT_ONCE = 1 << 20  #: scores that are held and sorted at a time
EVERY = 100  #: anchors are the rows whose id is divisible by this
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  #: a negative's score is at least LOW and at most HIGH hundredths of the positive's
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def relabelled(embeddings: DataFrame) -> DataFrame:
    """``embeddings`` with label (label + 1) % 10 where vec_id is divisible by 7: labels that partly disagree with the vectors."""
    label = F.col("label").cast("long")
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def numbered(embeddings: DataFrame) -> DataFrame:
    """(r, id, label, q) of the rows that take part, written once so that r stays the same."""
    t = vectors.valid(embeddings.select("vec_id", "embedding", "label").where("label is not null"))
    t = t.select(F.monotonically_increasing_id().alias("r"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vectors.scaled("embedding", SCALE).alias("q"))
    return shared.materialise(t, "negatives")


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows by id, null ids last, then by number."""
    return rows.sort_by([("id", "ascending"), ("r", "ascending")])


def _chunks(own: pa.Table, rows: pa.Table):
    """(first, scores) of some anchors at a time against all rows of the cell."""
    a, x = vectors.matrix(own.column("q")), vectors.matrix(rows.column("q"))
    width = max(a.shape[1], x.shape[1])
    a, x = vectors.widened(a, width), vectors.widened(x, width)
    step = max(1, AT_ONCE // max(1, len(x)))
    for i in range(0, len(a), step):
        yield i, vectors.products(a[i : i + step], x)


def _best_of_label(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each anchor of a cell its k first other rows of its label."""

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        anchor, entry, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if own.num_rows and rows.num_rows:
            rows = _in_order(rows)
            number, label = rows.column("r").to_numpy(), rows.column("label").to_numpy()
            own_number, own_label = own.column("r").to_numpy(), own.column("label").to_numpy()
            for first, s in _chunks(own, rows):
                order = np.argsort(-s, axis=1, kind="stable")
                for i, o in enumerate(order, first):
                    fits = o[(label[o] == own_label[i]) & (number[o] != own_number[i])][:k]
                    anchor.append(np.full(len(fits), own_number[i]))
                    entry.append(fits)
                    score.append(s[i - first, fits])
        found = np.concatenate(entry)
        take = rows.select(["id", "r"]).take(pa.array(found))
        return pa.table({"r": np.concatenate(anchor), "score": np.concatenate(score), "id": take.column("id"), "of": take.column("r")})

    return run


def _below_limits(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each positive of each anchor of a cell the k first rows of other labels between its limits."""

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        which, place, entry, score = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if own.num_rows and rows.num_rows:
            rows = _in_order(rows)
            label, own_label = rows.column("label").to_numpy(), own.column("label").to_numpy()
            limits = own.column("limits").to_pylist()
            for first, s in _chunks(own, rows):
                order = np.argsort(-s, axis=1, kind="stable")
                for i, o in enumerate(order, first):
                    o = o[label[o] != own_label[i]]
                    falling = -s[i - first, o]
                    for p, limit in enumerate(limits[i]):
                        top, least = high * limit // 100, -(-low * limit // 100)
                        start = int(np.searchsorted(falling, -top, "left"))
                        end = start + int(np.searchsorted(falling[start : start + k], -least, "right"))
                        which += [i] * (end - start)
                        place += [p] * (end - start)
                        entry.append(o[start:end])
                        score.append(-falling[start:end])
        taken, found = own.select(["r", "id"]).take(pa.array(which, pa.int64())), rows.select(["id", "r"]).take(pa.array(np.concatenate(entry)))
        return pa.table({"r": taken.column("r"), "anchor_id": taken.column("id"), "place": pa.array(place, pa.int32()), "negative_score": np.concatenate(score), "negative_id": found.column("id"), "of": found.column("r")})

    return run


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors."""
    spark = embeddings.sparkSession
    shared.ship(spark)
    t = numbered(embeddings)
    is_anchor = F.coalesce(F.col("id") % every == 0, F.lit(False))
    n = t.agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    if not n.anchors:
        return spark.createDataFrame([], OUT)
    blocks, groups = max(-(-n.rows // BLOCK), 2 * shared.partitions(spark)), -(-n.anchors // ANCHORS)
    # The stated anchors against all rows, in blocks: every row goes to each group of anchors, every anchor to each block.
    rows = t.withColumn("b", F.pmod(F.xxhash64("r"), F.lit(blocks))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    anchors = t.where(is_anchor).withColumn("g", F.pmod(F.xxhash64(F.lit("g"), "r"), F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # columns told apart from those of the rows
    near = anchors.groupBy("g", "b").cogroup(rows.groupBy("g", "b")).applyInArrow(_best_of_label(positives), "r long, score long, id long, of long")
    best = Window.partitionBy("r").orderBy(F.desc("score"), F.asc_nulls_last("id"), "of")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    # At most `positives` entries for an anchor, in their order.
    limits = near.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("p")).select("r", F.col("p.score").alias("limits"), F.col("p.id").alias("positive_ids"))
    limits = shared.materialise(limits, "positives")
    anchors = anchors.join(limits.select("r", "limits"), "r").select(*(F.col(c).alias(c) for c in (*anchors.columns, "limits")))
    found = anchors.groupBy("g", "b").cogroup(rows.groupBy("g", "b")).applyInArrow(_below_limits(negatives, low, high), "r long, anchor_id long, place int, negative_score long, negative_id long, of long")
    best = Window.partitionBy("r", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "of")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).join(limits, "r")
    return found.select("anchor_id", F.expr("positive_ids[place]").alias("positive_id"), "rank", "negative_id", F.expr("limits[place]").alias("positive_score"), "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    """The negatives of the relabelled table."""
    return mine(relabelled(embeddings))


REPORT_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM kept a, kept b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scores WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
