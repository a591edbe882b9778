"""Centroid clustering filtered through ball trees.

Vectors become integers and are put into metric trees, each over at most ``TREE`` vectors of one partition and
written once.  A node (ball) holds its count, the exact integer sum of its vectors and the radius about their mean.
A round walks every tree from its root with the centroids that can still be nearest: by the triangle inequality a
centroid b is out for all of a ball when d(b, mean) - radius > d(a, mean) + radius for another a.  When one is left,
the ball's count and sum go to it whole; a leaf that several reach is settled vector by vector with exact integer
distances.  Distances of means are rounded numbers, so a centroid goes only if it loses by more than their error.
What a task adds up is a row per centroid and component; Spark sums these, and the driver holds the centroids alone.

Defined results: rows with a null vector, another number of components than asked for, or a null or non-finite
component are not there.  Repeated rows and ids are vectors of their own; among equal hashes the vectors' components
decide, a null id comes last.  Fewer vectors than centroids: as many centroids as vectors.  Ties go to the smaller
number.  Components and distances beyond the range of a long are the range's end.  An empty table gives no rows.
Only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import shared, vectors

TREE = 512  #: vectors of a tree
LEAF = 16
SCALE = 1024
DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
ERROR = 1e-9  #: beyond the relative error of a distance in doubles
BATCH_BYTES = 8 << 20
FOREST = "ids array<long>, points binary, first array<int>, last array<int>, right array<int>, radius array<double>, sums array<decimal(38,0)>"


def kept(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, q) of the vectors that take part."""
    t = vectors.valid(embeddings.select("vec_id", "embedding").where(F.size("embedding") == dimensions))
    return t.select(F.col("vec_id").cast("long").alias("id"), vectors.scaled("embedding", SCALE).alias("q"))


def tree_of(q: np.ndarray) -> tuple[np.ndarray, dict[str, list]]:
    """The order of the vectors in a ball tree and its nodes, parents before children, the left child next to its parent."""
    order = np.arange(len(q))
    nodes: dict[str, list] = {"first": [], "last": [], "right": [], "radius": [], "sums": []}
    x = q.astype(np.float64)
    todo = [(0, len(q), -1)]
    while todo:
        lo, hi, parent = todo.pop()
        at, own = len(nodes["first"]), order[lo:hi]
        if parent >= 0:
            nodes["right"][parent] = at
        total = [int(s) for s in (q[own].sum(0) if vectors.largest(q[own]) < 2**50 else q[own].astype(object).sum(0))]
        p = x[own]
        mean = np.array([float(s) for s in total]) / len(own)
        radius = float(np.sqrt(((p - mean) ** 2).sum(1).max()))
        for k, v in (("first", lo), ("last", hi), ("right", -1), ("radius", radius), ("sums", total)):
            nodes[k].append(v)
        spread = np.ptp(p, axis=0)
        if len(own) > LEAF and spread.max() > 0:
            middle = len(own) // 2
            order[lo:hi] = own[np.argpartition(p[:, int(spread.argmax())], middle)]
            todo += [(lo + middle, hi, at), (lo, lo + middle, -1)]
    return order, nodes


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def trees(ids: pa.Array, q: np.ndarray) -> pa.RecordBatch:
        order, n = tree_of(q)
        sums = pa.array([Decimal(s) for node in n["sums"] for s in node], pa.decimal128(38, 0))
        columns = [ids.take(pa.array(order)), n["first"], n["last"], n["right"], n["radius"]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        lists = [pa.array([c.to_pylist() if isinstance(c, pa.Array) else c], pa.list_(t)) for c, t in zip(columns, kinds, strict=True)]
        all_sums = pa.ListArray.from_arrays(pa.array([0, len(sums)], pa.int32()), sums)
        return pa.RecordBatch.from_arrays([lists[0], pa.array([q[order].astype("<i8").tobytes()], pa.binary()), *lists[1:], all_sums], ["ids", "points", "first", "last", "right", "radius", "sums"])

    ids, held, n = [], [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, TREE):
            part = batch.slice(i, TREE)
            ids.append(part.column("id"))
            held.append(vectors.matrix(part.column("q")))
            n += part.num_rows
            if n >= TREE:
                all_ids, q = pa.concat_arrays(ids), np.vstack(held)
                yield trees(all_ids[:TREE], q[:TREE])
                ids, held, n = [all_ids[TREE:]], [q[TREE:]], n - TREE
    if n:
        yield trees(pa.concat_arrays(ids), np.vstack(held))


def plant(vectors_: DataFrame) -> DataFrame:
    """One row per tree, written to the shared folder."""
    spark = vectors_.sparkSession
    shared.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # a tree is some 300 kB
    return shared.materialise(vectors_.mapInArrow(_plant, FOREST), "forest")


class Tree:
    """A row of the forest in numpy."""

    def __init__(self, batch: pa.RecordBatch, i: int, dimensions: int):
        self.ids = batch.column("ids")[i].values
        self.q = np.frombuffer(batch.column("points")[i].as_buffer(), "<i8").reshape(-1, dimensions)
        self.first, self.last, self.right, self.radius = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("first", "last", "right", "radius"))
        sums = batch.column("sums")[i].values
        small = vectors.largest(self.q) < 2**50
        self.sums = (sums.cast(pa.int64()).to_numpy(zero_copy_only=False) if small else np.array([int(s) for s in sums.to_pylist()], object)).reshape(-1, dimensions)
        self.means = self.sums.astype(np.float64) / (self.last - self.first)[:, None]

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(node, centroids that can be nearest, whether the node goes whole to the only one) where the descent ends."""
        c = centroids.astype(np.float64)
        d = np.sqrt(((self.means[:, None, :] - c[None]) ** 2).sum(2))
        slack = ERROR * (d.max() + self.radius.max() + np.abs(c).max(initial=0) + np.abs(self.means).max(initial=0))
        todo = [(0, np.arange(len(c)))]
        while todo:
            node, left = todo.pop()
            r = self.radius[node]
            left = left[d[node, left] - r <= d[node, left].min() + r + slack]
            if len(left) == 1 or self.right[node] < 0:
                yield node, left, len(left) == 1
            else:
                todo += [(self.right[node], left), (node + 1, left)]

    def nearest(self, node: int, left: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid among those left (the smaller number of equals), and its squared distance."""
        d = vectors.squared_distances(self.q[self.first[node] : self.last[node]], centroids[left])
        best = d.argmin(1)
        return left[best], d[np.arange(len(d)), best]


def _totals(centroids: list[list[int]]):
    """Counts and sums of a task's vectors by nearest centroid, a row per centroid and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        counts, sums = [0] * len(c), [[0] * c.shape[1] for _ in c]

        def add(k: int, n: int, total: np.ndarray) -> None:
            counts[k] += n
            sums[k] = [a + int(b) for a, b in zip(sums[k], total, strict=True)]

        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree(batch, i, c.shape[1])
                exact = tree.q.astype(object) if tree.sums.dtype == object else tree.q
                for node, left, whole in tree.walk(c):
                    lo, hi = int(tree.first[node]), int(tree.last[node])
                    if whole:
                        add(int(left[0]), hi - lo, tree.sums[node])
                    else:
                        k, _ = tree.nearest(node, left, c)
                        for j in np.unique(k):
                            add(int(j), int((k == j).sum()), exact[lo:hi][k == j].sum(0))
        rows = [(k, i, counts[k], Decimal(s)) for k in range(len(c)) if counts[k] for i, s in enumerate(sums[k])]
        if rows:
            k, i, n, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.decimal128(38, 0))], ["cluster", "i", "n", "total"])

    return run


def _assigned(centroids: list[list[int]]):
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree(batch, i, c.shape[1])
                for node, left, _ in tree.walk(c):
                    k, d = tree.nearest(node, left, c)
                    lo, hi = int(tree.first[node]), int(tree.last[node])
                    yield pa.RecordBatch.from_arrays([tree.ids[lo:hi], pa.array(k, pa.int32()), pa.array(d, pa.int64())], ["id", "cluster", "distance"])

    return run


def starts(vectors_: DataFrame, k: int = CENTROIDS, salt: str = "3") -> list[list[int]]:
    """The k vectors with the least sha256 of salt and id, in that order."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    return [list(r.q) for r in vectors_.orderBy(h.asc_nulls_last(), "q").limit(k).select("q").collect()]


def step(forest: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: exact floors of means; without vectors they stay."""
    got = forest.mapInArrow(_totals(centroids), "cluster int, i int, n long, total decimal(38,0)").groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out = [list(c) for c in centroids]
    for r in got:  # at most centroids x components
        out[r.cluster][r.i] = int(r.total) // r.n
    return out


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector after so many rounds, and the centroids."""
    v = kept(embeddings, dimensions)
    forest, centroids = plant(v), starts(v, k)
    for _ in range(rounds if centroids else 0):
        centroids = step(forest, centroids)
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], "id long, cluster int, distance long"), []
    out = shared.materialise(forest.mapInArrow(_assigned(centroids), "id long, cluster int, distance long"), "clusters")
    shared.discard(forest)
    return out, centroids


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    rows, centroids = cluster(embeddings)
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid
    total = min(vectors.LIMIT, sum(sums.values()))
    told = [(k, min(vectors.LIMIT, sums.get(k, 0)), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def report_sql(rounds: int = ROUNDS) -> str:
    """The same by plain assignment of every vector to every centroid."""
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(q) AS v FROM kept)",
        "c0 AS MATERIALIZED (SELECT k, unnest(range(64)) AS i, unnest(q) AS v FROM (SELECT q, row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS k FROM kept QUALIFY k < 8))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS MATERIALIZED (SELECT r, k, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS distance FROM x JOIN c{n} c USING (i) GROUP BY r, k QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)")
        if n < rounds:
            mean = "CAST(s // n - CASE WHEN s % n <> 0 AND s < 0 THEN 1 ELSE 0 END AS BIGINT)"  # // cuts towards zero
            parts.append(f"m{n} AS MATERIALIZED (SELECT k, i, sum(v) AS s, count(*) AS n FROM d{n} JOIN x USING (r) GROUP BY k, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN n IS NULL THEN v ELSE {mean} END AS v FROM c{n} LEFT JOIN m{n} USING (k, i))")
    parts.append(f"h AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(k AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM d{rounds} JOIN kept USING (r) JOIN h USING (k)"
    )


REPORT_SQL = report_sql()
