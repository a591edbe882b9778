"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits are grouped so that correlated ones share a partition; each partition i gets its
own threshold T_i >= -1 with sum(T_i + 1) = tau + 1, by dynamic programming on
candidate counts estimated from the bit statistics of all fingerprints.  Two
fingerprints within tau bits differ in at most T_i bits of some partition i, so they
share a signature: the partition with some T_i of its bits masked out.  Fingerprints
meet by signature, are verified, and linked by a forest of edges, never by all pairs.

Only distinct fingerprints are probed; copies follow their fingerprint.  A bucket beyond ``MAX_BUCKET`` is dealt anew on
further bits (exact: the rest must agree on one of tau + 1 parts) before it is verified.

Defined results: null and wordless texts have fingerprint zero and are linked like any other.  Repeated rows, and
rows that share an id, are reported each; a null id counts as no id, so a group of such rows alone has a null
component.  Ties (a bit set in exactly half the hashes) leave the bit unset.  Very long texts are read in
bounded batches (a text beyond the bound alone).  An empty table gives no rows.  Columns other than doc_id and text
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import graph, shared

BITS = 64
TAU = 4
SHINGLE = 4
SEED = 42
MAX_BUCKET = 4_000_000  #: fingerprints one task verifies together at most
DIRECT = 2048  #: fingerprints compared each with each, in blocks
#: Relative costs of one signature row (shuffle, sort) and of one verified pair.
ROW_COST, PAIR_COST = 2e-6, 2e-8


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text: majority of each bit over its 4-word shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, counts = len(words) - SHINGLE + 1, np.zeros((8, 8), np.int64)
    for at in range(0, n, 50_000):  # a long text's hashes part by part
        to = min(n, at + 50_000)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + SHINGLE - 1 : to + SHINGLE - 1].tolist(), strict=True)]
        own = np.array(hashes, np.uint64).view(np.uint8).reshape(to - at, 8) + (np.arange(8, dtype=np.uint16) * 256)
        counts += np.bincount(own.ravel(), minlength=8 * 256).reshape(8, 256) @ _BIT_TABLE  # per byte, per bit
    set_bits = (2 * counts.ravel() > n).astype(np.uint8)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 512, "text"):
            fps = np.array([fingerprint(t) for t in shared.binary(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fps)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- planning -----------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for every two bits how many set both.

    Each task sums its own 64 x 64 counts; at most 2,080 rows a task are shuffled and 2,080 collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.float64)
        for batch in batches:
            x = np.unpackbits(batch.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "n": pa.array(total[i, j].astype(np.int64))})

    both = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = both[r.j, r.i] = r.n
    return fps.count(), both


def match_probabilities(n: int, both: np.ndarray) -> np.ndarray:
    """For every two bits, the chance that two random fingerprints agree on both (on the diagonal: on one)."""
    p = both / max(n, 1)
    one = np.diag(p)
    a, b = one[:, None], one[None, :]
    q = p**2 + (a - p) ** 2 + (b - p) ** 2 + (1 - a - b + p) ** 2
    np.fill_diagonal(q, one**2 + (1 - one) ** 2)
    return q


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of nearly equal width; each grows by the bit most correlated with it."""
    p = both / max(n, 1)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    corr = np.abs((p - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        seed = max(left, key=lambda b: (corr[b, left].max(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            b = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def mismatch_chances(group: list[int], q: np.ndarray, most: int) -> np.ndarray:
    """Chance that two random fingerprints differ in exactly d bits of a group, d = 0..most.

    Each bit agrees with the chance given the earlier bit of the group that tells most about it.
    """
    dist = np.zeros(most + 2)
    dist[0] = 1
    for k, b in enumerate(group):
        agree = max([q[b, b], *(q[b, c] / max(q[c, c], 1e-12) for c in group[:k])])
        agree = min(1.0, agree)
        dist[1:] = dist[1:] * agree + dist[:-1] * (1 - agree)
        dist[0] *= agree
    return dist[: most + 1]


def allocate(costs: np.ndarray, tau: int) -> tuple[float, list[int]]:
    """Thresholds with sum(T_i + 1) = tau + 1 of least total cost; costs[i, T + 1] is partition i's cost at T (0 at -1)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t1 in range(min(tau + 1 - used, len(row) - 1) + 1):
                new = (cost + row[t1], [*chosen, t1 - 1])
                if used + t1 not in step or new[0] < step[used + t1][0]:
                    step[used + t1] = new
        best = step
    return best[tau + 1]


def plan(n: int, both: np.ndarray, tau: int = TAU) -> list[tuple[int, list[int]]]:
    """The signatures to make: (mask of a group's bits, masks of what stays after leaving T bits out) per used partition."""
    q, best = match_probabilities(n, both), None
    for m in range(2, tau + 4):
        groups = group_bits(both, n, m)
        costs = np.zeros((m, tau + 2))
        for i, g in enumerate(groups):
            below = np.cumsum(mismatch_chances(g, q, tau))
            for t in range(tau + 1):
                costs[i, t + 1] = comb(len(g), t) * n * ROW_COST + n * n / 2 * below[t] * comb(len(g), t) ** 0.5 * PAIR_COST
        cost, chosen = allocate(costs, tau)
        if best is None or cost < best[0]:
            best = (cost, groups, chosen)
    made = []
    for g, t in zip(best[1], best[2], strict=True):
        if t >= 0:
            whole = sum(1 << b for b in g)
            made.append((whole, [whole & ~sum(1 << b for b in out) for out in combinations(g, t)]))
    return made


# --- probing and verifying ----------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(fps: DataFrame, made: list[tuple[int, list[int]]]) -> DataFrame:
    """(key, used, fp): one row per signature; used are the partition's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 20_000):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for whole, masks in made:
                used = np.full(len(fp), np.uint64(whole)).view(np.int64)
                for mask in masks:
                    key = _mix((fp & np.uint64(mask)) + _mix(np.uint64([mask])))
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "used": pa.array(used), "fp": batch.column("fp")})

    return fps.select("fp").mapInArrow(run, "key long, used long, fp long")


def rest_parts(used: int, tau: int = TAU) -> list[int]:
    """The bits outside ``used`` in tau + 1 parts: two fingerprints within tau bits agree on one of them."""
    rest = [b for b in range(BITS) if not used >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(rest, tau + 1) if len(part)] if len(rest) > tau else []


def refined(rows: DataFrame, tau: int = TAU) -> DataFrame:
    """Rows of too large buckets, dealt anew by a further part of their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, used, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "used", "fp"))
            for u in np.unique(used):
                own = used == u
                for part in rest_parts(int(u), tau):
                    new = _mix(key[own] ^ _mix((fp[own] & np.uint64(part)) + _mix(np.uint64([part]))))
                    yield pa.RecordBatch.from_pydict({"key": pa.array(new.view(np.int64)), "used": pa.array(np.full(len(new), u | np.uint64(part)).view(np.int64)), "fp": pa.array(fp[own].view(np.int64))})

    return rows.select("key", "used", "fp").mapInArrow(run, "key long, used long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index each of n nodes reaches by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def linked(fp: np.ndarray, used: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices) that connect whatever links within tau bits among distinct fingerprints that share a bucket."""
    n = len(fp)
    parts = rest_parts(used, tau)
    if n <= DIRECT or not parts:
        root = np.arange(n)
        for start in range(0, n, 256):
            for other in range(start, n, DIRECT):
                near = np.bitwise_count(fp[start : start + 256, None] ^ fp[None, other : other + DIRECT]) <= tau
                i, j = np.nonzero(near)
                i, j = i + start, j + other
                keep = (i < j) & (root[i] != root[j])
                i, j = i[keep], j[keep]
                if len(i):
                    root = _roots(n, np.concatenate([root, i]), np.concatenate([np.arange(n), j]))
        moved = np.flatnonzero(root != np.arange(n))
        return moved, root[moved]
    at, to = [], []
    for part in parts:
        value = fp & np.uint64(part)
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for some in np.split(order, cuts):
            if len(some) > 1:
                i, j = linked(fp[some], used | part, tau)
                at.append(some[i])
                to.append(some[j])
    at, to = np.concatenate(at or [np.zeros(0, int)]), np.concatenate(to or [np.zeros(0, int)])
    root = _roots(n, at, to)
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _verify(key: np.ndarray, used: np.ndarray, fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links within the buckets of sorted whole groups, as fingerprints."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    at, to = [], []
    small = np.repeat(size <= 64, size)
    idx = np.flatnonzero(small)
    for d in range(1, int(size[size <= 64].max(initial=1))):
        idx = idx[idx + d < len(key)]
        idx = idx[key[idx] == key[idx + d]]
        if not len(idx):
            break
        near = idx[np.bitwise_count(fp[idx] ^ fp[idx + d]) <= tau]
        at.append(near)
        to.append(near + d)
    for f, s in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        i, j = linked(fp[f : f + s], int(used[f]), tau)
        at.append(i + f)
        to.append(j + f)
    if not at:
        return fp[:0], fp[:0]
    own, inverse = np.unique(fp, return_inverse=True)
    root = _roots(len(own), inverse[np.concatenate(at)], inverse[np.concatenate(to)])
    moved = np.flatnonzero(root != np.arange(len(own)))
    return own[moved], own[root[moved]]


def links(rows: DataFrame, tau: int = TAU) -> DataFrame:
    """(u, v): verified links of ``rows`` (key, used, fp), a forest per batch of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows_held = 0

        def out(x: np.ndarray) -> pa.RecordBatch:
            u, v = _verify(x[0], x[1], x[2], tau)
            return pa.RecordBatch.from_pydict({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("key", "used", "fp")]))
            rows_held += batch.num_rows
            if rows_held >= 200_000:
                x = np.concatenate(held, axis=1)
                whole = int(np.flatnonzero(x[0] != x[0, -1])[-1]) + 1 if (x[0] != x[0, -1]).any() else 0
                if whole:
                    yield out(x[:, :whole])
                held = [x[:, whole:]]
                rows_held = x.shape[1] - whole if whole else 0  # one bucket so far: wait for as many again
        if held and (x := np.concatenate(held, axis=1)).shape[1]:
            yield out(x)

    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def all_links(fps: DataFrame, tau: int = TAU, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (u, v) that connect all of ``fps`` (distinct fp) within tau bits."""
    n, both = bit_statistics(fps)
    rows = signatures(fps, plan(n, both, tau))
    if n > max_bucket:  # else no bucket can be larger
        ready = None
        while True:
            hot = shared.materialise(rows.groupBy("key", "used").count().where(F.col("count") > max_bucket).where(F.bit_count(F.col("used")) <= BITS - tau - 1).select("key"), "hot")
            if hot.isEmpty():
                break
            cold = rows.join(F.broadcast(hot), "key", "left_anti")  # at most rows / max_bucket keys
            ready = cold if ready is None else ready.unionByName(cold)
            rows = shared.materialise(refined(rows.join(F.broadcast(hot), "key", "left_semi"), tau), "refined")
        rows = rows if ready is None else ready.unionByName(rows)
    return links(rows, tau)


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp, component_id (the least doc_id reachable)."""
    fps = shared.materialise(fingerprints(docs), "fps")
    n = fps.count()
    nodes = shared.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes", rows=n)
    roots = graph.components(all_links(nodes.select("fp"), tau), nodes=n)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return shared.fewer(fps.join(rooted.join(component, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id"), n)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
