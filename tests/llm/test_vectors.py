"""Hard negatives and centroid clustering against brute force, over vectors with nulls, ties and repeated rows."""

import hashlib
import math

import numpy as np
import pytest

from evidra.llm import balltree, negatives, vectors

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 64))
    v = [centre[i % 6] * 0.3 + 0.05 * rng.normal(size=64) for i in range(420)]
    out = [(i, [float(np.float32(x)) for x in v[i % 400]], i % 4) for i in range(420)]  # the last 20 repeat vectors of the first
    out += [out[100], out[100], out[37]]  # repeated rows
    out += [(1000, None, 1), (1001, [1.0] * 63 + [None], 1), (1002, [NAN] * 64, 1), (1003, [INF] * 64, 1), (1004, [0.1] * 64, None), (1100, [0.0] * 64, 2), (1200, [-0.25] * 64, 3), (None, v[3].tolist(), 3), (None, v[4].tolist(), 0)]
    out += [(1300, [0.5] * 10, 1), (1301, [], 1)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, q string, r int").repartition(5)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def expected_negatives(rows):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for n, (i, q, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        others = [(dot(q, q2), i2, label2) for m, (i2, q2, label2) in enumerate(kept) if m != n]
        for p, pid, _ in sorted((x for x in others if x[2] == label), key=order)[:5]:
            fits = sorted((x for x in others if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p), key=order)[:5]
            out += [(i, pid, k, nid, p, s) for k, (s, nid, _) in enumerate(fits, 1)]
    return out


def in_order(rows):
    return sorted(rows, key=repr)


def test_negatives(table, rows):
    want = expected_negatives(rows)
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.report(table).collect()]
    assert len(want) > 100 and in_order(got) == in_order(want)


def test_negatives_over_many_cells(table, rows, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "AT_ONCE", 16)
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.report(table).collect()]
    assert in_order(got) == in_order(expected_negatives(rows))


def test_negatives_of_nothing(table):
    assert negatives.report(table.limit(0)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.report(table.limit(0)).count() == 0
    assert negatives.report(table.where("vec_id % 100 = 3")).count() == 0


def test_products_stay_exact():
    for size in (2**10, 2**28, 2**40):
        a = np.array([[size + 1, -size, 3]] * 2, np.int64)
        b = np.array([[size - 1, size, -7], [1, 2, 3]], np.int64)
        want = [[max(-vectors.LIMIT, min(vectors.LIMIT, sum(int(x) * int(y) for x, y in zip(u, v, strict=True)))) for v in b] for u in a]
        assert vectors.products(a, b).tolist() == want
        d = [[min(vectors.LIMIT, sum((int(x) - int(y)) ** 2 for x, y in zip(u, v, strict=True))) for v in b] for u in a]
        assert vectors.squared_distances(a, b).tolist() == d


def expected_clusters(rows):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", q) for i, q in kept)[:8]
    c = [list(q) for _, q in first]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), k) for k, m in enumerate(c))
    for _ in range(10):
        own = [near(q)[1] for _, q in kept]
        for k in range(len(c)):
            of = [q for (_, q), j in zip(kept, own, strict=True) if j == k]
            if of:
                c[k] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = {k: sum(d for _, j, d in found if j == k) for k in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, k, d in found]


@pytest.mark.parametrize("n", [None, 5])
def test_centroids(spark, table, rows, n):
    t = table if n is None else spark.createDataFrame([r[:2] for r in rows[:n]], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in balltree.report(t).collect()]
    want = expected_clusters(rows if n is None else rows[:n])
    assert in_order(got) == in_order(want) and len(want) == (n or 428)


def test_centroids_of_nothing(table):
    out = balltree.report(table.limit(0))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_whole_balls_are_assigned_and_leaves_settled():
    rng = np.random.default_rng(0)
    q = np.vstack([rng.integers(-20, 20, (200, 64)), 5000 + rng.integers(-20, 20, (200, 64)), rng.integers(-3000, 3000, (112, 64))]).astype(np.int64)
    order, nodes = balltree.tree_of(q)
    assert sorted(order.tolist()) == list(range(512))
    for lo, hi, radius, total in zip(nodes["first"], nodes["last"], nodes["radius"], nodes["sums"], strict=True):
        own = q[order[lo:hi]]
        assert total == own.sum(0).tolist() and radius >= np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() - 1e-6
    import pyarrow as pa

    (batch,) = list(balltree._plant(iter([pa.RecordBatch.from_pydict({"id": pa.array(range(512)), "q": pa.array(q.tolist(), pa.list_(pa.int64()))})])))
    tree = balltree.Tree(batch, 0, 64)
    c = np.array([[0] * 64, [5000] * 64, [2000] * 64, [0] * 63 + [1]], np.int64)
    ends = list(tree.walk(c))
    assert sum(int(tree.last[n] - tree.first[n]) for n, _, _ in ends) == 512
    whole = sum(int(tree.last[n] - tree.first[n]) for n, _, w in ends if w)
    assert 100 < whole < 512, "some balls go whole, others are settled"
    for n, left, w in ends:
        d = vectors.squared_distances(tree.q[tree.first[n] : tree.last[n]], c)
        assert (d.argmin(1) == left[0]).all() if w else set(d.argmin(1)) <= set(left.tolist())


def test_vectors_far_apart(spark):
    far = [(i, [float(2.0 ** (30 + i % 3))] * 64) for i in range(20)] + [(20, [1e30] * 64)]
    got = balltree.report(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 21 and all(r.distance >= 0 for r in got)
