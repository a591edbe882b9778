"""The pipeline's near-duplicate stage against brute force over word shingles."""

import numpy as np

import corpus_pipeline
from evidra.llm import resemblance, shared


def _sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def _least(rows):
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    sets = [(i, _sets(t)) for i, t in rows]
    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if len(x & y) >= 0.8 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in root}


def _edited(words, places, mark):
    return " ".join(f"{mark}{k}" if k in places else w for k, w in enumerate(words))


def test_stage_finds_edited_copies(spark):
    shared.ship(spark)
    rng = np.random.default_rng(5)
    rows = [(0, None), (1, " \n"), (2, "two words"), (3, "Two  WORDS")]
    for f in range(20):  # four replaced words of 200: similarity 0.81; six: 0.73
        words = [f"x{v}" for v in rng.integers(0, 5000, 200)]
        rows += [(100 + 3 * f, " ".join(words)), (101 + 3 * f, _edited(words, {20, 70, 120, 170}, "new")), (102 + 3 * f, _edited(words, {10, 40, 80, 110, 140, 180}, "other"))]
    words = [f"y{v}" for v in range(120)]
    rows += [(500 + k, _edited(words, {int(rng.integers(0, 120))}, f"one{k}_")) for k in range(90)]  # one bucket beyond PAIRED
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == _least(rows)
    assert resemblance.keep_one(docs.limit(0)).count() == 0


def test_rest_of_large_buckets(spark, monkeypatch):
    """Texts of one long passage each share keys without being alike; all pairs that are alike must still be among those to check."""
    shared.ship(spark)
    rng = np.random.default_rng(6)
    passage = [f"p{v}" for v in range(110)]
    rows = [(5000 + k, f"short {k // 2}") for k in range(6)]
    for k in range(120):
        words = passage + [f"own{k}x{v}" for v in range(30)]
        rows.append((2 * k, " ".join(words)))
        if k % 3 == 0:
            rows.append((2 * k + 1, _edited(words, {int(rng.integers(115, 140))}, f"new{k}")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    name = {i: resemblance.identity(resemblance.shingles(t.encode(), 5)) for i, t in rows}
    least = {}
    for i, h in name.items():
        least[h] = min(i, least.get(h, i))
    nodes = spark.createDataFrame(list(least.items()), "h long, least long")
    keys = nodes.selectExpr("1L AS key", "h")
    linked = (name[0], name[1])
    roots = spark.createDataFrame([(linked[0], min(linked)), (linked[1], min(linked))], "node long, root long")
    sets = {h: _sets(dict(rows)[i]) for h, i in least.items()}
    hs = sorted(sets)
    alike = {(a, b) for k, a in enumerate(hs) for b in hs[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(alike) >= 40
    for block in (resemblance.BLOCK, 30):
        monkeypatch.setattr(resemblance, "BLOCK", block)
        got = {(r.u, r.v) for r in resemblance.rest(docs, nodes, keys, roots, 5, 0.8).collect()}
        assert got <= alike and len(got) < 100
        # With what was joined before, the links found reach as far as all of them.
        assert _groups(hs, got | {tuple(sorted(linked))}) == _groups(hs, alike | {tuple(sorted(linked))})
    one = spark.createDataFrame([(h, 1) for h in hs], "node long, root long")
    assert resemblance.rest(docs, nodes, keys, one, 5, 0.8) is None


def _groups(nodes, links):
    root = {h: h for h in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_shared_ids_and_null_ids(spark):
    shared.ship(spark)
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, t, "x"), (1, u, "y"), (2, t, "z"), (None, u, "v"), (None, "alone", "w"), (3, "alone", "q"), (3, "alone", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    kept = resemblance.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text, r.h) for r in kept.collect())) == sorted([(0, u, "v"), (0, "alone", "w"), (1, t, "x")])
