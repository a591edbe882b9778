"""The quality classifier: held-out accuracy, flattened trees against a plain walk, statistics, edge cases."""

import zlib

import numpy as np
import pytest

from evidra.llm import quality

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    own = [(got[i].score, y) for i, y in truth.items() if got[i].held_out]
    good, bad = [s for s, y in own if y == 1], [s for s, y in own if y == 0]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert len(bad) >= 5 and auc >= 0.97
    assert sum((s >= 0.3) == (y == 1) for s, y in own) / len(own) >= 0.95


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(800, 6)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.fit(x, y, trees=12, depth=3)

    def walk(t, row):
        node = 0
        while node < 7:
            node = 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1)
        return trees.value[t, node - 7]

    plain = np.array([trees.base + sum(walk(t, row) for t in range(12)) for row in x])
    assert np.allclose(trees.raw(x), plain)
    assert ((trees.score(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x, y = np.round(rng.normal(size=(300, 3)), 1), rng.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 0.4] = 1
    trees = quality.fit(x, y, trees=1, depth=1)
    share = (y.sum() + 1) / (len(y) + 2)
    g, h = share - y, np.full(len(y), share * (1 - share))
    gain = lambda k: g[k].sum() ** 2 / (h[k].sum() + 1)
    best = max((gain(x[:, f] <= c) + gain(x[:, f] > c), -f, -c) for f, edges in enumerate(quality.edges_of(x)) for c in edges if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) >= quality.MIN_ROWS)
    assert (trees.feature[0, 0], trees.threshold[0, 0]) == (-best[1], pytest.approx(-best[2]))


def test_statistics(monkeypatch):
    one = dict(zip(quality.NAMES, quality.statistics("Ab ab ab!! X1 é% \n\nab ab\nab ab\n"), strict=True))
    assert one["words"] == pytest.approx(np.log1p(9)) and one["distinct"] == pytest.approx(5 / 9) and one["adjacent"] == pytest.approx(3 / 8)
    assert one["repeated_lines"] == pytest.approx(1 / 3) and one["digit_words"] == pytest.approx(1 / 9) and one["symbol_ends"] == pytest.approx(1 / 9)
    assert one["shout_ends"] == pytest.approx(1 / 9) and one["title_words"] == pytest.approx(1 / 9) and one["top_pair"] == pytest.approx(3 / 8)
    assert quality.statistics("") == [0.0] * 25 + [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    text = "one two, THREE 4 five%% " * 500
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "PIECE", 100)
    assert quality.statistics(text) == pytest.approx(whole)


def test_edges(spark):
    texts = [None, "", "plain words here.", "plain words here.", "x" * 2_000_000, "@@@ ### " * 1000, "퟿ ünï"]
    docs = spark.createDataFrame([(i if i != 6 else None, t, "a", 0.5, "b") for i, t in enumerate(texts)], "doc_id long, text string, y string, _score double, x string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.report(docs, labels).collect()
    assert len(rows) == len(texts) and rows[0].score == rows[1].score and rows[2].score == rows[3].score
    assert {r.score for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.report(docs.limit(0), labels).count() == 0
    assert quality.keep(docs, labels, 0.0).columns == docs.columns and quality.keep(docs, labels, 0.0).count() == len(texts)
    assert quality.keep(docs, labels, 1.1).count() == 0


def test_many_rows_of_one_id_stay_within_the_bound(spark):
    docs = spark.range(3000).selectExpr("2L doc_id", "concat('text ', id) text")
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert quality.train(docs, labels, max_train=100) is not None
