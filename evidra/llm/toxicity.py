"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) train a linear classifier in numpy.
With class prior pi the risk of taking U as negative is corrected by what P contributes to
it, and kept from going below zero (Kiryo et al., 2017):

    R = pi R_P(+) + max(0, R_U(-) - pi R_P(-))

Features are words and word beginnings, chosen by how much more often they stand in P than
in the negative part of U.  The fit uses a bounded sample (``MAX_POSITIVE``,
``MAX_UNLABELLED``, ``FEATURES``); every text is scored whole.  Inputs of a score are the
text's words alone.

Defined results: null and empty texts have no features and score the intercept.  Without a confirmed toxic
text every score is 0.  Labels are learned from rows whose crc32(doc_id) mod 3 is not 1; of a text that stands
more than once the sample holds one row, and rows that share an id share its label.  Ties between features go to
the smaller name.  Very long texts are scored whole, in bounded batches (a text beyond the bound alone).  An empty
table gives no rows.  Columns other than doc_id and text are left as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm import shared

MAX_POSITIVE = 8192
MAX_UNLABELLED = 16384
FEATURES = 512
MIN_TEXTS = 4  #: distinct positive texts a feature must stand in
BEYOND = 5.0  #: standard errors by which a feature's rate in P must exceed that in U
PURE = 0.6  #: least share of toxic texts among those with a feature, as estimated from P, U and the prior
CUT = 0.7
EPOCHS, RATE, DECAY = 400, 0.1, 1e-4
_MARKS = ".,;:!?%&*$#|\"'()[]{}<>-_~`"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features_of_word(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four to eight letters."""
    word = word.strip(_MARKS)
    return (word, *("^" + word[:n] for n in range(4, min(len(word), 8) + 1))) if word else ()


def features_of(text: str) -> set[str]:
    return {f for w in set(text.lower().split()) for f in features_of_word(w)}


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, text, p, u) of the bounded training sample, and the class prior among learned labels."""
    own = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    r = own.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    prior = (r.k or 0) / r.n if r.n else 0.0
    positive = own.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(MAX_POSITIVE).withColumn("p", F.lit(True))
    total = max(1, docs.count())
    share = min(1.0, MAX_UNLABELLED / total)
    chosen = F.pmod(F.xxhash64(F.lit("u"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    u = chosen & ~held_out(F.col("doc_id"))
    s = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(positive), "doc_id", "left").withColumn("p", F.coalesce("p", F.lit(False))).withColumn("u", u).where("p or u").dropDuplicates(["text", "p"])
    return shared.materialise(s, "toxic-sample"), prior


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shared.small_batches(batches, 1024, "text"):
        p, u = Counter(), Counter()
        for text, is_p, is_u in zip(batch.column("text").to_pylist(), batch.column("p").to_pylist(), batch.column("u").to_pylist(), strict=True):
            own = features_of(text or "")
            if is_p:
                p.update(own)
            if is_u:
                u.update(own)
        if p or u:
            names = list(p | u)
            yield pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), "p": pa.array([p[x] for x in names], pa.int64()), "u": pa.array([u[x] for x in names], pa.int64())})


def choose_features(s: DataFrame, n_p: int, n_u: int, prior: float) -> list[str]:
    """The features that tell most: rate in P times its log ratio to the rate in U less P's part."""
    p = F.col("p") / n_p
    u = (F.col("u") + MIN_TEXTS) / (n_u + MIN_TEXTS)
    # How far the rate in P lies beyond that in U, in standard errors: chance words of a small sample stay out.
    beyond = (p - u) / F.sqrt(u * (1.0 / n_p + 1.0 / max(1, n_u)))
    negative = F.greatest(F.lit(0.0), u - prior * p) / max(1e-6, 1 - prior) + 1.0 / (n_u + 1)
    counts = s.mapInArrow(_count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    best = counts.where((F.col("p") >= MIN_TEXTS) & (beyond >= BEYOND) & (prior * p >= PURE * u)).withColumn("gain", p * F.log(p / negative)).orderBy(F.desc("gain"), "f").limit(FEATURES)
    return [r.f for r in best.select("f").collect()]


def risk(z: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores z with the logistic loss, and the slope that a step follows.

    With l(+) = log(1 + exp(-z)) and l(-) = log(1 + exp(z)): prior mean_P l(+) + max(0, mean_U l(-) - prior mean_P l(-)).
    Below zero the second term is fitted noise; its slope is followed upwards then, as the method's authors do.
    """
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    negative = np.logaddexp(0, z)
    rest = (negative * u).sum() / n_u - prior * (negative * p).sum() / n_p
    total = prior * (np.logaddexp(0, -z) * p).sum() / n_p + max(0.0, rest)
    rest_slope = s * u / n_u - prior * s * p / n_p
    return float(total), prior * (s - 1) * p / n_p + rest_slope if rest >= 0 else -rest_slope


def fit(rows: list[list[int]], p: np.ndarray, u: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept: Adam on the non-negative risk; rows hold feature numbers."""
    size = np.array([len(r) for r in rows])
    index = np.array([i for r in rows for i in r], np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    w = np.zeros(n_features + 1)  # the last is the intercept
    w[-1] = np.log(max(prior, 1e-3) / (1 - min(prior, 0.999)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(row, weights=w[index], minlength=len(rows)) + w[-1]
        _, g = risk(z, p, u, prior)
        grad = np.append(np.bincount(index, weights=g[row], minlength=n_features), g.sum())
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float] | None:
    """Weights by feature and the intercept, or None without a confirmed toxic text."""
    s, prior = sample(docs, labels)
    r = s.agg(F.sum(F.col("p").cast("int")).alias("p"), F.sum(F.col("u").cast("int")).alias("u")).first()
    if not r.p:
        return None
    names = choose_features(s, r.p, r.u or 0, prior)
    number = {f: i for i, f in enumerate(names)}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 1024, "text"):
            own = [sorted(number[f] for f in features_of(t or "") if f in number) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "p": batch.column("p"), "u": batch.column("u"), "x": pa.array(own, pa.list_(pa.int32()))})

    # At most MAX_POSITIVE + MAX_UNLABELLED rows (about) of at most FEATURES numbers.
    got = sorted(s.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "p", "u").mapInArrow(rows_of, "doc_id long, p boolean, u boolean, x array<int>").collect(), key=lambda r: (r.doc_id or 0, r.x))
    w, b = fit([r.x for r in got], np.array([r.p for r in got], float), np.array([r.u for r in got], float), len(names), prior)
    return dict(zip(names, w.tolist(), strict=True)), b


def _score(model: tuple[dict[str, float], float] | None):
    weights, bias = model or ({}, -60.0)

    class Hits(dict):
        """word -> its features that have weights; remembered up to a bound."""

        def __missing__(self, word: str) -> tuple[str, ...]:
            if len(self) >= 100_000:
                self.clear()
            out = self[word] = tuple(f for f in features_of_word(word) if f in weights)
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits()
        for batch in shared.small_batches(batches, 512, "text"):
            scores = []
            for text in batch.column("text").to_pylist():
                own = {f for w in set((text or "").lower().split()) if (h := hits[w]) for f in h}
                z = bias + sum(weights[f] for f in sorted(own))
                scores.append(0.0 if model is None else float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
            columns = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"_score": pa.array(scores, pa.float64())})

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``_score``."""
    model = train(docs, labels)
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])
    return docs.mapInArrow(_score(model), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    d = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    d = shared.neutral(docs)
    return scored(d, labels).where(F.col("_score") < CUT).select(*d.columns).toDF(*docs.columns)
