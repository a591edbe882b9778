"""Quality by histogram gradient-boosted trees over document statistics.

Each text becomes some thirty numbers (lengths, shares of kinds of characters and words, repetition, line shape).  The
fit takes a bounded sample of labelled rows (``MAX_TRAIN``, the least hashes of their ids): statistics are cut into at
most ``BINS`` bins at the sample's quantiles, and trees of a fixed depth are grown one level at a time from histograms
of gradients and hessians of the logistic loss.  The trees are flattened into three arrays and walked for a whole batch
and all trees at once in numpy; the statistics of every text are of the whole text, in pieces of bounded size.

Defined results: null and empty texts have statistics of zero and are scored like any other.  Without a learned label
every score is 0.5, with labels of one kind that kind's smoothed share.  Labels are learned from rows whose crc32(doc_id)
mod 5 is not 0; of several labels of one id the least counts, and rows that share an id are each learned.
Equal texts have equal scores.  An empty table gives no rows.  Only doc_id and text of the documents are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm import shared

MAX_TRAIN = 32768  #: labelled texts that are learned
BINS = 64
DEPTH = 4
TREES = 80
RATE = 0.1
MIN_ROWS = 20  #: learned texts of a leaf
REGULAR = 1.0
CUT = 0.3
PIECE = 1 << 20  #: bytes whose words are held at a time

_SENTENCE = re.compile(rb"[.!?]\s")
_SPACE = 3
NAMES = (
    "chars", "words", "word_length", "longest_word", "upper", "lower", "digits", "space", "marks", "symbols", "beyond_ascii", "entropy", "top_char",
    "upper_words", "title_words", "symbol_ends", "shout_ends", "digit_words", "wordless", "single", "distinct", "top_word", "adjacent", "distinct_pairs", "top_pair",
    "lines", "line_length", "repeated_lines", "ended_lines", "short_lines", "sentence_length",
)
_CLASS = np.full(256, 6, np.uint8)  # of bytes: upper, lower, digits, space, marks, symbols, beyond ASCII
for _i, _part in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\v\f", b".,;:?!'\"()-", bytes(b for b in range(128) if not chr(b).isalnum() and b not in b" \t\n\r\v\f.,;:?!'\"()-"))):
    _CLASS[list(_part)] = _i


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts that end between words where they can."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            space = max(text.rfind(b" ", start, end), text.rfind(b"\n", start, end))
            end = space if space > start else end
        yield text[start:end]
        start = end


def _of_words(piece: bytes) -> tuple[np.ndarray, int]:
    """Sums over the piece's words: length in code points; is upper, title, ends in a symbol, ends in "!", has a digit, has no letter, is one character; and the longest in bytes."""
    raw = np.frombuffer(piece, np.uint8)
    kind = _CLASS[raw]
    edge = np.diff(np.concatenate(([0], kind != _SPACE, [0])).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    if not len(first):
        return np.zeros(8), 0
    upper, lower, digits, beyond, size = (np.add.reduceat(m.astype(np.int32), first) for m in (kind == 0, kind == 1, kind == 2, kind == 6, (kind != _SPACE) & ((raw & 0xC0) != 0x80)))
    title = (kind[first] == 0) & (upper == 1) & (lower > 0)
    told = size, (upper > 1) & (lower == 0), title, kind[last] == 5, raw[last] == 33, digits > 0, upper + lower + beyond == 0, size == 1
    return np.array([float(t.sum()) for t in told]), int((last - first).max()) + 1


def statistics(text: str) -> list[float]:
    """The numbers of ``NAMES`` of one whole text."""
    whole = text.encode(errors="replace")
    counts = np.bincount(np.frombuffer(whole, np.uint8), minlength=256)
    n = max(1, len(whole))
    share = np.bincount(_CLASS, weights=counts, minlength=7) / n
    p = counts[counts > 0] / n
    number: dict[bytes, int] = {}
    parts, sums, longest = [np.empty(0, np.int64)], np.zeros(8), 0
    for piece in _pieces(whole):
        held = piece.split()
        new = [w for w in dict.fromkeys(held) if w not in number] if number else dict.fromkeys(held)
        number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
        parts.append(np.fromiter(map(number.__getitem__, held), np.int64, len(held)))
        of_words, most = _of_words(piece)
        sums += of_words
        longest = max(longest, most)
    ids = np.concatenate(parts)
    n_words, own = max(1, len(ids)), max(1, len(number))
    uses = np.bincount(ids, minlength=own)
    mean = sums / n_words
    pairs = ids[:-1] * own + ids[1:]
    pairs.sort()
    ends = np.flatnonzero(np.diff(pairs, append=-1))
    runs = np.diff(ends, prepend=-1) if len(pairs) else np.empty(0, np.int64)
    followed = max(1, len(ids) - 1)
    lines = [x for x in map(bytes.strip, whole.split(b"\n")) if x]
    n_lines = max(1, len(lines))
    sentences = 1 + len(_SENTENCE.findall(whole))
    return [
        np.log1p(len(text)), np.log1p(len(ids)), mean[0], np.log1p(longest), *share, float(-(p * np.log2(p)).sum()) + 0.0, counts.max() / n,
        *mean[1:], len(number) / n_words, uses.max(initial=0) / n_words, float((ids[:-1] == ids[1:]).sum()) / followed, len(runs) / followed, runs.max(initial=0) / followed,
        np.log1p(len(lines)), np.log1p(len(text) / n_lines), 1 - len(set(lines)) / n_lines if lines else 0.0, sum(x[-1] in b".!?:;\"'" for x in lines) / n_lines, sum(len(x) < 30 for x in lines) / n_lines,
        len(ids) / sentences,
    ]


@dataclass(frozen=True)
class Trees:
    """All trees as arrays by tree and node; the children of node i are 2 i + 1 (at most the threshold) and 2 i + 2."""

    feature: np.ndarray  #: int32, trees x inner nodes
    threshold: np.ndarray  #: float64, trees x inner nodes
    value: np.ndarray  #: float64, trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches: one gather a level for all rows and trees."""
        tree = np.arange(len(self.feature))
        row, node = np.arange(len(x))[:, None], np.zeros((len(x), len(tree)), np.int64)
        for _ in range(int(np.log2(self.value.shape[1])) if len(tree) else 0):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.value[tree, node - self.feature.shape[1]].sum(1) if len(tree) else np.full(len(x), self.base)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each statistic: distinct quantiles of the sample; a value is in the bin of the cuts below it."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees on rows of statistics and 0/1 labels."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if not 0 < y.sum() < len(y):
        return Trees(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = edges_of(x)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    width, m = BINS, x.shape[1]
    flat = binned + np.arange(m) * width
    feature, threshold, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    cut_at = np.full((m, width), np.inf)
    for i, e in enumerate(edges):
        cut_at[i, : len(e)] = e
    z = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)  # within its level
        for level in range(depth):
            n = 2**level
            at = (node[:, None] * (m * width) + flat).ravel()
            sums = [np.bincount(at, weights=np.repeat(w, m), minlength=n * m * width).reshape(n, m, width).cumsum(2) for w in (g, h, np.ones(len(y)))]
            (gl, hl, cl), (gt, ht, ct) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + REGULAR) + (gt - gl) ** 2 / (ht - hl + REGULAR) - gt**2 / (ht + REGULAR)
            gain[(cl < MIN_ROWS) | (ct - cl < MIN_ROWS) | ~np.isfinite(cut_at)[None]] = 0
            best = gain.reshape(n, -1).argmax(1)  # the first of equals: the smaller statistic, the smaller cut
            splits = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            f, b = best // width, best % width
            feature[t, n - 1 : 2 * n - 1] = np.where(splits, f, 0)
            threshold[t, n - 1 : 2 * n - 1] = np.where(splits, cut_at[f, b], np.inf)
            right = np.where(splits[node], binned[np.arange(len(y)), f[node]] > b[node], False)
            node = 2 * node + right
        gs, hs = np.bincount(node, weights=g, minlength=leaves), np.bincount(node, weights=h, minlength=leaves)
        value[t] = -RATE * gs / (hs + REGULAR)
        z += value[t, node]
    return Trees(feature, threshold, value, base)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shared.small_batches(batches, 512, "text"):
        x = [statistics(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["doc_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees | None:
    """The trees, or None without a learned label."""
    own = labels.where(~held_out(F.col("doc_id"))).where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    chosen = own.orderBy(F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string")), "doc_id").limit(max_train)
    # The statistics are a few hundred bytes a row; the second limit holds where many rows share a chosen id.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y")
    got = rows.mapInArrow(_numbers, "doc_id string, x array<double>, y int").orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "x").limit(max_train).collect()
    return fit(np.array([r.x for r in got]), np.array([r.y for r in got], float)) if got else None


def _score(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 512, "text"):
            texts = batch.column("text").to_pylist()
            scores = trees.score(np.array([statistics(t or "") for t in texts])) if trees else np.full(len(texts), 0.5)
            columns = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"_score": pa.array(scores, pa.float64())})

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, _score) of every row."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_score(train(docs, labels)), T.StructType([*d.schema.fields, T.StructField("_score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = F.col("_score")
    return scored(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without those that score below the cut."""
    d = shared.neutral(docs)
    fields = T.StructType([*d.schema.fields, T.StructField("_score", T.DoubleType())])
    return d.mapInArrow(_score(train(d, labels)), fields).where(F.col("_score") >= cut).select(*d.columns).toDF(*docs.columns)
