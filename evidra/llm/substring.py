"""Repeated substrings by relative Lempel-Ziv parsing.

The reference is the corpus itself in document order, cut into blocks and indexed.  Of
every window of ``WINDOW`` words the least-hashed gram of ``GRAM`` words is its anchor, so
equal windows share their anchor wherever they start.  The windows of one anchor make a
block, and the index holds every block under its anchor.  A document is factored against
it: an anchor that the index holds is the seed of a factor; where the whole block is
indexed, the seed grows to the block, and from there to the next block for as long as the
same source goes on.  Each block is offered two sources, its first holder and the one next
before it, and at each place the parse takes the source that reaches furthest.  Where a seed does
not grow to its whole block, the factor's boundary lies inside: there single windows are
looked up.  Factors of ``WINDOW`` words or more are the duplicate spans.

Defined results: null text has no words.  Documents are ordered by doc_id (null least), rows that
share a doc_id by a hash of their text, equal rows in any order; each row is a document of its own,
so of equal rows one keeps its words.  Texts of fewer than ``WINDOW`` words stay whole.  Very long
texts are read in bounded batches (a text beyond the bound alone).  An empty table gives no rows.
Columns other than doc_id and text are not looked at.  Blocks and windows are compared by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidra.llm import shared

WINDOW = 20
GRAM = 6
#: Texts hashed together by a task, within which blocks are pre-aggregated.
BATCH = 2048
#: An anchor with more blocks than so many mean partitions is dealt by block; fewer than the partitions can be such.
HOT = 2
#: Bits of the fixed-size filter of document ids that keeps untouched texts from being shuffled.
FILTER_BITS = 1 << 23

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PART = 1 << 20  #: bytes of a text whose words are hashed at once
_NEXT_SPACE = re.compile(rb"[\x20\x09-\x0d]").search


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as long as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16), b, np.uint64))]) for b in (self.base, self.inverse))
        if n <= 2 * PART:  # longer ones are not kept
            self.up, self.down = up, down
        return up[:n], down[:n]


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_LETTERS, _WORD_POWERS = _Powers(np.uint64(0x2545F4914F6CDD1D)), _Powers(_M1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hashes of values[start:end], from prefix sums, finalised with the length."""
    up, down = powers.upto(len(values) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return _mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each space-separated word of a UTF-8 text; a long text goes part by part, each up to a space."""
    parts, start = [], 0
    while start < len(text):
        cut = _NEXT_SPACE(text, start + PART) if len(text) - start > PART else None
        end = cut.start() if cut else len(text)
        raw = np.frombuffer(text, np.uint8, end - start, start)
        space = np.concatenate([[True], _SPACE[raw], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        parts.append(_range_hashes(_BYTES[raw], edges[::2], edges[1::2], _LETTERS))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, n: int, m: np.uint64) -> np.ndarray:
    """A polynomial hash of every n words in a row, finalised."""
    size = len(h) - n + 1
    x = np.zeros(size, np.uint64)
    for i in range(n):
        x = x * m + h[i : i + size]
    return _mix(x)


def blocks(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash, block hash) of each block of a text's word hashes."""
    g = _rolled(h, gram, _M1)
    width = window - gram + 1
    at, span = np.arange(len(g)), 1
    while span < width:  # sliding minimum by doubling: each step joins two overlapping halves
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        span += step
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.append(lo[1:], len(at)) - 1
    return lo, hi, g[at[lo]], _range_hashes(h, lo, hi + window, _WORD_POWERS)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text): ``own`` is the given id and ``doc_id`` a number of the row's own in document order.

    Where ids are whole and unique (one small aggregation tells), they are that number.  Else rows are ranked by one
    range shuffle and prefix sums, equal rows spread over it, and written, with their columns as ``_o0``, ``_o1`` and so on.
    """
    spark = docs.sparkSession
    own = docs.select(*(F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").cast("long").alias("own"), F.col("text").cast("string").alias("text"))
    if own.groupBy("own").agg(F.count("*").alias("n")).where("n > 1 or own is null").isEmpty():
        return own.select(F.col("own").alias("doc_id"), "own", "text")

    order = ["own", "_h", "_m"]
    ranked = own.withColumns({"_h": F.xxhash64("text"), "_m": F.monotonically_increasing_id()}).repartitionByRange(shared.partitions(spark), *order).sortWithinPartitions(*order)
    # A partition's rows are numbered in its order: the part above, the place below.
    ranked = shared.materialise(ranked.drop("_h", "_m").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, at = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    base, bases = 0, []
    for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        bases.append((r.part, base))
        base += r.n
    named = ranked.withColumn("part", part).join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
    out = named.withColumn("doc_id", F.col("base") + at).drop("part", "base", "_at")
    out._evidra_ranked = True
    return out


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})


BLOCKS = "kind int, doc_id long, lo long, a long, v long, source long, at long, near long, near_at long"
MATCHED = "kind int, doc_id long, lo long, source long, at long, near long, near_at long"


def _rows(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows of one kind; columns that are not given are 0."""
    zero = np.zeros(n, np.int64)
    names = [x.split()[0] for x in (BLOCKS if "a" in columns else MATCHED).split(", ")[1:]]
    return _batch(kind=np.full(n, kind, np.int32), **{c: columns.get(c, zero) for c in names})


def block_rows(docs: DataFrame, share: float) -> DataFrame:
    """Blocks of all texts.  kind 0: the first of its batch (a, v); 1: a later one in its batch, with its two sources;
    2: an anchor (a) with more than ``share`` of the batch's blocks (their number in v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, BATCH, "text"):
            ids = batch.column("doc_id").to_numpy()
            doc, lo, a, v = [], [], [], []
            for i, text in enumerate(shared.binary(batch.column("text"))):
                h = word_hashes(text)
                if len(h) >= WINDOW:
                    x, _, y, z = blocks(h)
                    doc.append(np.full(len(x), ids[i]))
                    lo.append(x)
                    a.append(y)
                    v.append(z)
            if not doc:
                continue
            doc, lo, a, v = (np.concatenate(x) for x in (doc, lo, a, v))
            order = np.lexsort((lo, doc, v, a))
            doc, lo, a, v = doc[order], lo[order], a[order], v[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (v[1:] != v[:-1])])
            first = np.flatnonzero(new)
            own = first[np.cumsum(new) - 1]
            yield _rows(0, len(first), doc_id=doc[first], lo=lo[first], a=a[first], v=v[first])
            later = np.flatnonzero(~new)
            if len(later):
                src, near = own[later], later - 1
                yield _rows(1, len(later), doc_id=doc[later], lo=lo[later], a=np.zeros(len(later), np.int64), source=doc[src], at=lo[src], near=doc[near], near_at=lo[near])
            anchor, n = np.unique(a[first], return_counts=True)
            many = n > max(8, share * len(first))
            if many.any():
                yield _rows(2, int(many.sum()), a=anchor[many], v=n[many])

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def _match_blocks(hot: frozenset[int]):
    """Over rows sorted by (k, a, v, doc_id, lo), k's groups whole: later blocks with their sources, and first blocks to check.

    Constant memory: of a group only its state is held.  A block is checked if its anchor has other blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first block so far of an anchor with one kind of block: it waits for a second kind
        key = source = before = None
        for batch in batches:
            a, v, doc, lo = (batch.column(c).to_numpy() for c in ("a", "v", "doc_id", "lo"))
            n = len(a)
            if not n:
                continue
            prev_a, prev_v = np.concatenate([[0], a[:-1]]), np.concatenate([[0], v[:-1]])
            new_a, new_v = a != prev_a, v != prev_v
            if key is not None:
                new_a[0], new_v[0] = a[0] != key[0], v[0] != key[1]
            else:
                new_a[0] = True
            first = new_a | new_v
            at_first = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            later = np.flatnonzero(~first)
            if len(later):
                src, carried, last = at_first[later], source or (0, 0), before or (0, 0)
                near_doc, near_lo = np.concatenate([[last[0]], doc[:-1]]), np.concatenate([[last[1]], lo[:-1]])
                yield _rows(1, len(later), doc_id=doc[later], lo=lo[later], source=np.where(src >= 0, doc[src], carried[0]), at=np.where(src >= 0, lo[src], carried[1]), near=near_doc[later], near_at=near_lo[later])
            # Groups of one anchor within this batch; the one under way goes on from the last batch.
            group = np.cumsum(new_a)
            kinds = np.bincount(group, weights=first, minlength=int(group[-1]) + 1)
            firsts = np.flatnonzero(first)
            many = kinds[group[firsts]] > 1
            many |= np.isin(a[firsts], list(hot)) if hot else False
            if group[0] == 0 and len(firsts):
                many |= group[firsts] == 0  # the anchor under way has another block before
            if held is not None and group[0] == 0 and kinds[0] > 0:
                yield _rows(3, 1, doc_id=np.array([held[0]]), lo=np.array([held[1]]))
                held = None
            if group[-1] > 0:
                held = None
                last = firsts[group[firsts] == group[-1]]
                if len(last) == 1 and not many[np.searchsorted(firsts, last[0])]:
                    held = (int(doc[last[0]]), int(lo[last[0]]))
            check = firsts[many]
            if len(check):
                yield _rows(3, len(check), doc_id=doc[check], lo=lo[check])
            if at_first[-1] >= 0:
                source = (int(doc[at_first[-1]]), int(lo[at_first[-1]]))
            key, before = (int(a[-1]), int(v[-1])), (int(doc[-1]), int(lo[-1]))

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, doc_id, start): the windows of the blocks to check."""
    for batch in shared.small_batches(batches, 256, "text"):
        ids = batch.column("doc_id").to_numpy()
        out = []
        for i, (text, wanted) in enumerate(zip(shared.binary(batch.column("text")), batch.column("los").to_pylist(), strict=True)):
            h = word_hashes(text)
            if len(h) < WINDOW:
                continue
            lo, hi, _, _ = blocks(h)
            own = np.isin(lo, wanted)
            size = (hi - lo + 1)[own]
            s = np.repeat(lo[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if own.any() else lo[:0]
            out.append((_rolled(h, WINDOW, _M1)[s], _rolled(h, WINDOW, _M2)[s], np.full(len(s), ids[i]), s))
        if out:
            w1, w2, doc, s = (np.concatenate(x) for x in zip(*out, strict=True))
            yield _batch(w1=w1, w2=w2, doc_id=doc, start=s)


class IdFilter:
    """A fixed-size Bloom filter of document ids (or another key): says no only to ids that are not in it."""

    def __init__(self, ids: DataFrame, bits: int = FILTER_BITS, key: str = "doc_id"):
        self.words, self.key = bits // 64, key
        places = F.explode(F.array(*(F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(2)))).alias("b")
        rows = ids.select(places).select(F.floor(F.col("b") / 64).alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
        self.table = np.zeros(self.words, np.int64)
        for w, m in rows.collect():  # bits / 64 rows at most
            self.table[w] = m
        self.broadcast = ids.sparkSession.sparkContext.broadcast(self.table)

    def split(self, texts: DataFrame, columns: str | StructType = "doc_id long, own long, text string") -> tuple[DataFrame, DataFrame]:
        """(texts that may be in it, texts that are not), with ``columns``."""
        names = [x.split()[0] for x in columns.split(", ")] if isinstance(columns, str) else columns.names
        bits, table = self.words * 64, self.broadcast
        placed = texts.withColumn("_b0", F.pmod(F.xxhash64(self.key, F.lit(0)), F.lit(bits))).withColumn("_b1", F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(bits)))

        def only(wanted: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                t = table.value
                for batch in batches:
                    there = np.ones(batch.num_rows, bool)
                    for c in ("_b0", "_b1"):
                        b = batch.column(c).to_numpy()
                        there &= (t[b // 64] >> (b % 64)) & 1 == 1
                    yield batch.select(names).filter(pa.array(there == wanted))

            return run

        return tuple(placed.mapInArrow(only(w), columns) for w in (True, False))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` but those whose ``key`` is in ``gone`` (key), a written table; only rows that the filter cannot clear are shuffled, not all texts."""
    maybe, sure = IdFilter(gone, key=key).split(rows, rows.schema)
    return sure.unionByName(maybe.join(gone, key, "left_anti").select(*rows.columns))


def found_pieces(texts: DataFrame) -> DataFrame:
    """(doc_id, found): per document of ``texts`` (:func:`keyed`), the blocks and windows that start earlier elsewhere.

    A piece is (start, windows, source, at, near, near_at); ``windows`` is 0 for a whole block (its windows follow from the
    text) and 1 for a single window.
    """
    spark = texts.sparkSession
    n = shared.partitions(spark)
    rows = shared.materialise(block_rows(texts, HOT / n / 2), "blocks")
    # An anchor with the share HOT / n of all blocks has half of it in batches that name it, so it is among these; they are fewer than n.
    total = rows.where("kind = 0").count()
    hot = rows.where("kind = 2").groupBy("a").agg(F.sum("v").alias("n")).where(F.col("n") > HOT / n / 2 * total).select("a")
    named = frozenset(r.a for r in hot.collect())
    reps = rows.where("kind = 0").select("a", "v", "doc_id", "lo")
    if named:
        reps = reps.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "a", "left").withColumn("k", F.when(F.col("_hot"), F.col("v")).otherwise(F.col("a"))).drop("_hot")
    else:
        reps = reps.withColumn("k", F.col("a"))
    dealt = reps.select("a", "v", "doc_id", "lo", "k").repartition(n, "k").sortWithinPartitions("k", "a", "v", "doc_id", "lo")
    matched = shared.materialise(dealt.mapInArrow(_match_blocks(named), MATCHED), "matched")
    columns = ["doc_id", "lo", "source", "at", "near", "near_at"]
    later = rows.where("kind = 1").select(*columns).unionByName(matched.where("kind = 1").select(*columns))
    # At the factor boundaries: windows of the first block of each kind, where its anchor has other blocks.
    check = matched.where("kind = 3").groupBy("doc_id").agg(F.collect_list("lo").alias("los"))  # within a text's length
    maybe, _ = IdFilter(check.select("doc_id")).split(texts)
    windows = shared.materialise(maybe.join(check, "doc_id").select("doc_id", "text", "los").mapInArrow(_window_rows, "w1 long, w2 long, doc_id long, start long"), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "first")
    single = windows.join(least, ["w1", "w2"]).where(F.struct("doc_id", "start") > F.col("first"))
    piece = lambda windows, *c: F.struct(c[0].alias("start"), F.lit(windows).cast("long").alias("windows"), *(x.alias(n) for x, n in zip(c[1:], ("source", "at", "near", "near_at"), strict=True))).alias("x")
    col, one = F.col, (F.col("first.doc_id"), F.col("first.start"))
    pieces = later.select("doc_id", piece(0, *(col(c) for c in columns[1:]))).unionByName(single.select("doc_id", piece(1, col("start"), *one, *one)))
    found = shared.materialise(pieces.groupBy("doc_id").agg(F.collect_list("x").alias("found")), "found")  # within a text's length
    for df in (rows, matched, windows):
        shared.discard(df)
    return found


Piece = tuple[int, int, tuple[tuple[int, int], ...]]  #: first window, windows, sources (document, place)


def parse(pieces: list[Piece]) -> list[tuple[int, int, int, int]]:
    """The factors (start, n_words, source document, source start) of one document from its matched pieces.

    Greedy: from the first word not yet behind a factor, the longest run of adjoining pieces that one source
    holds in a row.  A factor may reach back into the words of the one before, as far as its first window does.
    """
    at = sorted(pieces)
    starts = {p[0]: i for i, p in reversed(list(enumerate(at)))}
    reach: dict[tuple[int, int, int], int] = {}  # (piece, source, diagonal) -> end of the run of windows from there
    for i in range(len(at) - 1, -1, -1):
        start, n, sources = at[i]
        follows = starts.get(start + n)
        for doc, place in sources:
            run = (doc, place - start)
            reach[i, *run] = reach.get((follows, *run), start + n) if follows is not None else start + n
    factors, done = [], -1
    for i, (start, n, sources) in enumerate(at):
        if start + n <= done:
            continue
        end, doc, shift = max((reach[i, doc, place - start], -doc, place - start) for doc, place in sources)
        factors.append((start, end - start + WINDOW - 1, -doc, start + shift))
        done = end
    return factors


def covered(factors: list[tuple[int, int, int, int]], n: int) -> np.ndarray:
    """Which of n words lie in a factor; factors may overlap at their boundaries."""
    edge = np.zeros(n + 1, np.int32)
    for start, size, *_ in factors:
        edge[start] += 1
        edge[start + size] -= 1
    return np.cumsum(edge[:-1]) > 0


class Found:
    """The found pieces of a batch's documents as columns."""

    FIELDS = ("start", "windows", "source", "at", "near", "near_at")

    def __init__(self, column: pa.ListArray):
        rows = column.flatten()
        self.ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
        self.columns = [rows.field(f).to_numpy(zero_copy_only=False) for f in self.FIELDS]

    def pieces(self, i: int, text: bytes) -> list[Piece]:
        """Document i's pieces, those joined that adjoin in both sources."""
        own = slice(self.ends[i], self.ends[i + 1])
        start, n, source, at, near, near_at = (c[own] for c in self.columns)
        if not len(start):
            return []
        order = np.argsort(start, kind="stable")
        start, n, source, at, near, near_at = (c[order] for c in (start, n, source, at, near, near_at))
        if (n == 0).any():
            lo, hi, _, _ = blocks(word_hashes(text))
            n = np.where(n == 0, (hi - lo + 1)[np.searchsorted(lo, start).clip(max=len(lo) - 1)], n)
        same = [c[1:] == c[:-1] for c in (source, near, at - start, near_at - start)]
        first = np.flatnonzero(np.concatenate([[True], ~(np.logical_and.reduce(same) & (start[1:] == (start + n)[:-1]))]))
        size = np.add.reduceat(n, first)
        rows = zip(*(c[first].tolist() for c in (start,)), size.tolist(), *(c[first].tolist() for c in (source, at, near, near_at)), strict=True)
        return [(s, k, ((a, b),) if (a, b) == (c, d) else ((a, b), (c, d))) for s, k, a, b, c, d in rows]


REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 256, "text"):
            out = []
            found = Found(batch.column("found")) if "found" in batch.schema.names else None
            for i, (doc, text) in enumerate(zip(batch.column("own").to_pylist(), shared.binary(batch.column("text")), strict=True)):
                words = text.split()
                kept = words
                if found and (pieces := found.pieces(i, text)):
                    gone = covered(parse(pieces), len(words))
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), joined.decode() if with_text else hashlib.sha256(joined).hexdigest()))
            if out:
                names = ["doc_id", "n_words", "n_removed", "text" if with_text else "kept_sha256"]
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string() if n in ("text", "kept_sha256") else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    return run


def report(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (or ``text``, the kept words joined by one space)."""
    texts = keyed(docs.select("doc_id", "text")).select("doc_id", "own", "text")
    found = found_pieces(texts)
    maybe, untouched = IdFilter(found.select("doc_id")).split(texts)
    shape = REPORT.replace("kept_sha256", "text") if with_text else REPORT
    return maybe.join(found, "doc_id", "left").select("own", "text", "found").mapInArrow(_cut(with_text), shape).unionByName(untouched.select("own", "text").mapInArrow(_cut(with_text), shape))


def factor_table(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, source, at): every factor, in words; doc_id and source are the numbers of :func:`keyed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 256, "text"):
            found = Found(batch.column("found"))
            rows = [(doc, *f) for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), shared.binary(batch.column("text")), strict=True)) for f in parse(found.pieces(i, text))]
            if rows:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "n_words", "source", "at"), zip(*rows, strict=True), strict=True)})

    texts = keyed(docs.select("doc_id", "text")).select("doc_id", "own", "text")
    return texts.join(found_pieces(texts), "doc_id").select("doc_id", "text", "found").mapInArrow(run, "doc_id long, start long, n_words long, source long, at long")


#: The same in DuckDB: a window's words by nineteen leads.  Ids must be unique there.
REPORT_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT doc_id, i, w, lead(w, {WINDOW - 1}) OVER d IS NOT NULL AS whole, concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER d" for k in range(1, WINDOW))}) AS x
    FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, w, whole AND row_number() OVER (PARTITION BY whole, x ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, w, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, sum(gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
