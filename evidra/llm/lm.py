"""Language-model scores with stupid backoff, computed relationally.

Every token of the corpus is an occurrence of a centre word w between its left neighbour l and its
right neighbour r.  A row holds the occurrences of one word in some texts; rows are dealt by the
word, so that the count tables of w, (l, w), (w, r) and (l, w, r) all lie with the occurrences that
ask for them: one exchange serves all orders.  Each occurrence takes its counts from them and adds
its part of the score, and parts are summed per document.

What travels decides what a run costs: a neighbour that is one of the ``CODES`` most frequent words
is told by 16 bits and only a rarer one by its 64-bit hash; a text by its place among those of the row.

A document is scored by the rest of the corpus: its own counts are taken off.  With c
those counts, N the tokens of all other documents and ALPHA the backoff factor,

    S(w | h) = c(h w) / c(h) if c(h w) > 0, else ALPHA S(w | shorter h);  S(w) = max(c(w), 1) / N

An n-gram seen elsewhere has its shorter ones seen elsewhere too, so the logarithms of a text's
scores can be summed by centre word: each count stands in the rows of one centre only.

A word that would fill more than ``HOT`` mean partitions is hot.  Its count is known from the word
counts; its pairs and triples get count tables of their own, pre-aggregated and then joined, where
adaptive execution splits what is still skewed.

Words are lower-cased (A-Z) and split at ASCII white space; they are compared by 64 bits of hash.
Null and wordless texts have no tokens and score 0; an empty table gives no rows.  Repeated rows
are documents of their own, with or without one id.  Very long texts are read in bounded batches
(a text beyond the bound alone).  Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import shared
from evidra.llm.substring import _mix, word_hashes

ORDER = 3
ALPHA = 0.4
HOT = 2  #: a word with more rows than so many mean partitions is hot
CHUNK = 250_000  #: occurrences that are counted at once, unless one word has more
CODES = 65_534  #: frequent words that are told by a code; 0 is no neighbour and 1 a word told by its hash
BATCH = 2_000_000  #: tokens whose occurrences are put together by word, unless one text has more
PIECE = 512  #: occurrences in a row at most
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LEFT, RIGHT = 1, 2  #: bits of ``side``: which neighbours there are


def _sources(docs: DataFrame) -> DataFrame:
    """(doc_id, id, h, text): ``id`` and ``h`` name a row's content; equal rows have equal scores."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(0).cast("long")).alias("id"), F.xxhash64(doc.isNull(), text).alias("h"), text.alias("text"))


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a batch's texts in a row, and each word's text number."""
    per = [word_hashes(t.lower()) for t in shared.binary(batch.column("text"))]
    return np.concatenate(per), np.repeat(np.arange(len(per)), [len(h) for h in per])


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n): the count table of single words, pre-aggregated by batch."""

    def counted(per: list[np.ndarray]) -> pa.RecordBatch:
        w, n = np.unique(np.concatenate(per), return_counts=True)
        return pa.RecordBatch.from_pydict({"w": pa.array(w.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in shared.small_batches(batches, 1024, "text", 4_000_000):
            held.append(_hashes(batch)[0])
            n += len(held[-1])
            if n > BATCH:
                yield counted(held)
                held, n = [], 0
        if held:
            yield counted(held)

    return docs.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each place's key occurs."""
    order = np.argsort(keys)
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    n = np.diff(np.append(first, len(keys)))
    out = np.empty(len(keys), np.int32)
    out[order] = np.repeat(n.astype(np.int32), n)
    return out


def _grouped(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place the sum of the weights of all places with its key."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys)
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    sums = np.add.reduceat(weights[order], first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    return out


GRAMS = "id long, h long, w long, l long, r long, side int, k long, own_w long, own_lw long, own_wr long"


def hot_rows(docs: DataFrame, hot: frozenset[int]) -> DataFrame:
    """The n-grams of hot words: per text and distinct (l, w, r) one row with its count k and the text's own counts of w, (l, w), (w, r)."""
    words = np.array(sorted(hot), np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 1024, "text", 4_000_000):
            w, doc = _hashes(batch)
            if not len(w):
                continue
            l, r, side = _neighbours(w, doc)
            mine = np.isin(w, words)
            w, doc, l, r, side = w[mine], doc[mine], l[mine], r[mine], side[mine]
            one = np.ones(len(w), np.int64)
            at = _mix(w + doc.astype(np.uint64) * _A)
            lw, wr = _mix(at + l * _B + (side & LEFT).astype(np.uint64)), _mix(at + r * _A + (side & RIGHT).astype(np.uint64))
            _, first, k = np.unique(_mix(lw + wr * _B), return_index=True, return_counts=True)
            own = [_grouped(x, one)[first] for x in (at, lw, wr)]
            ids, hs = (batch.column(c).to_numpy()[doc[first]] for c in ("id", "h"))
            columns = [ids, hs, w[first].view(np.int64), l[first].view(np.int64), r[first].view(np.int64), side[first].astype(np.int32), k.astype(np.int64), *own]
            yield pa.RecordBatch.from_pydict({n.split()[0]: pa.array(c) for n, c in zip(GRAMS.split(", "), columns, strict=True)})

    return docs.select("id", "h", "text").mapInArrow(run, GRAMS)


def _neighbours(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in a row its left and right neighbour in its text (0: none) and its ``side``."""
    joint = np.concatenate([[False], doc[1:] == doc[:-1], [False]])
    left, right = joint[:-1], joint[1:]
    return np.where(left, np.roll(w, 1), 0), np.where(right, np.roll(w, -1), 0), left * LEFT + right * RIGHT


def _coded(words: np.ndarray, there: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The code of each word: its place among the (sorted) frequent ones, 1 where it is rarer, 0 where there is none."""
    at = np.minimum(np.searchsorted(frequent, words), max(len(frequent) - 1, 0))
    known = frequent[at] == words if len(frequent) else np.zeros(len(words), bool)
    return np.where(there, np.where(known, at + 2, 1), 0).astype(np.uint16)


TEXT = ("doc_id", "id", "h", "size")
_TEXT = "".join(f", {c} long" for c in TEXT)
OCCURRENCES = "w long, base long, x array<smallint>, far array<long>" + _TEXT


def occurrences(docs: DataFrame, hot: frozenset[int], frequent: np.ndarray) -> DataFrame:
    """Per word that is not hot and batch of texts the word's occurrences, in rows of ``PIECE`` at most, and a row for each text.

    ``x`` holds a text (less ``base``), then the left and then the right neighbour's code of each occurrence, ``far`` the hashes
    of the neighbours that have none, left ones first.  A text's row says under which number its occurrences travel.
    """
    skipped = np.array(sorted(hot), np.int64).view(np.uint64)

    def rows(base: int, per: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        w, doc = np.concatenate(per), np.repeat(np.arange(len(per)), [len(h) for h in per])
        if not len(w):
            return
        l, r, side = _neighbours(w, doc)
        if len(skipped):
            mine = ~np.isin(w, skipped)
            w, doc, l, r, side = w[mine], doc[mine], l[mine], r[mine], side[mine]
        order = np.argsort(w, kind="stable")
        w, doc, l, r, side = w[order], doc[order], l[order], r[order], side[order]
        if not len(w):
            return
        words = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        within = np.arange(len(w)) - np.repeat(words, np.diff(np.append(words, len(w))))
        first = np.flatnonzero(within % PIECE == 0)
        size = np.diff(np.append(first, len(w)))
        lc, rc = _coded(l, (side & LEFT) > 0, frequent), _coded(r, (side & RIGHT) > 0, frequent)
        n_far = np.add.reduceat((lc == 1).astype(np.int32) + (rc == 1), first)
        # Rows of one shape lie side by side: most of what is equal in them is then told once.
        shape = np.lexsort([w[first], n_far, size])
        moved = np.repeat(first[shape] - (np.cumsum(size[shape]) - size[shape]), size[shape]) + np.arange(len(w))
        w, doc, l, r, lc, rc, within, size = w[moved], doc[moved], l[moved], r[moved], lc[moved], rc[moved], within[moved], size[shape]
        first, n_far = np.cumsum(size) - size, n_far[shape]
        row, i = np.repeat(np.arange(len(first)), size), within % PIECE
        x, start = np.empty(3 * len(w), np.uint16), 3 * first[row] + i
        x[start], x[start + size[row]], x[start + 2 * size[row]] = doc, lc, rc
        rare = np.concatenate([np.flatnonzero(lc == 1), np.flatnonzero(rc == 1)])
        n_left = np.count_nonzero(lc == 1)
        by_row = np.argsort(row[rare], kind="stable")  # left ones stay before right ones
        far = np.concatenate([l[rare[:n_left]], r[rare[n_left:]]])[by_row]
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        x = pa.ListArray.from_arrays(ends(3 * size), pa.array(x.view(np.int16)))
        far = pa.ListArray.from_arrays(ends(n_far), pa.array(far.view(np.int64)))
        out = {"w": pa.array(w[first].view(np.int64)), "base": pa.array(np.full(len(first), base)), "x": x, "far": far} | {c: pa.nulls(len(first), pa.int64()) for c in TEXT}
        yield from pa.Table.from_pydict(out).to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = no = shared.task_partition() << 36
        held, n = [], 0
        for batch in shared.small_batches(batches, 1024, "text", 4_000_000):
            per = [word_hashes(t.lower()) for t in shared.binary(batch.column("text"))]
            sizes = np.array([len(h) for h in per], np.int64)
            numbers = no + np.arange(len(per))
            text = {c: batch.column(c) for c in TEXT[:3]} | {"size": pa.array(sizes)}
            none = lambda t: pa.nulls(len(per), pa.list_(t))
            yield pa.RecordBatch.from_pydict({"w": pa.array(_mix(numbers.astype(np.uint64)).view(np.int64)), "base": pa.array(numbers), "x": none(pa.int16()), "far": none(pa.int64())} | text)
            if held and (n + sizes.sum() > BATCH or len(held) + len(per) > 1 << 16):
                yield from rows(begun, held)
                held, n, begun = [], 0, no
            held, n, no = held + per, n + int(sizes.sum()), no + len(per)
        if held:
            yield from rows(begun, held)

    return docs.select("doc_id", "id", "h", "text").mapInArrow(run, OCCURRENCES)


def _read(batch: pa.RecordBatch, frequent: np.ndarray) -> dict[str, np.ndarray]:
    """The occurrences in a batch of :func:`occurrences`, one after the other."""
    x, far = batch.column("x"), batch.column("far")
    codes = x.flatten().to_numpy().view(np.uint16).astype(np.int64)
    size = np.diff(x.offsets.to_numpy()) // 3
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) + 2 * (np.cumsum(size) - size)[row]
    lc, rc = codes[at + size[row]], codes[at + 2 * size[row]]
    rare = np.concatenate([np.flatnonzero(lc == 1), np.flatnonzero(rc == 1)])
    n_left = np.count_nonzero(lc == 1)
    by_row = np.argsort(row[rare], kind="stable")
    hashes = np.empty(len(rare), np.uint64)
    hashes[by_row] = far.flatten().to_numpy().view(np.uint64)
    table = np.concatenate([np.zeros(2, np.uint64), frequent])
    l, r = table[lc], table[rc]
    l[rare[:n_left]], r[rare[n_left:]] = hashes[:n_left], hashes[n_left:]
    side = (lc > 0) * LEFT + (rc > 0) * RIGHT
    return {"w": batch.column("w").to_numpy()[row], "no": batch.column("base").to_numpy()[row] + codes[at], "l": l, "r": r, "side": side.astype(np.int8)}


def parts(x: dict[str, np.ndarray], order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row its part of its text's summed log score, and how many words it scores by S(w) = c(w) / N, where log N is still to be taken off.

    With c the rest's counts: the word at its own place by S(w), unless (l, w) is seen; the right
    neighbour by (w, r), unless (l, w, r) is seen; the right neighbour by (l, w, r).
    """
    k, left, right = x["k"], (x["side"] & LEFT) > 0, (x["side"] & RIGHT) > 0
    w, lw, wr, lwr = x["n_w"] - x["own_w"], x["n_lw"] - x["own_lw"], x["n_wr"] - x["own_wr"], x["n_lwr"] - x["own_lwr"]
    log = lambda n: np.log(np.maximum(n, 1))
    single = ~(left & (lw > 0))
    three = left & right & (order > 2)
    triple = three & (lwr > 0)
    pair = right & (wr > 0) & ~triple
    backoffs = (single & left).astype(np.int64) + (three & ~triple)
    s = single * log(w) + pair * (log(wr) - log(w)) + triple * (log(lwr) - log(lw)) + backoffs * np.log(alpha)
    return s * k, single * k


HOT_PARTS = "id long, h long, s double, u long, n long"
PARTS = "no long, s double, u long" + _TEXT


def _summed(x: dict[str, np.ndarray], by: list[str], order: int, alpha: float) -> dict[str, np.ndarray]:
    """The rows' parts, pre-aggregated by text."""
    s, u = parts(x, order, alpha)
    sort = np.lexsort([x[c] for c in by])
    keys = {c: x[c][sort] for c in by}
    first = np.flatnonzero(np.concatenate([[True], np.any([v[1:] != v[:-1] for v in keys.values()], axis=0)]))
    return {c: v[first] for c, v in keys.items()} | {name: np.add.reduceat(v[sort], first) for name, v in (("s", s), ("u", u), ("n", x["k"]))}


def _by_centre(frequent: np.ndarray, order: int, alpha: float):
    """Over rows sorted by centre word, a word's occurrences whole: the count tables of its n-grams, joined to the occurrences, and their parts."""

    def elsewhere(key: np.ndarray, text: np.ndarray) -> np.ndarray:
        """How often the other texts have each occurrence's n-gram."""
        return _times(key) - _times(_mix(key + text))

    def out(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        w, no, l, r, side = (x.pop(c) for c in ("w", "no", "l", "r", "side"))  # a frequent word has millions: what is not needed goes
        w = w.view(np.uint64) * _A
        l += w + (side & LEFT).astype(np.uint64)
        r += w + (side & RIGHT).astype(np.uint64)
        text, lw, wr = _mix(no.view(np.uint64) * _B + _A), _mix(l), _mix(r)
        del l, r
        rest = {"n_w": elsewhere(w, text), "n_lw": elsewhere(lw, text), "n_wr": elsewhere(wr, text)}
        wr *= _B
        lw += wr
        del w, wr
        rest["n_lwr"] = elsewhere(_mix(lw), text)
        del lw, text
        for at in range(0, len(no), CHUNK):
            some = slice(at, at + CHUNK)
            y = {c: v[some].astype(np.int64) for c, v in rest.items()} | {"no": no[some], "side": side[some], "k": np.ones(len(no[some]), np.int64)}
            sums = _summed(y | dict.fromkeys(("own_w", "own_lw", "own_wr", "own_lwr"), 0), ["no"], order, alpha)
            yield pa.RecordBatch.from_pydict({c: pa.array(sums[c]) for c in ("no", "s", "u")} | {c: pa.nulls(len(sums["no"]), pa.int64()) for c in TEXT})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            told = batch.filter(batch.column("size").is_valid())
            if told.num_rows:
                zero = np.zeros(told.num_rows)
                yield pa.RecordBatch.from_pydict({"no": told.column("base"), "s": pa.array(zero), "u": pa.array(zero.astype(np.int64))} | {c: told.column(c) for c in TEXT})
            batch = batch.filter(batch.column("size").is_null())
            if not batch.num_rows:
                continue
            held.append(_read(batch, frequent))
            n += len(held[-1]["w"])
            if n < CHUNK:
                continue
            x = {c: np.concatenate([y.pop(c) for y in held]) for c in list(held[0])}
            other = np.flatnonzero(x["w"] != x["w"][-1])
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                held = [{c: v[whole:].copy() for c, v in x.items()}]
                yield from out({c: x.pop(c)[:whole] for c in list(x)})
            else:
                held = [x]
            n = len(held[0]["w"]) if whole else 0  # one word so far: wait for as many again
        if held and len((x := {c: np.concatenate([y.pop(c) for y in held]) for c in list(held[0])})["w"]):
            yield from out(x)

    return run


def _hot_parts(rows: DataFrame, words: DataFrame, order: int, alpha: float) -> DataFrame:
    """The parts of rows whose centre word is hot: count tables by pair and triple, pre-aggregated, written, joined."""
    rows = shared.materialise(rows, "lm-hot")
    joined = rows.join(F.broadcast(words.select("w", F.col("n").alias("n_w"))), "w")  # fewer than the partitions / HOT
    for name, key in (("n_lw", ["w", "l", "left"]), ("n_wr", ["w", "r", "right"]), ("n_lwr", ["w", "l", "r", "side"])):
        sides = {"left": F.col("side").bitwiseAND(LEFT), "right": F.col("side").bitwiseAND(RIGHT)}
        extra = {c: sides[c] for c in key if c in sides}
        table = shared.materialise(rows.withColumns(extra).groupBy(*key).agg(F.sum("k").alias(name)), f"lm-{name[2:]}")
        joined = joined.withColumns(extra).join(table, key).drop(*extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = {c: batch.column(c).to_numpy() for c in batch.schema.names}
                yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in _summed(x | {"own_lwr": x["k"]}, ["id", "h"], order, alpha).items()})

    return joined.mapInArrow(run, HOT_PARTS)


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, hot: float = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, log_score (natural, summed), score (its mean over tokens).

    ``order`` is 2 or 3.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    n = shared.partitions(spark)
    texts = _sources(docs)
    counts = shared.materialise(word_counts(texts), "lm-words")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    often = counts.where(F.col("n") > hot * total / n)
    common = frozenset(r.w for r in often.collect())  # fewer than n / hot words
    top = counts.orderBy(F.desc("n"), "w").limit(CODES).select("w").collect()  # half a megabyte
    frequent = np.sort(np.array([r.w for r in top], np.int64).view(np.uint64))
    rows = occurrences(texts, common, frequent).repartition(n, "w").sortWithinPartitions("w")
    sums = rows.mapInArrow(_by_centre(frequent, order, alpha), PARTS).groupBy("no").agg(F.sum("s").alias("s"), F.sum("u").alias("u"), *(F.max(c).alias(c) for c in TEXT))
    each = sums.select(*TEXT, "s", "u")
    if common:
        # Equal rows have added to one sum.
        more = _hot_parts(hot_rows(texts, common), often, order, alpha).groupBy("id", "h").agg(F.sum("s").alias("hot_s"), F.sum("u").alias("hot_u"))
        alike = each.groupBy("id", "h").agg(F.count("*").alias("m")).join(more, ["id", "h"])
        joined = each.join(alike, ["id", "h"], "left")
        share = lambda c: F.coalesce(F.col(c) / F.col("m"), F.lit(0.0))
        each = joined.withColumns({"s": F.col("s") + share("hot_s"), "u": F.col("u") + share("hot_u")})
    log_score = F.col("s") - F.col("u") * F.log(F.greatest(F.lit(total) - F.col("size"), F.lit(1)))
    made = each.select("doc_id", F.col("size").alias("n_tokens"), F.when(F.col("size") > 0, log_score).otherwise(0.0).alias("log_score"))
    return made.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).otherwise(0.0))


def report(docs: DataFrame) -> DataFrame:
    """:func:`score` to four decimals of a text's score, six of its mean: sums in another order differ in the last bits."""
    return score(docs).select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("score", 6).alias("score"))


#: The same in DuckDB, over windows of all tokens.
REPORT_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT rid, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM p WINDOW d AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, v, u,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY rid, w) AS c1,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY rid, v, w) AS c2,
    count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY rid, u, v, w) AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY rid) AS n FROM g),
h AS (SELECT *, lag(c1) OVER d AS h1, lag(c2) OVER d AS h2 FROM c WINDOW d AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT rid, CASE WHEN u IS NOT NULL AND c3 > 0 THEN ln(c3) - ln(h2)
    ELSE CASE WHEN u IS NOT NULL THEN ln({ALPHA}) ELSE 0 END + CASE WHEN v IS NOT NULL AND c2 > 0 THEN ln(c2) - ln(h1)
    ELSE CASE WHEN v IS NOT NULL THEN ln({ALPHA}) ELSE 0 END + ln(greatest(c1, 1)) - ln(greatest(n, 1)) END END AS x FROM h)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_tokens, round(coalesce(a.x, 0), 4) AS log_score, round(coalesce(a.x / len(t.ws), 0), 6) AS score
FROM t LEFT JOIN (SELECT rid, sum(x) AS x FROM s GROUP BY rid) a USING (rid)
"""
