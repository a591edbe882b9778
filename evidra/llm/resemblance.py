"""Near copies by the Jaccard similarity of word shingles, for the pipeline's near-duplicate stage.

Two texts resemble each other when their sets of ``shingle`` words in a row overlap by
``similarity`` or more.  Candidates are (1) pairs whose fingerprints the generalised pigeonhole of
:mod:`evidra.llm.simhash` links, and (2) pairs that share one of ``BANDS`` keys, each made of the least
values of their set under ``ROWS`` permutations, since texts alike by 0.8 differ in about ten of 64
fingerprint bits, beyond any radius that a pigeonhole can probe: at similarity 0.8 one pair in about
13,000 shares no key.  Every candidate pair is checked on the sets themselves, so
no texts are linked below the similarity.

Texts with the same set are one node.  Buckets of a key up to ``PAIRED`` nodes are compared each
with each.  In larger ones a node first meets its ``NEIGHBOURS`` next ones, in an order that
differs from key to key, which joins a family without all its pairs.  The nodes of larger buckets that are
not one group by then are compared exactly (:func:`rest`): in blocks, each with each of another group, by
counting what their sets share; tasks hold two blocks and return only links that join groups, not pairs.

Defined results: null and wordless texts have one set; shorter texts have themselves as their one shingle.
Equal rows and rows that share an id are documents each.  Ties go to the least id.  Very long texts are read
in bounded batches (a text beyond the bound alone).  An empty table gives no rows.  Columns other than doc_id
and text are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import graph, shared, simhash
from evidra.llm.substring import _M1, IdFilter, _mix, _rolled, keyed, without, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
BLOCK = 1000  #: sets of one of the two blocks that a task compares
FIRST = 6  #: keys whose candidates are checked before the others'
PAIRED, NEIGHBOURS = 32, 4
CHECKED = 64  #: pairs whose sets one step holds
_FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: bytes, n: int) -> np.ndarray:
    """The distinct hashes of a text's ``n`` words in a row, sorted."""
    h = word_hashes(text.lower())
    return np.unique(_rolled(h, min(n, max(len(h), 1)), _M1)) if len(h) else np.zeros(1, np.uint64)


def identity(own: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash."""
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def band_keys(own: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(own), 4096):
        np.minimum(least, np.multiply.outer(_FACTORS, own[start : start + 4096]).min(axis=1), out=least)
    return _rolled_rows(least.reshape(BANDS, ROWS))


def _rolled_rows(least: np.ndarray) -> np.ndarray:
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        x = _mix(x * _M1 + least[:, i])
    return x


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, fp, keys): per row its set's name and keys, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 512, "text"):
            texts = shared.binary(batch.column("text"))
            sets = [shingles(t, shingle) for t in texts]
            keys = np.concatenate([band_keys(s) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), _signed(keys))
            fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": pa.array([identity(s) for s in sets], pa.int64()), "fp": _signed(fps), "keys": lists})

    return docs.mapInArrow(run, "doc_id long, h long, fp long, keys array<long>")


def _pairs(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs to check in whole buckets, which stand together."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    each = np.repeat(size, size)
    at, to = [], []
    idx = np.arange(len(key))
    for d in range(1, int(min(PAIRED, size.max(initial=1) + 1))):
        idx = idx[idx + d < len(key)]
        idx = idx[(key[idx] == key[idx + d]) & ((each[idx] <= PAIRED) | (d <= NEIGHBOURS))]
        at.append(idx)
        to.append(idx + d)
    at, to = (np.concatenate(x or [np.zeros(0, int)]) for x in (at, to))
    return np.minimum(h[at], h[to]), np.maximum(h[at], h[to])


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of ``rows`` (key, h) to check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("key", "h")]))
            n += batch.num_rows
            if n >= 200_000:
                x = np.concatenate(held, axis=1)
                other = np.flatnonzero(x[0] != x[0, -1])
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    u, v = _pairs(x[0, :whole], x[1, :whole])
                    yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})
                held = [x[:, whole:]]
                n = x.shape[1] - whole if whole else 0  # one bucket so far: wait for as many again
        if held and (x := np.concatenate(held, axis=1)).shape[1]:
            u, v = _pairs(x[0], x[1])
            yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", F.xxhash64("key", "h"))
    return dealt.mapInArrow(run, "u long, v long").distinct()


def checked(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets (a, b) overlap by ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in shared.small_batches([batch], CHECKED):
                keep = []
                for a, b in zip(some.column("a"), some.column("b"), strict=True):
                    x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield pa.RecordBatch.from_pydict({c: some.column(c).filter(pa.array(keep, pa.bool_())) for c in ("u", "v")})

    return pairs.mapInArrow(run, "u long, v long")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """(h, own): each row's set and its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 128, "text"):
            sets = [shingles(t, shingle) for t in shared.binary(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"h": pa.array([identity(s) for s in sets], pa.int64()), "own": pa.array([s.tobytes() for s in sets], pa.binary())})

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, own binary")


def _checked_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (u, v) among ``pairs``, from the sets of the documents that stand for their nodes (h, least)."""
    ends = pairs.select(F.col("u").alias("h")).unionByName(pairs.select(F.col("v").alias("h"))).distinct()
    sets = shared.materialise(_sets(docs, nodes.join(ends, "h"), shingle), "sets")
    both = pairs.join(sets.select(F.col("h").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("h").alias("v"), F.col("own").alias("b")), "v")
    links = shared.materialise(checked(both.select("u", "v", "a", "b"), similarity), "links")
    shared.discard(sets)
    return links


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(h, own) of ``nodes`` (h, least); texts that stand for none of them are held back by a fixed-size filter before the join."""
    named = shared.materialise(nodes.select(F.col("least").alias("doc_id")).distinct(), "named")
    maybe, _ = IdFilter(named).split(docs.withColumn("own", F.lit(0).cast("long")))
    return sets_of(maybe.join(named, "doc_id", "left_semi"), shingle).dropDuplicates(["h"]).join(nodes.select("h"), "h", "left_semi")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` whose ends are not in one group by ``roots`` (node, root)."""
    u, v = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    j = pairs.join(u, "u", "left").join(v, "v", "left")
    return j.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")


def joins(group: np.ndarray, block: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets alike by ``similarity`` that join groups, of one block each with each or of two blocks each with the other's.

    Sets go by size, so that those that can be alike lie side by side; what is joined already is not compared again.
    """
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size, flat = size[order], np.concatenate([sets[i] for i in order])
    at = np.concatenate([[0], np.cumsum(size)])
    _, root = np.unique(group[order], return_inverse=True)
    block, two, out = block[order], len(np.unique(block)) > 1, []
    for i in range(len(order) - 1):
        end = int(np.searchsorted(size, size[i] / similarity + 1e-9, side="right"))
        other = np.flatnonzero((root[i + 1 : end] != root[i]) & ((block[i + 1 : end] != block[i]) | (not two))) + i + 1
        if not len(other):
            continue
        own, some = flat[at[i] : at[i + 1]], flat[at[i + 1] : at[end]]
        found = own[np.minimum(np.searchsorted(own, some), len(own) - 1)] == some
        both = np.add.reduceat(found.astype(np.int64), at[i + 1 : end] - at[i + 1])[other - i - 1]
        for j in other[both >= similarity * (size[i] + size[other] - both) - 1e-9].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _join_blocks(similarity: float):
    """Over rows (k, b, g, h, own) sorted by k, whose rows are one block or two: links that join groups."""

    def out(x: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(x)
        h = t.column("h").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for c in t.column("own").chunks for v in c]
        pairs = joins(t.column("g").to_numpy(), t.column("b").to_numpy(), sets, similarity)
        u, v = (np.array([h[p[k]] for p in pairs], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_pydict({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            k = batch.column("k").to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j and k[i] != key:
                    if held:
                        yield out(held)
                    held, key = [], k[i]
                if i < j:
                    held.append(batch.slice(i, j - i))
        if held:
            yield out(held)

    return run


def rest(docs: DataFrame, nodes: DataFrame, keys: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame | None:
    """Links (u, v) between groups of nodes of buckets (key, h) beyond ``PAIRED`` that are not one group by ``roots`` (node, root); None without such buckets.

    Exact: nodes that such buckets connect are compared each with each of another group, ``BLOCK`` by ``BLOCK``.
    """
    big = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PAIRED).select("key")
    grouped = keys.select("key", "h").join(big, "key", "left_semi").join(roots, F.col("h") == F.col("node"), "left").select("key", "h", F.coalesce("root", "h").alias("g"))
    grouped = shared.materialise(grouped, "buckets")
    split = grouped.groupBy("key").agg(F.min("g").alias("a"), F.max("g").alias("z"), F.min("h").alias("first")).where("a <> z").select("key", "first")
    left = shared.materialise(grouped.join(split, "key"), "open")
    if left.isEmpty():
        return None
    sets = _sets(docs, nodes.join(left.select("h").distinct(), "h"), shingle)
    meet = graph.components(left.select(F.col("h").alias("u"), F.col("first").alias("v")))  # nodes that buckets connect
    placed = left.select("h", "g").distinct().join(meet, F.col("h") == F.col("node"), "left").select("h", "g", F.coalesce("root", "h").alias("r"))
    blocks = placed.groupBy("r").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    own = placed.join(blocks, "r").withColumn("b", F.pmod(F.xxhash64("h"), F.col("n")).cast("int")).join(sets, "h")
    rows = own.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(F.xxhash64("r", F.least("b", "c"), F.greatest("b", "c")).alias("k"), "b", "g", "h", "own")
    dealt = rows.repartition(shared.partitions(docs.sparkSession), "k").sortWithinPartitions("k")
    return dealt.mapInArrow(_join_blocks(similarity), "u long, v long").distinct()


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text), whose ids are whole and unique: doc_id, component_id (the least doc_id reachable).

    Candidates are checked in three turns, each without pairs that the turns before have joined: those of the
    fingerprints and the first keys, those of the other keys, and the rest of large buckets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = shared.materialise(signatures(docs, shingle), "signatures")
    nodes = shared.materialise(found.groupBy("h").agg(F.min(F.struct("doc_id", "fp")).alias("x")).select("h", F.col("x.doc_id").alias("least"), F.col("x.fp").alias("fp")), "nodes")
    first = found.join(nodes.select("h", "least"), (F.col("doc_id") == F.col("least")) & (found["h"] == nodes["h"])).select(F.posexplode("keys").alias("band", "key"), found["h"])
    keys = shared.materialise(first, "keys")
    turns = [
        lambda _: (candidates(keys.where(F.col("band") < FIRST)).unionByName(by_fingerprint(nodes)).distinct(), True),
        lambda roots: (_apart(candidates(keys.where(F.col("band") >= FIRST)), roots), True),
        lambda roots: (rest(docs, nodes, keys, roots, shingle, similarity), False),
    ]
    n = nodes.count()
    links = roots = None
    for turn in turns:
        own, open_yet = turn(roots)
        if own is None:
            continue
        own = shared.materialise(own, "pairs")
        if open_yet and (roots is None or not own.isEmpty()):
            own = _checked_pairs(docs, nodes, own, shingle, similarity)
        if roots is not None and own.isEmpty():
            continue
        links = own if links is None else links.unionByName(own)
        roots = graph.components(links, nodes=n)
    rooted = nodes.join(roots, nodes["h"] == roots["node"], "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = shared.materialise(found.select("doc_id", "h").join(rooted.join(component, "root").select("h", "component_id"), "h").select("doc_id", "component_id"), "components")
    for df in (found, nodes, keys):
        shared.discard(df)
    return out


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes (h, fp) that their fingerprints link, by :func:`evidra.llm.simhash.all_links`.

    Nodes of one fingerprint meet the first of them.
    """
    first = shared.materialise(nodes.groupBy("fp").agg(F.min("h").alias("h")), "firsts")
    links = simhash.all_links(first.select("fp"))
    far = links.join(first.select(F.col("fp").alias("u"), F.col("h").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("h").alias("b")), "v").select("a", "b")
    same = nodes.select("fp", F.col("h").alias("b")).join(first.withColumnRenamed("h", "a"), "fp").select("a", "b")
    both = far.unionByName(same).where("a <> b")
    return both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group: the first by id, then by a hash of the text (a null id is least).

    Rows that share an id are documents of their own: unlike texts stay all, of alike ones one row stays.
    """
    own = shared.neutral(docs)
    texts = keyed(own)
    named = texts.select("doc_id", "text")
    gone = near_copies(named, shingle, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_k"))
    if not getattr(texts, "_evidra_ranked", False):
        return without(own.withColumn("_k", F.col("doc_id").cast("long")), gone, "_k").drop("_k").toDF(*docs.columns)
    columns = [f"_o{i}" for i in range(len(own.columns))]
    return without(texts.select(F.col("doc_id").alias("_k"), *columns), gone, "_k").select(*columns).toDF(*docs.columns)
