"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window.

Built from DataFrame functions alone.  A window of ten words holds, at any alignment,
a five-word gram that starts at a multiple of six, so each text probes one gram in six
against the hash set; only around hits are whole windows compared, as strings.  Items
shorter than a window are one window each and get a gram length and stride of their own.

The hash set of grams, and that of whole windows with their items, are broadcast join sides: hash relations that
Spark builds once an executor.  Probes are exploded rows that never leave their task unless a gram hits, and one row a text
stands for those without a hit.  That holds while the benchmark has at most ``MAX_GRAMS`` grams and windows (counted
first); a larger benchmark is matched by shuffled joins instead.

Null text has no words.  Repeated rows are judged each.  An empty benchmark hits nothing, an empty table gives no rows.
Very long texts are probed whole: what a text adds in memory is some three times its words.  Equal windows of several items count
for each of them.  Extra columns of either table are ignored by :func:`report` and kept by :func:`remove`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
MAX_GRAMS = 500_000
#: Words of 64 bits of the fixed-size filter of hit texts that keeps clean ones from being shuffled; as many rows are broadcast at most.
FILTER_WORDS = 1 << 17
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; texts without other letters take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text.cast("string")), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(k)))


@dataclass(frozen=True)
class Probe:
    """How windows of one length are found: grams of k words at multiples of the stride."""

    length: int

    @property
    def k(self) -> int:
        return -(-self.length // 2)

    @property
    def stride(self) -> int:
        return self.length - self.k + 1

    def probed(self, words: Column, n: Column) -> Column:
        """Positions whose grams are looked up."""
        last = F.floor((n - self.k) / self.stride).cast("int")
        return F.when(n >= self.length, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: j * self.stride)).otherwise(F.array().cast("array<int>"))

    def probes(self, words: Column, n: Column) -> Column:
        """(at, length, gram, from, near) of each position looked up, with the words of all windows that hold the gram, the first of them at ``from``."""
        first = lambda at: F.greatest(at - (self.stride - 1), F.lit(0))
        near = lambda at: F.slice(words, first(at) + 1, F.lit(self.stride - 1 + self.length))
        return F.transform(self.probed(words, n), lambda at: F.struct(at.alias("at"), F.lit(self.length).alias("length"), gram(words, at, self.k).alias("gram"), first(at).alias("from"), near(at).alias("near")))

    def starts(self, hits: Column, n: Column) -> Column:
        """Starts of the windows that hold a hit gram."""
        return F.array_distinct(F.flatten(F.transform(hits, lambda p: F.filter(F.sequence(p - (self.stride - 1), p), lambda s: (s >= 0) & (s + self.length <= n)))))

    def grams_at(self, words: Column, n: Column) -> Column:
        """(at, gram) of each position looked up."""
        return F.transform(self.probed(words, n), lambda at: F.struct(at.alias("at"), gram(words, at, self.k).alias("gram")))

    def windows_at(self, words: Column, starts: Column) -> Column:
        """(start, length, window) of each start."""
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(self.length).alias("length"), self.window(words, s).alias("window")))

    def window(self, words: Column, start: Column) -> Column:
        return F.array_join(F.slice(words, start + 1, self.length), " ")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """One row per window of each item: item_id, length, window, and its words."""
    w = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    w = w.withColumn("length", F.least("n", F.lit(WINDOW)))
    at = F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length")))
    return w.select("item_id", "length", at.alias("at"), "words").select("item_id", "length", F.slice("words", F.col("at") + 1, F.col("length")).alias("own")).withColumn("window", F.array_join("own", " "))


def split(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_words``, their number ``_n`` and a number ``_row`` of the row."""
    return docs.select("*", words_of(F.col("text")).alias("_words"), F.monotonically_increasing_id().alias("_row")).withColumn("_n", F.size("_words"))


class Matcher:
    """Finds the windows of a benchmark in texts."""

    def __init__(self, benchmark: DataFrame, max_grams: int = MAX_GRAMS):
        self.windows = benchmark_windows(benchmark)
        self.lengths = [r.length for r in self.windows.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()]
        self.probes = [Probe(n) for n in self.lengths]
        grams = None
        for p in self.probes:
            own = self.windows.where(F.col("length") == p.length).select("own", F.explode(F.sequence(F.lit(0), F.lit(p.stride - 1))).alias("g"))
            g = own.select(F.lit(p.length).alias("length"), gram(F.col("own"), F.col("g"), p.k).alias("gram"))
            grams = g if grams is None else grams.unionByName(g)
        self.grams = grams.distinct() if grams is not None else None
        few = lambda df: df.limit(max_grams + 1).count() <= max_grams
        self.broadcast = self.grams is None or (few(self.grams) and few(self.windows))
        self.items = self.windows.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))

    def located(self, d: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, start, length, items): each hit window of the texts in ``d`` (keys, _words, _n), and a row with nulls for each text."""
        words, n = F.col("_words"), F.col("_n")
        if self.grams is None:
            return d.select(*keys, F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("array<string>").alias("items"))
        none = F.lit(None)
        text = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("length"), none.cast("long").alias("gram"), F.lit(0).alias("from"), none.cast("array<string>").alias("near")))
        e = d.select(*keys, F.explode(F.concat(text, *(p.probes(words, n) for p in self.probes))).alias("x")).select(*keys, "x.*")
        known = F.broadcast(self.grams.select("gram").distinct().withColumn("_known", F.lit(True)))
        hit = e.join(known, "gram", "left").where((F.col("at") < 0) | F.col("_known"))
        # Windows that hold a hit gram: as many of their words as there are, from each start.
        length, near, first = F.col("length"), F.col("near"), F.col("from")
        room = F.least(F.size("near") - length, F.col("at") - first)
        made = F.when((F.col("at") >= 0) & (room >= 0), F.transform(F.sequence(F.lit(0), room), lambda s: F.struct((first + s).alias("start"), length.alias("length"), F.array_join(F.slice(near, s + 1, length), " ").alias("window"))))
        w = hit.select(*keys, F.explode_outer(made).alias("w")).select(*keys, "w.*")
        return w.join(F.broadcast(self.items), "window", "left").where("items is not null or start is null").select(*keys, "start", "length", "items")

    def found(self, docs: DataFrame) -> DataFrame:
        """``docs`` with words, n_words and found: distinct (start, length, window) of each hit window, for a benchmark beyond the bound."""
        return self._found_by_join(split(docs))

    def _found_by_join(self, d: DataFrame) -> DataFrame:
        """The same by shuffled joins, for a benchmark beyond the bound: grams, then windows, are joined on equality."""
        from evidra.llm.shared import materialise

        none = F.array().cast("array<struct<start:int,length:int,window:string>>")
        if self.grams is None:
            return d.withColumn("_found", none)
        d = materialise(d, "decontam")
        words, n, parts = F.col("_words"), F.col("_n"), None
        for p in self.probes:
            own = self.grams.where(F.col("length") == p.length).select("gram")
            probes = d.select("_row", F.explode(p.grams_at(words, n)).alias("x")).select("_row", "x.*")
            hits = probes.join(own, "gram", "left_semi").groupBy("_row").agg(F.collect_set("at").alias("hits"))
            made = d.join(hits, "_row").select("_row", F.explode(p.windows_at(words, p.starts(F.col("hits"), n))).alias("x")).select("_row", "x.*")
            made = made.join(self.windows.where(F.col("length") == p.length).select("window"), "window", "left_semi")
            parts = made if parts is None else parts.unionByName(made)
        found = parts.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "length", "window"))).alias("_found"))
        return d.join(found, "_row", "left").withColumn("_found", F.coalesce("_found", none))


def _n_hit(found: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))))


def report(docs: DataFrame, benchmark: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    One shuffle, of a small row per text and one per hit window; texts stay where they are read.
    """
    m = Matcher(benchmark.select("item_id", "text"), max_grams)
    keys = ["_row", "doc_id", "_n"]
    if m.broadcast:
        w = m.located(split(docs.select("doc_id", "text")), keys)
    else:
        w = m.found(docs.select("doc_id", "text")).select(*keys, F.explode_outer("_found").alias("x")).select(*keys, "x.*").join(m.items, "window", "left")
    # A row's windows meet again by its key; each adds at most the benchmark's items.
    g = w.groupBy(*keys).agg(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))).alias("_found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = _n_hit(F.col("_found")).cast("long")
    return g.select("doc_id", F.col("_n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cleared(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` but those whose ``key`` is in ``gone`` (key), a written table, by DataFrame functions alone.

    A fixed-size Bloom filter of ``gone``, a broadcast join side (two bits in one of ``FILTER_WORDS`` words a key), clears
    most rows where they are read; only the others are shuffled, if Spark does not broadcast ``gone`` itself.
    """
    hashed = lambda df: df.withColumn("_h", F.xxhash64(key))
    word = F.pmod(F.shiftright("_h", 12), F.lit(FILTER_WORDS)).alias("_w")
    mask = F.expr("shiftleft(1L, cast(_h & 63 as int)) | shiftleft(1L, cast(shiftright(_h, 6) & 63 as int))").alias("_m")
    words = hashed(gone.select(key)).select(word, mask).groupBy("_w").agg(F.bit_or("_m").alias("_known"))
    placed = hashed(rows).select(*rows.columns, word, mask).join(F.broadcast(words), "_w", "left")
    maybe = F.coalesce(F.col("_known").bitwiseAND(F.col("_m")) == F.col("_m"), F.lit(False))
    sure, open_yet = (placed.where(x).select(*rows.columns) for x in (~maybe, maybe))
    return sure.unionByName(open_yet.join(gone, key, "left_anti").select(*rows.columns))


def remove(docs: DataFrame, benchmark: DataFrame, whole: bool = True, max_grams: int = MAX_GRAMS, native: bool = False) -> DataFrame:
    """``docs`` without contaminated documents, or (``whole=False``) with the hit words cut from their texts.

    ``native``: by DataFrame functions alone, clean texts being cleared by :func:`cleared` and not by a filter in Python.

    Cutting joins a touched text's remaining normalised words by one space; texts without hits stay as they are.
    What is hit is a matter of the text alone, so hits are kept by the text's MD5 (128 bits) and written as a small table,
    whose known size lets Spark decide how they meet the documents.
    """
    from evidra.llm.shared import materialise, neutral, ship
    from evidra.llm.substring import without

    if not native:
        ship(docs.sparkSession)
    own = neutral(docs)
    columns = own.columns
    m = Matcher(benchmark.select("item_id", "text"), max_grams)
    key = F.md5(F.col("text").cast("string").cast("binary")).alias("_key")
    texts = own.select("text", key)
    if m.broadcast:
        w = m.located(split(texts), ["_key"]).where("start is not null")
    else:
        w = m.found(texts).select("_key", F.explode("_found").alias("x")).select("_key", "x.*")
    found = materialise(w.groupBy("_key").agg(F.collect_set(F.struct("start", "length")).alias("_found")), "hits")
    d = own.select("*", key)
    if whole:
        return (cleared if native else without)(d, found.select("_key"), "_key").select(*columns).toDF(*docs.columns)
    words = words_of(F.col("text"))
    hit = F.array_distinct(F.flatten(F.transform("_found", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0))), hit), lambda i: F.get(F.col("_words"), i))
    j = d.join(found, "_key", "left").withColumn("_words", F.when(F.col("_found").isNotNull(), words)).withColumn("_n", F.size(F.coalesce("_words", F.array().cast("array<string>"))))
    return j.withColumn("text", F.when(F.col("_found").isNotNull(), F.array_join(kept, " ")).otherwise(F.col("text"))).select(*columns).toDF(*docs.columns)


#: The report in DuckDB, by every window against every window.
REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, s, l, array_to_string(w[s:s + l - 1], ' ') AS win
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hits AS (SELECT r, s, dw.l, item_id FROM dw JOIN bw USING (l, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM hits) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
