"""Information-theoretic sanitisation of personal data, with DataFrame functions alone.

Base entities are found by pattern (email, ip, card, phone).  Beyond them, a term (a word or number)
is disclosive when the corpus says it reveals an entity: with N distinct texts, c(e) of
them holding the entity, c(t) the term, and c(t, e) both, anywhere in the text,

    PMI(t, e) = log2(N c(t, e) / (c(t) c(e))),    IC(e) = log2(N / c(e)),

and the term is treated in the texts that hold the entity where PMI / IC reaches the disclosure
threshold and c(t, e) lies ``BEYOND`` standard errors above what chance gives: generalised to its
kind (name, number, word), or removed where the ratio reaches ``REMOVE``.  All counts are over
distinct texts, so copies add no evidence, and over all documents.  Pairs need ``MIN_SUPPORT`` texts.

Defined results: null text counts as empty and has no spans.  Repeated rows, and rows that share an id, are
each reported; what is found depends on a row's text alone.  Spans that overlap are reported each and replaced
as one.  Positions are code points.  Very long texts are read whole, by regular expressions without
backtracking and by scans in short steps.  An empty table gives no rows.  Columns other than
doc_id and text are left as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import arrays
from evidra.llm import shared

KINDS = ("email", "ip", "card", "phone")
# The kinds' patterns.  A run of local-part characters is entered at its start only (or where the last match ended),
# and repeated groups are possessive: the same matches, without backtracking on long runs.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match of the kind that could be kept.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

MIN_SUPPORT = 3
THRESHOLD = 0.5
REMOVE = 0.9
BEYOND = 5.0
BROADCAST_TERMS = 50_000
BROADCAST_SPANS = 500_000
PIECE = 4096  #: code points of a text that are searched for a place
TERM = r"[\p{L}\p{N}]++"
LABELS = {"name": "<NAME>", "number": "<NUMBER>", "word": "<WORD>", "gone": ""}
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_PLACES = "array<struct<start:int,end:int,kind:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the mod-10 check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & _luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _located(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their places: what lies between them, from a split on the same pattern, gives the offsets."""
    def place(at: Column, step: Column) -> tuple[Column, Column]:
        start = at + step["gap"]
        return start + step["n"], F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + step["n"]).alias("end"), step["value"].alias("value"))

    def found(matches: Column) -> Column:
        between = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, value: F.struct(F.char_length(gap).alias("gap"), value.alias("value"), F.char_length(value).alias("n")))
        return arrays.scan(steps, F.lit(0), place, _SPANS)

    return arrays.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _valid(kind: str):
    return lambda x: VALID[kind](x["value"])


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind, the kept matches in order: array of (kind, start, end, value)."""
    none = F.array().cast(_SPANS)
    return {k: F.when(NEEDS[k](text), F.filter(_located(text, PATTERNS[k], k), _valid(k))).otherwise(none) for k in KINDS}


def _with_text(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_t`` (text or empty) and ``_h`` (its hash)."""
    return docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_h", F.xxhash64("_t"))


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_t``, ``_h`` and one ``_<kind>`` array per kind."""
    d = _with_text(docs)
    for kind, spans in base_spans(F.col("_t")).items():
        d = d.withColumn(f"_{kind}", spans)
    return d


def _terms(text: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def entities_of(found: DataFrame) -> DataFrame:
    """(h, entity): the entities of each distinct text of ``found`` (_h, _base)."""
    e = found.where(F.size("_base") > 0).select(F.col("_h").alias("h"), F.explode("_base").alias("e"))
    value = F.when(F.col("e.kind") == "email", F.lower("e.value")).when(F.col("e.kind") == "ip", F.col("e.value")).otherwise(_digits(F.col("e.value")))
    return e.select("h", F.concat(F.col("e.kind"), F.lit(":"), value).alias("entity")).distinct()


def _small(df: DataFrame, bound: int) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def revealing_terms(docs: DataFrame, found: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame] | None:
    """(entity, term, ratio) of pairs at or beyond the disclosure threshold, and (h, es, ts), the entities and terms of the texts that hold some; or None if there is none.

    A pair stands in no more texts than its entity, so entities in fewer than ``min_support`` texts need no terms.
    """
    held = shared.materialise(entities_of(found), "entities")
    c_e = held.groupBy("entity").agg(F.count("*").alias("c_e")).where(F.col("c_e") >= min_support)
    held = shared.materialise(held.join(c_e, "entity"), "entities")
    if held.isEmpty():
        return None
    of = held.groupBy("h").agg(F.collect_list(F.struct("entity", "c_e")).alias("es"))  # the entities of one text
    texts = _with_text(docs).select(F.col("_h").alias("h"), "_t").join(_small(of, BROADCAST_TERMS), "h").dropDuplicates(["h"])
    near = shared.materialise(texts.select("h", "es", _terms(F.col("_t")).alias("ts")), "near")
    total = found.select("_h").distinct().count()
    pairs = near.select(F.explode("es").alias("e"), "ts").select("e.*", F.explode("ts").alias("term")).groupBy("entity", "c_e", "term").agg(F.count("*").alias("c_te")).where(F.col("c_te") >= min_support)
    pairs = shared.materialise(pairs, "pairs")
    if pairs.isEmpty():
        return None
    j = pairs.join(text_counts(docs), "term").withColumn("n", F.lit(total)).where("c_e < n")
    expected = F.col("c_t") * F.col("c_e") / F.col("n")
    chance = F.col("c_te") - expected >= BEYOND * F.sqrt(expected * (1 - F.col("c_e") / F.col("n")))
    ratio = F.log2(F.col("n") * F.col("c_te") / (F.col("c_t") * F.col("c_e"))) / F.log2(F.col("n") / F.col("c_e"))
    shown = j.withColumn("ratio", ratio).where((F.col("ratio") >= threshold) & chance).select("entity", "term", "ratio")
    return shared.materialise(shown, "revealing"), near


def text_counts(docs: DataFrame) -> DataFrame:
    """(term, c_t): in how many distinct texts of ``docs`` each term stands.

    Counted over all rows with partial sums, less what copies add: only texts that stand more than once are looked at again.
    """
    d = _with_text(docs.select("text"))
    every = d.select(F.explode(_terms(F.col("_t"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    many = shared.materialise(d.groupBy("_h").agg((F.count("*") - 1).alias("more")).where("more > 0"), "copies")
    once = d.join(_small(many, BROADCAST_TERMS), "_h").dropDuplicates(["_h"])
    again = once.select("more", F.explode(_terms(F.col("_t"))).alias("term")).groupBy("term").agg(F.sum("more").alias("more"))
    return every.join(again, "term", "left").select("term", (F.col("n") - F.coalesce("more", F.lit(0))).alias("c_t"))


def term_spans(docs: DataFrame, found: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame | None:
    """(h, terms): the places and kinds of disclosive terms in each distinct text that has some."""
    got = revealing_terms(docs, found, min_support, threshold)
    if got is None or got[0].isEmpty():
        return None
    pairs, near = got
    # Terms of the text that an entity of it reveals; the highest ratio counts.
    both = near.select("h", F.explode("es").alias("e"), "ts").select("h", "e.entity", F.explode("ts").alias("term"))
    named = shared.materialise(both.join(_small(pairs, BROADCAST_TERMS), ["entity", "term"]).groupBy("h", "term").agg(F.max("ratio").alias("ratio")), "named")
    of = shared.materialise(named.select("h").distinct(), "texts")
    texts = _with_text(docs).select(F.col("_h").alias("h"), "_t").join(_small(of, BROADCAST_TERMS), "h", "left_semi").dropDuplicates(["h"])
    at = texts.select("h", F.explode(_located(F.col("_t"), TERM, "term")).alias("x")).withColumn("term", F.lower("x.value"))
    value = F.col("x.value")
    kind = F.when(F.col("ratio") >= REMOVE, "gone").when(value.rlike(r"\p{N}"), "number").when(value.rlike(r"^\p{Lu}"), "name").otherwise("word")
    # Terms of one text, bounded by its length.
    placed = at.join(named, ["h", "term"]).groupBy("h").agg(F.array_sort(F.collect_list(F.struct(F.col("x.start").alias("start"), F.col("x.end").alias("end"), kind.alias("kind")))).alias("terms"))
    return shared.materialise(placed, "term-spans")


def _few(terms: DataFrame) -> DataFrame:
    """``terms``, to be broadcast if they have few spans in all."""
    n = terms.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    return F.broadcast(terms) if n <= BROADCAST_SPANS else terms


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, counts per base kind, base_sha256, spans (base spans, then disclosive terms), n_term."""
    d = docs.select("doc_id", "text")
    found = detect(d).select("doc_id", "_h", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.concat(*(F.col(f"_{k}") for k in KINDS)).alias("_base"))
    found = shared.materialise(found, "spans")
    terms = term_spans(d, found, min_support, threshold)
    base = _shown(F.col("_base"))
    out = [F.col("doc_id"), *(F.col(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256")]
    if terms is None:
        return found.select(*out, base.alias("spans"), F.lit(0).cast("long").alias("n_term"))
    shown = F.array_join(F.transform("terms", lambda x: F.concat(F.lit("term:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    j = found.join(_few(terms).withColumnRenamed("h", "_h"), "_h", "left")
    spans = F.concat_ws(",", F.nullif(base, F.lit("")), shown)
    return j.select(*out, spans.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def _replaced(text: Column, spans: Column, label) -> Column:
    """``text`` with each of its disjoint spans replaced; a place is looked for in its piece of the text alone."""

    def made(pieces: Column, spans: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.substring(some, start - first * PIECE + 1, end - start)

        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
        gaps = F.zip_with(F.slice(ends, 1, F.size(spans)), spans, lambda at, x: F.concat(between(at, x["start"]), label(x)))
        return F.concat(F.array_join(gaps, ""), between(F.element_at(ends, -1), F.char_length(text)))

    pieces = F.transform(F.sequence(F.lit(0), F.char_length(text), F.lit(PIECE)), lambda i: F.substring(text, i + 1, F.lit(PIECE)))
    return arrays.let(pieces, lambda p: arrays.let(spans, lambda x: made(p, x)))


def sanitise(docs: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each entity generalised to its kind and each disclosive term to its own or removed.

    Overlapping spans are joined; the joined span takes the kind that comes first.
    Texts without spans, null among them, stay exactly as they are; ``n_chars`` follows the new text where it exists.
    """
    own = shared.neutral(docs)
    columns = own.columns
    found = shared.materialise(detect(own.select("text")).select("_h", F.concat(*(F.col(f"_{k}") for k in KINDS)).alias("_base")).where(F.size("_base") > 0), "spans")
    every = _with_text(own.select("text")).select("_h").distinct()
    terms = term_spans(own, every.join(found.dropDuplicates(["_h"]), "_h", "left").select("_h", F.coalesce("_base", F.array().cast(_SPANS)).alias("_base")), min_support, threshold)
    d = detect(own)
    if terms is None:
        d = d.withColumn("terms", F.array().cast(_PLACES))
    else:
        d = d.join(_few(terms).withColumnRenamed("h", "_h"), "_h", "left").withColumn("terms", F.coalesce("terms", F.array().cast(_PLACES)))
    labels = [f"<{k.upper()}>" for k in KINDS] + list(LABELS.values())
    kinds = [*KINDS, *LABELS]
    rank = lambda x: (F.array_position(F.array(*map(F.lit, kinds)), x["kind"]) - 1).cast("int")
    ranked = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), rank(x).alias("rank")))
    d = d.withColumn("_all", F.array_sort(F.concat(*(ranked(F.col(c)) for c in (*(f"_{k}" for k in KINDS), "terms")))))
    shape = "array<struct<start:int,end:int,rank:int>>"

    def join(last: Column, x: Column) -> tuple[Column, Column]:
        apart = x["start"] >= last["end"]
        now = F.struct(
            F.when(apart, x["start"]).otherwise(last["start"]).alias("start"), F.when(apart, x["end"]).otherwise(F.greatest(last["end"], x["end"])).alias("end"), F.when(apart, x["rank"]).otherwise(F.least(last["rank"], x["rank"])).alias("rank")
        )
        return now, now

    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("rank"))
    d = d.withColumn("_run", arrays.scan(F.col("_all"), zero, join, shape))
    ends = lambda x, i: (i == F.size("_run") - 1) | (F.get(F.col("_all"), i + 1)["start"] >= x["end"])
    d = d.withColumn("_joined", F.filter("_run", ends))
    text = F.when(F.size("_joined") > 0, _replaced(F.col("_t"), F.col("_joined"), lambda x: F.get(F.array(*map(F.lit, labels)), x["rank"]))).otherwise(F.col("text"))
    d = d.withColumn("_new", text)
    made = [F.col("_new").alias("text") if c == "text" else F.when(F.size("_joined") > 0, F.char_length("_new").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in columns]
    return d.select(*made).toDF(*docs.columns)
