"""Main-text extraction with a site style tree.

Pages of one host are merged into one tree of style nodes (path of tags and classes).
A node's importance is composed of the entropy of its presentations (child sequences) over
the host's pages and of the entropy with which its texts spread over them: what looks and
reads alike on page after page is low, inside an article as outside.  A block's importance is the
least of its text's and of all nodes' that hold it.  Markup is evidence that scales it: an element
or class that names a menu, advert, comment or form (``STRONG``), a class that may name one
(``WEAK``), a place outside the article elements where these hold the page's text (``STRONG``);
a place inside them raises it (``ARTICLE``).
What is left at ``THRESHOLD`` or below is removed.  Elements within a sentence are no branches:
their classes say nothing.

Pages are told apart by the least-hashed three words of their main text, so that copies and near
copies of an article count as one page and keep their text.

Defined results: null or empty html gives empty text.  Unclosed and misnested elements are mended as
browsers do: a block closes an open paragraph, a list item the one before, an end tag what is open inside it.
Elements more than ``NAMED_DEPTH`` deep share the last style node of their path and are else like any other.
Repeated pages and pages that share a page_id are each reported; ties do not arise.  A null or odd url is
the host "".  Very long pages are read in bounded batches (a page beyond the bound alone).  An empty table
gives no rows.  Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import shared
from evidra.llm.substring import _M1, _rolled, word_hashes

THRESHOLD = 0.2
MIN_PAGES = 4  #: a node on fewer pages of its host is never low
DAMPING = 0.9
BROADCAST_NODES = 200_000
NAMED_DEPTH = 64  #: style nodes on a path
STRONG, WEAK = 0.2, 0.5  #: what evidence leaves of an importance
ARTICLE = 4.0  #: by how much standing in an article raises an importance: a passage that a third of a site's articles share is theirs
MAIN_SHARE = 1 / 3  #: article elements that hold less of the page's text are teasers, and say nothing of what is outside

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_ITEM = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ITEM_KIN = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements and class words that name what is not the article.
ROLE_TAGS = frozenset("nav footer aside form button dialog menu".split())
ROLE_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer masthead breadcrumb breadcrumbs ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing related recommended "
    "comment comments reply replies respond disqus pagination pager toolbar".split()
)
DOUBTFUL_WORDS = frozenset("side banner notice notices overlay social widget skip hidden copyright legal disclaimer".split())
#: Words that add nothing to the role word they stand beside.
FILLERS = frozenset("box bar area list section block item items wrapper container content inner outer link links post posts article articles main site page top bottom left right header body text wrap slot unit form".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_DIGITS = re.compile(r"[0-9]+")
_WORDS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Element:
    """An open element."""

    tag: str
    key: int
    weight: float  #: what the evidence of it and of what holds it leaves of an importance
    main: bool  #: inside an article
    children: list[str] = field(default_factory=list)  #: styles of its children, repeats in a row counted once


@dataclass(slots=True)
class Block:
    """A run of text with the path of style nodes that hold it."""

    text: str
    path: tuple[int, ...]
    weight: float
    main: bool
    heading: bool

    @property
    def leaf(self) -> int:
        return self.path[-1] if self.path else 0

    @property
    def value(self) -> int:
        return xxhash.xxh64_intdigest(self.text) >> 1


def attributes_of(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if "=" in raw or raw.strip(" /") else {}


def _evidence(tag: str, a: dict[str, str], main: bool) -> float:
    """What an element's markup leaves of the importance of what it holds; 0 if it is not shown."""
    if a and ("hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))):
        return 0.0
    if tag in ROLE_TAGS or (tag == "header" and not main):
        return STRONG
    if not a or tag in INLINE:
        return 1.0
    if a.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"):
        return STRONG
    kinds = [set(_WORDS.findall(name)) for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split()]
    if tag in ("html", "body", "article", "main"):
        return STRONG if any(k & {"comment", "comments"} for k in kinds) else 1.0
    if any(k & ROLE_WORDS and k <= ROLE_WORDS | FILLERS for k in kinds):
        return STRONG
    return WEAK if any(k & (ROLE_WORDS | DOUBTFUL_WORDS) for k in kinds) else 1.0


def read_page(html: str) -> tuple[list[Block], list[tuple[int, tuple[int, ...], str, int]]]:
    """The text blocks of a page in order, and its style nodes: (key, path, presentation, number of child styles)."""
    root = Element("#", 0, 1.0, False)
    stack, blocks, nodes, text = [root], [], [], []
    holder: Element | None = None

    def flush() -> None:
        nonlocal holder
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                blocks.append(Block(joined, tuple(e.key for e in held[:NAMED_DEPTH]), holder.weight, holder.main, any(e.tag in HEADINGS for e in held)))
        holder = None

    held: list[Element] = []
    open_tags: dict[str, int] = defaultdict(int)

    def close(to: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            open_tags[e.tag] -= 1
            if len(stack) <= NAMED_DEPTH:
                nodes.append((e.key, tuple(x.key for x in stack[1:]) + (e.key,), " ".join(e.children), len(e.children)))

    def say(s: str) -> None:
        nonlocal holder, held
        top = stack[-1]
        if holder is not None and (holder.weight != top.weight or holder.main != top.main):
            flush()
        if holder is None and s.strip():
            holder, held = top, stack[1:]
        if holder is not None:
            text.append(unescape(s) if "&" in s else s)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1 if open_tags[tag] else 0, 0, -1):
                if stack[i].tag == tag:
                    if any(e.tag not in INLINE for e in stack[i:]):
                        flush()
                    close(i)
                    break
            continue
        if tag not in INLINE:
            flush()
            for i in range(len(stack) - 1 if open_tags["p"] else 0, 0, -1):  # a block closes an open paragraph
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table", "button", "object"):
                    break
        if tag in CLOSES_ITEM:
            kin = ITEM_KIN.get(tag, {tag})
            for i in range(len(stack) - 1 if any(open_tags[k] for k in kin) else 0, 0, -1):
                if stack[i].tag in kin:
                    close(i)
                    break
                if stack[i].tag in CLOSES_ITEM[tag]:
                    break
        if tag in VOID:
            if tag == "br":
                flush()
            continue
        a = attributes_of(m[3])
        top = stack[-1]
        if tag in RAW:
            if m[3].endswith("/") and tag in ("svg", "math", "object"):
                continue
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "head":
            end = re.compile(r"</head\s*>|<body", re.I).search(html, at)
            at = (end.end() if html[end.start() + 1] == "/" else end.start()) if end else at
            continue
        style = tag + "".join("." + _DIGITS.sub("#", c) for c in sorted(a.get("class", "").split())[:3])
        main = top.main or tag in MAIN or a.get("role", "").lower() == "main" or a.get("itemprop", "") == "articleBody"
        weight = top.weight * _evidence(tag, a, main)
        if not top.children or top.children[-1] != style:
            top.children.append(style)
        key = xxhash.xxh64_intdigest(f"{top.key}/{style}") >> 1 if len(stack) <= NAMED_DEPTH else top.key
        open_tags[tag] += 1
        stack.append(Element(tag, key, weight, main and weight > STRONG))
    flush()
    close(1)
    return blocks, nodes


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def has_article(blocks: list[Block]) -> bool:
    """Whether the article elements hold the page's text, of what the evidence of roles leaves."""
    size = [(len(b.text), b.main) for b in blocks if b.weight > STRONG]
    return sum(n for n, main in size if main) >= MAIN_SHARE * max(1, sum(n for n, _ in size))


def company(blocks: list[Block]) -> int:
    """What a page counts as: the least hash of three words in a row of its main text, alike for most near copies."""
    article = has_article(blocks)
    h = word_hashes(" ".join(b.text for b in blocks if b.weight > STRONG and (b.main or not article)).encode())
    return int(_rolled(h, min(3, len(h)), _M1).min() >> np.uint64(1)) if len(h) else 0


PRESENTATION, TEXT, ANCESTOR = 0, 1, 2
STATS = "host string, node long, kind int, value long, children long, company long"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of a batch: the presentations of each node, its texts, and its ancestors (``children``; itself among them)."""
    for batch in shared.small_batches(batches, 1024, "html"):
        rows: set[tuple] = set()
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            blocks, nodes = read_page(html or "")
            own = company(blocks)
            for key, path, shown, n in nodes:
                rows.add((host, key, PRESENTATION, xxhash.xxh64_intdigest(shown) >> 1, n, own))
                if (mark := (host, key, ANCESTOR, key, key, 0)) not in rows:
                    rows.add(mark)
                    rows.update((host, key, ANCESTOR, k, k, 0) for k in path)
            rows.update((host, b.leaf, TEXT, b.value, 0, own) for b in blocks)
        if rows:
            names = [x.split()[0] for x in STATS.split(", ")]
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string() if n == "host" else pa.int32() if n == "kind" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The importance of every host's style nodes: (host, node, value, importance); value null for a whole branch, else a hash of one text in it.

    With m pages that show a node in n_i presentations, the presentation importance is -sum n_i/m log_m n_i/m.
    A text on n of them has the importance 1 - log_m n; a branch's content importance is the mean over its texts.
    A branch is as important as its content, or as both composed if that is more.  Nodes on fewer than ``min_pages``
    pages have importance 1 and are not listed.

    All counts are sums with partial aggregation, so a host with a third of all pages costs no task more than its share.
    """
    rows = pages.select("url", "html").mapInArrow(_stats, STATS)
    stats = shared.materialise(rows.groupBy("host", "node", "kind", "value").agg(F.count_distinct("company").alias("n"), F.max("children").alias("children")), "styles")
    shown = stats.where(F.col("kind") == PRESENTATION).groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum(F.col("n") * F.col("children")).alias("l"))
    shown = shown.select("host", "node", "m", (1 - F.col("nlogn") / (F.col("m") * F.log("m"))).alias("presentation"), (F.col("l") / F.col("m")).alias("l"))
    own = F.when(F.col("m") < min_pages, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.log("n") / F.log("m")))
    texts = stats.where(F.col("kind") == TEXT).select("host", "node", "value", "n").join(shown.select("host", "node", "m"), ["host", "node"]).withColumn("importance", own)
    said = texts.groupBy("host", "node").agg(F.sum("n").alias("texts"), F.sum(F.col("n") * F.col("importance")).alias("weight"))
    above = stats.where(F.col("kind") == ANCESTOR).select("host", "node", F.col("value").alias("branch"))
    below = said.join(above, ["host", "node"]).groupBy("host", F.col("branch").alias("node")).agg((F.sum("weight") / F.sum("texts")).alias("content"))
    keep = F.pow(F.lit(DAMPING), F.col("l"))
    content = F.coalesce("content", F.lit(0.0))
    composed = F.greatest(content, (1 - keep) * F.col("presentation") + keep * content)
    branches = shown.where(F.col("m") >= min_pages).join(below, ["host", "node"], "left").select("host", "node", F.lit(None).cast("long").alias("value"), composed.alias("importance"))
    return branches.unionByName(texts.where(F.col("m") >= min_pages).select("host", "node", "value", "importance"))


def kept_blocks(blocks: list[Block], low: dict[tuple[int, int | None], float], threshold: float = THRESHOLD) -> list[Block]:
    """The blocks of a page that stay; ``low`` holds importances below 1."""
    article, kept = has_article(blocks), []
    for b in blocks:
        weight = b.weight * (STRONG if article and not b.main else 1.0)
        if low and weight > threshold:
            title = b.main and b.heading  # a heading that articles have in common is still theirs
            held = [low.get((k, None), 1.0) for k in (b.path[:-1] if title else b.path)]
            least = min([*held, 1.0 if title else low.get((b.leaf, b.value), 1.0)], default=1.0)
            weight *= min(1.0, least * ARTICLE) if b.main else least
        if weight > threshold:
            kept.append(b)
    return kept


def main_text(html: str, low: dict[tuple[int, int | None], float], threshold: float = THRESHOLD) -> str:
    """The text of a page without branches of low importance."""
    return " ".join(b.text for b in kept_blocks(read_page(html)[0], low, threshold))


OUT = "page_id long, url string, text string, n_chars long"


def _extract(table, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches, 256, "html"):
            urls, texts = batch.column("url").to_pylist(), []
            lows = batch.column("low") if "low" in batch.schema.names else None
            for i, (url, html) in enumerate(zip(urls, batch.column("html").to_pylist(), strict=True)):
                low = {(x["node"], x["value"]): x["importance"] for x in lows[i].as_py() or ()} if lows is not None else (table.value if table else {}).get(host_of(url), {})
                texts.append(main_text(html or "", low, threshold))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": pa.array(urls, pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return run


def extract(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    The importances that can remove a block go to the tasks as one table while they are few (checked), else they are joined by host.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    low = shared.materialise(style_tree(pages, min_pages).where(F.col("importance") <= threshold / WEAK), "low")
    rows = low.limit(broadcast_nodes + 1).collect()
    if len(rows) <= broadcast_nodes:
        table: dict[str, dict] = {}
        for r in rows:
            table.setdefault(r.host, {})[r.node, r.value] = r.importance
        return pages.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(table), threshold), OUT)
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    lists = low.groupBy("host").agg(F.collect_list(F.struct("node", "value", "importance")).alias("low"))  # the style nodes of one site
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).join(lists, "host", "left").mapInArrow(_extract(None, threshold), OUT)
