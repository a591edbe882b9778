"""The style tree: entropies computed anew, what it removes, and what markup alone does not."""

import math
import random
from collections import Counter, defaultdict

import pytest

from evidra.llm import html_tree as h


def _table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _site(n, host="http://s.example/"):
    rng = random.Random(7)
    say = lambda k: " ".join(rng.choice("abcdefghij") + str(rng.randrange(4000)) for _ in range(k))
    rows = []
    for i in range(n):
        share = "<div class='x1'>Print this page or send it</div><p>A passage that half of the articles quote.</p>"[: None if i % 2 else 53]
        extra = "<p>an aside</p>" if i % 2 else "<ul><li>one<li>two</ul>"
        rows.append((i, f"{host}{i}", f"<body><div class=t>Our daily site</div><article><h2>Summary</h2><p>{say(30)}</p>{extra}<p>{say(20)}</p>{share}</article><div class=z>{say(3)}</div></body>"))
    return rows


def test_entropies(spark):
    rows = _site(30) + _site(7, "http://t.example/") + _site(2, "http://u.example/") + [(99, None, None)]
    want = {}
    hosts = defaultdict(list)
    for _, url, html in rows:
        hosts[h.host_of(url)].append(h.read_page(html or ""))
    for host, pages in hosts.items():
        shown, said, below = defaultdict(Counter), defaultdict(lambda: defaultdict(set)), defaultdict(set)
        style = {}
        for blocks, nodes in pages:
            own = h.company(blocks)
            for key, path, presentation, n in set(nodes):
                shown[key][presentation, own] = 1
                style[key, presentation] = n
                for k in path:
                    below[k].add(key)
            for b in blocks:
                said[b.leaf][b.value].add(own)
        pages_of = {k: sum(c.values()) for k, c in shown.items()}
        text = lambda node, v: 1.0 if pages_of[node] < 4 else max(0.0, 1 - math.log(len(said[node][v]), pages_of[node]))  # noqa: E731, B023
        for node, counts in shown.items():
            m = pages_of[node]
            if m < 4:
                continue
            each = Counter(p for p, _ in counts)
            entropy = -sum(x / m * math.log(x / m, m) for x in each.values())
            size = sum(style[node, p] * x for p, x in each.items()) / m
            weights = [(len(c), text(leaf, v)) for leaf in below[node] if leaf in shown for v, c in said[leaf].items()]
            content = sum(a * b for a, b in weights) / sum(a for a, _ in weights) if weights else 0.0
            keep = h.DAMPING**size
            want[host, node, None] = max(content, (1 - keep) * entropy + keep * content)
            want.update({(host, node, v): text(node, v) for v in said[node]})
    got = {(r.host, r.node, r.value): r.importance for r in h.style_tree(_table(spark, rows)).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("limit", [h.BROADCAST_NODES, 0])
def test_tree_removes(spark, limit):
    rows = _site(30)
    copied = "<body><article><h2>Copied</h2><p>this article stands on very many pages of the site word by word</p><p>and so does its second part</p></article><div>%d</div></body>"
    rows += [(100 + i, f"http://s.example/c{i}", copied % i) for i in range(40)]
    got = {r.page_id: r.text for r in h.extract(_table(spark, rows), broadcast_nodes=limit).collect()}
    for i in range(30):
        assert "Our daily site" not in got[i] and "Print this page" not in got[i]
        assert ("A passage that half" in got[i]) == (i % 2 == 1)
        assert got[i].startswith("Summary ") and len(got[i].split()) >= 51
    assert all(got[100 + i] == "Copied this article stands on very many pages of the site word by word and so does its second part" for i in range(40))


def test_markup_is_evidence_only():
    page = "<article><p>It has <span class=notice>some</span> parts.</p><div class='side effects'>Side effects follow.</div><p class=related-work>Others did so.</p><p id=legal>A legal term.</p><div class='share-box'>share</div><div class=comments><p>first!</p></div></article>"
    assert h.main_text(page, {}) == "It has some parts. Side effects follow. Others did so. A legal term."
    teaser = "<article>Read on</article><div>" + "The body of the page stands outside of any article element here. " * 3 + "</div>"
    assert h.main_text(teaser, {}).startswith("Read on The body")
    assert h.main_text("<p>before</p><article>" + "a whole article " * 9 + "</article>", {}).startswith("a whole")
    assert h.main_text("<p>seen <b hidden>not</b></p>", {}) == "seen"


def test_odd_tables(spark):
    rows = [(1, "x", "<p>a"), (1, "x", "<p>a"), (None, None, None), (3, "", "")]
    df = spark.createDataFrame([(*r, "t", "n") for r in rows], "page_id long, url string, html string, text string, node string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in h.extract(df).collect())
    assert got == [(0, "", 0), (1, "a", 1), (1, "a", 1), (3, "", 0)]
    assert h.extract(df.limit(0)).count() == 0
