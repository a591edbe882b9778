"""Each operator against brute force, over a small table with nulls, empty, very long and repeated texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from evidra.llm import decontam, html_tree, lm, ogg, packing, pii, shared, simhash, substring, tokenfile, toxicity
from evidra.llm.tokens import WordEncoder

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
BASE = " ".join(f"term{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "one", "Two WORDS", BASE, BASE, BASE + " and a tail", "head " + BASE, LONG, LONG, "é😀 ünï " * 30, "a " * 100,
    "mail a@b.com_x@y.org, +1 (555) 123-4567, 10.0.0.256 10.0.0.1 card 4111 1111 1111 1111", "question " + " ".join(f"q{i}" for i in range(14)) + " end", "Q0 q1-q2 Q3 q4 q5 q6 q7 q8 q9", "<|endoftext|> Ünder 123",
]


@pytest.fixture(scope="module")
def docs(spark):
    shared.ship(spark)
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, _t string, _words string").repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def texts():
    return {i: t or "" for i, t in enumerate(TEXTS)}


def words(t):
    return t.encode().split()


def test_simhash(docs, none):
    def fp(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    want = {i: fp(t) for i, t in texts().items()}
    ids = sorted(want)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (want[a] ^ want[b]).bit_count() <= 4:
                    root[a] = min(root[a], root[b])
    got = {r.doc_id: r for r in simhash.report(docs).collect()}
    assert {i: got[i].fingerprint for i in ids} == {i: f"{want[i]:016x}" for i in ids}
    assert {i: got[i].component_id for i in ids} == root
    assert simhash.report(none).count() == 0


def test_simhash_links_any_family():
    rng = np.random.default_rng(1)
    fam = np.unique(np.concatenate([np.uint64(b) ^ np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7))) for _ in range(150)], np.uint64) for b in rng.integers(0, 1 << 62, 6)]))
    i, j = np.nonzero(np.bitwise_count(fam[:, None] ^ fam[None, :]) <= 4)
    want = simhash._roots(len(fam), i, j)
    old, simhash.DIRECT = simhash.DIRECT, 64
    try:
        a, b = simhash.linked(fam, 0, 4)
    finally:
        simhash.DIRECT = old
    assert (simhash._roots(len(fam), a, b) == want).all()


def test_thresholds_cover():
    both = np.full((64, 64), 250.0) + np.eye(64) * 250
    for n in (1000, 10**6, 10**9):
        made = simhash.plan(n, both / 1000 * n)
        spent = sum(w.bit_count() - m[0].bit_count() + 1 for w, m in made)
        assert spent == simhash.TAU + 1


def _pii(t):
    def luhn(d):
        return sum(v if not i % 2 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    only = lambda v: re.sub("[^0-9]", "", v)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) < 256 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(only(v)) <= 19 and luhn(only(v))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(only(v)) <= 15),
    ]
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])] for k, p, ok in rules]


def test_pii(spark, docs, none):
    for r in pii.report(docs).collect():
        want = _pii(texts()[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in want]
        assert r.base_sha256 == hashlib.sha256(",".join(sum(want, [])).encode()).hexdigest()
    assert pii.report(none).count() == 0
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[13].text == "mail <EMAIL><EMAIL>, <PHONE>, 10.0.0.256 <IP> card <CARD>" and clean[13]._t == "x"
    assert all(clean[i].text == t for i, t in enumerate(TEXTS) if i != 13)


def test_pii_terms(spark):
    rows = [(i, f"by Zebulon Quill, mail zq@acme.org item {i}") for i in range(5)] + [(10 + i, f"other text number {i} about nothing") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:3:10" in got[0] and got[0].startswith("email:23:34") and got[10] == ""


@pytest.mark.parametrize(("order", "hot"), [(2, 2), (3, 2), (3, 0.001)])
def test_lm(spark, docs, order, hot):
    extra = spark.createDataFrame([(3, "one"), (3, "another text"), (None, "a a b a"), (None, "a a b a"), (None, None), (20, "one"), (21, "a b a b two"), (21, "a b a b two"), (21, "a b a b two")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra)
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in table.collect()]
    grams = lambda w: [tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
    count, total = Counter(g for _, w in rows for g in grams(w)), sum(len(w) for _, w in rows)
    want = []
    for i, w in rows:
        own, s = Counter(grams(w)), 0.0
        rest = lambda g: count[g] - own[g]  # noqa: E731, B023
        for k in range(len(w)):
            x = max(rest((w[k],)), 1) / max(total - len(w), 1)
            for n in range(2, min(order, k + 1) + 1):
                g = tuple(w[k - n + 1 : k + 1])
                x = rest(g) / rest(g[:-1]) if rest(g) > 0 else lm.ALPHA * x
            s += math.log(x)
        want.append((i if i is not None else -1, len(w), round(s, 5)))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_tokens, round(r.log_score, 5)) for r in lm.score(table, order, hot=hot).collect()]
    for a, b in zip(sorted(want), sorted(got), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-8, abs_tol=2e-5)
    assert lm.score(table.limit(0)).count() == 0


def test_ogg(docs, none):
    media = ogg.stored(docs)
    for r in ogg.read_media(media).collect():
        t = texts()[r.doc_id].encode()
        p = t + b" " * (max(192, -(-len(t) // 192) * 192) - len(t))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), None)
    assert ogg.read_media(ogg.stored(none)).count() == 0
    pages = [r for r in ogg.page_table(media).collect() if r.serial == ogg.AUDIO and r.doc_id == 9]
    pages.sort(key=lambda r: r.page)
    size = -(-len(LONG) // 192) * 192
    # A page ends where its last whole packet does: packets of 1,920 bytes, eight lacing values each, 255 a page.
    done = [0] + [min(size, 1920 * (255 * k // 8)) for k in range(1, len(pages))]
    assert [(r.start_seconds, r.end_seconds) for r in pages] == [(a / 8000, b / 8000) for a, b in zip([0, *done[:-1]], done, strict=True)]


def test_ogg_bad_rows(spark):
    good = ogg.mux(b"x" * 192, 1)
    other = ogg.mux(b"x" * 192, 1).replace(b"EVPCM8", b"OTHERS")
    rows = [(1, good), (2, None), (3, good[:-3]), (4, b""), (5, b"OggS"), (6, other), (None, good)]
    got = {r.doc_id: r for r in ogg.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].error is None and got[None].error is None and got[1].n_bytes == 1
    assert all(got[i].error and got[i].feature is None for i in (2, 3, 4, 5, 6))


def test_ogg_damage_and_checksum():
    crc = 0
    for byte in b"OggS check":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    assert ogg.page_checksum(b"OggS check") == crc
    media = ogg.mux(bytes(range(192)) * 2000, 5)
    assert len(ogg.demux(media)) == 2 and ogg.demux(media)[ogg.AUDIO].seconds() == 192 * 2000 / ogg.RATE
    for bad in (media[:-1], media[:5000] + b"!" + media[5001:], media + media[:100]):
        with pytest.raises(ogg.OggError):
            ogg.demux(bad)


def test_tokens(docs, none, spark, tmp_path):
    enc = WordEncoder(shared.tokenizer_path())
    ids = {i: [*enc.whole.encode(t, add_special_tokens=False).ids, 1] for i, t in texts().items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    folder = f"file://{tmp_path}/tokens"
    tokenfile.write_token_files(docs, folder, shared.tokenizer_path())
    start = 0
    for r in sorted(tokenfile.read_token_files(spark, folder).collect()):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        start += r.n_tokens
    tokenfile.write_token_files(none, f"{folder}-none", shared.tokenizer_path())
    assert tokenfile.read_token_files(spark, f"{folder}-none").count() == 0

    pieces = packing.pack(docs, shared.tokenizer_path()).collect()
    fill, own = Counter(), Counter()
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == own[r.doc_id] and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        own[r.doc_id] += r.length
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert own == Counter({i: len(x) for i, x in ids.items()}) and max(fill.values()) <= 2048
    assert packing.pack(none, shared.tokenizer_path()).count() == 0


def test_packing_limits():
    limits = packing.Limits(tokens=100, segments=3, loss_tokens=40, waiting=16)
    packer, rng, out = packing.Packer(limits), np.random.default_rng(0), []
    sizes = rng.integers(1, 260, 300)
    for i, n in enumerate(sizes):
        out += packer.add(packing.Piece(i, 0, np.arange(n), int(n), int(n * 0.6)))
    out += packer.finish()
    for seq in out:
        assert seq and sum(len(p.ids) for p in seq) <= 100 and len(seq) <= 3 and sum(p.loss() for p in seq) <= 40
    got = Counter()
    for seq in out:
        for p in seq:
            got[p.doc] += len(p.ids)
    assert got == Counter({i: int(n) for i, n in enumerate(sizes)})


def test_substring(docs, none):
    seen = set()
    got = {r.doc_id: r for r in substring.report(docs).collect()}
    for i, t in sorted(texts().items()):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert substring.report(none).count() == 0
    f = {(r.doc_id, r.start, r.n_words, r.source, r.at) for r in substring.factor_table(docs.where("doc_id in (5, 6, 8)")).collect()}
    assert {(6, 0, 60, 5, 0), (8, 1, 60, 5, 0)} == f


@pytest.mark.parametrize("limit", [decontam.MAX_GRAMS, 3])
def test_decontam(spark, docs, none, limit):
    items = [(1, " ".join(f"q{i}" for i in range(12))), (2, "two words"), (3, None), (10, " ".join(f"q{i}" for i in range(10))), (4, "never seen here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r.doc_id: r for r in decontam.report(docs, bench, limit).collect()}
    for i, t in texts().items():
        w, hit, found = split(t), set(), set()
        for k, x in items:
            y = split(x)
            n = min(10, len(y))
            for a in range(len(y) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == y[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(k))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontam.report(none, bench, limit).count() == 0 and decontam.report(docs, bench.limit(0), limit).where("contaminated").count() == 0
    kept = decontam.remove(docs, bench, max_grams=limit)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}


def test_html(spark):
    main = "<article><h1>T &amp; U</h1><p><b>a<br><p>b <i>c</i>d<nav>no</nav><section class='comments'><p>no</section></article>"
    page = f"<html><head><title>no</title></head><body><header>no</header><script>var t='</p>';</script><nav><li>no</nav><div class='ad box'>no</div>{main}<aside>no</aside><footer>no</body>"
    plain = [(100 + i, "http://h.example/x", f"<body><div class=top>same words on every page</div><div class=body><p>own text {i} {'z' * i}</p><p>more {i * 7}</p></div></body>") for i in range(12)]
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "x", ""), (4, "http://a.example/2", "just text <b>here"), *plain]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html_tree.BROADCAST_NODES, 0):
        got = {r.page_id: r for r in html_tree.extract(df, broadcast_nodes=limit).collect()}
        assert got[1].text == "T & U a b cd" and got[2].text == "" and got[3].n_chars == 0 and got[4].text == "just text here"
        assert got[103].text == "own text 3 zzz more 21" and got[103].n_chars == 22
    assert html_tree.extract(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, labels = [(9000, None), (9001, "")], []
    for i in range(900):
        toxic = i % 8 == 0
        w = list(rng.choice(vocabulary, 30)) + ([str(rng.choice(["idiot", "scum", "moron"]))] if toxic else [])
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.report(d, lab).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    hits = [got[i].predicted for i in range(0, 900, 8)]
    wrong = [got[i].predicted for i in range(900) if i % 8]
    assert np.mean(hits) > 0.9 and np.mean(wrong) < 0.02
    assert toxicity.report(d, lab.limit(0)).where("score > 0").count() == 0 and toxicity.report(d.limit(0), lab).count() == 0


def _without_repeats(rows):
    """(id, text) rows, in the operator's order, to (id, words, removed, kept words)."""
    seen, out = set(), []
    for i, t in rows:
        w = words(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        out.append((i, len(w), sum(gone), b" ".join(a for a, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_substring_shared_ids(spark):
    t, u = BASE, " ".join(f"other{i}" for i in range(50))
    for rows in ([(1, t), (1, t), (2, u)], [(1, t), (1, t + " tail"), (2, u + " " + t)], [(7, t), (7, u), (7, t + u), (7, u + " " + t), (None, t), (None, None)]):
        got = sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()))
        h = {x: r.h for x in {x for _, x in rows} for r in spark.createDataFrame([(x,)], "text string").selectExpr("xxhash64(text) AS h").collect()}
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
        assert got == sorted((i or 0, *rest) for i, *rest in _without_repeats(ordered))


def test_substring_families(spark):
    """Random documents made of shared passages, near copies and repeats within a text, against brute force."""
    rng = np.random.default_rng(5)
    passages = [[f"p{k}w{i}" for i in range(int(rng.integers(5, 70)))] for k in range(25)]
    rows = []
    for d in range(250):
        w = []
        for _ in range(int(rng.integers(0, 5))):
            part = passages[int(rng.integers(25))]
            a, b = sorted(rng.integers(0, len(part) + 1, 2).tolist())
            w += part if rng.random() < 0.5 else part[a:b]
            w += [f"own{d}x{int(x)}" for x in rng.integers(0, 9, int(rng.integers(0, 12)))]
        rows.append((d, " ".join(w)))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), with_text=True).collect())
    assert got == _without_repeats(rows) and sum(r[2] for r in got) > 1000


def test_parse_takes_the_longest_source():
    # Block 0-4 stands in documents 1 and 2; block 5-9 goes on in 2 alone.
    pieces = [(0, 5, ((1, 100), (2, 50))), (5, 5, ((3, 7), (2, 55))), (10, 2, ((4, 0),))]
    assert substring.parse(pieces) == [(0, 10 + 19, 2, 50), (10, 2 + 19, 4, 0)]
