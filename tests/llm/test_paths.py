"""Paths that the registered queries take rarely or not at all, and the whole pipeline against its parts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from evidra.llm import decontam, packing, shared, simhash, tokens, toxicity
from test_near_copies import _least
from test_operators import TEXTS


def test_risk_by_definition():
    rng = np.random.default_rng(1)
    z, p = rng.normal(0, 2, 40), (rng.random(40) < 0.4).astype(float)
    for prior, u in ((0.2, (rng.random(40) < 0.7).astype(float)), (0.9, (z < 0).astype(float))):
        loss = lambda x, y: float(np.log(1 + np.exp(-y * x)))
        mean = lambda who, y, z=z: sum(loss(x, y) for x, w in zip(z, who, strict=True) if w) / sum(who)  # noqa: E731, B008
        rest = mean(u, -1) - prior * mean(p, -1)
        total, slope = toxicity.risk(z, p, u, prior)
        assert np.isclose(total, prior * mean(p, 1) + max(0.0, rest))
        for i in range(40):  # of what is followed: the risk, or the rest upwards
            low, high = z.copy(), z.copy()
            low[i], high[i] = z[i] - 1e-5, z[i] + 1e-5
            if rest >= 0:
                want = (toxicity.risk(high, p, u, prior)[0] - toxicity.risk(low, p, u, prior)[0]) / 2e-5
            else:
                value = lambda x: mean(u, -1, x) - prior * mean(p, -1, x)  # noqa: E731, B023
                want = -(value(high) - value(low)) / 2e-5
            assert np.isclose(slope[i], want, atol=1e-6)
    assert rest < 0  # the second case is the clipped one


def test_fit_lowers_the_risk():
    rng = np.random.default_rng(2)
    x = rng.random((400, 6)) < 0.3
    p = np.zeros(400)
    p[:80] = 1
    x[:80, 0] = True
    u = 1 - p
    u[rng.random(400) < 0.05] = 1
    w, b = toxicity.fit([np.flatnonzero(r).tolist() for r in x], p, u, 6, 0.15)
    start = toxicity.risk(np.full(400, np.log(0.15 / 0.85)), p, u, 0.15)[0]
    assert toxicity.risk(x @ w + b, p, u, 0.15)[0] < start and np.argmax(w) == 0


@pytest.mark.parametrize("bucket", [simhash.MAX_BUCKET, 40])
def test_simhash_finds_all_links(spark, bucket):
    """Thousands of fingerprints, random and planted 1 to 6 bits from one another, against all pairs."""
    shared.ship(spark)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 2500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2500, dtype=np.uint64)
    base[:800] &= np.uint64(0xFFFF00FFFFFFFFFF)  # bits that go together
    flip = lambda x: np.uint64(x) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    fps = np.unique(np.concatenate([base, [flip(x) for x in rng.choice(base, 1500)], [flip(base[0]) for _ in range(300)]]).astype(np.uint64))
    at, to = [], []
    for i in range(0, len(fps), 500):
        a, b = np.nonzero(np.bitwise_count(fps[i : i + 500, None] ^ fps[None, :]) <= 4)
        at.append(a + i)
        to.append(b)
    want = simhash._roots(len(fps), np.concatenate(at), np.concatenate(to))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    got = simhash.all_links(df, max_bucket=bucket).collect()
    index = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    a, b = (np.array([index[r[c]] for r in got]) for c in ("u", "v"))
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 64).all()
    assert (simhash._roots(len(fps), a, b) == want).all() and len(set(want)) < len(fps) - 500


def test_tokens_in_short_steps(monkeypatch):
    monkeypatch.setattr(tokens, "STEP", 7)
    enc = tokens.WordEncoder(shared.tokenizer_path())
    odd = [t or "" for t in TEXTS] + ["don't we'll ''t 3.14 x86-64 ÀÉß ŉ İstanbul straße ﬁ Ω ǅ 中文 éa", "\x00 a\x1fb", "a b   c", "<|startoftext|> x <|endoftext|>"]
    for t, ids in zip(odd, enc.ids([t.encode() for t in odd]), strict=True):
        assert ids.tolist() == [*enc.whole.encode(t, add_special_tokens=False).ids, 1]


def test_packing_with_prompts(spark):
    shared.ship(spark)
    enc = tokens.WordEncoder(shared.tokenizer_path())
    rows = [(i, "ask " * (i % 90) + f"answer {i} " * (3 * i % 400), "ask " * (i % 90)) for i in range(150)] + [(150, None, None), (151, "x " * 9000, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, asked string").repartition(2)
    limits = packing.Limits(tokens=512, segments=6, loss_tokens=400, waiting=64)
    got = packing.pack(docs, shared.tokenizer_path(), limits, prompt="asked", with_ids=True).collect()
    ids = {i: [*enc.whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    head = {i: len(enc.whole.encode(a or "", add_special_tokens=False).ids) for i, _, a in rows}
    fill, loss, parts, own = Counter(), Counter(), Counter(), {i: [] for i in ids}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert piece == ids[r.doc_id][r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(r.ids)
        own[r.doc_id] += piece
        fill[r.sequence_id] += r.length
        parts[r.sequence_id] += 1
        loss[r.sequence_id] += max(0, r.start + r.length - max(r.start, head[r.doc_id]))
    assert own == ids and max(fill.values()) <= 512 and max(parts.values()) <= 6 and max(loss.values()) <= 400


def test_decontam_cuts_words(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Before, {item}! After"), (2, "nothing HERE, kept"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontam.remove(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), whole=False).collect()}
    assert got == {1: "before after", 2: "nothing HERE, kept", 3: None}


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 900, n))
    item = " ".join(f"q{i}" for i in range(14))
    rows, labels = [(0, None, "s", 0), (1, "", "s", 0)], []
    for i in range(2, 500):
        words = say(int(rng.integers(20, 60)))
        if i % 6 == 0:
            words += " " + str(rng.choice(["idiot", "scum", "moron"]))
        if i % 25 == 1:
            words += f" {item} "
        if i % 9 == 0:
            words += f" write to me{i}@mail.org or +1 555 123 45{i % 90:02d}"
        rows.append((i, words, "s", len(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    copies = [(1000 + k, rows[k * 7 + 5][1], "t", 0) for k in range(30)] + [(2000 + k, rows[k * 11 + 4][1] + " more", "t", 0) for k in range(30)]
    rows += copies + [(500, rows[20][1], "u", 0), (500, "another text under one id", "u", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after, made = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = shared.materialise(stage(spark, made, str(tmp_path)), f"test-{name}")
        assert made.columns == docs.columns
        after[name] = [(r.doc_id, r.text, r.source) for r in made.collect()]
    key = lambda r: (r[0], r[1] or "", r[2])
    report = toxicity.report(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    bad = {r.doc_id for r in report if r.predicted}
    toxic = {i for i, t, _, _ in rows if re.search("idiot|scum|moron", t or "")}
    assert len(bad ^ toxic) <= 0.05 * len(toxic)
    clean = [r[:3] for r in rows if r[0] not in bad]
    assert sorted(after["toxicity"], key=key) == sorted(clean, key=key)
    numbered = sorted(clean, key=lambda r: r[0])
    one = _least([(k, r[1]) for k, r in enumerate(numbered)])
    groups = {k: numbered[k] for k in one}
    assert len(after["near_duplicates"]) == len(groups) and {r[0] for r in after["near_duplicates"]} >= {r[0] for r in groups.values() if r[0] != 500}
    assert sorted(after["decontamination"], key=key) == sorted([r for r in after["near_duplicates"] if item not in (r[1] or "")], key=key)
    before, clean = {r[0]: r[1] for r in after["decontamination"]}, {r[0]: r[1] for r in after["pii"]}
    assert before.keys() == clean.keys() and not any("@mail.org" in (t or "") or "+1 555" in (t or "") for t in clean.values())
    assert all(clean[i] == t for i, t in before.items() if "@mail.org" not in (t or ""))
    enc = tokens.WordEncoder(shared.tokenizer_path())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert sum(total.values()) == sum(len(enc.whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in after["pii"])
    digest = lambda rs: hashlib.sha256(repr(sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rs)).encode()).hexdigest()
    again = packing.pack(made, shared.tokenizer_path()).collect()
    ids = lambda rs: sorted((r.doc_id, r.doc_tokens) for r in rs if r.start == 0)
    assert ids(packed) == ids(again) and digest(packed)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    from evidra.llm import substring

    rng = np.random.default_rng(8)
    words = [f"w{v}é" for v in rng.integers(0, 1000, 500)]
    words[100] = "x" * 700
    text = " \t".join(words).encode() + b"\n"
    whole = substring.word_hashes(text)
    for part in (1, 7, 300, 5000):
        monkeypatch.setattr(substring, "PART", part)
        assert (substring.word_hashes(text) == whole).all() and len(whole) == 500
    assert (whole == np.concatenate([substring.word_hashes(w.encode()) for w in words])).all()
    assert len(substring.word_hashes(b" \n")) == len(substring.word_hashes(b"")) == 0


def test_large_benchmark_in_seconds(spark):
    """1,500 items of 60 words: the hash set is a broadcast side, not part of the plan's text."""
    import time

    from evidra.llm import decontam

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    items = [" ".join(words[j] for j in rng.integers(0, 3000, 60)) for _ in range(1500)]
    docs = [" ".join(words[j] for j in rng.integers(0, 3000, 400)) for _ in range(200)]
    docs[7] = docs[7] + " " + items[3][: len(items[3]) // 2]
    docs[9] = items[5].upper() + ", " + docs[9]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    began = time.time()
    got = decontam.report(d, b)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    hit = {r.doc_id: (r.n_items, r.n_hit) for r in got.where("contaminated").collect()}
    assert set(hit) == {7, 9} and hit[9] == (1, 60) and hit[7][0] == 1
    assert time.time() - began < 60
    assert {r.doc_id for r in decontam.remove(d, b).collect()} == set(range(200)) - {7, 9}
