"""Disclosive terms against brute force, and very long texts."""

import math
import random
import re
import time

from evidra.llm import pii

TERM = re.compile(r"[^\W_]+")


def _entities(t):
    return {m[0].lower() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)}


def _revealed(texts):
    """text -> {term: ratio} by the definition."""
    texts = set(texts)
    n = len(texts)
    terms = {t: set(TERM.findall(t.lower())) for t in texts}
    held = {t: _entities(t) for t in texts}
    out = {t: {} for t in texts}
    for e in set().union(*held.values()):
        of = [t for t in texts if e in held[t]]
        for term in set().union(*(terms[t] for t in of)):
            both = sum(term in terms[t] for t in of)
            c_t = sum(term in terms[t] for t in texts)
            if both < 3 or len(of) == n:
                continue
            ratio = math.log2(n * both / (c_t * len(of))) / math.log2(n / len(of))
            expected = c_t * len(of) / n
            if ratio >= 0.5 and both - expected >= 5 * math.sqrt(expected * (1 - len(of) / n)):
                for t in of:
                    if term in terms[t]:
                        out[t][term] = max(ratio, out[t].get(term, 0))
    return out


def test_terms(spark):
    rng = random.Random(2)
    people = [(f"Name{k}", f"{700 + k}", f"u{k}@x.org", f"ö{k}") for k in range(6)]
    rows = [(0, None), (1, ""), (2, "help@x.org alone")]
    for i in range(3, 400):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(2, 20))]
        if rng.random() < 0.2:
            p = rng.choice(people)
            w += [p[2]] + [x for x in (p[0], p[1], p[3]) if rng.random() < 0.8]
        if rng.random() < 0.33:
            w.append("help@x.org")
        if rng.random() < 0.1:
            w.append(rng.choice(people)[0])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
    rows += rows[3:10] + [(3, rows[50][1])]
    want = _revealed([t or "" for _, t in rows])
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, terms string, n int, _h string")
    shown = []
    for i, t in rows:
        t = t or ""
        spans = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        shown.append((i, ",".join(spans + [f"term:{m.start()}:{m.end()}" for m in TERM.finditer(t) if m[0].lower() in want[t]])))
    assert sum("term" in s for _, s in shown) > 30
    assert sorted((r.doc_id, r.spans) for r in pii.report(df).collect()) == sorted(shown)

    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    expected = []
    for i, t in rows:
        found = [(m.start(), m.end(), 0, "<EMAIL>") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "")]
        for m in TERM.finditer(t or ""):
            if (r := want[t or ""].get(m[0].lower())) is not None:
                number = any(c.isnumeric() for c in m[0])
                found.append((m.start(), m.end(), 1, "" if r >= 0.9 else "<NUMBER>" if number else "<NAME>" if m[0][0].isupper() else "<WORD>"))
        joined = []
        for start, end, kind, label in sorted(found):  # what lies within an address goes with it
            if joined and start < joined[-1][1]:
                last = joined[-1]
                joined[-1] = (last[0], max(last[1], end), *min(last[2:], (kind, label)))
            else:
                joined.append((start, end, kind, label))
        out, at = "", 0
        for start, end, _, label in joined:
            out += (t or "")[at:start] + label
            at = end
        out += (t or "")[at:]
        expected.append((i, out if found else t))
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted(expected, key=key)
    assert pii.sanitise(df.limit(0)).count() == 0


def test_long_texts(spark):
    many = " ".join(f"a{i}@b.org" for i in range(30_000))
    digits = "1.2.3 " + "7" * 1_000_000
    rows = [(1, many), (2, digits), (3, "+1" + "(" * 500_000 + "1 " + "4 " * 200_000), (4, "é " * 500_000 + "x@y.de")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert got[1].n_email == 30_000 and got[2].spans == "" and got[4].spans == "email:1000000:1000006"
    assert got[1].spans.endswith(f"email:{len(many) - 12}:{len(many)}")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[1] == " ".join(["<EMAIL>"] * 30_000) and clean[2] == digits and clean[4].endswith("é <EMAIL>")
    assert time.monotonic() - began < 90
