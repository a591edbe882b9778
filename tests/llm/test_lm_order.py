"""The registered language-model query uses more context than one word."""

import math
from collections import Counter

from evidra.llm import lm, queries


def test_query_scores_trigrams(spark, tmp_path):
    rows = [(1, "a b c a b c"), (2, "x b d a b c"), (3, "x b d x b d"), (4, None), (5, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = {i: [tuple(w[max(0, k - n + 1) : k + 1]) for k in range(len(w)) for n in (1, 2, 3) if k >= n - 1] for i, w in ((i, (t or "").split()) for i, t in rows)}
    count = Counter(g for x in grams.values() for g in x)
    total = sum(len((t or "").split()) for _, t in rows)
    got = {r.doc_id: r.log_score for r in queries.op4_lm(spark, str(tmp_path)).collect()}
    for i, t in rows:
        w, own, want = (t or "").split(), Counter(grams[i]), 0.0
        rest = lambda g: count[g] - own[g]  # noqa: E731, B023
        for k in range(len(w)):
            s = max(rest((w[k],)), 1) / max(total - len(w), 1)
            for n in (2, 3):
                if k >= n - 1:
                    g = tuple(w[k - n + 1 : k + 1])
                    s = rest(g) / rest(g[:-1]) if rest(g) > 0 and rest(g[:-1]) > 0 else lm.ALPHA * s
            want += math.log(s)
        assert math.isclose(got[i], want, abs_tol=1e-4)
