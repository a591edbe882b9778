"""What the language model sends between stages stays small beside its texts."""

import random

from evidra.llm import lm


def written(spark):
    jvm = spark._jvm
    empty = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(empty, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), empty)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_bytes_per_token(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    docs = [(i, " ".join(words[int(r.paretovariate(0.5)) % 3000] for _ in range(2000))) for i in range(100)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    before = written(spark)
    assert lm.score(table).agg({"n_tokens": "sum"}).first()[0] == 200_000
    assert written(spark) - before < 14 * 200_000  # three 64-bit hashes a token took over 30 each


def test_texts_beyond_a_batch_and_a_piece(spark, monkeypatch):
    """The same scores, however the occurrences are put into rows, with words that have no code."""
    r = random.Random(5)
    docs = [(i, " ".join(r.choices("a b c d e f g h".split(), weights=[40, 9, 8, 7, 6, 5, 4, 3], k=r.choice([0, 1, 2, 900])))) for i in range(40)]
    table = spark.createDataFrame(docs + docs[:5], "doc_id long, text string")
    score = lambda: sorted((x.doc_id, x.n_tokens, round(x.log_score, 6)) for x in lm.score(table).collect())
    want = score()
    for name, value in (("BATCH", 1000), ("PIECE", 7), ("CODES", 3), ("CHUNK", 50)):
        monkeypatch.setattr(lm, name, value)
    assert score() == want
