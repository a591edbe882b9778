"""What the pipeline's stages hold in a worker beside a JVM that earlier stages have filled."""

import pyarrow as pa

import corpus_pipeline
from evidra.llm import packing, shared


def test_texts_travel_in_short_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes], "rows": [b.num_rows]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('some words of a text ', 1000) AS text")
        corpus_pipeline.packing_stage(spark, docs, "")
        got = docs.mapInArrow(sizes, "bytes long, rows long").collect()
        assert sum(r.rows for r in got) == 300 and max(r.bytes for r in got) < 2_000_000
        spark.conf.set(key, "5000000")  # the session's own
        shared.lean(spark)
        assert spark.conf.get(key).startswith("5000000")
    finally:
        spark.conf.unset(key)


def test_pieces_do_not_depend_on_what_is_held(monkeypatch):
    given = []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(1))
    words = [f"w{k}" for k in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": [" ".join(words[k * 40 : k * 40 + 20 * (k + 1)]) for k in range(60)]})

    def pieces(**held):
        run = packing._pack(shared.tokenizer_path(), packing.Limits(), 0.25, False, packing.Held(**held))
        return [r for b in run(iter([batch])) for r in b.to_pylist()]

    whole, plain = pieces(), len(given)
    given.clear()
    assert pieces(text_bytes=20_000, words=500, trim=True) == whole
    assert len(given) > plain  # after every batch, not at the end alone
