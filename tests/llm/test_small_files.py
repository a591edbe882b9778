"""Small tables between steps get few files, however many partitions a shuffle has."""

import os

from evidra.llm import graph, shared, simhash


def test_few_files_of_many_partitions(spark, monkeypatch):
    made, real = [], shared.materialise

    def seen(df, name, *args, **kwargs):
        out = real(df, name, *args, **kwargs)
        made.append((name, sum(x.startswith("part-") for x in os.listdir(out._evidra_path.removeprefix("file://")))))
        return out

    for module in (shared, graph):
        monkeypatch.setattr(module, "materialise", seen)
    put = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        texts = [" ".join(f"w{(i + k) % 90}" for k in range(60)) for i in range(200)]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
        rows = {r.doc_id: r for r in simhash.report(docs).collect()}
        path = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
        assert {(r.node, r.root) for r in graph.components(path, nodes=301).collect()} == {(i, 0) for i in range(1, 301)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    fps = [simhash.fingerprint(t.encode()) for t in texts * 2]
    assert all(rows[i].fingerprint == f"{fps[i]:016x}" for i in rows) and len(rows) == 400
    root = list(range(400))  # components by all pairs
    changed = True
    while changed:
        changed = False
        for i in range(400):
            least = min(root[j] for j in range(400) if (fps[i] ^ fps[j]).bit_count() <= simhash.TAU)
            if least < root[i]:
                root[i], changed = least, True
    assert [rows[i].component_id for i in range(400)] == root
    written = {name for name, _ in made}
    assert {"nodes", "edges"} <= written and all(files <= spark.sparkContext.defaultParallelism for name, files in made if name in ("nodes", "edges"))


def test_rows_for_many_files(spark):
    """Many rows keep their partitions."""
    wide = spark.range(0, 1200, 1, 12)
    few = shared.materialise(wide, "few", rows=1200)
    many = shared.materialise(wide, "many", rows=shared.ROWS_A_FILE * 12)
    count = lambda df: sum(x.startswith("part-") for x in os.listdir(df._evidra_path.removeprefix("file://")))
    assert (count(few), count(many)) == (max(4, spark.sparkContext.defaultParallelism), 12) and few.count() == many.count() == 1200
