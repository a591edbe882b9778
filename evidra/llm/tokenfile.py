"""Token-id files: flat unsigned integers, 64-bit document offsets, bases from prefix sums.

Layout below one folder, for shard k:

* ``tokens-k.bin``  ids of the shard's documents in a row, little-endian, as narrow as the vocabulary allows
* ``index-k.bin``   64-bit integers: n, then n document ids, then n + 1 offsets into the shard
* ``manifest``      a Parquet table: shard, n_docs, n_tokens, base, item_size

Documents ascend by id through the shards; ``base`` is the sum of all earlier shards.
Null texts count as empty (one end id), a null id sorts first and is kept as a flag;
equal ids keep a fixed order by text.  Very long texts are encoded alone.  An empty table gives no shards.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import shared
from evidra.llm.tokens import crcs, encoder

NO_ID = -(1 << 63)


def _write_shard(folder: str, vocab: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        shard, attempt = shared.task_partition(), uuid.uuid4().hex
        doc_ids, lengths, out, size = [], [], None, 0
        target = f"{folder}/tokens-{shard:06d}.bin"
        for batch in shared.small_batches(batches, 4096, "text"):
            enc = encoder(vocab)
            if out is None:
                out, size = shared.open_out(f"{target}.{attempt}"), enc.dtype.itemsize
            ids, at = enc.flat(batch.column("text"))
            out.write(ids.tobytes())
            lengths.append(np.diff(at))
            doc_ids += [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()]
        if out is None:
            return
        out.close()
        encoder(vocab).forget()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        index = f"{folder}/index-{shard:06d}.bin"
        with shared.open_out(f"{index}.{attempt}") as f:
            f.write(np.array([len(doc_ids), *doc_ids], "<i8").tobytes() + offsets.tobytes())
        shared.rename(f"{target}.{attempt}", target)  # a repeated task replaces whole files only
        shared.rename(f"{index}.{attempt}", index)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([int(offsets[-1])], pa.int64()), "item_size": pa.array([size], pa.int32())})

    return run


def write_token_files(docs: DataFrame, folder: str, vocab: str, partitions: int | None = None) -> DataFrame:
    """Write the token files of ``docs`` (doc_id, text) and return the manifest.

    One shuffle, by ranges of doc_id.  Only one row per shard reaches the driver, for the prefix sums.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = (
        text.repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_write_shard(folder, vocab), "shard long, n_docs long, n_tokens long, item_size int")
        .collect()
    )
    made, base = [], 0
    for r in sorted(rows):
        made.append((r.shard, r.n_docs, r.n_tokens, base, r.item_size))
        base += r.n_tokens
    manifest = spark.createDataFrame(made, "shard long, n_docs long, n_tokens long, base long, item_size int")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class _File:
    """Integers of a file by range: memory-mapped on a local path, ranged reads on any other file system."""

    def __init__(self, uri: str, dtype: str):
        self.dtype, self.mapped, self.file = np.dtype(dtype), None, None
        if (path := shared.local_path(uri)) is not None:
            self.mapped = np.memmap(path, dtype=dtype, mode="r")
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(uri)
            self.file = system.open_input_file(path)

    def __call__(self, start: int, end: int) -> np.ndarray:
        if self.mapped is not None:
            return np.asarray(self.mapped[start:end])
        size = self.dtype.itemsize
        self.file.seek(start * size)
        return np.frombuffer(self.file.read((end - start) * size), self.dtype)


def _read_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                index = _File(f"{folder}/index-{r['shard']:06d}.bin", "<i8")
                tokens = _File(f"{folder}/tokens-{r['shard']:06d}.bin", f"<u{r['item_size']}")
                n = int(index(0, 1)[0])
                for at in range(0, n, 4096):
                    to = min(n, at + 4096)
                    some, offsets = index(1 + at, 1 + to), index(1 + n + at, 2 + n + to)
                    crc = []
                    for i in range(to - at):  # a document at a time: bounded by its length
                        crc += crcs(tokens(int(offsets[i]), int(offsets[i + 1])), [0, int(offsets[i + 1] - offsets[i])])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(some, pa.int64(), mask=some == NO_ID),
                            "start": pa.array(offsets[:-1] + r["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(_read_shards(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
