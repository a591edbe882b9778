"""Helpers every operator of this subpackage uses: shared storage, shipping the package, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 2000
ARROW_BYTES = 1 << 20
ROWS_A_FILE = 200_000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, so that workers can import its functions.

    The archive is made on the driver and handed to Spark, which distributes it;
    executors never open the driver's path.  Arrow batches are kept to ``ARROW_ROWS`` rows unless the
    session says otherwise: whole texts are some kilobytes each, and a batch stands in the JVM and in Python.
    """
    sc = spark.sparkContext
    if spark.conf.get(_ARROW) == "10000":  # Spark's own default
        spark.conf.set(_ARROW, str(ARROW_ROWS))
    if getattr(sc, "_evidra_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="evidra-")) / "evidra_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._evidra_shipped = True


def lean(spark: SparkSession) -> None:
    """Ship the package and, unless the session says otherwise, end Arrow batches at ``ARROW_BYTES`` too, for jobs whose executors have run much before."""
    ship(spark)
    if spark.conf.get(_BYTES, None) in (None, "64MB", "67108864b"):  # Spark's own default
        spark.conf.set(_BYTES, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder if Spark runs in this process; a cluster must set it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_evidra_checkpoints", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = sc._evidra_checkpoints = f"file://{tempfile.mkdtemp(prefix='evidra-shared-')}"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/evidra-{name}-{uuid.uuid4().hex}"


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """A table of about so many short rows in a partition for each ``ROWS_A_FILE``, and no fewer than there are cores.

    A shuffle would leave one for each of its partitions; each is a file, and on local folders a JVM starts processes for every file it makes.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))


def materialise(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    ``rows``: about how many short rows it has, which :func:`fewer` makes files of.
    """
    spark = df.sparkSession
    if rows is not None:
        df = fewer(df, rows)
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evidra_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`materialise` once nothing reads it any more."""
    path = getattr(df, "_evidra_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """Into how many partitions a shuffle deals."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def neutral(docs: DataFrame) -> DataFrame:
    """``docs`` with every column but doc_id, text and n_chars under a name no operator uses; ``toDF(*names)`` restores them."""
    return docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"_x{i}" for i, c in enumerate(docs.columns)))


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as a list of UTF-8 bytes; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a function of one Arrow batch to what ``mapInArrow`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return run


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, column: str | None = None, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches, so that Python objects of only so many rows, and bytes of ``column``, live at once."""
    for batch in batches:
        ends = None
        if column in batch.schema.names:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            n = rows
            if ends is not None:  # a text beyond the size is a batch of its own
                before = ends[start - 1] if start else 0
                n = min(rows, max(1, int(np.searchsorted(ends, before + size, side="right")) - start))
            yield batch.slice(start, n)
            start += n
    give_back()


def give_back() -> None:
    """Return memory that a finished task no longer uses, so that an idle worker stays small beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a libc without it
        ctypes.CDLL(None).malloc_trim(0)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def task_partition() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def local_path(uri: str) -> str | None:
    """The plain path of a ``file:`` URI or a bare path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_out(uri: str):
    """A writable binary file at a URI of any file system that Arrow reaches; local folders are made."""
    from pyarrow import fs

    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path)


def rename(uri: str, to: str) -> None:
    from pyarrow import fs

    if (path := local_path(uri)) is not None:
        os.replace(path, local_path(to))
        return
    system, path = fs.FileSystem.from_uri(uri)
    system.move(path, fs.FileSystem.from_uri(to)[1])
