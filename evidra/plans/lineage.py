"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where that is unset, a temporary folder if Spark runs in this process; a cluster must set it."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_evidra_shared", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._evidra_shared = f"file://{tempfile.mkdtemp(prefix='evidra-shared-')}"
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """What a statement shuffles is dropped at its end instead of when the driver's memory is next cleared."""
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, by columns and packed (a long table takes a fraction of :func:`cut`'s disk), its shuffles dropped."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/evidra-table-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)
