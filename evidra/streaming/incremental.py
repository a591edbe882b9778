"""Structured Streaming forms of the incremental operators.

State lives in Spark's state store below a checkpoint folder; late rows beyond the
watermark are dropped by Spark and duplicates go to a side output instead of an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.plans.lineage import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, with the table's schema."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def series_prefix(points: DataFrame) -> DataFrame:
    """Observed prefix of each series (name, entity, t, v): size and widening window, for update or complete mode."""
    return points.groupBy("name", "entity").agg(F.count("*").alias("n_points"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("v").alias("peak"))


def windowed(points: DataFrame, width: str, late: str) -> DataFrame:
    """Tumbling windows of each series behind a watermark, for append mode."""
    return points.withWatermark("t", late).groupBy(F.window("t", width), "name", "entity").agg(F.count("*").alias("n_points"), F.avg("v").alias("v"))


def silences(points: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each series; a gap between sessions is a silence."""
    return points.withWatermark("t", late).groupBy(F.session_window("t", gap), "name", "entity").agg(F.count("*").alias("n_points"))


def split_duplicates(batch: DataFrame, seen: DataFrame | None, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(new rows, duplicate rows) of a micro-batch against the keys seen so far: the first of each key is new."""
    from pyspark.sql import Window

    ranked = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    fresh, again = ranked.where("_r = 1").drop("_r"), ranked.where("_r > 1").drop("_r")
    if seen is None:
        return fresh, again
    return fresh.join(seen.select(*key), key, "left_anti"), again.unionByName(fresh.join(seen.select(*key), key, "left_semi").select(*batch.columns))


def run_to_end(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All that is available now, through the stream, as a table: each batch's result is written below the shared folder.

    In complete mode the last batch stands; in append mode all do.  A batch that is repeated after a failure replaces itself.
    """
    spark = stream.sparkSession
    out = folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    if mode != "append":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.select(*stream.columns)


PART_ROWS = 1_000_000


def in_parts(df: DataFrame, name: str, parts: int, by: str) -> DataFrame:
    """A table as a stream of so many files, more where one would have over ``PART_ROWS`` rows, one a batch, that arrive in the order of ``by``.

    The table is dealt into its parts once; each file is then made from its own part, however many there are.
    """
    spark, out, dealt = df.sparkSession, folder(df.sparkSession, name), folder(df.sparkSession, f"{name}-dealt")
    parts = max(parts, -(-df.count() // PART_ROWS))
    cuts = df.approxQuantile(by, [k / parts for k in range(1, parts)], 0.01)
    part = sum((F.coalesce(F.col(by) > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    df.withColumn("_part", part).write.partitionBy("_part").parquet(dealt)
    there = {r[0] for r in spark.read.schema("_part int").parquet(dealt).select("_part").distinct().collect()}
    for k in range(parts):
        own = spark.read.schema(df.schema).parquet(f"{dealt}/_part={k}") if k in there else df.limit(0)
        own.coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(out)


def reject_duplicates(stream: DataFrame, key: list[str], order: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is new, rows whose key a row before has) of all that is available now, through the stream.

    Each batch is held against the keys that the batches before it wrote; a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    out = folder(spark, name)
    keys = stream.select(*key).schema

    def write(batch: DataFrame, number: int) -> None:
        seen = None
        if number:
            seen = spark.read.schema(keys).parquet(*(f"{out}/fresh/batch={k}" for k in range(number)))
        fresh, again = split_duplicates(batch, seen, key, order)
        fresh.write.mode("overwrite").parquet(f"{out}/fresh/batch={number}")
        again.write.mode("overwrite").parquet(f"{out}/again/batch={number}")

    q = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    read = lambda side: spark.read.schema(stream.schema).parquet(f"{out}/{side}/batch=*")
    return read("fresh"), read("again")
