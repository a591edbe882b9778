"""A table dealt into the files of a stream is read a fixed number of times, however many files there are."""

from pyspark.sql import functions as F

from evidra.streaming import incremental


def test_reads_do_not_grow_with_the_parts(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    def rows_read(parts):
        before = reads.value
        stream = incremental.in_parts(spark.range(600).mapInArrow(seen, "id long"), "parts", parts, "id")
        got = incremental.run_to_end(stream, "append", "parts")
        assert (got.count(), got.agg(F.sum("id")).first()[0], stream.columns) == (600, 179_700, ["id"])
        return reads.value - before

    assert rows_read(12) == rows_read(3)


def test_an_empty_table_is_an_empty_stream(spark):
    assert incremental.run_to_end(incremental.in_parts(spark.range(0), "none", 2, "id"), "append", "none").count() == 0
