"""Keyed state over streams: counted ingest with expiry, and references that resolve as records arrive.

:func:`ingest_outcomes` keeps a small record per key in Spark's state store (``transformWithStateInPandas``) and says of every
record whether it was inserted, updated, a duplicate or in conflict; :func:`resolve_as_they_arrive` is a stream-stream
outer join in which a reference waits for its record until the watermark gives it up.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "kind string, key string, inserted long, updated long, duplicates long, conflicts long, expired long, n long, first_t timestamp, last_t timestamp"
_RAW = OUTCOME.replace("timestamp", "long")  # times travel as microseconds: pandas would read them in the session's zone
_STATE = "payload string, n long, first_t long, last_t long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """State in RocksDB, which keyed processors need, for the queries that start meanwhile."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of a batch put together by key and payload before they travel, so that a hot key sends a row for each payload and not for each record."""
    for b in batches:
        if len(b):
            g = b.groupby(["kind", "key", "payload", "grows"], dropna=False, sort=False)
            yield g.agg(seq=("seq", "min"), n=("seq", "size"), first_t=("us", "min"), last_t=("us", "max")).reset_index()[["kind", "key", "payload", "grows", "seq", "n", "first_t", "last_t"]]


class Outcomes(StatefulProcessor):
    """Of each key what it first held, how often and when it came; closed after ``idle`` seconds of event time without a record."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["seq", "payload"], kind="stable")  # a row for each payload and task, see _combined
        counts = dict.fromkeys(("inserted", "updated", "duplicates", "conflicts"), 0)
        held = self.seen.get() if self.seen.exists() else None
        if held and self.idle is not None and timerValues.getCurrentWatermarkInMs() >= self._end(held[3]):  # rows come before timers in a batch
            yield self._row(key, {}, 1, *held[1:])
            held = None
        payload, n, first, last = held if held else (None, 0, None, None)
        fresh = held is None
        for r in new.itertuples(index=False):
            times, own = int(r.n), None if pd.isna(r.payload) else r.payload
            if fresh:
                payload, fresh, times = own, False, times - 1
                counts["inserted"] += 1
                n, first, last = 1, int(r.first_t), int(r.last_t)
            counts["conflicts" if own != payload else "updated" if r.grows else "duplicates"] += times
            if own == payload:
                first, last = min(first, int(r.first_t)), max(last, int(r.last_t))
                n += times if r.grows else 0
        self.seen.update((payload, n, first, last))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(self._end(last))
        yield self._row(key, counts, 0, n, first, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, n, first, last = self.seen.get()
        self.seen.clear()
        yield self._row(key, {}, 1, n, first, last)

    def _end(self, last: int) -> int:
        """When a key without further records is closed, in milliseconds."""
        return last // 1000 + 1000 * self.idle

    def close(self) -> None:
        return None

    @staticmethod
    def _row(key, counts: dict, expired: int, n: int, first, last) -> pd.DataFrame:
        c = [counts.get(k, 0) for k in ("inserted", "updated", "duplicates", "conflicts")]
        return pd.DataFrame([[key[0], key[1], *c, expired, n, first, last]], columns=[x.split()[0] for x in OUTCOME.split(", ")])


def ingest_outcomes(records: DataFrame, idle: int | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of outcome counts for a stream of records (kind, key, payload, grows, seq, t).

    The first record of a key is inserted.  A later one with the same payload is an update where the key's record ``grows``
    (an open series, whose window and count it widens) and else a duplicate; one with another payload is a conflict and changes
    nothing.  Within a micro-batch ``seq`` decides which is first.  A null key is a key like any other.  With ``idle``, a key
    without a record for so many seconds of event time (behind the watermark) is told as expired and forgotten.
    """
    r = records.withColumn("us", F.unix_micros(F.col("t").cast("timestamp"))).drop("t")
    made = r.mapInPandas(_combined, "kind string, key string, payload string, grows boolean, seq long, n long, first_t long, last_t long")
    if idle is not None:
        made = made.withColumn("at", F.timestamp_micros("last_t")).withWatermark("at", late)
    out = made.groupBy("kind", "key").transformWithStateInPandas(Outcomes(idle), _RAW, "Append", "EventTime" if idle is not None else "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first_t", "last_t")})


def resolve_as_they_arrive(references: DataFrame, records: DataFrame, wait: str, late: str) -> DataFrame:
    """(ref_id, key, ref_t, record_id, record_t) of streams of references (ref_id, key, ref_t) and records (key, record_id, record_t).

    A reference resolves to every record of its key that is at most ``wait`` older or younger, as soon as both are
    there.  One that has none is told with a null record once the watermark (``late`` behind both streams) says that none can come;
    references younger than that are still open and in no row.
    """
    a = references.withWatermark("ref_t", late)
    b = records.withColumnRenamed("key", "_key").withWatermark("record_t", late)
    near = F.expr(f"key = _key and record_t >= ref_t - interval {wait} and record_t <= ref_t + interval {wait}")
    return a.join(b, near, "left_outer").select("ref_id", "key", "ref_t", "record_id", "record_t")
