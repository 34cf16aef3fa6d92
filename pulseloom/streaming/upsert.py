"""Extension: bars kept up to date by a stream, newest observation first, and sessions of posts.

State is per bar and ends with it: a timer at the end of the bar's hour fires when the watermark, which trails the latest time by the overlap, has
passed it. Rows older than the watermark leave the state alone and are counted. The stateful operator needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``), which ``run_stream`` sets for its query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_HOUR_MS = 3_600_000

_CHANGE = "instrument_id string, hour_ms long, observed_at long, seq long, price double, replaced long, late long, closed boolean"


class NewestWins(StatefulProcessor):
    """The newest observation of each (instrument, hour); at a tie the earlier row. Every change is sent on, and the last state once more when the hour is closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "observed_at long, seq long, price double, replaced long")

    @staticmethod
    def _row(key: tuple, best: tuple | None, late: int, closed: bool) -> pd.DataFrame:
        values = [*key, *(best or (None,) * 4), late, closed]
        return pd.DataFrame({c.split()[0]: pd.Series([v], dtype="object") for c, v in zip(_CHANGE.split(", "), values, strict=True)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.best.get()) if self.best.exists() else None
        best, late, mark = known, 0, timerValues.getCurrentWatermarkInMs()
        for part in rows:
            part = part.sort_values("seq", kind="stable")
            for at, observed, seq, price in zip(part["at_ms"], part["observed_at"], part["seq"], part["price"], strict=True):
                if at < mark:
                    late += 1
                elif best is None:
                    best = (int(observed), int(seq), float(price), 0)
                elif observed > best[0]:
                    best = (int(observed), int(seq), float(price), best[3] + 1)
        if best != known:
            if known is None:
                self.handle.registerTimer(int(key[1]) + _HOUR_MS)
            self.best.update(best)
        if best != known or late:
            yield self._row(key, best, late, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.best.exists():
            yield self._row(key, tuple(self.best.get()), 0, True)
            self.best.clear()

    def close(self) -> None:
        pass


def ext_stream_upsert(rows: DataFrame, overlap: str = "8 hours") -> DataFrame:
    """Changes of the bars of a stream (instrument_id, ts, observed_at, seq, price): a row for each bar that a batch changes, with the late rows it brought, and one when it is closed. Output mode: update."""
    r = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", overlap)
    r = r.withColumns({"at_ms": F.unix_millis("ts"), "hour_ms": F.unix_millis(F.date_trunc("HOUR", "ts"))})
    # without its time column, so that late rows come through to be counted
    changes = r.drop("ts").groupBy("instrument_id", "hour_ms").transformWithStateInPandas(NewestWins(), outputStructType=_CHANGE, outputMode="Update", timeMode="EventTime")
    return changes.withColumn("hour", F.timestamp_millis("hour_ms")).drop("hour_ms")


def ext_stream_sessions(posts: DataFrame, key: str, gap: str = "30 minutes", late: str = "8 hours", ts: str = "ts") -> DataFrame:
    """(key, start, end, posts): posts of one author with pauses under ``gap``; sent when no late post can join any more. Output mode: append."""
    p = posts.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    s = p.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("posts"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "posts")


def run_stream(changes: DataFrame, target: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Everything there is, batch by batch, into the folder ``target``; a batch that is repeated after a failure replaces its own files."""
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        q = changes.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return q


def upserted(spark: SparkSession, target: str) -> DataFrame:
    """The last state of each bar that ``run_stream`` wrote, with all late rows of its hour (a bar that only late rows asked for has nulls)."""
    rows = spark.read.option("basePath", target).parquet(target)
    some = F.col("seq").isNotNull()
    last = F.max_by(F.struct("observed_at", "seq", "price", "replaced", "closed"), F.when(some, F.struct("closed", "batch")))
    return rows.groupBy("instrument_id", "hour").agg(last.alias("r"), F.sum("late").alias("late")).select("instrument_id", "hour", "r.*", "late")
