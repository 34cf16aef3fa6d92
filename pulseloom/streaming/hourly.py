"""Extension: the hourly index and bars over streams, with late data by watermark.

The batch engine's overlap and newest-wins rule is its way with late rows; a stream has the watermark instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hourly_index import FULL_SAMPLE, SCORES


def ext_stream_index(posts: DataFrame, ts: str = "ts", late: str = "8 hours") -> DataFrame:
    """Windowed counts and index per hour; NTZ times are taken as the session's zone, which watermarks need."""
    score = None
    for k, v in SCORES.items():
        arm = F.col("direction") == k
        score = F.when(arm, v) if score is None else score.when(arm, v)
    p = posts.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).withColumn("_s", score)
    g = p.groupBy(F.window("_t", "1 hour")).agg(F.count(F.lit(1)).alias("post_count"), F.count("_s").alias("analyzed_post_count"), F.avg("_s").alias("mean"), F.avg(F.when(F.col("_s").isNotNull(), F.col("confidence"))).alias("conf"))
    n = F.col("analyzed_post_count")
    return g.select(
        F.col("window.start").alias("hour"), "post_count", "analyzed_post_count", F.when(n > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("mean") + 1) * 50)), 2)).alias("sentiment_index"),
        F.coalesce(F.bround(F.col("conf") * F.least(F.lit(1.0), n / float(FULL_SAMPLE)), 4), F.lit(0.0)).alias("confidence"),
    )


def ext_stream_bars(ticks: DataFrame, keys: list[str], ts: str = "ts", price: str = "price", late: str = "8 hours", order: str = "pos") -> DataFrame:
    """Hourly open, high, low and close of prints, in order of time and, at equal times, of ``order``."""
    t = ticks.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    at = F.struct("_t", order)
    g = t.groupBy(*keys, F.window("_t", "1 hour")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"))
    return g.select(*keys, F.col("window.start").alias("hour"), "open", "high", "low", "close")


def ext_stream_dedup(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "8 hours") -> DataFrame:
    """First row of each key within the watermark."""
    return rows.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")
