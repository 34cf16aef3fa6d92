"""The hourly sentiment index and its join to market bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a direction scores; any other direction is counted but not scored.
SCORES = {"positive": 1.0, "neutral": 0.0, "mixed": 0.0, "negative": -1.0}
FULL_SAMPLE = 10


def hourly_index(posts: DataFrame, hour: Column, direction: str = "direction", comments: str = "comment_count", confidence: str = "confidence", scores: dict[str, float] | None = None) -> DataFrame:
    """Per hour: counts, 0-100 index, ratios and confidence. Hours with posts but no scored one have a NULL index."""
    table = scores or SCORES
    score = None
    for k, v in table.items():
        arm = F.col(direction) == k
        score = F.when(arm, v) if score is None else score.when(arm, v)
    p = posts.select(hour.alias("hour"), score.alias("s"), F.col(direction).alias("d"), F.col(comments).alias("n"), F.col(confidence).alias("c")).filter("hour is not null")
    scored = F.col("s").isNotNull()
    g = p.groupBy("hour").agg(
        F.count(F.lit(1)).alias("post_count"), F.sum("n").cast("long").alias("comment_count"), F.count("s").alias("analyzed"), F.sum("s").alias("total"),
        F.count_if(F.col("d") == "positive").alias("pos"), F.count_if(F.col("d") == "negative").alias("neg"), F.sum(F.when(scored, F.col("c"))).alias("conf"),
    )
    n = F.nullif(F.col("analyzed"), F.lit(0))
    share = lambda c: F.coalesce(F.bround(c / n, 4), F.lit(0.0))
    return g.select(
        "hour",
        # greatest and least pass over NULL
        F.when(F.col("analyzed") > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("total") / n + 1.0) * 50.0)), 2)).alias("sentiment_index"),
        (F.col("analyzed") > 0).alias("has_sentiment"),
        share(F.col("pos")).alias("positive_ratio"), share(F.col("neg")).alias("negative_ratio"), share(F.col("analyzed") - F.col("pos") - F.col("neg")).alias("neutral_ratio"),
        "post_count", "comment_count", F.col("analyzed").alias("analyzed_post_count"),
        F.coalesce(F.bround(F.col("conf") / n * F.least(F.lit(1.0), F.col("analyzed") / float(FULL_SAMPLE)), 4), F.lit(0.0)).alias("confidence"),
    )


def join_market(bars: DataFrame, index: DataFrame, order: list[str], base_partition: bool = False, index_order: str | None = None) -> DataFrame:
    """Every bar with the index of its hour: has sentiment, has posts only, or has nothing; closes rebased to the first bar.

    ``bars``: hour, close, change_rate; ``index``: as ``hourly_index`` returns it, the last row of an hour (by ``index_order``) counts.
    The base is one row, found by aggregation and broadcast; the index is left to the optimizer, which broadcasts it if small.
    """
    if index_order:
        kept = [c for c in index.columns if c != "hour"]
        index = index.groupBy("hour").agg(F.max_by(F.struct(*kept), index_order).alias("_r")).select("hour", "_r.*")
    # the anchor reads all columns, so that what is shuffled below it is shuffled once for both uses
    first = bars.agg(F.min_by(F.struct(*bars.columns), F.struct(*order)).getField("close").alias("_base"))
    base = F.when(F.col("_base") == 0, 1.0).otherwise(F.col("_base"))
    i = index.select("hour", *[F.col(c).alias(f"_{c}") for c in ("sentiment_index", "has_sentiment", "post_count", "comment_count", "analyzed_post_count", "confidence")])
    j = bars.crossJoin(F.broadcast(first)).join(i, "hour", "left")
    some = F.coalesce(F.col("_has_sentiment"), F.lit(False))
    zero = F.lit(0).cast("long")
    return j.select(
        *[c for c in bars.columns if c != "change_rate"],
        F.when(some, F.col("_sentiment_index")).alias("sentiment_index"), some.alias("has_sentiment"),
        F.bround(F.col("close") / base * 100.0, 2).alias("market_normalized"), F.col("change_rate").alias("market_change_rate"),
        F.coalesce("_post_count", zero).alias("post_count"), F.when(some, F.col("_confidence")).otherwise(0.0).alias("confidence"),
        F.coalesce("_comment_count", zero).alias("comment_count"), F.coalesce("_analyzed_post_count", zero).alias("analyzed_post_count"),
    )


def overnight(trade_date: str = "") -> dict:
    """Overnight evaluation is not available from hourly bars; the contract says so instead of inventing numbers."""
    return {"tradeDate": trade_date, "overnight": {"status": "unavailable", "reason": "real_session_data_not_available"}, "kospi": {}, "matches": {}}
