"""Operators on a time-ordered series: period, rebase, change, divergence, place.

A series is never pulled into one task: neighbours are found within a day, and the day's edges through a table of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import js_round

# Periods in hours.
PERIODS = {"24h": 24, "7d": 168, "30d": 720}


def period_filter(rows: DataFrame, ts: Column, period: str, unknown: str = "all") -> DataFrame:
    """Rows of the last hours before the latest valid time (inclusive). ``all`` keeps everything, invalid times too.

    An unknown period keeps everything as well, or (``unknown="valid"``) nothing if no row has a valid time.
    """
    hours = PERIODS.get(period)
    if hours is None:
        if period == "all" or unknown == "all":
            return rows
        some = rows.filter(ts.isNotNull()).limit(1).select(F.lit(1).alias("_some"))
        return rows.crossJoin(F.broadcast(some)).drop("_some")
    latest = rows.select(F.max(ts).alias("_latest"))
    return rows.crossJoin(F.broadcast(latest)).filter(ts >= F.col("_latest") - F.make_interval(hours=F.lit(hours))).drop("_latest")


def rebase(rows: DataFrame, value: str, order: list[str], out: str = "rebased") -> DataFrame:
    """The value against the first one by ``order``, which is 100; rounded half up; a base of 0 or NULL counts as 100."""
    first = rows.agg(F.min_by(F.struct(value), F.struct(*order)).getField(value).alias("_base"))
    base = F.coalesce(F.nullif(F.col("_base"), F.lit(0.0)), F.lit(100.0))
    return rows.crossJoin(F.broadcast(first)).withColumn(out, F.floor(F.col(value) / base * 10000 + 0.5) / 100).drop("_base")


def previous(rows: DataFrame, ts: str, value: str, out: str = "previous") -> DataFrame:
    """The value of the row before by time."""
    day = F.to_date(F.col(ts))
    d = rows.withColumn("_day", day)
    ends = d.groupBy("_day").agg(F.max_by(F.struct(F.col(value).alias("v")), ts).alias("_end"))
    ends = ends.select("_day", F.lag("_end").over(Window.orderBy("_day")).alias("_before"))
    w = Window.partitionBy("_day").orderBy(ts)
    d = d.withColumn("_own", F.lag(F.struct(F.col(value).alias("v"))).over(w)).join(ends, "_day")
    return d.withColumn(out, F.coalesce("_own", "_before").getField("v")).drop("_day", "_own", "_before")


def change(rows: DataFrame, ts: str, value: str, out: str = "change") -> DataFrame:
    """Change against the row before, to one decimal, half up; NULL if either is missing."""
    return previous(rows, ts, value, "_prev").withColumn(out, js_round(F.col(value) - F.col("_prev"), 1)).drop("_prev")


def place(rows: DataFrame, ts: str, out: str = "place") -> DataFrame:
    """Number of the row by time, from 0."""
    d = rows.withColumn("_day", F.to_date(F.col(ts)))
    days = d.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    days = days.select("_day", (F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).alias("_ahead"))
    w = Window.partitionBy("_day").orderBy(ts)
    return d.withColumn("_own", F.row_number().over(w) - 1).join(days, "_day").withColumn(out, (F.col("_ahead") + F.col("_own")).cast("long")).drop("_day", "_own", "_ahead")


def any_sentiment(rows: DataFrame) -> DataFrame:
    """(has_sentiment, hours): whether any row of the series has sentiment, and how many rows it has."""
    return rows.agg(F.coalesce(F.bool_or("has_sentiment"), F.lit(False)).alias("has_sentiment"), F.count(F.lit(1)).alias("hours"))


def latest(rows: DataFrame, ts: str, n: int = 1) -> DataFrame:
    return rows.orderBy(F.col(ts).desc()).limit(n)


def divergence(rows: DataFrame, ts: str, index: str = "sentiment_index", rate: str = "market_change_rate") -> DataFrame:
    """Points where the index and the market point to different sides, with their place in the series."""
    d = place(rows, ts, "x")
    mood = F.when(F.col(index) >= 50, 1).otherwise(-1)
    move = F.signum(rate).cast("int")
    return d.filter(F.col(index).isNotNull() & F.col(rate).isNotNull() & (move != 0) & (mood != move))


def market_series(rows: DataFrame, value: str, order: list[str], market: str, out: str = "market_value") -> DataFrame:
    """The rebased series of the index market; other markets have no series of their own and stay NULL."""
    if market == "NASDAQ":
        return rows.withColumn(out, F.lit(None).cast("double"))
    return rebase(rows, value, order, out)


def chart_series(joined: DataFrame, ts: Column, period: str, market: str = "KOSPI", order: list[str] | None = None) -> DataFrame:
    """label, sentiment_index and market_value of a period."""
    f = period_filter(joined, ts, period)
    s = market_series(f, "market_normalized", order or ["timestamp"], market)
    return s.withColumn("label", F.substring(F.coalesce("timestamp", F.lit("")), 1, 16))
