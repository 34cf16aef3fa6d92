"""Incremental collection: what to ask for, what to refuse."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timefn import check_years, is_trading_day

OVERLAP_HOURS = 8


class NoTradingDays(ValueError):
    """The range holds no trading day."""


class NothingAccepted(RuntimeError):
    """A range with trading days gave no accepted row."""


def latest_timestamp(existing: DataFrame) -> str:
    return existing.agg(F.max("timestamp")).first()[0] or ""


def effective_from(requested_from: str, requested_to: str, latest: str, overlap_hours: int = OVERLAP_HOURS, force: bool = False) -> str:
    """First day to ask for: the requested one, or the latest stored time less the overlap if later, but not past the last day."""
    first, last = date.fromisoformat(requested_from), date.fromisoformat(requested_to)
    if latest and not force:
        back = (datetime.fromisoformat(latest) - timedelta(hours=overlap_hours)).date()
        first = min(max(first, back), last) if back > first else first
    return first.isoformat()


def trading_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day) of the trading days from ``first`` to ``last``, both in a year that is known."""
    check_years(first, last)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")) if first <= last else spark.createDataFrame([], "day date")
    return days.filter(is_trading_day(F.col("day")))


def trading_neighbours(spark: SparkSession, first: str, last: str, within: int = 31) -> DataFrame:
    """(day, is_trading, previous_day, next_day): every date of the range and the trading days before and after it, looked for up to ``within`` days inside the range. A row per date."""
    check_years(first, last)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).withColumn("is_trading", is_trading_day(F.col("day")))
    w, trading = Window.orderBy("day"), F.when(F.col("is_trading"), F.col("day"))
    return days.withColumns({"previous_day": F.max(trading).over(w.rowsBetween(-within, -1)), "next_day": F.min(trading).over(w.rowsBetween(1, within))})


def previous_trading_day(spark: SparkSession, day: str, within: int = 31) -> str | None:
    d = date.fromisoformat(day)
    rows = spark.range(1, within + 1).select(F.date_sub(F.lit(d), F.col("id").cast("int")).alias("day")).filter(is_trading_day(F.col("day"))).agg(F.max("day")).first()
    return rows[0].isoformat() if rows[0] else None


def plan(spark: SparkSession, existing: DataFrame | None, first: str, last: str, overlap_hours: int = OVERLAP_HOURS, force: bool = False) -> tuple[str, DataFrame]:
    """(effective first day, days to ask for); a range without trading days is refused."""
    check_years(first, last)
    latest = latest_timestamp(existing) if existing is not None and not force else ""
    start = effective_from(first, last, latest, overlap_hours, force)
    days = trading_days(spark, start, last)
    if not days.limit(1).count():
        raise NoTradingDays(f"no trading day in {start}..{last}")
    return start, days


def refuse_empty(accepted: int, days: int) -> None:
    """Nothing is written for a range with trading days that gave nothing, whatever is stored."""
    if days > 0 and accepted == 0:
        raise NothingAccepted(f"no row accepted on {days} trading day(s)")
