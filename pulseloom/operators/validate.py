"""Contracts of records. Each adds ``reject_reason`` (NULL: accepted), so that counters are one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import first_field, lenient_double
from ..functions.timefn import iso, kst

# Identity of the index series.
INSTRUMENT, SYMBOL = "001", "KOSPI"


def is_exact_index(instrument: Column, symbol: Column) -> Column:
    return F.coalesce((F.trim(instrument) == INSTRUMENT) & (F.upper(F.trim(symbol)) == SYMBOL), F.lit(False))


def reasons(*rules: tuple[str, Column]) -> Column:
    """The first broken rule's name."""
    out = None
    for name, ok in rules:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def ohlc_consistent(o: Column, h: Column, l: Column, c: Column) -> Column:
    return (h >= F.greatest(o, c)) & (l <= F.least(o, c))


def strict_rows(rows: DataFrame, provider: str, row: str = "raw", market: str = "KOSPI", source: str = "broker-api") -> DataFrame:
    """Alias-resolved hourly records of a strict file (map column ``raw``), with reject_reason."""
    f = lambda *n: first_field(F.col(row), *n)
    d = rows.withColumns(
        {
            "provider": f("provider", "source"), "asset_type": f("assetType", "asset_type", "securityType"), "data_mode": f("dataMode", "data_mode"),
            "instrument_id": F.coalesce(f("instrumentId", "instrument_id"), F.lit("")), "symbol": F.coalesce(f("symbol", "종목명"), F.lit("")),
            "ts": kst(f("timestamp", "time", "datetime")), "o": lenient_double(f("open", "시가")), "h": lenient_double(f("high", "고가")), "l": lenient_double(f("low", "저가")),
            "c": lenient_double(f("close", "종가", "cur_prc")), "volume": lenient_double(f("volume", "거래량")),
            "change_rate": F.coalesce(lenient_double(f("changeRate", "change_rate", "flu_rt")), F.lit(0.0)), "observed": f("observedAt", "observed_at"),
        }
    )
    o, h, l, c = (F.col(x) for x in "ohlc")
    why = reasons(
        ("provider", F.lower("provider") == provider), ("asset_type", F.lower(F.trim("asset_type")) == "index"), ("data_mode", F.lower(F.trim("data_mode")) == "real"),
        ("identity", is_exact_index(F.col("instrument_id"), F.col("symbol"))), ("timestamp", F.col("ts").isNotNull()),
        ("price", o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()), ("ohlc", ohlc_consistent(o, h, l, c)),
    )
    return d.select(
        "ts", iso(F.col("ts")).alias("timestamp"), F.lit(market).alias("market"), "instrument_id", "symbol", *[F.bround(F.col(k[0]), 4).alias(k) for k in ("open", "high", "low", "close")],
        "volume", "change_rate", F.lit(source).alias("source"), F.lit(provider).alias("provider"), F.lit("index").alias("asset_type"),
        F.coalesce(F.nullif("observed", F.lit("")), iso(F.col("ts"))).alias("observed_at"), F.lit("real").alias("data_mode"), why.alias("reject_reason"),
        *[x for x in ("kind", "file", "pos") if x in rows.columns],
    )


def index_records(records: DataFrame, provider: str) -> DataFrame:
    """The same contract for hourly records that are already typed."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    why = reasons(
        ("provider", F.col("provider") == provider), ("asset_type", F.col("asset_type") == "index"), ("data_mode", F.col("data_mode") == "real"),
        ("instrument", F.col("instrument_id") == INSTRUMENT), ("symbol", F.upper("symbol") == SYMBOL), ("market", F.upper("market") == SYMBOL),
        ("price", o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()), ("ohlc", ohlc_consistent(o, h, l, c)),
    )
    return records.withColumn("reject_reason", why)


def counters(classified: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """received, accepted and rejected, in one pass."""
    return classified.agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col(reason).isNull()).alias("accepted"), F.count(reason).alias("rejected"))
