"""Prints and bars to hourly bars, and the keep-one rules before and after.

All are partial aggregations on the grouping key: one shuffle, no window, no group in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import hour_of, is_partial, iso, session_bucket

# Names that stand for the index, and the asset types that decide on their own.
INDEX_NAMES = ("KOSPI", "KS11", "KOSPI COMPOSITE", "KOSPI 200", "KOSPI200", "KOSPI INDEX", "코스피")
INDEX_TYPES = ("index", "지수", "kospi")
STOCK_TYPES = ("stock", "equity", "share", "common_stock", "주식", "종목")


def change_rate(open_: Column, close: Column, digits: int = 4) -> Column:
    return F.when(open_ == 0, 0.0).otherwise(F.bround((close - open_) / F.nullif(open_, F.lit(0.0)) * 100, digits))


def is_index(instrument: Column, symbol: Column, asset_type: Column, own: tuple[str, ...] = ()) -> Column:
    """Whether an identity may stand for the market index: by asset type, else by name; no identity counts as the index."""
    kind = F.lower(F.trim(asset_type))
    identity = F.upper(F.trim(F.concat_ws(" ", F.coalesce(instrument, F.lit("")), F.coalesce(symbol, F.lit("")))))
    named = F.lit(False)
    for n in (*INDEX_NAMES, *(x for x in own if x)):
        named = named | F.contains(identity, F.lit(n.upper()))
    out = F.when(kind.isin(*INDEX_TYPES), True).when(kind.isin(*STOCK_TYPES), False).when(identity == "", True).otherwise(named)
    return out


def keep_last(rows: DataFrame, keys: list[str], order: list[str], position: str = "ord") -> DataFrame:
    """The last row of each key by ``order``, with the position of the key's first row as ``position``.

    That is what overwriting an ordered map does: the value is the last one, the place the first one's.
    """
    at = F.struct(*order)
    kept = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), at).alias("_last"), F.min(at).alias(position))
    return last.select(*keys, "_last.*", position)


def hourly_from_rows(rows: DataFrame, own_names: tuple[str, ...] = (), market: str = "KOSPI", data_mode: str = "real", source: str = "market-files", observed_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Hourly bars of prints and bars in input order, and the buckets turned down as other instruments.

    ``rows``: kind (tick or candle), ts, instrument_id, symbol, price, open, high, low, close, asset_type and the input order
    (file, pos). The result is in no order: writers sort. Keys are (instrument or else symbol, ts): the last row stays and bars go before prints. A bucket with any bar ignores its
    prints; open and close follow the input order, not time.
    """
    ranked = rows.withColumns({"key": F.when(F.coalesce(F.col("instrument_id"), F.lit("")) != "", F.col("instrument_id")).otherwise(F.col("symbol")), "rank": (F.col("kind") == "candle").cast("int")})
    one = keep_last(ranked, ["key", "ts"], ["rank", "file", "pos"]).withColumn("hour", hour_of(F.col("ts")))
    bar = F.col("kind") == "candle"
    agg = {"bars": F.count_if(bar), "asset_type": F.min_by("asset_type", "ord")}
    for name, use, tick_use in (("open", "open", F.min_by), ("close", "close", F.max_by)):
        agg[f"bar_{name}"] = tick_use(F.when(bar, F.col(use)), F.when(bar, F.col("ord")))
        agg[f"tick_{name}"] = tick_use(F.when(~bar, F.col("price")), F.when(~bar, F.col("ord")))
    for name, f in (("high", F.max), ("low", F.min)):
        agg[f"bar_{name}"] = f(F.when(bar, F.col(name)))
        agg[f"tick_{name}"] = f(F.when(~bar, F.col("price")))
    b = one.groupBy("instrument_id", "symbol", "hour").agg(*[v.alias(k) for k, v in agg.items()])
    for name in ("open", "high", "low", "close"):
        b = b.withColumn(name, F.when(F.col("bars") > 0, F.col(f"bar_{name}")).otherwise(F.col(f"tick_{name}")))
    b = b.withColumn("accepted", is_index(F.col("instrument_id"), F.col("symbol"), F.col("asset_type"), own_names))
    price = [F.bround(c, 2).alias(c) for c in ("open", "high", "low", "close")]
    bars = b.filter("accepted").select(
        iso(F.col("hour")).alias("timestamp"), F.lit(market).alias("market"), "instrument_id", "symbol", *price, F.lit(None).cast("double").alias("volume"),
        change_rate(F.col("open"), F.col("close")).alias("change_rate"), F.lit(source).alias("source"), F.lit("").alias("provider"), F.lit("index").alias("asset_type"),
        (observed_at if observed_at is not None else iso(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))).alias("observed_at"), F.lit(data_mode).alias("data_mode"), F.lit(False).alias("is_partial"),
    )
    return bars, b.filter("not accepted").select("instrument_id", "symbol", "hour")


def hourly_ohlc(candles: DataFrame, keys: list[str], ts: str = "ts", order: tuple[str, ...] = (), digits: int = 4, session: bool = True) -> DataFrame:
    """Hourly bars in time order; volume only if every bar has one; rows out of session go.

    ``order`` breaks ties of time. Adds hour, open, high, low, close, volume, change_rate and is_partial.
    """
    t = F.col(ts)
    at = F.struct(ts, *order)
    c = candles.withColumn("hour", session_bucket(t) if session else hour_of(t)).filter("hour is not null")
    b = c.groupBy(*keys, "hour").agg(
        F.min_by("open", at).alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", at).alias("c"),
        F.when(F.count("volume") == F.count(F.lit(1)), F.bround(F.sum("volume"), 4)).alias("volume"), F.bool_or(is_partial(t)).alias("is_partial"),
    )
    price = [F.bround(F.col(k[0]), digits).alias(k) for k in ("open", "high", "low", "close")]
    return b.select(*keys, "hour", *price, "volume", change_rate(F.col("o"), F.col("c")).alias("change_rate"), "is_partial")


def merge_newest(existing: DataFrame, fresh: DataFrame, keys: list[str], observed: str = "observed_at") -> tuple[DataFrame, DataFrame]:
    """One row per key: the newest ``observed``, and at a tie the earlier one (existing before fresh, then in order of ``seq``).

    Also (replaced): how often a later row took an earlier one's place while folding in that order, as
    the collector counts. Both are aggregations and a window per key, never over the whole table.
    """
    from pyspark.sql import Window

    both = existing.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("_side", "seq").rowsBetween(Window.unboundedPreceding, -1)
    taken = both.withColumn("_best", F.max(observed).over(w)).filter(F.col(observed) > F.col("_best")).agg(F.count(F.lit(1)).alias("replaced"))
    # newest first, then earliest: order the pair (observed, place from the end)
    kept = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(observed, (-F.col("_side")).alias("s"), (-F.col("seq")).alias("q"))).alias("_row"))
    return newest.select(*keys, "_row.*").drop("_side"), taken
