"""The whole flow: market bars and posts to joined records, summary and files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentiment import create_provider, full_text
from ..functions.timefn import hour_of, iso, kst
from ..operators.hourly_index import hourly_index, join_market, overnight
from ..sinks import METHODOLOGY, dashboard_payload, records, to_contract, write_json
from ..sources import html, market_files, posts
from ..sources.posts import effective_time


@dataclass
class Config:
    """Where rows come from. ``as_of`` stands for the wall clock, so that runs repeat."""

    as_of: str
    market: str = "sample"
    market_path: str = ""
    community: str = "sample"
    community_path: str = ""
    provider: str = "broker"
    community_source: str = "community"
    sentiment: str = "lexicon"
    options: dict = field(default_factory=dict)


def market_bars(spark: SparkSession, c: Config) -> DataFrame:
    """Bars by source: ``strict`` needs a path and rows; ``files`` falls back to the sample if it yields nothing."""
    if c.market == "strict":
        if not c.market_path:
            raise ValueError("the strict source needs a path")
        bars, _ = market_files.read_strict(spark, c.market_path, c.provider)
        if not bars.limit(1).count():
            raise RuntimeError("the strict source holds no valid record")
        return bars.withColumn("is_partial", F.lit(False))
    if c.market == "files" and c.market_path:
        reader = market_files.read_file if c.market_path.rsplit(".", 1)[-1].lower() in market_files.FORMATS else market_files.read_folder
        from ..operators.bars import hourly_from_rows

        bars, _ = hourly_from_rows(market_files.resolve(reader(spark, c.market_path)), observed_at=F.lit(c.as_of))
        if bars.limit(1).count():
            return bars
    return market_files.sample_market(spark, c.as_of)


def community_posts(spark: SparkSession, c: Config) -> DataFrame:
    if c.community == "live":
        return posts.load_live_posts(spark, c.community_path, c.community_source)
    if c.community == "fixtures" and c.community_path:
        found = html.read_fixture_posts(spark, c.community_path).withColumn("first_seen_at", F.coalesce("first_seen_at", F.lit(c.as_of)))
        if found.limit(1).count():
            return found
    return posts.sample_posts(spark, c.as_of)


def score_posts(p: DataFrame, provider: str, now: Column) -> DataFrame:
    bodies = F.expr("transform(comments, c -> c.body)")
    scored = create_provider(provider)(p, full_text(F.col("title"), F.col("body"), bodies))
    return scored.withColumn("hour", hour_of(kst(effective_time(F.col("first_seen_at"), F.col("published_at"), now)))).withColumn("comment_count", F.size("comments"))


def summary(scored: DataFrame, bars: DataFrame, index: DataFrame, joined: DataFrame) -> dict:
    """Totals, mean confidence of all posts, range of times and the first bar's identity: one aggregation a table."""
    seen = F.coalesce(F.nullif("first_seen_at", F.lit("")), F.nullif("published_at", F.lit("")))
    s = scored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("comment_count"), F.lit(0)).alias("c"), F.coalesce(F.bround(F.avg("confidence"), 4), F.lit(0.0)).alias("f"), F.min(seen).alias("a"), F.max(seen).alias("b")).first()
    names = ("instrument_id", "symbol", "asset_type", "data_mode", "provider", "source")
    m = bars.agg(F.min_by(F.struct(*names), F.struct("instrument_id", "symbol", "timestamp")).alias("m")).first()["m"]
    m = m.asDict() if m else dict.fromkeys(names, "") | {"data_mode": "sample", "asset_type": "index"}
    return {
        "totalPosts": s["n"], "totalComments": s["c"], "totalAnalyzed": s["n"], "avgConfidence": s["f"], "indexBuckets": index.count(), "joinedRecords": joined.count(),
        "marketProvider": m["provider"] or m["source"], "marketSource": m["source"], "instrument": m["instrument_id"], "symbol": m["symbol"], "assetType": m["asset_type"], "dataMode": m["data_mode"],
        "communityPosts": s["n"], "communityComments": s["c"], "communityFirstSeenAt": s["a"], "communityLastSeenAt": s["b"],
    }


def run(spark: SparkSession, c: Config, output: str | None = None) -> dict:
    """All steps; returns the payload and, with ``output``, writes ``api/data.json`` and ``pipeline_output.json`` below it."""
    bars = market_bars(spark, c)
    scored = score_posts(community_posts(spark, c), c.sentiment, F.lit(c.as_of)).cache()
    index = hourly_index(scored, F.col("hour")).cache()
    b = bars.withColumn("hour", hour_of(kst(F.col("timestamp"))))
    joined = join_market(b, index, ["instrument_id", "symbol", "timestamp"]).orderBy("instrument_id", "symbol", "timestamp")
    shown = joined.select("timestamp", "market", "instrument_id", "symbol", "sentiment_index", "has_sentiment", "market_normalized", "market_change_rate", "post_count", "confidence", "data_mode", "comment_count", "analyzed_post_count")
    total = summary(scored, bars, index, shown) | {"communitySource": c.community, "provider": c.sentiment, "lastUpdated": c.as_of, "methodologyVersion": METHODOLOGY}
    rows = records(to_contract(shown))
    payload = dashboard_payload(rows, None, total)
    if output:
        write_json(spark, payload, f"{output}/api/data.json")
        whole = {"marketRecords": records(to_contract(bars)), "indices": records(to_contract(index.withColumn("timestamp", iso(F.col("hour"))).drop("hour"))), "joined": rows, "overnight": overnight()["overnight"], "summary": total}
        write_json(spark, whole, f"{output}/pipeline_output.json")
    scored.unpersist()
    index.unpersist()
    return payload
