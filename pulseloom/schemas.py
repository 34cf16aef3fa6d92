"""Schemas of the records that flow between sources, operators and sinks."""

from __future__ import annotations

#: One print or bar as read from a file: aliases resolved, nothing aggregated.
MARKET_ROW = "kind string, ts timestamp_ntz, instrument_id string, symbol string, price double, open double, high double, low double, close double, volume double, file string, pos long"

#: An hourly bar.
HOURLY_BAR = "timestamp string, market string, instrument_id string, symbol string, open double, high double, low double, close double, volume double, change_rate double, source string, provider string, asset_type string, observed_at string, data_mode string, is_partial boolean"

COMMENT = "struct<id:string,parent_id:string,depth:int,body:string,author:string,published_at:string,recommendations:bigint,deleted:boolean>"
POST = f"post_id string, url string, title string, body string, published_at string, first_seen_at string, views bigint, recommendations bigint, comment_count bigint, deleted boolean, comments array<{COMMENT}>"

SENTIMENT = "struct<direction:string,score:double,positive:double,negative:double,neutral:double,sarcasm:boolean,fear_greed:int,targets:array<string>,confidence:double,model:string>"

#: An hour of the sentiment index.
HOURLY_INDEX = "timestamp string, sentiment_index double, has_sentiment boolean, positive_ratio double, negative_ratio double, neutral_ratio double, post_count bigint, comment_count bigint, analyzed_post_count bigint, confidence double"

JOINED = "timestamp string, market string, instrument_id string, symbol string, sentiment_index double, has_sentiment boolean, market_normalized double, market_change_rate double, post_count bigint, confidence double, data_mode string, comment_count bigint, analyzed_post_count bigint"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)
