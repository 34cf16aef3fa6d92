"""Registered queries over the record sources: files, stored lines, broker pages, saved posts, and what is built on them.

The driver's tables are rendered to the text a source would hold (JSON, JSON lines, CSV, pages), and the readers run on that text.
The SQL gives the same rows from the tables, with all names and word lists as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, parse, sentiment, sql, timefn
from ..operators import extensions, series, validate
from ..sources import broker_pages, html, market_files
from ..sources import posts as post_source
from ..streaming import hourly as streams
from . import pipeline
from .catalog import _INDEX, _JOINED, _POSTS, _STAMP, _shown, event_index, event_posts, event_ticks, joined, ntz, query, settled, stamp, t, tick_bars


def _text(c: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    return F.date_format(c, pattern)


def _json(**fields: Column) -> Column:
    """A JSON object without its NULL fields."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _by_day(rows: DataFrame, item: Column) -> DataFrame:
    """(file, items): the texts of a day's rows in order of their ids, a file for each thousand ids, so that files stay small however many rows a day has."""
    file = F.concat(F.to_date("ts").cast("string"), F.lit("-"), F.lpad(F.floor(F.col("event_id") / 1000).cast("string"), 9, "0"))
    kept = rows.select(file.alias("file"), F.struct("event_id", item.alias("item")).alias("x"))
    return kept.groupBy("file").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]).alias("items"))


def _in_pieces(rows: DataFrame, item: Column, head: Column, tail: Column, between: str) -> DataFrame:
    """(file, part, text): a file a day in pieces, its head, then the texts of its rows in order of their ids, a piece for each thousand ids, then its tail. ``between`` rows a line ends."""
    day, block = F.to_date("ts").cast("string").alias("file"), F.floor(F.col("event_id") / 1000)
    parts = rows.select(day, block.alias("part"), F.struct("event_id", item.alias("item")).alias("x")).groupBy("file", "part")
    parts = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]), between).alias("text"))
    days = rows.groupBy(day).agg(F.min(block).alias("least"), F.max(block).alias("most"))
    ends = [days.select("file", at.alias("part"), text.alias("text")) for at, text in ((F.col("least") - 1, head), (F.col("most") + 1, tail))]
    most = days.select(F.col("file").alias("_file"), "most")
    same = F.col("file").eqNullSafe(F.col("_file"))
    text = F.concat("text", F.when(F.col("part") < F.col("most"), between).otherwise(between.lstrip(",")))
    return parts.join(F.broadcast(most), same).select("file", "part", text.alias("text")).unionByName(ends[0]).unionByName(ends[1])


def _last_hour(spark: SparkSession, d: str) -> str:
    last = t(spark, d, "events").select(timefn.iso(timefn.hour_of(F.max(ntz()))).alias("hour")).first()["hour"]
    return last or "1970-01-01T00:00:00+09:00"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").withColumn("ts", ntz())


_FILE = "ts::DATE::VARCHAR || '-' || lpad((event_id // 1000)::VARCHAR, 9, '0')"
_POS = "row_number() OVER (PARTITION BY ts::DATE, event_id // 1000 ORDER BY event_id) - 1"
_DAY_FILE = "ts::DATE::VARCHAR"
_DAY_POS = "row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) - 1"
_SHOWN = "file, pos, kind, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+09:00') AS timestamp, instrument_id, symbol, price, open, high, low, close, volume"


def _resolved(rows: DataFrame) -> DataFrame:
    r = market_files.resolve(rows)
    return r.select("file", "pos", "kind", timefn.iso(F.col("ts")).alias("timestamp"), "instrument_id", "symbol", "price", "open", "high", "low", "close", "volume")


# ---------------------------------------------------------------- market files


@query(
    "market_json",
    f"""SELECT {_DAY_FILE} AS file, {_DAY_POS} AS pos, 'tick' AS kind, {_STAMP.format("date_trunc('second', ts)")} AS timestamp, event_type AS instrument_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS symbol, value AS price,
  NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low, CASE WHEN event_id % 5 = 0 THEN NULL::DOUBLE END AS close, CASE WHEN event_id % 3 = 0 THEN user_id::DOUBLE END AS volume FROM events""",
)
def q_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file a day: a list, or an object with the list under one of its names."""
    e, odd = _events(spark, d), F.col("event_id") % 2 == 1
    when = _text(F.col("ts"))
    item = _json(timestamp=F.when(~odd, when), 시간=F.when(odd, when), price=F.when(~odd, F.col("value")), 현재가=F.when(odd, F.col("value").cast("string")), symbol=F.when(~odd, F.col("event_type")), code=F.when(odd, F.col("event_type")), 거래량=F.when(F.col("event_id") % 3 == 0, F.col("user_id")))
    k = F.dayofmonth(F.col("file").cast("date")) % 4
    name = F.element_at(F.array(*[F.lit(x) for x in ("data", "ticks", "records")]), F.greatest(k, F.lit(1)))
    head = F.when(k == 0, "[\n").otherwise(F.concat(F.lit('{"note": "day", "'), name, F.lit('": [\n')))
    return _resolved(market_files.json_rows(_in_pieces(e, item, head, F.when(k == 0, "]").otherwise("]}"), ",\n")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines a day: prints, every tenth a bar, and among them blank and damaged lines and a list."""
    k, v = F.col("event_id") % 10, F.col("value")
    bar = k == 3
    good = _json(
        time=_text(F.col("ts"), "yyyy-MM-dd HH:mm:ss"), code=F.col("event_type"), assetType=F.lit("index"), cur_prc=F.when(~bar, v),
        open=F.when(bar, v), high=F.when(bar, v + 1), low=F.when(bar, v - 1), close=F.when(bar, v + 0.5), volume=F.when(bar, F.col("user_id")),
    )
    line = F.when(k == 0, "{damaged").when(k == 1, "").when(k == 2, "[1, 2]").otherwise(good)
    return market_files.jsonl_rows(_by_day(_events(spark, d), line).select("file", F.array_join("items", "\n").alias("text")))


_LINES = f"""numbered AS (SELECT *, {_FILE} AS file, {_POS} AS pos, event_id % 10 AS k FROM events),
l AS (SELECT file, pos, CASE k WHEN 3 THEN 'candle' ELSE 'tick' END AS kind, ts, event_type AS instrument_id, '' AS symbol, CASE WHEN k = 3 THEN value + 0.5::DOUBLE ELSE value END AS price, CASE k WHEN 3 THEN value END AS open, CASE k WHEN 3 THEN value + 1::DOUBLE END AS high,
  CASE k WHEN 3 THEN value - 1::DOUBLE END AS low, CASE WHEN k = 3 THEN value + 0.5::DOUBLE ELSE value END AS close, CASE k WHEN 3 THEN user_id::DOUBLE END AS volume FROM numbered WHERE k > 2)"""


@query("market_jsonl", f"WITH {_LINES} SELECT {_SHOWN} FROM l")
def q_jsonl(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(_lines(spark, d))


@query(
    "market_csv",
    f"""WITH l AS (SELECT {_DAY_FILE} AS file, {_DAY_POS} AS pos, 'candle' AS kind, ts, event_type AS instrument_id, event_type || ', "x"' AS symbol, value AS price, NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low, value AS close, NULL::DOUBLE AS volume FROM events)
SELECT {_SHOWN.replace("'candle'", "kind")} FROM (SELECT * REPLACE ('tick' AS kind) FROM l)""",
)
def q_csv(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file a day, with a byte-order mark, a header and quoted fields."""
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit(', ""x"""'))
    line = F.concat_ws(",", _text(F.col("ts")), F.col("event_type"), quoted, F.col("value").cast("string"), F.lit("none"))
    head = F.lit("﻿일자,종목코드,name,종가,volume\r\n")
    return _resolved(market_files.csv_rows(_in_pieces(_events(spark, d), line, head, F.lit(""), "\r\n")))


@query(
    "market_file_bars",
    f"""WITH {_LINES}, r AS (SELECT *, date_trunc('second', ts) AS s, CASE kind WHEN 'candle' THEN 1 ELSE 0 END AS rank FROM l),
one AS (SELECT instrument_id, s, arg_max(kind, (rank, file, pos)) AS kind, arg_max(price, (rank, file, pos)) AS price, arg_max(open, (rank, file, pos)) AS o, arg_max(high, (rank, file, pos)) AS h, arg_max(low, (rank, file, pos)) AS w, arg_max(close, (rank, file, pos)) AS c, min((rank, file, pos)) AS ord FROM r GROUP BY 1, 2),
b AS (SELECT instrument_id, date_trunc('hour', s) AS hour, count(*) FILTER (kind = 'candle') > 0 AS bars, arg_min(o, ord) FILTER (kind = 'candle') AS bo, max(h) FILTER (kind = 'candle') AS bh, min(w) FILTER (kind = 'candle') AS bl, arg_max(c, ord) FILTER (kind = 'candle') AS bc,
  arg_min(price, ord) FILTER (kind = 'tick') AS o, max(price) FILTER (kind = 'tick') AS h, min(price) FILTER (kind = 'tick') AS w, arg_max(price, ord) FILTER (kind = 'tick') AS c FROM one GROUP BY 1, 2),
p AS (SELECT instrument_id, hour, CASE WHEN bars THEN bo ELSE o END AS o, CASE WHEN bars THEN bh ELSE h END AS h, CASE WHEN bars THEN bl ELSE w END AS w, CASE WHEN bars THEN bc ELSE c END AS c FROM b)
SELECT {_STAMP.format('hour')} AS timestamp, instrument_id, round_even(o, 2) AS open, round_even(h, 2) AS high, round_even(w, 2) AS low, round_even(c, 2) AS close, CASE WHEN o = 0 THEN 0.0 ELSE round_even((c - o) / o * 100, 4) END AS change_rate FROM p""",
)
def q_file_bars(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.bars import hourly_from_rows

    out, _ = hourly_from_rows(market_files.resolve(_lines(spark, d)))
    return out.select("timestamp", "instrument_id", "open", "high", "low", "close", "change_rate")


def _strict_rows(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    item = _json(
        provider=F.when(F.col("event_id") % 11 != 0, "Broker"), source=F.when(F.col("event_id") % 11 == 0, "elsewhere"), assetType=F.when(F.col("event_id") % 29 == 0, "stock").otherwise(" INDEX"), data_mode=F.when(F.col("event_id") % 31 == 0, "sample").otherwise("real"),
        instrumentId=F.when(F.col("event_id") % 13 == 0, "101").otherwise(" 001 "), symbol=F.lit("kospi"), timestamp=F.when(F.col("event_id") % 19 == 0, "soon").otherwise(_text(F.date_trunc("HOUR", "ts"))),
        open=F.when(F.col("event_id") % 17 == 0, "x").otherwise(v.cast("string")), high=F.when(v < 5, v - 1).otherwise(v + 1), low=v - 1, close=v, volume=F.when(F.col("event_id") % 2 == 0, F.col("user_id")), observedAt=F.when(F.col("event_id") % 3 == 0, "seen"),
    )
    return market_files.jsonl_rows(_by_day(_events(spark, d), item).select("file", F.array_join("items", "\n").alias("text")))


_STRICT = f"""r AS (SELECT event_id, value AS v, user_id, {_FILE} AS file, {_POS} AS pos, date_trunc('hour', ts) AS hour,
  CASE WHEN event_id % 11 = 0 THEN 'provider' WHEN event_id % 29 = 0 THEN 'asset_type' WHEN event_id % 31 = 0 THEN 'data_mode' WHEN event_id % 13 = 0 THEN 'identity' WHEN event_id % 19 = 0 THEN 'timestamp' WHEN event_id % 17 = 0 THEN 'price' WHEN value < 5 THEN 'ohlc' END AS reject_reason FROM events)"""


@query("strict_rows", f"WITH {_STRICT} SELECT file, pos, CASE WHEN event_id % 19 <> 0 THEN {_STAMP.format('hour')} END AS timestamp, reject_reason FROM r")
def q_strict_rows(spark: SparkSession, d: str) -> DataFrame:
    return validate.strict_rows(_strict_rows(spark, d), "broker").select("file", "pos", "timestamp", "reject_reason")


@query(
    "strict_records",
    f"""WITH {_STRICT}, k AS (SELECT hour, arg_max((event_id, v, user_id), (file, pos)) AS x FROM r WHERE reject_reason IS NULL GROUP BY hour)
SELECT ' 001 ' AS instrument_id, {_STAMP.format('hour')} AS timestamp, round_even(x[2], 4) AS open, round_even(x[2] + 1::DOUBLE, 4) AS high, round_even(x[2] - 1::DOUBLE, 4) AS low, round_even(x[2], 4) AS close,
  CASE WHEN x[1] % 2 = 0 THEN x[3]::DOUBLE END AS volume, CASE WHEN x[1] % 3 = 0 THEN 'seen' ELSE {_STAMP.format('hour')} END AS observed_at FROM k""",
)
def q_strict_records(spark: SparkSession, d: str) -> DataFrame:
    records, _ = market_files.strict_records(_strict_rows(spark, d), "broker")
    return records.select("instrument_id", "timestamp", "open", "high", "low", "close", "volume", "observed_at")


@query(
    "existing_records",
    f"""SELECT event_id AS seq, event_id % 10 >= 4 AS accepted, CASE WHEN event_id % 10 >= 4 THEN value END AS close, CASE WHEN event_id % 10 >= 4 AND event_id % 3 = 0 THEN user_id::DOUBLE END AS volume,
  CASE WHEN event_id % 10 >= 4 THEN event_id % 4 = 0 END AS is_partial, CASE WHEN event_id % 10 >= 4 THEN {_STAMP.format("date_trunc('second', ts)")} END AS timestamp FROM events WHERE event_id % 10 <> 3""",
)
def q_existing(spark: SparkSession, d: str) -> DataFrame:
    """A stored line an event: some damaged, without a key, with NULL where a number is required, or blank."""
    k, v = F.col("event_id") % 10, F.col("value")
    texts = {"market": "KOSPI", "instrumentId": "001", "symbol": "KOSPI", "assetType": "index", "source": "s", "provider": "broker", "observedAt": "o", "dataMode": "real"}
    fields = {"timestamp": timefn.iso(F.date_trunc("SECOND", "ts")), "open": F.when(k != 2, v), "high": v, "low": v, "close": v, "volume": F.when(F.col("event_id") % 3 == 0, F.col("user_id")), "changeRate": F.lit(0.5), "isPartial": F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 4 == 0)}
    whole = F.to_json(F.struct(*[F.lit(x).alias(n) for n, x in texts.items()], *[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})
    line = F.when(k == 0, "{damaged").when(k == 1, F.regexp_replace(whole, '"symbol"', '"name"')).when(k == 3, "  ").otherwise(whole)
    good, bad = market_files.existing_records(_events(spark, d).select(F.col("event_id").alias("seq"), line.alias("line")))
    null = F.lit(None)
    good = good.select("seq", F.lit(True).alias("accepted"), "close", "volume", "is_partial", "timestamp")
    return good.unionByName(bad.select("seq", F.lit(False).alias("accepted"), null.cast("double").alias("close"), null.cast("double").alias("volume"), null.cast("boolean").alias("is_partial"), null.cast("string").alias("timestamp")))


@query(
    "sample_market",
    """WITH s AS (SELECT i, CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM range(8) r(i)), c AS (SELECT i, sign, 3200.0::DOUBLE + sum(sign * (i * 0.5::DOUBLE + 2) - 3 * sign) OVER (ORDER BY i) AS c FROM s), p AS (SELECT i, c, c + 3 * sign AS o FROM c)
SELECT strftime((SELECT date_trunc('hour', max(ts)) FROM events) - to_hours(7 - i), '%Y-%m-%dT%H:%M:%S+09:00') AS timestamp, round_even(o, 2) AS open, round_even(greatest(o, c) + 2, 2) AS high, round_even(least(o, c) - 2, 2) AS low, round_even(c, 2) AS close, round_even((c - o) / o * 100, 2) AS change_rate, 'sample' AS data_mode FROM p""",
)
def q_sample_market(spark: SparkSession, d: str) -> DataFrame:
    """The sample series up to the last hour that has events."""
    return market_files.sample_market(spark, _last_hour(spark, d)).select("timestamp", "open", "high", "low", "close", "change_rate", "data_mode")


# ---------------------------------------------------------------- posts


@query(
    "live_posts",
    """SELECT conv_id AS pos, 'c' || conv_id AS post_id, count(*) FILTER (turn > 0) AS comment_count, coalesce(md5(max(text) FILTER (turn = 0)), md5('')) AS body, md5(coalesce(string_agg(coalesce(text, ''), '|' ORDER BY turn, text) FILTER (turn > 0), '')) AS comments FROM conversations GROUP BY conv_id""",
)
def q_live(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as saved posts, a JSON line each."""
    th = post_source.threads(t(spark, d, "conversations"))
    line = F.to_json(
        F.struct(
            F.lit("board").alias("source"), F.lit("real").alias("dataMode"), F.concat(F.lit("c"), F.col("conv_id")).alias("sourcePostId"), F.col("body"), F.size("comments").alias("commentCount"),
            F.transform("comments", lambda c: F.struct(c.alias("body"))).alias("comments"),
        )
    )
    p = post_source.live_posts(th.select(F.col("conv_id").alias("pos"), line.alias("line")), "board")
    return p.select("pos", "post_id", "comment_count", F.md5("body").alias("body"), F.md5(F.array_join(F.transform("comments", lambda c: c["body"]), "|")).alias("comments"))


@query(
    "sample_posts",
    f"""SELECT post_id, title, {_STAMP.format("(SELECT date_trunc('hour', max(ts)) FROM events) - to_hours(hours)")} AS first_seen_at, views, comment_count FROM (VALUES ('sample-1', '코스피 오늘 급등 예상, 반도체 호재 쏟아진다', 4, 100::BIGINT, 3::BIGINT), ('sample-2', '시장 폭락 공포 심화, 손절 가속', 3, 150::BIGINT, 4::BIGINT),
  ('sample-3', '오늘 장세는 보합권, 관망이 답', 2, 200::BIGINT, 5::BIGINT), ('sample-4', '반도체 폭등! 상한가 러시', 1, 250::BIGINT, 6::BIGINT), ('sample-5', '외인 대거 매도, 하락 압력 심하다', 0, 300::BIGINT, 7::BIGINT)) v(post_id, title, hours, views, comment_count)""",
)
def q_sample_posts(spark: SparkSession, d: str) -> DataFrame:
    """The sample posts, the newest at the last hour that has events."""
    return post_source.sample_posts(spark, _last_hour(spark, d)).select("post_id", "title", "first_seen_at", "views", "comment_count")


# ---------------------------------------------------------------- web pages


@query(
    "html_list",
    f"""SELECT event_id::VARCHAR AS post_id, '/p/' || event_id AS url, event_type AS title, user_id * 1000 AS views, event_id % 7 AS recommendations, user_id % 5 AS comment_count, {_STAMP.format("date_trunc('second', ts)")} AS published_at FROM events WHERE event_id % 10 <> 9""",
)
def q_html_list(spark: SparkSession, d: str) -> DataFrame:
    """Plain list pages of ten entries, the last of them without a title."""
    e, k = _events(spark, d), F.col("event_id")
    entry = F.concat(
        F.lit('<li><a class="post-link" data-id="'), k, F.lit('" href="/p/'), k, F.lit('">'), F.when(k % 10 == 9, " ").otherwise(F.col("event_type")), F.lit('</a> <span class="views">'), F.format_number(F.col("user_id") * 1000, 0),
        F.lit(' views</span><span class="recommends">'), k % 7, F.lit('</span><span class="comments-count">['), F.col("user_id") % 5, F.lit(']</span><time class="published" datetime="'), stamp(F.date_trunc("SECOND", "ts")), F.lit('">today</time></li>'),
    )
    pages = e.groupBy(F.floor(k / 10).alias("page")).agg(F.concat(F.lit("<ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, entry.alias("entry")))), lambda x: x["entry"]), "\n"), F.lit("</ul>")).alias("html"))
    return html.parse_lists(pages).select("post_id", "url", "title", "views", "recommendations", "comment_count", "published_at")


@query(
    "html_posts",
    """SELECT conv_id, 'Talk ' || conv_id AS title, md5(coalesce(max(text) FILTER (turn = 0), '')) AS body, conv_id * 1000 AS views, conv_id % 7 AS recommendations, greatest(count(*) FILTER (turn > 0), CASE WHEN count(*) FILTER (turn > 0) = 0 THEN 3 ELSE 0 END) AS comment_count,
  md5(coalesce(string_agg('reader:' || coalesce(text, ''), '|' ORDER BY turn, text) FILTER (turn > 0), '')) AS comments FROM conversations GROUP BY conv_id""",
)
def q_html_posts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as plain detail pages that declare three comments, whatever they hold."""
    th, k = post_source.threads(t(spark, d, "conversations")), F.col("conv_id")
    comment = lambda c: F.concat(F.lit('<div class="comment"><span class="author"> reader </span><div class="body">'), parse.html_escape(c), F.lit("</div></div>"))
    page = F.concat(
        F.lit('<!DOCTYPE html><html><body><article class="post"><h1 class="title">Talk '), k, F.lit('</h1><div class="body">'), parse.html_escape(F.col("body")), F.lit('</div><span class="views">'), F.format_number(k * 1000, 0),
        F.lit('</span><span class="recommends">'), k % 7, F.lit('</span><span class="comments-count">3</span>'), F.array_join(F.transform("comments", comment), ""), F.lit("</article></body></html>"),
    )
    p = html.parse_posts(th.select("conv_id", page.alias("html")), keep=("conv_id",))
    said = F.array_join(F.transform("comments", lambda c: F.concat_ws(":", c["author"], c["body"])), "|")
    return p.select("conv_id", "title", F.md5("body").alias("body"), "views", "recommendations", "comment_count", F.md5(said).alias("comments"))


@query(
    "board_list",
    """SELECT page_id, 'Page ' || page_id AS title, CASE WHEN page_id % 4 = 1 THEN (200000 + page_id)::VARCHAR ELSE (1000000 + page_id)::VARCHAR END AS post_id,
  CASE WHEN page_id % 4 = 1 THEN 'https://site.example/' || (200000 + page_id) ELSE 'https://site.example/index.php?document_srl=' || (1000000 + page_id) END AS url FROM pages WHERE page_id % 5 <> 0""",
)
def q_board_list(spark: SparkSession, d: str) -> DataFrame:
    """Links of a board: with a document id as a parameter, in the path, or (every fifth) without one."""
    k = F.col("page_id")
    href = F.when(k % 5 == 0, "/about").when(k % 4 == 1, F.concat(F.lit("/"), k + 200000, F.lit("#c"))).otherwise(F.concat(F.lit("/index.php?page=2&amp;document_srl="), k + 1000000, F.lit("&amp;x=1#top")))
    page = F.concat(F.lit('<div><a href="'), href, F.lit('">  Page\n<b>'), k, F.lit('</b></a><a href="/9999999"> </a></div>'))
    return html.parse_lists(t(spark, d, "pages").select("page_id", page.alias("html")), "board", "https://site.example", ("page_id",)).select("page_id", "title", "post_id", "url")


@query(
    "board_posts",
    f"""WITH e AS (SELECT *, event_id % 11 = 0 AS gone FROM events WHERE event_id % 11 = 0 OR event_id % 13 <> 0)
SELECT event_id::VARCHAR AS post_id, gone AS deleted, CASE WHEN gone THEN '' ELSE 'https://site.example/' || (8800000 + event_id) END AS url, CASE WHEN gone THEN '삭제된 게시물입니다' ELSE event_type || ' & co' END AS title, CASE WHEN gone THEN '' ELSE props END AS body,
  CASE WHEN gone THEN 0 ELSE user_id * 1000 END AS views, CASE WHEN gone THEN 0 ELSE -(event_id % 5) END AS recommendations, CASE WHEN gone THEN 0 WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 4 END AS comment_count,
  CASE WHEN NOT gone AND event_id % 3 < 2 THEN {_STAMP.format("date_trunc('second', ts)")} END AS published_at FROM e""",
)
def q_board_posts(spark: SparkSession, d: str) -> DataFrame:
    """Detail pages of a board: some deleted, some without anything, times in the attribute, in the text or without a zone."""
    e, k = _events(spark, d), F.col("event_id")
    at, naive = stamp(F.date_trunc("SECOND", "ts")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    comment = F.when(k % 4 == 0, '<div class="cmt_list"><div class="cmt_item"><div class="cmt_content">so it is</div></div></div>').otherwise(F.concat(F.lit('<span class="comment_cnt">'), k % 4, F.lit("</span>")))
    page = F.concat(
        F.lit('<html><head><meta property="og:url" content="/'), k + 8800000, F.lit('?x=1"></head><body><article class="bd_doc"><h1 class="title"> '), F.col("event_type"), F.lit(' &amp; co</h1><div class="rd_body"><p>'), parse.html_escape(F.col("props")),
        F.lit('</p></div><span class="view_cnt">'), F.format_number(F.col("user_id") * 1000, 0), F.lit('</span><span class="recommend_cnt">'), -(k % 5), F.lit('</span><time datetime="'), F.when(k % 3 == 0, at).otherwise(naive), F.lit('">'),
        F.when(k % 3 == 1, at).otherwise("3분 전"), F.lit("</time>"), comment, F.lit("</article></body></html>"),
    )
    page = F.when(k % 11 == 0, '<h1 class="title">삭제된 게시물입니다</h1><time>3분 전</time>').when(k % 13 == 0, "<div></div>").otherwise(page)
    p = html.parse_posts(e.select(k.cast("string").alias("post_id"), page.alias("html")), "board", "https://site.example")
    return p.select("post_id", "deleted", "url", "title", "body", "views", "recommendations", "comment_count", "published_at")


# ---------------------------------------------------------------- broker pages


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of raw bars for a day's each thousand ids; some of another day, at no time or without a price."""
    e = _events(spark, d)
    v = F.round(F.col("value") * 100).cast("bigint").cast("string")
    signed = lambda s: F.concat(F.lit(s), v)
    at = F.date_format(F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.make_interval(days=F.lit(1))).otherwise(F.col("ts")), "yyyyMMddHHmmss")
    row = F.struct(
        signed("-").alias("cur_prc"), F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")).alias("trde_qty"), F.when(F.col("event_id") % 11 == 0, "x").otherwise(at).alias("cntr_tm"), signed("+").alias("open_pric"), v.alias("high_pric"),
        F.when(F.col("event_id") % 13 == 0, "0").otherwise(signed("-")).alias("low_pric"), F.lit("999999").alias("acc_trde_qty"),
    )
    p = e.select(F.date_format("ts", "yyyyMMdd").alias("day"), (F.floor(F.col("event_id") / 1000) * 3 + F.col("event_id") % 3).cast("int").alias("page"), F.struct("event_id", row.alias("row")).alias("x"))
    p = p.groupBy("day", "page").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["row"]).alias("inds_min_pole_qry"))
    broken = p.select("day", F.lit(-1).alias("page"), F.lit('{"inds_min_pole_qry": 3}').alias("body")).distinct()
    return p.select("day", "page", F.to_json(F.struct(F.lit(0).alias("return_code"), "inds_min_pole_qry")).alias("body")).unionByName(broken)


_BROKER = """b AS (SELECT strftime(ts, '%Y%m%d') AS day, ((event_id // 1000) * 3 + event_id % 3)::INT AS page, row_number() OVER (PARTITION BY ts::DATE, event_id // 1000, event_id % 3 ORDER BY event_id) - 1 AS pos, date_trunc('second', ts) AS ts, round(value * 100)::BIGINT::DOUBLE AS v, CASE WHEN event_id % 5 <> 0 THEN user_id::DOUBLE END AS volume,
  CASE WHEN event_id % 11 = 0 THEN 'invalid_time' WHEN event_id % 7 = 0 THEN 'other_date' WHEN event_id % 13 = 0 OR round(value * 100) = 0 THEN 'invalid_price' ELSE 'accepted' END AS status, hour(ts) * 60 + minute(ts) BETWEEN 540 AND 929 AS session FROM events)"""


@query("broker_rows", f"WITH {_BROKER} SELECT day, page, pos, status, CASE WHEN status = 'accepted' THEN v END AS close, volume, status IN ('accepted', 'invalid_price') AND session AND hour(ts) = 15 AS is_partial FROM b")
def q_broker_rows(spark: SparkSession, d: str) -> DataFrame:
    c = broker_pages.classify(broker_pages.page_rows(_pages(spark, d)))
    return c.select("day", "page", "pos", "status", F.when(F.col("status") == "accepted", F.col("close")).alias("close"), "volume", (F.col("is_partial") & F.col("status").isin("accepted", "invalid_price")).alias("is_partial"))


@query(
    "broker_counters",
    f"""WITH {_BROKER} SELECT count(*) AS received, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status <> 'accepted' OR NOT session) AS rejected, count(*) FILTER (status IN ('accepted', 'invalid_price')) AS target_date, count(*) FILTER (status = 'other_date') AS other_date,
  count(*) FILTER (status = 'invalid_time') AS invalid_time, count(*) FILTER (status = 'invalid_price') AS invalid_price, count(*) FILTER (status = 'accepted' AND NOT session) AS out_of_session, count(DISTINCT CASE WHEN status = 'accepted' AND session THEN date_trunc('hour', ts) END) AS hourly_records,
  count(DISTINCT CASE WHEN status = 'accepted' AND session AND hour(ts) = 15 THEN date_trunc('hour', ts) END) AS partial_buckets FROM b""",
)
def q_broker_counters(spark: SparkSession, d: str) -> DataFrame:
    return broker_pages.run_counters(broker_pages.classify(broker_pages.page_rows(_pages(spark, d))))


@query(
    "broker_hours",
    f"""WITH {_BROKER} SELECT {_STAMP.format("date_trunc('hour', ts)")} AS timestamp, arg_min(v, (ts, page, pos)) AS open, max(v) AS high, min(v) AS low, arg_max(v, (ts, page, pos)) AS close, CASE WHEN count(volume) = count(*) THEN round_even(sum(volume), 4) END AS volume,
  round_even((arg_max(v, (ts, page, pos)) - arg_min(v, (ts, page, pos))) / arg_min(v, (ts, page, pos)) * 100, 4) AS change_rate FROM b WHERE status = 'accepted' AND session GROUP BY date_trunc('hour', ts)""",
)
def q_broker_hours(spark: SparkSession, d: str) -> DataFrame:
    return _shown(broker_pages.collect_hours(broker_pages.classify(broker_pages.page_rows(_pages(spark, d)))).drop("is_partial"))


# ---------------------------------------------------------------- the default lexicon, the summary, labels

_SAID = ("", "코스피 급등 호재", "공포 급락 손절", "관망 횡보", "BULL long 매수", "bear short 약세 조정", "코스닥 상승 하락", "비트코인 폭락 패닉 러시", "나스닥 보합 지지 저항", "기대 수익 익절 위험")
_SAID_SQL = ", ".join(f"'{x}'" for x in _SAID)
_LEX_P = "['상승', '급등', '호재', '매수', 'bull', 'long', '상한가', '갭상승', '돌파', '반등', '회복', '긍정', '좋', '기대', '수익', '익절', '보유', '추가매수', '신고가', '러시', '폭등', '급반등']"
_LEX_N = "['하락', '급락', '악재', '매도', 'bear', 'short', '하한가', '갭하락', '손절', '손실', '부정', '나쁘', '위험', '폭락', '버림', '탈출', '붕괴', '급락', '공포', '패닉', '출렁', '약세', '조정']"
_LEX_U = "['관망', '횡보', '박스권', '지지', '저항', '보합', '보통', 'neutral', '횡보세', '지루']"


@query(
    "default_lexicon",
    f"""WITH x AS (SELECT doc_id, trim([{_SAID_SQL}][doc_id % 10 + 1] || ' ' || coalesce(text, '')) AS text FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT AS h, len(list_filter({_LEX_P}, lambda w: contains(lower(text), w))) AS p, len(list_filter({_LEX_N}, lambda w: contains(lower(text), w))) AS n, len(list_filter({_LEX_U}, lambda w: contains(lower(text), w))) AS u FROM x),
k AS (SELECT *, p + n + u AS total, CASE WHEN p + n + u = 0 THEN 'unrelated' WHEN p > n AND p > u THEN 'positive' WHEN n > p AND n > u THEN 'negative' WHEN p > 0 AND n > 0 THEN 'mixed' ELSE 'neutral' END AS direction FROM h),
s AS (SELECT *, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE round_even(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (CASE direction WHEN 'positive' THEN p::DOUBLE / total WHEN 'negative' THEN -(n::DOUBLE / total) WHEN 'mixed' THEN (p - n)::DOUBLE / total ELSE 0.0::DOUBLE END) + ((h % 100)::DOUBLE / 1000.0::DOUBLE - 0.05::DOUBLE))), 4) END AS score FROM k)
SELECT doc_id, direction, score, CAST(greatest(0, least(100, round_even((score + 1.0::DOUBLE) * 50, 0))) AS INT) AS fear_greed, direction = 'positive' AND n > 0 AND h % 10 < 2 AS sarcasm, CASE WHEN total = 0 THEN 0.3 ELSE round_even(least(0.95::DOUBLE, 0.5::DOUBLE + total / 10.0::DOUBLE), 4) END::DOUBLE AS confidence, 'lexicon-v1' AS model FROM s""",
)
def q_default_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Documents after some words of the default lexicon, through the provider of that name."""
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("doc_id") % 10 + 1).cast("int"))
    x = t(spark, d, "documents").select("doc_id", F.trim(F.concat(said, F.lit(" "), F.coalesce("text", F.lit("")))).alias("text"))
    return sentiment.create_provider("lexicon")(x, F.col("text")).select("doc_id", "direction", "score", "fear_greed", "sarcasm", "confidence", "model")


@query(
    "summary_of_run",
    f"""WITH {_JOINED}, p AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN {_STAMP.format("ts + INTERVAL 1 HOUR")} ELSE {_STAMP.format('ts')} END AS seen FROM posts), b AS (SELECT count(*) AS n FROM bars)
SELECT count(*) AS total_posts, CAST(sum(comment_count) AS BIGINT) AS total_comments, count(*) AS total_analyzed, round_even(avg(k), 4) AS avg_confidence, (SELECT count(*) FROM idx) AS index_buckets, (SELECT count(*) FROM joined) AS joined_records, 'first' AS market_provider, 'files' AS market_source,
  '001' AS instrument, 'KOSPI' AS symbol, 'index' AS asset_type, 'real' AS data_mode, min(seen) AS community_first_seen_at, max(seen) AS community_last_seen_at FROM p""",
)
def q_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The operator's own summary of posts, bars, index and joined rows."""
    late = F.when(F.col("event_id") % 3 == 0, "").otherwise(stamp(F.date_trunc("SECOND", "ts")))
    scored = event_posts(spark, d).select("comment_count", F.col("k").alias("confidence"), late.alias("first_seen_at"), stamp(F.date_trunc("SECOND", F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.make_interval(hours=F.lit(1))).otherwise(F.col("ts")))).alias("published_at"))
    named = {"instrument_id": "001", "symbol": "KOSPI", "asset_type": "index", "data_mode": "real", "source": "files"}
    hours = _shown(tick_bars(spark, d).select("hour"))
    earliest = hours.agg(F.min("timestamp").alias("first"))
    b = hours.crossJoin(F.broadcast(earliest)).withColumns({k: F.lit(v) for k, v in named.items()}).withColumn("provider", F.when(F.col("timestamp") == F.col("first"), "first").otherwise("later"))
    s = pipeline.summary(scored, b, event_index(spark, d), joined(spark, d))
    names = {"totalPosts": "total_posts", "totalComments": "total_comments", "totalAnalyzed": "total_analyzed", "avgConfidence": "avg_confidence", "indexBuckets": "index_buckets", "joinedRecords": "joined_records", "marketProvider": "market_provider", "marketSource": "market_source", "instrument": "instrument", "symbol": "symbol", "assetType": "asset_type", "dataMode": "data_mode", "communityFirstSeenAt": "community_first_seen_at", "communityLastSeenAt": "community_last_seen_at"}
    return spark.createDataFrame([{v: s[k] for k, v in names.items()}], ", ".join(f"{v} {'double' if v == 'avg_confidence' else 'long' if k.startswith('total') or v in ('index_buckets', 'joined_records') else 'string'}" for k, v in names.items()))


@query("has_sentiment_any", f"WITH {_JOINED} SELECT bool_or(has_sentiment) AS has_sentiment, count(*) AS hours FROM joined")
def q_any(spark: SparkSession, d: str) -> DataFrame:
    return series.any_sentiment(joined(spark, d))


@query("nasdaq_series", f"WITH {_JOINED} SELECT {_STAMP.format('hour')} AS timestamp, NULL::DOUBLE AS market_value FROM joined")
def q_nasdaq(spark: SparkSession, d: str) -> DataFrame:
    return _shown(series.market_series(joined(spark, d), "market_normalized", ["hour"], "NASDAQ").select("hour", "market_value"))


@query("sample_badge", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true ELSE false END AS sample FROM customer")
def q_badge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    mode = F.when(k == 0, "sample").when(k == 1, "real").when(k == 2, "Sample")
    return t(spark, d, "customer").select("c_custkey", labels.is_sample(mode).alias("sample"))


@query(
    "change_text",
    f"""WITH {_JOINED}, w AS (SELECT hour, sentiment_index AS a, lag(sentiment_index) OVER (ORDER BY hour) AS b FROM joined), r AS (SELECT hour, floor((a - b) * 10 + 0.5) / 10 AS c FROM w)
SELECT {_STAMP.format('hour')} AS timestamp, '지난 1시간 ' || coalesce(CASE WHEN c > 0 THEN '+' ELSE '' END || format('{{:.1f}}', c), '–') AS text FROM r""",
)
def q_change_text(spark: SparkSession, d: str) -> DataFrame:
    p = series.previous(settled(spark, d).select("hour", "sentiment_index"), "hour", "sentiment_index")
    return _shown(p.select("hour", labels.change_text(F.col("sentiment_index"), F.col("previous")).alias("text")))


@query("closing_auction", "SELECT event_id, hour(ts) * 60 + minute(ts) BETWEEN 920 AND 929 AS auction FROM events")
def q_auction(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", timefn.in_closing_auction(ntz()).alias("auction"))


# ---------------------------------------------------------------- built-in kinds of aggregates, windows and sets


@query("cube_distinct", "SELECT event_type, CAST(hour(ts) AS INT) AS hour, count(*) AS rows, count(DISTINCT user_id) AS users FROM events GROUP BY CUBE (event_type, hour(ts))")
def q_cube(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).cube("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"))


@query(
    "ranked_users",
    """WITH u AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, user_id, n, CAST(rank() OVER w AS INT) AS rank, CAST(dense_rank() OVER w AS INT) AS dense, round_even(percent_rank() OVER w, 9) AS percent, CAST(ntile(4) OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS INT) AS quarter FROM u WINDOW w AS (PARTITION BY event_type ORDER BY n DESC)""",
)
def q_ranked(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    u = _events(spark, d).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.col("n").desc())
    return u.select("event_type", "user_id", "n", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.bround(F.percent_rank().over(w), 9).alias("percent"), F.ntile(4).over(Window.partitionBy("event_type").orderBy(F.col("n").desc(), "user_id")).alias("quarter"))


_BUYERS = "(SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')"
_FAILED = "(SELECT DISTINCT user_id FROM events WHERE event_type = 'error')"


@query("set_operations", f"SELECT 'both' AS kind, user_id FROM (SELECT * FROM {_BUYERS} INTERSECT SELECT * FROM {_FAILED}) UNION ALL SELECT 'only', user_id FROM (SELECT * FROM {_BUYERS} EXCEPT SELECT * FROM {_FAILED}) UNION ALL SELECT 'any', user_id FROM (SELECT * FROM {_BUYERS} UNION SELECT * FROM {_FAILED})")
def q_sets(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    a, b = (e.filter(F.col("event_type") == k).select("user_id") for k in ("purchase", "error"))
    named = lambda k, df: df.select(F.lit(k).alias("kind"), "user_id")
    return named("both", a.intersect(b)).unionByName(named("only", a.subtract(b))).unionByName(named("any", a.union(b).distinct()))


@query("registered_functions", f"WITH {_INDEX} SELECT {_STAMP.format('hour')} AS timestamp, CASE WHEN sentiment_index IS NULL THEN '데이터 없음' WHEN sentiment_index >= 75 THEN '매우 긍정' WHEN sentiment_index >= 60 THEN '긍정' WHEN sentiment_index > 40 THEN '중립' WHEN sentiment_index > 25 THEN '부정' ELSE '강한 부정' END AS label, CASE WHEN sentiment_index >= 60 THEN 'up' WHEN sentiment_index <= 40 THEN 'down' ELSE 'flat' END AS side FROM idx")
def q_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions as a SQL session sees them."""
    sql.register(spark)
    return spark.sql("SELECT ts AS timestamp, sentiment_label(i) AS label, sentiment_class(i) AS side FROM {index}", index=event_index(spark, d).select(stamp(F.col("hour")).alias("ts"), F.col("sentiment_index").alias("i")))


# ---------------------------------------------------------------- extensions


@query("ext_attention", f"WITH {_INDEX}, m AS (SELECT hour, post_count, avg(post_count) OVER (PARTITION BY hour(hour), isodow(hour)) AS mean FROM idx) SELECT {_STAMP.format('hour')} AS timestamp, post_count, round_even(post_count / mean, 4) AS attention FROM m")
def q_attention(spark: SparkSession, d: str) -> DataFrame:
    return _shown(extensions.ext_attention(event_index(spark, d).select("hour", "post_count"), "hour", "post_count"))


@query(
    "ext_disagreement",
    f"WITH {_INDEX}, e AS (SELECT hour, -(CASE WHEN positive_ratio > 0 THEN positive_ratio * ln(positive_ratio) ELSE 0 END + CASE WHEN negative_ratio > 0 THEN negative_ratio * ln(negative_ratio) ELSE 0 END + CASE WHEN neutral_ratio > 0 THEN neutral_ratio * ln(neutral_ratio) ELSE 0 END) / ln(3) AS x FROM idx) SELECT {_STAMP.format('hour')} AS timestamp, floor(x * 1000 + 0.5) / 1000 + 0.0 AS disagreement FROM e",
)
def q_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return _shown(extensions.ext_disagreement(event_index(spark, d), digits=9).select("hour", (F.floor(F.col("disagreement") * 1000 + 0.5) / 1000 + 0.0).alias("disagreement")))


@query("ext_velocity", f"WITH {_INDEX} SELECT {_STAMP.format('a.hour')} AS timestamp, round_even(a.sentiment_index - b.sentiment_index, 2) AS velocity_60m, round_even(a.sentiment_index - c.sentiment_index, 2) AS velocity_1440m FROM idx a LEFT JOIN idx b ON b.hour = a.hour - INTERVAL 1 HOUR LEFT JOIN idx c ON c.hour = a.hour - INTERVAL 24 HOUR")
def q_velocity(spark: SparkSession, d: str) -> DataFrame:
    return _shown(extensions.ext_velocity(event_index(spark, d).select("hour", "sentiment_index"), "hour", "sentiment_index", (60, 1440)).drop("sentiment_index"))


@query("ext_market_divergence", f"WITH {_JOINED} SELECT {_STAMP.format('hour')} AS timestamp, round_even((sentiment_index - 50) / 50 - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, market_change_rate / 5.0::DOUBLE)), 4) AS market_divergence FROM joined")
def q_market_divergence(spark: SparkSession, d: str) -> DataFrame:
    return _shown(joined(spark, d).select("hour", extensions.ext_market_divergence(F.col("sentiment_index"), F.col("market_change_rate"), 5.0).alias("market_divergence")))


@query("ext_author_weight", "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT e.event_id, round_even(CASE WHEN n.n > 3 THEN 3.0::DOUBLE / n.n ELSE 1.0::DOUBLE END, 6) AS weight FROM events e JOIN n USING (user_id)")
def q_author_weight(spark: SparkSession, d: str) -> DataFrame:
    return extensions.ext_author_weight(t(spark, d, "events").select("event_id", "user_id"), "user_id", 3).select("event_id", F.bround("weight", 6).alias("weight"))


@query("ext_engagement", "SELECT event_id, floor(least(10.0::DOUBLE, ln(1 + user_id) + 2 * ln(1 + event_id % 7) + 2 * ln(1 + greatest(event_id % 5 - 2, 0))) * 1e6 + 0.5) / 1e6 AS engagement FROM events")
def q_engagement(spark: SparkSession, d: str) -> DataFrame:
    e = extensions.ext_engagement(F.col("user_id"), F.col("event_id") % 7, F.col("event_id") % 5 - 2)
    return t(spark, d, "events").select("event_id", (F.floor(e * 1e6 + 0.5) / 1e6).alias("engagement"))


@query("ext_decay", "SELECT event_id, floor(pow(0.5, value / 24) * 1e6 + 0.5) / 1e6 AS weight FROM events")
def q_decay(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", (F.floor(extensions.ext_decay(F.col("value")) * 1e6 + 0.5) / 1e6).alias("weight"))


@query("ext_mask_personal", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), '\b\d{2,3}-\d{3,4}-\d{4}\b', '<phone>', 'g'), '\b\d{2,6}-\d{2,6}-\d{4,8}\b', '<account>', 'g')) AS digest FROM documents")
def q_mask(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(extensions.ext_mask_personal(F.coalesce("text", F.lit("")))).alias("digest"))


@query("ext_retain", "SELECT event_id FROM events WHERE CASE event_type WHEN 'click' THEN ts >= TIMESTAMP '2024-01-24 00:00:00' WHEN 'view' THEN ts >= TIMESTAMP '2024-01-17 00:00:00' ELSE true END")
def q_retain(spark: SparkSession, d: str) -> DataFrame:
    return extensions.ext_retain(_events(spark, d), "ts", "event_type", F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")), {"click": 7, "view": 14}).select("event_id")


@query("ext_status", "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, CASE WHEN n < 150 THEN 'INSUFFICIENT_DATA' ELSE 'OK' END AS status FROM n")
def q_sample_status(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", extensions.ext_status(F.col("n"), 150).alias("status"))


@query("ext_tickers", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '000100' WHEN 'MACHINERY' THEN '000200' END AS ticker FROM customer")
def q_tickers(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("BUILDING", "000100"), ("MACHINERY", "000200"), ("MACHINERY", "000200")], "alias string, ticker string")
    return extensions.ext_tickers(t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("a")), "a", names).select("c_custkey", "ticker")


@query("ext_review_queue", "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'review' ELSE 'accepted' END AS queue FROM documents")
def q_review(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") < 100, 0.1).otherwise(0.9).alias("confidence"))
    review, accepted = extensions.ext_review_queue(p, "confidence")
    return review.select("doc_id", F.lit("review").alias("queue")).unionByName(accepted.select("doc_id", F.lit("accepted").alias("queue")))


@query("ext_event_log", f"SELECT event_id::VARCHAR AS event_id, CASE event_type WHEN 'purchase' THEN 'source.post.discovered' WHEN 'view' THEN 'content.normalized' WHEN 'error' THEN 'content.analysis.rejected' END AS event_type, {_STAMP.format("date_trunc('second', ts)")} AS occurred_at, event_type IN ('purchase', 'view', 'error') AS valid FROM events")
def q_event_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "source.post.discovered").when(F.col("event_type") == "view", "content.normalized").when(F.col("event_type") == "error", "content.analysis.rejected")
    e = _events(spark, d).select(
        F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"), stamp(F.date_trunc("SECOND", "ts")).alias("occurred_at"), F.lit("engine").alias("producer"), F.lit("1").alias("producer_version"),
        F.col("user_id").cast("string").alias("correlation_id"), F.lit("board").alias("source_id"), F.lit(1).alias("payload_schema_version"),
    )
    return extensions.ext_event_log(e).select("event_id", "event_type", "occurred_at", F.col("reject_reason").isNull().alias("valid"))


@query("ext_label_contract", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'relevance' WHEN doc_id % 5 = 0 THEN 'stance' WHEN doc_id % 7 = 0 THEN 'confidence' END AS reject_reason FROM labels")
def q_label_contract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = t(spark, d, "labels").select(
        "doc_id", F.when(k % 3 == 0, "maybe").otherwise("relevant").alias("relevance"), F.expr("array('KOSPI')").alias("targets"), F.when(k % 5 != 0, "bullish").alias("stance"), F.lit("fear").alias("emotion"), F.lit("hold").alias("action_intent"),
        F.lit("unspecified").alias("time_horizon"), F.lit("opinion").alias("expression_type"), F.lit("no").alias("sarcasm"), F.when(k % 7 == 0, "HIGH").otherwise("high").alias("confidence"), F.lit("").alias("notes"),
    )
    return extensions.ext_label_contract(rows).select("doc_id", "reject_reason")


# ---------------------------------------------------------------- streams, over the table as one batch


@query(
    "ext_stream_index",
    f"""WITH {_POSTS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS post_count, count(*) FILTER (direction <> 'unrelated') AS analyzed_post_count,
  CASE WHEN count(*) FILTER (direction <> 'unrelated') > 0 THEN round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (avg(CASE direction WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE WHEN 'unrelated' THEN NULL ELSE 0.0::DOUBLE END) + 1) * 50)), 2) END AS sentiment_index FROM posts GROUP BY date_trunc('hour', ts)""",
)
def q_stream_index(spark: SparkSession, d: str) -> DataFrame:
    p = event_posts(spark, d).withColumnRenamed("k", "confidence")
    return streams.ext_stream_index(p).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "post_count", "analyzed_post_count", "sentiment_index")


@query("ext_stream_bars", "SELECT event_type AS instrument_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY event_type, date_trunc('hour', ts)")
def q_stream_bars(spark: SparkSession, d: str) -> DataFrame:
    b = streams.ext_stream_bars(event_ticks(spark, d), ["instrument_id"])
    return b.select("instrument_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "open", "high", "low", "close")
