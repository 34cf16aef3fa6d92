import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseloom.functions.timefn import kst
from pulseloom.operators import bars, extensions, hourly_index, incremental, posts, series, validate

TICK = "kind string, ts timestamp_ntz, instrument_id string, symbol string, price double, open double, high double, low double, close double, asset_type string, file string, pos long"
T0 = datetime(2026, 8, 5, 9)


def tick(minute, price, pos, who="", file="a"):
    return ("tick", T0 + timedelta(minutes=minute), who, "", price, None, None, None, None, None, file, pos)


def bar(minute, o, h, l, c, pos, who=""):
    return ("candle", T0 + timedelta(minutes=minute), who, "", None, o, h, l, c, None, "a", pos)


def test_ticks_keep_input_order_and_last_value(spark):
    rows = [tick(30, 100.0, 0), tick(5, 110.0, 1), tick(40, 95.0, 2), tick(30, 105.0, 3)]
    got, _ = bars.hourly_from_rows(spark.createDataFrame(rows, TICK))
    r = got.collect()
    assert [(x.timestamp, x.open, x.high, x.low, x.close, x.volume) for x in r] == [("2026-08-05T09:00:00+09:00", 105.0, 110.0, 95.0, 95.0, None)]


def test_bars_beat_ticks(spark):
    rows = [tick(0, 1.0, 0), bar(5, 100.0, 110.0, 95.0, 105.0, 1), bar(10, 105.0, 120.0, 98.0, 115.0, 2)]
    r = bars.hourly_from_rows(spark.createDataFrame(rows, TICK))[0].first()
    assert (r.open, r.high, r.low, r.close, r.change_rate) == (100.0, 120.0, 95.0, 115.0, 15.0)


def test_stocks_are_turned_down(spark):
    rows = [tick(0, 1.0, 0, "005930"), tick(0, 2.0, 1, "KOSPI")]
    good, bad = bars.hourly_from_rows(spark.createDataFrame(rows, TICK))
    assert [x.instrument_id for x in good.collect()] == ["KOSPI"] and bad.count() == 1
    assert bars.hourly_from_rows(spark.createDataFrame([], TICK))[0].count() == 0


def test_dedup_and_bars_against_an_ordered_map(spark):
    rng = random.Random(5)
    rows = [tick(rng.randrange(90), float(rng.randrange(1, 50)), i, rng.choice(["KOSPI", "KS11"])) if rng.random() < 0.7 else bar(rng.randrange(90), *[float(rng.randrange(1, 50)) for _ in range(4)], i, rng.choice(["KOSPI", "KS11"])) for i in range(300)]
    merged = {}
    for kind in ("tick", "candle"):
        for r in rows:
            if r[0] == kind:
                merged[r[2], r[1]] = r
    groups = {}
    for (who, ts), r in merged.items():
        groups.setdefault((who, ts.replace(minute=0)), []).append(r)
    want = {}
    for k, g in groups.items():
        c = [r for r in g if r[0] == "candle"]
        p = [r[4] for r in g]
        want[k] = (c[0][5], max(r[6] for r in c), min(r[7] for r in c), c[-1][8]) if c else (p[0], max(p), min(p), p[-1])
    got = {(r.instrument_id, datetime.fromisoformat(r.timestamp).replace(tzinfo=None)): (r.open, r.high, r.low, r.close) for r in bars.hourly_from_rows(spark.createDataFrame(rows, TICK))[0].collect()}
    assert got == want


def test_session_bars(spark):
    day = [("2026-08-05 09:05", 100.0, 105.0, 99.0, 101.0, 100.0), ("2026-08-05 09:25", 101.0, 110.0, 100.0, 108.0, 200.0), ("2026-08-05 09:45", 108.0, 109.0, 102.0, 104.0, 150.0), ("2026-08-05 15:10", 1.0, 1.0, 1.0, 1.0, None), ("2026-08-05 16:00", 9.0, 9.0, 9.0, 9.0, 1.0)]
    d = spark.createDataFrame(day, "t string, open double, high double, low double, close double, volume double").withColumn("ts", kst(F.col("t")))
    got = [tuple(r)[1:] for r in bars.hourly_ohlc(d, []).orderBy("hour").collect()]
    assert got == [(100.0, 110.0, 99.0, 104.0, 450.0, 4.0, False), (1.0, 1.0, 1.0, 1.0, None, 0.0, True)]


def test_merge_against_a_fold(spark):
    rng = random.Random(3)
    rows = [(str(rng.randrange(20)), str(rng.randrange(4)), i, float(i)) for i in range(200)]
    old, new = rows[:90], rows[90:]
    best, replaced = {}, 0
    for r in rows:
        if r[0] not in best:
            best[r[0]] = r
        elif r[1] > best[r[0]][1]:
            best[r[0]], replaced = r, replaced + 1
    make = lambda x: spark.createDataFrame(x, "k string, observed_at string, seq long, close double")
    got, n = bars.merge_newest(make(old), make(new), ["k"])
    assert {r.k: (r.observed_at, r.seq) for r in got.collect()} == {k: (r[1], r[2]) for k, r in best.items()}
    assert n.first()[0] == replaced
    again, _ = bars.merge_newest(got, got, ["k"])
    assert sorted(map(tuple, again.select("k", "seq").collect())) == sorted(map(tuple, got.select("k", "seq").collect()))


def post(hour, direction, comments=0, confidence=0.5):
    return (T0 + timedelta(hours=hour), direction, comments, confidence)


def test_index_and_join(spark):
    p = [post(0, "positive", 1, 0.95), post(0, "negative", 2, 0.95), post(0, "neutral", 0, 0.95), post(0, "unrelated", 4, 0.3), post(1, "unrelated", 7), *[post(2, "negative", 0, 0.9)] * 10, (None, "positive", 1, 0.5)]
    i = hourly_index.hourly_index(spark.createDataFrame(p, "ts timestamp_ntz, direction string, comment_count int, confidence double"), F.col("ts"))
    r = {x.hour.hour: x for x in i.collect()}
    assert (r[9].post_count, r[9].analyzed_post_count, r[9].comment_count, r[9].sentiment_index, r[9].positive_ratio, r[9].confidence) == (4, 3, 7, 50.0, 0.3333, 0.285)
    assert r[10].sentiment_index is None and r[10].post_count == 1 and not r[10].has_sentiment and r[10].confidence == 0.0
    assert r[11].sentiment_index == 0.0 and r[11].has_sentiment
    b = spark.createDataFrame([(T0 + timedelta(hours=h), c, 0.5) for h, c in ((0, 3000.0), (1, 3060.0), (2, 0.0), (5, 1.0))], "hour timestamp_ntz, close double, change_rate double")
    j = {x.hour.hour: x for x in hourly_index.join_market(b, i, ["hour"]).collect()}
    assert len(j) == 4 and (j[9].market_normalized, j[10].market_normalized) == (100.0, 102.0)
    assert (j[10].sentiment_index, j[10].post_count, j[10].comment_count) == (None, 1, 7)
    assert (j[14].post_count, j[14].has_sentiment, j[14].comment_count) == (0, False, 0)
    assert abs(r[9].positive_ratio + r[9].negative_ratio + r[9].neutral_ratio - 1) < 1e-3
    assert hourly_index.overnight()["overnight"]["status"] == "unavailable"


def test_series(spark):
    now = datetime(2026, 8, 5, 9)
    rows = [(now - timedelta(days=d), float(d + 1)) for d in (40, 8, 2, 0)] + [(None, 1.0)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    assert [series.period_filter(d, F.col("ts"), p).count() for p in ("24h", "7d", "30d", "all", "x")] == [1, 2, 3, 5, 5]
    assert series.period_filter(d.filter("ts is null"), F.col("ts"), "x", unknown="valid").count() == 0
    hours = [(now + timedelta(hours=7 * k), None if k == 3 else float(k * k)) for k in range(12)]
    h = spark.createDataFrame(hours, "ts timestamp_ntz, v double")
    before = {r.ts: r.previous for r in series.previous(h, "ts", "v").collect()}
    assert all(before[hours[k][0]] == (hours[k - 1][1] if k else None) for k in range(12))
    assert sorted((r.ts, r.place) for r in series.place(h, "ts").collect()) == [(x[0], k) for k, x in enumerate(hours)]
    j = spark.createDataFrame([(now + timedelta(hours=k), s, m) for k, (s, m) in enumerate([(60.0, -1.0), (60.0, 1.0), (None, 1.0), (40.0, 2.0), (0.0, -1.0), (50.0, 0.0)])], "hour timestamp_ntz, sentiment_index double, market_change_rate double")
    assert sorted(r.x for r in series.divergence(j, "hour").collect()) == [0, 3]
    n = series.market_series(h, "v", ["ts"], "NASDAQ")
    assert n.filter("market_value is not null").count() == 0


def test_contract(spark):
    base = {"provider": "broker", "assetType": "index", "dataMode": "real", "instrumentId": "001", "symbol": "kospi", "timestamp": "2026-08-05T10:00:00+09:00", "open": "3200", "high": "3210", "low": "3190", "close": "3205"}
    bad = [{"provider": "x"}, {"instrumentId": "1001"}, {"symbol": "KOSDAQ"}, {"high": "3000"}, {"open": "abc"}, {"timestamp": None}, {"dataMode": "sample"}]
    d = spark.createDataFrame([(base | b,) for b in [{}, *bad]], "raw map<string,string>")
    got = validate.strict_rows(d, "broker")
    assert [r.reject_reason for r in got.collect()] == [None, "provider", "identity", "identity", "ohlc", "price", "timestamp", "data_mode"]
    assert tuple(validate.counters(got).first()) == (8, 1, 7)


@pytest.mark.parametrize(("first", "last", "latest", "overlap", "force", "want"), [
    ("2026-08-01", "2026-08-06", "2026-08-05T14:00:00+09:00", 8, False, "2026-08-05"), ("2026-08-01", "2026-08-05", "2026-08-05T09:00:00+09:00", 24, False, "2026-08-04"),
    ("2026-08-04", "2026-08-05", "", 8, False, "2026-08-04"), ("2026-08-01", "2026-08-03", "2026-08-03T14:00:00+09:00", 8, True, "2026-08-01"), ("2026-08-01", "2026-08-06", "2026-08-10T14:00:00+09:00", 8, False, "2026-08-06"),
])
def test_effective_from(first, last, latest, overlap, force, want):
    assert incremental.effective_from(first, last, latest, overlap, force) == want


def test_plan(spark):
    _, days = incremental.plan(spark, None, "2026-08-06", "2026-08-10")
    assert [r.day.day for r in days.orderBy("day").collect()] == [6, 7, 10]
    with pytest.raises(incremental.NoTradingDays):
        incremental.plan(spark, None, "2026-08-08", "2026-08-09")
    with pytest.raises(ValueError, match="calendar"):
        incremental.plan(spark, None, "2025-12-31", "2026-01-02")
    with pytest.raises(incremental.NothingAccepted):
        incremental.refuse_empty(0, 3)
    assert incremental.previous_trading_day(spark, "2026-08-10") == "2026-08-07"


def test_selection_and_greedy_dedup(spark):
    d = spark.createDataFrame([(i, str(p), t) for i, (p, t) in enumerate([(1, "공지: x"), (2, "a"), (2, "a again"), (3, ""), (4, "Notice"), (5, "b"), (6, "c")])], "pos long, post_id string, title string")
    assert [r.post_id for r in posts.select_posts(d, 2).orderBy("pos").collect()] == ["2", "5"]
    rng = random.Random(2)
    rows = [(i, str(rng.randrange(25)), rng.choice(["", *map(str, range(20))]), rng.choice([None, *map(str, range(20))])) for i in range(60)]
    seen, want = (set(), set(), set()), {}
    for i, a, b, c in rows:
        hit = "post_id" if a in seen[0] else "url" if b and b in seen[1] else "content_hash" if c and c in seen[2] else None
        want[i] = hit
        if hit is None:
            for s, v in zip(seen, (a, b, c), strict=True):
                s.add(v)
    for range_rows in (200_000, 7):
        got = posts.greedy_dedup(spark.createDataFrame(rows, "pos long, post_id string, url string, content_hash string"), range_rows=range_rows)
        assert {r.pos: r.dropped_by for r in got.collect()} == want
    # rows without keys, NULL ids, and a chain as long as the table
    bare = [(i, None, "", None) for i in range(5)] + [(10, None, "u", None), (11, None, "u", ""), (12, "", "", None), (13, "", "v", None)]
    got = posts.greedy_dedup(spark.createDataFrame(bare, "pos long, post_id string, url string, content_hash string"))
    assert {r.pos: r.dropped_by for r in got.collect() if r.dropped_by} == {11: "url", 13: "post_id"}
    chain = spark.createDataFrame([(i, f"p{i}", f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(40)], "pos long, post_id string, url string, content_hash string")
    kept = [r.pos for r in posts.greedy_dedup(chain).filter("dropped_by is null").orderBy("pos").collect()]
    assert kept == list(range(0, 40, 2))


def test_greedy_dedup_of_a_long_chain_and_a_hot_key(spark):
    n = 100_000
    row = F.col("id")
    chain = spark.range(n).select(row.alias("pos"), F.concat(F.lit("p"), row).alias("post_id"), F.concat(F.lit("u"), F.floor(row / 2)).alias("url"), F.concat(F.lit("h"), F.floor((row + 1) / 2)).alias("content_hash"))
    got = posts.greedy_dedup(chain, range_rows=30_000)
    assert got.groupBy(F.col("pos") % 2, "dropped_by").count().orderBy("dropped_by").collect() == [(0, None, n // 2), (1, "url", n // 2)]
    plan = got._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    # a third of all rows share a hash, their first row has a key of an earlier one
    hot = spark.range(30_000).select(row.alias("pos"), F.concat(F.lit("p"), F.when(row == 3, 1).otherwise(row)).alias("post_id"), F.lit("").alias("url"), F.when(row % 3 == 0, "same").alias("content_hash"))
    got = posts.greedy_dedup(hot.filter("pos > 0"), range_rows=5_000).filter("dropped_by is not null")
    assert got.groupBy("dropped_by").agg(F.count("*"), F.min("pos")).orderBy("dropped_by").collect() == [("content_hash", 9_997, 9), ("post_id", 1, 3)]


def test_extensions(spark):
    d = spark.createDataFrame([("mail a.b@c.de tel 010-1234-5678",)], "v string")
    assert d.select(extensions.ext_mask_personal(F.col("v"))).first()[0] == "mail <email> tel <phone>"
    p = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "t int, g int")
    r = extensions.ext_macro_f1(p, "t", "g").first()
    assert (r.accuracy, r.macro_f1) == (0.75, round((2 / 3 + 0.8) / 2, 6))


def test_author_weight_keeps_every_post(spark):
    d = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "who string")
    got = sorted((r.who or "", r.weight) for r in extensions.ext_author_weight(d, "who", 2).collect())
    assert got == [("", 1.0), ("a", 2 / 3), ("a", 2 / 3), ("a", 2 / 3), ("b", 1.0)]


def test_documented_extensions(spark):
    import hashlib
    import hmac

    d = spark.createDataFrame([("site", "누구"), ("s", None)], "s string, a string")
    for secret in (b"key", b"k" * 100):
        got = d.select(extensions.ext_pseudonym(F.col("s"), F.col("a"), secret)).collect()
        assert [r[0] for r in got] == [hmac.new(secret, "site누구".encode(), hashlib.sha256).hexdigest(), None]
    rows = [(datetime(2026, 8, d), k) for d in (1, 20) for k in ("raw", "derived")]
    kept = extensions.ext_retain(spark.createDataFrame(rows, "t timestamp_ntz, k string"), "t", "k", F.to_timestamp_ntz(F.lit("2026-08-21 00:00:00")), {"raw": 7})
    assert sorted((r.t.day, r.k) for r in kept.collect()) == [(1, "derived"), (20, "derived"), (20, "raw")]
    assert [r[0] for r in spark.range(2, 5).select(extensions.ext_status(F.col("id"), 4)).collect()] == ["INSUFFICIENT_DATA", "INSUFFICIENT_DATA", "OK"]
    m = extensions.ext_tickers(spark.createDataFrame([("삼전",), ("x",)], "a string"), "a", spark.createDataFrame([("삼전", "005930")], "alias string, ticker string"))
    assert sorted((r.a, r.ticker) for r in m.collect()) == [("x", None), ("삼전", "005930")]
