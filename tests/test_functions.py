import hashlib

import pytest
from pyspark.sql import functions as F

from pulseloom.functions import labels, parse, sentiment, text, timefn
from pulseloom.operators import bars


def column(spark, values, *exprs, kind="string"):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(*exprs).collect()]


V = None


@pytest.fixture(autouse=True)
def _column(spark):
    globals()["V"] = F.col("v")


def test_times(spark):
    got = column(spark, ["2026-08-05T00:05:00+00:00", "2026-08-05 09:10", "2026/8/5 9:10:05", "20260805", "20260805101112", "2026-08-05T00:15:30.25Z", "10:00", "2026", "2026-13-01", "x", "", None], timefn.iso(timefn.kst(V)))
    assert [g[0] for g in got] == [
        "2026-08-05T09:05:00+09:00", "2026-08-05T09:10:00+09:00", "2026-08-05T09:10:05+09:00", "2026-08-05T00:00:00+09:00", "2026-08-05T10:11:12+09:00",
        "2026-08-05T09:15:30.250000+09:00", None, None, None, None, None, None,
    ]


def test_absolute_datetimes(spark):
    good = ["2026-08-05T09:15:00+09:00", "2026-08-05T00:15:00Z"]
    bad = ["3분 전", "방금", "2026-08-05", "2026-08-05T09:15", "", None]
    got = column(spark, good + bad, timefn.absolute_datetime(V))
    assert [g[0] for g in got] == good + [None] * len(bad)


def test_bar_times(spark):
    day = F.lit("20260805")
    values = ["20260805150000", "20260804150000", "20260805240000", "20260805156000", "20260805150060", "091500", "0915", "256000", " 0915", "09:15", "", None]
    got = column(spark, values, timefn.bar_time_status(V, day), timefn.iso(timefn.bar_time(V, day)))
    assert [g[0] for g in got] == ["target", "other_date", "invalid", "invalid", "invalid", "target", "target", "target", "invalid", "invalid", "invalid", "invalid"]
    assert [g[1] for g in got] == ["2026-08-05T15:00:00+09:00", None, None, None, None, "2026-08-05T09:15:00+09:00", "2026-08-05T09:15:00+09:00", None, None, None, None, None]


def test_session_and_calendar(spark):
    ts = timefn.kst(V)
    got = column(spark, ["2026-08-05 08:59", "2026-08-05 09:00", "2026-08-05 15:20", "2026-08-05 15:29:59", "2026-08-05 15:30"], timefn.in_session(ts), timefn.in_closing_auction(ts), timefn.is_partial(ts))
    assert got == [(False, False, False), (True, False, False), (True, True, True), (True, True, True), (False, False, False)]
    days = ["2026-05-01", "2026-06-03", "2026-07-17", "2026-12-31", "2026-06-30", "2026-12-30", "2026-08-08"]
    assert [g[0] for g in column(spark, days, timefn.is_trading_day(V))] == [False, False, False, False, True, True, False]


def test_numbers(spark):
    values = ["+3200.5", "-3200", "--1", "+-1", "0", "1e-5", "-1e-5", "+1e-5", "1_000", "NaN", "Infinity", " 5 ", "", "-", None, "1.5d"]
    got = column(spark, values, parse.price_magnitude(V), parse.nonnegative_number(V))
    assert [g[0] for g in got] == [3200.5, 3200.0, None, None, None, 1e-5, None, None, 1000.0, None, None, 5.0, None, None, None, None]
    assert [g[1] for g in got] == [3200.5, None, None, None, 0.0, 1e-5, None, None, 1000.0, None, None, 5.0, None, None, None, None]
    got = column(spark, ["89", "-3", "+15", "1,234", "조회 1 234", "abc", "", None], parse.signed_int(V), parse.nonnegative_int(V), parse.digits_int(V))
    assert [g[0] for g in got] == [89, -3, 15, 1234, 1234, None, None, None]
    assert [g[1] for g in got] == [89, None, 15, 1234, 1234, None, None, None]
    assert [g[2] for g in got] == [89, 3, 15, 1234, 1234, 0, 0, 0]


def test_aliases(spark):
    d = spark.createDataFrame([({"Time": "x", "price": None, "close": "3"},), ({"CLOSE": "4"},), ({},)], "m map<string,string>")
    m = F.col("m")
    got = [tuple(r) for r in d.select(parse.first_field(m, "timestamp", "time"), parse.first_field(m, "price", "close"), parse.is_candle(m)).collect()]
    assert got == [("x", None, True), (None, "4", False), (None, None, False)]


def test_urls(spark):
    got = column(spark, ["/index.php?mid=stock&page=2&document_srl=1234567&mid=b#x", "https://a.b/1234567?x=1", "//a.b/c", "q/12", "", None], parse.canonical_url(V, "https://s.example"), parse.document_id(V))
    assert got == [
        ("https://s.example/index.php?mid=stock&document_srl=1234567", "1234567"), ("https://a.b/1234567", "1234567"), ("https://a.b/c", None), ("https://s.example/q/12", None), ("", None), ("", None),
    ]


def test_http_status(spark):
    codes = [400, 405, 418, 451, 401, 403, 404, 410, 429, 500, 503, None, 200, 302]
    got = column(spark, codes, parse.http_status(V, F.lit("ok")), kind="int")
    assert [g[0] for g in got] == ["client_error"] * 4 + ["forbidden"] * 2 + ["deleted"] * 2 + ["rate_limited"] + ["server_error"] * 2 + ["network_error", "ok", "client_error"]
    assert column(spark, ["<p>reCAPTCHA"], parse.http_status(F.lit(200), V)) == [("captcha",)]


def test_scope():
    assert parse.tick_scope(60) == parse.tick_scope("60") == "60"
    for bad in ("05", " 60", 2, True, 1.0, None):
        with pytest.raises(ValueError):
            parse.tick_scope(bad)


def test_text(spark):
    assert column(spark, ["  A  B​ ", None, "é"], text.normalize(V)) == [("A B",), ("",), ("é",)]
    d = spark.createDataFrame([("7", " t ", None, ["a  b", None])], "i string, t string, b string, c array<string>")
    want = "sha256:" + hashlib.sha256("7\x1ft\x1f\x1fa b\x1f".encode()).hexdigest()
    assert d.select(text.content_hash(F.col("i"), F.col("t"), F.col("b"), F.col("c"))).first()[0] == want
    assert column(spark, ["<a href='x'>&\"", None], parse.html_escape(V)) == [("&lt;a href=&#39;x&#39;&gt;&amp;&quot;",), ("",)]


def reference_score(s):
    """Plain model of the lexicon classifier, for comparison."""
    low = s.lower()
    p, n, u = (sum(w.lower() in low for w in ws) for ws in (sentiment.POSITIVE, sentiment.NEGATIVE, sentiment.NEUTRAL))
    total = p + n + u
    if not total:
        return "unrelated", 0.0
    kind = "positive" if p > n and p > u else "negative" if n > p and n > u else "mixed" if p and n else "neutral"
    raw = {"positive": p / total, "negative": -n / total, "mixed": (p - n) / total, "neutral": 0.0}[kind]
    h = int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    return kind, round(max(-1.0, min(1.0, raw + (h % 100) / 1000 - 0.05)), 4)


def test_sentiment(spark):
    texts = ["급락 상승", "급등 상승 short", "관망 횡보세", "hello", "상승 하락", "추가매수 급반등", "", "Bull BEAR neutral"]
    d = spark.createDataFrame([(t,) for t in texts], "v string")
    got = sentiment.analyze(d, V).select("direction", "score", "targets", "confidence").collect()
    assert [(r[0], r[1]) for r in got] == [reference_score(t) for t in texts]
    assert got[3]["confidence"] == 0.3 and got[3]["targets"] == ["KOSPI"]
    assert column(spark, ["kospi nasdaq btc"], F.array_join(sentiment.market_targets(V), ",")) == [("KOSPI,NASDAQ,CRYPTO",)]


def test_labels(spark):
    got = column(spark, [None, 80.0, 60.0, 50.0, 40.0, 30.0, 25.0], labels.sentiment_label(V), labels.sentiment_class(V), kind="double")
    assert [g[0] for g in got] == [labels.NO_DATA, *(labels.LABELS[i] for i in (0, 1, 2, 3, 3, 4))]
    assert [g[1] for g in got] == ["flat", "up", "up", "flat", "down", "down", "down"]
    got = column(spark, [4.25, None], labels.change_text(F.lit(5.0), V), kind="double")
    assert got == [("지난 1시간 +0.8",), ("지난 1시간 –",)]


def test_identity(spark):
    rows = [("", "", None, True), ("005930", "", None, False), ("KOSPI200", "", None, True), ("005930", "", "Index ", True), ("KOSPI", "", "stock", False), ("9", "코스피", "other", True)]
    d = spark.createDataFrame(rows, "i string, s string, a string, want boolean")
    assert all(r[0] == r[1] for r in d.select(bars.is_index(F.col("i"), F.col("s"), F.col("a")), "want").collect())


def test_interpretation_prints_halves_and_keeps_every_hour(spark, sf):
    from pulseloom.plans.catalog import QUERIES, joined

    values = [k / 100 for k in range(10_001)]
    sentence = labels.interpretation(F.col("v"), F.lit(1), F.lit(1), F.lit(0.5), F.lit(False))
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", sentence.alias("s")).collect()
    assert len(rows) == len(values) and all(f"는 {r.v:.1f}로 " in r.s for r in rows)
    d = sf.replace("sf0.001", "sf0.01")
    index = [r.sentiment_index for r in joined(spark, d).select("sentiment_index").collect()]
    sentences = [r.sentence for r in QUERIES["interpretation"](spark, d).collect()]
    assert len(sentences) == len(index)
    shown = sorted(s.split("는 ")[1].split("로 ")[0] for s in sentences if s.startswith("현재"))
    assert shown == sorted(f"{i:.1f}" for i in index if i is not None)
