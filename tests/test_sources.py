import json
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulseloom import sinks
from pulseloom.functions import text
from pulseloom.operators.bars import hourly_from_rows
from pulseloom.plans import pipeline
from pulseloom.sources import broker_pages, html, market_files, posts

AS_OF = "2026-04-14T12:00:00+09:00"


def test_market_files(spark, tmp_path):
    ticks = [("09:07", "412.5"), ("09:21", "418.0"), ("09:52", "409.25"), ("10:14", "421.0")]
    rows = [{"timestamp": f"2026-04-14T{t}:00+09:00", "price": p} for t, p in ticks]
    (tmp_path / "a.json").write_text(json.dumps(rows + [5]))
    (tmp_path / "b.JSON").write_text(json.dumps({"meta": 1, "ticks": [{"ts": "2026-04-14 11:00", "close": 1, "open": 1, "high": 2, "low": 1}]}))
    (tmp_path / "c.jsonl").write_text('{"time": "2026-04-14 12:00", "price": 7, "volume": "x"}\n\nbroken\n[1]\n')
    (tmp_path / "d.csv").write_text("﻿timestamp,현재가,volume\n2026-04-14 13:00,8,5\n", encoding="utf-8")
    (tmp_path / "e.json").write_text("{bad")
    (tmp_path / "f.txt").write_text("x")
    d = market_files.resolve(market_files.read_folder(spark, str(tmp_path)))
    got = hourly_from_rows(d, observed_at=F.lit(AS_OF))[0].collect()
    assert [(r.timestamp[11:13], r.open, r.high, r.low, r.close) for r in got] == [("09", 412.5, 418.0, 409.25, 409.25), ("10", 421.0, 421.0, 421.0, 421.0), ("11", 1.0, 2.0, 1.0, 1.0), ("12", 7.0, 7.0, 7.0, 7.0), ("13", 8.0, 8.0, 8.0, 8.0)]
    assert market_files.read_file(spark, str(tmp_path / "f.txt")).count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        market_files.read_file(spark, str(tmp_path / "none.json")).count()


def test_strict_and_existing(spark, tmp_path):
    good = {"timestamp": "2026-04-14T10:00:00+09:00", "market": "KOSPI", "instrumentId": "001", "symbol": "KOSPI", "assetType": "index", "open": 640, "high": 655, "low": 637, "close": 648, "volume": None, "changeRate": 0.42, "source": "s", "provider": "broker", "observedAt": "o", "dataMode": "real"}
    rows = [good, good | {"close": 649}, good | {"instrumentId": "101"}, good | {"timestamp": "2026-04-14T09:00:00+09:00"}, good | {"open": None}]
    path = tmp_path / "h.jsonl"
    path.write_text("\n".join([*map(json.dumps, rows), "{bad"]))
    kept, classified = market_files.read_strict(spark, str(path), "broker")
    assert [(r.timestamp[11:13], r.close) for r in kept.collect()] == [("09", 648.0), ("10", 649.0)]
    assert classified.filter("reject_reason is not null").count() == 2
    ok, bad = market_files.load_existing(spark, str(path))
    assert ok.count() == 4 and bad.count() == 2
    target = tmp_path / "out" / "h.jsonl"
    for _ in range(2):
        sinks.write_jsonl(sinks.to_contract(ok.drop("seq").dropDuplicates(["timestamp", "instrument_id"])), f"file://{target}", ["timestamp"])
    lines = [json.loads(x) for x in target.read_text().splitlines()]
    assert [x["timestamp"][11:13] for x in lines] == ["09", "10", "10"] and "volume" in lines[0] and "changeRate" in lines[0]
    assert not [p for p in target.parent.iterdir() if p.name.endswith((".tmp", ".old"))]


def test_broker_pages(spark):
    bar = {"cur_prc": "-648", "trde_qty": "10", "open_pric": "+640", "high_pric": "655", "low_pric": "637", "acc_trde_qty": "999"}
    page = {"return_code": 0, broker_pages.TABLE: [bar | {"cntr_tm": "20260414150000"}, bar | {"cntr_tm": "20260413150000"}, bar | {"cntr_tm": "20260414151000", "trde_qty": None}, bar | {"cntr_tm": "x"}, bar | {"cntr_tm": "20260414100000", "low_pric": "0"}]}
    pages = spark.createDataFrame([("20260414", 0, json.dumps(page)), ("20260414", 1, '{"inds_min_pole_qry": 3}')], "day string, page int, body string")
    c = broker_pages.classify(broker_pages.page_rows(pages))
    n = broker_pages.run_counters(c).first()
    assert (n.received, n.accepted, n.rejected, n.target_date, n.other_date, n.invalid_time, n.invalid_price, n.partial_buckets) == (5, 2, 3, 3, 1, 1, 1, 1)
    r = broker_pages.collect_hours(c).first()
    assert n.out_of_session == 0 and n.hourly_records == 1
    counters = n.asDict() | {"duplicates_removed": 2}
    series = broker_pages.collect_hours(c).select(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss'+09:00'").alias("timestamp"))
    m = sinks.run_metadata(counters, series, ("2026-04-13", "2026-04-14"), "now", "broker", 3, 8, "", "2026-04-13T15:00:00+09:00", ("w",))
    assert len(m) == 26 and (m["recordsReceived"], m["recordsAccepted"], m["recordsRejected"], m["duplicatesRemoved"], m["partialBuckets"]) == (5, 1, 3, 2, 1)
    assert m["latestTimestamp"] == m["effectiveTo"] == m["effectiveFrom"] == "2026-04-14T15:00:00+09:00" and m["provider"] == "broker" and m["warnings"] == ["w"]
    assert (r.open, r.high, r.low, r.close, r.volume, r.is_partial) == (640.0, 655.0, 637.0, 648.0, None, True)


LIST = '<div><a class="post-link" href="/p/1" data-id="1">하나</a><span class="views">2,718</span><span class="comments-count">3</span><time class="published" datetime="2026-04-14T09:25:00+09:00">x</time><a class="post-link" href="/p/2" data-id="2"> </a></div>'
POST = '<article class="post"><h1 class="title">봄 소풍</h1><div class="body">아침에 <b>하나</b></div><span class="views">2,718</span><span class="recommends">31</span><span class="comments-count">9</span><div class="comment"><span class="author">x</span><div class="body">댓글</div></div><div class="comment"><div class="body">둘</div></div></article>'
BOARD = '<html><head><meta property="og:url" content="/8800553?x=1"></head><body><article class="bd_doc"><h1 class="title">날씨 이야기</h1><div class="rd_body"> 아침에  문 </div><span class="view_cnt">2,718</span><span class="recommend_cnt">-4</span><span class="comment_cnt">2</span><time datetime="2026-04-14T09:41:00+09:00">x</time><div class="cmt_list"><div class="cmt_item"><div class="cmt_content">일</div></div><div class="reply_list"><div class="cmt_item reply"><div class="cmt_content">이</div></div></div></div></article></body></html>'
GONE = '<h1 class="title">존재하지 않는 게시글</h1><time>어제 밤</time>'
LINKS = '<a href="/hint-900000017">도움말 모음</a><a href="/880055380">점심 이야기</a><a href="/x?document_srl=880055381">둘</a><a href="/12">짧다</a><a href="/8800553"></a>'


def pages(spark, *rows):
    return spark.createDataFrame(rows, "post_id string, html string")


def test_html(spark):
    one = html.parse_lists(pages(spark, ("", LIST), ("", ""))).collect()
    assert [(r.post_id, r.title, r.views, r.comment_count, r.published_at) for r in one] == [("1", "하나", 2718, 3, "2026-04-14T09:25:00+09:00")]
    p = html.parse_posts(pages(spark, ("", POST))).first()
    assert (p.title, p.body, p.views, p.recommendations, p.comment_count, [c.body for c in p.comments]) == ("봄 소풍", "아침에 하나", 2718, 31, 2, ["댓글", "둘"])
    b = html.parse_posts(pages(spark, ("8800553", BOARD), ("4400771", GONE), ("9", "<p>nothing</p>"), (None, BOARD)), "board", "https://s.example").collect()
    assert [(r.post_id, r.title, r.body, r.views, r.recommendations, r.comment_count, r.published_at, r.deleted) for r in b] == [("8800553", "날씨 이야기", "아침에 문", 2718, -4, 2, "2026-04-14T09:41:00+09:00", False), ("4400771", "존재하지 않는 게시글", "", 0, 0, 0, None, True)]
    assert [c.depth for c in b[0].comments] == [0, 1] and b[0].url == "https://s.example/8800553" and b[0].content_hash.startswith("sha256:")
    assert p.comments[0].author == "x" and p.comments[1].author is None
    links = html.parse_lists(pages(spark, ("", LINKS)), "board", "https://s.example").collect()
    assert [(r.post_id, r.url) for r in links] == [("900000017", "https://s.example/hint-900000017"), ("880055380", "https://s.example/880055380"), ("880055381", "https://s.example/x?document_srl=880055381")]


def test_html_one_worker_a_task(spark):
    """What composes only once zero-width characters are gone is composed in the parser's worker, as in the columns of ``functions.text``."""
    parts = "<h1 class='title'>cafe{0} {1}</h1><div class='rd_body'>e{0}\u0301 x</div><div class='cmt_item'><div class='xe_content'>o{0}\u0308</div></div>"
    rows = [(str(i), parts.format(z, w)) for i, (z, w) in enumerate([("\u200b", "a"), ("\u200b", "삭\u200b\u1100제된 게시물"), ("", "삭제된 게시물"), ("\u200b", unicodedata.normalize("NFD", "삭제된 게시물"))])]
    p = html.parse_posts(pages(spark, *rows), "board")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    by_columns = text.content_hash(F.col("post_id"), F.col("title"), F.col("body"), F.expr("transform(comments, c -> c.body)"))
    gone = text.normalize(F.concat_ws(" ", "title", "body")).rlike("(?U)" + html.DELETED)
    got = p.orderBy("post_id").select("content_hash", by_columns.alias("want"), "deleted", gone.alias("gone"), "body").collect()
    assert [r.content_hash for r in got] == [r.want for r in got] and len({r.want for r in got}) == 4
    assert [r.deleted for r in got] == [r.gone for r in got] == [False, False, True, True]
    assert [unicodedata.is_normalized("NFC", r.body) for r in got] == [False, False, True, False]


def test_html_dates_and_depth(spark):
    def dated(*times):
        return "<h1 class='title'>t</h1>" + "".join(f"<time{f' datetime={a!r}' if a else ''}>{x}</time>" for a, x in times)

    at = "2026-04-14T09:41:00+09:00"
    rows = pages(spark, ("1", dated(("soon", at))), ("2", dated(("2026-04-14T09:41:00", "later"), (at, ""))), ("3", dated((None, "2026-04-14T09:41:00"))))
    assert [r.published_at for r in html.parse_posts(rows, "board").orderBy("post_id").collect()] == [at, at, None]
    deep = "<div>" * 30_000 + "<a class='post-link' data-id='4' href='/p/4'>below</a>" + "</div>" * 30_000
    assert [r.title for r in html.parse_lists(pages(spark, ("", deep))).collect()] == ["below"]
    assert html.links(pages(spark, ("", deep))).first().title == "below"
    post = "<article class='post'><h1 class='title'>deep</h1><div class='body'>" + "<b>" * 5000 + "text</article>"
    assert html.parse_posts(pages(spark, ("", post))).first().body == "text"


@pytest.mark.parametrize("unit", ["<div class='comment'><div class='body'>x", "<div class='body'>x ", "<div class='cmt_item'><div class='cmt_content'>y ", "<div class='rd_body'>", "<li class='fdb_itm'><ul>", "<span class='views'>1 <em class='view_cnt'>2", "<h1 class='title'> ", "<a class='post-link' href='/1'>z", "<time class='published'>", "</b></i>", "<article class='bd_doc'>"])
def test_hostile_pages_take_linear_time(unit):
    import time

    page = "<article class='post'>" + unit * (40_000 // unit.count("<")) + "w " * 100_000
    for parser in (html.simple_list, html.simple_post, html.board_list, html.board_post):
        began = time.perf_counter()
        parser(page)
        assert time.perf_counter() - began < 10
        assert parser(None) is not None


def test_a_large_page():
    import time

    page = "<article class='post'><h1 class='title'>t</h1><div class='body rd_body'>" + "<p>some words <b>here</b></p>\n" * 120_000 + "</div></article>"
    assert len(page) > 3_000_000
    began = time.perf_counter()
    assert html.simple_post(page)[0]["body"] == " ".join(["some words here"] * 120_000)
    assert len(html.board_post(page)[0]["body"]) == 16 * 120_000 - 1
    assert time.perf_counter() - began < 60


def test_nested_comments_keep_their_words():
    page = "<article class='post'><div class='body'>a <div class='comment'><div class='body'>b<div class='comment'><div class='body'>c</div></div>d</div></div>e</div></article>"
    p = html.simple_post(page)[0]
    assert (p["body"], [c["body"] for c in p["comments"]], p["comment_count"]) == ("a e", ["b d", "c"], 2)
    board = "<ul><li class='fdb_itm' id='comment_7'><div class='xe_content'>b <ul><li class='fdb_itm'><div class='xe_content'>c</div></li></ul>d</div></li></ul>"
    p = html.board_post(board)[0]
    assert [(c["id"], c["depth"], c["body"]) for c in p["comments"]] == [("7", 0, "b d"), (None, 1, "c")]
    assert html.simple_list("<a class='post-link' data-id='1'>one<a class='post-link' data-id='2'>two</a><span class='views'>" + "9" * 40 + "</span>")[1]["views"] == 0
    assert [p["title"] for p in html.simple_list("<a class='post-link'>one<b>x<a class='post-link'>two</a>")] == ["onex", "two"]


def test_html_page_fails_alone(spark):
    def parser(page):
        if page == "bad":
            raise ValueError("no page")
        return html.simple_post(page)

    named = pages(spark, ("a", "bad"), ("b", POST)).withColumnRenamed("post_id", "page")
    parsed = html._parse(named, parser, ["page"])
    assert [(r.page, r.title, r.error) for r in parsed.orderBy("page").collect()] == [("a", "", "ValueError: no page"), ("b", "봄 소풍", None)]
    assert [r.page for r in html._good(parsed).collect()] == ["b"]
    assert html.page_errors(pages(spark, ("b", POST)), detail=True).count() == 0


def live(**kw):
    return json.dumps({"source": "board", "dataMode": "real", "sourcePostId": "1", "title": "상승", "body": "", "firstSeenAt": AS_OF, "comments": [{"body": "매수"}]} | kw)


def test_live_posts_fail_closed(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text(live() + "\n\n" + live(sourcePostId="2"))
    d = posts.load_live_posts(spark, str(path), "board")
    assert [r.post_id for r in d.collect()] == ["1", "2"] and d.first().comments[0].body == "매수"
    for bad, why in (("{", "line 2: is not valid"), (live(source="x"), "line 2: source"), (live(dataMode="sample"), "line 2: dataMode")):
        path.write_text(live() + "\n" + bad)
        with pytest.raises(ValueError, match=why):
            posts.load_live_posts(spark, str(path), "board")


def test_pipeline(spark, tmp_path):
    out = pipeline.run(spark, pipeline.Config(as_of=AS_OF), f"file://{tmp_path}")
    assert len(out["joined"]) == 8 and out["summary"]["totalPosts"] == 5 and out["summary"]["dataMode"] == "sample"
    assert out["joined"][0]["marketNormalized"] == 100.0 and out["joined"][-1]["hasSentiment"] and out["overnight"]["status"] == "unavailable"
    saved = json.loads((tmp_path / "api" / "data.json").read_text())
    assert saved == out and not any("_" in k for r in saved["joined"] for k in r)
    whole = json.loads((tmp_path / "pipeline_output.json").read_text())
    assert len(whole["marketRecords"]) == 8 and whole["summary"] == out["summary"]
    with pytest.raises(ValueError, match="path"):
        pipeline.run(spark, pipeline.Config(as_of=AS_OF, market="strict"))


def test_stream(spark, tmp_path):
    from pulseloom.streaming.hourly import ext_stream_index

    rows = [("2026-04-14 09:05:00", "positive", 0.9), ("2026-04-14 09:10:00", "unrelated", 0.3), ("2026-04-14 10:10:00", "negative", 0.9), ("2026-04-15 12:00:00", "neutral", 0.5)]
    spark.createDataFrame(rows, "t string, direction string, confidence double").select(F.col("t").cast("timestamp_ntz").alias("ts"), "direction", "confidence").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp_ntz, direction string, confidence double").parquet(f"{tmp_path}/in")
    q = ext_stream_index(s).writeStream.outputMode("append").format("memory").queryName("stream_index").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.post_count, r.sentiment_index) for r in spark.table("stream_index").orderBy("hour").collect()]
    assert got == [(2, 100.0), (1, 0.0)]


def _cut(spark, texts, every):
    """Files in pieces, cut behind each ``every``-th line feed."""
    rows = []
    for file, text in texts.items():
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + [lines[-1]]
        rows += [(file, i - 5, "".join(lines[i : i + every])) for i in range(0, len(lines), every)]
    return spark.createDataFrame(rows, "file string, part int, text string").repartition(3)


def _same_rows(read, spark, texts):
    shown = lambda d: sorted((r.file, r.pos, sorted(r.raw.items())) for r in d.collect())
    want = shown(read(spark.createDataFrame(list(texts.items()), "file string, text string")))
    assert len(want) > 20 and all(shown(read(_cut(spark, texts, n))) == want for n in (1, 3))


def test_csv_in_pieces(spark):
    """A file in pieces has the rows of the whole file: quoted line feeds, odd quotes, blank lines, short and long records, a mark and a missing last line feed."""
    body = 'a,"b\n""x"",\n\n",c\r\n\r\n1,2,3\n"q"r"s,5\n x"y,"z\n",9,10\n\n7\n"\n",",\n' * 3
    _same_rows(market_files.csv_rows, spark, {"a": "﻿k,\"l\nl\",k\r\n" + body, "b": "k,l\n" + body + '"open\nto the end\n', "c": "\n" + body, "d": "", "e": "k\n" + body + "last"})


def test_json_in_pieces(spark):
    """A document in pieces has the rows of the whole one: lists under several names, items over lines, brackets in strings, objects that are no items, and damage."""
    item = '{"a": 1, "b": "]},{[\\""},\n{"a": [1,\n{"c": 2}]},\n5, "s", {"a": null}\n,{"z": {"y":\n{"x": 1}\n}}'
    listed = f"[\n{item},\n{item}\n]"
    texts = {"a": listed, "b": f'{{"ticks": {listed},\n"data": [\n{item}\n], "n":\n{{"a": 2}}\n}}', "c": f'{{"k": {{"a": 1,\n"m":\n{{"a": 3}}\n}},\n"other": {listed}}}', "d": listed + "\n{", "e": f"[\n{item}\n{item}\n]", "f": f'﻿{{"prices": [], "records": {listed}}}', "g": "", "h": f"[\n{item},\n{{bad}},\n{item}]"}
    _same_rows(market_files.json_rows, spark, texts)
