import json

import pytest
from pyspark.sql import functions as F

from pulseloom import sinks
from pulseloom.operators.incremental import NothingAccepted, NoTradingDays
from pulseloom.plans.collector import PagesIncomplete, Run, collect_run
from pulseloom.sources import broker_pages

AS_OF = "2026-04-16T18:00:00+09:00"


def bar(time, close, **kw):
    return {"cur_prc": str(close), "trde_qty": "10", "open_pric": "640", "high_pric": "655", "low_pric": "637", "cntr_tm": time} | kw


def pages(spark, *rows):
    return spark.createDataFrame([(d, i, json.dumps({broker_pages.TABLE: r})) for i, (d, r) in enumerate(rows)], "day string, page long, body string")


def stored(timestamp, close, observed):
    return {"timestamp": timestamp, "market": "KOSPI", "instrumentId": "001", "symbol": "KOSPI", "assetType": "index", "open": 640, "high": 660, "low": 630, "close": close, "volume": None, "changeRate": 0.4, "source": "s", "provider": "broker", "observedAt": observed, "dataMode": "real"}


OLD = [stored("2026-04-14T09:00:00+09:00", 641.0, "2026-04-14T20:00:00+09:00"), stored("2026-04-14T10:00:00+09:00", 642.0, "2027-01-01T00:00:00+09:00"), stored("2026-04-10T10:00:00+09:00", 643.0, "2026-04-11T00:00:00+09:00")]
GOOD = [("20260414", [bar("20260414090500", 650), bar("20260414100500", 651), bar("20260413100500", 1), bar("x", 2)]), ("20260415", [bar("20260415150100", 652, trde_qty=None), bar("20260415155000", 3), bar("20260415093000", 4, low_pric="0")]), ("20260401", [bar("20260401100500", 641)])]


@pytest.fixture
def files(tmp_path):
    out, meta = tmp_path / "d" / "series.jsonl", tmp_path / "d" / "meta.json"
    out.parent.mkdir()
    out.write_text("\n".join([*map(json.dumps, OLD), "{bad"]))
    meta.write_text('{"old": true}')
    return out, meta


def run(files, **kw):
    return Run(**({"first": "2026-04-10", "last": "2026-04-16", "output": f"file://{files[0]}", "metadata": f"file://{files[1]}", "as_of": AS_OF} | kw))


def test_a_run(spark, files):
    got = collect_run(spark, pages(spark, *GOOD), run(files))
    m = json.loads(files[1].read_text())
    lines = [json.loads(x) for x in files[0].read_text().splitlines()]
    assert got["status"] == "OK" and got["records"] == 4 and got["requestedDates"] == ["2026-04-14", "2026-04-15", "2026-04-16"] and len(m) == 26
    # the newest observed stays: the fresh 9 o'clock, the stored 10 o'clock; 15 o'clock is a half hour without a whole volume
    assert [(x["timestamp"][8:13], x["close"]) for x in lines] == [("10T10", 643.0), ("14T09", 650.0), ("14T10", 642.0), ("15T15", 652.0)]
    assert lines[-1]["volume"] is None and lines[-1]["isPartial"] and lines[1]["volume"] == 10.0
    assert (m["recordsReceived"], m["recordsAccepted"], m["recordsRejected"], m["duplicatesRemoved"], m["partialBuckets"], m["requestsMade"]) == (7, 3, 5, 1, 1, 2)
    assert (m["effectiveFrom"], m["effectiveTo"], m["existingLatestTimestamp"], m["warnings"]) == ("2026-04-14", "2026-04-15T15:00:00+09:00", "2026-04-14T10:00:00+09:00", ["no bar on 2026-04-16"])
    # the same pages again change nothing
    before = files[0].read_bytes()
    collect_run(spark, pages(spark, *GOOD), run(files, overlap_hours=48))
    assert files[0].read_bytes() == before
    forced = collect_run(spark, pages(spark, *GOOD), run(files, force=True, first="2026-04-01"))
    assert forced["records"] == 4 and forced["metadata"]["existingLatestTimestamp"] == "" and forced["metadata"]["requestsMade"] == 3


def test_refusals_leave_both_files_as_they_are(spark, files):
    before = [f.read_bytes() for f in files]
    fault = spark.createDataFrame([("20260415", "repeated_key")], "day string, reason string")
    empty = pages(spark, ("20260415", [bar("x", 1)]))
    good = pages(spark, *GOOD)
    for error, args, kw in ((ValueError, (good,), {"first": "2025-12-31"}), (NoTradingDays, (good,), {"first": "2026-04-18", "last": "2026-04-19"}), (NothingAccepted, (empty,), {}), (NothingAccepted, (good.limit(0),), {}), (PagesIncomplete, (good,), {"faults": fault})):
        faults = kw.pop("faults", None)
        with pytest.raises(error):
            collect_run(spark, *args, run(files, **kw), faults)
        assert [f.read_bytes() for f in files] == before
    assert collect_run(spark, good, run(files, dry_run=True)) == {"dryRun": True, "requestedDates": ["2026-04-14", "2026-04-15", "2026-04-16"], "recordsReceived": 7, "recordsAccepted": 3, "recordsRejected": 4}
    assert [f.read_bytes() for f in files] == before and sorted(p.name for p in files[0].parent.iterdir() if not p.name.startswith(".")) == ["meta.json", "series.jsonl"]


def test_two_files_move_together(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.write_text("a")
    two.write_text("b")
    staged = [sinks.stage_text(spark, x, f"file://{p}") for x, p in (("A", one), ("B", two))]
    (tmp_path / staged[1].rsplit("/", 1)[-1]).unlink()
    with pytest.raises(Exception, match="(?i)cannot move|not exist"):
        sinks.commit(spark, [(staged[0], f"file://{one}"), (staged[1], f"file://{two}")])
    assert (one.read_text(), two.read_text()) == ("a", "b") and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["one", "two"]
    folder = spark.range(5).select(F.col("id"))
    sinks.write_jsonl(folder, f"file://{tmp_path}/many", ["id"], single_file=False)
    assert sorted(json.loads(x)["id"] for p in (tmp_path / "many").glob("part-*") for x in p.read_text().splitlines()) == list(range(5))


def test_bars_of_one_second_keep_their_order(spark, files):
    """Microseconds decide between bars of one second, whatever pages they stand on; what is no fraction counts as none."""
    late, early = bar("20260414090500", 650, cntr_us="900000"), bar("20260414090500", 640, open_pric="639", cntr_us="100000")
    collect_run(spark, pages(spark, ("20260414", [late]), ("20260414", [early, bar("20260414090500", 645, open_pric="638", cntr_us="x")])), run(files, force=True))
    (line,) = [json.loads(x) for x in files[0].read_text().splitlines()]
    assert (line["open"], line["close"]) == (638.0, 650.0)
