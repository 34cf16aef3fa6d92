import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import intervals

T0 = datetime(2026, 4, 14, 9)
SPAN = "{0}_id long, k string, {0}_a timestamp_ntz, {0}_z timestamp_ntz"


def seconds(n):
    return None if n is None else T0 + timedelta(seconds=n)


def no_loops(df):
    plan = df._jdf.queryExecution().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("hot_rows", [1 << 20, 5])
def test_within_before(spark, hot_rows):
    rng = random.Random(1)
    points = [(i, rng.choice(["a", "b", None]), rng.randrange(0, 20_000) if i % 17 else None) for i in range(300)] + [(999, "a", 3600), (999, "a", 3600), (998, "a", 0)]
    marks = [(i, rng.choice(["a", "b", None]), rng.randrange(0, 20_000)) for i in range(60)] + [(90, "a", 3600), (91, "b", None), (92, "a", 7200)]
    p = spark.createDataFrame([(i, k, seconds(t)) for i, k, t in points], "p long, k string, ts timestamp_ntz")
    m = spark.createDataFrame([(i, k, seconds(t)) for i, k, t in marks], "m long, k string, mark timestamp_ntz")
    df = intervals.ext_within_before(p, m, ["k"], "ts", "mark", 60, hot_rows=hot_rows)
    want = sorted((a, b) for a, k, t in points for b, j, u in marks if k is not None and k == j and t is not None and u is not None and u - 3600 <= t < u)
    assert sorted((r.p, r.m) for r in df.collect()) == want and len(want) > 100
    assert no_loops(df) and intervals.ext_within_before(p.limit(0), m, ["k"], "ts", "mark", 60).count() == 0


@pytest.mark.parametrize("hot_rows", [1 << 20, 7])
def test_overlapping(spark, hot_rows):
    rng = random.Random(2)

    def spans(n):
        out = [(i, rng.choice("ab"), a := rng.randrange(-5000, 50_000), a + rng.choice([0, 1, 5, 300, 7000, -4, 90_000])) for i in range(n)]
        return out + [(n, "a", 0, 10), (n + 1, "a", 10, 20), (n + 2, "b", None, 5), (n + 3, None, 0, 5), (n, "a", 0, 10), (n + 4, "a", 0, 10**9)]

    left, right = spans(120), spans(100)
    df = intervals.ext_overlapping(*[spark.createDataFrame([(i, k, seconds(a), seconds(z)) for i, k, a, z in s], SPAN.format(n)) for n, s in (("l", left), ("r", right))], ["k"], ("l_a", "l_z"), ("r_a", "r_z"), hot_rows=hot_rows)
    whole = [[s for s in side if s[1] is not None and s[2] is not None and s[2] < s[3]] for side in (left, right)]
    want = sorted((x[0], y[0]) for x in whole[0] for y in whole[1] if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r.l_id, r.r_id) for r in df.collect()) == want and len(want) > 500
    assert no_loops(df)
    none = spark.createDataFrame([], SPAN.format("l"))
    assert intervals.ext_overlapping(none, none.withColumnsRenamed({f"l_{c}": f"r_{c}" for c in ("id", "a", "z")}), ["k"], ("l_a", "l_z"), ("r_a", "r_z")).count() == 0


def test_overlapping_sends_spans_once(spark, monkeypatch):
    """Keys of few rows are sent without bins, those of many rows on levels that are a home on their other side only, and no side is shuffled for the table of hot bins."""
    rng = random.Random(4)
    lengths = {"few": (1, 60, 3600, 90_000), "many": (50, 60), "long": (200_000,), "alone": (1, 60, 3600, 90_000)}

    def spans(keys, n):
        return [(i, k, a := rng.randrange(0, 50_000), a + rng.choice(lengths[k])) for i, k in enumerate(k for k in keys for _ in range(n if k == "many" else 20))]

    left, right = spans(("few", "many", "long", "alone"), 90), spans(("few", "many", "long"), 80)
    sent = []
    split = intervals.split_hot
    monkeypatch.setattr(intervals, "split_hot", lambda p, m, *rest: sent.extend((p, m)) or split(p, m, *rest))
    sides = [spark.createDataFrame([(i, k, seconds(a), seconds(z)) for i, k, a, z in s], SPAN.format(n)) for n, s in (("l", left), ("r", right))]
    df = intervals.ext_overlapping(*sides, ["k"], ("l_a", "l_z"), ("r_a", "r_z"), few_rows=100)
    assert sorted((r.l_id, r.r_id) for r in df.collect()) == sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    for side, rows in zip(sent, (left, right), strict=True):
        n = {r.k: r["count"] for r in side.groupBy("k").count().collect()}
        assert n["few"] == n["long"] == 20 and n["many"] <= 2 * sum(r[1] == "many" for r in rows)
    one_sided = intervals.ext_overlapping(*sides, ["k"], ("l_a", "l_z"), ("r_a", "r_z"), few_rows=5)
    assert one_sided.count() == df.count() and sent[2].filter("k = 'alone'").count() == 0
    hot = intervals.split_hot(*sides, ["k"], 10)[0]
    assert "strategy=broadcast" in hot._jdf.queryExecution().optimizedPlan().toString()


def test_forward_value(spark):
    rng = random.Random(3)
    right = [(rng.choice("ab"), rng.randrange(400_000), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(150)]
    left = [(i, rng.choice(["a", "b", None]), rng.randrange(400_000)) for i in range(100)] + [(7, "a", right[0][1] - 300)]
    ls = spark.createDataFrame([(i, k, seconds(t)) for i, k, t in left], "id long, k string, ts timestamp_ntz")
    rs = spark.createDataFrame([(k, seconds(t), v) for k, t, v in right], "k string, ts timestamp_ntz, v double")
    got = sorted(map(tuple, intervals.ext_forward_value(ls, rs, ["k"], "ts", "v", (5, 60), 30).collect()), key=str)

    def after(k, t):
        hits = sorted((u, v) for j, u, v in right if j == k and v is not None and u >= t)
        return hits[0][1] if hits and hits[0][0] <= t + 1800 else None

    assert got == sorted(((i, k, seconds(t), after(k, t + 300), after(k, t + 3600)) for i, k, t in left), key=str)
    assert any(r[3] for r in got) and any(r[3] is None for r in got)


def test_next_session(spark):
    when = ["2026-04-30 16:00", "2026-04-30 15:29", "2026-04-30 15:30", "2026-05-01 10:00", "2026-05-04 08:59", "2026-05-04 09:00", "2026-05-05 00:00", "2026-04-30 08:00"]
    p = spark.createDataFrame([(i, datetime.fromisoformat(w)) for i, w in enumerate(when)], "id int, ts timestamp_ntz")
    h = spark.createDataFrame([(datetime(2026, 5, 4, 9), 7.0), (datetime(2026, 4, 30, 9), 8.0)], "hour timestamp_ntz, v double")
    got = {r.id: (r.session_hour and r.session_hour.isoformat()[:13], r.session_value) for r in intervals.ext_next_session(p, h, "ts", "hour", "v", "2026-04-30", "2026-05-06").collect()}
    monday, wednesday = ("2026-05-04T09", 7.0), ("2026-05-06T09", None)
    assert got == {0: monday, 1: (None, None), 2: monday, 3: monday, 4: monday, 5: (None, None), 6: wednesday, 7: ("2026-04-30T09", 8.0)}
    assert [r.next_day for r in intervals.next_sessions(spark, "2026-05-01", "2026-05-01").collect()] == [date(2026, 5, 4)]
    assert p.select(F.count("id")).first()[0] == len(when)
