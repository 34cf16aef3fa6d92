import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseloom.functions import provider
from pulseloom.operators import decay, sketches
from pulseloom.sinks import merge_days

ROW = "k string, at string, observed_at string, v long, day date"


def stamps(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_merge_days_rewrites_only_what_changed(spark, tmp_path):
    rng = random.Random(3)
    days = [date(2026, 4, d) for d in range(1, 9)]

    def rows(n, among):
        return [(rng.choice("abc"), f"{rng.randrange(30):02}", f"2026-05-0{rng.randrange(1, 6)} 00:00:00", rng.randrange(99), rng.choice(among)) for _ in range(n)]

    target, best = tmp_path / "t", {}

    def fold(batch):
        # one row of a key and time of observation: the least
        for r in sorted(batch, key=lambda r: (r[2], -r[3])):
            key = (r[0], r[1], r[4])
            if key not in best or r[2] > best[key][2] or (r[2] == best[key][2] and id(best[key]) in now and r[3] < best[key][3]):
                best[key] = r
                now.add(id(r))

    def merge(batch):
        return merge_days(spark, f"file://{target}", spark.createDataFrame(batch, ROW), ["k", "at"], "day", ["at", "k"])

    for n, among in ((400, days), (40, days[2:4]), (30, [days[5], date(2026, 6, 1)])):
        batch, now = rows(n, among), set()
        before, was = stamps(target) if target.exists() else {}, dict(best)
        fold(batch)
        changed = merge(batch)
        assert set(changed) == {k[2] for k in best if best[k] is not was.get(k)}
        after = stamps(target)
        same = {f: m for f, m in before.items() if not any(f"day={d}" in f for d in changed)}
        assert same.items() <= after.items()
    stored = spark.read.parquet(str(target))
    assert sorted(tuple(r) for r in stored.select("k", "at", "observed_at", "v", "day").collect()) == sorted(best.values())
    # nothing new, nothing written
    before = stamps(target)
    assert merge([(k, a, o, v, d) for k, a, o, v, d in best.values()]) == [] and stamps(target) == before
    # inside a day, files are ranges in order
    for d in days:
        files = sorted((target / f"day={d}").glob("part-*"))
        read = [[(r["at"], r["k"]) for r in spark.read.parquet(str(f)).coalesce(1).collect()] for f in files]
        assert all(x == sorted(x) for x in read) and sum(read, []) == sorted(sum(read, []))
    assert merge([]) == []


@pytest.mark.parametrize(("half", "block"), [(24.0, 24.0), (0.01, 24.0), (100.0, 1.0), (3.0, 7.0)])
def test_decayed_sums(spark, half, block):
    rng = random.Random(4)
    t0 = datetime(2026, 4, 14)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.05 else t0 + timedelta(minutes=rng.randrange(-5000, 9000)), rng.choice([None, 1.0, -2.0, 5.0])) for _ in range(200)] + [("a", t0, 1.0)] * 2
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = sorted(map(tuple, decay.ext_decayed_sums(d, ["k"], "ts", ["v"], half, block).collect()), key=str)

    def direct(k, ts):
        return None if ts is None else sum((v or 0.0) * 0.5 ** ((ts - u).total_seconds() / 3600 / half) for j, u, v in rows if j == k and u is not None and u <= ts)

    want = sorted(((k, ts, v, direct(k, ts)) for k, ts, v in rows), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == [r[3] if r[3] is None else pytest.approx(r[3], rel=1e-9, abs=1e-9) for r in want]
    plan = decay.ext_decayed_sums(d, ["k"], "ts", ["v"], half, block)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches(spark):
    d = spark.range(60_000).select((F.col("id") % 6).alias("g"), F.when(F.col("id") % 7 > 0, F.floor(F.col("id") / 2)).alias("item"))
    hourly = sketches.ext_sketches(d, ["g"], "item")
    total = sketches.ext_merge_sketches(hourly.withColumn("all", F.lit(1)), ["all"]).select(sketches.ext_estimate()).first()[0]
    exact = d.select(F.count_distinct("item")).first()[0]
    assert abs(total - exact) <= exact * sketches.error_bound()
    assert sketches.ext_sketches(d.filter("item is null"), ["g"], "item").select(sketches.ext_estimate().alias("n")).distinct().first().n == 0


class Flaky(provider.Rehearsal):
    """Counts its calls; every batch fails twice before it is answered."""

    def __init__(self):
        super().__init__()
        self.calls = []

    def label(self, texts):
        self.calls.append(tuple(texts))
        if self.calls.count(tuple(texts)) < 3:
            raise TimeoutError
        return super().label(texts)


def test_provider_isolates_rows(spark):
    client = Flaky()
    got = provider.ask(client, ["a", "b !poison", "c", "d !silent"], retries=2, pause=0)
    assert [r for _, r in got] == [None, "provider:ConnectionError", None, "no_label"] and got[0][0]["stance"] == "strong_bearish"
    assert len(client.calls) == 3 + 3 + 3 + 3 + 3
    short = type("Short", (), {"label": lambda self, texts: []})()
    assert provider.ask(short, ["a", "b"], 0, 0) == [(None, "provider:ValueError")] * 2
    d = spark.createDataFrame([(1, "x", "old"), (2, None, "old"), (3, "!odd", "old"), (4, "!bare", "old"), (5, "y !later", "old")], "id long, text string, stance string")
    out = {r.id: r for r in provider.ext_provider_labels(d, "test", provider.Rehearsal, batch=2, pause=0).collect()}
    assert {i: r.reject_reason for i, r in out.items()} == {1: None, 2: None, 3: "stance", 4: "notes", 5: None}
    assert out[1].stance == "strong_bearish" and out[1].text == "x"
    assert provider.ext_provider_labels(d.limit(0), "test", provider.Rehearsal).count() == 0
