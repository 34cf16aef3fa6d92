import json
import random

from pulseloom.sources import pagination


def walk(pages, request, limit):
    """One page after the other."""
    held = {}
    for seq, (r, key, cont, following) in enumerate(pages):
        if r == request:
            held.setdefault(key, (cont, following))
    key, seen, fetched = "", set(), []
    while True:
        if key not in held:
            return fetched, "missing_page"
        fetched.append(key)
        cont, following = held[key]
        if cont != "Y":
            return fetched, "complete"
        if not following.strip():
            return fetched, "empty_next_key"
        if following in seen:
            return fetched, "repeated_key"
        seen.add(following)
        if len(fetched) == limit:
            return fetched, "over_limit"
        key = following


def test_follow_by_walking(spark):
    rng = random.Random(5)
    pages = []
    for r in range(60):
        n = rng.randrange(1, 12)
        keys = ["", *(f"k{i}" for i in range(1, n))]
        for i, key in enumerate(keys):
            following = keys[i + 1] if i + 1 < n else "gone"
            if rng.random() < 0.1:
                following = rng.choice([*keys[1:], " ", "nowhere"])
            pages.append((f"r{r}", key, "N" if i + 1 == n and rng.random() < 0.6 else "Y", following))
    pages = [p for p in pages if rng.random() > 0.02]
    pages += [("self", "", "Y", "a"), ("self", "a", "Y", "a"), ("twice", "", "N", ""), ("twice", "", "Y", "x"), ("headless", "k", "N", "")]
    d = spark.createDataFrame([(r, k, {"CONT-yn": c, "Next-Key": f}, f"{r}{k}", i) for i, (r, k, c, f) in enumerate(pages)], "request string, key string, headers map<string,string>, body string, seq long")
    d = pagination.from_headers(d)
    for limit in (3, 5, 50):
        w = pagination.follow(d, limit)
        got = {}
        for x in w.collect():
            got.setdefault(x.request, []).append((x.pos, x.key, x.outcome))
        requests = {p[0] for p in pages}
        assert set(got) == requests
        for r in requests:
            fetched, outcome = walk(pages, r, limit)
            rows = sorted(got[r], key=lambda x: -1 if x[0] is None else x[0])
            assert [x[1] for x in rows if x[0] is not None] == fetched and rows[-1][2] == outcome and all(x[2] is None for x in rows[:-1])
        bad = {(r, o, len(f)) for r in requests for f, o in [walk(pages, r, limit)] if o != "complete"}
        assert {tuple(x) for x in pagination.faults(w).collect()} == bad
    whole = [(x.request, x.page, x.body) for x in pagination.ordered_pages(d, w).collect()]
    assert sorted(whole) == sorted((r, i, f"{r}{k}") for r in requests for f, o in [walk(pages, r, 50)] if o == "complete" for i, k in enumerate(f))
    assert pagination.follow(d.limit(0)).count() == 0


def test_saved_files_feed_a_run(spark, tmp_path):
    from test_collector import GOOD, run

    from pulseloom.plans.collector import collect_run
    from pulseloom.sources import broker_pages

    def save(name, **response):
        (tmp_path / f"{name}.json").write_text(json.dumps(response))

    for day, rows in GOOD[:2]:
        save(f"{day}-1", request=day, headers={"cont-yn": "Y", "next-key": "n"}, body={broker_pages.TABLE: rows[:1]})
        save(f"{day}-2", request=day, key="n", headers={"cont-yn": "N"}, body={broker_pages.TABLE: rows[1:]})
    r = pagination.read_responses(spark, f"file://{tmp_path}")
    walked = pagination.follow(r)
    pages = pagination.ordered_pages(r, walked).withColumnRenamed("request", "day")
    faults = pagination.faults(walked).withColumnRenamed("request", "day")
    got = collect_run(spark, pages, run((tmp_path / "o" / "s.jsonl", tmp_path / "o" / "m.json")), faults)
    assert got["metadata"]["requestsMade"] == 4 and got["records"] == 3
