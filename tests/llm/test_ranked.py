"""Ranked search against scoring every document, and the cutting into blocks against every cutting."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import ranked
from pulseloom.llm.ranked import Blocks, block_starts, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        q = Counter(plain_terms(text))
        scored = []
        for i, c, n in held:
            m = 25 + 75 * n * total // words
            s = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in q.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    odd = "Éa-B_c\x00d\x7fE9É ß x\u0085y Zz{}|~[\\]^`@?/:9"
    assert [t.decode() for t in terms_of(odd)] == plain_terms(odd)
    assert terms_of(None) == terms_of("") == terms_of("-- !?") == []


def test_block_borders(monkeypatch):
    monkeypatch.setattr(ranked, "MAX_BLOCK", 6)
    rng = np.random.default_rng(1)
    lists = [rng.integers(1, 100, size=s) for s in rng.integers(1, 40, size=60)] + [np.full(20, 7)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    marks = block_starts(np.concatenate(lists), offsets)
    for i, x in enumerate(lists):
        cost = ranked._block_cost(x)
        least = [0.0]
        for j in range(1, len(x) + 1):
            least.append(min(least[a] + (j - a) * int(x[a:j].max()) + cost for a in range(max(0, j - 6), j)))
        begin = np.flatnonzero(marks[offsets[i] : offsets[i + 1]]).tolist()
        assert begin[0] == 0
        assert sum((b - a) * int(x[a:b].max()) + cost for a, b in zip(begin, [*begin[1:], len(x)], strict=True)) == pytest.approx(least[-1])


def test_blocks_are_skipped():
    """A document far above all others leaves most postings unread."""
    rng = np.random.default_rng(2)
    n = 4000
    docs = [np.union1d(rng.choice(n, n // 2, replace=False), np.arange(100, 110)) for _ in range(6)]
    tfs = [np.where((d >= 100) & (d < 110), 40, 1) for d in docs]
    shard = Blocks(np.full(n, 100), np.arange(6), np.array([len(d) for d in docs]), np.concatenate(docs), np.concatenate(tfs), n, 100 * n)
    found, scores = shard.best([(t, 700) for t in range(6)], 5, 0)
    want = np.zeros(n, np.int64)
    for t in range(6):
        a, b = np.concatenate([[0], np.cumsum([len(d) for d in docs])])[[t, t + 1]]
        want[docs[t]] += 700 * shard.impacts[a:b]
    top = [(int(s), i) for s, i in sorted(zip(-want, range(n), strict=True))[:5]]
    assert sorted(zip((-scores).tolist(), found.tolist(), strict=True))[:5] == top
    # the list that gives the first k-th score is read, of the others little
    assert shard.read < sum(map(len, docs)) * 0.4


def test_search(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß9", "A_B", "x-y"]

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))

    docs = [(i, text(rng.randrange(1, 60))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "?!"), (903, docs[3][1]), (903, docs[3][1]), (None, docs[4][1]), (904, text(5000)), (-7, docs[5][1].upper()), (905, "w1 " * 900)]
    items = [(i, text(rng.randrange(1, 30))) for i in range(20)] + [(50, None), (51, ""), (52, "nowhere"), (53, "w1 w1 W1 w2"), (None, docs[4][1]), (54, text(3000))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "score", "Rank", "row", "term")}).repartition(7)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("row", "query", "doc_id", "rank")})
    want = plain(docs, items)
    assert rows(search(d, q)) == want
    # small shards, and queries in several blocks
    monkeypatch.setattr(ranked, "SHARD_DOCS", 16)
    assert rows(search(d, q, query_bytes=6000)) == want
    assert rows(search(d, q, k=3)) == plain(docs, items, 3)
    # documents of equal score, in several tasks: the least ids
    same = spark.createDataFrame([(i, "alpha beta") for i in range(100)] + [(1000 + i, "gamma") for i in range(100)], "doc_id long, text string").repartition(9)
    assert rows(search(same, spark.createDataFrame([(1, "Alpha")], "item_id long, text string"))) == plain([(i, "alpha beta") for i in range(100)] + [(1000 + i, "gamma") for i in range(100)], [(1, "Alpha")])
    assert rows(search(d.limit(0), q)) == [] and rows(search(d, q.limit(0))) == []


def test_sql(spark, sf):
    from pulseloom.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES["op11_block_max_wand"](spark, sf)
    want = con.sql(ORACLE_SQL["op11_block_max_wand"])
    assert got.columns == want.columns
    assert rows(got) == sorted(want.fetchall(), key=str) and got.count() > 100
