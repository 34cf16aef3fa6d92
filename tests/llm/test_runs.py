"""Periodic runs against brute force, and the linear number of comparisons."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm.runs import lyndon_edges, run_digests, runs, stretches
from pulseloom.llm.runs import _rooted as rooted


def brute(x, least=2):
    out, seen = [], set()
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j - i >= p and (i, j + p) not in seen:
                seen.add((i, j + p))
                out.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted((r for r in out if r[1] >= least), key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        x = [rng.randrange(rng.choice([1, 2, 3])) if rng.random() < 0.9 else rng.randrange(3) for _ in range(rng.randrange(40))]
        if rng.random() < 0.3:
            x = (x * rng.randrange(1, 5))[:60]
        assert runs(x) == brute(x)
        nxt = lyndon_edges(x)[0]
        assert nxt == [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) for i in range(len(x))]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("n", [2000, 16000])
def test_comparisons_are_linear(n):
    rng = random.Random(1)
    rising = [v for k in range(1, int((2 * n) ** 0.5)) for v in [0] * k + [1]]
    families = [[0] * n, fibonacci(n), [i.bit_count() & 1 for i in range(n)], [rng.randrange(2) for _ in range(n)], list(range(n)), ([0] * 50 + [1]) * (n // 51), [(i & -i).bit_length() for i in range(1, n)], rising, rising[::-1]]
    families.append([rng.randrange(50) for _ in range(1000)] * (n // 1000))
    for x in families:
        for y in (x, [-v for v in x]):
            assert lyndon_edges(y)[2] <= 3 * len(x) and rooted(y)[1] <= 6 * len(x)


def test_stretches_hold_every_run():
    rng = random.Random(2)
    for _ in range(300):
        texts = [[rng.randrange(30) for _ in range(rng.randrange(60))] + [rng.randrange(3) for _ in range(rng.randrange(20))] for _ in range(3)]
        owner = np.repeat(np.arange(3), [len(t) for t in texts])
        flat = np.array([w for t in texts for w in t], np.int64)
        spans = list(stretches(flat, owner, 6))
        at = 0
        for t in texts:
            for s, n, _ in brute(t, 6):
                assert any(a <= at + s and at + s + n <= b for a, b in spans)
            at += len(t)
        assert all(len(set(owner[a:b])) == 1 for a, b in spans)


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = [r for r in brute(w, 12) if r[1] >= max(12, 2 * r[2])]
    gone = {i for s, k, p in found for i in range(s + p, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{k},{p}\n" for s, k, p in found)
    kept = " ".join(v for i, v in enumerate(w) if i not in gone)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_digests(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "x " * 11, "x " * 12, "x  \t" * 4000, "é ü\x0bé ü " * 40, "one two three " * 5 + "four " + "five six " * 9]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(200))) + " ".join(["", "q q"] * rng.randrange(20)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b c " * 10), (5, texts[5]), (-3, "z y x " * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "n_words", "start", "Text_", "owner")})
    got = sorted(map(tuple, run_digests(d).collect()), key=str)
    assert got == sorted((plain(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 30
    assert run_digests(d.limit(0)).count() == 0


def test_whole_table(spark, sf):
    from pulseloom.llm.queries import QUERIES

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    short = [r for r in d if len(r.text or "") < 6000]
    assert len(got) == len(d) and len(short) > 100
    for r in short:
        assert got[r.doc_id] == plain(r.doc_id, r.text)
