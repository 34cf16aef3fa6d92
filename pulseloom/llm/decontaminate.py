"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as lower-cased words. A document is set against an item if
they share a seed of ``min_match`` words (an item with fewer words is its own seed). Tiling then marks the
longest common runs of words that overlap no marked one, again and again: for search lengths that halve
down to ``min_match``, running Karp-Rabin fingerprints of all unmarked windows meet, matches are extended and
marked longest first. An item whose words are covered to ``threshold`` is contained, in whatever order its passages stand.

The benchmark is the query set: its size is summed first. Up to ``block_bytes`` of text it goes to the tasks as one index and
documents stream past it unshuffled; a larger one is joined to the documents on equal seeds, and the pairs that meet are tiled.

Defined cases: null and empty texts match nothing, items without words take no part; repeated rows come out once each; equal
coverage goes to the smallest item_id (null last); items without an id count, all as one null id; empty tables give no rows or no matches;
very long texts are tiled whole, a bounded number of window pairs at a time; other columns are kept (``decontaminate``) or ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import split_hot
from .common import materialize, slices, text_of, unused

WORD = re.compile(r"[^\W_]+")
MIN_MATCH, THRESHOLD = 5, 0.8
BLOCK_BYTES = 16 << 20
#: In the join on seeds: documents of one seed in a task, and items that a document is set against at a time.
HOT_ROWS, ITEMS_PER_ROW = 1 << 20, 256
_PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _running(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin fingerprints modulo 2**64 of all windows of n ids, from one running sum."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n) if n <= 8 else ():
        h = h * _BASE + x[k : len(ids) - n + 1 + k]
    if n > 8:
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids) - 1, _BASE, np.uint64)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(x * power, dtype=np.uint64)])
        # aligned to the last power, so that equal windows at any place have equal fingerprints
        h = (total[n:] - total[:-n]) * power[::-1][: len(ids) - n + 1]
        h *= np.uint64(pow(int(_BASE), (1 << 62) - len(ids), 1 << 64))
    return h


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of n unmarked positions."""
    c = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(c[n:] == c[:-n]) if len(marked) >= n else np.zeros(0, np.int64)


def _matches(doc: np.ndarray, item: np.ndarray, in_doc: np.ndarray, in_item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start in doc, start in item) of all maximal runs of equal fingerprints over unmarked windows of n ids, longest first."""
    a, b = _free(in_doc, n), _free(in_item, n)
    none = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return none, none, none
    ha, hb = _running(doc, n)[a], _running(item, n)[b]
    hit = np.isin(ha, hb)
    a, ha = a[hit], ha[hit]
    order = np.argsort(ha, kind="stable")
    a, ha = a[order], ha[order]
    first = np.searchsorted(ha, hb)
    count = np.searchsorted(ha, hb, side="right") - first
    upto = np.cumsum(count)
    runs, at = [], 0
    while at < len(b):
        # some item windows at a time, so that a text of one word a million times needs little memory
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
        c = count[at:to]
        i = a[np.repeat(first[at:to] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
        runs.append(_diagonals(i, np.repeat(b[at:to], c), np.ones(len(i), np.int64)))
        at = to
    i, j, k = _diagonals(*(np.concatenate(x) for x in zip(*runs, strict=True))) if len(runs) > 1 else runs[0]
    k = k + n - 1
    order = np.lexsort((j, i, -k))
    return k[order], i[order], j[order]


def _diagonals(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join runs (start in doc, start in item, windows) that follow one another on a diagonal."""
    order = np.lexsort((i, i - j))
    i, j, k = i[order], j[order], k[order]
    if not len(i):
        return i, j, k
    new = np.concatenate([[True], (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + k[:-1])])
    first = np.flatnonzero(new)
    return i[first], j[first], np.add.reduceat(k, first)


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(length, start in doc, start in item) of the greedy tiling. Ids below zero match nothing.

    Always the longest match of unmarked words is marked; ties go to the least start in doc, then in item. What marks
    leave of an occluded match stands in line by its own length again.
    """
    in_doc, in_item = doc < 0, item < 0
    low = min(min_match, len(item))
    out: list[tuple[int, int, int]] = []
    n = len(item)
    while low and n >= low and not in_item.all():
        found = list(zip(*(x.tolist() for x in _matches(doc, item, in_doc, in_item, n)), strict=True))
        rest: list[tuple[int, int, int]] = []
        at, left = 0, len(item) - int(in_item.sum())
        while left >= n and (at < len(found) or rest):
            if rest and (at == len(found) or rest[0] < (-found[at][0], *found[at][1:])):
                k, i, j = heapq.heappop(rest)
                k = -k
            else:
                k, i, j = found[at]
                at += 1
            ok = ~(in_doc[i : i + k] | in_item[j : j + k]) & (doc[i : i + k] == item[j : j + k])
            if ok.all():
                in_doc[i : i + k] = True
                in_item[j : j + k] = True
                out.append((k, i, j))
                left -= k
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8))).tolist()
            for s, e in zip(edges[::2], edges[1::2], strict=True):
                if e - s >= n:
                    heapq.heappush(rest, (s - e, i + s, j + s))
        n = low if low < n < 2 * low else n // 2
    return out


class Index:
    """A block of benchmark items: vocabulary, seeds and their items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH):
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        seeds: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int64)
            if len(ids):
                n = min(min_match, len(ids))
                for h in set(_running(ids, n).tolist()):
                    seeds.setdefault(n, {}).setdefault(h, []).append(len(self.items))
                self.items.append((item_id, ids))
        self.seeds = {n: (np.array(sorted(s), np.uint64), s) for n, s in seeds.items()}

    def coverage(self, texts: list[str | None]) -> list[dict[int, float]]:
        """For each text, the covered share of each item that shares a seed with it."""
        get = self.vocabulary.get
        docs = [[get(w, -1) for w in words(t)] for t in texts]
        flat = np.fromiter((x for d in docs for x in (*d, -1)), np.int64)
        ends = np.cumsum([len(d) + 1 for d in docs])
        pairs: set[tuple[int, int]] = set()
        for n, (keys, items) in self.seeds.items():
            at = _free(flat < 0, n)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            x = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            for k in range(n):
                h = h * _BASE + x[at + k]
            hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            for d, v in set(zip(np.searchsorted(ends, at[hit], side="right").tolist(), h[hit].tolist(), strict=True)):
                pairs.update((d, i) for i in items[v])
        out: list[dict[int, float]] = [{} for _ in texts]
        for d, i in pairs:
            item_id, ids = self.items[i]
            covered = sum(k for k, _, _ in tiles(np.array(docs[d], np.int64), ids, self.min_match)) / len(ids)
            if covered > out[d].get(item_id, 0):
                out[d][item_id] = covered
        return out


def _seeds(batches: Iterator[pa.RecordBatch], min_match: int, text_at: int) -> Iterator[pa.RecordBatch]:
    """Adds the distinct seeds of each text, by their length; words are named by their hash."""
    for b in slices(batches, "text"):
        out = []
        for t in b.column(text_at).to_pylist():
            ids = _word_ids(words(t))
            # every length up to min_match: an item with fewer words is its own seed
            out.append([int(h) for n in range(1, min_match + 1) for h in set((_running(ids, n) + np.uint64(n)).view(np.int64).tolist())])
        keep = [b.column(i) for i in range(b.num_columns) if i != text_at]
        names = [x for i, x in enumerate(b.schema.names) if i != text_at]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.list_(pa.int64()))], names=[*names, "seeds"])


def _word_ids(parts: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 for w in parts), np.int64, len(parts))


def _met(docs: DataFrame, items: DataFrame, min_match: int, hot_rows: int = HOT_ROWS, per_row: int = ITEMS_PER_ROW) -> DataFrame:
    """(row, item, covered) of all pairs of ``docs`` (row, text) and ``items`` (item, text) that share a seed.

    An equality join on seeds, for benchmarks of any size. Only texts that meet an item go on, once for each ``per_row`` of their items. Words are compared by 63-bit hashes.
    """

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _seeds(batches, min_match, 1)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for t in b.column(1).to_pylist():
                ids = _word_ids(words(t))
                n = min(min_match, len(ids))
                out.append(list(set((_running(ids, n) + np.uint64(n)).view(np.int64).tolist())) if n else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["item", "seeds"])

    wanted = items.mapInArrow(of_items, "item long, seeds array<bigint>").select("item", F.explode("seeds").alias("seed"))
    offered = docs.mapInArrow(of_docs, "row long, seeds array<bigint>").select("row", F.explode("seeds").alias("seed"))
    # a seed that a great share of the documents hold is dealt to several tasks
    offered, wanted = split_hot(offered, wanted, ["seed"], hot_rows)
    pairs = offered.join(wanted, ["seed", "_salt"]).select("row", "item").distinct()
    # a document goes out once for each ``per_row`` of its items, with their passages beside it
    lists = pairs.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    part = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / per_row).cast("int")), lambda k: F.slice("items", (k * per_row + 1).cast("int"), F.lit(per_row)))
    chunks = lists.select("row", F.posexplode(part).alias("chunk", "items")).select("row", "chunk", F.explode("items").alias("item"))
    passages = chunks.join(items.withColumnRenamed("text", "passage"), "item").groupBy("row", "chunk").agg(F.collect_list(F.struct("item", "passage")).alias("asked"))
    both = docs.join(passages, "row").select("row", "text", "asked")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows, found, got = [], [], []
            for r, t, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc = _word_ids(words(t))
                for x in asked:
                    ids = _word_ids(words(x["passage"]))
                    rows.append(r)
                    found.append(x["item"])
                    got.append(sum(k for k, _, _ in tiles(doc, ids, min_match)) / len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.int64()), pa.array(got, pa.float64())], names=["row", "item", "covered"])

    return both.mapInArrow(cover, "row long, item long, covered double")


def _benchmark(benchmark: DataFrame, block_bytes: int) -> tuple[Index | None, DataFrame]:
    """The benchmark as one index if its texts fit ``block_bytes``, and as a table."""
    b = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    total = int(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return (Index([(r[0], r[1]) for r in b.collect()]) if total <= block_bytes else None), b


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number, written out so that it holds in every later use."""
    return materialize(df.select(F.monotonically_increasing_id().alias(name), *[F.col(f"`{c}`") for c in df.columns]))


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: contaminated, n_items (contained), item_id and coverage of the best-covered item, items (all contained)."""
    d = docs.select("doc_id", text_of().alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    index, b = _benchmark(benchmark, block_bytes)
    if index is None:
        rows, items = _numbered(d, "row"), _numbered(b, "item")
        met = _met(rows.select("row", "text"), items.select("item", "text"), MIN_MATCH).join(items.select("item", "item_id"), "item").filter("covered > 0")
        best = F.min(F.struct((-F.col("covered")).alias("least"), F.col("item_id").isNull().alias("last"), "item_id", "covered"))
        hit = F.when(F.col("covered") >= threshold, F.struct(F.col("item_id").isNull().alias("last"), "item_id"))
        found = met.groupBy("row").agg(best.alias("best"), F.sort_array(F.collect_set(hit)).alias("hits"))
        none = F.expr("cast(array() as array<bigint>)")
        out = rows.drop("text").join(found, "row", "left").select("doc_id", F.coalesce(F.transform("hits", lambda x: x["item_id"]), none).alias("items"), F.col("best.item_id").alias("item_id"), F.coalesce("best.covered", F.lit(0.0)).alias("coverage"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                items, best, most = [], [], []
                for got in index.coverage(b.column(1).to_pylist()):
                    items.append(sorted((k for k, c in got.items() if c >= threshold), key=lambda k: (k is None, k or 0)))
                    c, k = min(((-c, (k is None, k)) for k, c in got.items()), default=(0.0, (True, None)))
                    best.append(k[1])
                    most.append(0.0 - c)
                cols = [b.column(0), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.int64()), pa.array(most, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "items", "item_id", "coverage"])

        out = d.mapInArrow(run, f"doc_id {kind}, items array<bigint>, item_id long, coverage double")
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "item_id", "coverage", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    text = docs.columns[at]
    docs = docs.withColumn(text, text_of(text))
    index, b = _benchmark(benchmark, block_bytes)
    if index is None:
        row = unused(docs, "row")
        rows, items = _numbered(docs, row), _numbered(b, "item")
        met = _met(rows.select(F.col(row).alias("row"), text_of().alias("text")), items.select("item", "text"), MIN_MATCH)
        bad = met.filter(F.col("covered") >= threshold).select(F.col("row").alias(row)).distinct()
        return rows.join(bad, row, "left_anti").drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            got = index.coverage(b.column(at).to_pylist())
            yield b.filter(pa.array([all(c < threshold for c in g.values()) for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
