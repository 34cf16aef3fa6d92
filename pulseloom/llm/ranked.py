"""Ranked lexical search: the k best documents for each query text, by variable-block-max WAND over document shards.

Terms are runs of ASCII letters and digits and of whatever is beyond ASCII, with only A-Z lower-cased. With N documents that hold a term, L terms
in all, n terms in a document, df documents with a term and tf occurrences in a document, a query term adds

    w * ((10**9 * tf) div (1000 * tf + 8 * m)),  w = floor(1000 ln((2 N + 2) / (2 df + 1))),  m = 25 + (75 n N) div L

Every document goes into the index, once, in the shard of the task that reads it: a shard is one row with the postings of the queries' terms (other
terms are never asked for), so nothing is shuffled. Counts over all shards give N, L and every df. Then each shard is searched by itself:

* each posting list is cut into blocks. A dynamic program chooses the borders that minimise the sum over blocks of length times greatest impact (what the
  block's bound claims beyond the true impacts, up to a constant) plus a cost for each block, exactly, among all cuttings into blocks of up to 64 postings;
* some documents that the lists of the greatest bounds put first give a first k-th score. Lists stand by their bounds; the pivot is where their sum reaches that score, for a document that only lists before it hold cannot. So
  candidates come from the lists from the pivot on alone, and of these only blocks are read that cover a document whose summed block bounds reach the k-th score. Then the lists before the pivot follow, a few at a time from the greatest bound down: a candidate stays while
  what it has and the bounds of the blocks still unread that cover it reach the k-th score; only blocks with a candidate are read, or the list is searched for the candidates if they are few. This is done for all documents of a shard at once. A task keeps its
  k best from shard to shard, so that the test gets sharper.

Only documents whose bound is below the k-th score are left out, so the result is exact; equal scores go by ascending id. Queries are taken in blocks whose texts have
``query_bytes`` together (all of them at once in most cases), one pass over the documents for each.

Defined cases: a null or empty text has no terms and is never found, a query without terms finds nothing; documents with score 0 are not returned; repeated rows are documents
and queries of their own (ranks count within a query's row); a null id stands last among equal scores; very long texts are read whole; bytes that are no UTF-8 count as U+FFFD; empty tables give no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, text_of

#: Texts and documents of a shard at most (one longer text is a shard of its own).
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 15
#: Query texts that are sent to every task at a time.
QUERY_BYTES = 8 << 20
MAX_BLOCK = 64
#: A block costs as much as this many mean deviations of an impact.
BLOCK_COST = 12
_LISTS = 2048
#: Documents that are looked at, and scored, for a first k-th score; lists before the pivot that are read at a time.
_FIRST, _SCORED, _STEP = 64, 24, 2

_TO_TERMS = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_TERMS).split()


# ---------------------------------------------------------------- index

_INTS = "terms binary, counts binary, docs binary, tfs binary"


class _Shard:
    """Postings of the documents read so far."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def row(self) -> list:
        doc, term, tf = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.empty(0, np.int64) for i in range(3))
        order = np.lexsort((doc, term))
        terms, counts = np.unique(term, return_counts=True)
        ints = [x.astype("<i4").tobytes() for x in (terms, counts, doc[order], tf[order])]
        return [self.ids, len(self.ids), sum(self.sizes), np.array(self.sizes, "<i8").tobytes(), *ints]


def _index(batches: Iterator[pa.RecordBatch], wanted: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    shard, kind = _Shard(), None

    def out() -> pa.RecordBatch:
        types = [pa.list_(kind), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(shard.row(), types, strict=True)], names=["ids", "n_docs", "n_terms", "sizes", "terms", "counts", "docs", "tfs"])

    for b in slices(batches):
        kind = b.schema.field(0).type
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        words, sizes, kept = [], [], []
        for i, t in zip(ids, texts, strict=True):
            w = terms_of(t)
            if w:
                words += w
                sizes.append(len(w))
                kept.append(i)
        if not kept:
            continue
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        known = np.array([wanted.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
        term = known[coded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(kept)), sizes)
        here = term >= 0
        key, tf = np.unique(doc[here] * (len(wanted) + 1) + term[here], return_counts=True)
        doc, term = np.divmod(key, len(wanted) + 1)
        shard.parts.append((doc + len(shard.ids), term, tf))
        shard.ids += kept
        shard.sizes += sizes
        shard.bytes += sum(map(len, words))
        if shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
            yield out()
            shard = _Shard()
    if shard.ids:
        yield out()


def build_index(docs: DataFrame, terms: dict[bytes, int], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each shard: its documents' ids and sizes, and the postings of ``terms`` (term: number). Written out."""
    d = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    return materialize(d.mapInArrow(lambda batches: _index(batches, terms), f"ids array<{kind}>, n_docs long, n_terms long, sizes binary, {_INTS}"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of the shards of a task."""
    total: Counter = Counter()
    for b in batches:
        for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total.update(dict(zip(np.frombuffer(t, "<i4").tolist(), np.frombuffer(c, "<i4").tolist(), strict=True)))
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])


# ---------------------------------------------------------------- blocks


def block_starts(impacts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks (one byte a posting) where the blocks of posting lists ``impacts[offsets[i]:offsets[i + 1]]`` begin.

    A list's cutting has the least sum of length x greatest impact + the list's block cost among all into blocks of up to ``MAX_BLOCK``. All lists advance together,
    longest first, so that a step is a few array operations.
    """
    marks = np.zeros(len(impacts), np.uint8)
    sizes = np.diff(offsets)
    longest = np.argsort(-sizes, kind="stable")
    for at in range(0, len(longest), _LISTS):
        some = longest[at : at + _LISTS]
        begin, size = offsets[:-1][some], sizes[some]
        n = int(size[0])
        cost = np.array([_block_cost(impacts[b : b + s]) for b, s in zip(begin, size, strict=True)])
        best = np.zeros(len(some))
        top = np.zeros((len(some), MAX_BLOCK))
        base = np.full((len(some), MAX_BLOCK), np.inf)
        start = np.zeros(MAX_BLOCK, np.int64)
        came = np.zeros(len(impacts) + 1, np.int32)
        live = np.searchsorted(-size, -np.arange(n), side="left")  # lists longer than j
        rows = np.arange(len(some))
        for j in range(n):
            k, s = int(live[j]), j % MAX_BLOCK
            top[:k, s], base[:k, s], start[s] = 0, best[:k], j
            np.maximum(top[:k], impacts[begin[:k] + j][:, None], out=top[:k])
            sums = top[:k] * (j + 1 - start) + base[:k]
            pick = sums.argmin(1)
            best[:k] = sums[rows[:k], pick] + cost[:k]
            came[begin[:k] + j] = start[pick]
        for b, s in zip(begin.tolist(), size.tolist(), strict=True):
            while s:
                s = int(came[b + s - 1])
                marks[b + s] = 1
    return marks


def _block_cost(x: np.ndarray) -> float:
    return BLOCK_COST * float(np.abs(x - x.mean()).mean()) + 1 if len(x) else 1.0


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[i] .. begin[i] + size[i] - 1, one stretch after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)


class Blocks:
    """One shard, its lists cut into blocks."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int) -> None:
        n, inverse = np.unique(sizes, return_inverse=True)
        m = np.array([25 + 75 * v * n_docs // n_terms for v in n.tolist()], np.int64)[inverse]
        self.documents = len(sizes)
        self.docs = docs.astype(np.int64)
        tf = tfs.astype(np.int64)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.begin = np.flatnonzero(block_starts(self.impacts, offsets))
        self.size = np.diff(self.begin, append=len(docs))
        self.top = np.maximum.reduceat(self.impacts, self.begin) if len(docs) else np.empty(0, np.int64)
        self.last_at = self.begin + self.size - 1
        self.first, self.last = self.docs[self.begin], self.docs[self.last_at]
        self.read = 0  # postings looked at so far
        self.lists = np.searchsorted(self.begin, offsets)  # the blocks of each list
        self.list_top = np.maximum.reduceat(self.top, self.lists[:-1]) if len(docs) else np.empty(0, np.int64)
        self.number = {t: i for i, t in enumerate(terms.tolist())}

    def best(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers in the shard) and scores: every one of the k best whose score reaches ``floor`` (1 at least), ties at the end all in."""
        here = [(self.number[t], w) for t, w in query if w > 0 and t in self.number]
        none = np.empty(0, np.int64)
        if not here:
            return none, none
        lists, weight = (np.array(x, np.int64) for x in zip(*here, strict=True))
        most = weight * self.list_top[lists]
        order = np.argsort(most, kind="stable")
        lists, weight, most = lists[order], weight[order], most[order]
        count = self.lists[lists + 1] - self.lists[lists]
        ends = np.concatenate([[0], np.cumsum(count)])  # the blocks of the lists, in the order of their bounds
        blocks, weights = _ranges(self.lists[lists], count), np.repeat(weight, count)
        upto = np.cumsum(most)
        floor = max(1, floor)

        def score(a: int, z: int, live: np.ndarray, scores: np.ndarray) -> None:
            wanted = np.flatnonzero(live)
            for j in range(a, z):
                self._add(int(lists[j]), int(weight[j]), wanted, live, scores)

        def bound(a: int, z: int) -> np.ndarray:
            return self._bound(blocks[ends[a] : ends[z]], weights[ends[a] : ends[z]])

        # a first k-th score: of the documents that the lists of the greatest bounds put first
        n, partial = len(lists), np.zeros(self.documents, np.int64)
        head, everyone = n, np.ones(self.documents, bool)
        while head and np.count_nonzero(partial) < min(_FIRST, self.documents):
            head -= 1
            score(head, head + 1, everyone, partial)
        done = np.zeros(self.documents, bool)
        few = max(k, _SCORED)
        done[np.argpartition(partial, -few)[-few:] if self.documents > few else slice(None)] = True
        exact = np.zeros(self.documents, np.int64)
        score(0, n, done, exact)
        floor = self._raised(floor, exact[done], k)
        # the pivot: what only the lists before it hold cannot reach the k-th score
        pivot = int(np.searchsorted(upto, floor))
        rest = bound(0, pivot)
        live = (rest + bound(pivot, n) >= floor) & ~done
        partial = np.zeros(self.documents, np.int64)
        score(pivot, n, live, partial)
        live &= partial > 0
        for z in range(pivot, 0, -_STEP):
            live &= partial + rest >= floor
            a = max(0, z - _STEP)
            score(a, z, live, partial)
            rest = bound(0, a)
            floor = self._raised(floor, np.concatenate([exact[done], partial[live]]), k)
        exact[live] = partial[live]
        found = np.flatnonzero((live | done) & (exact >= floor))
        return found, exact[found]

    @staticmethod
    def _raised(floor: int, scores: np.ndarray, k: int) -> int:
        return max(floor, int(np.partition(scores, -k)[-k])) if len(scores) >= k else floor

    def _bound(self, blocks: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each document the sum of the bounds of the blocks that cover it."""
        change = np.zeros(self.documents + 1, np.int64)
        claim = weight * self.top[blocks]
        np.add.at(change, self.first[blocks], claim)
        np.subtract.at(change, self.last[blocks] + 1, claim)
        return np.cumsum(change)[:-1]

    def _add(self, number: int, weight: int, wanted: np.ndarray, live: np.ndarray, scores: np.ndarray) -> None:
        """Add what one list gives to the wanted documents (numbers, and the same as marks): it is searched for few ones, else its blocks that cover one are read."""
        blocks = np.arange(self.lists[number], self.lists[number + 1])
        a, z = int(self.begin[blocks[0]]), int(self.last_at[blocks[-1]]) + 1
        if len(wanted) * 4 < z - a:
            docs = self.docs[a:z]
            at = np.minimum(np.searchsorted(docs, wanted), z - a - 1)
            hit = docs[at] == wanted
            scores[wanted[hit]] += weight * self.impacts[a + at[hit]]
            self.read += len(wanted)
            return
        upto = np.concatenate([[0], np.cumsum(live)])
        blocks = blocks[upto[self.last[blocks] + 1] > upto[self.first[blocks]]]
        at = _ranges(self.begin[blocks], self.size[blocks])
        at = at[live[self.docs[at]]]
        scores[self.docs[at]] += weight * self.impacts[at]
        self.read += int(self.size[blocks].sum())


# ---------------------------------------------------------------- search


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search(batches: Iterator[pa.RecordBatch], queries: list[list[tuple[int, int]]], n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    best: list[list[tuple]] = [[] for _ in queries]
    kind = None
    for b in batches:
        kind = b.schema.field(0).type.value_type
        for i in range(b.num_rows):
            ids = b.column(0)[i].values
            sizes, *ints = (np.frombuffer(b.column(c)[i].as_py(), "<i8" if c == 3 else "<i4") for c in range(3, 8))
            shard = Blocks(sizes, *ints, n_docs, n_terms)
            for q, query in enumerate(queries):
                docs, scores = shard.best(query, k, -best[q][-1][0] if len(best[q]) == k else 1)
                if len(docs):
                    named = [(-s, d is None, d) for d, s in zip(ids.take(pa.array(docs)).to_pylist(), scores.tolist(), strict=True)]
                    best[q] = heapq.nsmallest(k, best[q] + named)
    rows = [(q, d, -s) for q, hits in enumerate(best) for s, _, d in hits]
    if rows:
        q, d, s = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, kind), pa.array(s, pa.int64())], names=["query", "doc_id", "score"])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", id_col: str = "doc_id", query_id: str = "item_id", query_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias(query_id), text_of(query_text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    asked = materialize(asked.filter("length(text) > 0"))
    total = int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rounds = max(1, -(-total // query_bytes))
    found = None
    for r in range(rounds):
        block = [(x[0], terms_of(x[1])) for x in asked.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).select("row", "text").collect()]
        terms = {t: i for i, t in enumerate(sorted({t for _, q in block for t in q}))}
        index = build_index(docs, terms, text, id_col)
        n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        df = dict(index.select("terms", "counts").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect())
        weight = {t: term_weight(n_docs, n) for t, n in df.items()}
        wanted = [[(t, c * weight[t]) for t, c in Counter(terms[t] for t in q).items() if t in weight] for _, q in block]
        kind = index.schema["ids"].dataType.elementType.simpleString()
        args = (wanted, n_docs, n_terms, k)
        hits = index.mapInArrow(lambda batches, args=args: _search(batches, *args), f"query long, doc_id {kind}, score long")
        rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], "query long, row long")
        hits = hits.join(F.broadcast(rows), "query").drop("query")
        found = hits if found is None else found.unionByName(hits)
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(F.broadcast(asked.select("row", query_id)) if rounds == 1 else asked.select("row", query_id), "row").select(query_id, "rank", "doc_id", "score")
