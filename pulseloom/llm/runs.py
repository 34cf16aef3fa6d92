"""Maximal periodic runs of words, found with Lyndon arrays, and texts whose repetitions are collapsed.

A run is a stretch of words with smallest period q and at least 2 q words which no neighbouring word extends. Each
run of period q holds a Lyndon word of q words (its root) that is, under an order of the words or under the reversed order, the
longest Lyndon word at its place. So both Lyndon arrays are computed and every longest Lyndon word is extended
to both sides; the word is a root if the extensions together are at least as long as it.

The arrays come from one pass from left to right over the edges between a place and its next (or previous) smaller suffix, without
suffix structures or hashes: words are only compared. Two sources save comparisons: the last stretch that
matched an earlier one (an edge inside it was met before, in the earlier one, and ends as it did or at the border of the stretch), and
two edges in a row (the extension of their sum is the lesser of theirs unless both are equal). So each comparison beyond the known border moves that
border, and their number is linear in the words. Extensions to the left reuse matched stretches in the same way from right to left.

Before that, stretches of words are cut at every word that its stretch holds once, again and again: no run
contains such a word. Most prose falls apart by this; what remains is searched exactly.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a text without runs is its words joined by single spaces; repeated rows
come out once each; runs that start together stand by period; very long texts are read whole (a worker holds the words of a few megabytes of text, or of one
longer text); bytes that are no UTF-8 count as U+FFFD; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

MIN_LENGTH = 12
_ROUNDS = 64


def lyndon_edges(x: list[int]) -> tuple[list[int], list[int], int]:
    """For each place the next place with a smaller suffix, how far the two suffixes agree, and the symbol comparisons made."""
    n = len(x)
    nxt, nxt_len, prev, prev_len = [n] * n, [0] * n, [-1] * n, [0] * n
    right, shift, border, made = 0, 0, 0, 0  # x[right:border] equals what stands ``shift`` before
    for r in range(1, n):
        left, k, below = r - 1, 0, -1
        while left >= 0:
            scan = True
            if r < border and left >= right:
                a, b = left - shift, r - shift
                if nxt[a] == b:
                    k = nxt_len[a]
                elif prev[b] == a:
                    k = prev_len[b]
                else:
                    k = 0
                if r + k >= border:
                    k = border - r
                elif nxt[a] == b or prev[b] == a:
                    scan = False
            elif below >= 0:
                e = prev_len[below]
                if e != k:
                    scan = False
                    if e < k:
                        k = e
            if scan:
                at = r + k
                while at < n and x[left + at - r] == x[at]:
                    at += 1
                made += at - r - k + 1
                k = at - r
                if at >= border:
                    right, shift, border = r, r - left, at
            if r + k < n and x[left + k] < x[r + k]:
                prev[r], prev_len[r] = left, k
                break
            nxt[left], nxt_len[left] = r, k
            below, left = left, prev[left]
    return nxt, nxt_len, made


def _rooted(x: list[int]) -> tuple[list[tuple[int, int, int]], int]:
    """(start, length, period) of the runs whose roots are longest Lyndon words under this order."""
    nxt, forward, made = lyndon_edges(x)
    found = []
    back = [-1] * len(x)
    low, high, shift = 0, 0, 0  # x[low:high] equals what stands ``shift`` after
    for a in range(len(x) - 1, -1, -1):
        f = forward[a]
        if not f:
            continue
        b = nxt[a]
        p = b - a
        k = 0
        if low < a and b <= high and nxt[a + shift] == b + shift and back[a + shift] >= 0:
            k = min(back[a + shift], a - low)
        if not k or k == a - low:
            began = k
            # a root further left reports the run if the extension reaches a whole period
            while k < p and k < a and x[a - 1 - k] == x[b - 1 - k]:
                k += 1
            made += k - began + 1
            if a - k <= low or a - k < low or high <= a - k:
                low, high, shift = a - k, a, p
        back[a] = k
        if k < p and k + f >= p:
            found.append((a - k, k + p + f, p))
    return found, made


def runs(x: list[int], min_length: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``min_length`` symbols, by start, then period."""
    both = sorted(_rooted(x)[0] + _rooted([-v for v in x])[0])
    once = [r for i, r in enumerate(both) if not i or both[i - 1] != r]
    return sorted((r for r in once if r[1] >= min_length), key=lambda r: (r[0], r[2]))


def stretches(ranks: np.ndarray, owner: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """[begin, end) of stretches in which every word occurs twice at least; ``owner`` numbers the texts. No run crosses or leaves them."""
    at, seg = np.arange(len(ranks)), owner.astype(np.int64)
    base = int(ranks.max(initial=0)) + 1
    for _ in range(_ROUNDS):
        if not len(at):
            return
        key = seg * base + ranks[at]
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        kept = np.zeros(len(at), bool)
        kept[order[1:][same]] = True
        kept[order[:-1][same]] = True
        every = kept.all()
        at, seg = at[kept], seg[kept]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(seg) != 0)
        seg = np.cumsum(new) - 1
        size = np.bincount(seg, minlength=1)
        long = size[seg] >= least if len(at) else kept[:0]
        if every and long.all():
            break
        at, seg = at[long], seg[long]
    cut = np.flatnonzero(np.diff(seg, prepend=-1)) if len(at) else at
    for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
        yield int(at[a]), int(at[b - 1]) + 1


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"


def _search(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        at = b.schema.get_field_index("text")
        texts = [(t or "").encode().split() for t in b.column(at).to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        words = [w for t in texts for w in t]
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if len(words) >= min_length:
            ranks = pc.rank(pa.array(words, pa.large_binary()), tiebreaker="dense").to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(texts)), np.diff(starts))
            for begin, end in stretches(ranks, owner, min_length):
                d = int(owner[begin])
                found[d] += [(s + begin - int(starts[d]), n, p) for s, n, p in runs(ranks[begin:end].tolist(), min_length)]
        out = []
        for t, rs in zip(texts, found, strict=True):
            if rs:
                gone = bytearray(len(t))
                for s, n, p in rs:
                    gone[s + p : s + n] = b"\1" * (n - p)
                t = [w for w, g in zip(t, gone, strict=True) if not g]
            out.append(b" ".join(t).decode())
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in rs] for rs in found]
        keep = [i for i in range(b.num_columns) if i != at]
        cols = [*[b.column(i) for i in keep], pa.array(np.diff(starts), pa.int64()), pa.array(rows, _RUN), pa.array(out, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[*[b.schema.names[i] for i in keep], "n_words", "runs", "text"])


def collapse_runs(docs: DataFrame, text: str | Column = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, text): every run of a document, and its words without what any run repeats after its first period."""
    t = text_of(text) if isinstance(text, str) else text
    d = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"))
    return d.mapInArrow(lambda batches: _search(batches, min_length), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text, of every tenth document (by crc32 of the id) its end replaced by a period of its own words.

    With h the checksum, g = h div 10 and n words, words from a = g mod n on repeat the p = 1 + (n - a) div (3 + g mod 8) words at a.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        old = F.slice(w, F.lit(1), a.cast("int"))
        new = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.array_join(F.concat(old, new), " ")

    # the array is named once, so that it is not taken anew for each word
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)


def run_digests(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Per document the longest run and digests of all runs and of the collapsed text."""
    d = docs.select(F.col("doc_id"), text_of("text").alias("text"))
    found = collapse_runs(d, with_planted_period(F.col("text"), F.col("doc_id")), min_length=min_length)
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.try_element_at(best, F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length = -best["n"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * length / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
