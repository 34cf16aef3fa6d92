"""SimHash near-duplicates by deletion-variant signatures.

The 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at
most three bits, one of the segments differs in at most one. Each distinct fingerprint is
indexed under its segments with one bit wildcarded, 32 variants a segment; fingerprints that
meet under a variant are compared in full, and linked at ``max_bits`` or fewer.

A bucket gives the edges of a spanning forest of its links, never all its pairs: texts that
are alike share one fingerprint, and a bucket's members are taken off it as they are
reached. Links and components are between fingerprints; documents join at the end.

Defined cases: a null text is empty and has fingerprint zero; zero fingerprints link like any
other; a bit that exactly half of the hashes have is not set; of several links to one fingerprint any spans its component; repeated rows come out once each; a null id counts in no minimum, and a component
without ids has a null ``component_id``; very long texts are hashed whole, some shingles at a time; an empty table gives no rows; other columns are ignored, or
kept (``drop_near_duplicates``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialize, slices, small, text_of, unused

SEED = 42
_CHUNK = 1 << 15
#: Members of a bucket from which on it is split.
_CROWD = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the text's word shingles, as an unsigned integer."""
    import xxhash

    # bytes.lower() and bytes.split() know the ASCII letters and the blanks 0x20, 0x09-0x0D only
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends, at = [], -1
    for p in parts:
        at += 1 + len(p)
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts, ends[words - 1 :], strict=False) if len(parts) >= words else [(0, len(flat))]
    h = np.fromiter((digest(flat[a:b], SEED) for a, b in pairs), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[k : k + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist())


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            prints = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    return d.mapInArrow(_fingerprints(words), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _link(max_bits: int):
    """Edges of a spanning forest of each bucket's links; rows come sorted by bucket."""

    def forest(members: np.ndarray) -> list[tuple[int, int]]:
        edges, left = [], members
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(left ^ x) <= max_bits
                if near.any():
                    found = left[near]
                    edges += [(int(x), int(y)) for y in found]
                    queue += list(found)
                    left = left[~near]
        return edges

    def parted(members: np.ndarray) -> Iterator[np.ndarray]:
        """A crowded bucket in parts that agree on a byte: up to three differing bits leave one of any four bytes as it is. The half that differs more is split."""
        if len(members) <= _CROWD:
            yield members
            return
        octets = members.view(np.uint8).reshape(-1, 8).T
        for byte in max(octets[:4], octets[4:], key=lambda half: sum(np.count_nonzero(np.bincount(x)) for x in half)):
            order = np.argsort(byte, kind="stable")
            for part in np.split(members[order], np.flatnonzero(np.diff(byte[order])) + 1):
                if len(part) > 1:
                    yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy()])
            f = np.concatenate([rest_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last bucket may go on in the next batch
            yield from linked(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        yield from linked(rest_k, rest_f)

    def linked(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(k)))
        a, b = [], []
        two = first[sizes == 2]
        ok = np.bitwise_count(f[two] ^ f[two + 1]) <= max_bits
        a.append(f[two][ok])
        b.append(f[two + 1][ok])
        for s, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for members in parted(f[s : s + n]):
                if e := forest(members):
                    e = np.array(e, np.uint64)
                    a.append(e[:, 0])
                    b.append(e[:, 1])
        a, b = (np.concatenate(x).view(np.int64) for x in (a, b))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return run


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all links."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    variants = []
    for s, seg in enumerate((low, high)):
        for j in range(32):
            name = (s << 5 | j) << 32
            variants.append(seg.bitwiseAND(0xFFFFFFFF & ~(1 << j)).bitwiseOR(name))
    keyed = prints.select("fp").distinct().select(F.explode(F.array(*variants)).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link(max_bits), "u long, v long")


def roots(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint: the least fingerprint (as a signed long) its links reach."""
    groups = components(links(prints, max_bits)).withColumnRenamed("node", "fp")
    return prints.select("fp").distinct().join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, max_bits: int = 3) -> DataFrame:
    """Per document: fingerprint (16 hexadecimal digits) and the smallest doc_id its links reach."""
    prints = materialize(fingerprints(docs, text, id_col, words))
    rooted = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots(prints, max_bits), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_keys(docs: DataFrame) -> DataFrame:
    """(key, text): keys order the rows by doc_id (null last) and the hash of the text."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(text_of()).alias("hash")).alias("key"), text_of().alias("text"))


def keep_least(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the least key of their group, once each, with all their columns; ``grouped`` has (key, root) of all rows.

    Keys alone are shuffled. Those that go, and those that are there several times, are broadcast if their counted rows are few, so that texts stay where they are.
    """
    grouped = materialize(grouped.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")))
    least = grouped.groupBy("root").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("keys")).filter("keys > 1")
    least = small(materialize(least), 96)  # a large group's keys then stay where they are
    key, hashed, repeat = (unused(docs, x) for x in ("id", "hash", "repeat"))
    met = grouped.join(least, "root", "left")
    gone = F.coalesce(F.col("key") != F.col("least"), F.lit(False))
    marked = materialize(met.filter(gone | (F.col("n") > 1)).select(F.col("key.doc_id").alias(key), F.col("key.hash").alias(hashed), (~gone).alias(repeat)))
    here = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(text_of()) == F.col(hashed))
    plain = docs.join(small(marked, 48), here, "left_anti")
    again = marked.filter(repeat)
    if not again.limit(1).count():
        return plain
    # a kept row that is there several times comes out once
    several = docs.join(small(again, 48), here).drop(repeat).dropDuplicates([key, hashed]).drop(key, hashed)
    return plain.unionByName(several)


def drop_near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest doc_id (null last)."""
    prints = materialize(fingerprints(row_keys(docs), "text", "key", words))
    return keep_least(docs, prints.join(roots(prints, max_bits), "fp").select(F.col("doc_id").alias("key"), "root"))
