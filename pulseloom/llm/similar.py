"""Near duplicates by exact Jaccard similarity of word shingles.

Candidates are texts whose SimHash fingerprints link at three or fewer differing bits, as in
``simhash``, and, as pairs at 0.8 are mostly further apart than that, texts that share a band of minimum hashes: a pair of similarity s meets with
probability 1 - (1 - s**ROWS)**BANDS, 0.99998 at 0.8 and more above. The texts of a class of fingerprints or of a band go to the
group named after the least of them, so that a text goes to as many groups as its bands have least
texts (few, since copies share them) and groups do not chain. There all pairs are compared exactly on
their shingle sets (equal 64-bit shingle hashes count as equal shingles), so that no pair is taken or
given up on an estimate. A group longer than ``group_bytes`` is compared in chunks, the least
text in each of them; then what did not come to the least text's component, mostly little, meets the
whole group block by block. Links give a spanning forest, never all pairs.

Defined cases: a text of fewer words than a shingle is one shingle; texts without words are alike;
letter case (ASCII) and blanks do not count; a null text is empty; repeated rows stay once; null ids come last; a very long text is
compared whole, one that alone passes ``group_bytes`` in a chunk of its own with the least text; an empty table gives no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialize, slices, small
from .simhash import SEED, fingerprint, keep_least, roots, row_keys

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 6
#: Bits in which the fingerprints of a link differ, at most.
BITS = 3
#: Text bytes of a group that a worker compares at a time.
GROUP_BYTES = 16 << 20
_CHUNK = 1 << 10


def normal(text: str | None) -> list[bytes]:
    # bytes.lower() and bytes.split() know the ASCII letters and the blanks 0x20, 0x09-0x0D only
    return (text or "").encode().lower().split()


def shingles(parts: list[bytes], words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(parts[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def _hashes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
    return a, b, rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)


def _bands(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b, mix = _hashes()
        for batch in slices(batches, "text"):
            nodes, keys, sizes, prints = [], [], [], []
            for t in batch.column(1).to_pylist():
                parts = normal(t)
                sizes.append(sum(map(len, parts)) + len(parts))
                nodes.append(xxhash.xxh3_128_digest(b" ".join(parts), SEED))
                prints.append(fingerprint(t))
                h = (shingles(parts, words) >> np.uint64(32)).astype(np.uint32)[:, None]
                least = np.full(len(a), 0xFFFFFFFF, np.uint32)
                for k in range(0, len(h), _CHUNK):
                    np.minimum(least, (h[k : k + _CHUNK] * a + b).min(0), out=least)
                keys.append((least.reshape(BANDS, ROWS) * mix).sum(1, dtype=np.uint64).view(np.int64))
            flat = pa.array(np.concatenate(keys))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), bands], names=["key", "node", "size", "fp", "bands"])

    return run


def links(nodes: list[bytes], sets: list[np.ndarray], similarity: float) -> list[tuple[bytes, bytes]]:
    """Edges of a spanning forest of all pairs of at least this similarity."""
    size = np.array([len(s) for s in sets])
    own = np.repeat(np.arange(len(sets)), size)
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    holders, start = own[order], np.searchsorted(at[order], np.arange(len(names) + 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    left, edges = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            both = np.bincount(np.concatenate([holders[start[j] : start[j + 1]] for j in at[begin[x] : begin[x + 1]]]), minlength=len(sets))
            near = np.flatnonzero(left & (both / (size + size[x] - both) >= similarity))
            left[near] = False
            edges += [(nodes[x], nodes[y]) for y in near.tolist()]
            queue += near.tolist()
    return edges


def _verify(words: int, similarity: float):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        edges = links(nodes, [shingles(normal(t), words) for t in table.column("text").to_pylist()], similarity)
        return pa.table({"u": pa.array([e[0] for e in edges], pa.binary()), "v": pa.array([e[1] for e in edges], pa.binary())})

    return run


def simhash_groups(prints: DataFrame) -> DataFrame:
    """(node, group) of the texts (node, fp) whose fingerprints' links reach another text; the group is the least hash of its nodes."""
    met = materialize(prints.select("node", "fp").distinct().join(roots(prints, BITS), "fp").select("node", "root"))
    shared = met.groupBy("root").agg(F.min(F.xxhash64("node")).alias("group"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return met.join(small(materialize(shared), 24), "root").select("node", "group")


def _compare(keyed: DataFrame, placed: DataFrame, repeated: bool, words: int, similarity: float) -> DataFrame:
    """Links between the texts of each task; ``placed`` has (key, node, task). Only texts of tasks leave their place."""
    parts = keyed.join(small(materialize(placed), 96), "key")
    if repeated:
        parts = parts.dropDuplicates(["node", "task"])
    return parts.select("node", "text", "task").groupBy("task").applyInArrow(_verify(words, similarity), "u binary, v binary")


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One document of each component of similar texts, with all its columns: that of the smallest doc_id (null last)."""
    keyed = row_keys(docs)
    prints = materialize(keyed.mapInArrow(_bands(words), f"key {keyed.schema['key'].dataType.simpleString()}, node binary, size long, fp long, bands array<bigint>"))
    name, group = F.xxhash64("node"), F.col("group")
    met = prints.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    # bands are counted before they are shuffled, and those of one text alone go
    shared = materialize(met.groupBy("band").agg(F.min(name).alias("group"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    group_of = simhash_groups(prints).unionByName(met.join(small(shared, 24), "band").select("node", "group")).distinct()
    # one row stands for the rows of a text
    rows = prints.groupBy("node", "key").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    members = materialize(rows.groupBy("node").agg(F.min(F.struct("key", "rows", "size")).alias("x")).join(group_of, "node").select("node", "group", (name == group).alias("least"), "x.*"))
    repeated = members.filter("rows > 1").limit(1).count() > 0
    chunks = materialize(members.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / group_bytes).cast("int")).alias("chunks")))
    inside = members.join(chunks, "group")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(SEED)), n).cast("int")
    chunk = F.explode(F.when(F.col("least"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own(F.col("chunks")))))
    first = inside.select("key", "node", "group", chunk.alias("chunk")).select("key", "node", F.struct("group", "chunk").alias("task"))
    edges = _compare(keyed, first, repeated, words, similarity)
    if chunks.filter("chunks > 1").limit(1).count():
        edges = materialize(edges)
        reached = inside.filter("chunks > 1").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        heads = reached.filter("least").groupBy("group").agg(F.min("root").alias("head"))
        reached = materialize(reached.join(heads, "group").withColumn("rest", F.col("root") != F.col("head")))
        count = lambda rest: F.ceil(F.sum(F.when(F.col("rest") == rest, F.col("size") + 1).otherwise(0)) / (group_bytes / 2)).cast("int")
        blocks = reached.groupBy("group").agg(count(True).alias("r"), count(False).alias("m")).filter("r > 0")
        block = F.when(F.col("rest"), own(F.col("r"))).otherwise(F.col("r") + own(F.greatest(F.lit(1), F.col("m"))))
        others = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("r") + F.col("m")).otherwise(F.col("r")) - 1)
        second = reached.join(blocks, "group").select("key", "node", "group", block.alias("own"), F.explode(others).alias("other"))
        second = second.select("key", "node", F.struct("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("task"))
        edges = edges.unionByName(_compare(keyed, second, repeated, words, similarity))
    return keep_least(docs, prints.join(components(edges), "node", "left").select("key", F.coalesce("root", "node").alias("root")))
