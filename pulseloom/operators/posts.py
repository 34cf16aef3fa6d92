"""Selection and deduplication of community posts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

# What marks a notice or an advertisement in a lower-cased title.
NOTICE = ("공지", "notice", "광고", "ad ")


def is_normal(title: Column) -> Column:
    low, ok = F.lower(title), F.coalesce(title, F.lit("")) != ""
    for t in NOTICE:
        ok = ok & ~F.contains(low, F.lit(t))
    return F.coalesce(ok, F.lit(False))


def select_posts(stubs: DataFrame, k: int, order: str = "pos") -> DataFrame:
    """The first k posts of different id that are no notice. The pools with and without comments come after and add nothing."""
    w = Window.partitionBy("post_id").orderBy(order)
    return stubs.filter(is_normal(F.col("title"))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(order).limit(k)


def evidence(title: Column, body: Column, comments: Column) -> Column:
    return (F.coalesce(title, F.lit("")) != "") | (F.coalesce(body, F.lit("")) != "") | (F.coalesce(F.size(comments), F.lit(0)) > 0)


_KEPT, _DROPPED, _OPEN = 1, 2, 0


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (order, keys, outside) of a range in order, with their fate as far as the range itself decides it."""
    kept: set[str] = set()
    undecided: set[str] = set()
    for b in batches:
        fates = []
        for own, outside in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if any(k in kept for k in own):
                fates.append(_DROPPED)
            elif outside or any(k in undecided for k in own):
                undecided.update(own)
                fates.append(_OPEN)
            else:
                kept.update(own)
                fates.append(_KEPT)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fates, pa.int32())], names=[b.schema.names[0], "keys", "fate"])


def greedy_dedup(posts: DataFrame, order: str = "pos", keys: tuple[str, ...] = ("post_id", "url", "content_hash"), range_rows: int = 200_000) -> DataFrame:
    """First come, first kept over three keys; adds ``dropped_by`` (NULL: kept).

    Only kept rows register their keys, so a row's fate hangs on the rows before it that share a key, directly or in a chain: the kept rows are the lexicographically first
    independent set of the graph of shared keys. Rows none of whose keys is shared are kept at once. The others go in rounds:
    cut into ranges of the order, of up to ``range_rows``, each range is read in order by a task; a row is kept if no earlier row that shares a key is undecided or kept, and
    dropped if one is kept. Whether earlier ranges hold an undecided row of the same key comes from an aggregation by key, so that a key of any share of the rows is
    combined before it is shuffled. After each round, rows that share a key with a kept one go. The first undecided range is always decided whole,
    so a chain through everything takes a round for each range, and anything less entangled a few rounds.

    A NULL key, or an empty one but the first, registers nothing; rows without any key are kept. ``order`` must be unique.
    """
    nodes = [F.when(F.col(k).isNotNull() & ((F.lit(i) == 0) | (F.col(k) != "")), F.concat_ws(":", F.lit(str(i)), F.col(k))) for i, k in enumerate(keys)]
    flat = posts.select(order, F.explode(F.array_compact(F.array(*nodes))).alias("key"))
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    tied = materialize(flat.join(shared, "key").groupBy(order).agg(F.collect_list("key").alias("keys")))
    kind = posts.schema[order].dataType.simpleString()
    left, kept = tied, tied.limit(0)
    while n := left.count():
        ranges = -(-n // range_rows)
        placed = left.repartitionByRange(ranges, order).withColumn("part", F.spark_partition_id())
        if ranges > 1:
            placed = materialize(placed)
            each = placed.select(order, "part", F.explode("keys").alias("key"))
            first = each.groupBy("key").agg(F.min("part").alias("first"))
            outside = each.join(first, "key").filter("first < part").select(order, F.lit(True).alias("outside")).distinct()
            placed = placed.join(outside, order, "left").withColumn("outside", F.col("outside").isNotNull()).repartition(ranges, "part")
        else:
            placed = placed.withColumn("outside", F.lit(False))
        walked = materialize(placed.sortWithinPartitions(order).select(order, "keys", "outside").mapInArrow(_walk, f"`{order}` {kind}, keys array<string>, fate int"))
        now = walked.filter(F.col("fate") == _KEPT).select(order, "keys")
        left = walked.filter(F.col("fate") == _OPEN).select(order, "keys")
        if ranges > 1:
            taken = now.select(F.explode("keys").alias("key")).distinct()
            gone = left.select(order, F.explode("keys").alias("key")).join(taken, "key").select(order).distinct()
            left = materialize(left.join(gone, order, "left_anti"))
        kept = kept.unionByName(now)
    # each key has one kept row at most; it drops what comes after it
    owners = kept.select(F.col(order).alias("_owner"), F.explode("keys").alias("key"))
    which = F.substring_index("key", ":", 1).cast("int")
    fates = tied.select(order, F.explode("keys").alias("key")).join(owners, "key").filter(F.col("_owner") < F.col(order)).groupBy(order).agg(F.min(which).alias("_which"))
    named = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("_which") + 1)
    return posts.join(fates.select(order, named.alias("dropped_by")), order, "left")
