"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in order of their names (null last) weigh 1, 2, 3, 1, ... and share the words of
the corpus; no target passes ``max_repeats`` times its source's words, the excess goes to the others by
weight. A schedule of equal-token slots follows: slot i maps the golden-ratio point
frac(i * 0.618...) through the cumulative targets to a source, so every stretch of the
schedule holds each source in its share. Slots are ranked per source; rank r takes block r of the source's stream: its documents
laid end to end in shuffled order, again and again up to the target, cut into equal runs of words.

The schedule has at most ``slots`` slots whatever the corpus. The points of a source decide how many slots it has, and its blocks are
its target divided equally among these (to within a word), so that its slots together take exactly its target; a source so small that no point falls on
its share gets one slot after the others. In every stretch of N slots a source with share s has s N slots to within 2 + 0.6 ln N.
``pieces`` is the mix itself, slot by slot; ``mix`` sums it by document. Positions in a source's stream come
from prefix sums over a hash order in three levels, so that no task holds a whole source. The sources themselves, a row each, are ranked in one task.

Defined cases: a null text has size 0; documents of size 0 take 0; a null source is a source, last in
order; repeated rows are documents of their own; documents of equal hash stand by id, then size; a very long text is counted whole and spans as many blocks as it needs; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
SLOTS = 1 << 17


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(skey, source_size, target, goal, lo, hi): goal is the target in whole words, hi - lo the source's share of the schedule."""
    by = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    w = by.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    cap = F.col("source_size") * max_repeats
    every = Window.partitionBy()
    order = Window.orderBy(cap / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"cap": cap.cast("double"), "total": F.sum("source_size").over(every).cast("double")})
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    w = w.withColumn("full", F.col("level") > F.col("cap") / F.col("weight"))
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    left = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    level = F.when(left > 0, (F.col("total") - taken) / left).otherwise(0.0)
    w = w.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")))
    running = Window.orderBy("skey")
    w = w.withColumn("hi", F.coalesce(F.try_divide(F.sum("target").over(running), F.col("total")), F.lit(0.0)))
    w = w.withColumn("lo", F.coalesce(F.lag("hi").over(running), F.lit(0.0)))
    w = w.withColumn("hi", F.when(F.row_number().over(Window.orderBy(F.col("skey").desc())) == 1, 2.0).otherwise(F.col("hi")))
    return w.select("skey", "source_size", "target", F.floor(F.col("target") + 0.5).alias("goal"), "lo", "hi")


def schedule(targets: DataFrame, total: int, slots: int = SLOTS, ratio: float = GOLDEN) -> DataFrame:
    """(slot, skey, rank, n): the slots in order, each with its source, its rank among the n slots of that source."""
    spark = targets.sparkSession
    n_slots, cells = min(slots, total), 1024
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") * ratio % 1).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    asked = targets.filter("hi > lo and goal > 0")
    spans = asked.select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(1.0)) * cells))).alias("cell"))
    met = points.join(spans, "cell").filter("u >= lo and u < hi").select("slot", "skey")
    # a share so small that no point falls on it
    last = Window.orderBy("skey")
    missed = targets.filter("goal > 0").join(met.select("skey").distinct(), "skey", "left_anti").select((F.row_number().over(last) + n_slots - 1).cast("long").alias("slot"), "skey")
    every = met.unionByName(missed)
    by = Window.partitionBy("skey")
    return every.withColumns({"rank": (F.row_number().over(by.orderBy("slot")) - 1).cast("long"), "n": F.count(F.lit(1)).over(by)})


def stream_positions(sizes: DataFrame) -> DataFrame:
    """Adds ``start``: the words before the document in its source's shuffled order."""
    h = F.xxhash64("doc_id", "size")
    d = sizes.withColumns({"h": h, "b1": F.shiftrightunsigned(h, 54), "b2": F.shiftrightunsigned(h, 44).bitwiseAND(1023)})
    fine = d.groupBy("skey", "b1", "b2").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("skey", "b1").agg(F.sum("n").alias("n"))

    def ahead(part: list[str], order: str):
        return F.sum("n").over(Window.partitionBy(*part).orderBy(order)) - F.col("n")

    coarse = coarse.select("skey", "b1", ahead(["skey"], "b1").alias("o1"))
    fine = fine.select("skey", "b1", "b2", ahead(["skey", "b1"], "b2").alias("o2"))
    offsets = fine.join(coarse, ["skey", "b1"]).select("skey", "b1", "b2", (F.col("o1") + F.col("o2")).alias("o"))
    inner = Window.partitionBy("skey", "b1", "b2").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("own", F.sum("size").over(inner) - F.col("size"))
    return d.join(offsets, ["skey", "b1", "b2"]).withColumn("start", F.col("o") + F.col("own")).drop("h", "b1", "b2", "o", "own")


def pieces(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", slots: int = SLOTS, max_repeats: int = 3, ratio: float = GOLDEN) -> DataFrame:
    """The mix, a row for each stretch of a document that a slot takes: (slot, first, words, row, doc_id, source, size, source_size, target).

    ``first`` is the first word of the stretch within the document. In the order of (slot, place in the source's stream) the stretches are the mix. A document of which
    no slot takes anything has one row with a null slot and 0 words.
    """
    s = F.col(source).cast("string")
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        s.alias("source"),
        F.when(s.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), s)).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("row", F.monotonically_increasing_id())
    sizes = materialize(sizes)
    targets = materialize(source_targets(sizes, max_repeats))
    total = int(targets.agg(F.sum("source_size")).first()[0] or 0)
    dealt = materialize(schedule(targets, total, slots, ratio))
    counted = dealt.groupBy("skey").agg(F.max("n").alias("n"))
    known = small(materialize(targets.join(counted, "skey", "left").drop("lo", "hi")), 96)  # a row per source; a source's documents then stay where they are
    placed = stream_positions(sizes).join(known, "skey")
    # one stretch of the repeated stream for each time that a document comes round, up to the target
    starts = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.struct((F.col("start") + e * F.col("source_size")).alias("a"), F.least(F.col("start") + e * F.col("source_size") + F.col("size"), "goal").alias("z")))
    placed = placed.withColumn("times", F.filter(starts, lambda t: t["a"] < t["z"]))
    # block r holds the words from floor(r goal / n) on; the ranks whose blocks a stretch meets
    rank = lambda at: F.expr(f"(({at} + 1) * n - 1) div goal")
    met = placed.withColumn("t", F.explode_outer("times")).withColumn("rank", F.explode_outer(F.sequence(rank("t.a"), rank("t.z - 1")))).drop("times")
    begin, end = F.greatest(F.col("t.a"), F.expr("rank * goal div n")), F.least(F.col("t.z"), F.expr("(rank + 1) * goal div n"))
    met = met.withColumns({"first": F.expr("greatest(t.a, rank * goal div n) - t.a"), "words": F.coalesce(F.greatest(end - begin, F.lit(0)), F.lit(0)).cast("long")})
    slot = small(dealt.select("skey", "rank", "slot"), 40)
    return met.join(slot, ["skey", "rank"], "left").select("slot", "first", "words", "row", "doc_id", "source", "size", "source_size", "target")


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", slots: int = SLOTS, max_repeats: int = 3, ratio: float = GOLDEN) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source), taken (words that the slots take of it) and first_slot (the slot where it first comes up, else null)."""
    each = pieces(docs, text, id_col, source, slots, max_repeats, ratio)
    whole = ["doc_id", "source", "size", "source_size", "target"]
    by = each.groupBy("row", *whole).agg(F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot"))
    return by.select(*whole, "taken", "first_slot")
