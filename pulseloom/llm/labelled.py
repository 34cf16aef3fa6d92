"""A bounded sample of labelled documents, for fitting on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, text_of

#: Folds of five: rows of fold 0 are held out.
FOLDS = 5


#: Bounds of a fitting sample: text bytes of a class, and of one text (longer ones are left to the other rows).
CLASS_BYTES, TEXT_BYTES = 16 << 20, 1 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = CLASS_BYTES, text_bytes: int = TEXT_BYTES) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """((label, text) of up to ``per_class`` documents of either class, labelled rows by class).

    Only rows outside the held-out fold and with a label of 0 or 1; those with the least hash of
    their id, whatever the size of the tables, while their whole texts stay within ``class_bytes``. Texts over ``text_bytes`` are not
    drawn; no text is cut. The ids of the sample are few and are broadcast, so no text is shuffled.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != 0))
    counts = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = F.xxhash64("doc_id")
    few = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(rank, "doc_id").limit(per_class)
        few = part if few is None else few.unionByName(part)
    texts = docs.select("doc_id", F.coalesce(text_of(), F.lit("")).alias("text")).filter(F.octet_length("text") <= text_bytes)
    rows = texts.join(F.broadcast(few), "doc_id").orderBy(rank, "doc_id", "text").limit(2 * per_class)
    drawn = Window.partitionBy("y").orderBy(rank, "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(drawn)).filter(F.col("bytes") <= class_bytes).orderBy(rank, "doc_id", "text").select("y", "text")
    return [(int(r["y"]), r["text"]) for r in rows.collect()], counts


def segments(lengths: np.ndarray, most: int) -> np.ndarray:
    """Lengths of chains cut into pieces of up to ``most``, in order: fitting goes over short chains, and no position is left out."""
    out: list[int] = []
    for n in lengths.tolist():
        whole, rest = divmod(int(n), most)
        out += [most] * whole + [rest] * bool(rest)
    return np.array(out, np.int64)
