"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: hang each node's neighbours (larger ones, or smaller ones and itself) on their least."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    met = edges.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
    else:
        out = met.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        out = out.unionByName(least.select("u", F.col("least").alias("v")))
    return out.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of one orderable type) but the roots.

    The root is the least node of a component. Every round is written to the shared folder; the rounds
    grow with the logarithm of the longest path. Self-links and repeated edges do no harm; an
    empty table gives an empty result.
    """
    u, v = F.col("u"), F.col("v")
    edges = edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = materialize(edges)
    before = _state(edges)
    while before[0]:
        edges = materialize(_stars(_stars(edges, True), False))
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
