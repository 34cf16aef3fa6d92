"""Exact top-k inner products by a Voronoi join.

Components become the integers floor(256 * x). Pivots cut the space into cells; of each cell two bounded
summaries are kept: the largest distance of a member from the pivot, and the k + 1 ids nearest to it with their distances.
By Cauchy-Schwarz a member x of a cell with pivot p has q.p - |q| |x - p| <= q.x <= q.p + |q| |x - p|.
The left side, over the cells' nearest members of other ids than the query's, bounds its k-th best score from
below; a cell whose right side is under that bound holds nothing for it. The bounds are taken
per query group (the queries of neighbouring cells): a cell goes to a group only if some
query of the group needs it. Cells and groups are cut into blocks of bounded size, so a cell that holds a third of
all rows is solved in many tasks; each block keeps its k best per query, and a last ranking merges them.

The number of pivots follows the square root of the number of rows, between fixed bounds; they are taken from a sample of bounded size.

Every vector with finite components is indexed, scores are exact integers, ties go to the smaller id. Defined
cases: null vectors, and those with null or non-finite components, take no part (nor do double components beyond 2**400, which no 32-bit float reaches); integers of
any size are kept as doubles, which hold them exactly; scores beyond 64 bits rank by their exact values and are returned as the nearest 64-bit integer; vectors pair with those of their own
length only; empty vectors score 0 with one another; repeated ids are rows of their own (a query meets every row with another id); rows without an id take no part; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 5
#: Least and most pivots; candidates for a pivot.
PIVOTS, SAMPLE = (16, 1024), 8
#: Rows of a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 8192, 8192
_SLACK = 1e-6
#: Rounding of a product against the product of the norms.
_ROUNDING = 1e-12
_GREATEST, _HUGE = (1 << 63) - 1, 2.0**400


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<double>) of the rows that take part; the components are whole numbers."""
    v = F.col(vector)
    ok = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < _HUGE), F.lit(False)))

    def whole(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 62), F.floor(y).cast("double")).otherwise(y)  # beyond 2**53 every double is whole

    return vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(v, whole).alias("v")).filter("id is not null")


def _rank_key(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    n = (abs(score).bit_length() + 7) // 8
    body = abs(score).to_bytes(n, "big")
    return bytes([128 + n]) + body if score >= 0 else bytes([127 - n]) + bytes(255 - x for x in body)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _assign(pivots: np.ndarray, dim: int):
    """Cell and distance of each vector. Vectors whose products may pass 2**53 are solved in Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots * pivots).sum(1)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                d2 = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + squares
                cell = d2.argmin(1)
                dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["id", "v", "cell", "dist"])

    return run


def _needed(queries: DataFrame, pivots: np.ndarray, summary: dict[int, tuple[float, list[tuple[float, int]]]], dim: int, k: int) -> list[tuple[int, int]]:
    """(group, cell) pairs: the cells that some query of the group needs; at most the square of the pivots."""
    cells = np.array(sorted(summary))
    far = np.array([summary[c][0] for c in cells])
    norm = np.sqrt((pivots[cells] ** 2).sum(1))
    near = [(i, d, x) for i, c in enumerate(cells) for d, x in summary[c][1]]
    at, gap, ids = np.array([i for i, _, _ in near]), np.array([d for _, d, _ in near]), np.array([x for _, _, x in near], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                q = _matrix(part.column(1), dim)
                size = np.sqrt((q * q).sum(1))[:, None]
                dot = q @ pivots[cells].T
                blur = _ROUNDING * size * norm
                low = (dot - blur)[:, at] - size * gap * (1 + _ROUNDING)
                # rows of the query's own id are no neighbours, however many there are
                low[part.column(0).to_numpy()[:, None] == ids] = -np.inf
                floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] >= k else np.full(len(q), -np.inf)
                high = dot + size * far
                slack = _SLACK * (np.abs(high) + size * far + 1) + blur
                for i, j in zip(*np.nonzero(high + slack >= floor[:, None]), strict=True):
                    found.add((int(part.column(2)[int(i)].as_py()), int(cells[j])))
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())], names=["grp", "cell"])

    return [(r[0], r[1]) for r in queries.mapInArrow(run, "grp int, cell int").distinct().collect()]


def _groups(pivots: np.ndarray, asked: dict[int, int]) -> dict[int, int]:
    """Query group of each cell: neighbouring cells share one until it has a block of queries, for a row goes out once per group."""
    out, group, filled = {}, 0, 0
    for c in sorted(asked, key=lambda c: float(pivots[c] @ pivots[0])):
        if filled and filled + asked[c] > QUERY_BLOCK:
            group, filled = group + 1, 0
        out[c] = group
        filled += asked[c]
    return out


def _solve(dim: int, k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, rows: pa.Table) -> pa.Table:
        out_q, out_v, out_s, out_k = [], [], [], []
        if queries.num_rows and rows.num_rows:
            qid, rid = queries.column("q_id").to_numpy(), rows.column("id").to_numpy()
            r = _matrix(rows.column("v").combine_chunks(), dim)
            order = np.argsort(rid, kind="stable")
            rid, r = rid[order], r[order]
            q_all = _matrix(queries.column("q_v").combine_chunks(), dim)
            exact = dim * (np.abs(r).max(initial=0) or 1) * (np.abs(q_all).max(initial=0) or 1) < 2**53
            if not exact:
                whole, q_whole = (np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape) for m in (r, q_all))
            for s in range(0, len(qid), 256):
                score = q_all[s : s + 256] @ r.T if exact else np.array(q_whole[s : s + 256] @ whole.T, object)
                for i, q in enumerate(qid[s : s + 256]):
                    own = score[i]
                    other = rid != q
                    if exact:
                        if not other.all():
                            own = np.where(other, own, -np.inf)
                        n = min(k, int(other.sum()))
                        if not n:
                            continue
                        least = np.partition(own, len(own) - n)[len(own) - n]
                        near = np.flatnonzero((own >= least) & other)
                        best = near[np.argsort(-own[near], kind="stable")[:n]]
                    else:
                        best = sorted(np.flatnonzero(other).tolist(), key=lambda j: (-own[j], rid[j]))[:k]
                    out_q += [int(q)] * len(best)
                    out_v += [int(rid[j]) for j in best]
                    for j in best:
                        score_j = int(own[j])
                        out_s.append(max(-_GREATEST - 1, min(_GREATEST, score_j)))
                        out_k.append(_rank_key(score_j))
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64()), "key": pa.array(out_k, pa.binary())})

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (id, v) that ``is_query`` selects, against all rows."""
    spark = vectors.sparkSession
    vectors = materialize(vectors.withColumn("dim", F.size("v")))
    every = None
    for dim, rows_in in sorted(map(tuple, vectors.groupBy("dim").count().collect())):
        own = vectors.filter(F.col("dim") == dim).select("id", "v")
        # a bounded, reproducible choice of pivots, of distinct vectors
        n_pivots = pivots or max(PIVOTS[0], min(PIVOTS[1], math.isqrt(rows_in) // 2))
        drawn = own.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE * n_pivots)
        chosen = drawn.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").collect()
        p = np.array([list(r[0]) for r in chosen], np.float64).reshape(len(chosen), dim)
        placed = materialize(own.mapInArrow(_assign(p, dim), "id long, v array<double>, cell int, dist double"))
        # one row an id: with k + 1 ids, k are left whichever the query's is
        w = Window.partitionBy("cell").orderBy("dist", "id")
        nearest = placed.groupBy("cell", "id").agg(F.min("dist").alias("dist")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
        near = {r["cell"]: sorted((d["dist"], d["id"]) for d in r["d"]) for r in nearest.groupBy("cell").agg(F.collect_list(F.struct("dist", "id")).alias("d")).collect()}
        totals = placed.groupBy("cell").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("nq")).collect()
        summary = {r["cell"]: (r["far"], near[r["cell"]]) for r in totals}
        queries = placed.filter(is_query)
        pairs = _needed(queries, p, summary, dim, k)
        if not pairs:
            continue
        sizes = {r["cell"]: (r["n"], r["nq"]) for r in totals}
        group = _groups(p, {c: nq for c, (_, nq) in sizes.items() if nq})
        asks = {g: sum(sizes[c][1] for c in group if group[c] == g) for g in set(group.values())}
        rows_of = [(g, c, sizes[c][0], asks[g], -(-sizes[c][0] // BLOCK), -(-asks[g] // QUERY_BLOCK)) for g, c in sorted({(group[g], c) for g, c in pairs})]
        met = spark.createDataFrame(rows_of, "grp int, cell int, n long, nq long, blocks int, qblocks int")
        grouped = spark.createDataFrame(sorted(group.items()), "cell int, grp int")
        cut = lambda size, column: F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col(column) / size))).cast("int")
        rows = placed.join(F.broadcast(met.select("grp", "cell", "n", "qblocks")), "cell").withColumn("block", cut(BLOCK, "n"))
        rows = rows.select("id", "v", "grp", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("qblocks").cast("int") - 1)).alias("qblock"))
        asked = queries.join(F.broadcast(grouped), "cell").drop("cell").join(F.broadcast(met.select("grp", "cell", "nq", "blocks")), "grp").withColumn("qblock", cut(QUERY_BLOCK, "nq"))
        renamed = [F.col(c).alias(f"q_{c}") for c in ("id", "v", "grp", "cell", "qblock")]
        asked = asked.select(*renamed, F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("q_block"))
        by = ["grp", "cell", "block", "qblock"]
        solved = asked.groupBy(*[f"q_{c}" for c in by]).cogroup(rows.groupBy(*by)).applyInArrow(_solve(dim, k), "query_id long, vec_id long, score long, key binary")
        every = solved if every is None else every.unionByName(solved)
    if every is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("key").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
