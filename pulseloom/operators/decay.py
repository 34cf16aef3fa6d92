"""Extension: exponentially decayed sums over a series, by a prefix scan in blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import micros

_HOUR = 3_600_000_000


def ext_decayed_sums(series: DataFrame, by: list[str], ts: str, values: list[str], half_life_hours: float, block_hours: float = 24.0) -> DataFrame:
    """For each column v of ``values`` adds ``decayed_<v>``: the sum of v over the rows up to this one's time, each halved for every ``half_life_hours`` of its age. NULL counts as 0.

    Inside a block, values are weighted up to the block's start and summed by a running window over (keys, block). A block's own sum, weighted to its end, is one row of a table of
    blocks; there the state is carried from block to block, a group per key whose rows are blocks and not records. Rows of equal time have equal sums. A block may not be
    longer than 500 half-lives, so that no weight leaves the range of doubles; longer ones are cut to that. Rows without a time have NULL sums.
    """
    half, block = half_life_hours * _HOUR, int(min(block_hours, 500 * half_life_hours) * _HOUR)
    named = {v: f"decayed_{v}" for v in values}
    d = series.withColumn("_t", micros(ts)).withColumn("_block", F.expr(f"floor(_t / {block})"))
    inside = (F.col("_t") - F.col("_block") * block) / half  # half-lives since the block's start
    d = d.withColumn("_in", inside)
    w = Window.partitionBy(*by, "_block").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    own = d.withColumns({f"_s_{v}": F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0)) * F.pow(F.lit(2.0), "_in")).over(w) for v in values})
    ends = d.filter("_t is not null").groupBy(*by, "_block").agg(*[F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0)) * F.pow(F.lit(2.0), F.col("_in") - block / half)).alias(f"_e_{v}") for v in values])
    columns = [f"_c_{v}" for v in values]

    def carry(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block").reset_index(drop=True)
        state, at, out = [0.0] * len(values), None, []
        for number, *sums in blocks[["_block", *[f"_e_{v}" for v in values]]].itertuples(index=False):
            # what had come together at the end of the block before, at the start of this one
            fade = 0.0 if at is None else 0.5 ** ((number - at - 1) * block / half)
            state = [s * fade for s in state]
            out.append(state)
            state, at = [s * 0.5 ** (block / half) + x for s, x in zip(state, sums, strict=True)], number
        return pd.concat([blocks[[*by, "_block"]], pd.DataFrame(out, columns=columns)], axis=1)

    keyed = ends if by else ends.withColumn("_all", F.lit(0))
    kinds = [f"`{c}` {series.schema[c].dataType.simpleString()}" for c in by] + ["_block long", *[f"{c} double" for c in columns]]
    carried = keyed.groupBy(*(by or ["_all"])).applyInPandas(carry, ", ".join(kinds))
    carried = carried.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_at"), *columns)
    met = own.join(carried, [F.col("_block") == F.col("_at"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)], "left")
    fade = F.pow(F.lit(0.5), "_in")
    out = met.withColumns({n: (F.col(f"_s_{v}") + F.col(f"_c_{v}")) * fade for v, n in named.items()})
    return out.select(*series.columns, *named.values())
