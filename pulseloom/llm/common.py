"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import slices
from ..shared import materialize, shared_dir

#: Estimated bytes up to which a table is sent to every task; a larger one is joined by shuffling both sides.
BROADCAST_BYTES = 64 << 20

__all__ = ["fold", "materialize", "partitions", "shared_dir", "slices", "small", "table", "text_of", "unused", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null id: as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names (in any case) an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has in no spelling, for a column that an operator adds for a while."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text as a string that Python can read: bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its counted rows of ``row_bytes`` each fit the limit; ``df`` should be written out already."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
