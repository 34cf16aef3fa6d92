"""Files of lines, read in as many tasks as they have splits, with every line's number in its file.

Spark says in which block of which file it found a line, and a task reads a block in order. So a line's number is its number in the block plus
the lines of the blocks before, a prefix sum over a table of a row per block. Numbered lines are written once: a second scan might be split
otherwise, as splits depend on the cores there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import materialize


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, line) in the order of reading, with ``n``, the line's number in its block."""
    last, n = None, 0
    for b in batches:
        rows = b.num_rows
        if not rows:
            continue
        file, block = b.column(0), b.column(1)
        new = np.zeros(rows, bool)
        new[1:] = pc.or_(pc.not_equal(file.slice(1), file.slice(0, rows - 1)), pc.not_equal(block.slice(1), block.slice(0, rows - 1))).to_numpy(zero_copy_only=False)
        key = (file[0].as_py(), block[0].as_py())
        begin = np.flatnonzero(new)
        number = np.arange(rows, dtype=np.int64)
        if len(begin):
            # lines since the latest block of this batch began
            number -= np.where(np.cumsum(new) > 0, begin[np.maximum(np.cumsum(new) - 1, 0)], 0)
        head = int(begin[0]) if len(begin) else rows
        if key == last:
            number[:head] += n
        last = (file[rows - 1].as_py(), block[rows - 1].as_py())
        n = int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([file, block, pa.array(number), b.column(2)], names=["file", "block", "n", "line"])


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, returns: bool = False) -> DataFrame:
    """(file, pos, line) of text files or folders: pos counts all lines of a file from 0; a carriage return at a line's end goes, unless ``returns`` are kept. A missing path is an error."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.col("value") if returns else F.regexp_replace("value", r"\r\z", "")).alias("line"))
    rows = materialize(found.mapInArrow(_number, "file string, block long, n long, line string"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg((F.max("n") + 1).alias("lines")).select("file", "block", F.coalesce(F.sum("lines").over(ahead), F.lit(0)).alias("before"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("n")).alias("pos"), "line")
