"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in ``spark.checkpoint.dir``; ``release`` removes it, ``keep_only`` and ``discard`` remove single tables.

    A session on one machine that names none (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        where = context.getCheckpointDir()
        if where:
            where = where.rsplit("/", 1)[0]
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pulseloom-"))
            where = context.getCheckpointDir().rsplit("/", 1)[0]
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{where.rstrip('/')}/{spark.sparkContext.applicationId}"


_made: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a reread and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def keep_only(build: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``build`` returns as a table and remove the tables that were made on the way to it.

    For the steps of a long run: what a step has left behind is gone when its result is written. Frames made inside ``build`` must not be used afterwards.
    """
    outer = _made.get()
    made: list[str] = []
    token = _made.set(made)
    try:
        out = materialize(build())
    finally:
        _made.reset(token)
    spark = out.sparkSession
    for path in made:
        if path != out._table:
            _delete(spark, path)
    if outer is not None:
        outer.append(out._table)
    return out


def discard(df: DataFrame) -> None:
    """Remove the table behind a frame of ``materialize`` or ``keep_only``; any other frame is left alone."""
    if path := vars(df).get("_table"):
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of the application, once its results are written."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
