"""Sinks that replace their target at once or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import camel
from .shared import materialize

METHODOLOGY = "hourly-index-v1"
UNAVAILABLE = {"status": "unavailable", "reason": "real_session_data_not_available"}


def to_contract(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Columns in camel case (or as ``names`` says), for the JSON edge."""
    names = names or {}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, camel(c))) for c in df.columns])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def commit(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Move every (staged, target), all or none: if one fails, the targets before it get their old files back and what is staged goes."""
    done: list[tuple[str, str | None]] = []
    try:
        for staged, target in moves:
            fs, dst, jvm = _fs(spark, target)
            old = f"{target}.{uuid.uuid4().hex}.old" if fs.exists(dst) else None
            fs.mkdirs(dst.getParent())
            if old and not fs.rename(dst, jvm.org.apache.hadoop.fs.Path(old)):
                raise OSError(f"cannot set {target} aside")
            done.append((target, old))
            if not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), dst):
                raise OSError(f"cannot move {staged} to {target}")
    except Exception:
        for target, old in reversed(done):
            fs, dst, jvm = _fs(spark, target)
            fs.delete(dst, True)
            if old:
                fs.rename(jvm.org.apache.hadoop.fs.Path(old), dst)
        for staged, _ in moves:
            fs, src, _ = _fs(spark, staged)
            fs.delete(src, True)
        raise
    for _, old in done:
        if old:
            fs, path, _ = _fs(spark, old)
            fs.delete(path, True)


def stage_jsonl(df: DataFrame, target: str, order: list[str], single_file: bool = True) -> str:
    """Write JSON lines in order, NULL fields kept, beside the target and return where: one file for the hourly series, whose size is bounded by time; else a folder of ordered files."""
    spark = df.sparkSession
    stage = f"{target}.{uuid.uuid4().hex}.tmp"
    if not single_file:
        df.orderBy(*order).write.option("ignoreNullFields", "false").json(stage)
        return stage
    folder = f"{stage}.parts"
    df.coalesce(1).sortWithinPartitions(*order).write.option("ignoreNullFields", "false").json(folder)
    fs, path, jvm = _fs(spark, folder)
    try:
        parts = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")]
        if not parts:
            return stage_text(spark, "", target)
        if not fs.rename(parts[0], jvm.org.apache.hadoop.fs.Path(stage)):
            raise OSError(f"cannot move {parts[0]} to {stage}")
    finally:
        fs.delete(path, True)
    return stage


def write_jsonl(df: DataFrame, target: str, order: list[str], single_file: bool = True) -> None:
    """JSON lines as ``stage_jsonl`` writes them, moved over the target at once."""
    commit(df.sparkSession, [(stage_jsonl(df, target, order, single_file), target)])


def stage_text(spark: SparkSession, text: str, target: str) -> str:
    stage = f"{target}.{uuid.uuid4().hex}.tmp"
    fs, path, _ = _fs(spark, stage)
    fs.mkdirs(path.getParent())
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return stage


def write_text(spark: SparkSession, text: str, target: str) -> None:
    commit(spark, [(stage_text(spark, text, target), target)])


def merge_days(spark: SparkSession, target: str, fresh: DataFrame, keys: list[str], day: str, order: list[str], observed: str = "observed_at") -> list:
    """Merge rows into the table at ``target``, partitioned by ``day``; of each key the newest observed row stays, at a tie the stored one. Returns the days that were rewritten.

    Only stored days that ``fresh`` names are read, and of these only the ones where a fresh row won are written again (dynamic partition overwrite, each replaced at once); all others keep
    their files. A day's files are ranges of ``order`` and sorted inside, so a large day is several tasks' work. A key stands in one day; of fresh rows with one
    key and one time of observation the least row counts; a time that is none is older than all.
    """
    columns = [c for c in fresh.columns if c != day]
    days = materialize(fresh.select(day).distinct())
    if exists(spark, target):
        stored = spark.read.parquet(target).select(*columns, day)
    else:
        stored = fresh.limit(0)
    touched = stored.join(F.broadcast(days), day, "left_semi")  # a row per date
    both = touched.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    kept = [c for c in columns if c not in keys]
    newest = F.min_by(F.struct(*kept, "_new"), F.struct(F.coalesce(-F.unix_micros(F.col(observed).try_cast("timestamp")), F.lit((1 << 63) - 1)).alias("t"), "_new", F.struct(*kept).alias("r")))
    merged = materialize(both.groupBy(day, *keys).agg(newest.alias("_r")).select(day, *keys, "_r.*"))
    changed = [r[0] for r in merged.filter("_new = 1").select(day).distinct().orderBy(day).collect()]
    if changed:
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        out = merged.join(F.broadcast(spark.createDataFrame([(x,) for x in changed], merged.select(day).schema)), day, "left_semi").select(*columns, day)
        out = out.repartitionByRange(n, day, *order).sortWithinPartitions(day, *order)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)
    return changed


def write_json(spark: SparkSession, payload: dict, target: str) -> None:
    write_text(spark, json.dumps(payload, ensure_ascii=False, indent=2), target)


def records(df: DataFrame) -> list[dict]:
    """Rows of a bounded result (an hourly series, a summary) as dictionaries, for a JSON document."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def dashboard_payload(joined: list[dict], overnight: dict | None = None, summary: dict | None = None, methodology: str = METHODOLOGY) -> dict:
    """Payload of the dashboard; what the caller gives is never overwritten, what is missing gets defaults."""
    s = {"methodologyVersion": methodology, "dataMode": "unavailable", "provider": ""}
    if joined:
        s |= {"lastUpdated": joined[-1].get("timestamp"), "marketSource": joined[-1].get("source", "")}
    return {"joined": joined, "overnight": UNAVAILABLE if overnight is None else overnight, "summary": s | (summary or {})}


# The calendar and contract a run names in its metadata.
IDENTITY = {"provider": "", "instrumentId": "001", "symbol": "KOSPI", "assetType": "index", "dataMode": "real"}


def run_metadata(
    counters: dict, series: DataFrame, requested: tuple[str, str], generated_at: str, provider: str, requests_made: int = 0, overlap_hours: int = 0, effective_from: str = "", existing_latest: str = "",
    warnings: tuple[str, ...] = (), no_trading_days: bool = False, years: tuple[int, ...] = (2026,), versions: dict[str, str] | None = None,
) -> dict:
    """Metadata of a collection run: always the same 26 keys, free of secrets.

    ``counters``: as ``broker_pages.run_counters`` gives them, with ``duplicates_removed`` of the merge. ``versions`` names
    apiContractVersion, collectorVersion, calendarSource and calendarVersion.
    """
    r = series.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    named = dict.fromkeys(("apiContractVersion", "collectorVersion", "calendarSource", "calendarVersion"), "") | (versions or {})
    return IDENTITY | {"provider": provider} | named | {
        "requestedFrom": requested[0], "requestedTo": requested[1], "effectiveFrom": effective_from or r["a"] or requested[0], "effectiveTo": r["b"] or requested[1], "requestsMade": requests_made,
        "recordsReceived": counters.get("received", 0), "recordsAccepted": counters.get("hourly_records", 0), "recordsRejected": counters.get("rejected", 0), "duplicatesRemoved": counters.get("duplicates_removed", 0), "partialBuckets": counters.get("partial_buckets", 0),
        "latestTimestamp": r["b"] or "", "generatedAt": generated_at, "warnings": list(warnings), "overlapHours": overlap_hours, "existingLatestTimestamp": existing_latest, "supportedCalendarYears": list(years), "noTradingDays": no_trading_days,
    }
