"""One collection run: stored series and saved pages to a new series and its metadata, or to nothing at all.

The plan (range, overlap, calendar) decides which pages count. Their rows are classified and brought to hours by one aggregation in which every row counts: rows that
give no bar gather under a NULL hour. So the series and all counters come from the same pass, and they are exact even where a lost
executor makes Spark repeat a part of it (an accumulator, which ``DataFrame.observe`` is, would count that part twice).

Gates stand before anything is replaced: unknown calendar years, no trading day, incomplete pages, nothing accepted. Both files are
staged first and then moved; if the second cannot be moved, the first one is put back.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timefn import YEARS, check_years, in_session, iso, session_bucket
from ..operators.bars import change_rate
from ..operators.incremental import OVERLAP_HOURS, NoTradingDays, effective_from, refuse_empty, trading_days
from ..operators.validate import INSTRUMENT, SYMBOL, index_records
from ..schemas import HOURLY_BAR
from ..shared import materialize
from ..sinks import commit, exists, run_metadata, stage_jsonl, stage_text, to_contract
from ..sources import broker_pages, market_files

COUNTERS = ("received", "accepted", "rejected", "target_date", "other_date", "invalid_time", "invalid_price", "out_of_session")


class PagesIncomplete(RuntimeError):
    """A request's chain of pages has a fault."""


@dataclass
class Run:
    """What is asked of a run. ``as_of`` stands for the wall clock."""

    first: str
    last: str
    output: str
    metadata: str
    as_of: str
    provider: str = "broker"
    source: str = "broker-api"
    overlap_hours: int = OVERLAP_HOURS
    force: bool = False
    dry_run: bool = False
    versions: dict[str, str] = field(default_factory=dict)


def hours_with_counters(rows: DataFrame) -> DataFrame:
    """Bars by (day, hour) of classified rows, and under a NULL hour what gave none; each row with the counters of the rows behind it."""
    s = F.col("status")
    session = F.coalesce(in_session(F.col("ts")), F.lit(False))
    good = (s == "accepted") & session
    at = F.struct("ts", "page", "pos")
    n = lambda c: F.count_if(c)
    counts = {
        "received": F.count(F.lit(1)), "accepted": n(s == "accepted"), "rejected": n(~good), "target_date": n(F.col("time_status") == "target"), "other_date": n(s == "other_date"),
        "invalid_time": n(s == "invalid_time"), "invalid_price": n(s == "invalid_price"), "out_of_session": n((s == "accepted") & ~session),
    }
    b = rows.groupBy("day", F.when(good, session_bucket(F.col("ts"))).alias("hour")).agg(
        F.min_by("open", at).alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", at).alias("c"),
        F.when(F.count("volume") == F.count(F.lit(1)), F.bround(F.sum("volume"), 4)).alias("volume"), F.bool_or("is_partial").alias("is_partial"), *[v.alias(k) for k, v in counts.items()],
    )
    price = [F.bround(F.col(k[0]), 4).alias(k) for k in ("open", "high", "low", "close")]
    return b.select("day", "hour", *price, "volume", change_rate(F.col("o"), F.col("c")).alias("change_rate"), "is_partial", *COUNTERS)


def merge_counted(existing: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("provider", "instrument_id", "timestamp")) -> DataFrame:
    """One record per key, the newest observed (at a tie the earlier one), and ``replaced``: how often a later record took an earlier one's place. One shuffle."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("_side", "seq").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_won", F.coalesce(F.col("observed_at") > F.max("observed_at").over(w), F.lit(False)).cast("long"))
    kept = [c for c in existing.columns if c not in keys]
    newest = F.max_by(F.struct(*kept), F.struct("observed_at", (-F.col("_side")).alias("s"), (-F.col("seq")).alias("q")))
    return both.groupBy(*keys).agg(newest.alias("_row"), F.sum("_won").alias("replaced")).select(*keys, "_row.*", "replaced")


def _records(hours: DataFrame, run: Run) -> DataFrame:
    said: dict[str, Column] = {
        "timestamp": iso(F.col("hour")), "market": F.lit(SYMBOL), "instrument_id": F.lit(INSTRUMENT), "symbol": F.lit(SYMBOL), "source": F.lit(run.source), "provider": F.lit(run.provider),
        "asset_type": F.lit("index"), "observed_at": F.lit(run.as_of), "data_mode": F.lit("real"),
    }
    return hours.select(F.lit(0).cast("long").alias("seq"), *[c.alias(k) for k, c in said.items()], "open", "high", "low", "close", "volume", "change_rate", "is_partial")


def collect_run(spark: SparkSession, pages: DataFrame, run: Run, faults: DataFrame | None = None) -> dict:
    """Apply ``pages`` (day yyyyMMdd, page, body) to the series at ``run.output``; returns a summary.

    ``faults``: rows with a ``reason`` for chains of pages that are not complete; any of a planned day refuses the run. A table of pages without a day of the plan
    is a run in which nothing was accepted.
    """
    check_years(run.first, run.last)
    columns = [c.split()[0] for c in HOURLY_BAR.split(", ")]
    if not run.force and exists(spark, run.output):
        stored, bad = market_files.load_existing(spark, run.output)
        stored = index_records(stored, run.provider)
        broken = bad.count()
        latest = stored.agg(F.max("timestamp")).first()[0] or ""
    else:
        stored = index_records(spark.createDataFrame([], f"seq long, {HOURLY_BAR}"), run.provider)
        broken, latest = 0, ""
    start = effective_from(run.first, run.last, latest, run.overlap_hours, run.force)
    days = [r[0] for r in trading_days(spark, start, run.last).orderBy("day").collect()]  # a year or so at most
    if not days:
        if run.dry_run:
            return {"dryRun": True, "status": "NO_TRADING_DAYS"}
        raise NoTradingDays(f"no trading day in {start}..{run.last}")
    planned = F.broadcast(spark.createDataFrame([(d.strftime("%Y%m%d"),) for d in days], "day string"))
    if faults is not None and (f := faults.join(planned, "day", "left_semi").first()) is not None:
        raise PagesIncomplete(f"{f['day']}: {f['reason']}")
    asked = pages.join(planned, "day", "left_semi")
    hours = materialize(hours_with_counters(broker_pages.classify(broker_pages.page_rows(asked))))
    bar = F.col("hour").isNotNull()
    n = hours.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.count_if(bar).alias("hourly_records"), F.count_if(bar & F.col("is_partial")).alias("partial_buckets"), F.collect_set(F.when(bar, F.col("day"))).alias("days")).first().asDict()
    seen = set(n.pop("days"))
    names = [d.isoformat() for d in days]
    if run.dry_run:
        return {"dryRun": True, "requestedDates": names, "recordsReceived": n["received"], "recordsAccepted": n["hourly_records"], "recordsRejected": n["rejected"]}
    refuse_empty(n["hourly_records"], len(days))
    fresh = index_records(_records(hours.filter(bar), run), run.provider)
    fit = F.col("reject_reason").isNull()
    unfit = stored.unionByName(fresh).filter(~fit).count()
    merged = materialize(merge_counted(stored.filter(fit).drop("reject_reason"), fresh.filter(fit).drop("reject_reason")))
    n["rejected"] += broken + unfit
    n["duplicates_removed"] = merged.agg(F.coalesce(F.sum("replaced"), F.lit(0))).first()[0]
    warnings = tuple(f"no bar on {d.isoformat()}" for d in days if d.strftime("%Y%m%d") not in seen)
    told = run_metadata(n, merged, (run.first, run.last), run.as_of, run.provider, asked.count(), run.overlap_hours, start, latest, warnings, years=YEARS, versions=run.versions)
    series = to_contract(merged.select(*columns))
    commit(spark, [(stage_jsonl(series, run.output, ["timestamp"]), run.output), (stage_text(spark, json.dumps(told, ensure_ascii=False, indent=2), run.metadata), run.metadata)])
    return {"status": "OK", "records": merged.count(), "requestedDates": names, "output": run.output, "metadata": told}
