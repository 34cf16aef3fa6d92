"""Registered queries over whole flows: collection runs, pagination, streams, interval joins and forward values.

As in ``records``, inputs are rendered from the driver's tables. Days of ``events`` are moved by a constant number of days into the year whose calendar is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import provider, timefn
from ..operators import bars, decay, extensions, intervals, sketches
from ..schemas import HOURLY_BAR
from ..shared import shared_dir
from ..sinks import merge_days, to_contract, write_jsonl, write_text
from ..sources import broker_pages, html, market_files, pagination
from ..streaming import upsert
from .catalog import _POSTS, _STAMP, event_posts, query, t
from .collector import Run, collect_run

#: Days from the events' first day to the first day of the calendar's April.
_SHIFT = 822
_CLOSED_SQL = ", ".join(f"DATE '{d}'" for d in timefn.CLOSED)


def moved_events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz") + F.make_interval(days=F.lit(_SHIFT)))


# ---------------------------------------------------------------- collection run

_RUN = {"first": "2026-04-01", "last": "2026-05-15", "as_of": "2026-05-16T00:00:00+09:00", "overlap_hours": 60}
_STORED_UNTIL = "2026-04-14"


def _bodies(e: DataFrame) -> DataFrame:
    """Pages of a broker, a day's rows in three of them for each 1000 ids, some rows of another day, at no time or without a price; and a page whose table is none."""
    k, v = F.col("event_id"), F.round(F.col("value") * 100).cast("bigint").cast("string")
    at = F.date_format(F.when(k % 7 == 0, F.col("ts") + F.make_interval(days=F.lit(1))).otherwise(F.col("ts")), "yyyyMMddHHmmss")
    row = F.struct(
        F.concat(F.lit("-"), v).alias("cur_prc"), F.when(k % 5 != 0, F.col("user_id").cast("string")).alias("trde_qty"), F.when(k % 11 == 0, "x").otherwise(at).alias("cntr_tm"), F.concat(F.lit("+"), v).alias("open_pric"), v.alias("high_pric"),
        F.when(k % 13 == 0, "0").otherwise(v).alias("low_pric"), F.date_format("ts", "SSSSSS").alias(broker_pages.FRACTION),
    )
    p = e.select(F.date_format("ts", "yyyyMMdd").alias("day"), (F.floor(k / 1000) * 3 + k % 3).cast("long").alias("page"), F.struct("event_id", row.alias("row")).alias("x"))
    p = p.groupBy("day", "page").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["row"]).alias(broker_pages.TABLE))
    none = e.select(F.date_format("ts", "yyyyMMdd").alias("day")).distinct().select("day", F.lit(-1).cast("long").alias("page"), F.lit('{"inds_min_pole_qry": 3}').alias("body"))
    return p.select("day", "page", F.to_json(F.struct(F.lit(0).alias("return_code"), broker_pages.TABLE)).alias("body")).unionByName(none)


def _stored(e: DataFrame) -> DataFrame:
    """An hourly series of the events of even id before a day; every third hour was observed after the run."""
    half = e.filter((F.col("event_id") % 2 == 0) & (F.col("ts") < F.lit(_STORED_UNTIL).cast("timestamp_ntz")) & (F.round(F.col("value") * 100) > 0))
    price = [F.col("value").alias(c) for c in ("open", "high", "low", "close")]
    b = bars.hourly_ohlc(half.select("ts", "event_id", *price, F.lit(None).cast("double").alias("volume")), [], order=("event_id",))
    late = F.when(F.hour("hour") % 3 == 0, "2027-01-01T00:00:00+09:00").otherwise("2026-04-20T00:00:00+09:00")
    named = {"timestamp": timefn.iso(F.col("hour")), "market": F.lit("KOSPI"), "instrument_id": F.lit("001"), "symbol": F.lit("KOSPI"), "source": F.lit("stored"), "provider": F.lit("broker"), "asset_type": F.lit("index"), "observed_at": late, "data_mode": F.lit("real")}
    b = b.withColumns(named)
    return b.select(*[c.split()[0] for c in HOURLY_BAR.split(", ")])


def _collected(spark: SparkSession, d: str) -> str:
    """Run the collector over the events; the folder that holds its two files."""
    e = moved_events(spark, d)
    folder = f"{shared_dir(spark)}/run-{spark._jvm.java.util.UUID.randomUUID()}"
    output = f"{folder}/series.jsonl"
    write_jsonl(to_contract(_stored(e)), output, ["timestamp"])
    lines = [r[0] for r in spark.read.text(output).collect()]  # an hourly series
    write_text(spark, "\n".join([*lines, "{damaged", '{"timestamp": "2026-04-01T09:00:00+09:00"}', ""]), output)
    collect_run(spark, _bodies(e), Run(output=output, metadata=f"{folder}/meta.json", versions={"collectorVersion": "1"}, **_RUN))
    return folder


_COLLECTED = f"""b AS (SELECT event_id, ts + INTERVAL {_SHIFT} DAY AS ts, (ts + INTERVAL {_SHIFT} DAY)::DATE AS day, (event_id // 1000) * 3 + event_id % 3 AS page, value, round(value * 100)::BIGINT::DOUBLE AS v, CASE WHEN event_id % 5 <> 0 THEN user_id::DOUBLE END AS volume,
  CASE WHEN event_id % 11 = 0 THEN 'invalid_time' WHEN event_id % 7 = 0 THEN 'other_date' WHEN event_id % 13 = 0 OR round(value * 100) = 0 THEN 'invalid_price' ELSE 'accepted' END AS status, hour(ts) * 60 + minute(ts) BETWEEN 540 AND 929 AS session FROM events),
old AS (SELECT date_trunc('hour', ts) AS hour, round_even(arg_min(value, (ts, event_id)), 4) AS open, round_even(max(value), 4) AS high, round_even(min(value), 4) AS low, round_even(arg_max(value, (ts, event_id)), 4) AS close, NULL::DOUBLE AS volume,
  round_even((arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / arg_min(value, (ts, event_id)) * 100, 4) AS change_rate, hour(date_trunc('hour', ts)) % 3 = 0 AS newer, hour(date_trunc('hour', ts)) = 15 AS partial FROM b WHERE event_id % 2 = 0 AND ts < TIMESTAMP '{_STORED_UNTIL}' AND session AND round(value * 100) > 0 GROUP BY 1, hour(date_trunc('hour', ts))),
eff AS (SELECT greatest(DATE '{_RUN["first"]}', coalesce((max(hour) - INTERVAL {_RUN["overlap_hours"]} HOUR)::DATE, DATE '{_RUN["first"]}')) AS day FROM old),
plan AS (SELECT day::DATE AS day FROM generate_series((SELECT day FROM eff), DATE '{_RUN["last"]}', INTERVAL 1 DAY) g(day) WHERE isodow(day) < 6 AND day::DATE NOT IN ({_CLOSED_SQL})),
asked AS (SELECT b.* FROM b JOIN plan USING (day)),
new AS (SELECT date_trunc('hour', ts) AS hour, arg_min(v, (ts, page, event_id)) AS open, max(v) AS high, min(v) AS low, arg_max(v, (ts, page, event_id)) AS close, CASE WHEN count(volume) = count(*) THEN round_even(sum(volume), 4) END AS volume,
  round_even((arg_max(v, (ts, page, event_id)) - arg_min(v, (ts, page, event_id))) / arg_min(v, (ts, page, event_id)) * 100, 4) AS change_rate, hour(date_trunc('hour', ts)) = 15 AS partial FROM asked WHERE status = 'accepted' AND session GROUP BY 1, hour(date_trunc('hour', ts))),
series AS (SELECT coalesce(n.hour, o.hour) AS hour, n.hour IS NOT NULL AND NOT coalesce(o.newer, false) AS fresh, n.hour IS NOT NULL AND o.hour IS NOT NULL AND NOT o.newer AS replaced,
  o.open AS o1, o.high AS o2, o.low AS o3, o.close AS o4, o.change_rate AS o6, o.partial AS o7, n.open AS n1, n.high AS n2, n.low AS n3, n.close AS n4, n.volume AS n5, n.change_rate AS n6, n.partial AS n7 FROM old o FULL JOIN new n ON o.hour = n.hour)"""


@query(
    "collector_series",
    f"""WITH {_COLLECTED} SELECT {_STAMP.format('hour')} AS timestamp, CASE WHEN fresh THEN 'broker-api' ELSE 'stored' END AS source, CASE WHEN fresh THEN n1 ELSE o1 END AS open, CASE WHEN fresh THEN n2 ELSE o2 END AS high, CASE WHEN fresh THEN n3 ELSE o3 END AS low,
  CASE WHEN fresh THEN n4 ELSE o4 END AS close, CASE WHEN fresh THEN n5 END AS volume, CASE WHEN fresh THEN n6 ELSE o6 END AS change_rate, CASE WHEN fresh THEN n7 ELSE o7 END AS is_partial FROM series""",
)
def q_collector_series(spark: SparkSession, d: str) -> DataFrame:
    """The series that a run leaves, read back from its file."""
    s = spark.read.schema("timestamp string, source string, open double, high double, low double, close double, volume double, changeRate double, isPartial boolean").json(f"{_collected(spark, d)}/series.jsonl")
    return s.withColumnsRenamed({"changeRate": "change_rate", "isPartial": "is_partial"})


_META = ("provider", "instrumentId", "symbol", "assetType", "dataMode", "apiContractVersion", "collectorVersion", "calendarSource", "calendarVersion", "requestedFrom", "requestedTo", "effectiveFrom", "effectiveTo", "latestTimestamp", "generatedAt", "existingLatestTimestamp")
_META_COUNTS = ("requestsMade", "recordsReceived", "recordsAccepted", "recordsRejected", "duplicatesRemoved", "partialBuckets", "overlapHours")


@query(
    "collector_metadata",
    f"""WITH {_COLLECTED} SELECT 'broker' AS "provider", '001' AS "instrumentId", 'KOSPI' AS "symbol", 'index' AS "assetType", 'real' AS "dataMode", '' AS "apiContractVersion", '1' AS "collectorVersion", '' AS "calendarSource", '' AS "calendarVersion",
  '{_RUN["first"]}' AS "requestedFrom", '{_RUN["last"]}' AS "requestedTo", (SELECT day FROM eff)::VARCHAR AS "effectiveFrom", {_STAMP.format("(SELECT max(hour) FROM series)")} AS "effectiveTo", {_STAMP.format("(SELECT max(hour) FROM series)")} AS "latestTimestamp",
  '{_RUN["as_of"]}' AS "generatedAt", {_STAMP.format("(SELECT max(hour) FROM old)")} AS "existingLatestTimestamp", (SELECT count(DISTINCT (day, page)) + count(DISTINCT day) FROM asked) AS "requestsMade", (SELECT count(*) FROM asked) AS "recordsReceived", (SELECT count(*) FROM new) AS "recordsAccepted",
  (SELECT count(*) FROM asked WHERE status <> 'accepted' OR NOT session) + 2 AS "recordsRejected", (SELECT count(*) FROM series WHERE replaced) AS "duplicatesRemoved", (SELECT count(*) FROM new WHERE partial) AS "partialBuckets", {_RUN["overlap_hours"]}::BIGINT AS "overlapHours",
  (SELECT coalesce(string_agg('no bar on ' || p.day::VARCHAR, '|' ORDER BY p.day), '') FROM plan p WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.hour::DATE = p.day)) AS "warnings", '2026' AS "supportedCalendarYears", false AS "noTradingDays" """,
)
def q_collector_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The 26 keys of a run's metadata, read back from its file."""
    schema = ", ".join([*(f"{c} string" for c in _META), *(f"{c} bigint" for c in _META_COUNTS), "warnings array<string>", "supportedCalendarYears array<bigint>", "noTradingDays boolean"])
    m = spark.read.text(f"{_collected(spark, d)}/meta.json", wholetext=True).select(F.from_json("value", schema).alias("m"), F.json_object_keys("value").alias("keys"))
    m = m.filter(F.size("keys") == 26).select("m.*")
    return m.withColumns({"warnings": F.array_join("warnings", "|"), "supportedCalendarYears": F.array_join("supportedCalendarYears", ",")})


# ---------------------------------------------------------------- streams


def _arrivals(spark: SparkSession, d: str, beyond: bool = True, files: int = 4) -> tuple[DataFrame, str]:
    """The events as a stream of that many files in order of their ids; some come 3 hours late and, ``beyond`` the overlap, some 20."""
    e = t(spark, d, "events")
    k = F.col("event_id")
    back = F.when((k % 10 == 0) & F.lit(beyond), 20).when(k % 4 == 0, 3).otherwise(0)
    ts = F.col("ts").cast("timestamp_ntz") - F.make_interval(hours=back)
    rows = e.select(F.col("event_type").alias("instrument_id"), ts.alias("ts"), (k * 7919 % 1000).alias("observed_at"), k.alias("seq"), F.col("value").alias("price"), "user_id")
    n = e.agg(F.max("event_id") + 1).first()[0] or 0
    folder = f"{shared_dir(spark)}/stream-{spark._jvm.java.util.UUID.randomUUID()}"
    for i in range(files):
        rows.filter((k >= n * i // files) & (k < n * (i + 1) // files)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


_ARRIVALS = """a AS (SELECT event_type AS instrument_id, ts - INTERVAL 1 HOUR * (CASE WHEN event_id % 10 = 0 THEN 20 WHEN event_id % 4 = 0 THEN 3 ELSE 0 END) AS ts, event_id * 7919 % 1000 AS observed_at, event_id AS seq, value AS price, user_id,
  (SELECT count(*) FROM range(1, 4) r(i) WHERE event_id >= (SELECT max(event_id) + 1 FROM events) * i // 4) AS batch FROM events),
m AS (SELECT batch, max(epoch_ms(max(ts))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 8 * 3600000 AS mark FROM a GROUP BY batch),
x AS (SELECT a.*, coalesce(epoch_ms(ts) < mark, false) AS late, date_trunc('hour', ts) AS hour FROM a JOIN m USING (batch)),
finish AS (SELECT max(epoch_ms(ts)) - 8 * 3600000 AS mark FROM a)"""


@query(
    "ext_stream_upsert",
    f"""WITH {_ARRIVALS}, w AS (SELECT *, observed_at > max(observed_at) OVER (PARTITION BY instrument_id, hour, late ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS won FROM x)
SELECT instrument_id, {_STAMP.format('hour')} AS timestamp, arg_min(observed_at, (-observed_at, seq)) FILTER (NOT late) AS observed_at, arg_min(seq, (-observed_at, seq)) FILTER (NOT late) AS seq, arg_min(price, (-observed_at, seq)) FILTER (NOT late) AS price,
  CASE WHEN count(*) FILTER (NOT late) > 0 THEN count(*) FILTER (NOT late AND won) END AS replaced, CASE WHEN count(*) FILTER (NOT late) > 0 THEN epoch_ms(hour) + 3600000 <= (SELECT mark FROM finish) END AS closed, count(*) FILTER (late) AS late FROM w GROUP BY instrument_id, hour""",
)
def q_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The stream's files one by one through the state of each bar, into a table."""
    rows, folder = _arrivals(spark, d)
    upsert.run_stream(upsert.ext_stream_upsert(rows), f"{folder}/out", f"{folder}/checkpoint")
    u = upsert.upserted(spark, f"{folder}/out")
    return u.select("instrument_id", timefn.iso(F.col("hour").cast("timestamp_ntz")).alias("timestamp"), "observed_at", "seq", "price", "replaced", "closed", "late")


@query(
    "ext_stream_sessions",
    """WITH a AS (SELECT user_id, ts - INTERVAL 1 HOUR * (CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END) AS ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS first FROM a),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, first DESC ROWS UNBOUNDED PRECEDING) AS n FROM g),
one AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 12 HOUR AS z, count(*) AS posts FROM s GROUP BY user_id, n)
SELECT user_id, strftime(a, '%Y-%m-%dT%H:%M:%S.%f') AS start, strftime(z, '%Y-%m-%dT%H:%M:%S.%f') AS end, posts FROM one WHERE epoch_ms(z) <= (SELECT epoch_ms(max(ts)) - 8 * 3600000 FROM a)""",
)
def q_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Posts of one user with pauses under half a day, in the stream's files one by one; sessions still open at the end stay in the state."""
    rows, folder = _arrivals(spark, d, beyond=False)
    upsert.run_stream(upsert.ext_stream_sessions(rows, "user_id", "12 hours"), f"{folder}/out", f"{folder}/checkpoint", mode="append")
    shown = lambda c: F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    return spark.read.parquet(f"{folder}/out").select("user_id", shown("start"), shown("end"), "posts")


# ---------------------------------------------------------------- range joins and forward values


@query(
    "ext_within_before",
    "WITH b AS (SELECT DISTINCT event_type AS kind, date_trunc('hour', ts) AS hour FROM events) SELECT strftime(b.hour, '%Y-%m-%dT%H:%M:%S+09:00') AS timestamp, b.kind, e.event_id FROM b JOIN events e ON e.event_type = b.kind AND e.ts >= b.hour - INTERVAL 90 MINUTE AND e.ts < b.hour",
)
def q_within_before(spark: SparkSession, d: str) -> DataFrame:
    """Events within 90 minutes before an hour that has events of their kind."""
    e = t(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    marks = e.select("kind", timefn.hour_of(F.col("ts")).alias("hour")).distinct()
    return intervals.ext_within_before(e, marks, ["kind"], "ts", "hour", 90).select(timefn.iso(F.col("hour")).alias("timestamp"), "kind", "event_id")


@query(
    "ext_overlapping",
    """WITH s AS (SELECT event_id, user_id, ts AS a, ts + INTERVAL 1 SECOND * (CASE WHEN event_id % 50 = 0 THEN 200000 WHEN event_id % 7 = 0 THEN 0 ELSE user_id * 60 + event_id % 600 END) AS z FROM events)
SELECT x.user_id, x.event_id AS first_id, y.event_id AS second_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a < y.z AND y.a < x.z AND x.a < x.z AND y.a < y.z""",
)
def q_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Spans of one user, of seconds up to days, that overlap."""
    k = F.col("event_id")
    long = F.when(k % 50 == 0, 200_000).when(k % 7 == 0, 0).otherwise(F.col("user_id") * 60 + k % 600)
    s = t(spark, d, "events").select(k, "user_id", F.col("ts").cast("timestamp_ntz").alias("a")).withColumn("z", F.col("a") + F.make_interval(secs=long))
    named = [s.select("user_id", F.col("event_id").alias(f"{n}_id"), F.col("a").alias(f"{n}_a"), F.col("z").alias(f"{n}_z")) for n in ("first", "second")]
    met = intervals.ext_overlapping(*named, ["user_id"], ("first_a", "first_z"), ("second_a", "second_z"))
    return met.filter("first_id < second_id").select("user_id", "first_id", "second_id")


_FORWARD = (5, 15, 30, 60)


@query(
    "ext_forward_value",
    "WITH r AS (SELECT event_type AS kind, ts, min(value) AS v FROM events GROUP BY ALL), q AS (SELECT event_id, event_type AS kind, ts, m, ts + INTERVAL 1 MINUTE * m AS target FROM events, unnest([5, 15, 30, 60]) AS u(m)), a AS (SELECT q.event_id, q.m, CASE WHEN r.ts <= q.target + INTERVAL 45 MINUTE THEN r.v END AS v FROM q ASOF LEFT JOIN r ON q.kind = r.kind AND r.ts >= q.target) SELECT event_id, "
    + ", ".join(f"max(v) FILTER (m = {m}) AS after_{m}m" for m in _FORWARD)
    + " FROM a GROUP BY event_id",
)
def q_forward_value(spark: SparkSession, d: str) -> DataFrame:
    """The first value of the same kind 5, 15, 30 and 60 minutes after each event, at most 45 minutes later than that."""
    e = t(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    return intervals.ext_forward_value(e.drop("value"), e, ["kind"], "ts", "value", _FORWARD, 45).drop("kind", "ts")


@query(
    "ext_next_session",
    f"""WITH e AS (SELECT event_id, ts + INTERVAL {_SHIFT} DAY AS ts, value FROM events), days AS (SELECT day::DATE AS day FROM generate_series(DATE '2026-03-01', DATE '2026-06-30', INTERVAL 1 DAY) g(day) WHERE isodow(day) < 6 AND day::DATE NOT IN ({_CLOSED_SQL})),
h AS (SELECT date_trunc('hour', ts) AS hour, min(value) AS low FROM e GROUP BY 1),
p AS (SELECT event_id, ts, ts::DATE IN (SELECT day FROM days) AS trading, hour(ts) * 60 + minute(ts) AS m FROM e),
s AS (SELECT event_id, CASE WHEN trading AND m >= 540 AND m < 930 THEN NULL WHEN trading AND m < 540 THEN ts::DATE ELSE (SELECT min(day) FROM days WHERE day > ts::DATE) END + INTERVAL 9 HOUR AS session FROM p)
SELECT event_id, {_STAMP.format('session')} AS session_hour, low AS session_value FROM s LEFT JOIN h ON h.hour = s.session""",
)
def q_next_session(spark: SparkSession, d: str) -> DataFrame:
    """The lowest value in the first hour of the next session after each event that is out of session."""
    e = moved_events(spark, d).select("event_id", "ts", "value")
    low = e.groupBy(timefn.hour_of(F.col("ts")).alias("hour")).agg(F.min("value").alias("low"))
    n = intervals.ext_next_session(e.drop("value"), low, "ts", "hour", "low", "2026-03-31", "2026-05-31")
    return n.select("event_id", timefn.iso(F.col("session_hour")).alias("session_hour"), "session_value")


# ---------------------------------------------------------------- saved pagination

_LIMIT = 35


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Forty events a request as linked pages: chains that end, come round, lose their key, lack a page or their first one, or never end; some pages are saved twice."""
    e = t(spark, d, "events").select("event_id", (F.col("event_id") % 40).alias("i"), F.floor(F.col("event_id") / 40).alias("b"))
    last, kind, k = F.col("i") == 5 + F.col("b") % 25, F.col("b") % 8, F.col("event_id")
    following = F.when(last & (kind == 1), F.concat(F.lit("k"), F.col("b") * 40 + 3)).when(last & (kind == 2), " ").otherwise(F.concat(F.lit("k"), k + 1))
    more = F.when(last & ~kind.isin(1, 2, 4), "N").otherwise(F.when(k % 3 == 0, "y").otherwise("Y"))
    e = e.filter(~((kind == 3) & last) & ~((kind == 5) & (F.col("i") == 0)))
    p = e.select(
        F.concat(F.lit("r"), "b").alias("request"), F.when(F.col("i") > 0, F.concat(F.lit("k"), k)).alias("key"), F.create_map(F.lit("Cont-YN"), more, F.lit("next-key"), following).alias("headers"), F.concat(F.lit('{"id": '), k, F.lit("}")).alias("body"), k.alias("seq"),
    )
    twice = p.filter("seq % 9 = 0").withColumns({"headers": F.create_map(F.lit("Cont-YN"), F.lit("N")), "seq": F.col("seq") + 1_000_000_000})
    return pagination.from_headers(p.unionByName(twice))


_WALK = f"""e AS (SELECT event_id, event_id % 40 AS i, event_id // 40 AS b, event_id % 40 = 5 + (event_id // 40) % 25 AS last, (event_id // 40) % 8 AS kind FROM events),
p AS (SELECT b, event_id, CASE WHEN i = 0 THEN '' ELSE 'k' || event_id END AS key, CASE WHEN last AND kind = 1 THEN 'k' || (b * 40 + 3) WHEN last AND kind = 2 THEN '' ELSE 'k' || (event_id + 1) END AS next, NOT (last AND kind NOT IN (1, 2, 4)) AS more FROM e WHERE NOT (kind = 3 AND last) AND NOT (kind = 5 AND i = 0)),
w AS (SELECT b, 0 AS pos, event_id, next, more, [next] AS seen, CASE WHEN NOT more THEN 'complete' WHEN next = '' THEN 'empty_next_key' WHEN NOT EXISTS (SELECT 1 FROM p n WHERE n.b = p.b AND n.key = p.next) THEN 'missing_page' END AS outcome FROM p WHERE key = ''
  UNION ALL SELECT w.b, w.pos + 1, p.event_id, p.next, p.more, list_append(w.seen, p.next), CASE WHEN NOT p.more THEN 'complete' WHEN p.next = '' THEN 'empty_next_key' WHEN list_contains(w.seen, p.next) THEN 'repeated_key' WHEN w.pos + 1 = {_LIMIT - 1} THEN 'over_limit'
    WHEN q.key IS NULL THEN 'missing_page' END FROM w JOIN p ON p.b = w.b AND p.key = w.next LEFT JOIN p q ON q.b = p.b AND q.key = p.next WHERE w.outcome IS NULL)"""


@query(
    "page_faults",
    f"WITH RECURSIVE {_WALK} SELECT 'r' || b AS request, max(outcome) AS reason, count(*) AS pages FROM w GROUP BY b HAVING max(outcome) <> 'complete' UNION ALL SELECT 'r' || b, 'missing_page', 0 FROM p GROUP BY b HAVING count(*) FILTER (key = '') = 0",
)
def q_page_faults(spark: SparkSession, d: str) -> DataFrame:
    return pagination.faults(pagination.follow(_responses(spark, d), _LIMIT))


@query("ordered_pages", f"WITH RECURSIVE {_WALK} SELECT 'r' || b AS request, pos::BIGINT AS page, event_id FROM w WHERE b IN (SELECT b FROM w WHERE outcome = 'complete')")
def q_ordered_pages(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    return pagination.ordered_pages(r, pagination.follow(r, _LIMIT)).select("request", "page", F.get_json_object("body", "$.id").cast("long").alias("event_id"))


# ---------------------------------------------------------------- files of lines in splits


@query("jsonl_splits", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id, event_type AS kind, value FROM events")
def q_jsonl_splits(spark: SparkSession, d: str) -> DataFrame:
    """All events in one JSON-lines file, read in splits of 64 KB."""
    target = f"{shared_dir(spark)}/lines-{spark._jvm.java.util.UUID.randomUUID()}.jsonl"
    write_jsonl(t(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), "value"), target, ["event_id"])
    most = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(most)
    spark.conf.set(most, "64k")
    try:
        rows = market_files.read_file(spark, target)
    finally:
        spark.conf.set(most, before)
    g = lambda k: F.element_at("raw", F.lit(k))
    return rows.select("pos", g("event_id").cast("long").alias("event_id"), g("kind").alias("kind"), g("value").cast("double").alias("value"))


# ---------------------------------------------------------------- a table merged day by day


@query(
    "merged_days",
    """WITH b AS (SELECT event_type AS kind, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, value, event_id AS seq, '2026-01-0' || (event_id % 7 + 1) || ' 00:00:00' AS observed_at, ts::DATE AS day, 0 AS side FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT event_type, strftime(ts, '%Y-%m-%dT%H:%M'), value + 1, event_id, '2026-01-0' || (event_id % 5 + 2) || ' 00:00:00', ts::DATE, 1 FROM events WHERE day(ts) % 3 = 0)
SELECT kind, minute, value, seq, observed_at, day::VARCHAR AS day FROM b QUALIFY row_number() OVER (PARTITION BY kind, minute ORDER BY observed_at DESC, side, observed_at, seq, value) = 1""",
)
def q_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """Half of the events as a stored table, then all events of every third day merged into it."""
    target = f"{shared_dir(spark)}/days-{spark._jvm.java.util.UUID.randomUUID()}"
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    k = F.col("event_id")

    def rows(x: DataFrame, value: Column, observed: Column) -> DataFrame:
        at = F.concat(F.lit("2026-01-0"), observed, F.lit(" 00:00:00"))
        return x.select(F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("minute"), at.alias("observed_at"), k.alias("seq"), value.alias("value"), F.to_date("ts").alias("day"))

    for part in (rows(e.filter(k % 2 == 0), F.col("value"), k % 7 + 1), rows(e.filter(F.dayofmonth("ts") % 3 == 0), F.col("value") + 1, k % 5 + 2)):
        merge_days(spark, target, part, ["kind", "minute"], "day", ["minute", "kind"])
    return spark.read.parquet(target).select("kind", "minute", "value", "seq", "observed_at", F.col("day").cast("string").alias("day"))


# ---------------------------------------------------------------- decay, sketches, providers


@query(
    "ext_decayed_index",
    f"""WITH {_POSTS}, h AS (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (direction <> 'unrelated') AS n, coalesce(sum(CASE direction WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE WHEN 'unrelated' THEN NULL ELSE 0.0::DOUBLE END), 0) AS total FROM posts GROUP BY 1)
SELECT {_STAMP.format('a.hour')} AS timestamp, round(sum(b.total * pow(0.5, epoch(a.hour - b.hour) / 43200.0)), 6) AS decayed_total, round(sum(b.n * pow(0.5, epoch(a.hour - b.hour) / 43200.0)), 6) AS decayed_n FROM h a JOIN h b ON b.hour <= a.hour GROUP BY a.hour""",
)
def q_decayed_index(spark: SparkSession, d: str) -> DataFrame:
    """Sums of an hourly index, each post's weight halved every twelve hours."""
    p = event_posts(spark, d)
    score = F.when(F.col("direction") == "positive", 1.0).when(F.col("direction") == "negative", -1.0).otherwise(0.0)
    h = p.groupBy(timefn.hour_of(F.col("ts")).alias("hour")).agg(F.count_if(F.col("direction") != "unrelated").alias("n"), F.sum(score).alias("total"))
    s = decay.ext_decayed_sums(h, [], "hour", ["total", "n"], 12.0)
    return s.select(timefn.iso(F.col("hour")).alias("timestamp"), F.round("decayed_total", 6).alias("decayed_total"), F.round("decayed_n", 6).alias("decayed_n"))


@query("ext_sketches", "SELECT ts::DATE::VARCHAR AS day, count(DISTINCT event_id // 3) AS items, true AS near, true AS same FROM events GROUP BY ts::DATE")
def q_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Days merged from hourly sketches against exact counts, and against days merged from hours of single kinds of events."""
    e = t(spark, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.floor(F.col("event_id") / 3).alias("item"), "event_type")
    hourly = sketches.ext_sketches(e, [F.date_trunc("HOUR", "ts").alias("hour"), "event_type"], "item")
    day = F.to_date("hour").alias("day")
    merged = sketches.ext_merge_sketches(hourly, [day])
    twice = sketches.ext_merge_sketches(sketches.ext_merge_sketches(hourly, ["event_type", day]), ["day"])
    exact = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("item").alias("items"))
    met = exact.join(merged.select("day", sketches.ext_estimate().alias("one")), "day").join(twice.select("day", sketches.ext_estimate().alias("two")), "day")
    near = F.abs(F.col("one") - F.col("items")) <= F.col("items") * sketches.error_bound() + 1
    return met.select(F.col("day").cast("string").alias("day"), "items", near.alias("near"), (F.col("one") == F.col("two")).alias("same"))


@query(
    "ext_provider_labels",
    """WITH r AS (SELECT CASE WHEN doc_id % 31 = 0 THEN 'provider:ConnectionError' WHEN doc_id % 23 = 0 THEN 'no_label' WHEN doc_id % 19 = 0 THEN 'stance' WHEN doc_id % 17 = 0 THEN 'notes' END AS reason FROM documents)
SELECT coalesce(reason, 'valid') AS outcome, count(*) AS n, round_even(count(*)::DOUBLE / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY reason""",
)
def q_provider_labels(spark: SparkSession, d: str) -> DataFrame:
    """All documents through a provider that fails, stays silent or answers wrongly on some; shares of outcomes."""
    k = F.col("doc_id")
    mark = F.when(k % 31 == 0, "!poison").when(k % 23 == 0, "!silent").when(k % 19 == 0, "!odd").when(k % 17 == 0, "!bare").when(k % 7 == 0, "!later").otherwise("")
    docs = t(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), mark).alias("text"))
    labelled = provider.ext_provider_labels(docs, "rehearsal", provider.Rehearsal, pause=0.001)
    by = labelled.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("_all"))
    return by.crossJoin(F.broadcast(total)).select("outcome", "n", F.bround(F.col("n") / F.col("_all"), 6).alias("share"))


# ---------------------------------------------------------------- a folder of files, pseudonyms, health of sources


@query("folder_rows", "SELECT event_id AS id, event_type AS instrument_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+09:00') AS timestamp, value AS price FROM events")
def q_folder_rows(spark: SparkSession, d: str) -> DataFrame:
    """A folder with a JSON-lines file, CSV files and JSON documents of up to 1000 events, read together."""
    folder = f"{shared_dir(spark)}/folder-{spark._jvm.java.util.UUID.randomUUID()}"
    k = F.col("event_id")
    e = t(spark, d, "events").select(k, F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("event_type").alias("code"), F.col("value").alias("price"), k.cast("string").alias("volume"))
    write_jsonl(e.filter(k % 3 == 0).drop("event_id"), f"{folder}/a.jsonl", ["volume"])
    e.filter(k % 3 == 1).drop("event_id").write.option("header", "true").csv(f"{folder}/b")
    blocks = e.filter(k % 3 == 2).groupBy(F.floor(k / 3000).alias("block")).agg(F.collect_list(F.struct("time", "code", "price", "volume")).alias("data"))
    blocks.write.partitionBy("block").json(f"{folder}/c")
    r = market_files.resolve(market_files.read_folder(spark, folder))
    return r.select(F.col("volume").cast("long").alias("id"), "instrument_id", timefn.iso(F.col("ts")).alias("timestamp"), "price")


_SECRET = b"a key of our own"
_PADS = [bytes(x ^ pad for x in _SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(
    "ext_pseudonyms",
    f"""SELECT event_id, sha256(unhex('{_PADS[1]}' || sha256(unhex('{_PADS[0]}' || hex(encode(event_type || user_id)))))) AS author FROM events""",
)
def q_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """Users of each source by keyed digests."""
    e = t(spark, d, "events")
    return e.select("event_id", extensions.ext_pseudonym(F.col("event_type"), F.col("user_id").cast("string"), _SECRET).alias("author"))


@query(
    "ext_source_health",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, TIMESTAMP '2026-01-01' + INTERVAL 1 MINUTE * page_id AS seen, regexp_matches(html, '<a href="[^"]+">[^<]+</a>') AS good FROM pages)
SELECT host, count(*) AS pages, round_even(count(*) FILTER (good)::DOUBLE / count(*), 6) AS parse_success, round_even(epoch(TIMESTAMP '2026-01-03' - max(seen)) / 3600.0::DOUBLE, 4) AS freshness_hours, epoch(TIMESTAMP '2026-01-03' - max(seen)) / 3600.0 > 45.0 AS is_stale FROM p GROUP BY host""",
)
def q_source_health(spark: SparkSession, d: str) -> DataFrame:
    """Of each host the share of pages that have a link with text, and the age of its newest page."""
    pages = t(spark, d, "pages")
    seen = F.lit("2026-01-01").cast("timestamp_ntz") + F.make_interval(mins=F.col("page_id").cast("int"))
    named = pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), seen.cast("timestamp").alias("seen"))
    as_of = F.lit("2026-01-03").cast("timestamp_ntz").cast("timestamp")
    return extensions.ext_source_health(named, html.links(pages, ("page_id",)), "page_id", "host", "seen", as_of, 45.0)
