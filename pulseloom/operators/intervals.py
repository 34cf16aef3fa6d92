"""Range and interval joins by bins, and values forward in time.

An inequality between times becomes an equality of bins: a span is listed in the bins that it touches, of which there are two at most if a bin is as long as
the span, and the exact condition follows. A pair that meets in two bins counts in one of them only, so no pair has to be made distinct.
A bin (with its keys) that holds more than ``hot_rows`` rows of the left side is split: its left rows are dealt by hash, its right rows are copied to each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import is_trading_day
from ..shared import materialize

HOT_ROWS = 1 << 20
#: Rows of both sides up to which the spans of a key meet without bins: a row then meets no more than these.
FEW_ROWS = 1024
#: Length in microseconds of the shortest bins of ``ext_overlapping``; each further level doubles it.
_BASE = 1 << 20
#: Length of a bin of the column ``_level``.
_WIDTH = f"({_BASE} * CAST(pow(2.0D, greatest(_level, 0)) AS BIGINT))"
#: The level whose bins are longer than all representable time.
_TOP = 44
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """A wall-clock time as microseconds; a time with a zone is taken as the session shows it."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, CAST(`{ts}` AS TIMESTAMP_NTZ))")


def split_hot(left: DataFrame, right: DataFrame, on: list[str], hot_rows: int, suspected: str = "true") -> tuple[DataFrame, DataFrame]:
    """Both sides of an equality join on the columns ``on``, with a further one, ``_salt``: keys of more than ``hot_rows`` left rows are dealt to several parts, and their right rows copied to each.

    The table of hot keys has at most a row for each ``hot_rows`` rows and is broadcast, so that no side is shuffled for it. NULL keys are never dealt.
    ``suspected`` says which left rows need counting: all rows of any key that may be hot.
    """
    hot = left.filter(suspected).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > hot_rows) & ~F.expr(" or ".join(f"`{c}` is null" for c in on)))
    hot = hot.select(*[F.col(c).alias(f"_hot{i}") for i, c in enumerate(on)], F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))

    def met(side: DataFrame) -> DataFrame:
        same = [F.col(c) == F.col(f"_hot{i}") for i, c in enumerate(on)]
        return side.join(F.broadcast(hot), same, "left").drop(*[f"_hot{i}" for i in range(len(on))])

    parts = F.coalesce("_parts", F.lit(1))
    dealt = met(left).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int"))
    copied = met(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_parts"), copied.drop("_parts")


def ext_within_before(points: DataFrame, marks: DataFrame, by: list[str], ts: str, mark: str, minutes: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every (point, mark) with equal keys and mark - minutes <= ts < mark.

    Columns of both sides, whose names must differ but for the keys. Rows with a null key or time meet nothing; repeated rows meet each other as often as they stand there.
    """
    width = minutes * 60_000_000
    p = points.withColumn("_t", micros(ts)).withColumn("_bin", F.expr(f"floor(_t / {width})"))
    m = marks.withColumn("_m", micros(mark)).withColumn("_first", F.expr(f"floor((_m - {width}) / {width})"))
    m = m.withColumn("_bin", F.explode(F.array(F.col("_first"), F.col("_first") + 1))).drop("_first")
    p, m = split_hot(p, m, [*by, "_bin"], hot_rows)
    met = p.join(m, [*by, "_bin", "_salt"]).filter((F.col("_t") >= F.col("_m") - width) & (F.col("_t") < F.col("_m")))
    return met.drop("_bin", "_salt", "_t", "_m")


def ext_overlapping(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], hot_rows: int = HOT_ROWS, few_rows: int = FEW_ROWS) -> DataFrame:
    """Every (left, right) with equal keys whose spans [start, end) overlap. Columns of both sides, whose names must differ but for the keys.

    Keys of up to ``few_rows`` rows on both sides together need no bins: each of their spans is sent once. Spans of the others meet on levels, whose bins double in length.
    A span is at home on the level where it touches two bins at most, and a guest on those higher levels that are a home to spans of its key on the other side;
    a pair counts on the higher one of its homes, in the bin of the later start. Empty and reversed spans, and rows with a null key or time, meet nothing.
    """

    def levelled(side: DataFrame, span: tuple[str, str], a: str, z: str) -> DataFrame:
        d = side.withColumns({a: micros(span[0]), z: micros(span[1])}).filter(F.col(a) < F.col(z))
        return d.withColumn(f"{a}_home", F.greatest(F.lit(0), F.ceil(F.log2((F.col(z) - F.col(a)) / _BASE))).cast("int"))

    lefts, rights = levelled(left, left_span, "_a", "_az"), levelled(right, right_span, "_b", "_bz")
    # keys of many rows, at most one for each few_rows rows, with the homes of each side as bits; a key without rows on a side has NULL there, and no levels
    homes = [d.select(*by, *[(F.expr(f"shiftleft(1L, {c})") if c == home else F.lit(None).cast("long")).alias(f"{c}s") for c in ("_a_home", "_b_home")]) for d, home in ((lefts, "_a_home"), (rights, "_b_home"))]
    many = homes[0].unionByName(homes[1]).groupBy(*by).agg(F.bit_or("_a_homes").alias("_a_homes"), F.bit_or("_b_homes").alias("_b_homes"), F.count("_a_homes").alias("_rows"), F.count(F.lit(1)).alias("_n"))
    many = materialize(many.filter(F.col("_n") > min(few_rows, hot_rows)).drop("_n"))
    many = many.withColumnsRenamed({c: f"_many{i}" for i, c in enumerate(by)})

    def binned(d: DataFrame, a: str, z: str, others: str) -> DataFrame:
        d = d.join(many, [F.col(c) == F.col(f"_many{i}") for i, c in enumerate(by)], "left")
        met = f"filter(sequence({a}_home, {_TOP}), x -> ({others} & if(x = {a}_home, shiftleft(1L, x + 1) - 1, shiftleft(1L, x))) <> 0)"
        d = d.withColumn("_level", F.explode(F.expr(f"if(_rows is null, array(-1), {met})")))
        bins = f"sequence(floor({a} / {_WIDTH}), floor(({z} - 1) / {_WIDTH}))"
        d = d.withColumn("_bin", F.explode(F.expr(f"if(_level < 0, array(0L), {bins})")))
        return d.drop(*[f"_many{i}" for i in range(len(by))], "_a_homes", "_b_homes")

    p, m = binned(lefts, "_a", "_az", "_b_homes"), binned(rights, "_b", "_bz", "_a_homes").drop("_rows")
    p, m = split_hot(p, m, [*by, "_level", "_bin"], hot_rows, f"_rows > {hot_rows}")
    met = p.join(m, [*by, "_level", "_bin", "_salt"])
    once = F.expr(f"_level < 0 or greatest(_a_home, _b_home) = _level and _bin = floor(greatest(_a, _b) / {_WIDTH})")
    met = met.filter((F.col("_a") < F.col("_bz")) & (F.col("_b") < F.col("_az")) & once)
    return met.drop("_level", "_bin", "_salt", "_rows", "_a", "_az", "_b", "_bz", "_a_home", "_b_home")


def ext_forward_value(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str, minutes: tuple[int, ...], tolerance: int) -> DataFrame:
    """For each m of ``minutes`` adds ``after_<m>m``: the first ``value`` of ``right`` at or after ts + m minutes, NULL if it is more than ``tolerance`` minutes later or there is none.

    A union and one window per key and day; what a day has no later value for comes from a table of a row per key and day. Of values at the same time the least counts; null values are none.
    """
    every = left.withColumn("_id", F.monotonically_increasing_id())
    asked = every.select("_id", *by, F.col(ts).cast("timestamp_ntz").alias("_t"), F.explode(F.array(*[F.lit(m) for m in minutes])).alias("_m"))
    asked = asked.withColumn("_t", F.col("_t") + F.make_interval(mins=F.col("_m")))
    known = right.filter(F.col(value).isNotNull()).groupBy(*by, F.col(ts).cast("timestamp_ntz").alias("_t")).agg(F.min(value).alias("_v"))
    known = known.withColumn("_v", F.struct(F.col("_t").alias("at"), F.col("_v").alias("v")))
    both = asked.withColumn("_v", F.lit(None).cast(known.schema["_v"].dataType)).unionByName(known, allowMissingColumns=True).withColumn("_day", F.to_date("_t"))
    # latest first, so that a running frame holds what comes later; a value at the very time stands before those who ask
    w = Window.partitionBy(*by, "_day").orderBy(F.col("_t").desc(), F.col("_v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    days = both.groupBy(*by, "_day").agg(F.min(F.when(F.col("_v").isNotNull(), F.col("_v"))).alias("_start"))
    after = Window.partitionBy(*by).orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = days.withColumn("_carry", F.last("_start", ignorenulls=True).over(after)).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_day").alias("_on"), "_carry")
    own = both.withColumn("_own", F.last("_v", ignorenulls=True).over(w)).filter("_id is not null")
    met = own.join(carry, [F.col("_day") == F.col("_on"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)], "left").withColumn("_hit", F.coalesce("_own", "_carry"))
    near = F.when(F.col("_hit.at") <= F.col("_t") + F.make_interval(mins=F.lit(tolerance)), F.col("_hit.v"))
    found = met.withColumn("_hit", near).groupBy("_id").agg(*[F.max(F.when(F.col("_m") == m, F.col("_hit"))).alias(f"after_{m}m") for m in minutes])
    return every.join(found, "_id", "left").drop("_id")


def next_sessions(spark, first: str, last: str, beyond: int = 31) -> DataFrame:
    """(day, next_day): of every date from ``first`` to ``last`` the next trading day after it, NULL if there is none within ``beyond`` days. A row per date."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), beyond))).alias("day"))
    later = Window.orderBy("day").rowsBetween(1, beyond)
    return days.withColumn("next_day", F.min(F.when(is_trading_day(F.col("day")), F.col("day"))).over(later)).filter(F.col("day") <= F.lit(last).cast("date"))


def ext_next_session(posts: DataFrame, hours: DataFrame, ts: str, hour: str, value: str, first: str, last: str, opens: int = 9, closes: tuple[int, int] = (15, 30)) -> DataFrame:
    """Adds ``session_hour`` and ``session_value``: for a post out of session, the first hour of the next session and its value (NULL without one); for a post in session both are NULL.

    Before the opening of a trading day that day's session comes next, else the next trading day's. The table of days is a row per date from ``first`` to ``last`` and is broadcast.
    """
    day, minute = F.to_date(ts), F.hour(ts) * 60 + F.minute(ts)
    days = F.broadcast(next_sessions(posts.sparkSession, first, last).withColumnsRenamed({"day": "_day", "next_day": "_next"}))
    trading = is_trading_day(day)
    inside = trading & (minute >= opens * 60) & (minute < closes[0] * 60 + closes[1])
    p = posts.withColumn("_d", day).join(days, F.col("_d") == F.col("_day"), "left")
    session = F.when(inside, F.lit(None)).when(trading & (minute < opens * 60), F.col("_d")).otherwise(F.col("_next"))
    p = p.withColumn("session_hour", session.cast("timestamp_ntz") + F.make_interval(hours=F.lit(opens)))
    values = hours.groupBy(F.col(hour).alias("_hour")).agg(F.min(value).alias("session_value"))
    return p.join(values, F.col("session_hour") == F.col("_hour"), "left").drop("_d", "_day", "_next", "_hour")
