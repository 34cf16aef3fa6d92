"""Market time: wall-clock time of UTC+9 as TIMESTAMP_NTZ inside, ISO text with the offset at the edges.

Nothing here depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = "+09:00"
_OFFSET_MINUTES = 540

_DASHED = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
_USUAL = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
_SUFFIX = r"[T ]\d{2}:[^Z+-]*(Z|[+-]\d{2}:?\d{2})$"
_SLASHED = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2}) (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
_PLAIN = r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2}))?$"


def _ntz(date: Column, hour: Column, minute: Column, second: Column, fraction: Column | None = None) -> Column:
    zero = lambda c: F.lpad(F.when(c == "", "0").otherwise(c), 2, "0")
    text = F.concat(date, F.lit(" "), F.concat_ws(":", zero(hour), zero(minute), zero(second)))
    if fraction is not None:
        text = F.concat(text, F.lit("."), F.rpad(fraction, 6, "0"))
    return text.try_cast("timestamp_ntz")


def kst(value: Column) -> Column:
    """A timestamp text as wall-clock time of UTC+9; no offset means UTC+9; NULL if it is none.

    ISO 8601 in its dashed and plain forms, and dashed or slashed dates with a time.
    """
    text = F.trim(value.cast("string"))
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    zone = part(_DASHED, 6)
    digits = F.regexp_replace(zone, r"[^\d]", "")
    minutes = F.when(
        zone.rlike(r"^[+-]"),
        F.when(zone.startswith("-"), -1).otherwise(1)
        * (F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))),
    ).otherwise(0)
    local = _ntz(part(_DASHED, 1), part(_DASHED, 2), part(_DASHED, 3), part(_DASHED, 4), part(_DASHED, 5))
    moved = F.when(zone == "", local).otherwise(local + F.make_interval(mins=F.lit(_OFFSET_MINUTES) - minutes))
    slashed = _ntz(F.concat_ws("-", part(_SLASHED, 1), F.lpad(part(_SLASHED, 2), 2, "0"), F.lpad(part(_SLASHED, 3), 2, "0")), part(_SLASHED, 4), part(_SLASHED, 5), part(_SLASHED, 6))
    plain = _ntz(F.concat_ws("-", part(_PLAIN, 1), part(_PLAIN, 2), part(_PLAIN, 3)), part(_PLAIN, 4), part(_PLAIN, 5), part(_PLAIN, 6))
    # the usual shapes go through one cast; the other forms are taken apart
    suffix = F.regexp_extract(text, _SUFFIX, 1)
    naive = F.replace(F.substr(text, F.lit(1), F.length(text) - F.length(suffix)), F.lit(","), F.lit(".")).try_cast("timestamp_ntz")
    sign = F.when(F.substring(suffix, 1, 1) == "-", -1).otherwise(1)
    shift = F.when(suffix == "Z", 0).otherwise(sign * (F.substring(suffix, 2, 2).try_cast("int") * 60 + F.substring(suffix, -2, 2).try_cast("int")))
    usual = F.when(suffix == "", naive).otherwise(naive + F.make_interval(mins=F.lit(_OFFSET_MINUTES) - shift))
    return F.when(text.rlike(_USUAL), usual).when(text.rlike(_DASHED), moved).when(text.rlike(_SLASHED), slashed).when(text.rlike(_PLAIN), plain)


def iso(ts: Column) -> Column:
    """ISO text with the offset; microseconds only where there are any."""
    text = ts.cast("timestamp_ntz").cast("string")
    fraction = F.substr(text, F.lit(20))
    whole = F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T"))
    return F.concat(whole, F.when(fraction == "", "").otherwise(F.rpad(fraction, 7, "0")), F.lit(OFFSET))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts).cast("timestamp_ntz")


# The regular session and its closing auction, in minutes of the day.
SESSION = (9 * 60, 15 * 60 + 30)
AUCTION = (15 * 60 + 20, 15 * 60 + 30)
LAST_HOUR = 15


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(ts: Column) -> Column:
    m = minute_of_day(ts)
    return (m >= SESSION[0]) & (m < SESSION[1])


def in_closing_auction(ts: Column) -> Column:
    m = minute_of_day(ts)
    return (m >= AUCTION[0]) & (m < AUCTION[1])


def session_bucket(ts: Column) -> Column:
    """Hour of the session, NULL outside of it."""
    return F.when(in_session(ts), hour_of(ts))


def is_partial(ts: Column) -> Column:
    """Whether the bucket is the last one, of half an hour."""
    return F.coalesce(in_session(ts) & (F.hour(ts) == LAST_HOUR), F.lit(False))


def absolute_datetime(value: Column) -> Column:
    """The text itself if it is a complete ISO datetime with an offset, else NULL."""
    text = F.trim(value.cast("string"))
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?([+-]\d{2}:?\d{2}|Z)$")
    return F.when(shape & kst(text).isNotNull(), text)


def _padded(value: Column) -> Column:
    return value != F.regexp_replace(value, r"^(?U)\s+|(?U)\s+$", "")


def _plain_time(text: Column) -> Column:
    """The time of 14 digits, NULL if they are none; short, so that it may stand in a plan several times."""
    cut = lambda i, n: F.substring(text, i, n)
    dashed = F.concat(cut(1, 4), F.lit("-"), cut(5, 2), F.lit("-"), cut(7, 2), F.lit(" "), cut(9, 2), F.lit(":"), cut(11, 2), F.lit(":"), cut(13, 2))
    return F.when(text.rlike(r"^\d{14}$"), dashed.try_cast("timestamp_ntz"))


def bar_time_status(value: Column, day: Column) -> Column:
    """``target``, ``other_date`` or ``invalid`` for a broker's bar time against the day asked for (yyyyMMdd)."""
    text = value.cast("string")
    return (
        F.when(text.isNull() | ~text.rlike(r"^\d+$"), "invalid")
        .when(F.length(text) == 14, F.when(_plain_time(text).isNull(), "invalid").when(F.substring(text, 1, 8) != day, "other_date").otherwise("target"))
        .when(F.length(text).isin(4, 6), "target")
        .otherwise("invalid")
    )


def bar_time(value: Column, day: Column) -> Column:
    """The time of a broker's bar: 14 digits on the day asked for, or 6 or 4 digits of that day; never made up."""
    text = value.cast("string")
    n = F.length(text)
    whole = F.when((n == 14) & (F.substring(text, 1, 8) == day), text).when(n == 6, F.concat(day, text)).when(n == 4, F.concat(day, text, F.lit("00")))
    return _plain_time(whole)


# Days on which the exchange is closed, for the years that are known.
CLOSED = (
    "2026-01-01", "2026-02-16", "2026-02-17", "2026-02-18", "2026-03-02", "2026-05-01", "2026-05-05", "2026-05-25", "2026-06-03", "2026-06-06",
    "2026-07-17", "2026-08-15", "2026-08-17", "2026-09-24", "2026-09-25", "2026-09-26", "2026-10-05", "2026-10-09", "2026-12-25", "2026-12-31",
)
YEARS = (2026,)


def is_trading_day(day: Column) -> Column:
    d = day.cast("date")
    return (F.weekday(d) < 5) & ~d.isin(*[F.lit(x).cast("date") for x in CLOSED])


def check_years(first: str, last: str, years: tuple[int, ...] = YEARS) -> None:
    """Refuse ranges that begin or end outside the years whose closing days are known."""
    for d in (first, last):
        if not str(d)[:4].isdigit() or int(str(d)[:4]) not in years:
            raise ValueError(f"no calendar for {d!r}; known years are {years}")
