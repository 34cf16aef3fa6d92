"""Scalar parsing: numbers, aliases, identifiers, URLs. All functions map Columns to Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"^[+-]?(\d+(_?\d+)*\.?(\d+(_?\d+)*)?|\.\d+(_?\d+)*)([eE][+-]?\d+)?$"


def lenient_double(value: Column) -> Column:
    """A finite float as text, with blanks around it, else NULL (non-finite values are NULL too)."""
    text = F.trim(value.cast("string"))
    number = F.regexp_replace(text, "_", "").try_cast("double")
    return F.when(text.rlike(_FLOAT) & (F.abs(number) < float("inf")), number)


def _one_sign(text: Column) -> Column:
    plus, minus = F.regexp_count(text, F.lit(r"\+")), F.regexp_count(text, F.lit("-"))
    return plus + minus <= 1


def price_magnitude(value: Column) -> Column:
    """Positive magnitude of a price whose sign marks a direction; NULL if blank, doubly signed, zero or no number."""
    text = F.trim(value.cast("string"))
    magnitude = F.abs(lenient_double(text))
    return F.when(_one_sign(text) & (magnitude > 0), magnitude)


def nonnegative_number(value: Column) -> Column:
    """A quantity of zero or more; a negative one is invalid, not made positive."""
    text = F.trim(value.cast("string"))
    number = lenient_double(text)
    return F.when(_one_sign(text) & (number >= 0), F.abs(number))


def signed_int(value: Column) -> Column:
    """An integer that may carry separators, blanks and Hangul words; NULL if there is none."""
    bare = F.regexp_replace(value.cast("string"), r"(?U)[,\s]|[가-힣]+", "")
    return F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("bigint"))


def nonnegative_int(value: Column) -> Column:
    number = signed_int(value)
    return F.when(number >= 0, number)


def digits_int(value: Column) -> Column:
    """The digits of a text as an integer; 0 if there are none."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"[^\d]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def first_field(row: Column, *names: str) -> Column:
    """Value of the first alias that exists in a map, exactly or else in any case, even if its value is NULL.

    ``coalesce`` would fall through to a later alias when the first one holds NULL.
    """
    out = None
    for name in names:
        low = F.lit(name.lower())
        other = F.filter(F.map_keys(row), lambda k: F.lower(k) == low)  # noqa: B023  evaluated at once
        arms = [(F.map_contains_key(row, F.lit(name)), F.element_at(row, F.lit(name))), (F.size(other) > 0, F.element_at(row, F.element_at(F.when(F.size(other) > 0, other).otherwise(F.array(F.lit(name))), 1)))]
        for test, value in arms:
            out = F.when(test, value) if out is None else out.when(test, value)
    return out


def is_candle(row: Column) -> Column:
    """A row with any of the four lower-case price keys is a bar, not a print."""
    return F.arrays_overlap(F.map_keys(row), F.array(*[F.lit(x) for x in ("open", "high", "low", "close")]))


# The site that relative links belong to, and the query keys that identify a page, are parameters.
BOARD_KEYS = ("document_srl", "mid", "category")


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def canonical_url(url: Column, site: str) -> Column:
    """Absolute URL with the first non-empty value of each identifying key, in their order, and no fragment."""
    full = (
        F.when(url.rlike("^https?://"), url)
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(F.lit(site), url))
        .otherwise(F.concat(F.lit(site + "/"), url))
    )
    pairs = F.filter(F.split(_query(full), "&"), lambda p: F.split(p, "=")[0].isin(*BOARD_KEYS) & p.rlike("^[^=]+=.+"))
    first = F.aggregate(
        pairs,
        F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(F.exists(acc, lambda q: F.split(q, "=")[0] == F.split(p, "=")[0]), acc).otherwise(F.array_append(acc, p)),
    )
    base, query = F.regexp_extract(full, "^([^?#]*)", 1), F.array_join(first, "&")
    return F.when(url.isNull() | (url == ""), "").when(query == "", base).otherwise(F.concat_ws("?", base, query))


def document_id(url: Column) -> Column:
    """The ``document_srl`` of six or more digits, else the first six or more digits of the path, else NULL."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    srl = F.regexp_extract(_query(url), r"(?:^|&)document_srl=([^&]+)", 1)
    return F.when(srl.rlike(r"^\d{6,}$"), srl).otherwise(F.nullif(F.regexp_extract(path, r"(\d{6,})", 1), F.lit("")))


def html_escape(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


# Response classes of the collector.
STATUS = {400: "client_error", 401: "forbidden", 403: "forbidden", 404: "deleted", 405: "client_error", 410: "deleted", 429: "rate_limited", 451: "client_error"}
CAPTCHA_MARKS = ("captcha", "security check", "자동입력방지")


def http_status(status: Column, html: Column, marks: tuple[str, ...] = CAPTCHA_MARKS) -> Column:
    """Class of a response; unknown codes fail closed."""
    head = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 2000))
    blocked = F.lit(False)
    for m in marks:
        blocked = blocked | F.contains(head, F.lit(m))
    out = F.when(status.isNull(), "network_error").when(status.between(200, 299), F.when(blocked, "captcha").otherwise("ok"))
    for code, label in STATUS.items():
        out = out.when(status == code, label)
    return out.when(status.between(500, 599), "server_error").otherwise("client_error")


# The legal scopes of minute bars.
SCOPES = ("1", "3", "5", "10", "15", "30", "45", "60")


def tick_scope(value: str | int) -> str:
    """One of the legal bar scopes as text; booleans, floats and padded texts are refused."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise ValueError(f"unsupported scope {value!r}")
    text = str(value)
    if text not in SCOPES:
        raise ValueError(f"unsupported scope {value!r}; legal are {SCOPES}")
    return text
