"""Text normalisation and content hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _nfc(text: Column) -> Column:
    # made on use: workers import this module without a session. Texts below U+0300 are composed
    # already: they stay in the JVM, and the worker gets NULL for them.
    return F.coalesce(F.pandas_udf(_compose, "string")(F.when(text.rlike("[^\\x00-\u02FF]"), text)), text)


def tidy(text: Column) -> Column:
    """Drop zero-width characters, collapse Unicode white space and trim; NULL becomes empty."""
    out = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\u200B\\u200C\\u200D\\uFEFF]", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """``tidy`` after composing characters; composition has no built-in function, so it is an Arrow batch UDF."""
    return tidy(_nfc(F.coalesce(text.cast("string"), F.lit(""))))


def content_hash(post_id: Column, title: Column, body: Column, comments: Column, compose: bool = True) -> Column:
    """SHA-256 over id, title, body and comment bodies, normalised and joined by the unit separator.

    The parts are joined first and composed in one call; the separator survives composition and is no white space here.
    """
    bodies = F.transform(F.coalesce(comments, F.expr("cast(array() as array<string>)")), lambda c: F.coalesce(c, F.lit("")))
    whole = F.array_join(F.concat(F.array(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), bodies), "\x1f")
    parts = F.transform(F.split(_nfc(whole) if compose else whole, "\x1f"), tidy)
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", F.coalesce(post_id.cast("string"), F.lit("")), F.array_join(parts, "\x1f")), 256))
