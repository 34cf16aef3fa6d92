"""Extensions beyond the parity operators; the formulas are this engine's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ext_attention(series: DataFrame, ts: str, volume: str) -> DataFrame:
    """Volume against the mean of the same hour and weekday."""
    slot = [F.hour(ts).alias("_h"), F.weekday(F.col(ts)).alias("_d")]
    s = series.select("*", *slot)
    base = s.groupBy("_h", "_d").agg(F.avg(volume).alias("_mean"))
    return s.join(F.broadcast(base), ["_h", "_d"]).withColumn("attention", F.bround(F.try_divide(volume, "_mean"), 4)).drop("_h", "_d", "_mean")


def ext_disagreement(index: DataFrame, digits: int = 4) -> DataFrame:
    """Entropy of the direction shares, 0 to 1."""
    shares = ["positive_ratio", "negative_ratio", "neutral_ratio"]
    term = sum((F.when(F.col(c) > 0, -F.col(c) * F.log(c)).otherwise(0.0) for c in shares), F.lit(0.0))
    return index.withColumn("disagreement", F.bround(term / F.log(F.lit(3.0)), digits))


def ext_engagement(views: Column, likes: Column, comments: Column, cap: float = 10.0) -> Column:
    """Capped logarithmic engagement."""
    pos = lambda c: F.log1p(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("double"))
    return F.least(F.lit(cap), pos(views) + 2 * pos(likes) + 2 * pos(comments))


def ext_decay(age_hours: Column, half_life: float = 24.0) -> Column:
    return F.pow(F.lit(0.5), age_hours / half_life)


def ext_macro_f1(predictions: DataFrame, truth: str, guess: str) -> DataFrame:
    """(accuracy, macro_f1) over all classes, from one confusion aggregation."""
    c = predictions.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    side = c.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("pos"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("said")), F.struct(F.col("g").alias("k"), F.lit(0).cast("long").alias("pos"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("said")))).alias("x")).select("x.*")
    per = side.groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("hit").alias("hit"), F.sum("said").alias("said"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("pos") + F.col("said")), F.lit(0.0))
    return per.agg(F.bround(F.try_divide(F.sum("hit"), F.sum("pos")), 6).alias("accuracy"), F.bround(F.avg(f1), 6).alias("macro_f1"))


def ext_forward_change(series: DataFrame, ts: str, value: str, minutes: tuple[int, ...] = (60,)) -> DataFrame:
    """Change to the value exactly that many minutes later, NULL if there is none: an equality join, no look-ahead."""
    out = series
    for m in minutes:
        later = series.select((F.col(ts) - F.make_interval(mins=F.lit(m))).alias(ts), F.col(value).alias("_later"))
        out = out.join(later, ts, "left").withColumn(f"change_{m}m", F.bround((F.col("_later") - F.col(value)) / F.nullif(F.col(value), F.lit(0.0)) * 100, 4)).drop("_later")
    return out


def ext_mask_personal(text: Column) -> Column:
    """E-mail addresses, phone and account numbers masked."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    out = F.regexp_replace(out, r"\b\d{2,3}-\d{3,4}-\d{4}\b", "<phone>")
    return F.regexp_replace(out, r"\b\d{2,6}-\d{2,6}-\d{4,8}\b", "<account>")


def ext_as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str, out: str) -> DataFrame:
    """The latest ``value`` of ``right`` at or before each row of ``left``: a union and one window per key and day.

    So that no task holds a key's whole series, a day starts from the last value of the days before, which comes from a table of a row per key and day.
    """
    day = F.to_date(F.col(ts))
    r = right.select(*by, F.col(ts), F.struct(F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_r"), day.alias("_day"))
    both = left.withColumns({"_v": F.lit(None).cast(r.schema["_v"].dataType), "_r": F.lit(1), "_day": day}).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_day").orderBy(ts, "_r").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*by, "_day").agg(F.max_by("_v", F.when(F.col("_r") == 0, F.col(ts))).alias("_end"))
    ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    own = both.withColumn("_own", F.last("_v", ignorenulls=True).over(w)).filter("_r = 1")
    named = ends.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_day").alias("_on"), "_carry")
    met = own.join(named, [F.col("_day") == F.col("_on"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)], "left")
    return met.withColumn(out, F.coalesce("_own", "_carry").getField("v")).drop("_v", "_r", "_day", "_own", "_on", "_carry", *(f"_by_{c}" for c in by))


def ext_retain(rows: DataFrame, seen: str, kind: str, as_of: Column, days: dict[str, int]) -> DataFrame:
    """Rows whose kind's days of retention have not passed; kinds without a limit stay."""
    limit = F.create_map(*[F.lit(x) for k, v in days.items() for x in (k, v)])
    return rows.filter(F.coalesce(F.col(seen) >= as_of - F.make_interval(days=F.try_element_at(limit, F.col(kind))), F.lit(True)))


def ext_pseudonym(source: Column, author: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of source and author in hexadecimal, composed of built-in digests; the padded keys are made on the driver."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    message = F.concat(source, author).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def ext_status(sample: Column, least: int) -> Column:
    """Whether a sample is large enough to show."""
    return F.when(F.coalesce(sample, F.lit(0)) < least, "INSUFFICIENT_DATA").otherwise("OK")


def ext_tickers(mentions: DataFrame, alias: str, dictionary: DataFrame) -> DataFrame:
    """Ticker of each mention by a dictionary (alias, ticker); left to the optimizer, which broadcasts a small one."""
    return mentions.join(dictionary.select(F.col("alias").alias(alias), "ticker").dropDuplicates([alias]), alias, "left")


def ext_quality_ratios(posts: DataFrame, content: str, confidence: str, author: str, low: float = 0.5) -> DataFrame:
    """Shares of duplicates and of low confidence, and the largest share of one contributor; counted per key before anything meets."""
    total = posts.agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col(confidence) < low).alias("weak"))
    distinct = posts.groupBy(content).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("kinds"))
    most = posts.groupBy(author).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    one = total.crossJoin(F.broadcast(distinct)).crossJoin(F.broadcast(most))
    n = F.col("posts")
    return one.select("posts", F.bround(1 - F.try_divide("kinds", n), 6).alias("duplicate_share"), F.bround(F.try_divide("weak", n), 6).alias("low_confidence_share"), F.bround(F.try_divide("most", n), 6).alias("max_contribution"))


def ext_source_health(pages: DataFrame, parsed: DataFrame, key: str, source: str, seen: str, as_of: Column, stale_hours: float = 24.0) -> DataFrame:
    """(source, pages, parse_success, freshness_hours, is_stale): how many pages of a source gave a record, and how long ago its newest page was seen.

    ``parsed`` holds the keys of the pages that gave one, as often as they like; a source whose pages have no time has no freshness and counts as stale.
    """
    good = parsed.select(F.col(key).alias("_good")).filter("_good is not null").distinct()
    met = pages.join(good, F.col(key) == F.col("_good"), "left")
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.max(seen).cast("timestamp"))) / 3_600_000_000
    g = met.groupBy(source).agg(F.count(F.lit(1)).alias("pages"), F.bround(F.count("_good") / F.count(F.lit(1)), 6).alias("parse_success"), F.bround(age, 4).alias("freshness_hours"))
    return g.withColumn("is_stale", F.coalesce(F.col("freshness_hours") > stale_hours, F.lit(True)))


def ext_velocity(series: DataFrame, ts: str, value: str, minutes: tuple[int, ...] = (15, 60, 1440)) -> DataFrame:
    """Change against the value exactly that many minutes before, NULL if there is none: equality joins."""
    out = series
    for m in minutes:
        before = series.select((F.col(ts) + F.make_interval(mins=F.lit(m))).alias(ts), F.col(value).alias("_before"))
        out = out.join(before, ts, "left").withColumn(f"velocity_{m}m", F.bround(F.col(value) - F.col("_before"), 2)).drop("_before")
    return out


def ext_market_divergence(index: Column, change_rate: Column, full_move: float = 5.0) -> Column:
    """Sentiment from -1 to 1 less the market's move from -1 to 1; ``full_move`` per cent count as 1. An observation, no signal."""
    return F.bround((index - 50) / 50 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), change_rate / full_move)), 4)


def ext_author_weight(posts: DataFrame, author: str, most: int) -> DataFrame:
    """Weight of each post so that no author counts for more than ``most`` posts; a post without an author counts fully."""
    n = posts.filter(F.col(author).isNotNull()).groupBy(author).agg(F.count(F.lit(1)).alias("_n"))
    return posts.join(n, author, "left").withColumn("weight", F.when(F.col("_n") > most, F.lit(float(most)) / F.col("_n")).otherwise(1.0)).drop("_n")


def ext_review_queue(scored: DataFrame, confidence: str, low: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(to review, accepted): rows of low or missing confidence are for people to look at."""
    sure = F.coalesce(F.col(confidence) >= low, F.lit(False))
    return scored.filter(~sure), scored.filter(sure)


# Kinds of events and the fields that all of them carry.
EVENT_TYPES = (
    "source.post.discovered", "source.post.fetched", "source.post.changed", "source.post.deleted", "content.normalized", "content.analysis.completed", "content.analysis.rejected", "index.window.calculated", "index.window.invalidated",
    "retention.raw.expired",
)
EVENT_FIELDS = ("event_id", "occurred_at", "producer", "producer_version", "correlation_id", "source_id", "payload_schema_version")


def _first_broken(rules: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])


def ext_event_log(events: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: NULL, or the first field that breaks the log's contract."""
    return events.withColumn("reject_reason", _first_broken([("event_type", F.col("event_type").isin(*EVENT_TYPES)), *((f, F.col(f).isNotNull()) for f in EVENT_FIELDS)]))


# Fields of a label and what they may hold.
LABEL_VALUES = {
    "relevance": ("relevant", "irrelevant", "uncertain"),
    "stance": ("strong_bearish", "bearish", "neutral", "bullish", "strong_bullish", "unclear"),
    "emotion": ("fear", "greed", "anxiety", "anger", "euphoria", "resignation", "relief", "none", "unclear"),
    "action_intent": ("buy", "add", "hold", "wait", "sell", "cut_loss", "short", "avoid", "none", "unclear"),
    "time_horizon": ("intraday", "next_session", "short_term", "mid_term", "long_term", "unspecified"),
    "expression_type": ("fact", "opinion", "question", "joke", "sarcasm", "quote", "mixed"),
    "sarcasm": ("yes", "no", "uncertain"),
    "confidence": ("high", "medium", "low"),
}


def ext_label_contract(labels: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: NULL, or the first field whose value the labelling guide does not know; targets and notes must be there."""
    rules = [(k, F.col(k).isin(*v)) for k, v in LABEL_VALUES.items()]
    return labels.withColumn("reject_reason", _first_broken([*rules, ("targets", F.col("targets").isNotNull()), ("notes", F.col("notes").isNotNull())]))
