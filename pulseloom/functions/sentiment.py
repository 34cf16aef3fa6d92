"""Deterministic lexicon sentiment as column expressions, and the surface for other providers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MODEL = "lexicon-v1"


# Word lists of the default lexicon (one entry stands twice and counts twice), and target rules in order.
POSITIVE = ("상승", "급등", "호재", "매수", "bull", "long", "상한가", "갭상승", "돌파", "반등", "회복", "긍정", "좋", "기대", "수익", "익절", "보유", "추가매수", "신고가", "러시", "폭등", "급반등")
NEGATIVE = ("하락", "급락", "악재", "매도", "bear", "short", "하한가", "갭하락", "손절", "손실", "부정", "나쁘", "위험", "폭락", "버림", "탈출", "붕괴", "급락", "공포", "패닉", "출렁", "약세", "조정")
NEUTRAL = ("관망", "횡보", "박스권", "지지", "저항", "보합", "보통", "neutral", "횡보세", "지루")
TARGETS = (("KOSPI", ("코스피", "kospi", "kospidaq")), ("KOSDAQ", ("코스닥", "kosdaq")), ("NASDAQ", ("나스닥", "nasdaq", "nas")), ("CRYPTO", ("비트코인", "bitcoin", "btc", "crypto")))
DEFAULT_TARGET = "KOSPI"


@dataclass(frozen=True)
class Lexicon:
    positive: Sequence[str] = POSITIVE
    negative: Sequence[str] = NEGATIVE
    neutral: Sequence[str] = NEUTRAL
    targets: Sequence[tuple[str, Sequence[str]]] = TARGETS
    default_target: str = DEFAULT_TARGET
    model: str = MODEL


def hits(low: Column, words: Sequence[str]) -> Column:
    """How many entries the lower-cased text contains, each counted once."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(low, F.lit(w.lower())).cast("int")
    return out


def full_text(title: Column, body: Column, comments: Column) -> Column:
    bodies = F.array_join(F.transform(F.coalesce(comments, F.expr("cast(array() as array<string>)")), lambda c: F.coalesce(c, F.lit(""))), " ")
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")), bodies)


def text_number(text: Column) -> Column:
    """The first 32 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def market_targets(low: Column, lexicon: Lexicon = Lexicon()) -> Column:
    arms = []
    for name, words in lexicon.targets:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        arms.append(F.when(hit, F.lit(name)))
    found = F.array_compact(F.array(*arms))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(lexicon.default_target)))


def direction(p: Column, n: Column, u: Column) -> Column:
    return (
        F.when(p + n + u == 0, "unrelated")
        .when((p > n) & (p > u), "positive")
        .when((n > p) & (n > u), "negative")
        .when((p > 0) & (n > 0), "mixed")
        .otherwise("neutral")
    )


def analyze(df, text: Column, lexicon: Lexicon = Lexicon(), prefix: str = ""):
    """Add direction, score, positive, negative, neutral, sarcasm, fear_greed, targets, confidence and model to ``df``.

    Step by step as columns, so that counts and hash are computed once.
    """
    c = lambda name: F.col(f"_{name}")
    low = df.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_low", F.lower("_text"))
    low = low.withColumns({"_p": hits(c("low"), lexicon.positive), "_n": hits(c("low"), lexicon.negative), "_u": hits(c("low"), lexicon.neutral), "_h": text_number(c("text"))})
    low = low.withColumns({"_total": c("p") + c("n") + c("u"), "_dir": direction(c("p"), c("n"), c("u"))})
    related = c("total") > 0
    total = F.when(related, c("total"))
    raw = F.when(c("dir") == "positive", c("p") / total).when(c("dir") == "negative", -(c("n") / total)).when(c("dir") == "mixed", (c("p") - c("n")) / total).otherwise(0.0)
    jitter = (c("h") % 100) / 1000.0 - 0.05
    score = F.when(related, F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw + jitter)), 4)).otherwise(0.0)
    low = low.withColumn("_score", score)
    share = lambda k: F.when(related, F.bround(c(k) / total, 4)).otherwise(0.33)
    out = {
        "direction": c("dir"),
        "score": c("score"),
        "positive": share("p"),
        "negative": share("n"),
        "neutral": share("u"),
        "sarcasm": (c("dir") == "positive") & (c("n") > 0) & (c("h") % 10 < 2),
        "fear_greed": F.greatest(F.lit(0), F.least(F.lit(100), F.bround((c("score") + 1.0) * 50, 0).cast("int"))),
        "targets": market_targets(c("low"), lexicon),
        "confidence": F.when(related, F.bround(F.least(F.lit(0.95), 0.5 + c("total") / 10.0), 4)).otherwise(0.3),
        "model": F.lit(lexicon.model),
    }
    return low.withColumns({prefix + k: v for k, v in out.items()}).drop("_text", "_low", "_p", "_n", "_u", "_h", "_total", "_dir", "_score")


Provider = Callable[..., object]
_PROVIDERS: dict[str, Provider] = {"lexicon": analyze}


def register_provider(name: str, provider: Provider) -> None:
    """A provider maps (df, text) to ``df`` with the sentiment columns; it may use an Arrow UDF."""
    _PROVIDERS[name] = provider


def create_provider(name: str = "lexicon") -> Provider:
    if name not in _PROVIDERS:
        raise NotImplementedError(f"no sentiment provider named {name!r}")
    return _PROVIDERS[name]
