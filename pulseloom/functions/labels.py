"""Labels and sentences of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts.
NO_DATA = "데이터 없음"
LABELS = ("매우 긍정", "긍정", "중립", "부정", "강한 부정")
CHANGE = "지난 1시간 "
DASH = "–"


# Bounds of the labels and classes; a band holds its own bound or begins above it.
LABEL_BANDS = ((">=", 75, LABELS[0]), (">=", 60, LABELS[1]), (">", 40, LABELS[2]), (">", 25, LABELS[3]))
CLASS_BANDS = ((">=", 60, "up"), (">", 40, "flat"))


def banded_sql(name: str, bands: tuple[tuple[str, int, str], ...], rest: str, missing: str) -> str:
    """The band of a number as an SQL expression."""
    arms = "".join(f" WHEN {name} {sign} {bound} THEN '{label}'" for sign, bound, label in bands)
    return f"CASE WHEN {name} IS NULL THEN '{missing}'{arms} ELSE '{rest}' END"


def label_sql(name: str) -> str:
    return banded_sql(name, LABEL_BANDS, LABELS[4], NO_DATA)


def class_sql(name: str) -> str:
    return banded_sql(name, CLASS_BANDS, "down", "flat")


def _banded(index: Column, bands: tuple[tuple[str, int, str], ...], rest: str, missing: str) -> Column:
    out = F.when(index.isNull(), missing)
    for sign, bound, label in bands:
        out = out.when(index >= bound if sign == ">=" else index > bound, label)
    return out.otherwise(rest)


def sentiment_label(index: Column) -> Column:
    return _banded(index, LABEL_BANDS, LABELS[4], NO_DATA)


def sentiment_class(index: Column) -> Column:
    return _banded(index, CLASS_BANDS, "down", "flat")


def js_round(value: Column, digits: int = 0) -> Column:
    """Half up, as the dashboard rounds."""
    k = 10**digits
    return F.floor(value * k + 0.5) / k


def one_digit(value: Column) -> Column:
    """A number from 0 up with one digit, as C, Python and DuckDB print it: by the exact binary value, exact halves to even."""
    whole = F.floor(value).cast("double")
    rest = value - whole
    # tenths + error are exactly ten times the rest, so a half that came of rounding is told from a true one
    tenths = rest * 8 + rest * 2
    part = tenths - rest * 8
    error = (rest * 8 - (tenths - part)) + (rest * 2 - part)
    low = F.floor(tenths)
    up = (tenths - low > 0.5) | (tenths - low == 0.5) & ((error > 0) | (error == 0) & (low % 2 == 1))
    digit = low + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%d", (whole + F.floor(digit / 10)).cast("long"), (digit % 10).cast("long"))


def change_text(now: Column, before: Column) -> Column:
    delta = js_round(now - before, 1)
    shown = F.concat(F.when(delta > 0, "+").otherwise(""), F.when(delta.isNotNull(), F.format_string("%.1f", delta)))
    return F.concat(F.lit(CHANGE), F.coalesce(shown, F.lit(DASH)))


def is_sample(data_mode: Column) -> Column:
    return F.coalesce(data_mode == "sample", F.lit(False))


def interpretation(index: Column, posts: Column, analyzed: Column, confidence: Column, sample: Column, name: str = "심리지수") -> Column:
    """The day's sentence: from the index, or else what is missing."""
    head = F.format_string(f"현재 {name}는 %s로 %s 구간입니다.", one_digit(index.cast("double")), sentiment_label(index))
    size = F.format_string("오늘 분석 표본은 %d건, 평균 신뢰도는 %d%%입니다.", analyzed.cast("long"), js_round(F.coalesce(confidence, F.lit(0.0)) * 100).cast("long"))
    note = F.lit("현재 화면은 샘플 데이터로 구조 검증용입니다. 실제 시장 데이터로 오인하지 마세요.")
    full = F.concat_ws(" ", head, F.when(analyzed > 0, size), F.when(sample, note))
    waiting = F.format_string("%d개의 게시글이 수집되었으나, 아직 심리 분석 결과가 없습니다. 분석이 완료되면 여기에 해석이 표시됩니다.", posts.cast("long"))
    return F.when(index.isNotNull(), full).when(posts > 0, waiting).otherwise("아직 심리 데이터가 없습니다. 파이프라인이 데이터를 생성하면 여기에 해석이 표시됩니다.")
