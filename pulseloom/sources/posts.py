"""Saved community posts: fail-closed JSON lines, conversations as posts, and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import iso, kst
from ..schemas import COMMENT
from .line_files import read_lines

_LINE = "source string, dataMode string, sourcePostId string, canonicalUrl string, title string, body string, publishedAt string, firstSeenAt string, viewCount bigint, recommendationCount bigint, commentCount bigint, deleted boolean, comments array<struct<body:string,publishedAt:string,recommendationCount:bigint>>"


def load_live_posts(spark: SparkSession, path: str, source: str, data_mode: str = "real") -> DataFrame:
    """Posts of a JSON-lines file. A missing file, a damaged line or one of another source or mode fails the load, with its number."""
    return live_posts(read_lines(spark, path).select("pos", "line"), source, data_mode)


def live_posts(lines: DataFrame, source: str, data_mode: str = "real") -> DataFrame:
    """The same of lines (pos, line); blank lines count for nothing."""
    d = lines.filter("trim(line) <> ''").withColumn("p", F.from_json("line", _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("m", F.from_json("line", "map<string,string>"))
    why = F.when(F.col("m").isNull(), "is not valid JSON").when(~F.col("p.source").eqNullSafe(source), f"source must be {source}").when(~F.col("p.dataMode").eqNullSafe(data_mode), f"dataMode must be {data_mode}")
    bad = d.withColumn("why", why).filter("why is not null").orderBy("pos").select("pos", "why").first()
    if bad:
        raise ValueError(f"line {bad['pos'] + 1}: {bad['why']}")
    text = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(""))
    number = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0).cast("bigint"))
    comments = F.expr(
        "transform(coalesce(p.comments, array()), c -> named_struct('id', cast(null as string), 'parent_id', cast(null as string), 'depth', 0, 'body', coalesce(c.body, ''), 'author', cast(null as string), 'published_at', coalesce(c.publishedAt, ''), 'recommendations', coalesce(c.recommendationCount, 0L), 'deleted', false))"
    )
    return d.select(
        text("sourcePostId").alias("post_id"), text("canonicalUrl").alias("url"), text("title").alias("title"), text("body").alias("body"), text("publishedAt").alias("published_at"), text("firstSeenAt").alias("first_seen_at"),
        number("viewCount").alias("views"), number("recommendationCount").alias("recommendations"), number("commentCount").alias("comment_count"), F.coalesce(F.col("p.deleted"), F.lit(False)).alias("deleted"), comments.alias("comments"),
        F.col("pos").cast("long").alias("pos"),
    )


def effective_time(first_seen, published, now):
    """First seen, or else published, or else ``now``; an empty text counts as missing."""
    return F.coalesce(F.nullif(first_seen, F.lit("")), F.nullif(published, F.lit("")), now)


def threads(turns: DataFrame) -> DataFrame:
    """(conv_id, body, comments): the first turn of a conversation as the post, the others as its comments in order.

    Turns are folded per conversation, whose length is the conversation's own.
    """
    rest = F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))))
    return turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("body"), F.transform(rest, lambda c: c["text"]).alias("comments"))


# Titles and bodies of the sample posts, oldest first.
SAMPLES = (
    ("코스피 오늘 급등 예상, 반도체 호재 쏟아진다", "삼성전자 SK하이닉스 상승 매수 신호"),
    ("시장 폭락 공포 심화, 손절 가속", "하락 장세 매도 관망 위험"),
    ("오늘 장세는 보합권, 관망이 답", "횡보 박스권 지지 저항"),
    ("반도체 폭등! 상한가 러시", "급등 상승 갭상승 신고가"),
    ("외인 대거 매도, 하락 압력 심하다", "급락 손실 위험 공포"),
)


def sample_posts(spark: SparkSession, end: str) -> DataFrame:
    """The sample posts, an hour apart, the last one at ``end``."""
    n = len(SAMPLES)
    d = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(SAMPLES)], "i int, title string, body string")
    at = iso(kst(F.lit(end)) - F.make_interval(hours=n - 1 - F.col("i")))
    return d.select(
        F.concat(F.lit("sample-"), F.col("i") + 1).alias("post_id"), F.concat(F.lit("https://example.com/post/"), F.col("i") + 1).alias("url"), "title", "body", at.alias("published_at"), at.alias("first_seen_at"),
        (100 + F.col("i") * 50).cast("bigint").alias("views"), (10 + F.col("i") * 5).cast("bigint").alias("recommendations"), (3 + F.col("i")).cast("bigint").alias("comment_count"), F.lit(False).alias("deleted"),
        F.from_json(F.lit("[]"), f"array<{COMMENT}>").alias("comments"),
    )
