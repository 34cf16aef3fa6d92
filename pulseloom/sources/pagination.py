"""Saved pages of paginated requests: their order, and why a chain is not complete.

A response names the key of the page that follows. Pages are saved in any order; from each request's first page (its key is empty) the chain is followed by doubling: the table of
pointers is joined with itself, so that after n rounds it leads 2**n pages ahead, and the pages known so far are joined with it once a round.
Chains of up to ``max_pages`` take its logarithm of rounds, each an equality join on (request, key), and no task holds a request. A chain ends at the first page where one of these holds:

* ``complete``: the page says that nothing follows;
* ``empty_next_key``: more should follow, but no key is given;
* ``repeated_key``: the key was given before;
* ``missing_page``: the page of that key, or the first page, was not saved;
* ``over_limit``: ``max_pages`` pages and still more to follow.

Responses are read with Spark's own readers, so they may lie wherever Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize

MAX_PAGES = 50
RESPONSE = "request string, key string, headers map<string,string>, body string"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(request, key, cont, next_key, seq, body) of saved responses, a JSON document a file: request, key, headers and body (a document, kept as text). Files in order of their names."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.from_json("value", RESPONSE).alias("r"), F.col("_metadata.file_path").alias("seq"))
    return from_headers(files.select("r.*", "seq"))


def from_headers(responses: DataFrame) -> DataFrame:
    """The same of rows (request, key, headers, body, seq); names of headers in any case, no key is the first page's."""
    low = F.map_from_entries(F.array_distinct(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))))
    return responses.select("request", F.coalesce("key", F.lit("")).alias("key"), F.element_at(low, F.lit("cont-yn")).alias("cont"), F.element_at(low, F.lit("next-key")).alias("next_key"), "seq", "body")


def follow(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(request, pos, key, outcome) of every page that a walk from the first page fetches; ``outcome`` is NULL but on the last one.

    A request without its first page has one row with a NULL pos. Of pages saved twice the first by ``seq`` counts.
    """
    one = pages.groupBy("request", "key").agg(F.min_by(F.struct("cont", "next_key"), "seq").alias("p")).select("request", "key", F.upper("p.cont").eqNullSafe("Y").alias("more"), F.trim(F.coalesce("p.next_key", F.lit(""))).alias("next"))
    one = materialize(one)
    saved = one.select("request", F.col("key").alias("next"))
    jump = materialize(one.filter("more and next <> ''").select("request", "key", "next").join(saved, ["request", "next"]).select("request", "key", "next"))
    met = one.filter("key = ''").select("request", "key", F.lit(0).alias("pos"))
    step = 1
    while step <= max_pages:
        ahead = met.join(jump, ["request", "key"]).select("request", F.col("next").alias("key"), (F.col("pos") + step).alias("pos")).filter(F.col("pos") <= max_pages)
        met = materialize(met.unionByName(ahead))
        jump = materialize(jump.join(jump.select("request", F.col("key").alias("next"), F.col("next").alias("far")), ["request", "next"]).select("request", "key", F.col("far").alias("next")))
        step *= 2
    # where a page comes round for the second time, the page before gave its key again
    again = met.groupBy("request", "key").agg(F.sort_array(F.collect_list("pos")).alias("at")).filter("size(at) > 1").groupBy("request").agg((F.min(F.element_at("at", 2)) - 1).alias("_again"))
    walk = met.filter(F.col("pos") < max_pages).join(one, ["request", "key"]).join(again, "request", "left")
    there = saved.withColumn("_saved", F.lit(True))
    walk = walk.join(there, ["request", "next"], "left")
    last = F.col("pos") == max_pages - 1
    outcome = (
        F.when(~F.col("more"), "complete").when(F.col("next") == "", "empty_next_key").when(F.col("pos") == F.col("_again"), "repeated_key")
        .when(last, "over_limit").when(F.col("_saved").isNull(), "missing_page")
    )
    walk = walk.withColumn("outcome", outcome)
    ends = walk.filter("outcome is not null").groupBy("request").agg(F.min("pos").alias("_end"))
    walked = walk.join(ends, "request").filter("pos <= _end").select("request", "pos", "key", F.when(F.col("pos") == F.col("_end"), F.col("outcome")).alias("outcome"))
    headless = one.select("request").distinct().join(one.filter("key = ''").select("request"), "request", "left_anti")
    none = F.lit(None)
    return walked.unionByName(headless.select("request", none.cast("int").alias("pos"), none.cast("string").alias("key"), F.lit("missing_page").alias("outcome")))


def faults(walked: DataFrame) -> DataFrame:
    """(request, reason, pages): the chains of ``follow`` that are not complete, and how many pages were fetched."""
    by = walked.groupBy("request").agg(F.max("outcome").alias("reason"), F.count("pos").alias("pages"))
    return by.filter("reason <> 'complete'")


def ordered_pages(pages: DataFrame, walked: DataFrame) -> DataFrame:
    """(request, page, body): the pages of complete chains, numbered in their order."""
    whole = walked.filter("outcome = 'complete'").select("request")
    first = pages.groupBy("request", "key").agg(F.min_by("body", "seq").alias("body"))
    return walked.join(whole, "request", "left_semi").join(first, ["request", "key"]).select("request", F.col("pos").cast("long").alias("page"), "body")
