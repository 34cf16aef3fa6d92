"""The documents of a corpus, filtered, deduplicated, decontaminated, masked and mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to the
shared folder and reads it again as the next one's documents; tables that a stage made on the way, and the one it read, go when its result is written.
All stages but the last return the columns of ``documents``.

Defined cases: null texts count as empty; very long texts are judged, compared, masked and counted whole; of texts equal in all that near duplicates compare the one with the
least id stays, and of rows repeated with one id one; a stage keeps further columns, whatever their names; an empty table runs through to an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseloom.llm.common import table
from pulseloom.llm.decontaminate import decontaminate
from pulseloom.llm.mixing import mix
from pulseloom.llm.quality import fit_quality, quality_filter
from pulseloom.llm.secrets import redact
from pulseloom.llm.similar import drop_similar
from pulseloom.shared import discard, keep_only


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_filter(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays."""
    return drop_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are masked in the texts."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", secrets),
    ("source_mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        docs = keep_only(lambda stage=stage, before=before: stage(spark, before, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express fitted models and fingerprints: the tests compare with brute force.
ORACLE_SQL = None
