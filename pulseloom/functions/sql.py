"""The scalar functions as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .labels import class_sql, label_sql

_FUNCTIONS = {
    "sentiment_label(i DOUBLE)": ("STRING", label_sql("i")),
    "sentiment_class(i DOUBLE)": ("STRING", class_sql("i")),
    "round_half_up(x DOUBLE, digits INT)": ("DOUBLE", "floor(x * pow(10, digits) + 0.5) / pow(10, digits)"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``; they are expanded into the plan, nothing runs outside the JVM."""
    for head, (kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
