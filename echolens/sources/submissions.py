"""The submission source: JSON bodies under a strict envelope, as rows with a status and what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("request_id", "text")
OPTIONAL = ("trace_id", "callback_url", "scope_id")


def parse(rows: DataFrame) -> DataFrame:
    """Adds request_id, text, trace_id, status (202 or 422) and problem to rows with a ``body``."""
    keys = F.json_object_keys("body")
    known = F.array(*[F.lit(k) for k in REQUIRED + OPTIONAL])
    value = lambda k: F.get_json_object("body", f"$.{k}")
    # a JSON string is the value in quotes; numbers, objects and the like aren't
    text = lambda k: F.contains(F.regexp_replace("body", "\\s*:\\s*", ":"), F.lit(f'"{k}":"'))
    given = [F.array_contains(keys, k) for k in REQUIRED]
    problem = (
        F.when(keys.isNull(), "NOT_AN_OBJECT")
        .when(F.size(F.array_except(keys, known)) > 0, "UNKNOWN_FIELD")
        .when(~(given[0] & given[1]), "MISSING_FIELD")
        .when(~(text("request_id") & text("text")), "WRONG_TYPE")
        .when(F.coalesce(value("text"), F.lit("")) == "", "EMPTY_TEXT")
    )
    return rows.select("*", value("request_id").alias("request_id"), value("text").alias("text"), value("trace_id").alias("trace_id"), problem.alias("problem")).withColumn("status", F.when(F.col("problem").isNull(), 202).otherwise(422))
