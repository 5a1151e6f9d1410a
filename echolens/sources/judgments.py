"""Judgments as text: the JSON object inside a loose answer, its structure, and repeated keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("duplicate", "not_duplicate", "uncertain")
SCHEMA = "verdict string, evidence_a array<string>, evidence_b array<string>, reason string"


def loose_object(answer: Column) -> Column:
    """The text from the first opening to the last closing brace, which leaves out fences and talk around the object."""
    found = F.regexp_extract(answer, "(?s)\\{.*\\}", 0)
    return F.when(found != "", found)


def repeats_a_key(body: Column) -> Column:
    """Whether some object of the JSON text names a key twice; the built-in parser keeps the last and doesn't tell."""

    def of(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool:
            twice = []

            def note(pairs: list[tuple[str, object]]) -> dict:
                twice.append(len({k for k, _ in pairs}) < len(pairs))
                return dict(pairs)

            try:
                json.loads(text or "null", object_pairs_hook=note)
            except ValueError:
                return False
            return any(twice)

        return texts.map(one)

    return F.pandas_udf(of, "boolean")(body)


def parse(answers: DataFrame) -> DataFrame:
    """Adds verdict, evidence_a, evidence_b and problem (null for a sound judgment) to rows with an ``answer``."""
    rows = answers.withColumn("body", loose_object(F.col("answer"))).withColumn("j", F.from_json("body", SCHEMA))
    whole = F.json_object_keys("body").isNotNull()
    problem = (
        F.when(F.col("body").isNull() | ~F.coalesce(whole, F.lit(False)), "NO_OBJECT")
        .when(repeats_a_key(F.col("body")), "REPEATED_KEY")
        .when(F.col("j.verdict").isNull() | ~F.col("j.verdict").isin(*VERDICTS), "VERDICT")
        .when((F.col("j.verdict") == "duplicate") & ((F.coalesce(F.size("j.evidence_a"), F.lit(0)) < 1) | (F.coalesce(F.size("j.evidence_b"), F.lit(0)) < 1)), "EVIDENCE")
    )
    return rows.select(*answers.columns, F.col("j.verdict").alias("verdict"), F.col("j.evidence_a").alias("evidence_a"), F.col("j.evidence_b").alias("evidence_b"), problem.alias("problem"))


def write_artifacts(rows: DataFrame, path: str) -> None:
    """Plans and decisions as nested Parquet, a folder for each business date and scope, so readers prune what they don't ask for."""
    rows.write.mode("append").partitionBy("business_date", "scope_id").parquet(path)
