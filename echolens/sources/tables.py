"""Sources: the driver's tables as the engine's inputs, literal rows, and validated readers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCOPE, DATE, EXPIRES = "default", "2026-09-26", "2026-10-02 16:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as items of one scope and business day, in order of doc_id."""
    docs = table(spark, sf_dir, "documents")
    item = F.col("doc_id").cast("string")
    return docs.select(
        T.record_id(F.lit(SCOPE), item).alias("record_id"),
        item.alias("item_id"),
        "text",
        (F.col("doc_id") + 1).alias("arrival_seq"),
        F.lit(SCOPE).alias("scope_id"),
        F.lit(DATE).cast("date").alias("business_date"),
        F.lit(EXPIRES).cast("timestamp").alias("expires_at"),
        "source",
        "lang",
    )


#: Column types as Spark and DuckDB name them.
TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE", "array<string>": "VARCHAR[]"}


def quoted(value: object, duck: bool = False) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return f"{'list_value' if duck else 'array'}({', '.join(quoted(v, duck) for v in value)})"
    text = str(value).replace("'", "''")
    return f"'{text}'" if duck else "'" + text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r") + "'"


def values(columns: dict[str, str], rows: list[tuple], duck: bool = False) -> str:
    """Literal rows as a SELECT with typed columns, for Spark or for DuckDB."""
    body = ", ".join("(" + ", ".join(quoted(v, duck) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {TYPES[k] if duck else k}) AS {n}" for n, k in columns.items())
    return f"SELECT {casts} FROM (VALUES {body}) AS t({', '.join(columns)})"


def literal(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    return spark.sql(values(columns, rows))


def dictionary(rows: DataFrame) -> DataFrame:
    """Validates dictionary rows (section, surface, canonical, relation): adds ``problem``, null for a sound entry.

    Problems, in order: an empty side, text that isn't NFC (an Arrow pass: Spark has no function for it), a surface with two
    canonical forms, a surface listed twice, and a canonical form that is itself a surface of another entry.
    """
    composed = F.pandas_udf(lambda texts: texts.map(lambda t: t is None or unicodedata.is_normalized("NFC", t)).astype(bool), "boolean", F.PandasUDFType.SCALAR)
    per = rows.groupBy("section", "surface").agg(F.count_distinct("canonical").alias("forms"), F.count("*").alias("times"))
    chained = rows.alias("a").join(rows.select("section", F.col("surface").alias("s"), F.col("canonical").alias("c")).distinct().alias("b"), (F.col("a.section") == F.col("b.section")) & (F.col("a.canonical") == F.col("b.s")) & (F.col("b.s") != F.col("b.c")), "left_semi")
    chained = chained.select("section", "surface", "canonical").distinct().withColumn("chained", F.lit(True))
    joined = rows.join(per, ["section", "surface"]).join(chained, ["section", "surface", "canonical"], "left")
    problem = F.when((F.trim("surface") == "") | (F.trim("canonical") == ""), "EMPTY").when(~composed("surface") | ~composed("canonical"), "NOT_NFC").when(F.col("forms") > 1, "AMBIGUOUS").when(F.col("times") > 1, "DUPLICATE").when(F.col("chained"), "CHAINED")
    return joined.withColumn("problem", problem).select("section", "surface", "canonical", "problem")
