"""Validity of results, log fields and fact artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decide import DUPLICATE
from ..functions.text import quote_holds

SAFE = ("trace_id", "request_id", "record_id", "status", "error_code", "arrival_seq", "elapsed_ms")


def results(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(record_id, problem): only duplicates name members; each has an audit row, and their arrivals rise strictly."""
    named = rows.select("record_id", F.posexplode("duplicate_ids").alias("place", "member_id")).join(audits, ["record_id", "member_id"], "left")
    seqs = named.groupBy("record_id").agg(F.max(F.col("seq").isNull().cast("int")).alias("unknown"), F.array_sort(F.collect_list(F.struct("place", "seq"))).alias("s"))
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda k: F.coalesce(F.get("s", k)["seq"] <= F.get("s", k - 1)["seq"], F.lit(False)))
    joined = rows.join(seqs, "record_id", "left")
    count = (F.col("decision") == DUPLICATE) != (F.size("duplicate_ids") > 0)
    return joined.select("record_id", F.when(count, "CARDINALITY").when(F.col("unknown") == 1, "MEMBER_WITHOUT_AUDIT").when(falls, "ORDER").alias("problem"))


def safe(fields: DataFrame) -> DataFrame:
    """Adds the value that may be logged: listed names with plain values; null for anything else."""
    return fields.withColumn("safe", F.when(F.col("name").isin(*SAFE) & F.col("value").rlike("^[A-Za-z0-9._:-]{1,128}$"), F.col("value")))


def facts(rows: DataFrame) -> DataFrame:
    """(record_id, issues): facts with subject and predicate evidence (ss, se, ps, pe) held against the text; ids are f1, f2, ..."""
    bad = lambda slot, s, e: F.col(slot).isNotNull() & ~F.coalesce(quote_holds(F.col("text"), F.col(s), F.col(e), F.col(slot)), F.lit(False))
    one = rows.groupBy("record_id").agg(
        F.max((bad("subject", "ss", "se") | bad("predicate", "ps", "pe")).cast("int")).alias("evidence"),
        F.max(F.col("subject").isNull().cast("int")).alias("subject"),
        F.max(F.col("predicate").isNull().cast("int")).alias("predicate"),
        F.array_sort(F.collect_list(F.substring("fact_id", 2, 9).cast("int"))).alias("ids"),
    )
    order = F.col("ids") != F.sequence(F.lit(1), F.size("ids"))
    return one.select("record_id", F.array_compact(F.array(F.when(F.col("evidence") == 1, "EVIDENCE_INVALID"), F.when(order, "IDS_NOT_SEQUENTIAL"), F.when(F.col("subject") == 1, "SUBJECT_UNRESOLVED"), F.when(F.col("predicate") == 1, "FACT_INCOMPLETE"))).alias("issues"))


def provable(rows: DataFrame) -> DataFrame:
    """(pair_id, provable) over the facts of a pair: all aligned, equal in the number of numbers, in polarity and in modality."""
    fine = F.col("aligned") & (F.col("n_history") == F.col("n_current")) & F.col("same_polarity") & F.col("same_modality")
    return rows.groupBy("pair_id").agg(F.bool_and(fine).alias("provable"))


def contradictions(slots: DataFrame) -> DataFrame:
    """Slots that one fact gives two values: (record_id, fact_id, slot, n_values)."""
    return slots.groupBy("record_id", "fact_id", "slot").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")
