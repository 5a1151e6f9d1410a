"""Queries over alignment by dictionary, carried values, anchors, and the smaller pieces of ordered state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import decide
from ..sources import tables as S
from ..streaming import state
from .registry import ITEMS, query

FACTS = [
    ("p1", "h", "f1", 1, "EIA", "回购", None), ("p1", "c", "f1", 1, "美国能源信息署", "回购", None), ("p1", "h", "f2", 2, "甲公司", "买入", None), ("p1", "c", "f2", 2, "甲公司", "增持", None),
    ("p2", "h", "f1", 1, "EIA", "买入", None), ("p2", "c", "f1", 1, "美国能源信息署", "增持", None), ("p3", "h", "f1", 1, "EIA", "回购", None), ("p3", "h", "f2", 2, "EIA", "回购", None), ("p3", "c", "f1", 1, "美国能源信息署", "回购", None),
]
FACT_COLUMNS = {"pair_id": "string", "side": "string", "fact_id": "string", "ord": "int", "subject": "string", "predicate": "string", "key_object": "string"}
NAMES = [("EIA", "美国能源信息署"), ("买入", "增持")]


@query(S.values({"pair_id": "string", "history_fact": "string", "current_fact": "string"}, [("p1", "f1", "f1"), ("p1", "f2", "f2"), ("p3", "f1", "f1")], duck=True))
def dictionary_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows = S.literal(spark, FACT_COLUMNS, FACTS)
    h, c = rows.where("side = 'h'"), rows.where("side = 'c'")
    return decide.align_by_dictionary(h, c, decide.align(h, c), S.literal(spark, {"surface": "string", "canonical": "string"}, NAMES))


@query(S.values({"pair_id": "string", "place": "int", "history": "string", "current": "string", "uneven": "boolean"}, [("a", 0, "1", "1", True), ("a", 1, "2", "3", True), ("b", 0, "5", "5", False), ("c", None, None, None, True)], duck=True))
def numeric_zip(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", ["1", "2", "9"], ["1", "3"]), ("b", ["5"], ["5"]), ("c", [], ["4"])]
    return decide.zipped_numbers(S.literal(spark, {"pair_id": "string", "history": "array<string>", "current": "array<string>"}, rows))


@query("SELECT conv_id AS record_id, turn AS place, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations")
def carried_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The last user turn in force at each turn."""
    rows = S.table(spark, d, "conversations").select(F.col("conv_id").alias("record_id"), F.col("turn").alias("place"), F.when(F.col("role") == "user", F.col("text")).alias("subject"))
    return decide.carried_subjects(rows).select("record_id", "place", "carried")


@query(S.values({"id": "string", "day": "date"}, [("a", "2026-09-23"), ("b", "2026-09-22"), ("c", None), ("e", None)], duck=True))
def anchored_times(spark: SparkSession, d: str) -> DataFrame:
    rows = S.literal(spark, {"id": "string", "word": "string", "relation": "string", "anchor": "string"}, [("a", "次日", "next_day_of", "2026年9月22日"), ("b", "当日", "same_day_as", "2026-09-22"), ("c", "次日", "same_day_as", "2026-09-22"), ("e", "次日", "next_day_of", "9月22日")])
    return rows.select("id", values.anchored(F.col("word"), F.col("relation"), F.col("anchor")).alias("day"))


@query(f"WITH {ITEMS}, x AS (SELECT record_id, unnest(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[+-]?[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?')) AS raw FROM items) SELECT record_id, CASE WHEN regexp_matches(raw, '-[0-9]{{1,2}}-') THEN 'date' WHEN regexp_matches(raw, '^[0-9]{{6}}$') THEN 'identifier' ELSE 'quantity' END AS hint, count(*)::BIGINT AS n FROM x GROUP BY ALL")
def numeric_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = S.items(spark, d).select("record_id", F.explode(values.inventory(F.col("text"))).alias("x"))
    return rows.groupBy("record_id", F.col("x.hint").alias("hint")).agg(F.count("*").alias("n"))


@query("SELECT conv_id AS scope_id, turn AS seq, turn <= 2 AS complete FROM conversations")
def watermark_complete(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "conversations").select(F.col("conv_id").alias("scope_id"), F.col("turn").alias("seq"), F.col("turn").alias("arrival_seq"), F.lit(1).alias("prepared_seq"), F.lit(5).alias("lexical_seq"))
    return state.watermark_complete(rows).select("scope_id", "seq", "complete")


@query(S.values({"query_id": "string", "cand_id": "string", "payload": "string"}, [("q", "a", "new"), ("q", "b", "old"), ("q", "c", "new")], duck=True))
def refrozen_candidates(spark: SparkSession, d: str) -> DataFrame:
    columns = {"query_id": "string", "cand_id": "string", "payload": "string"}
    return state.refreeze(S.literal(spark, columns, [("q", "a", "old"), ("q", "b", "old")]), S.literal(spark, columns, [("q", "a", "new"), ("q", "c", "new")]))


@query(S.values({"scope_id": "string", "entry": "int", "gate": "string"}, [("s", 1, "open"), ("s", 2, "expired"), ("s", 3, "blocked"), ("t", 1, "conflict"), ("t", 2, "blocked"), ("u", 1, "open")], duck=True))
def quarantine_gates(spark: SparkSession, d: str) -> DataFrame:
    late, soon = "2026-10-03 16:00:00", "2026-09-26 00:00:00"
    rows = [("s", 1, late, False), ("s", 2, soon, False), ("s", 3, late, False), ("t", 1, late, True), ("t", 2, late, False), ("u", 1, late, False)]
    log = S.literal(spark, {"scope_id": "string", "entry": "int", "expires_at": "timestamp", "conflict": "boolean"}, rows)
    return state.quarantine(log, F.lit("2026-09-27 12:00:00").cast("timestamp")).select("scope_id", "entry", "gate")


@query(S.values({"history_hash": "string", "current_hash": "string", "version": "string"}, [("h2", "c1", "v1"), ("h1", "c1", "v2")], duck=True))
def uncached_pairs(spark: SparkSession, d: str) -> DataFrame:
    key = {"history_hash": "string", "current_hash": "string", "version": "string"}
    plan = S.literal(spark, key, [("h1", "c1", "v1"), ("h2", "c1", "v1"), ("h2", "c1", "v1"), ("h1", "c1", "v2")])
    cache = S.literal(spark, key | {"outcome": "string"}, [("h1", "c1", "v1", "equivalent")])
    return state.prechecked(plan, cache)[1]


@query(S.values({"mode": "string", "does": "string"}, [("fixed", "none"), ("shadow", "emit"), ("live", "commit"), ("parallel_live", "precheck,commit"), ("other", None)], duck=True))
def run_modes(spark: SparkSession, d: str) -> DataFrame:
    return state.run_mode(S.literal(spark, {"mode": "string"}, [("fixed",), ("shadow",), ("live",), ("parallel_live",), ("other",)]))
