"""Queries over ordered state: admission, frontiers, commits, delivery and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as S
from ..streaming import state
from .registry import query

REQUESTS = [(1, "s", "r1", "i1", "a"), (2, "s", "r2", "i2", "b"), (3, "s", "r1", "i1", "a"), (4, "s", "r3", "i2", "b"), (5, "s", "r2", "i2", "c"), (6, "t", "r1", "i1", "z"), (7, "s", "r4", "i4", "d")]
REQUEST_COLUMNS = {"ord": "long", "scope_id": "string", "request_id": "string", "item_id": "string", "text": "string"}


@query(S.values({"ord": "long", "status": "string", "arrival_seq": "long"}, [(1, "accepted", 1), (2, "accepted", 2), (3, "reused", 1), (4, "conflict", None), (5, "conflict", None), (6, "accepted", 3), (7, "accepted", 4)], duck=True))
def admission_replay(spark: SparkSession, d: str) -> DataFrame:
    return state.admit(S.literal(spark, REQUEST_COLUMNS, REQUESTS)).select("ord", "status", F.col("arrival_seq").cast("long").alias("arrival_seq"))


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 THEN 'accepted' ELSE 'conflict' END AS status FROM events")
def event_admission(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests whose item is the user: the first of a user and type is admitted, later ones carry another body."""
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("scope_id"), F.col("event_id").cast("string").alias("request_id"), F.col("user_id").cast("string").alias("item_id"), F.col("props").alias("text"))
    return state.admit(rows).select(F.col("ord").alias("event_id"), "status")


@query("SELECT event_type AS scope_id, user_id::VARCHAR AS item_id, count(DISTINCT event_id)::BIGINT AS n_versions FROM events GROUP BY ALL HAVING count(DISTINCT event_id) > 1")
def identity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "events").select(F.col("event_type").alias("scope_id"), F.col("user_id").cast("string").alias("item_id"), F.col("event_id").cast("string").alias("request_id"), F.lit("").alias("text"))
    return state.identity_conflicts(rows)


@query("SELECT conv_id AS batch_id, count(*)::BIGINT AS n_items, sum(strlen(text))::BIGINT AS n_bytes, CASE WHEN count(*) > 8 THEN 'too_many_items' WHEN sum(strlen(text)) > 524288 THEN 'too_many_bytes' ELSE 'ok' END AS verdict FROM conversations GROUP BY 1")
def batch_limits(spark: SparkSession, d: str) -> DataFrame:
    return state.batch_limits(S.table(spark, d, "conversations").select(F.col("conv_id").alias("batch_id"), "text"))


@query("SELECT source AS scope_id, doc_id AS ord, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8)::BIGINT AS batch FROM documents")
def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    return state.micro_batches(S.table(spark, d, "documents").select(F.col("source").alias("scope_id"), F.col("doc_id").alias("ord")))


READY = [("a", "d", 1), ("a", "d", 2), ("a", "d", 4), ("b", "d", 1), ("b", "d", 2), ("b", "d", 4), ("c", "d", 7)]
FOREIGN = [("b", "d", 3)]
STORED = [("a", "d", 0), ("b", "d", 0), ("c", "d", 5), ("e", "d", 9)]
KEYS = {"scope_id": "string", "business_date": "string"}


@query(S.values(KEYS | {"frontier": "long"}, [("a", "d", 2), ("b", "d", 4), ("c", "d", 5), ("e", "d", 9)], duck=True))
def prepared_frontier(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda x: S.literal(spark, KEYS | {"seq": "long"}, x)
    return state.frontier(rows(READY), rows(FOREIGN), S.literal(spark, KEYS | {"stored_seq": "long"}, STORED))


@query("WITH r AS (SELECT conv_id AS scope_id, turn AS seq, length(text) > 60 AS ok FROM conversations), b AS (SELECT scope_id, min(seq) AS stop FROM r WHERE NOT ok GROUP BY 1) SELECT scope_id, seq, CASE WHEN stop IS NULL OR seq < stop THEN 'committed' WHEN seq = stop THEN 'blocked' ELSE 'deferred' END AS state FROM r LEFT JOIN b USING (scope_id)")
def decision_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Turns commit in order until the first that can't (short ones here)."""
    rows = S.table(spark, d, "conversations").select(F.col("conv_id").alias("scope_id"), F.col("turn").alias("seq"), (F.length("text") > 60).alias("committable"))
    return state.decision_prefix(rows).select("scope_id", "seq", "state")


@query(S.values({"scope_id": "string", "seq": "long", "state": "string"}, [("a", 1, "committed"), ("a", 2, "committed"), ("a", 4, "deferred"), ("b", 7, "committed")], duck=True))
def deferred_commits(spark: SparkSession, d: str) -> DataFrame:
    flips = S.literal(spark, {"scope_id": "string", "seq": "long"}, [("a", 1), ("a", 2), ("a", 4), ("b", 7), ("b", 6)])
    stored = S.literal(spark, {"scope_id": "string", "stored_seq": "long"}, [("a", 0), ("b", 6)])
    return state.commit_target(stored, flips).select("scope_id", "seq", "state")


@query(S.values({"record_id": "string", "differing": "string"}, [("x", ""), ("y", "decision"), ("z", "code")], duck=True))
def retry_divergence(spark: SparkSession, d: str) -> DataFrame:
    columns = {"record_id": "string", "decision": "string", "code": "string"}
    first = S.literal(spark, columns, [("x", "重复", None), ("y", "重复", "A"), ("z", "不重复", "A")])
    again = S.literal(spark, columns, [("x", "重复", None), ("y", "不重复", "A"), ("z", "不重复", None)])
    return state.divergence(first, again, "record_id", ["decision", "code"]).select("record_id", F.array_join("differing", ",").alias("differing"))


@query("SELECT event_id, (ts + INTERVAL 8 HOUR)::DATE AS business_date, ((ts + INTERVAL 8 HOUR)::DATE + 7)::TIMESTAMP - INTERVAL 8 HOUR AS expires_at, least(ts + INTERVAL 24 HOUR, ((ts + INTERVAL 8 HOUR)::DATE + 7)::TIMESTAMP - INTERVAL 8 HOUR) AS deadline FROM events")
def business_dates(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    rows = S.table(spark, d, "events").select("event_id", at.alias("at")).select("event_id", "at", state.business_date(F.col("at")).alias("business_date"), state.expires_at(F.col("at")).alias("expires_at"))
    return rows.select("event_id", "business_date", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), state.deadline(F.col("at"), F.col("expires_at")).cast("timestamp_ntz").alias("deadline"))


@query("SELECT event_id FROM (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before > ts")
def timestamp_regressions(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "events").select("event_id", F.col("user_id").alias("scope_id"), F.lit("").alias("business_date"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return state.regressions(rows).select("event_id")


NOW = "2026-09-27 12:00:00"
DELIVERIES = [
    ("d1", "pending", "2026-09-27 11:00:00", "2026-09-28 00:00:00", "2026-10-03 16:00:00", 0, None), ("d2", "pending", "2026-09-27 13:00:00", "2026-09-28 00:00:00", "2026-10-03 16:00:00", 1, None), ("d3", "pending", "2026-09-27 11:00:00", "2026-09-27 12:00:00", "2026-10-03 16:00:00", 1, None), ("d4", "pending", "2026-09-27 11:00:00", "2026-09-28 00:00:00", "2026-09-27 11:59:59", 1, None),
    ("d5", "delivering", None, "2026-09-28 00:00:00", "2026-10-03 16:00:00", 1, "2026-09-27 11:59:00"), ("d6", "delivering", None, "2026-09-28 00:00:00", "2026-10-03 16:00:00", 1, "2026-09-27 12:01:00"), ("d7", "held", None, None, "2026-10-03 16:00:00", 0, None), ("d8", "pending", "2026-09-27 11:00:00", "2026-09-28 00:00:00", "2026-10-03 16:00:00", 12, None), ("d9", "delivered", None, None, None, 3, None),
]
DELIVERY_COLUMNS = {"id": "string", "delivery_state": "string", "next_delivery_at": "timestamp", "delivery_deadline_at": "timestamp", "expires_at": "timestamp", "round_attempts": "int", "lease_until": "timestamp"}
_ACTIONS = [("d1", "send"), ("d2", "wait"), ("d3", "give_up"), ("d4", "expire"), ("d5", "release"), ("d6", "none"), ("d7", "none"), ("d8", "give_up"), ("d9", "none")]


@query(S.values({"id": "string", "action": "string"}, _ACTIONS, duck=True))
def delivery_due(spark: SparkSession, d: str) -> DataFrame:
    return state.due(S.literal(spark, DELIVERY_COLUMNS, DELIVERIES), F.lit(NOW).cast("timestamp")).select("id", "action")


SENT = [("a", 0, True), ("b", 0, False), ("c", 5, False), ("e", 11, False), ("f", 3, None)]


@query(S.values({"id": "string", "new_state": "string", "wait_s": "double"}, [("a", "delivered", None), ("b", "pending", 1.0), ("c", "pending", 32.0), ("e", "exhausted", None), ("f", "delivering", None)], duck=True))
def delivery_after_send(spark: SparkSession, d: str) -> DataFrame:
    return state.after_send(S.literal(spark, {"id": "string", "round_attempts": "int", "ack": "boolean"}, SENT)).select("id", "new_state", "wait_s")


@query("SELECT n::INTEGER AS attempt, least(power(2, n - 1), 1800)::DOUBLE AS seconds FROM range(1, 16) t(n)")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 16).select(F.col("id").cast("int").alias("attempt")).withColumn("seconds", state.backoff(F.col("attempt")))


INDICES = [("x-news-dedup-items-v1-2026.09.19",), ("x-news-dedup-audits-v1-2026.09.18",), ("news-dedup-items-v1-2026.02.30",), ("news-dedup-items-v2-2026.09.19",), ("other",)]


@query(S.values({"name": "string", "day": "date", "target": "boolean", "overdue": "boolean"}, [("x-news-dedup-items-v1-2026.09.19", "2026-09-19", True, False), ("x-news-dedup-audits-v1-2026.09.18", "2026-09-18", False, True)], duck=True))
def cleanup_targets(spark: SparkSession, d: str) -> DataFrame:
    """Day tables of exactly today minus the retention are dropped; older ones are residue to report."""
    rows = S.literal(spark, {"name": "string"}, INDICES).withColumn("day", state.cleanup_target(F.col("name"))).where("day is not null")
    limit = F.date_sub(F.lit("2026-09-26").cast("date"), state.RETENTION_DAYS)
    return rows.select("name", "day", (F.col("day") == limit).alias("target"), (F.col("day") < limit).alias("overdue"))


@query("SELECT (ts + INTERVAL 8 HOUR)::DATE AS business_date, count(*)::BIGINT AS n_items, count(*) FILTER (WHERE ((ts + INTERVAL 8 HOUR)::DATE + 7)::TIMESTAMP - INTERVAL 8 HOUR < TIMESTAMP '2024-01-20 00:00:00')::BIGINT AS n_expired FROM events GROUP BY 1")
def expired_documents(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    expired = (state.expires_at(at) < F.lit("2024-01-20 00:00:00").cast("timestamp")).cast("long")
    return S.table(spark, d, "events").groupBy(state.business_date(at).alias("business_date")).agg(F.count("*").alias("n_items"), F.sum(expired).alias("n_expired"))


@query(S.values({"request_id": "string", "found_in": "string", "task_state": "string"}, [("r1", "main", "done"), ("r2", "pending", "accepted"), ("r3", "unavailable", None), ("r4", "not_found", None)], duck=True))
def task_lookup(spark: SparkSession, d: str) -> DataFrame:
    pair = {"request_id": "string", "record_id": "string"}
    return state.lookup(S.literal(spark, {"request_id": "string"}, [("r1",), ("r2",), ("r3",), ("r4",)]), S.literal(spark, pair, [("r1", "x1"), ("r3", "x3")]), S.literal(spark, pair, [("r2", "x2")]), S.literal(spark, {"record_id": "string", "task_state": "string"}, [("x1", "done")]))


@query("SELECT doc_id + 1 AS seq, greatest(1, doc_id + 1 - 200) AS low, doc_id AS high FROM documents")
def incremental_windows(spark: SparkSession, d: str) -> DataFrame:
    low, high = state.incremental_window(F.col("arrival_seq"))
    return S.items(spark, d).select(F.col("arrival_seq").alias("seq"), low.cast("long").alias("low"), high.alias("high"))


BUDGETS = [("b1", 10.0, 3.0, 5.0), ("b2", 10.0, 9.5, 5.0), ("b3", 10.0, 11.0, 5.0)]


@query(S.values({"id": "string", "timeout": "double", "code": "string"}, [("b1", 5.0, None), ("b2", 0.5, None), ("b3", 0.0, "CANDIDATE_BUDGET_EXHAUSTED")], duck=True))
def runtime_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = S.literal(spark, {"id": "string", "total": "double", "spent": "double", "asked": "double"}, BUDGETS)
    left = F.greatest(F.lit(0.0), F.col("total") - F.col("spent"))
    return rows.select("id", F.least("asked", left).alias("timeout"), F.when(left <= 0, "CANDIDATE_BUDGET_EXHAUSTED").alias("code"))


PROBES = [("live", "store", False), ("live", "vector", True), ("fixed", "vector", False), ("fixed", "store", True), ("shadow", "vector", False), ("shadow", "store", True)]


@query(S.values({"mode": "string", "readiness": "string"}, [("live", "fatal"), ("fixed", "ready"), ("shadow", "degraded")], duck=True))
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """A failed store is fatal in any mode; a failed vector store only degrades, and doesn't count in the fixed mode."""
    rows = S.literal(spark, {"mode": "string", "probe": "string", "ok": "boolean"}, PROBES)
    level = F.when(F.col("ok"), 0).when(F.col("probe") == "store", 2).when(F.col("mode") == "fixed", 0).otherwise(1)
    return rows.groupBy("mode").agg(F.max(level).alias("level")).select("mode", F.when(F.col("level") == 2, "fatal").when(F.col("level") == 1, "degraded").otherwise("ready").alias("readiness"))


@query("SELECT page_id, url IS NOT NULL AND regexp_matches(url, '^https?://') AS sound, sha256(url) AS url_key FROM pages")
def page_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan of two columns with its validity check."""
    return S.table(spark, d, "pages").select("page_id", (F.col("url").isNotNull() & F.col("url").rlike("^https?://")).alias("sound"), F.sha2("url", 256).alias("url_key"))
