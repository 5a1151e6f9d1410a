"""Ordered state: admission, frontiers, commits, delivery and clean-up, as queries over event and state tables.

Frontiers here follow arrival numbers, not event time: they are contiguous prefixes, found by the gap between a number and
its place. Every function works on a bounded set (a day and scope, or a micro-batch) or by partitioned windows over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import numbered

ZONE = "Asia/Shanghai"
RETENTION_DAYS = 7
BATCH_ITEMS, BATCH_BYTES, LOG_ITEMS, LOG_BYTES = 8, 512 * 1024, 64, 4 * 1024 * 1024
STALE_WINDOW = 200


def business_date(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, ZONE))


def expires_at(at: Column) -> Column:
    """Local midnight after RETENTION_DAYS, in UTC."""
    return F.to_utc_timestamp(F.date_add(business_date(at), RETENTION_DAYS).cast("timestamp"), ZONE)


def deadline(now: Column, expires: Column) -> Column:
    return F.least(now + F.expr("INTERVAL 24 HOURS"), expires)


def admit(requests: DataFrame, first_seq: int = 1) -> DataFrame:
    """Idempotent admission in order: adds status (accepted, reused, conflict) and arrival_seq (null for a conflict).

    requests: ord, scope_id, request_id, item_id, text. A request or item that comes again is the same only if all three agree.
    The first of a request and the first of an item decide; numbers are given to first ones only, without gaps.
    """
    by = lambda *cols: Window.partitionBy("scope_id", *cols).orderBy("ord")
    body = F.struct("request_id", "item_id", "text")
    seen = requests.withColumn("by_request", F.first(body).over(by("request_id"))).withColumn("by_item", F.first(body).over(by("item_id")))
    new = (F.row_number().over(by("request_id")) == 1) & (F.row_number().over(by("item_id")) == 1)
    status = F.when(new, "accepted").when((F.col("by_request") == body) & (F.col("by_item") == body), "reused").otherwise("conflict")
    marked = seen.withColumn("status", status)
    numbers = numbered(marked.where("status = 'accepted'").select("ord"), "ord", "own_seq", first_seq)
    rows = marked.join(numbers, "ord", "left")
    return rows.withColumn("arrival_seq", F.when(F.col("status") != "conflict", F.first("own_seq").over(by("request_id")))).select("ord", "scope_id", "request_id", "item_id", "status", "arrival_seq")


def identity_conflicts(requests: DataFrame) -> DataFrame:
    """Items that came with more than one (request, text): (scope_id, item_id, n_versions)."""
    return requests.groupBy("scope_id", "item_id").agg(F.count_distinct(F.struct("request_id", "text")).alias("n_versions")).where("n_versions > 1")


def batch_limits(batches: DataFrame) -> DataFrame:
    """(batch_id, n_items, n_bytes, verdict) of rows (batch_id, text): a batch is taken whole or not at all."""
    one = batches.groupBy("batch_id").agg(F.count("*").alias("n_items"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))
    verdict = F.when(F.col("n_items") > BATCH_ITEMS, "too_many_items").when(F.col("n_bytes") > BATCH_BYTES, "too_many_bytes").otherwise("ok")
    return one.withColumn("verdict", verdict)


def micro_batches(arrivals: DataFrame, items: int = BATCH_ITEMS) -> DataFrame:
    """(scope_id, ord) rows to consecutive batches of at most ``items`` within a scope."""
    place = F.row_number().over(Window.partitionBy("scope_id").orderBy("ord"))
    return arrivals.withColumn("batch", F.floor((place - 1) / items))


def frontier(ready: DataFrame, foreign: DataFrame, stored: DataFrame) -> DataFrame:
    """(scope_id, business_date, frontier): the end of the unbroken run of ready or provably foreign numbers above the stored one."""
    keys = ["scope_id", "business_date"]
    known = ready.select(*keys, "seq").unionByName(foreign.select(*keys, "seq")).distinct()
    above = stored.join(known, keys).where(F.col("seq") > F.col("stored_seq"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    run = above.withColumn("unbroken", F.col("seq") - F.col("stored_seq") == place).where("unbroken").groupBy(*keys).agg(F.max("seq").alias("reach"))
    return stored.join(run, keys, "left").select(*keys, F.coalesce("reach", "stored_seq").alias("frontier"))


def decision_prefix(rows: DataFrame) -> DataFrame:
    """Adds state to (scope_id, seq, committable): rows before the first that can't be committed are committed, later ones deferred."""
    blocker = F.min(F.when(~F.col("committable"), F.col("seq"))).over(Window.partitionBy("scope_id"))
    state = F.when(blocker.isNull() | (F.col("seq") < blocker), "committed").when(F.col("seq") == blocker, "blocked").otherwise("deferred")
    return rows.withColumn("state", state)


def commit_target(stored: DataFrame, flips: DataFrame) -> DataFrame:
    """Flipped rows (scope_id, seq) with their state: within the contiguous prefix above stored_seq, or deferred."""
    place = F.row_number().over(Window.partitionBy("scope_id").orderBy("seq"))
    rows = flips.distinct().join(stored, "scope_id").where(F.col("seq") > F.col("stored_seq"))
    return rows.withColumn("state", F.when(F.col("seq") - F.col("stored_seq") == place, "committed").otherwise("deferred"))


def divergence(first: DataFrame, again: DataFrame, key: str, stable: list[str]) -> DataFrame:
    """(key, differing): fields that a retry would change."""
    a, b = first.alias("a"), again.alias("b")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in stable]))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), differ.alias("differing"))


def regressions(rows: DataFrame) -> DataFrame:
    """Rows whose timestamp lies before that of the row before them in their scope and day."""
    before = F.lag("at").over(Window.partitionBy("scope_id", "business_date").orderBy("seq"))
    return rows.withColumn("before", before).where(F.col("before") > F.col("at"))


def due(state: DataFrame, now: Column) -> DataFrame:
    """Adds action to delivery rows: send, wait, expire, give_up, release (a lease that ran out), none."""
    action = (
        F.when((F.col("delivery_state") == "pending") & (now >= F.col("expires_at")), "expire")
        .when((F.col("delivery_state") == "pending") & (now >= F.col("delivery_deadline_at")), "give_up")
        .when((F.col("delivery_state") == "pending") & (F.col("round_attempts") >= 12), "give_up")
        .when((F.col("delivery_state") == "pending") & (now >= F.col("next_delivery_at")), "send")
        .when(F.col("delivery_state") == "pending", "wait")
        .when((F.col("delivery_state") == "delivering") & (now >= F.col("lease_until")), "release")
        .otherwise("none")
    )
    return state.withColumn("action", action)


def backoff(attempt: Column) -> Column:
    """Seconds before the next attempt, without jitter."""
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(1800.0))


def after_send(state: DataFrame) -> DataFrame:
    """The state after a send (column ack: true, false, or null for an unknown outcome)."""
    new = F.when(F.col("ack"), "delivered").when(F.col("ack").isNull(), "delivering").when(F.col("round_attempts") + 1 >= 12, "exhausted").otherwise("pending")
    return state.withColumn("new_state", new).withColumn("wait_s", F.when(new == "pending", backoff(F.col("round_attempts") + 1)))


def cleanup_target(name: Column) -> Column:
    """The date of a day table's name that may be dropped; null for any other name or an impossible date."""
    pattern = "^[a-z0-9-]*news-dedup-(items|audits)-v1-([0-9]{4}\\.[0-9]{2}\\.[0-9]{2})$"
    return F.when(name.rlike(pattern), F.try_to_date(F.regexp_extract(name, pattern, 2), "yyyy.MM.dd"))


def lookup(requests: DataFrame, mapping: DataFrame, pending: DataFrame, main: DataFrame) -> DataFrame:
    """Where a request is found (request_id): main first, then the pending log, else a mapping without a body, else nothing."""
    joined = requests.join(mapping.select("request_id", F.col("record_id").alias("mapped")), "request_id", "left")
    joined = joined.join(pending.select("request_id", F.col("record_id").alias("waiting")), "request_id", "left")
    joined = joined.join(main.select(F.col("record_id").alias("mapped"), F.col("task_state").alias("state")), "mapped", "left")
    source = F.when(F.col("state").isNotNull(), "main").when(F.col("waiting").isNotNull(), "pending").when(F.col("mapped").isNotNull(), "unavailable").otherwise("not_found")
    return joined.select("request_id", source.alias("found_in"), F.coalesce("state", F.when(F.col("waiting").isNotNull(), "accepted")).alias("task_state"))


def incremental_window(seq: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(1), seq - STALE_WINDOW), seq - 1


def watermark_complete(rows: DataFrame) -> DataFrame:
    """Adds complete: both frontiers (prepared_seq, lexical_seq) reach the number before arrival_seq."""
    floor = F.col("arrival_seq") - 1
    return rows.withColumn("complete", F.coalesce((F.col("prepared_seq") >= floor) & (F.col("lexical_seq") >= floor), F.lit(False)))


def refreeze(history: DataFrame, increment: DataFrame) -> DataFrame:
    """The candidate set after an increment: (query_id, cand_id, payload), the later payload winning."""
    both = history.withColumn("late", F.lit(0)).unionByName(increment.withColumn("late", F.lit(1)))
    return both.groupBy("query_id", "cand_id").agg(F.max_by("payload", "late").alias("payload"))


def quarantine(log: DataFrame, now: Column) -> DataFrame:
    """Adds gate to log entries (entry, expires_at, conflict): expired and conflict entries block all entries behind them."""
    bad = F.when(now >= F.col("expires_at"), "expired").when(F.col("conflict"), "conflict")
    rows = log.withColumn("bad", bad)
    stop = F.min(F.when(F.col("bad").isNotNull(), F.col("entry"))).over(Window.partitionBy("scope_id"))
    return rows.withColumn("gate", F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("entry") > stop, "blocked").otherwise("open")).drop("bad")


def prechecked(plan: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of a plan (history_hash, current_hash, version) whose outcome is cached, and those still to compare, each once."""
    key = ["history_hash", "current_hash", "version"]
    return plan.join(cache, key), plan.select(*key).distinct().join(cache, key, "left_anti")


def run_mode(rows: DataFrame) -> DataFrame:
    """What each mode does with a decision: fixed runs no loop, shadow only emits, live commits, parallel_live checks ahead too."""
    does = F.create_map(*[F.lit(x) for kv in {"fixed": "none", "shadow": "emit", "live": "commit", "parallel_live": "precheck,commit"}.items() for x in kv])
    return rows.withColumn("does", does[F.col("mode")])
