"""From compared pairs to decisions: alignment, pair outcomes, the three-valued set decision, and its audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .recall import equal_texts

DUPLICATE, DISTINCT, BOUNDARY = "重复", "不重复", "边界case/疑难case"
#: Reasons for an unresolved pair, the most important first (fixed values).
PRIORITY = (
    "SUBJECT_UNRESOLVED", "DEPENDENCY_TIMEOUT", "RECALL_INCOMPLETE", "CANDIDATE_BUDGET_EXHAUSTED", "EXTRACTION_FAILED",
    "EVIDENCE_INVALID", "NUMERIC_ALIGNMENT_FAILED", "TIME_RELATION_UNCERTAIN", "RULE_UNCOVERED", "FACT_INCOMPLETE",
)
PROOFS = ("EXACT_TEXT_MATCH", "LOSSLESS_TEXT_MATCH")
WRAPPERS = ("宣布", "公告", "披露", "发布")


def rank_of(code: Column) -> Column:
    """Place in PRIORITY; an unknown code comes last."""
    return F.coalesce(F.create_map(*[F.lit(x) for k, c in enumerate(PRIORITY) for x in (c, k)])[code], F.lit(len(PRIORITY)))


def primary_issue(issues: DataFrame, by: str) -> DataFrame:
    """(by, code, detail): the issue of the highest priority, ties by detail."""
    best = F.min(F.struct(rank_of(F.col("code")).alias("r"), "detail", "code"))
    return issues.groupBy(by).agg(best.alias("b")).select(by, "b.code", "b.detail")


def align(history: DataFrame, current: DataFrame) -> DataFrame:
    """One-to-one alignment of facts (pair_id, fact_id, ord, subject, predicate, key_object) with equal core slots.

    Taking, for each history fact in order, the first current fact that is free and equal pairs the i-th of each kind with
    the i-th, so an occurrence number makes it an equi-join. A fact without subject or predicate aligns with nothing.
    """
    key = ["pair_id", "subject", "predicate", "key_object"]
    numbered = lambda df: df.where("subject is not null and predicate is not null").withColumn("key_object", F.coalesce("key_object", F.lit("\x00"))).withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("ord", "fact_id")))
    h = numbered(history).select(*key, "n", F.col("fact_id").alias("history_fact"))
    c = numbered(current).select(*key, "n", F.col("fact_id").alias("current_fact"))
    return h.join(c, [*key, "n"]).select("pair_id", "history_fact", "current_fact")


def extra_events(pairs: DataFrame) -> DataFrame:
    """(pair_id, history_facts, current_facts) arrays to the facts that only one side has."""
    return pairs.select("pair_id", F.array_sort(F.array_except("history_facts", "current_facts")).alias("history_only"), F.array_sort(F.array_except("current_facts", "history_facts")).alias("current_only"))


def filler_exempt(facts: DataFrame) -> DataFrame:
    """Leftover facts (pair_id, side, fact_id, predicate, subject, start, end, aligned) that only wrap another fact of the same
    side: a wrapper verb, and an aligned fact of the same clause and subject."""
    twins = facts.where("aligned").select("pair_id", "side", "subject", "clause").distinct()
    left = facts.where(~F.col("aligned") & F.col("predicate").isin(*WRAPPERS))
    return left.join(twins, ["pair_id", "side", "subject", "clause"], "left_semi").select("pair_id", "side", "fact_id")


def pair_outcome(decoupled: bool = False) -> tuple[Column, Column]:
    """(outcome, code) of a pair with columns n_conflicts, issue (the primary code or null), equivalent (bool), proof (or null).

    A conflict decides; with ``decoupled``, a text certificate then stands even against open issues.
    """
    conflict = F.col("n_conflicts") > 0
    certified = F.col("equivalent") & F.coalesce(F.col("proof").isin(*PROOFS), F.lit(False)) & F.lit(decoupled)
    equal = certified | (F.col("issue").isNull() & F.col("equivalent"))
    outcome = F.when(conflict, "conflict").when(equal, "equivalent").otherwise("unresolved")
    code = F.when(conflict, "VERIFIED_CONFLICT").when(equal, F.coalesce("proof", F.lit("FACT_EQUIVALENT"))).otherwise(F.coalesce("issue", F.lit("FACT_INCOMPLETE")))
    return outcome, code


def aggregate(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """The three-valued decision of each item.

    items: record_id, item_id, coverage_complete, subject_missing; pairs: record_id, cand_seq, cand_item_id, outcome, code.
    An equivalent pair makes it a duplicate of all equivalent items, by arrival; without one, no open issue and full coverage
    make it distinct; everything else is a boundary case with the most important reason. Items without pairs stay.
    """
    one = pairs.groupBy("record_id").agg(
        F.max((F.col("outcome") == "equivalent").cast("int")).alias("any_equal"),
        F.max((F.col("outcome") == "conflict").cast("int")).alias("any_conflict"),
        F.min(F.when(F.col("outcome") == "unresolved", F.struct(rank_of(F.col("code")).alias("r"), "code"))).alias("issue"),
        F.array_sort(F.collect_set(F.when(F.col("outcome") == "equivalent", F.struct("cand_seq", "cand_item_id")))).alias("equal"),
    )
    return decided(items.join(one, "record_id", "left").withColumn("any_equal", F.coalesce("any_equal", F.lit(0))))


def decided(rows: DataFrame) -> DataFrame:
    """The decision of items with what their pairs come to: any_equal, any_conflict, issue, equal."""
    distinct = F.col("issue").isNull() & F.col("coverage_complete") & ~F.col("subject_missing")
    decision = F.when(F.col("any_equal") == 1, DUPLICATE).when(distinct, DISTINCT).otherwise(BOUNDARY)
    code = (
        F.when(F.col("any_equal") == 1, "DUPLICATE_FOUND")
        .when(distinct, F.when(F.col("any_conflict") == 1, "VERIFIED_CONFLICT").otherwise("NO_DUPLICATE_FOUND"))
        .otherwise(F.coalesce("issue.code", F.when(F.col("subject_missing"), "SUBJECT_UNRESOLVED").otherwise("RECALL_INCOMPLETE")))
    )
    ids = F.when(F.col("any_equal") == 1, F.transform("equal", lambda x: x["cand_item_id"])).otherwise(F.array().cast("array<string>"))
    extra = [c for c in ("n_equal",) if c in rows.columns]
    return rows.select("record_id", "item_id", decision.alias("decision"), ids.alias("duplicate_ids"), code.alias("code"), *extra)


def public_view(decisions: DataFrame, n_ids: Column | None = None) -> DataFrame:
    """What leaves the engine: decision, ids and a reason without internal codes; only duplicates may name ids.
    ``n_ids``: how many these are, where they aren't listed."""
    reason = F.when(F.col("decision") == DUPLICATE, "主体和核心事件一致。").when(F.col("decision") == DISTINCT, "未发现可比较的重复候选。").otherwise("证据不足，需要复核。")
    sound = (F.col("decision") == DUPLICATE) == ((F.size("duplicate_ids") if n_ids is None else n_ids) > 0)
    return decisions.withColumn("reason", reason).withColumn("valid", sound)


def audit(pairs: DataFrame, version: str) -> DataFrame:
    """Adds comparison_id, a digest of the canonical JSON of (current, history, version), and payload_hash."""
    text = F.concat(F.lit('["'), F.col("record_id"), F.lit('","'), F.col("cand_id"), F.lit(f'","{version}"]'))
    payload = F.concat_ws("|", "record_id", "cand_id", "outcome", "code")
    return pairs.withColumn("comparison_id", F.sha2(text, 256)).withColumn("payload_hash", F.sha2(payload, 256))


def certified(items: DataFrame, listed: bool = True, least: int = 50) -> DataFrame:
    """Items with what their pairs of equal text come to by text certificate alone, for ``decided``; n_equal has the number of equivalent ones,
    and ``listed`` says whether ``equal`` names them.

    Of a group of equal texts all have ``least`` code points and are equivalent, EXACT or LOSSLESS, or none is and all pairs are open. Ids
    are read off the group where it lies, so pairs are never shuffled.
    """
    rows = equal_texts(items, (F.length(T.normalized(F.col("text"))) >= least).alias("long"))
    is_equal = (F.col("hits") > 0) & F.col("long")
    issue = F.when((F.col("hits") > 0) & ~F.col("long"), F.struct(rank_of(F.lit("FACT_INCOMPLETE")).alias("r"), F.lit("FACT_INCOMPLETE").alias("code")))
    equal = F.array().cast("array<struct<cand_seq:bigint,cand_item_id:string>>")
    if listed:
        whole = Window.partitionBy("scope_id", "business_date", "group").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("members", F.collect_list(F.struct(F.col("arrival_seq").alias("cand_seq"), F.col("item_id").alias("cand_item_id"))).over(whole))
        equal = F.when(is_equal, F.filter(F.slice("members", F.lit(1), F.col("earlier")), lambda _, place: ~F.array_contains("own", place + 1))).otherwise(equal)
    return rows.select("record_id", "item_id", is_equal.cast("int").alias("any_equal"), F.lit(0).alias("any_conflict"), issue.alias("issue"), equal.alias("equal"), F.when(is_equal, F.col("hits")).otherwise(0).alias("n_equal"))


def align_by_dictionary(history: DataFrame, current: DataFrame, aligned: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Facts left over by ``align`` that agree on one core slot through the dictionary (surface, canonical) and on the rest as written.

    First come, first served in the order of the history side: what one fact takes is gone for the next, so each pair's
    leftovers (a handful of facts) are folded together. The canonical forms come by equi-joins before that.
    """
    import pandas as pd

    names = dictionary.select("surface", "canonical")

    def canon(df: DataFrame) -> DataFrame:
        for slot in ("subject", "predicate"):
            df = df.join(names.select(F.col("surface").alias(slot), F.col("canonical").alias(f"{slot}_c")), slot, "left").withColumn(f"{slot}_c", F.coalesce(f"{slot}_c", slot))
        return df.where("subject is not null and predicate is not null")

    columns = ["pair_id", "fact_id", "ord", "subject", "predicate", "key_object", "subject_c", "predicate_c"]
    fresh = [F.col(x).alias(x) for x in columns]  # the sides may come from one table
    h = canon(history.join(aligned.select("pair_id", F.col("history_fact").alias("fact_id")), ["pair_id", "fact_id"], "left_anti")).select(*fresh)
    c = canon(current.join(aligned.select("pair_id", F.col("current_fact").alias("fact_id")), ["pair_id", "fact_id"], "left_anti")).select(*fresh)

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, free = [], right.sort_values(["ord", "fact_id"]).to_dict("records")
        for x in left.sort_values(["ord", "fact_id"]).to_dict("records"):
            for y in free:
                same = [x[s] == y[s] for s in ("subject", "predicate")]
                alike = [x[f"{s}_c"] == y[f"{s}_c"] for s in ("subject", "predicate")]
                if all(alike) and sum(same) == 1 and (x["key_object"] or None) == (y["key_object"] or None):
                    out.append((x["pair_id"], x["fact_id"], y["fact_id"]))
                    free.remove(y)
                    break
        return pd.DataFrame(out, columns=["pair_id", "history_fact", "current_fact"])

    return h.groupBy("pair_id").cogroup(c.groupBy("pair_id")).applyInPandas(fold, "pair_id string, history_fact string, current_fact string")


def zipped_numbers(pairs: DataFrame) -> DataFrame:
    """(pair_id, place, history, current) of two arrays of numbers, by place up to the shorter, and whether lengths differ."""
    n = F.least(F.size("history"), F.size("current"))
    uneven = (F.size("history") != F.size("current")).alias("uneven")
    rows = pairs.select("pair_id", uneven, F.posexplode_outer(F.slice(F.arrays_zip("history", "current"), 1, F.greatest(n, F.lit(0)))).alias("place", "z"))
    return rows.select("pair_id", "place", F.col("z.history").alias("history"), F.col("z.current").alias("current"), "uneven")


def carried_subjects(clauses: DataFrame) -> DataFrame:
    """Adds the subject in force to (record_id, place, subject): its own, else the last one before it in the text."""
    before = Window.partitionBy("record_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return clauses.withColumn("carried", F.last("subject", ignorenulls=True).over(before))
