"""Evaluation: isolation families, splits, frozen sets and metrics over labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import kept


def families(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root, family_id): connected components; root is the smallest node, family_id the digest of the sorted members.

    Labels take the smallest of their neighbours' and then their label's own label, until nothing changes.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "families")
    labels = kept(nodes.select("node", F.col("node").alias("root")).distinct(), "families")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        lower = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("seen", "root")).alias("root"), F.col("root").alias("old"))
        short = lower.alias("x").join(lower.select(F.col("node").alias("r"), F.col("root").alias("further")).alias("y"), F.col("x.root") == F.col("y.r"), "left")
        after = kept(short.select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "old"), "families")
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    members = labels.groupBy("root").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "\n"), 256).alias("family_id"))
    return labels.join(members, "root").select("node", "root", "family_id")


def split_bucket(family: Column, seed: str) -> Column:
    """dev below 0.6, validation below 0.8, else test, of the first eight digest bytes as a fraction."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), family), 256), 1, 16)
    return F.when(digits < "999999999999999a", "dev").when(digits < "cccccccccccccccd", "validation").otherwise("test")


def isolation_risks(rows: DataFrame) -> DataFrame:
    """(kind, key, members): one id with several bodies, one body under several ids. rows: item_id, body_hash."""
    by_id = rows.groupBy(F.col("item_id").alias("key")).agg(F.array_sort(F.collect_set("body_hash")).alias("members")).where("size(members) > 1").select(F.lit("same_id").alias("kind"), "key", "members")
    by_body = rows.groupBy(F.col("body_hash").alias("key")).agg(F.array_sort(F.collect_set("item_id")).alias("members")).where("size(members) > 1").select(F.lit("same_body").alias("kind"), "key", "members")
    return by_id.unionByName(by_body)


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """Counts and rates of (expected, predicted) in duplicate / distinct / boundary; boundary gold doesn't count."""
    known = pairs.where("expected in ('duplicate', 'distinct')")
    count = lambda e, p: F.sum((F.expr(e) & F.expr(p)).cast("long"))
    dup, say = "expected = 'duplicate'", "predicted = 'duplicate'"
    one = known.agg(count(dup, say).alias("tp"), count(f"not ({dup})", say).alias("fp"), count(dup, f"not ({say})").alias("fn"), count(f"not ({dup})", f"not ({say})").alias("tn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return one.select("tp", "fp", "fn", "tn", rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"))


def strict_metrics(replay: DataFrame) -> DataFrame:
    """n_output: rows that name duplicates; n_strict: those naming only true ones; n_any: those naming at least one; n_gold: rows with true ones."""
    d, g = F.col("predicted_ids"), F.col("expected_ids")
    some = F.size(d) > 0
    return replay.agg(
        F.sum(some.cast("long")).alias("n_output"),
        F.sum((some & (F.size(F.array_except(d, g)) == 0)).cast("long")).alias("n_strict"),
        F.sum((some & F.arrays_overlap(d, g)).cast("long")).alias("n_any"),
        F.sum((F.size(g) > 0).cast("long")).alias("n_gold"),
    )


def clopper_pearson_lower(x: int, n: int, alpha: float = 0.05) -> float:
    """One-sided lower bound of a proportion: the p at which x or more of n have probability ``alpha``; 0 without successes."""
    import math

    if x <= 0 or n <= 0:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(x, n + 1)]

    def tail(p: float) -> float:
        return sum(math.exp(c + k * math.log(p) + (n - k) * math.log1p(-p)) if p < 1 else float(k == n) for k, c in zip(range(x, n + 1), logs, strict=True))

    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) < alpha else (low, mid)
    return (low + high) / 2


def recall_at(truth: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(n_queries, n_hit, recall): queries with a true candidate (query_id, cand_id) among their first k (query_id, cand_id, rank)."""
    hits = truth.join(ranked.where(F.col("rank") <= k), ["query_id", "cand_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    per = truth.select("query_id").distinct().join(hits, "query_id", "left")
    one = per.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"))
    return one.select("n_queries", "n_hit", F.when(F.col("n_queries") > 0, F.col("n_hit") / F.col("n_queries")).otherwise(0.0).alias("recall"))


def member_audit(known: DataFrame, members: DataFrame) -> DataFrame:
    """Each named member as correct, known_wrong, unknown or illegal. known: (query_id, member_id, label); members: (query_id,
    member_id, query_seq, member_seq)."""
    kind = F.when(F.col("member_seq") >= F.col("query_seq"), "illegal").when(F.col("label") == "duplicate", "correct").when(F.col("label") == "distinct", "known_wrong").otherwise("unknown")
    return members.join(known, ["query_id", "member_id"], "left").select("query_id", "member_id", kind.alias("kind"))


def stratified(rows: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """A share of each stratum, at least one row: those whose digests come first, so that the choice is fixed by the seed."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    ranked = rows.withColumn("place", F.row_number().over(order)).withColumn("size", F.count("*").over(Window.partitionBy(stratum)))
    return ranked.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("size") * share + 0.5))).drop("place", "size")


def materials(sheets: list[DataFrame]) -> DataFrame:
    """One catalogue of several sheets (item_id, body, origin): bodies that are the same bytes count once, under their smallest origin."""
    rows = sheets[0]
    for s in sheets[1:]:
        rows = rows.unionByName(s)
    rows = rows.withColumn("body_hash", F.sha2("body", 256))
    return rows.groupBy("item_id", "body_hash").agg(F.min("origin").alias("origin"), F.count("*").alias("n_copies"))


def review_problems(reviews: DataFrame) -> DataFrame:
    """(pair_id, problem) of review rows (pair_id, annotator, label, has_evidence, at, reviewed_at): a pair takes two annotators,
    a label of each with evidence, and reviews that don't come before the annotation."""
    one = reviews.groupBy("pair_id").agg(F.count_distinct("annotator").alias("n"), F.bool_and("has_evidence").alias("evidence"), F.count_distinct("label").alias("labels"), F.bool_and(F.col("reviewed_at") >= F.col("at")).alias("ordered"))
    problem = F.when(F.col("n") < 2, "ONE_ANNOTATOR").when(~F.col("evidence"), "EVIDENCE_MISSING").when(~F.col("ordered"), "TIME_ORDER").when(F.col("labels") > 1, "DISAGREEMENT")
    return one.select("pair_id", problem.alias("problem"))
