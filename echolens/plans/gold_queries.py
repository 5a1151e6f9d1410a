"""Queries over evaluation: families, splits, frozen sets and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold, recall
from ..sources import tables as S
from .recall_queries import _HASH
from .registry import ITEMS, query


def family_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents are tied to the smallest with the same text, and to the smallest with the same first 40 code points."""
    items = S.items(spark, d)
    first = items.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("item_id").alias("b"))
    edges = items.select(F.col("item_id").alias("a"), F.sha2("text", 256).alias("h")).join(first, "h").select("a", "b")
    head = items.groupBy(F.substring("text", 1, 40).alias("h")).agg(F.min("item_id").alias("b"))
    more = items.select(F.col("item_id").alias("a"), F.substring("text", 1, 40).alias("h")).join(head, "h").select("a", "b")
    return items.select(F.col("item_id").alias("node")), edges.unionByName(more)


@query("WITH RECURSIVE e AS (SELECT a.doc_id::VARCHAR AS x, b.doc_id::VARCHAR AS y FROM documents a JOIN documents b ON a.text = b.text OR a.text[1:40] = b.text[1:40]), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), roots AS (SELECT x AS node, min(y) AS root FROM r GROUP BY 1), fam AS (SELECT root, sha256(string_agg(node, chr(10) ORDER BY node)) AS family_id FROM roots GROUP BY 1) SELECT node, root, family_id FROM roots JOIN fam USING (root)")
def family_components(spark: SparkSession, d: str) -> DataFrame:
    return gold.families(*family_edges(spark, d))


@query("SELECT doc_id::VARCHAR AS item_id, CASE WHEN h < '999999999999999a' THEN 'dev' WHEN h < 'cccccccccccccccd' THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, substr(sha256('v1:' || sha256(doc_id::VARCHAR)), 1, 16) AS h FROM documents)")
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    return S.items(spark, d).select("item_id", gold.split_bucket(F.sha2("item_id", 256), "v1").alias("split"))


RISKS = [("a", "h1"), ("a", "h2"), ("b", "h2"), ("c", "h3"), ("c", "h3")]


@query(S.values({"kind": "string", "key": "string", "members": "string"}, [("same_id", "a", "h1,h2"), ("same_body", "h2", "a,b")], duck=True))
def isolation_risks(spark: SparkSession, d: str) -> DataFrame:
    rows = gold.isolation_risks(S.literal(spark, {"item_id": "string", "body_hash": "string"}, RISKS))
    return rows.select("kind", "key", F.array_join("members", ",").alias("members"))


_GOLD = _HASH + """, pred AS (SELECT query_id, count(*) AS n FROM hash_hits GROUP BY 1),
lab AS (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'boundary' WHEN l.quality = 0 THEN 'duplicate' ELSE 'distinct' END AS expected, CASE WHEN p.n IS NULL THEN 'distinct' ELSE 'duplicate' END AS predicted FROM documents d LEFT JOIN labels l USING (doc_id) JOIN items i ON i.item_id = d.doc_id::VARCHAR LEFT JOIN pred p ON p.query_id = i.record_id)"""


@query(f"WITH {_GOLD}, c AS (SELECT count(*) FILTER (WHERE expected = 'duplicate' AND predicted = 'duplicate') AS tp, count(*) FILTER (WHERE expected = 'distinct' AND predicted = 'duplicate') AS fp, count(*) FILTER (WHERE expected = 'duplicate' AND predicted = 'distinct') AS fn, count(*) FILTER (WHERE expected = 'distinct' AND predicted = 'distinct') AS tn FROM lab) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c")
def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a toy gold set: low quality stands for duplicate, no label for boundary; hash hits are the prediction."""
    hit = recall.hash_channel(S.items(spark, d)).select(F.col("query_id").alias("record_id")).distinct().withColumn("predicted", F.lit("duplicate"))
    labels = S.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("item_id"), "quality")
    rows = S.items(spark, d).join(labels, "item_id", "left").join(hit, "record_id", "left")
    expected = F.when(F.col("quality").isNull(), "boundary").when(F.col("quality") == 0, "duplicate").otherwise("distinct")
    return gold.pair_metrics(rows.select(expected.alias("expected"), F.coalesce("predicted", F.lit("distinct")).alias("predicted")))


REPLAY = [("q1", ["a"], ["a", "b"]), ("q2", ["a", "x"], ["a"]), ("q3", [], ["c"]), ("q4", ["z"], []), ("q5", [], [])]


@query(S.values({"n_output": "long", "n_strict": "long", "n_any": "long", "n_gold": "long"}, [(3, 1, 2, 3)], duck=True))
def strict_metrics(spark: SparkSession, d: str) -> DataFrame:
    return gold.strict_metrics(S.literal(spark, {"query_id": "string", "predicted_ids": "array<string>", "expected_ids": "array<string>"}, REPLAY))


@query(S.values({"x": "int", "n": "int", "lower": "double"}, [(9, 10, 0.60583669756), (0, 10, 0.0), (0, 0, 0.0), (389, 389, 0.99232846)], duck=True).replace("CAST(lower AS DOUBLE)", "round(CAST(lower AS DOUBLE), 6)"))
def proportion_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    rows = [(x, n, round(gold.clopper_pearson_lower(x, n), 6)) for x, n in ((9, 10), (0, 10), (0, 0), (389, 389))]
    return S.literal(spark, {"x": "int", "n": "int", "lower": "double"}, rows)


@query(f"WITH {_HASH}, t AS (SELECT query_id, cand_id, rank FROM hash_hits), q AS (SELECT query_id, max((rank <= 1)::INT) AS hit FROM t GROUP BY 1) SELECT count(*)::BIGINT AS n_queries, sum(hit)::BIGINT AS n_hit, sum(hit) / count(*) AS recall FROM q")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    hits = recall.hash_channel(S.items(spark, d))
    return gold.recall_at(hits.select("query_id", "cand_id"), hits.select("query_id", "cand_id", "rank"), 1)


KNOWN = [("q", "m1", "duplicate"), ("q", "m2", "distinct")]
MEMBERS = [("q", "m1", 10, 3), ("q", "m2", 10, 4), ("q", "m3", 10, 5), ("q", "m4", 10, 12)]


@query(S.values({"query_id": "string", "member_id": "string", "kind": "string"}, [("q", "m1", "correct"), ("q", "m2", "known_wrong"), ("q", "m3", "unknown"), ("q", "m4", "illegal")], duck=True))
def member_audit(spark: SparkSession, d: str) -> DataFrame:
    known = S.literal(spark, {"query_id": "string", "member_id": "string", "label": "string"}, KNOWN)
    members = S.literal(spark, {"query_id": "string", "member_id": "string", "query_seq": "long", "member_seq": "long"}, MEMBERS)
    return gold.member_audit(known, members)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('v1:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k <= greatest(1, floor(n * 0.1 + 0.5))")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: a tenth of each language, fixed by the seed."""
    return gold.stratified(S.table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 0.1, "v1")


@query("SELECT lang, count(*)::BIGINT AS n, quantile_disc(n_chars, 0.5)::BIGINT AS p50, quantile_disc(n_chars, 0.95)::BIGINT AS p95, quantile_disc(n_chars, 0.99)::BIGINT AS p99, max(n_chars)::BIGINT AS top, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def count_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars)").cast("long")
    return S.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max("n_chars").alias("top"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (WHERE value > 50)::BIGINT AS ok, round(count(*) FILTER (WHERE value > 50) / count(*), 9) AS rate FROM events GROUP BY 1")
def engineering_rates(spark: SparkSession, d: str) -> DataFrame:
    ok = F.sum((F.col("value") > 50).cast("long"))
    return S.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.coalesce(ok, F.lit(0)).alias("ok"), F.round(F.coalesce(ok, F.lit(0)) / F.count("*"), 9).alias("rate"))


@query("SELECT source, toxic, quality, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source", "toxic", "quality").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS n_prior FROM conversations")
def prior_sets(spark: SparkSession, d: str) -> DataFrame:
    """Earlier items of the same scope: a conversation is a scope and its turns are its arrivals."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(before).alias("n_prior"))


@query("SELECT sha256(string_agg(k || '=' || v, ';' ORDER BY k)) AS manifest_sha FROM (SELECT lang AS k, count(*)::VARCHAR AS v FROM documents GROUP BY 1)")
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of what a run read: counts by language, in order."""
    counts = S.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    line = F.array_join(F.array_sort(F.collect_list(F.concat("lang", F.lit("="), F.col("n").cast("string")))), ";")
    return counts.agg(F.sha2(line, 256).alias("manifest_sha"))


PENDING = [("b", "a"), ("a", "b"), ("c", "d")]


@query(S.values({"left_id": "string", "right_id": "string"}, [("a", "b"), ("c", "d")], duck=True))
def pending_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = S.literal(spark, {"x": "string", "y": "string"}, PENDING)
    return rows.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()


SUSPICION = [("s1", 0.8, 0.6, 2), ("s2", 0.3333, 0.1, 0)]


@query(S.values({"id": "string", "suspicion": "double"}, [("s1", 0.6), ("s2", 0.2167)], duck=True))
def suspicion_score(spark: SparkSession, d: str) -> DataFrame:
    rows = S.literal(spark, {"id": "string", "w1": "double", "w2": "double", "n_rules": "int"}, SUSPICION)
    return rows.select("id", F.round(0.5 * (F.col("w1") + F.col("w2")) - 0.05 * F.col("n_rules"), 4).alias("suspicion"))


@query(f"WITH {ITEMS} SELECT count(*)::BIGINT AS n_members, count(DISTINCT sha256(text))::BIGINT AS n_bodies, (count(*) - count(DISTINCT sha256(text)))::BIGINT AS n_excluded FROM items")
def freeze_counts(spark: SparkSession, d: str) -> DataFrame:
    body = F.count_distinct(F.sha2("text", 256))
    return S.items(spark, d).agg(F.count("*").alias("n_members"), body.alias("n_bodies"), (F.count("*") - body).alias("n_excluded"))
