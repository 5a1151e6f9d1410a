"""Secret scans: base patterns and multipart credential linking, with built-in functions only.

Base kinds (assign, access, hex) are reported on their own. Weaker parts are gathered too: access identifiers, secret-like
strings and endpoints. A weak part is reported only when complementary parts stand in its scope: an identifier, a secret
and an endpoint within SCOPE characters of the secret. Parts are intervals, and what counts is the gap between them; the join
runs on buckets of SCOPE characters, a part standing in each from its start to its end. In a bucket each kind is first reduced
to its outermost ends, so it is an equi-join whose size is that of the parts even in a document that holds a hundred thousand
of them. Places are running sums over a text's matches, so a text of many matches takes time in proportion to them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, table

#: Kinds in the order in which spans that start together are listed: pattern, group to measure, least length.
BASE = {
    "assign": (r"((?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak parts: what each may be part of, and its pattern.
WEAK = {
    "identifier": r"(?:(?i)user|username|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}",
    "weak_secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}",
    "endpoint": r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[A-Za-z0-9.:@/_?&=%~+-]+|(?:(?i)host|endpoint|server)\x20*[:=]\x20*[A-Za-z0-9.-]{3,}",
}
SCOPE = 300
#: What a text must hold for a kind to match at all, tried before the pattern: substrings of which one is enough.
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "hex": ()}
KINDS = [*BASE, *WEAK]


def has_one(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(x)) for x in needles], F.lit(not needles))


def pieces(text: Column, pattern: str, group: int, least: int, gate: Column) -> Column:
    """All matches, left to right without overlap: (gap, size, long) in code points, gap being what lies between a match and the one before.

    long: whether ``group`` of the match has ``least`` characters or more. gate: a cheap condition that every text with a match meets.
    """
    empty = F.array().cast("array<struct<gap:int,size:int,long:boolean>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long = lambda w: (F.length(F.regexp_extract(w, pattern, group)) if group else F.length(w)) >= least
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size"), long(w).alias("long")))
    return F.when(gate & text.rlike(pattern), pairs).otherwise(empty)


def parts(docs: DataFrame, tag: str = "secrets") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``docs`` (doc_id, text) as (doc_id, k), and all matches that are long enough as (k, start, rank, end).

    rank is the kind's place in KINDS. Repeated rows share their spans.
    """
    text = F.coalesce("text", F.lit(""))
    # weak parts count together only: without an identifier and an endpoint there is nothing to link
    whole = has_one(text, (":", "=")) & text.rlike(WEAK["endpoint"]) & (text.rlike(WEAK["identifier"]) | has_one(text, ("AKIA",)))
    kinds = [pieces(text, pattern, group, least, has_one(text, NEEDS[kind])) for kind, (pattern, group, least) in BASE.items()]
    kinds += [pieces(text, pattern, 0, 0, whole) for pattern in WEAK.values()]
    rows = docs.select("doc_id", row_key("doc_id").alias("k"), F.array(*kinds).alias("kinds"))
    rows = materialize(rows.select("doc_id", "k", F.when(F.exists("kinds", lambda x: F.size(x) > 0), F.col("kinds")).alias("kinds")), f"{tag}-rows")
    each = rows.where("kinds is not null").dropDuplicates(["k"]).select("k", F.posexplode("kinds").alias("rank", "found")).select("k", "rank", F.posexplode("found").alias("nth", "m"))
    # gaps and matches follow each other, so their running sizes are the places
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("k", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = each.withColumn("end", end).where("m.long").select("k", (F.col("end") - F.col("m.size")).alias("start"), "rank", "end")
    return rows.select("doc_id", "k"), spans


def scan(docs: DataFrame, tag: str = "secrets", scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, linked) for every row of ``docs`` (doc_id, text); arrays of (start, rank, end), sorted.

    base: spans of the BASE kinds. linked: weak parts that complete each other within ``scope`` characters and overlap no
    base span. A base assign or hex span counts as a secret and an access span as an identifier. Null text is empty. Rows
    are told apart by 128 bits of id and text, so repeated rows all get their own results. An empty table gives none.
    """
    rows, spans = parts(docs, tag)
    spans = materialize(spans, f"{tag}-spans")
    base, weak = F.col("rank") < len(BASE), F.col("rank") >= len(BASE)
    role = F.when(F.col("rank").isin(KINDS.index("access"), KINDS.index("identifier")), "identifier").when(F.col("rank") == KINDS.index("endpoint"), "endpoint").otherwise("secret")
    each = spans.join(spans.where(weak).select("k").distinct(), "k", "left_semi").select("k", "start", "rank", "end", role.alias("role"))
    # a part stands in every bucket from its start to its end
    placed = each.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))

    def around(some: DataFrame, *names: str) -> DataFrame:
        """The outermost ends in a bucket, seen from the bucket itself and from both neighbours; for a gap from there no more is needed."""
        ends = some.groupBy("k", "bucket", *names).agg(F.min("start").alias("low"), F.max("end").alias("high"))
        return ends.select("k", *names, "low", "high", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))

    close = (F.col("low") - F.col("end") <= scope) & (F.col("start") - F.col("high") <= scope)
    near = around(placed.where("role <> 'secret'"), "role").withColumnRenamed("role", "other")
    met = placed.where("role = 'secret'").join(near, ["k", "bucket"]).where(close)
    centres = met.groupBy("k", "start", "rank", "end").agg(F.countDistinct("other").alias("n")).where("n = 2").drop("n")
    # every part within the scope of a complete secret is reported: weak ones only
    reach = around(placed.join(centres, ["k", "start", "rank", "end"], "left_semi"))
    linked = materialize(placed.where(weak).join(reach, ["k", "bucket"]).where(close).select("k", "start", "rank", "end").distinct(), f"{tag}-linked")
    # of the base spans of a text, the furthest end so far and the nearest start ahead tell whether one overlaps
    both = spans.where(base).unionByName(linked)
    before = Window.partitionBy("k").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("k").orderBy(F.col("start").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("far", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    # spans that start together: a base one is among those ahead of a weak one or behind it, so both sides are asked
    free = base | ((F.coalesce("far", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    lists = held.where(free).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("all"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    pick = lambda weak_ones: F.coalesce(F.filter("all", lambda m: (m["rank"] >= len(BASE)) == F.lit(weak_ones)), none)
    return rows.join(lists, "k", "left").select("doc_id", pick(False).alias("base"), pick(True).alias("linked"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda m: F.concat_ws(":", F.get(names, m["rank"]), m["start"], m["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's spans; a null text has none, and repeated rows each get theirs."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), tag="op8")
    count = lambda kind: F.size(F.filter("base", lambda m: m["rank"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "linked")).alias("spans"))
