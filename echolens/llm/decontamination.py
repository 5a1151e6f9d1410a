"""Benchmark decontamination by a distributed positional inverted index.

Built-in functions only. For each window of a benchmark item the rarest terms (by benchmark frequency, then length) are
its list terms; one pass over the corpus stores the postings (document, position) of just these terms. A posting of a term
at item place i and document place p lies on the alignment p - i: postings adjusted by their offsets are intersected by
grouping them on (document, item, alignment), and an alignment goes on if the two rarest lists of some window, by corpus
frequency, meet there. Words are compared on the alignments that are left, which gives exact phrases, all of them, and, where at
least ``near`` words of a window agree, proximity matches; a passage of which one of those two words is changed is no match.

A window that an item repeats stands in the index once, so an item of a few words over and over has few places.
Rows are told apart by 128 bits of id and text, so repeated rows and shared ids keep their own results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, free_name, materialize, row_key, table

GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 8
#: Words of a window that agree in a proximity match.
NEAR = 6
#: List terms that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def windows_of_items(benchmark: DataFrame, window: int = WINDOW, lists: int = 3) -> DataFrame:
    """(item, item_id, iw, len, wins): an item's words, its window length, and its distinct windows as (s, req): where each
    first stands, and the places of its rarest terms."""
    items = benchmark.select(row_key("item_id").alias("item"), F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("iw")).where("size(iw) > 0 and item_id is not null").dropDuplicates(["item"])
    items = items.withColumn("len", F.least(F.size("iw"), F.lit(window)))
    places = items.select("item", F.posexplode("iw").alias("place", "term"))
    often = places.groupBy("term").agg(F.count("*").alias("often"))
    ranks = places.join(often, "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("place", "often", (-F.length("term")).alias("brief")))).alias("r"))
    starts = items.select("item", "iw", "len", F.explode(F.sequence(F.lit(0), F.size("iw") - F.col("len"))).alias("s"))
    fresh = starts.select("item", "s", F.array_join(F.slice("iw", F.col("s") + 1, F.col("len")), " ").alias("what")).groupBy("item", "what").agg(F.min("s").alias("s")).groupBy("item").agg(F.sort_array(F.collect_list("s")).alias("fresh"))
    rarest = lambda s: F.transform(F.slice(F.sort_array(F.transform(F.slice("r", s + 1, F.col("len")), lambda x: F.struct(x["often"].alias("often"), x["brief"].alias("brief"), x["place"].alias("place")))), 1, lists), lambda x: x["place"])
    return items.join(ranks, "item").join(fresh, "item").select("item", "item_id", "iw", "len", F.transform("fresh", lambda s: F.struct(s.alias("s"), rarest(s).alias("req"))).alias("wins"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR, tag: str = "decontam") -> DataFrame:
    """(doc_id, k, n_words, n_hit, items, near_items) for every row of ``docs`` (doc_id, text).

    n_hit: words inside any occurrence of a window; items: sorted ids (strings) of items with occurring windows; near_items:
    those with a window of which ``near`` words or more, but not all, are in place. Null texts have no words; items without words or id take
    no part; an item shorter than ``window`` is one window. An empty benchmark gives no hits, an empty table no rows.
    """
    items = materialize(windows_of_items(benchmark, window), f"{tag}-items")
    lists = items.select("item", "iw", F.explode(F.array_distinct(F.flatten("wins.req"))).alias("place")).select("item", "place", F.get("iw", F.col("place")).alias("term"))
    end = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    wanted = lists.select("term").distinct().unionByName(end)
    if (items.agg(F.sum(F.size("iw")).alias("n")).first()["n"] or 0) <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    keyed = docs.select("doc_id", "text", row_key("doc_id").alias("k"))
    # the empty term stands at the end of each row and so gives the number of words
    spread = keyed.select("doc_id", "k", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "term"))
    index = materialize(spread.join(wanted, "term").select("k", "doc_id", "pos", "term"), f"{tag}-index")
    postings = index.where("term <> ''").select("k", "pos", "term")
    corpus = postings.groupBy("term").agg(F.count("*").alias("often"))
    weights = lists.join(corpus, "term").groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("place", "often"))).alias("often"))
    # a window with a term that the corpus lacks doesn't occur; of the others the two rarest lists are intersected
    alive = F.filter("wins", lambda w: F.forall(w["req"], lambda p: F.map_contains_key("often", p)))
    two = lambda r: F.transform(F.slice(F.sort_array(F.transform(r, lambda p: F.struct(F.element_at("often", p).alias("often"), p.alias("place")))), 1, 2), lambda x: x["place"])
    pairs = items.join(weights, "item").select("item", "iw", F.explode(F.transform(alive, lambda w: F.struct(w["s"].alias("s"), two(w["req"]).alias("pair")))).alias("w"))
    pairs = pairs.select("item", "iw", F.struct(F.col("w.s").alias("s"), F.col("w.pair").alias("pair")).alias("w"), F.explode(F.array_distinct("w.pair")).alias("place"))
    starts = materialize(pairs.groupBy("item", "place", F.get("iw", F.col("place")).alias("term")).agg(F.collect_list("w").alias("ws")), f"{tag}-starts")
    aligned = postings.join(starts.drop("ws"), "term").groupBy("k", "item", (F.col("pos") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("met"))
    # each place names the windows that it is one of the two of, so a met alignment looks at these alone
    of_item = starts.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("place", "ws"))).alias("of"))
    asked = F.array_distinct(F.flatten(F.transform("met", lambda p: F.element_at("of", p))))
    whole = F.transform(F.filter(asked, lambda w: F.size(F.array_except(w["pair"], F.col("met"))) == 0), lambda w: w["s"])
    meetings = aligned.join(of_item, "item").select("k", "item", "shift", F.array_sort(whole).alias("at")).where("size(at) > 0")
    low = F.get("at", F.lit(0))
    cut = meetings.join(items.select("item", "item_id", "iw", "len"), "item").select("k", F.struct("item_id", (F.col("shift") + low).alias("shift"), "len", F.slice("iw", low + 1, F.array_max("at") - low + F.col("len")).alias("iw")).alias("case"))
    cases = cut.groupBy("k").agg(F.collect_list("case").alias("cases"))
    text = keyed.select("k", "text").join(cases, "k").dropDuplicates(["k"])

    def compare(w: Column, c: Column) -> Column:
        agree = F.transform(c["iw"], lambda t, i: F.coalesce(F.get(w, c["shift"] + i) == t, F.lit(False)).cast("int"))
        return F.struct(c["item_id"].alias("item_id"), c["shift"].alias("shift"), c["len"].alias("len"), agree.alias("agree"))

    def agreement(c: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(c["agree"]) - c["len"]), lambda s: F.aggregate(F.slice(c["agree"], s + 1, c["len"]), F.lit(0), lambda x, y: x + y))
        return F.struct(c["item_id"].alias("item_id"), c["shift"].alias("shift"), c["len"].alias("len"), full.alias("sums"))

    # the words are bound as a lambda's argument: a plain column would be split again for every word compared
    lined_up = F.get(F.transform(F.array(words(F.col("text"))), lambda w: F.transform("cases", lambda c: compare(w, c))), F.lit(0))
    compared = text.select("k", F.transform(lined_up, agreement).alias("c"))
    exact = F.filter("c", lambda x: F.array_max(x["sums"]) == x["len"])
    close = F.filter("c", lambda x: F.exists(x["sums"], lambda s: (s >= near) & (s < x["len"])))
    hit = F.flatten(F.transform("c", lambda x: F.flatten(F.transform(x["sums"], lambda s, i: F.when(s == x["len"], F.sequence(x["shift"] + i, x["shift"] + i + x["len"] - 1)).otherwise(F.array().cast("array<int>"))))))
    found = compared.select("k", F.size(F.array_distinct(hit)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.transform(exact, lambda x: x["item_id"]))).alias("items"), F.array_sort(F.array_distinct(F.transform(close, lambda x: x["item_id"]))).alias("near_items"))
    found = materialize(found, f"{tag}-found")
    rows = materialize(index.where("term = ''").select("doc_id", "k", F.col("pos").cast("long").alias("n_words")), f"{tag}-words")
    discard(items, index, starts)
    none = F.array().cast("array<string>")
    return rows.join(found, "k", "left").select("doc_id", "k", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's hits; null texts have no words, and repeated rows each get theirs."""
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), tag="op7")
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, list_slice(w, s, s + least(8, len(w)) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, s, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def without_leaks(docs: DataFrame, benchmark: DataFrame, tag: str = "decontam-stage") -> DataFrame:
    """``docs`` without those that hold a whole window of WINDOW benchmark words, or windows of two items or more.

    Null and empty texts stay; repeated rows stay or go together.
    """
    found = matches(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), tag=tag)
    k = free_name(docs.columns, "k")
    leaking = found.where((F.size("items") >= 2) | ((F.size("items") >= 1) & (F.col("n_hit") >= WINDOW))).select(F.col("k").alias(k)).distinct()
    return docs.withColumn(k, row_key("doc_id")).join(leaking, k, "left_anti").select(*docs.columns)
