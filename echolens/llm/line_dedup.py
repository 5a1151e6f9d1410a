"""Line deduplication by a log-template tree, with built-in functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its first DEPTH tokens, where a token with a digit is
a variable field (``<*>``). In the leaf, the rest of the line is compared token by token: a token is a constant of the leaf if
LEAST documents or more have it at that place, and else a variable field. What is left is the line's template. It recurs if it
stands in LEAST documents or more and if constants are at least three fifths of its tokens, so lines that merely begin alike
are not one template. Documents are counted as distinct texts: exact copies count once.

All lines of recurring templates go, in every document, but for one case: a document of which they are nine tenths of the words or
more is itself a copy or near copy of others. It is kept whole and left to the stages that look for copies, which keep one of
a group; to drop its lines would lose the text in all of them.

Tokens stand between ASCII white space; blank lines have none and stay. Null text has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, row_key, table

DEPTH = 4
#: Distinct texts that make a template recur, and a token a constant.
LEAST = 10
FIELD = "<*>"


def lines_of(text: Column) -> Column:
    """Lines with every run of other white space as spaces, so that tokens are what stands between spaces."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), "\t\x0b\x0c\r", "    "), "\n", -1)


def tokens_of(line: Column) -> Column:
    parts = F.split(line, " ", -1)
    return F.filter(parts, lambda t: t != "")


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _branch(tokens: Column, depth: int) -> Column:
    """(n, leaf): the number of tokens and, as a hash, the leaf that they lead to."""
    n = F.size(tokens)
    return F.struct(n.alias("n"), F.xxhash64(n, F.array_join(F.transform(F.slice(tokens, 1, depth), masked), " ")).alias("leaf"))


def recurring(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, tag: str = "lines") -> DataFrame:
    """(doc_id, k, n_lines, drop): for every row of ``docs`` (doc_id, text) the places of its lines that go.

    Rows are told apart by k, 128 bits of id and text; repeated rows count once and get the same result. An empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "text", row_key("doc_id").alias("k"))
    branches = F.transform(lines_of(F.col("text")), lambda x: _branch(tokens_of(x), depth))
    rows = keyed.select("doc_id", "k", F.xxhash64(text).alias("same"), F.when(text == "", F.array().cast("array<struct<n:int,leaf:bigint>>")).otherwise(branches).alias("b"))
    rows = materialize(rows, f"{tag}-rows")
    lines = rows.select("k", "same", F.posexplode("b").alias("at", "x")).select("k", "same", "at", "x.n", "x.leaf").where("n > 0")
    # a leaf that few texts reach has no recurring template: only the others' lines are read token by token
    common = lines.groupBy("leaf", "same").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") >= least).select("leaf")
    common = materialize(common, f"{tag}-common")
    # tables of their own: the joins' exchanges then stand alone, and adaptive execution can split a leaf that is everywhere
    reached = materialize(lines.join(common, "leaf").select("k", "same", "at", "n", "leaf"), f"{tag}-reached")
    places = reached.where(F.col("n") > 0).groupBy("k").agg(F.collect_list(F.struct("at", "leaf", "same")).alias("asked"))
    got = keyed.select("k", "text").join(places, "k").dropDuplicates(["k"])
    fetched = got.select("k", F.transform("asked", lambda a: F.struct(a["at"].alias("at"), a["leaf"].alias("leaf"), a["same"].alias("same"), F.lit(0).alias("zero"))).alias("asked"), lines_of(F.col("text")).alias("l"))
    # split once for each row: a lambda's argument is bound, a plain column would be split again for every line
    fetched = fetched.select("k", F.explode(F.get(F.transform(F.array("l"), lambda l: F.transform("asked", lambda a: F.struct(a["at"].alias("at"), a["leaf"].alias("leaf"), a["same"].alias("same"), tokens_of(F.get(l, a["at"])).alias("t")))), F.lit(0))).alias("x"))
    lead = lambda t: F.size(F.filter(F.slice(t, 1, depth), lambda w: ~w.rlike("[0-9]")))
    seen = fetched.select("k", "x.at", "x.leaf", "x.same", F.size("x.t").alias("n"), lead(F.col("x.t")).alias("led"), F.slice("x.t", depth + 1, 1 << 30).alias("rest"))
    seen = materialize(seen, f"{tag}-seen")
    spread = seen.select("k", "at", "leaf", "same", F.posexplode("rest").alias("place", "token")).where(~F.col("token").rlike("[0-9]"))
    constant = spread.groupBy("leaf", "place", "token", "same").agg(F.lit(1).alias("one")).groupBy("leaf", "place", "token").agg(F.count("*").alias("texts")).where(F.col("texts") >= least).select("leaf", "place", "token")
    constant = materialize(constant, f"{tag}-constant")
    fixed = spread.join(constant, ["leaf", "place", "token"]).groupBy("k", "at").agg(F.count("*").alias("fixed"), F.bit_xor(F.xxhash64("place", "token")).alias("shape"))
    fixed = materialize(fixed, f"{tag}-fixed")
    shaped = seen.select("k", "at", "leaf", "same", "n", "led").join(fixed, ["k", "at"], "left")
    shaped = shaped.select("k", "at", "n", "same", (F.col("led") + F.coalesce("fixed", F.lit(0))).alias("fixed"), F.xxhash64("leaf", F.coalesce("shape", F.lit(0))).alias("template"))
    shaped = materialize(shaped.where(F.col("fixed") * 5 >= F.col("n") * 3), f"{tag}-shaped")
    often = shaped.groupBy("template", "same").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= least).select("template")
    often = materialize(often, f"{tag}-often")
    gone = materialize(shaped.join(often, "template").select("k", "at", "n"), f"{tag}-gone")
    drop = gone.groupBy("k").agg(F.array_sort(F.collect_set("at")).alias("drop"), F.sum("n").alias("words"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    met = rows.select("doc_id", "k", F.size("b").cast("long").alias("n_lines"), total.alias("total")).join(drop, "k", "left")
    goes = F.col("words") * 10 < F.col("total") * 9
    found = materialize(met.select("doc_id", "k", "n_lines", F.when(goes, F.col("drop")).otherwise(F.array().cast("array<int>")).alias("drop")), f"{tag}-found")
    discard(rows, common, reached, seen, constant, fixed, shaped, often, gone)
    return found


def kept_text(text: Column, drop: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(drop, i)), "\n")


def without_lines(docs: DataFrame, tag: str = "lines-stage", least: int = LEAST) -> DataFrame:
    """``docs`` without the lines that recur. Every row stays, and n_chars, where there is one, follows the text.

    A document that consists of recurring lines alone is a copy in the sense above, so none loses all its text. Null and
    blank texts stay as they are; repeated rows get the same result.
    """
    k, drop = free_name(docs.columns, "k"), free_name(docs.columns, "drop")
    found = recurring(docs.select("doc_id", "text"), least=least, tag=tag).where("size(drop) > 0").select(F.col("k").alias(k), F.col("drop").alias(drop)).dropDuplicates([k])
    joined = docs.withColumn(k, row_key("doc_id")).join(found, k, "left")
    new = F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col(drop)))
    left = joined.withColumn("text", new)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every row. kept_chars and kept_sha256 are null where nothing does; null texts have no lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = recurring(docs, tag="op6")
    hit = found.where("size(drop) > 0").select("k", "drop").dropDuplicates(["k"])
    changed = docs.withColumn("k", row_key("doc_id")).join(hit, "k").dropDuplicates(["k"]).select("k", kept_text(F.col("text"), F.col("drop")).alias("kept"))
    out = found.join(changed, "k", "left")
    return out.select("doc_id", "n_lines", F.size("drop").cast("long").alias("n_dropped"), F.when(F.size("drop") > 0, F.length("kept")).cast("long").alias("kept_chars"), F.when(F.size("drop") > 0, F.sha2("kept", 256)).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS txt, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
line AS (SELECT doc_id, txt, pos, list_filter(string_split_regex(l[pos], '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS t FROM (SELECT doc_id, txt, l, unnest(range(1, len(l) + 1)) AS pos FROM d)),
leafed AS (SELECT doc_id, txt, pos, t, len(t) AS n, len(t)::VARCHAR || ':' || array_to_string(list_transform(t[1:4], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS leaf FROM line WHERE len(t) > 0),
tok AS (SELECT doc_id, txt, pos, n, leaf, i, t[i] AS w FROM (SELECT doc_id, txt, pos, t, n, leaf, unnest(range(1, n + 1)) AS i FROM leafed WHERE leaf IN (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT txt) >= 10))),
fixed AS (SELECT leaf, i, w FROM tok WHERE NOT regexp_matches(w, '[0-9]') AND i > 4 GROUP BY leaf, i, w HAVING count(DISTINCT txt) >= 10),
shaped AS (SELECT tok.doc_id, tok.txt, tok.pos, tok.n, tok.leaf,
                  count(*) FILTER (WHERE NOT regexp_matches(tok.w, '[0-9]') AND (tok.i <= 4 OR fixed.w IS NOT NULL)) AS constants,
                  string_agg(coalesce(fixed.w, '<*>'), ' ' ORDER BY tok.i) AS shape
           FROM tok LEFT JOIN fixed ON tok.leaf = fixed.leaf AND tok.i = fixed.i AND tok.w = fixed.w GROUP BY tok.doc_id, tok.txt, tok.pos, tok.n, tok.leaf),
sure AS (SELECT * FROM shaped WHERE constants * 5 >= n * 3),
often AS (SELECT leaf, shape FROM sure GROUP BY leaf, shape HAVING count(DISTINCT txt) >= 10),
hit AS (SELECT doc_id, pos, n FROM sure JOIN often USING (leaf, shape)),
share AS (SELECT doc_id, sum(n) AS gone FROM hit GROUP BY doc_id),
size AS (SELECT doc_id, sum(n) AS total FROM leafed GROUP BY doc_id),
r AS (SELECT hit.doc_id, pos FROM hit JOIN share USING (doc_id) JOIN size USING (doc_id) WHERE gone * 10 < total * 9),
e AS (SELECT doc_id, pos, l[pos] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM d)),
k AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.pos) FILTER (WHERE r.pos IS NULL) AS kept, count(r.pos) AS n_dropped FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.pos = r.pos GROUP BY e.doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN n_dropped > 0 THEN length(coalesce(kept, ''))::BIGINT END AS kept_chars,
       CASE WHEN n_dropped > 0 THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
