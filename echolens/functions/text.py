"""Text functions as column expressions: normalisation, hashes, shingles, segments, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``str.isspace`` and ``\s`` of most engines agree on for blank checks of this data model.
BLANK = "^[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{001C}-\\x{001F}]*$"
#: One code point at each start, three in all; the second look-ahead keeps a start out of a surrogate pair.
_TRIGRAM = "(?s)(?=(...))(?![\\x{DC00}-\\x{DFFF}])"
_TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"
#: Entity patterns: fixed values.
EIA = "(?i)(?<![A-Za-z0-9])EIA(?![A-Za-z0-9])"
EIA_FULL = "美国能源信息署"
CODE = "(?i)(?:证券|股票)?代码[\\s:：]*([0-9]{6}(?:\\.(?:SH|SZ))?)(?![0-9A-Za-z])"
ORGANIZATION = "[\\x{4e00}-\\x{9fff}A-Za-z]{1,20}?(?:股份有限公司|有限公司|公司|集团|银行|证券)"
CLAUSE = "[^。！？!?；;\\n]+[。！？!?；;]?"


def normalized(text: Column, outer_trim: bool = False) -> Column:
    """CRLF becomes LF; with ``outer_trim`` blanks, tabs and newlines at both ends go, unless nothing else is there."""
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    if not outer_trim:
        return lf
    bare = F.regexp_replace(lf, "^[ \t\n]+|[ \t\n]+$", "")
    return F.when(bare == "", lf).otherwise(bare)


def indexable(text: Column) -> Column:
    return F.coalesce(~normalized(text).rlike(BLANK), F.lit(False))


def raw_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def record_id(scope: Column, item: Column) -> Column:
    """Digest of the compact JSON list of scope and item, escaped as JSON asks."""
    return F.sha2(F.to_json(F.array(scope, item)), 256)


def bucket_key(scope: Column, date: Column, version: Column, kind: Column, digest: Column) -> Column:
    return F.concat_ws("/", scope, date.cast("string"), version, kind, digest)


def bucket_parts(key: Column) -> Column:
    """Five parts, or null."""
    parts = F.split(key, "/", -1)
    return F.when((F.size(parts) == 5) & ~F.exists(parts, lambda p: p == ""), parts)


def certificate(left: Column, right: Column, least: int = 0) -> Column:
    """EXACT, LOSSLESS or null; ``least``: normalised code points that both need."""
    long = (F.length(normalized(left)) >= least) & (F.length(normalized(right)) >= least) & indexable(left) & indexable(right)
    return F.when(long & (left == right), "EXACT").when(long & (normalized(left) == normalized(right)), "LOSSLESS")


def shingles(text: Column) -> Column:
    """Distinct code-point trigrams; a shorter text is its own shingle, an empty one has none."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_TRIGRAM), F.lit(1)))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) < 3, F.array(text)).otherwise(found)


def tokens(text: Column) -> Column:
    """Distinct word tokens and single symbols."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))


def word_tokens(text: Column) -> Column:
    """Lower-cased words, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def segments(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Overlapping pieces; the last one ends with the text."""
    step = size - overlap
    count = F.when(F.length(text) <= size, 1).otherwise(F.ceil((F.length(text) - size) / step).cast("int") + 1)
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def entities(text: Column) -> Column:
    """Sorted distinct entity ids of the explicit cues in a text."""
    some = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    named = F.transform(F.concat(some(EIA, 0), some(EIA_FULL, 0)), lambda _: F.lit("entity_v1|org:美国能源信息署"))
    codes = F.transform(some(CODE, 1), lambda c: F.concat(F.lit("entity_v1|code:"), F.upper(c)))
    orgs = F.transform(some(ORGANIZATION, 0), lambda o: F.concat(F.lit("entity_v1|org:"), o))
    return F.array_sort(F.array_distinct(F.concat(named, codes, orgs)))


def clauses(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0)), lambda c: ~c.rlike(BLANK))


def quote_holds(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """The evidence check: code points start to end of the text are the quote."""
    return (start >= 0) & (end > start) & (F.substring(text, start + 1, end - start) == quote)


def fuzzy_contains(text: Column, quote: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, "\\s+", "")
    return (F.length(bare(quote)) > 0) & (F.contains(text, quote) | F.contains(bare(text), bare(quote)))
