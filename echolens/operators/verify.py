"""Machine checks of judgments about two texts, and the adjudication of both orders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fuzzy_contains
from ..functions.values import DIGITS, chinese_number

# Words and forms.
STAGE_WORDS = ("初值", "终值", "开盘", "收盘", "同比", "环比", "当年", "次年", "选举", "预期", "修正", "投产", "中标", "生效", "复牌", "停牌")
POLARITY = (("上涨", "下跌"), ("高于", "低于"), ("净流入", "净流出"), ("增持", "减持"), ("超预期", "不及预期"), ("走强", "走弱"), ("扩张", "收缩"), ("升值", "贬值"))
NEGATION_WORDS = ("否认", "不予", "不再", "并无", "并未", "未有", "取消", "终止", "否决")
RELATIVE_WORDS = ("今日", "昨日", "当年", "当日", "次日", "明日", "今年")
RELATIVE_SPAN = r"过去[0-9零〇一二两三四五六七八九十半]+(?:\.[0-9]+)?\s*(?:小时|天|周)"
DATE = r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*[日号]|[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*[日号]|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
ARABIC = r"[+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:%|％|万亿|万|亿|千|百)?"
CHINESE = r"[零〇一二两三四五六七八九十百千万亿]+(?:点[零〇一二两三四五六七八九]+)?%?"
SIZES = {"万亿": 10**12, "万": 10**4, "亿": 10**8, "千": 10**3, "百": 10**2}
#: Powers of ten by which a quote may be short of the text, where the text goes on with a word for them.
SHORT_BY, SIZE_WORDS = (2, 3, 4, 8), "万亿千百"
#: What makes a number a date or an ordinal: what follows, and what leads.
DATED, ORDINAL = "年月日号届版", "第"
_ARABIC, _CHINESE = re.compile(ARABIC), re.compile(CHINESE)


def amount(token: str) -> tuple[Fraction, bool] | None:
    """(value, whether it is a percentage) of a number as it stands in a text, exactly."""
    bare = re.sub(r"\s", "", token)
    percent, bare = bare.endswith(("%", "％")), bare.rstrip("%％")
    if bare[:1].isdigit() or bare[:1] in "+-":
        size = next((s for s in SIZES if bare.endswith(s)), "")
        return Fraction(Decimal(bare.removesuffix(size).replace(",", ""))) * SIZES.get(size, 1), percent
    whole, _, part = bare.partition("点")
    # 万 or 亿 without a numeral before it is what follows digits, and counts nothing
    whole = whole.lstrip("万亿")
    value = chinese_number(whole) if whole else Fraction(0)
    return None if value is None else (value + (Fraction("0." + "".join(str(DIGITS[c]) for c in part)) if part else 0), percent)


def amounts(text: str) -> Iterator[tuple[Fraction, bool, bool]]:
    """(value, percentage, whether it is a date's or an ordinal's) of all numbers of a text, in digits and written out."""
    for form in (_ARABIC, _CHINESE):
        for m in form.finditer(text):
            if (got := amount(m[0])) is not None:
                follows, leads = text[m.end() : m.end() + 1], text[: m.start()][-1:]
                yield *got, bool(follows) and follows in DATED or leads == ORDINAL


def _named(found: set[tuple[Fraction, bool]]) -> list[str]:
    return sorted(f"{v}%" if percent else str(v) for v, percent in found)


def codes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![0-9])[0-9]{6}(?![0-9])"), F.lit(0)))


def numbers(text: Column) -> Column:
    """Distinct numbers beside dates and ordinals as exact fractions, with their percent sign; separators, magnitudes and trailing
    zeros don't count. A text's numbers have no bound of digits, which no fixed decimal type holds: an Arrow pass."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_named({(v, p) for v, p, dated in amounts(t or "") if not dated}) for t in texts], dtype=object)

    return F.pandas_udf(of, "array<string>")(text)


def subject_codes(a: Column, b: Column) -> Column:
    """R1: both sides name codes and share none."""
    return (F.size(codes(a)) > 0) & (F.size(codes(b)) > 0) & ~F.arrays_overlap(codes(a), codes(b))


def time_anchors(a: Column, b: Column) -> Column:
    """R2: the times given for the two sides (arrays) differ, and one of them is a stage."""
    tidy = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda t: F.regexp_replace(t, "[\\s年月日号]", ""))))
    staged = F.exists(F.concat(a, b), lambda t: t.rlike("|".join(STAGE_WORDS)))
    return (F.size(a) > 0) & (F.size(b) > 0) & (tidy(a) != tidy(b)) & staged


def number_conflict(a: Column, b: Column) -> Column:
    """R3: either side has a number that the other lacks."""
    return (F.size(F.array_except(numbers(a), numbers(b))) > 0) & (F.size(F.array_except(numbers(b), numbers(a))) > 0)


def _grounded(quote: str, held: set[tuple[Fraction, bool]], text: str) -> bool:
    values, at = {v for v, _ in held}, text.find(quote)
    follows = text[at + len(quote) : at + len(quote) + 1] if at >= 0 else ""
    short = not follows or follows in SIZE_WORDS
    asked = {(v, p) for v, p, _ in amounts(quote)}
    return asked <= held or all(v in values or short and any(v * 10**k in values for k in SHORT_BY) for v, _ in asked)


def ungrounded(claims: Column, text: Column) -> Column:
    """R4: claims with a number that the text has neither as such, nor with another percent mark, nor as a magnitude of it that the
    text goes on with (or leaves open: the claim ends the text, or isn't in it). Claims without a number pass."""

    def of(quotes: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for some, t in zip(quotes, texts, strict=True):
            held = {(v, p) for v, p, _ in amounts(t or "")}
            out.append([q for q in (some if some is not None else []) if q and not _grounded(q, held, t or "")])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, "array<string>")(claims, text)


def bad_quotes(quotes: Column, text: Column) -> Column:
    """R5: quotes with fewer than four characters beside white space, or that the text doesn't hold."""
    return F.filter(quotes, lambda q: (F.length(F.regexp_replace(q, "\\s+", "")) < 4) | ~fuzzy_contains(text, q))


def polarity_conflict(a: Column, b: Column) -> Column:
    """R6: a pair of opposite words, one on each side."""
    hit = F.lit(False)
    for x, y in POLARITY:
        hit = hit | (F.contains(a, F.lit(x)) & F.contains(b, F.lit(y))) | (F.contains(a, F.lit(y)) & F.contains(b, F.lit(x)))
    return hit


def misquoted(quotes: Column, text: Column) -> Column:
    """R5, for quoted numbers and times: those that the text doesn't hold, of whatever length."""
    return F.filter(quotes, lambda q: ~fuzzy_contains(text, q))


def negation_asymmetry(a: Column, b: Column) -> Column:
    """The sides don't hold the same words of denial."""
    held = lambda t: [F.contains(t, F.lit(w)) for w in NEGATION_WORDS]
    differ = F.lit(False)
    for x, y in zip(held(a), held(b), strict=True):
        differ = differ | (x != y)
    return differ


def relative_time_open(a: Column, b: Column) -> Column:
    """A relative time on a side, without a date that both share: the certificate is withdrawn."""
    dates = lambda t: F.transform(F.regexp_extract_all(t, F.lit(DATE), F.lit(0)), lambda x: F.regexp_replace(x, "[\\s年月日号]", ""))
    relative = lambda t: t.rlike("|".join((*RELATIVE_WORDS, RELATIVE_SPAN)))
    return (relative(a) | relative(b)) & ~F.arrays_overlap(dates(a), dates(b))


def fired(a: Column, b: Column, evidence_a: Column, evidence_b: Column, claims_a: Column, claims_b: Column, times_a: Column, times_b: Column) -> Column:
    """Codes of the rules that a signed judgment breaks, in the order in which they are reported."""
    rules = {
        "R5": F.size(F.concat(bad_quotes(evidence_a, a), bad_quotes(evidence_b, b), misquoted(claims_a, a), misquoted(claims_b, b), misquoted(times_a, a), misquoted(times_b, b))) > 0,
        "R4": F.size(F.concat(ungrounded(claims_a, a), ungrounded(claims_b, b))) > 0,
        "R3": number_conflict(a, b),
        "R1": subject_codes(a, b),
        "R2": time_anchors(times_a, times_b),
        "R6": polarity_conflict(a, b),
    }
    return F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))


def adjudicate(orders: DataFrame) -> DataFrame:
    """Two judgments of each pair (pair_id, order, verdict, checks) to an outcome.

    Both orders duplicate and clean: equivalent. Both not_duplicate with a common axis: conflict. Anything else is open, with
    the reason of the highest priority: a missing order, a failed check, then disagreement.
    """
    clean = F.size("checks") == 0
    both = orders.groupBy("pair_id").agg(
        F.count_distinct("order").alias("n"),
        F.min(((F.col("verdict") == "duplicate") & clean).cast("int")).alias("all_duplicate"),
        F.min((F.col("verdict") == "not_duplicate").cast("int")).alias("all_distinct"),
        F.max((~clean).cast("int")).alias("failed"),
        F.min_by("axes", "order").alias("first_axes"),
        F.max_by("axes", "order").alias("last_axes"),
    )
    axes = F.array_sort(F.array_intersect("first_axes", "last_axes"))
    outcome = F.when(F.col("n") < 2, "unresolved").when(F.col("all_duplicate") == 1, "equivalent").when((F.col("all_distinct") == 1) & (F.size(axes) > 0), "conflict").otherwise("unresolved")
    code = F.when(F.col("n") < 2, "DEPENDENCY_TIMEOUT").when(outcome == "equivalent", "FACT_EQUIVALENT").when(outcome == "conflict", "VERIFIED_CONFLICT").when(F.col("failed") == 1, "EVIDENCE_INVALID").otherwise("FACT_INCOMPLETE")
    return both.select("pair_id", outcome.alias("outcome"), code.alias("code"), F.when(outcome == "conflict", axes).otherwise(F.array().cast("array<string>")).alias("axes"))
