"""Rule-based fact extraction (first rule set): one Arrow pass, text to an array of facts.

Every clause yields a fact for each event verb in it, or one fallback fact if it has none. Slots hold what the text says,
or null where nothing was found.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of the first rule set, in their order of precedence.
VERBS = (
    "收购", "回购", "增持", "减持", "中标", "签署", "获批", "退市", "上市", "停牌", "复牌", "分红", "派息", "配股", "增发", "重组", "并购", "破产", "清算", "转让", "质押",
    "发布", "披露", "公告", "公布", "预告", "涨价", "降价", "上调", "下调", "提价", "减产", "增产", "停产", "复工", "限价", "违约", "兑付", "展期", "降息", "加息", "降准",
)
PREFIXES = ("未曾", "不会", "不再", "并未", "已经", "未", "不", "无", "已", "将", "拟", "正", "取消")
NEGATIONS = ("未曾", "不会", "不再", "并未", "不曾", "无非", "未", "不", "无", "非")
MODALS = ("计划", "预计", "可能", "有望", "已", "将", "拟", "或")
STAGE_WORDS = ("开盘", "收盘", "盘中", "早盘", "尾盘", "盘前", "盘后", "午间")
COMPARATOR_WORDS = ("不低于", "不少于", "超过", "高于", "低于", "不足", ">=", "<=", "≥", "≤", "约", "近", "超", ">", "<")
METRICS = ("营业收入", "净利润", "成交额", "成交量", "营收", "市值", "股价", "价格", "产量", "销量", "产能", "利率", "股息", "分红")
SUBJECTS = re.compile(r"“([^”]{2,30})”|《([^》]{2,30})》")
COMPANY = re.compile(r"(?:^|[，,、：:；;。!?\s（(])?([一-龥A-Za-z0-9]{1,24}(?:股份有限公司|有限公司|公司|集团|银行|证券|央行))")
TIME = re.compile(r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}月[0-9]{1,2}日|(?:[0-9]{4}年)?(?:上半年|下半年|第?[一二三四]季度)|[本上下]季度|今日|昨日|前天|明天|[本上]周[一二三四五六日天]?|[本上]月")
OBJECTS = (re.compile(r"《([^》]{2,30})》|“([^”]{2,30})”"), re.compile(r"((?:本公司|公司)?(?:可转债|股票|股份|债券|合同|协议|项目|订单|产品|产能|牌照|股权|资产|批文))"), re.compile(r"(?<![0-9])([036][0-9]{5})(?![0-9])"))
NUMBER = r"[+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
QUANTITY = re.compile(rf"(?P<currency>人民币|美元|港元|欧元)?(?P<core>{NUMBER})\s?(?:(?P<rate>[%％])|(?P<magnitude>亿|万|千(?!瓦时)|百)?(?P<unit>千瓦时|平方米|股|手|吨|桶|台|辆|家|笔|单|人|元|美元|港元|欧元)?)|(?P<chinese>[零〇一二两三四五六七八九十百千万亿]+)(?P<cunit>(?=元|股|吨|手|%|％|家|笔)(?:元|股|吨|手|%|％|家|笔))")
_CLAUSES = re.compile(r"[^。！？!?；;\n]+[。！？!?；;]?")
_VERB = re.compile("|".join(sorted(VERBS, key=len, reverse=True)))
FACT = "struct<fact_id:string,clause:int,predicate:string,start:int,end:int,subject:string,polarity:string,modality:string,key_object:string,time:string,stage:string,numerics:array<struct<raw:string,value:string,magnitude:string,unit:string,currency:string,comparator:string,range_end:string,metric:string>>>"


def _last(pattern: re.Pattern[str], text: str) -> str | None:
    found = [m.group(m.lastindex) for m in pattern.finditer(text) if m.lastindex]
    return found[-1] if found else None


def _object(text: str) -> tuple[str | None, tuple[int, int]]:
    for pattern in OBJECTS:
        if m := pattern.search(text):
            return m.group(m.lastindex), m.span(m.lastindex)
    return None, (0, 0)


def _polarity(text: str, start: int, end: int) -> str:
    """The closest prefix, or a negation a few characters before, with the verb."""
    for p in PREFIXES:
        if text.endswith(p, 0, start):
            return text[start - len(p) : end]
    low = max(0, start - 4)
    loose = [k for w in NEGATIONS if (k := text.find(w, low, start)) >= 0]
    return text[min(loose, default=start) : end]


def _modality(text: str, start: int) -> str | None:
    window = text[max(0, start - 4) : start]
    touching = [w for w in MODALS if window.endswith(w)]
    if touching:
        return max(touching, key=len)
    found = [(window.rfind(w), w) for w in MODALS if w in window]
    return max(found, key=lambda x: x[0])[1] if found else None


def numerics(clause: str, taken: list[tuple[int, int]]) -> list[tuple[int, dict]]:
    """(place, numeric) of a clause, ranges joined; parts of times and key objects are no numbers."""
    free = [m for m in QUANTITY.finditer(clause) if not any(m.start() < b and a < m.end() for a, b in taken)]
    out, k = [], 0
    while k < len(free):
        m, end = free[k], None
        if k + 1 < len(free) and m["core"] and free[k + 1]["core"] and re.fullmatch("[-~至到]", clause[m.end() : free[k + 1].start()]):
            end, k = free[k + 1], k + 1
        elif k + 1 < len(free) and m["core"] and free[k + 1]["core"] and free[k + 1]["core"].startswith("-") and m.end() == free[k + 1].start():
            end, k = free[k + 1], k + 1
        tail = end or m
        left = clause[max(0, m.start() - 4) : m.start()]
        comparator = next((w for gap in range(5) for w in sorted(COMPARATOR_WORDS, key=len, reverse=True) if left[: len(left) - gap].endswith(w)), "=")
        near = clause[max(0, m.start() - 6) : m.start()]
        metric = max(((near.rfind(w), w) for w in METRICS if w in near), default=(0, None))[1]
        metric = metric or next((w for w in METRICS if w in clause[tail.end() : tail.end() + 6]), None)
        core = m["core"] or m["chinese"]
        strip = lambda x: x.replace(",", "").lstrip("-") if x.startswith("-") and end is not None else x.replace(",", "")  # noqa: E731, B023
        out.append((m.start(), {
            "raw": core, "value": m["core"].replace(",", "") if m["core"] else None, "magnitude": tail["magnitude"], "unit": tail["rate"] or tail["unit"] or tail["cunit"], "currency": m["currency"],
            "comparator": "range" if end is not None else comparator, "range_end": strip(end["core"]) if end is not None else None, "metric": metric,
        }))
        k += 1
    return out


def extract(text: str | None) -> list[dict]:
    """All facts of a text, in order; a text without content has none."""
    facts: list[dict] = []
    for place, m in enumerate(x for x in _CLAUSES.finditer(text or "") if x.group().strip()):
        clause, base = m.group(), m.start()
        if not clause.strip().strip("。！？!?；;").strip():
            continue
        when = TIME.search(clause)
        stage = next((w for w in STAGE_WORDS if w in clause), None)
        verbs = list(_VERB.finditer(clause))
        own: list[dict] = []
        taken = [when.span()] if when else []
        for k, v in enumerate(verbs):
            stop = verbs[k + 1].start() if k + 1 < len(verbs) else len(clause)
            thing, span = _object(clause[v.end() : stop])
            if thing and thing.isdigit():
                taken.append((span[0] + v.end(), span[1] + v.end()))
            before = clause[: v.start()]
            own.append({"predicate": v.group(), "start": base + v.start(), "end": base + v.end(), "subject": _last(SUBJECTS, before) or _last(COMPANY, before), "polarity": _polarity(clause, v.start(), v.end()), "modality": _modality(clause, v.start()), "key_object": thing, "numerics": []})
        if not own:
            own = [{"predicate": None, "start": base, "end": base + len(clause), "subject": _last(SUBJECTS, clause) or _last(COMPANY, clause), "polarity": None, "modality": None, "key_object": None, "numerics": []}]
        for at, number in numerics(clause, taken):
            holder = [f for f in own if f["predicate"] and f["start"] - base <= at]
            (holder[-1] if holder else own[0])["numerics"].append(number)
        for f in own:
            facts.append({"fact_id": f"f{len(facts) + 1}", "clause": place, "time": when.group() if when else None, "stage": stage} | f)
    return facts


def rule_facts(text: Column) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(extract)

    return F.pandas_udf(of, f"array<{FACT}>")(text)
