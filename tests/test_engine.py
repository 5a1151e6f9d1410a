"""Expectations written down by hand: facts, near candidates, ordering, streaming, metamorphic checks."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from echolens.functions import facts, fingerprints, values
from echolens.functions import text as T
from echolens.operators import decide, gold, recall, verify
from echolens.plans.recall_queries import prints
from echolens.sources import tables as S
from echolens.streaming import jobs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

FACTS = [
    ("甲公司完成回购。", {"subject": "甲公司", "predicate": "回购", "time": None}),
    ("今日油价上调。", {"subject": None, "predicate": "上调", "time": "今日"}),
    ("甲集团股份有限公司发布年报。", {"subject": "甲集团股份有限公司"}),
    ("今天天气不错。", {"predicate": None, "fact_id": "f1"}),
    ("甲公司并未回购。", {"polarity": "并未回购"}),
    ("甲公司已回购。", {"polarity": "已回购", "modality": "已"}),
    ("甲公司未完成回购。", {"polarity": "未完成回购"}),
    ("甲公司2026年9月26日完成回购。", {"time": "2026年9月26日", "numerics": []}),
    ("甲公司增持600519。", {"key_object": "600519", "numerics": []}),
    ("甲公司2026年9月26日收盘发布年报。", {"time": "2026年9月26日", "stage": "收盘"}),
]


@pytest.mark.parametrize(("text", "slots"), FACTS)
def test_fact_slots(text: str, slots: dict) -> None:
    got = facts.extract(text)[0]
    assert {k: got[k] for k in slots} == slots


NUMBERS = [
    ("甲公司回购100万元。", {"value": "100", "magnitude": "万", "unit": "元"}),
    ("甲公司回购1,200.50元。", {"value": "1200.50"}),
    ("甲公司减持100-200万股。", {"value": "100", "range_end": "200", "comparator": "range"}),
    ("甲公司回购一百万股。", {"raw": "一百万", "value": None}),
    ("甲公司披露净利润超5亿元。", {"comparator": "超", "metric": "净利润"}),
]


@pytest.mark.parametrize(("text", "slots"), NUMBERS)
def test_fact_numbers(text: str, slots: dict) -> None:
    got = facts.extract(text)[0]["numerics"][0]
    assert {k: got[k] for k in slots} == slots


def test_facts_of_a_clause_and_of_nothing() -> None:
    assert [f["predicate"] for f in facts.extract("甲公司签署协议并获批上市。")] == ["签署", "获批", "上市"]
    assert facts.extract("") == facts.extract(None) == facts.extract(" 。") == []


def test_numbers_are_exact() -> None:
    assert values.exact("1", "元", "亿") == values.exact("10000", "元", "万")
    assert values.exact("一百万", "股", "") == values.exact("100", "股", "万")
    assert values.exact("一万二", "元", "") is values.exact("一千二", "元", "") is None
    assert values.exact("1.20", "元", "", "10") == values.exact("0.12", "元", "", "1")


NUMERALS = [
    ("十", 10), ("十二", 12), ("二十", 20), ("一百零二", 102), ("一百二十", 120), ("一千零二十", 1020), ("三万五千", 35_000), ("一亿零五百", 100_000_500), ("三亿五千万", 350_000_000), ("一万亿", 10**12), ("百", 100), ("万", 10_000), ("零", 0), ("两千", 2000),
    ("一万二", None), ("一百二", None), ("二〇二六", None), ("", None), ("甲", None), ("百十千", None),
]


@pytest.mark.parametrize(("raw", "value"), NUMERALS)
def test_chinese_numerals(raw: str, value: int | None) -> None:
    assert values.chinese_number(raw) == value


def test_amounts_of_a_text() -> None:
    found = {(str(v), p, dated) for v, p, dated in verify.amounts("2026年9月 第3季度 涨1,200.50点 5％ 330万手 三亿五千万 一点五")}
    assert found == {("2026", False, True), ("9", False, True), ("3", False, True), ("2401/2", False, False), ("5", True, False), ("3300000", False, False), ("0", False, False), ("350000000", False, False), ("3/2", False, False)}


def test_units_alone_are_no_conflict(spark: SparkSession) -> None:
    row = spark.createDataFrame([("成交3亿元", "成交30000万元")], "a string, b string").select(verify.number_conflict(F.col("a"), F.col("b")).alias("c")).first()
    assert not row.c


def test_claims_are_grounded(spark: SparkSession) -> None:
    """The same, another percent mark, a magnitude that follows; not a magnitude that doesn't, nor a number of no text."""
    rows = [("成交330万手", ["330"], 0), ("成交330万手", ["330万"], 0), ("涨9%多", ["9"], 0), ("一共33000元整", ["330"], 1), ("涨9%多", ["8"], 1), ("涨9%多", ["大涨"], 0), ("净流入三亿元", ["三亿"], 0), (None, ["1"], 1), ("x", None, 0)]
    got = spark.createDataFrame([(t, c) for t, c, _ in rows], "t string, c array<string>").select(F.size(verify.ungrounded(F.col("c"), F.col("t"))).alias("n")).collect()
    assert [r.n for r in got] == [n for *_, n in rows]


def test_record_ids_are_escaped_json(spark: SparkSession) -> None:
    row = spark.createDataFrame([('a"b\\c', "d\ne")], "s string, i string").select(T.record_id(F.col("s"), F.col("i")).alias("r")).first()
    assert row.r == hashlib.sha256(json.dumps(['a"b\\c', "d\ne"], separators=(",", ":")).encode()).hexdigest()


def test_minhash_signatures_by_hand(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("a", "abcd"), ("b", "xy")], "record_id string, text string")
    got = {r.record_id: r.signature for r in fingerprints.minhash(rows).collect()}
    for name, grams in (("a", ["abc", "bcd"]), ("b", ["xy"])):
        assert got[name] == [min(hashlib.sha256(f"minhash_v1|news_flash_dedup_v1|{p}|{g}".encode()).hexdigest()[:16] for g in grams) for p in range(128)]


def test_proportion_bound() -> None:
    assert gold.clopper_pearson_lower(9, 10) == pytest.approx(0.6058366975634952, abs=1e-9)
    assert gold.clopper_pearson_lower(0, 5) == gold.clopper_pearson_lower(0, 0) == 0.0
    assert 0.99 < gold.clopper_pearson_lower(389, 389) < 1


def test_shingles_keep_code_points(spark: SparkSession) -> None:
    row = spark.createDataFrame([("ab😀cd",)], "text string").select(T.shingles(F.col("text")).alias("s")).first()
    assert row["s"] == ["ab😀", "b😀c", "😀cd"]


def test_line_ends_do_not_change_fingerprints(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("a", "甲公司\r\n增持"), ("b", "甲公司\n增持"), ("c", " \t"), ("d", None)], "record_id string, text string")
    sims = {r["record_id"]: r["simhash"] for r in fingerprints.simhash(rows).collect()}
    mins = {r["record_id"]: r["signature"] for r in fingerprints.minhash(rows).collect()}
    assert set(sims) == set(mins) == {"a", "b"}
    assert sims["a"] == sims["b"] and mins["a"] == mins["b"] and len(mins["a"]) == 128


def test_simhash_by_hand(spark: SparkSession) -> None:
    text = "abcd ef"
    grams = {text[k : k + 3] for k in range(len(text) - 2)}
    hashes = [int.from_bytes(hashlib.sha256(f"simhash_v1|{k}|{f}".encode()).digest()[:8], "big") for k, f in [*(("char", g) for g in grams), ("token", "abcd"), ("token", "ef")]]
    want = sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes))
    got = fingerprints.simhash(spark.createDataFrame([("a", text)], "record_id string, text string")).first()["simhash"]
    assert got % (1 << 64) == want


def test_near_channel_against_brute_force(spark: SparkSession, small: str) -> None:
    items = S.items(spark, small)
    made = prints(spark, small)
    got = {(r["query_id"], r["cand_id"]): r["score"] for r in recall.near_channel(items, made).collect()}
    seq = {r["record_id"]: r["arrival_seq"] for r in items.collect()}
    rows = made.withColumn("bands", fingerprints.minhash_bands(F.col("signature"))).withColumn("sb", fingerprints.simhash_bands(F.col("simhash"))).collect()
    want = {}
    for q in rows:
        mine = []
        for c in rows:
            if seq[c["record_id"]] >= seq[q["record_id"]]:
                continue
            scores = []
            far = ((q["simhash"] ^ c["simhash"]) % (1 << 64)).bit_count()
            if set(q["sb"]) & set(c["sb"]) and far <= 3:
                scores.append(1 - far / 64)
            if set(q["bands"]) & set(c["bands"]):
                scores.append(sum(a == b for a, b in zip(q["signature"], c["signature"], strict=True)) / 128)
            if scores:
                mine.append((-max(scores), seq[c["record_id"]], c["record_id"]))
        for s, _, cand in sorted(mine)[:40]:
            want[q["record_id"], cand] = -s
    assert got == pytest.approx(want)


def test_near_channel_of_full_bands_in_blocks(spark: SparkSession) -> None:
    """Bands that all items share: with a bucket of 5 a query sees the first five, however the blocks are cut."""
    rows = [(f"r{x:02}", f"i{x:02}", "the same words in the same order, " * 3 + f"and {x:02} at the end", x + 1, "s", "2026-09-26") for x in range(60)]
    items = spark.createDataFrame(rows, "record_id string, item_id string, text string, arrival_seq long, scope_id string, business_date string")
    made = fingerprints.simhash(items).join(fingerprints.minhash(items), "record_id")
    for block in (7, 1000):
        got = recall.near_channel(items, made, k=3, bucket=5, block=block).collect()
        assert sorted({r["rank"] for r in got}) == [1, 2, 3] and all(r["arrival_seq"] < int(r["query_id"][1:]) + 1 for r in got)
        seen = {}
        for r in made.select("record_id", F.explode(F.concat(fingerprints.simhash_bands(F.col("simhash")), fingerprints.minhash_bands(F.col("signature")))).alias("band")).collect():
            seen.setdefault(r["band"], []).append(r["record_id"])
        allowed = {(q, c) for v in seen.values() for q in v for c in sorted(v)[:5] if c < q}
        assert {(r["query_id"], r["cand_id"]) for r in got} <= allowed
        assert len(got) == sum(min(3, sum(1 for a, _ in allowed if a == q)) for q in {a for a, _ in allowed})


def test_vector_channel_in_cells(spark: SparkSession) -> None:
    """However the grid is cut, the nearest are those of brute force; nothing is collected for it or broadcast."""
    import numpy as np

    v = np.random.default_rng(5).normal(size=(300, 8))
    v[40] = v[41] = v[42]
    rows = spark.createDataFrame([(x, r.tolist()) for x, r in enumerate(v)], "cand_id long, embedding array<double>")
    asked = rows.where("cand_id % 3 = 0").withColumnRenamed("cand_id", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, rank): round(s, 9) for q in range(0, 300, 3) for rank, (s, _) in enumerate(sorted(((round(float(u[q] @ u[c]), 9), c) for c in range(300) if c != q), key=lambda x: (-x[0], x[1]))[:5], 1)}
    for block, piece in ((7, 11), (1000, 1000)):
        found = recall.vector_channel(rows, asked, k=5, block=block, piece=piece)
        assert {(r["query_id"], r["rank"]): r["score"] for r in found.collect()} == pytest.approx(want, abs=2e-9)
        by = {(r["query_id"], r["rank"]): r["cand_id"] for r in found.collect()}
        assert (by[42, 1], by[42, 2]) == (40, 41)


def exchanged(df) -> list[str]:
    """Shuffles of the plan that run, each with what it deals out."""
    return [x for x in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("\n") if "Exchange hashpartitioning" in x]


def copies(spark: SparkSession, tmp_path: Path, n: int = 700) -> str:
    """Documents with a text that many share, one that few share, short ones and blanks."""
    texts = ["a text that very many of the documents share, long enough to be certain" if x % 2 else ["short", "b text that some documents share, and that is long enough to be certain too", f"alone {x}", " "][x // 2 % 4] for x in range(n)]
    rows = [(x, t, "en" if x % 3 else None, f"src{x % 2}", len(t)) for x, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").where("text <> ' '").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["hash_channel", "rrf_fusion", "plan_required", "candidate_diff", "decisions_end_to_end", "public_decisions", "plan_completion", "audit_ids"])
def test_large_groups_of_equal_texts(spark: SparkSession, tmp_path: Path, name: str) -> None:
    """Groups beyond a piece, against SQL; pairs come out of one join on pieces and aren't shuffled after it."""
    from echolens import catalogue
    from oracle import assert_same

    d = copies(spark, tmp_path)
    df = catalogue.QUERIES[name](spark, d)
    assert_same(df, catalogue.ORACLE_SQL[name], d)
    if name not in ("plan_completion",):
        assert not [x for x in exchanged(df) if "query_id" in x or "cand_id" in x]


def test_equal_texts_of_one_item_are_left_out(spark: SparkSession) -> None:
    """Ranks leave no gap for another record of the same item, an equal arrival or another day."""
    rows = [("a", "i", 1), ("b", "j", 2), ("c", "i", 3), ("d", "k", 3), ("e", "l", 4), ("f", "m", 0)]
    items = spark.createDataFrame([(r, i, "one text", s, "s", "d") for r, i, s in rows] + [("g", "n", "one text", 2, "s", "other")], "record_id string, item_id string, text string, arrival_seq long, scope_id string, business_date string")
    got = sorted((r["query_id"], r["rank"], r["cand_id"]) for r in recall.hash_channel(items).collect())
    assert got == [("b", 1, "a"), ("c", 1, "b"), ("d", 1, "a"), ("d", 2, "b"), ("e", 1, "a"), ("e", 2, "b"), ("e", 3, "c"), ("e", 4, "d")]
    pieces = recall.equal_pairs(recall.equal_texts(items), piece=2)
    assert sorted((r["record_id"], r["rank"], r["c"]["record_id"]) for r in pieces.collect()) == got


def test_bm25_channel_shuffles_neither_postings_nor_scores(spark: SparkSession) -> None:
    """Against sums by hand, with repeated terms, two segments, documents without words and ties; a shuffle has k rows of a segment and task at most."""
    import math
    import re
    from collections import Counter

    docs = [(x, x + 1, ("alpha " * (x % 4) + "beta " * (x % 3) + f"word{x % 7}") if x % 11 else ("" if x % 2 else None)) for x in range(120)]
    asked = [("p", "Alpha beta beta word3"), ("q", "word1 " * 100 + "alpha"), ("r", "nothing here"), ("s", "")]
    words = [re.findall(r"\w+", (t or "").lower()) for _, _, t in docs]
    mean = sum(map(len, words)) / sum(t is not None for _, _, t in docs)
    df = Counter(w for x in words for w in set(x))
    want = {}
    for q, text in asked:
        best = {}
        for at in range(1 if len(text) <= 512 else -(-(len(text) - 512) // 448) + 1):
            found = []
            for (c, _, _), have in zip(docs, map(Counter, words), strict=True):
                s = sum(n * math.log(1 + (120 - df[w] + 0.5) / (df[w] + 0.5)) * have[w] * 2.2 / (have[w] + 1.2 * (0.25 + 0.75 * sum(have.values()) / mean)) for w, n in Counter(re.findall(r"\w+", text[448 * at : 448 * at + 512].lower())).items() if have[w])
                found += [(-round(s, 9), c)] if s else []
            for s, c in sorted(found)[:5]:
                best[c] = max(best.get(c, 0), -s)
        for rank, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5], 1):
            want[q, rank] = (c, s)
    found = recall.bm25_channel(spark.createDataFrame(asked, "query_id string, text string"), spark.createDataFrame(docs, "cand_id long, arrival_seq long, text string").repartition(3), k=5)
    got = {(r["query_id"], r["rank"]): (r["cand_id"], r["score"]) for r in found.collect()}
    assert {x: c for x, (c, _) in got.items()} == {x: c for x, (c, _) in want.items()}
    assert all(abs(got[x][1] - want[x][1]) < 1e-8 for x in want)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_of_odd_texts_in_one_pass(spark: SparkSession) -> None:
    """Shorter texts than a shingle, code points beyond the first plane, symbols, and more rows than are returned at once; features aren't sent as lists."""
    texts = ["a", "ab", "abc", "𠮷公司 𠮷!", "x\r\ny\u00a0z\u0085.", "  ", "e\u0301e\u0301e\u0301", "the same words " * 20]
    rows = [(f"{x:05}", t) for x, t in enumerate(texts)] + [(f"{x:05}", f"text {x}") for x in range(10, 2300)]
    items = spark.createDataFrame(rows, "record_id string, text string").coalesce(1)
    normal = items.where("trim(text) <> ''").select("record_id", T.normalized(F.col("text")).alias("t")).select("record_id", T.shingles(F.col("t")).alias("g"), T.tokens(F.col("t")).alias("w")).collect()
    made = fingerprints.prints(items)
    got = {r["record_id"]: r for r in made.collect()}
    assert set(got) == {r["record_id"] for r in normal}
    eight = lambda text: int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    for r in normal[:40] + normal[-40:]:
        hashes = [eight(f"simhash_v1|char|{g}") for g in r["g"]] + [eight(f"simhash_v1|token|{w}") for w in r["w"]]
        assert got[r["record_id"]]["simhash"] % (1 << 64) == sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes))
        assert got[r["record_id"]]["signature"] == [f"{min(eight(f'minhash_v1|news_flash_dedup_v1|{p}|{g}') for g in r['g']):016x}" for p in range(128)]
    assert "array<string>" not in made._jdf.queryExecution().analyzed().children().head().schema().simpleString()
    bands = made.select("record_id", F.explode(F.concat(fingerprints.simhash_bands(F.col("simhash")), fingerprints.minhash_bands(F.col("signature")))).alias("band"))
    held = made.select("record_id", F.posexplode(fingerprints.band_bytes(F.col("simhash"), fingerprints.packed(F.col("signature")))).alias("number", "held")).select("record_id", fingerprints.band_name(F.col("number"), F.col("held")).alias("band"))
    assert bands.exceptAll(held).count() == 0 and held.count() == bands.count() == 36 * len(normal)


def test_hash_channel_survives_repartitioning(spark: SparkSession, small: str) -> None:
    items = S.items(spark, small)
    rows = lambda df: sorted(map(tuple, recall.hash_channel(df).select("query_id", "cand_id", "rank").collect()))
    assert rows(items) == rows(items.repartition(13, "text")) == rows(items.orderBy(F.col("arrival_seq").desc()))


def test_families_of_a_chain(spark: SparkSession) -> None:
    nodes = spark.createDataFrame([(str(k).zfill(2),) for k in range(12)], "node string")
    edges = spark.createDataFrame([(str(k).zfill(2), str(k + 1).zfill(2)) for k in range(8)], "a string, b string")
    roots = {r["node"]: r["root"] for r in gold.families(nodes, edges).collect()}
    assert [roots[str(k).zfill(2)] for k in range(12)] == ["00"] * 9 + ["09", "10", "11"]


def test_tie_keeps_items_without_pairs(spark: SparkSession) -> None:
    items = spark.createDataFrame([("a", "1", True, False)], "record_id string, item_id string, coverage_complete boolean, subject_missing boolean")
    pairs = spark.createDataFrame([], "record_id string, cand_seq long, cand_item_id string, outcome string, code string")
    assert decide.aggregate(items, pairs).first()["decision"] == decide.DISTINCT


def test_streamed_admission_is_idempotent(spark: SparkSession, tmp_path: Path) -> None:
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    send = lambda rows: spark.createDataFrame(rows, jobs.REQUEST).coalesce(1).write.mode("append").parquet(source)
    send([(1, "s", "r1", "i1", "a"), (2, "s", "r2", "i2", "b")])
    jobs.run_admission(jobs.read_requests(spark, source), out, check).awaitTermination()
    send([(3, "s", "r1", "i1", "a"), (4, "s", "r9", "i2", "b"), (5, "s", "r5", "i5", "c")])
    jobs.run_admission(jobs.read_requests(spark, source), out, check).awaitTermination()
    rows = {r["ord"]: (r["status"], r["arrival_seq"]) for r in spark.read.parquet(out).collect()}
    assert rows[1] == ("accepted", 1) and rows[2] == ("accepted", 2) and rows[5] == ("accepted", 3)
    assert rows[3][0] == "reused" and rows[4][0] == "conflict"


def test_chunks_cover_and_overlap() -> None:
    from echolens.functions import positions

    for text in ("", "短", "句子。" * 400, "x" * 2000, "a sentence. " * 200):
        spans = positions.cut(text)
        assert all(0 < b - a <= positions.CHUNK for a, b in spans)
        assert spans == [] if not text else spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(c[0] < a[1] and c[0] > a[0] for a, c in zip(spans, spans[1:], strict=False))
