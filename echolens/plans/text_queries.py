"""Queries over text functions and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, fingerprints, values
from ..functions import text as T
from ..sources import tables as S
from .registry import FEATURES, ITEMS, query

TEXTS = [
    ("a", "甲公司\r\n增持"), ("b", "甲公司\n增持"), ("c", ""), ("d", " "), ("e", "\r\n"), ("f", "甲公司完成股份回购，金额为3亿元。"), ("g", "ab😀cd"), ("h", "甲"), ("i", " 甲公司 \n"),
    ("j", "证券代码：600519.sh公布年报"), ("k", "美国EIA数据显示"), ("l", "美国能源信息署数据"), ("m", "甲乙丙公司与丁集团"), ("n", "第一句。第二句！第三句；\n第四句"),
]
COLUMNS = {"id": "string", "text": "string"}
DUCK = S.values(COLUMNS, TEXTS, duck=True)


def texts(spark: SparkSession) -> DataFrame:
    return S.literal(spark, COLUMNS, TEXTS)


@query(f"WITH {ITEMS} SELECT record_id, item_id, sha256(text) AS raw_hash, sha256(norm) AS normalized_hash, length(norm)::INTEGER AS n_chars FROM items")
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return S.items(spark, d).select("record_id", "item_id", T.raw_hash(t).alias("raw_hash"), T.normalized_hash(t).alias("normalized_hash"), F.length(T.normalized(t)).alias("n_chars"))


@query(f"WITH x AS ({DUCK}) SELECT id, replace(text, chr(13) || chr(10), chr(10)) AS norm, CASE WHEN trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10)) = '' THEN replace(text, chr(13) || chr(10), chr(10)) ELSE trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10)) END AS trimmed, trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS indexable FROM x")
def text_normalization(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return texts(spark).select("id", T.normalized(t).alias("norm"), T.normalized(t, outer_trim=True).alias("trimmed"), T.indexable(t).alias("indexable"))


@query(f"WITH {ITEMS} SELECT record_id, 'default/2026-09-26/v1/raw/' || sha256(text) AS bucket_key, 5::INTEGER AS n_parts FROM items")
def bucket_keys(spark: SparkSession, d: str) -> DataFrame:
    key = T.bucket_key(F.col("scope_id"), F.col("business_date"), F.lit("v1"), F.lit("raw"), T.raw_hash(F.col("text")))
    return S.items(spark, d).select("record_id", key.alias("bucket_key")).select("*", F.size(T.bucket_parts(F.col("bucket_key"))).alias("n_parts"))


@query(f"WITH {ITEMS} SELECT sha256(text) AS raw_hash, count(*)::BIGINT AS n_items, min(arrival_seq)::BIGINT AS first_seq, max(arrival_seq)::BIGINT AS last_seq FROM items GROUP BY ALL HAVING count(*) > 1")
def exact_text_groups(spark: SparkSession, d: str) -> DataFrame:
    one = S.items(spark, d).groupBy(T.raw_hash(F.col("text")).alias("raw_hash")).agg(F.count("*").alias("n_items"), F.min("arrival_seq").alias("first_seq"), F.max("arrival_seq").alias("last_seq"))
    return one.where("n_items > 1")


@query(f"WITH x AS ({DUCK}), n AS (SELECT id, text, replace(text, chr(13) || chr(10), chr(10)) AS norm FROM x WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') SELECT a.id AS left_id, b.id AS right_id, CASE WHEN a.text = b.text THEN 'EXACT' ELSE 'LOSSLESS' END AS proof FROM n a JOIN n b ON a.norm = b.norm AND a.id < b.id")
def text_certificates(spark: SparkSession, d: str) -> DataFrame:
    a, b = texts(spark).alias("a"), texts(spark).alias("b")
    met = a.join(b, (T.normalized_hash(F.col("a.text")) == T.normalized_hash(F.col("b.text"))) & (F.col("a.id") < F.col("b.id")))
    return met.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), T.certificate(F.col("a.text"), F.col("b.text")).alias("proof")).where("proof is not null")


@query(f"WITH {FEATURES} SELECT record_id, count(*)::INTEGER AS n_shingles FROM grams GROUP BY 1")
def shingle_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.items(spark, d).where(T.indexable(F.col("text"))).select("record_id", F.size(T.shingles(T.normalized(F.col("text")))).alias("n_shingles"))


@query(f"WITH {FEATURES} SELECT record_id, count(*)::INTEGER AS n_tokens FROM toks GROUP BY 1")
def token_features(spark: SparkSession, d: str) -> DataFrame:
    return S.items(spark, d).select("record_id", F.size(T.tokens(T.normalized(F.col("text")))).alias("n_tokens")).where("n_tokens > 0")


_SIMHASH = FEATURES + """, hashed AS (SELECT record_id, ('0x' || substr(sha256('simhash_v1|' || kind || '|' || f), 1, 16))::UBIGINT AS h FROM feats),
votes AS (SELECT record_id, p, sum((h >> p) & 1) * 2 > count(*) AS one FROM hashed, range(0, 64) r(p) GROUP BY 1, 2),
sim AS (SELECT record_id, sum(CASE WHEN one THEN 1::HUGEINT << p::INTEGER ELSE 0::HUGEINT END)::UBIGINT AS v FROM votes GROUP BY 1)"""


@query(f"WITH {_SIMHASH} SELECT record_id, printf('%016x', v) AS simhash FROM sim")
def simhash_values(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.simhash(S.items(spark, d)).select("record_id", fingerprints.hex64(F.col("simhash")).alias("simhash"))


@query(f"WITH {_SIMHASH} SELECT record_id, 'simhash_v1:' || i || ':' || substr(printf('%016x', v), 4 * i + 1, 4) AS band FROM sim, (SELECT unnest(range(0, 4))::INTEGER AS i)")
def simhash_band_rows(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.simhash(S.items(spark, d)).select("record_id", F.explode(fingerprints.simhash_bands(F.col("simhash"))).alias("band"))


@query(f"WITH {_SIMHASH}, b AS (SELECT record_id, v, i, substr(printf('%016x', v), 4 * i + 1, 4) AS band FROM sim, (SELECT unnest(range(0, 4)) AS i)) SELECT DISTINCT a.record_id AS left_id, c.record_id AS right_id, bit_count(xor(a.v, c.v))::INTEGER AS distance FROM b a JOIN b c ON a.i = c.i AND a.band = c.band AND a.record_id < c.record_id WHERE bit_count(xor(a.v, c.v)) <= 3")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within three bits: four bands, so two such fingerprints agree in one."""
    bands = fingerprints.simhash(S.items(spark, d)).select("record_id", "simhash", F.explode(fingerprints.simhash_bands(F.col("simhash"))).alias("band"))
    a, b = bands.alias("a"), bands.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.record_id") < F.col("b.record_id")) & (fingerprints.hamming(F.col("a.simhash"), F.col("b.simhash")) <= 3))
    return met.select(F.col("a.record_id").alias("left_id"), F.col("b.record_id").alias("right_id"), fingerprints.hamming(F.col("a.simhash"), F.col("b.simhash")).alias("distance")).distinct()


_MINHASH = FEATURES + """, kinds AS (SELECT DISTINCT f FROM grams),
perms AS (SELECT f, p, substr(sha256('minhash_v1|news_flash_dedup_v1|' || p || '|' || f), 1, 16) AS h FROM kinds, (SELECT unnest(range(0, 128)) AS p)),
sig AS (SELECT record_id, p, min(h) AS h FROM grams JOIN perms USING (f) GROUP BY 1, 2)"""


@query(f"WITH {_MINHASH} SELECT record_id, string_agg(h, ' ' ORDER BY p) AS signature FROM sig GROUP BY 1")
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    """All 128 permutations of every document."""
    return fingerprints.minhash(S.items(spark, d)).select("record_id", F.array_join("signature", " ").alias("signature"))


@query(f"WITH {_MINHASH} SELECT record_id, 'minhash_v1:' || (p // 4) || ':' || sha256(unhex(string_agg(h, '' ORDER BY p))) AS band FROM sig GROUP BY record_id, p // 4")
def minhash_band_rows(spark: SparkSession, d: str) -> DataFrame:
    """All 32 bands of every document."""
    return fingerprints.minhash(S.items(spark, d)).select("record_id", F.explode(fingerprints.minhash_bands(F.col("signature"))).alias("band"))


@query(f"WITH {ITEMS} SELECT record_id, i::INTEGER AS segment, substr(text, i * 448 + 1, 512) AS part FROM (SELECT record_id, text, unnest(range(0, CASE WHEN length(text) <= 512 THEN 1 ELSE ceil((length(text) - 512) / 448.0)::INTEGER + 1 END)) AS i FROM items WHERE text <> '')")
def bm25_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.items(spark, d).select("record_id", F.posexplode(T.segments(F.col("text"))).alias("segment", "part"))


@query(f"WITH x AS ({DUCK}), e AS (SELECT id, unnest(list_concat(CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9])(?i:EIA)([^A-Za-z0-9]|$)') OR contains(text, '美国能源信息署') THEN ['entity_v1|org:美国能源信息署'] ELSE [] END, list_transform(list_filter([upper(regexp_extract(text, '(?:证券|股票)?代码[\\s:：]*([0-9]{{6}}(?:\\.(?i:SH|SZ))?)', 1))], lambda c: c <> ''), lambda c: 'entity_v1|code:' || c), list_transform(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]{{1,20}}?(?:股份有限公司|有限公司|公司|集团|银行|证券)'), lambda o: 'entity_v1|org:' || o))) AS entity FROM x) SELECT DISTINCT id, entity FROM e")
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark).select("id", F.explode(T.entities(F.col("text"))).alias("entity"))


@query(f"WITH x AS ({DUCK}), c AS (SELECT id, list_filter(regexp_extract_all(text, '[^。！？!?；;\\n]+[。！？!?；;]?'), lambda s: trim(s, ' ' || chr(9) || chr(13)) <> '') AS l FROM x) SELECT id, (i - 1)::INTEGER AS place, l[i] AS clause FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM c)")
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark).select("id", F.posexplode(T.clauses(F.col("text"))).alias("place", "clause"))


EVIDENCE = [("e1", "𠮷公司报价101.84。", 5, 11, "101.84"), ("e2", "𠮷公司报价101.84。", 6, 12, "101.84"), ("e3", "甲公司回购", 0, 3, "甲公司"), ("e4", "甲公司回购", 0, 3, "甲公"), ("e5", "甲公司", 2, 2, "")]
EVIDENCE_COLUMNS = {"id": "string", "text": "string", "s": "int", "e": "int", "quote": "string"}


@query(f"WITH x AS ({S.values(EVIDENCE_COLUMNS, EVIDENCE, duck=True)}) SELECT id, s >= 0 AND e > s AND substr(text, s + 1, e - s) = quote AS holds FROM x")
def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    return S.literal(spark, EVIDENCE_COLUMNS, EVIDENCE).select("id", T.quote_holds(F.col("text"), F.col("s"), F.col("e"), F.col("quote")).alias("holds"))


RULES = [
    ("r1", "甲公司完成回购。"), ("r2", "今日油价上调。"), ("r3", "甲集团股份有限公司发布年报。"), ("r4", "甲公司签署协议并获批上市。"), ("r5", "今天天气不错。"), ("r6", "甲公司并未回购。"), ("r7", "甲公司已回购。"),
    ("r8", "甲公司回购100万元。"), ("r9", "甲公司回购1,200.50元。"), ("r10", "甲公司减持100-200万股。"), ("r11", "甲公司回购一百万股。"), ("r12", "甲公司披露净利润超5亿元。"), ("r13", "甲公司2026年9月26日完成回购。"), ("r14", "甲公司增持600519。"), ("r15", "甲公司2026年9月26日收盘发布年报。"), ("r16", ""),
]


@query()
def rule_fact_rows(spark: SparkSession, d: str) -> DataFrame:
    found = S.literal(spark, COLUMNS, RULES).select("id", F.explode(facts.rule_facts(F.col("text"))).alias("f"))
    return found.select("id", "f.fact_id", "f.predicate", "f.subject", "f.polarity", "f.modality", "f.key_object", "f.time", "f.stage", F.to_json("f.numerics").alias("numerics"))


@query()
def document_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of every document, counted: without event verbs each clause has its fallback fact."""
    return S.items(spark, d).select("record_id", F.size(facts.rule_facts(F.col("text"))).alias("n_facts"))


NUMBERS = [
    ("n1", "101.84", "美元", "", "101.85", "美元", ""), ("n2", "116.350", "元", "", "116.35", "元", ""), ("n3", "1", "元", "亿", "10000", "元", "万"), ("n4", "100", "股", "万", "一百万", "股", ""),
    ("n5", "一万二", "元", "", "12000", "元", ""), ("n6", "12345678901234567890123456789", "股", "万", "12345678901234567890123456788", "股", "万"), ("n7", "3", "BP", "", "0.03", "个百分点", ""), ("n8", "5", "元", "", "5", "股", ""), ("n9", "7", "吨", "", "7", "吨", ""),
]
NUMBER_COLUMNS = {"id": "string", "ra": "string", "ua": "string", "ma": "string", "rb": "string", "ub": "string", "mb": "string"}
_EXPECTED = [("n1", "verified_conflict"), ("n2", "format_equal"), ("n3", "unit_equal"), ("n4", "unit_equal"), ("n5", "unresolved"), ("n6", "verified_conflict"), ("n7", "unit_equal"), ("n8", "unresolved"), ("n9", "equal")]


@query(S.values({"id": "string", "status": "string"}, _EXPECTED, duck=True))
def number_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = S.literal(spark, NUMBER_COLUMNS, NUMBERS)
    for side in "ab":
        raw, unit, magnitude = F.col(f"r{side}"), F.col(f"u{side}"), F.col(f"m{side}")
        rows = rows.withColumn(f"x{side}", values.exact_value(raw, unit, magnitude, F.lit("1")))
        null = F.lit(None).cast("string")
        rows = rows.withColumn(side, F.struct(F.lit("present").alias("status"), F.col(f"x{side}").isNotNull().alias("valid"), F.col(f"x{side}").alias("exact"), null.alias("range_end"), raw.alias("raw"), unit.alias("unit"), magnitude.alias("magnitude"), null.alias("currency"), null.alias("dimension"), null.alias("role"), null.alias("metric"), F.lit("=").alias("comparator"), F.lit(False).alias("approximate"), F.lit("1").alias("denominator")))
    return rows.withColumn("aligned", F.lit(True)).select("id", values.compare_numbers("a", "b").alias("status"))


@query(S.values({"unit": "string", "kind": "string", "up": "long", "down": "long"}, [(u, v[0], v[1], v[2]) for u, v in values.UNITS.items()], duck=True))
def unit_normalization(spark: SparkSession, d: str) -> DataFrame:
    rows = S.literal(spark, {"unit": "string"}, [(u,) for u in values.UNITS])
    return rows.select("unit", *[values.unit_table(k)[F.col("unit")].alias(n) if n == "kind" else values.unit_table(k)[F.col("unit")].cast("long").alias(n) for k, n in enumerate(("kind", "up", "down"))])


TIMES = [
    ("t1", "今日", None, "今日", None, "compatible"), ("t2", "今日", None, "次日", None, "conflict"), ("t3", "今日", "开盘", "今日", "收盘", "conflict"), ("t4", "2026年9月22日", None, "2026-09-22", None, "compatible"), ("t5", "今日", None, "2026-09-22", None, "unresolved"),
    ("t6", "10:01", None, "10:02", None, "conflict"), ("t7", "2026年上半年", None, "2026年下半年", None, "conflict"), ("t8", "2026年上半年", None, "2026年第一季度", None, "unresolved"), ("t9", "2026年半年度", None, "2026年上半年", None, "compatible"), ("t10", "2026年9月22日", None, "2026年三季度", None, "unresolved"),
    ("t11", "2026年9月22日", None, "2026年一季度", None, "conflict"), ("t12", "近期", None, "最近", None, "compatible"), ("t13", "9月10日", None, "9月10日", None, "unresolved"), ("t14", "第二季度", None, "二季度", None, "compatible"), ("t15", "今日", None, None, None, "compatible"), ("t16", "2026年2月30日", None, "2026-02-28", None, "unresolved"),
]
TIME_COLUMNS = {"id": "string", "ra": "string", "sa": "string", "rb": "string", "sb": "string", "expected": "string"}


@query(S.values({"id": "string", "relation": "string"}, [(t[0], t[5]) for t in TIMES], duck=True))
def time_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A null expression is a verified missing one."""
    rows = S.literal(spark, TIME_COLUMNS, TIMES)
    for side in "ab":
        raw = F.col(f"r{side}")
        parsed = values.parse_time(raw, F.col(f"s{side}"))
        rows = rows.withColumn(f"p{side}", parsed)
        fields = [F.col(f"p{side}.{n}").alias(n) for n in ("kind", "low", "high", "relative", "stage")]
        rows = rows.withColumn(side, F.struct(F.when(raw.isNull(), "missing").otherwise("present").alias("status"), *fields, F.coalesce(f"p{side}.weak", F.lit(False)).alias("weak"), (raw.isNull() | F.col(f"p{side}.valid")).alias("valid")))
    return rows.withColumn("aligned", F.lit(True)).select("id", values.compare_times("a", "b").alias("relation"))
