"""Queries over sources, sinks and validity: submissions, stored rows, results, positions, chunks and fact checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import positions
from ..functions import text as T
from ..operators import decide, gold, validate
from ..sources import judgments, store, submissions
from ..sources import tables as S
from .registry import ITEMS, query

BODIES = [
    ("s1", '{"request_id":"r1","text":"甲公司回购"}'), ("s2", '{"request_id":"r2","text":""}'), ("s3", '{"request_id":"r3"}'), ("s4", "not json"), ("s5", '{"request_id":"r5","text":"x","extra":1}'), ("s6", '{"request_id":7,"text":"x"}'), ("s7", '{"request_id":"r7","text":"x","trace_id":"t"}'),
]
_STATUS = [("s1", 202, None), ("s2", 422, "EMPTY_TEXT"), ("s3", 422, "MISSING_FIELD"), ("s4", 422, "NOT_AN_OBJECT"), ("s5", 422, "UNKNOWN_FIELD"), ("s6", 422, "WRONG_TYPE"), ("s7", 202, None)]


@query(S.values({"id": "string", "status": "int", "problem": "string"}, _STATUS, duck=True))
def submission_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return submissions.parse(S.literal(spark, {"id": "string", "body": "string"}, BODIES)).select("id", "status", "problem")


@query("SELECT event_id, CASE WHEN json_valid(props) THEN 'object' ELSE 'broken' END AS kind FROM events")
def json_source(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.when(F.col("m").isNotNull(), "object").otherwise("broken").alias("kind"))


STORE = {"key": "string", "version": "long", "value": "string"}


STORED, WRITES = [("a", 1, "a1"), ("b", 1, "b1"), ("d", 4, "d4")], [("a", 1, "a2"), ("b", 7, "b2"), ("c", 0, "c1")]
_MERGED = f"""WITH s AS ({S.values(STORE, STORED, duck=True)}), w AS ({S.values(STORE, WRITES, duck=True)}), j AS (SELECT coalesce(s.key, w.key) AS key, s.version AS held, s.value AS old, w.version AS seen, w.value AS new, w.key IS NOT NULL AS asked FROM s FULL JOIN w ON s.key = w.key)
SELECT key, CASE WHEN asked AND seen = coalesce(held, 0) THEN seen + 1 ELSE held END AS version, CASE WHEN asked AND seen = coalesce(held, 0) THEN new ELSE old END AS value,
       CASE WHEN NOT asked THEN 'kept' WHEN seen <> coalesce(held, 0) THEN 'conflict' WHEN held IS NULL THEN 'created' ELSE 'replaced' END AS outcome FROM j WHERE held IS NOT NULL OR seen = 0"""


@query(_MERGED)
def versioned_writes(spark: SparkSession, d: str) -> DataFrame:
    """Optimistic writes as a merge: a write names the version that it saw (0: none)."""
    return store.merge(S.literal(spark, STORE, STORED), S.literal(spark, STORE, WRITES))


HELD, NEW = [("a",), ("b",)], [("a",), ("n",), ("m",), ("m",)]


@query(f"WITH s AS ({S.values({'key': 'string'}, HELD, duck=True)}), n AS ({S.values({'key': 'string'}, NEW, duck=True)}) SELECT key, CASE WHEN key IN (SELECT key FROM s) THEN 'exists' WHEN count(*) > 1 THEN 'duplicate' ELSE 'created' END AS outcome FROM n GROUP BY key")
def create_only(spark: SparkSession, d: str) -> DataFrame:
    return store.create(S.literal(spark, {"key": "string"}, HELD), S.literal(spark, {"key": "string"}, NEW))


@query("SELECT vec_id, CASE WHEN d.doc_id IS NULL THEN 'ES_MISSING' WHEN d.lang <> 'en' THEN 'AUTHORITY_MISMATCH' ELSE 'ok' END AS hole FROM embeddings LEFT JOIN documents d ON doc_id = vec_id")
def vector_holes(spark: SparkSession, d: str) -> DataFrame:
    """Vector rows held against the items that should own them; the language stands for the identity to match."""
    v = S.table(spark, d, "embeddings").select("vec_id", F.lit("en").alias("claimed"))
    items = S.table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("owner"))
    return store.holes(v, items, "vec_id").select("vec_id", "hole")


@query(S.values({"record_id": "string", "problem": "string"}, [("a", None), ("b", "MEMBER_WITHOUT_AUDIT"), ("c", "ORDER"), ("e", "CARDINALITY"), ("f", "CARDINALITY")], duck=True))
def result_validation(spark: SparkSession, d: str) -> DataFrame:
    results = S.literal(spark, {"record_id": "string", "decision": "string", "duplicate_ids": "array<string>"}, [("a", decide.DUPLICATE, ["x", "y"]), ("b", decide.DUPLICATE, ["z"]), ("c", decide.DUPLICATE, ["y", "x"]), ("e", decide.DUPLICATE, []), ("f", decide.DISTINCT, ["x"])])
    audits = S.literal(spark, {"record_id": "string", "member_id": "string", "seq": "long"}, [("a", "x", 1), ("a", "y", 2), ("c", "x", 1), ("c", "y", 2)])
    return validate.results(results, audits)


LOGS = [("l1", "trace_id", "abc"), ("l2", "text", "secret body"), ("l3", "status", "202"), ("l4", "error_code", "with space"), ("l5", "arrival_seq", "12")]


@query(S.values({"id": "string", "safe": "string"}, [("l1", "abc"), ("l2", None), ("l3", "202"), ("l4", None), ("l5", "12")], duck=True))
def safe_log(spark: SparkSession, d: str) -> DataFrame:
    return validate.safe(S.literal(spark, {"id": "string", "name": "string", "value": "string"}, LOGS)).select("id", "safe")


POSITIONS = [("a", "甲\r\n乙", 0, 3), ("b", "甲\r\n乙", 1, 2), ("c", "a\r\n\r\nb", 2, 4), ("e", "plain", 1, 3)]


@query(S.values({"id": "string", "s": "int", "e": "int"}, [("a", 0, 4), ("b", 1, 3), ("c", 3, 6), ("e", 1, 3)], duck=True))
def original_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = S.literal(spark, {"id": "string", "text": "string", "s": "int", "e": "int"}, POSITIONS)
    span = positions.original_span(F.col("text"), F.col("s"), F.col("e"))
    return rows.select("id", span["start"].alias("s"), span["end"].alias("e"))


@query(f"WITH {ITEMS}, c AS (SELECT record_id, norm, unnest(range(0, greatest(1, ceil((length(norm) - 64) / 448.0))::INTEGER)) AS i FROM items) SELECT record_id, i::INTEGER AS chunk, (i * 448)::INTEGER AS start, least(i * 448 + 512, length(norm))::INTEGER AS stop, sha256(substr(norm, i * 448 + 1, 512)) AS chunk_hash FROM c")
def hash_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows with overlap over the normalised text, each with its hash: the unit that vectors are made of."""
    rows = S.items(spark, d).select("record_id", T.normalized(F.col("text")).alias("norm"))
    return rows.select("record_id", F.explode(positions.windows(F.col("norm"))).alias("c")).select("record_id", "c.chunk", "c.start", "c.stop", "c.chunk_hash")


@query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of up to 512 code points that end at a sentence where one ends in the last 64; tests check their coverage."""
    return positions.chunks(S.items(spark, d).select("record_id", "text"))


SHELLS = [("a", "甲公司今日完成回购股份事项共计一百万股（产联社）"), ("b", "甲公司回购（产联社）"), ("c", "甲公司今日完成回购股份事项共计一百万股用于注销"), ("e", "甲公司回购")]


@query(S.values({"id": "string", "passes": "boolean"}, [("a", True), ("b", False), ("c", True), ("e", False)], duck=True))
def source_shells(spark: SparkSession, d: str) -> DataFrame:
    return S.literal(spark, {"id": "string", "text": "string"}, SHELLS).select("id", positions.shell_passes(F.col("text")).alias("passes"))


@query(f"WITH {ITEMS}, s AS (SELECT record_id, norm, unnest(range(1, length(norm) + 1)) AS p FROM items) SELECT record_id, count(*)::BIGINT AS n_spans FROM s WHERE substr(norm, p, 3) = 'the' GROUP BY 1")
def all_quote_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every place of a quote, overlapping ones too."""
    rows = S.items(spark, d).select("record_id", positions.all_spans(T.normalized(F.col("text")), "the").alias("spans"))
    return rows.select("record_id", F.size("spans").cast("long").alias("n_spans")).where("n_spans > 0")


ARTIFACTS = [
    ("ok", "甲公司回购100万股", "f1", "甲公司", 0, 3, "回购", 3, 5), ("quote", "甲公司回购100万股", "f1", "乙公司", 0, 3, "回购", 3, 5), ("order", "甲公司回购", "f2", "甲公司", 0, 3, "回购", 3, 5), ("subject", "回购100万股", "f1", None, None, None, "回购", 0, 2), ("predicate", "甲公司很好", "f1", "甲公司", 0, 3, None, None, None),
]
ARTIFACT_COLUMNS = {"record_id": "string", "text": "string", "fact_id": "string", "subject": "string", "ss": "int", "se": "int", "predicate": "string", "ps": "int", "pe": "int"}
_ISSUES = [("ok", ""), ("quote", "EVIDENCE_INVALID"), ("order", "IDS_NOT_SEQUENTIAL"), ("subject", "SUBJECT_UNRESOLVED"), ("predicate", "FACT_INCOMPLETE")]


@query(S.values({"record_id": "string", "issues": "string"}, _ISSUES, duck=True))
def fact_validation(spark: SparkSession, d: str) -> DataFrame:
    return validate.facts(S.literal(spark, ARTIFACT_COLUMNS, ARTIFACTS)).select("record_id", F.array_join("issues", ",").alias("issues"))


PROOFS = [("p1", "h1", True, 1, 1, True, True), ("p1", "h2", True, 0, 0, True, True), ("p2", "h1", True, 2, 1, True, True), ("p3", "h1", True, 1, 1, False, True), ("p4", "h1", False, 0, 0, True, True), ("p5", "h1", False, 0, 0, True, True), ("p5", "h2", True, 0, 0, True, True)]
PROOF_COLUMNS = {"pair_id": "string", "fact_id": "string", "aligned": "boolean", "n_history": "int", "n_current": "int", "same_polarity": "boolean", "same_modality": "boolean"}


@query(f"SELECT pair_id, bool_and(aligned AND n_history = n_current AND same_polarity AND same_modality) AS provable FROM ({S.values(PROOF_COLUMNS, PROOFS, duck=True)}) GROUP BY pair_id")
def equivalence_proof(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a pair prove equality if all are aligned, with as many numbers, the same polarity and the same modality."""
    return validate.provable(S.literal(spark, PROOF_COLUMNS, PROOFS))


SLOTS = [("r1", "f1", "price", "100"), ("r1", "f1", "price", "101"), ("r1", "f1", "volume", "5"), ("r1", "f2", "price", "7"), ("r2", "f1", "price", "9"), ("r2", "f1", "price", "9")]


SLOT_COLUMNS = {"record_id": "string", "fact_id": "string", "slot": "string", "value": "string"}


@query(f"SELECT record_id, fact_id, slot, count(DISTINCT value)::BIGINT AS n_values FROM ({S.values(SLOT_COLUMNS, SLOTS, duck=True)}) GROUP BY ALL HAVING count(DISTINCT value) > 1")
def slot_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return validate.contradictions(S.literal(spark, SLOT_COLUMNS, SLOTS))


GATES = [("verbatim", True, 100), ("paraphrase", True, 263), ("coverage", True, 10), ("dimension", False, 3)]


@query(S.values({"n_gates": "long", "n_passed": "long", "open": "boolean"}, [(4, 3, False)], duck=True))
def backfill_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = S.literal(spark, {"gate": "string", "ok": "boolean", "n": "int"}, GATES)
    return rows.agg(F.count("*").alias("n_gates"), F.sum(F.col("ok").cast("long")).alias("n_passed"), F.bool_and("ok").alias("open"))


@query("SELECT conv_id, turn, role, sha256(conv_id || '/' || turn) AS item_key FROM conversations")
def conversation_items(spark: SparkSession, d: str) -> DataFrame:
    """Turns as items: the conversation is the scope, the turn the arrival."""
    return S.table(spark, d, "conversations").select("conv_id", "turn", "role", F.sha2(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256).alias("item_key"))


@query("SELECT count(*)::BIGINT AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.text = b.text AND b.turn < a.turn")
def scoped_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Equal earlier texts within a scope."""
    from ..operators import recall

    rows = S.table(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"), "text", F.col("turn").alias("seq"), F.col("conv_id").cast("string").alias("scope_id"))
    items = rows.select("record_id", F.col("record_id").alias("item_id"), "text", (F.col("seq") + 1).alias("arrival_seq"), "scope_id", F.lit("").alias("business_date"))
    return recall.hash_channel(items).agg(F.count("*").alias("n"))


ANSWERS = [
    ("a", '```json\n{"verdict":"duplicate","evidence_a":["x"],"evidence_b":["y"]}\n```'), ("b", "no object"), ("c", '{"verdict":"duplicate","verdict":"not_duplicate"}'), ("e", '{"verdict":"maybe"}'), ("f", '{"verdict":"duplicate","evidence_a":[],"evidence_b":["y"]}'), ("g", 'Answer: {"verdict":"not_duplicate"} done'),
]
_ANSWERS = [("a", "duplicate", None), ("b", None, "NO_OBJECT"), ("c", "not_duplicate", "REPEATED_KEY"), ("e", "maybe", "VERDICT"), ("f", "duplicate", "EVIDENCE"), ("g", "not_duplicate", None)]


@query(S.values({"id": "string", "verdict": "string", "problem": "string"}, _ANSWERS, duck=True))
def judgment_answers(spark: SparkSession, d: str) -> DataFrame:
    return judgments.parse(S.literal(spark, {"id": "string", "answer": "string"}, ANSWERS)).select("id", "verdict", "problem")


@query("SELECT item_id, sha256(text) AS body_hash, min(origin) AS origin, count(*)::BIGINT AS n_copies FROM (SELECT doc_id::VARCHAR AS item_id, text, 'documents' AS origin FROM documents UNION ALL SELECT item_id::VARCHAR, text, 'benchmark' FROM benchmark) GROUP BY ALL")
def material_catalogue(spark: SparkSession, d: str) -> DataFrame:
    one = S.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("body"), F.lit("documents").alias("origin"))
    two = S.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("body"), F.lit("benchmark").alias("origin"))
    return gold.materials([one, two])


REVIEWS = [("p1", "x", "dup", True, 1, 2), ("p1", "y", "dup", True, 1, 3), ("p2", "x", "dup", True, 1, 2), ("p3", "x", "dup", True, 1, 2), ("p3", "y", "dup", False, 1, 2), ("p4", "x", "dup", True, 5, 2), ("p4", "y", "dup", True, 1, 2), ("p5", "x", "dup", True, 1, 2), ("p5", "y", "not", True, 1, 2)]


@query(S.values({"pair_id": "string", "problem": "string"}, [("p1", None), ("p2", "ONE_ANNOTATOR"), ("p3", "EVIDENCE_MISSING"), ("p4", "TIME_ORDER"), ("p5", "DISAGREEMENT")], duck=True))
def review_records(spark: SparkSession, d: str) -> DataFrame:
    columns = {"pair_id": "string", "annotator": "string", "label": "string", "has_evidence": "boolean", "at": "int", "reviewed_at": "int"}
    return gold.review_problems(S.literal(spark, columns, REVIEWS))
