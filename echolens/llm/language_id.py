"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded, stratified sample of labelled rows (``per_language`` documents of each language, whole texts)
and are summed on the executors. The log-probability matrix has one row for each language and BUCKETS columns, so its size
is set by the label set and not by the corpus; it is broadcast, and each Arrow batch is scored in numpy.

Texts of any length take one way: their n-grams are gone through in steps, each taking those that begin in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

SIZES = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.1
UNKNOWN = "und"
#: Characters of text that one step holds.
STEP = 1 << 20
#: Languages that a model may tell apart: a bound of the matrix that is broadcast, beyond which training is refused.
MOST_LANGUAGES = 400
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, owners) of all n-grams of the lower-cased texts with a blank at each end, STEP characters' at a time.

    owners: which text each belongs to, ascending in each step. An n-gram is given once, in the step where it begins.
    """
    made = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in made])
    flat, total, more = "".join(made), int(ends[-1]) if len(ends) else 0, max(SIZES) - 1
    for low in range(0, total, STEP):
        codes = np.frombuffer(flat[low : low + STEP + more].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        of = np.searchsorted(ends, np.arange(low, low + len(codes)), "right")
        buckets, owners = [], []
        for n in SIZES:
            m = min(len(codes) - n + 1, STEP)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ (codes[k : m + k] * _MULTIPLIERS[k])
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            inside = of[:m] == of[n - 1 : m + n - 1]
            buckets.append((h >> np.uint64(48)).astype(np.int64)[inside])
            owners.append(of[:m][inside])
        bucket, owner = np.concatenate(buckets), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        yield bucket[order], owner[order]


def runs(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters together; a longer text stands alone."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= limit):
            size += len(texts[high])
            high += 1
        yield low, high
        low = high


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) rows to (lang, bucket, n): the sums of a partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            into = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
            for bucket, _ in grams([text.as_py() or ""]):
                into += np.bincount(bucket, minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "bucket", "n"])


class Model:
    """Languages, their log priors and log probabilities."""

    def __init__(self, langs: list[str], priors: np.ndarray, logs: np.ndarray) -> None:
        self.langs, self.priors, self.logs = langs, priors, logs

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log posteriors up to a constant, a row for each text."""
        out = np.tile(self.priors, (len(texts), 1))
        for bucket, owner in grams(texts):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for k in range(len(self.langs)):
                out[owner[starts], k] += np.add.reduceat(self.logs[k][bucket], starts, dtype=np.float64)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; UNKNOWN with 0 for one without a letter. Ties: the first language in order of name."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        asked = [k for k, t in enumerate(texts) if _LETTER.search(t)]
        for low, high in runs([texts[k] for k in asked], STEP):
            got = self.scores([texts[k] for k in asked[low:high]])
            best = got.argmax(axis=1)
            post = 1 / np.exp(got - got.max(axis=1, keepdims=True)).sum(axis=1)
            for k, b, p in zip(asked[low:high], best, post, strict=True):
                langs[k], scores[k] = self.langs[b], p
        return langs, scores


def train(labelled: DataFrame, per_language: int = 2000) -> Model:
    """A model from rows (doc_id, text, lang). At most about ``per_language`` documents of each language are used, those
    whose hashed doc_id is smallest as a fraction; a language with fewer gives all it has. No labelled row: no languages.
    More than MOST_LANGUAGES different labels are refused: the matrix has a row for each."""
    labelled = labelled.where("lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS), np.float32))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / counts[k]))])
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = labelled.where(place < share[F.col("lang")]).select("text", "lang")
    sums = sample.mapInArrow(count_grams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix, row = np.full((len(langs), BUCKETS), SMOOTHING), {k: i for i, k in enumerate(langs)}
    if sums.num_rows:
        matrix[np.array([row[x] for x in sums.column("lang").to_pylist()]), sums.column("bucket").to_numpy()] += sums.column("n").to_numpy()
    logs = np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)
    total = sum(counts.values())
    return Model(langs, np.log(np.array([counts[k] / total for k in langs])), logs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; null or letterless texts are ``und`` with score 0.

    A prediction is a function of the text alone: repeated rows, and rows of equal texts, get equal ones. Ids may be null.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.priors, model.logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            langs, scores = known.predict([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's language. A null text is ``und``, a null doc_id is not held out; repeated rows each get theirs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang").withColumn("held_out", held_out("doc_id", 4))
    return identify(docs, train(docs.where(~F.col("held_out"))))
