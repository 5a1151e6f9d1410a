"""Toxicity: a factorization machine over hashed terms.

Terms are words and word beginnings, hashed into BUCKETS. On a bounded, stratified sample of labelled rows the FEATURES
buckets that tell the classes apart best are kept; over these the machine learns a bias, linear weights and, by factors, a
weight for each pair, so two terms can mean more together than apart. Classes are weighted back to their true shares, which
keeps the scores probabilities. The model's size is fixed by the parameters; it is broadcast.

Only labels of the rows handed in as training rows are ever looked at, also in the counts of classes. Null, empty and blank
texts have no terms: their score is the bias alone, 0 to 1 like any other. Equal texts have equal scores, and repeated rows
each keep theirs. Ids are used for the choice of the sample alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE_LOWER, blocks, buffers, discard, free_name, handed_back, held_out, materialize, mix64, powers, table, with_columns_after

BUCKETS = 1 << 20
FEATURES = 4096
FACTORS = 6
#: Word beginnings, in bytes.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
#: Labelled documents of each class that are learnt from, at most (about).
PER_CLASS = 4000
THRESHOLD = 0.3
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets) of all words and then of all beginnings of each length."""
    low, high = int(offsets[0]), int(offsets[-1])
    text, at = data[low:high], offsets - low
    if not len(text):
        return
    gap = _GAP[text]
    fresh, last = np.ones(len(text), bool), np.ones(len(text), bool)
    fresh[1:], last[:-1] = gap[:-1], gap[1:]
    inner = at[(at > 0) & (at < len(text))]
    fresh[inner], last[inner - 1] = True, True
    starts, ends = np.flatnonzero(fresh & ~gap), np.flatnonzero(last & ~gap) + 1
    rows = np.searchsorted(at, starts, "right") - 1
    up, down = powers(len(text))
    prefix = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[text] * up[: len(text)], out=prefix[1:])
    for size in (0, *BEGINNINGS):
        long = np.ones(len(starts), bool) if size == 0 else ends - starts >= size
        s = starts[long]
        e = ends[long] if size == 0 else s + size
        h = mix64((prefix[e] - prefix[s]) * down[s] + np.uint64(size))
        yield rows[long], (h >> np.uint64(44)).astype(np.int64)


def pairs(column: pa.Array, place: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, row, feature, count) of runs of rows, a block of text at a time: each row of ``column`` is in one run.

    row (from 0 in its run) and feature are sorted; features are buckets, or their places where ``place`` has one. Only one
    block's terms are held at a time.
    """
    data, offsets = buffers(column)
    width = BUCKETS if place is None else len(place)
    for first, last in blocks(offsets):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows, bucket in terms(data, offsets[first : last + 1]):
            if place is not None:
                bucket = place[bucket]
                rows, bucket = rows[bucket >= 0], bucket[bucket >= 0].astype(np.int64)
            some, n = np.unique(rows * width + bucket, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield first, last, keys // width, keys % width, counts


class Machine:
    """place: bucket to feature or -1; bias, linear weights and factors."""

    def __init__(self, place: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> None:
        self.place, self.bias, self.linear, self.factors = place, bias, linear, factors

    def margin(self, row: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        x = np.log1p(count)
        out = self.bias + np.bincount(row, self.linear[feature] * x, n)
        for k in range(self.factors.shape[1]):
            vx = self.factors[feature, k] * x
            out += 0.5 * (np.bincount(row, vx, n) ** 2 - np.bincount(row, vx * vx, n))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, last, row, feature, count in pairs(column, self.place):
            out[first:last] = self.margin(row, feature, count, last - first)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(row: np.ndarray, feature: np.ndarray, count: np.ndarray, label: np.ndarray, weight: np.ndarray, place: np.ndarray, features: int, rounds: int = 200) -> Machine:
    """Weighted logistic loss by Adam over the whole (bounded) sample; ridge on weights and factors."""
    rng, n, m = np.random.default_rng(7), len(label), max(int(feature.max(initial=0)) + 1, 1)
    x = np.log1p(count)
    share = float((label * weight).sum() / weight.sum())
    p = {"bias": np.array([np.log((share + 1e-6) / (1 - share + 1e-6))]), "linear": np.zeros(m), "factors": rng.normal(0, 0.02, (m, FACTORS))}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = weight / weight.sum()
    add = lambda at, v, size: np.bincount(at, v, size)
    for step in range(1, rounds + 1):
        vx = p["factors"][feature] * x[:, None]
        s = np.stack([add(row, vx[:, k], n) for k in range(FACTORS)], axis=1)
        z = p["bias"] + add(row, p["linear"][feature] * x, n) + 0.5 * (s * s - np.stack([add(row, vx[:, k] ** 2, n) for k in range(FACTORS)], axis=1)).sum(axis=1)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight
        gx = g[row] * x
        grad = {"bias": np.array([g.sum()]), "linear": add(feature, gx, m) + 2e-5 * p["linear"]}
        pull = gx[:, None] * (s[row] - vx)
        grad["factors"] = np.stack([add(feature, pull[:, k], m) for k in range(FACTORS)], axis=1) + 2e-4 * p["factors"]
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            p[k] = p[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    linear, factors = np.zeros(features), np.zeros((features, FACTORS))
    linear[:m], factors[:m] = p["linear"], p["factors"]
    return Machine(place, float(p["bias"][0]), linear, factors)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES, tag: str = "toxicity") -> Machine:
    """A machine from ``docs`` (doc_id, text) and the labels (doc_id, toxic) of these documents, no others'.

    About ``per_class`` documents of each class are used, and the ``features`` best buckets. Repeated labels of a document
    count as toxic if one is. No label, or one class: a constant score.
    """
    none = Machine(np.full(BUCKETS, -1, np.int32), -20.0, np.zeros(features), np.zeros((features, FACTORS)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    labels = materialize(labels.join(docs.select("doc_id"), "doc_id", "left_semi"), f"{tag}-labels")
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return none
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = {k: min(1.0, per_class / v) for k, v in counts.items()}
    some = labels.where(place < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    # about 2 * per_class rows of two numbers: bounded by the parameter, and so is the sample, which is read several times
    sample = materialize(docs.join(F.broadcast(some), "doc_id").select("text", "toxic"), f"{tag}-sample")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int32)
        for batch in handed_back(batches):
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, row, bucket, _ in pairs(batch.column(0), None):
                toxic = label[first + row]
                for k in (0, 1):
                    np.add.at(n[k], bucket[toxic == k], 1)
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[1, at], pa.int64()), pa.array(n[0, at], pa.int64())], ["bucket", "pos", "neg"])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return none if not n1 else Machine(none.place, 20.0, none.linear, none.factors)
    sums = sample.mapInArrow(seen, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    far = F.abs(F.col("pos") / n1 - F.col("neg") / n0) / F.sqrt((F.col("pos") + F.col("neg") + 1) / (n1 + n0))
    best = sums.where("pos + neg >= 3").orderBy(far.desc(), "bucket").limit(features).select("bucket").collect()
    where = np.full(BUCKETS, -1, np.int32)
    where[[r["bucket"] for r in best]] = np.arange(len(best))
    shared = docs.sparkSession.sparkContext.broadcast(where)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, feature, count in pairs(batch.column(0), shared.value):
                cut = pa.array(np.searchsorted(row, np.arange(last - first + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(v, pa.int32())) for v in (feature, np.minimum(count, 1 << 30))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, last - first).cast(pa.int32()), *lists], ["toxic", "feature", "n"])

    label, length, feature, count = [], [], [], []
    for batch in sample.mapInArrow(kept, "toxic int, feature array<int>, n array<int>").toArrow().to_batches():
        label.append(batch.column(0).to_numpy().astype(float))
        length.append(np.diff(batch.column(1).offsets.to_numpy()))
        feature.append(batch.column(1).flatten().to_numpy())
        count.append(batch.column(2).flatten().to_numpy())
    label, length, feature, count = (np.concatenate(x) for x in (label, length, feature, count))
    discard(labels, sample)
    weight = np.where(label == 1, counts[1] / max((label == 1).sum(), 1), counts.get(0, 0) / max((label == 0).sum(), 1))
    return fit(np.repeat(np.arange(len(label)), length), feature.astype(np.int64), count.astype(np.int64), label, weight, where, features)


def scored(docs: DataFrame, machine: Machine, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 at THRESHOLD or more) to ``docs``, in place of columns of these names.

    Null texts count as empty. All other columns, whatever their names, are handed on as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.place, machine.bias, machine.linear, machine.factors))
    at, keep = docs.columns.index("text"), with_columns_after(docs.columns, [score, predicted])
    names = [docs.columns[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Machine(*shared.value)
        for batch in handed_back(batches):
            value = known.score(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], [*names, score, predicted])

    schema = ", ".join(f"`{docs.schema[k].name}` {docs.schema[k].dataType.simpleString()}" for k in keep) + f", `{score}` double, `{predicted}` int"
    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id", 4)).select("doc_id", "text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's score. A null text is scored as an empty one, a null doc_id is not held out; repeated rows each get theirs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    machine = train(training_rows(docs), table(spark, sf_dir, "labels"), tag="op5")
    ready = docs.select("doc_id", held_out("doc_id", 4).alias("held_out"), "text")
    return scored(ready, machine).select("doc_id", "held_out", "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those scored THRESHOLD or more by a machine learnt from the labelled rows that aren't held out.

    Empty and null texts are scored like any other; an empty table stays one; repeated rows stay or go together.
    """
    score, predicted = free_name(docs.columns, "score"), free_name(docs.columns, "predicted")
    return scored(docs, train(training_rows(docs), labels, tag="toxicity-stage"), score, predicted).where(F.col(predicted) == 0).select(*docs.columns)
