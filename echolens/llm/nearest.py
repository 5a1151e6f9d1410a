"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks quantise the halves of a vector separately, so an entry's cell is a pair of centroids. A query scores the
centroids of each half and takes pairs in order of their summed inner product, with a heap, until the cells taken hold
enough entries; those are reranked exactly, in double precision.

Codebooks are learnt from a bounded sample. Cells are packed into blocks of a bounded number of entries, a larger cell
being split over several, and a query is sent once to each block that holds cells it takes. Equal vectors are searched
once, and of equal entries only those that can be among the nearest are stored: k + 1, the smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Vectors that the codebooks are learnt from, at most (about).
SAMPLE = 20_000
#: Entries in the cells that a query takes, at least: the larger of a number and a share of all.
TAKE, TAKE_SHARE = 2_000, 0.4
BLOCK = 20_000
MOST_CENTROIDS = 128


def usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def centroids(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from a spread-out start; an empty cluster keeps its centre."""
    k = min(k, len(points))
    rng = np.random.default_rng(11)
    at = [int(rng.integers(len(points)))]
    far = ((points - points[at[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        at.append(int(rng.choice(len(points), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(points))))
        far = np.minimum(far, ((points - points[at[-1]]) ** 2).sum(axis=1))
    c = points[at].copy()
    for _ in range(rounds):
        own = nearest_centroid(points, c)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, points[:, d], k) for d in range(points.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_centroid(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * points @ c.T).argmin(axis=1)


class MultiIndex:
    """Codebooks of both halves, entries of each cell, and the blocks that hold them."""

    def __init__(self, one: np.ndarray, two: np.ndarray) -> None:
        self.one, self.two, self.half = one, two, one.shape[1]
        self.count = np.zeros(len(one) * len(two), np.int64)
        self.first, self.split = self.count.copy(), self.count.copy()

    def cells(self, v: np.ndarray) -> np.ndarray:
        return nearest_centroid(v[:, : self.half], self.one) * len(self.two) + nearest_centroid(v[:, self.half :], self.two)

    def pack(self, count: np.ndarray) -> None:
        """Blocks: neighbouring cells together up to BLOCK entries, larger ones split."""
        self.count = count
        block, room = 0, BLOCK
        for cell in np.flatnonzero(count):
            n = int(count[cell])
            if n > room and room < BLOCK:
                block, room = block + 1, BLOCK
            self.first[cell], self.split[cell] = block, max(1, -(-n // BLOCK))
            if self.split[cell] > 1:
                block, room = block + int(self.split[cell]), BLOCK
            else:
                room -= n

    def taken(self, q: np.ndarray, enough: int) -> list[int]:
        """Cells in order of their centroids' summed inner product with ``q``, until they hold ``enough`` entries."""
        a, b = self.one @ q[: self.half], self.two @ q[self.half :]
        i, j = np.argsort(-a), np.argsort(-b)
        # row x of the sorted table opens when row x - 1 gives its first pair, and then gives its pairs in order
        grid = (i[:, None] * len(self.two) + j[None, :]).tolist()
        a, b, count = (-a[i]).tolist(), (-b[j]).tolist(), self.count.tolist()
        heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
        while heap and held < enough:
            _, x, y = heap[0]
            if y + 1 < len(b):
                heapq.heapreplace(heap, (a[x] + b[y + 1], x, y + 1))
            else:
                heapq.heappop(heap)
            if y == 0 and x + 1 < len(a):
                heapq.heappush(heap, (a[x + 1] + b[0], x + 1, 0))
            if n := count[grid[x][y]]:
                out.append(grid[x][y])
                held += n
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit(vectors: DataFrame, dim: int, n: int) -> MultiIndex:
    share = min(1.0, SAMPLE / max(n, 1))
    some = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("embedding").toArrow().combine_chunks()
    points = np.concatenate([matrix(x, dim) for x in some.column("embedding").chunks] or [np.zeros((0, dim))])
    points = points if len(points) else np.zeros((1, dim))
    k, half = int(np.clip(np.sqrt(n), 4, MOST_CENTROIDS)), dim // 2
    return MultiIndex(centroids(points[:, :half], k), centroids(points[:, half:], k))


def search(vectors: DataFrame, is_query: Column, k: int = 20, tag: str = "nearest") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) where ``is_query``, the k rows found
    with the largest inner product, its own id left out, ties to the smaller id; all of them where there are fewer.

    Rows with a null id, and vectors that are null, zero, of another length than most, or that hold null or non-finite
    components take no part. Repeated (id, vector) rows count once. Different vectors of one id are entries and queries of
    their own: each has a list under that id, without the id's other vectors. Components may be float or double.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asked")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    length = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, kind = length["d"], good.schema["embedding"].dataType.elementType.simpleString()
    good = good.where(F.size("embedding") == dim).dropDuplicates(["vec_id", "embedding"])
    entries = good.withColumn("copy", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("copy") <= k + 1)
    entries = materialize(entries.select("vec_id", "embedding"), f"{tag}-entries")
    asked = good.where("asked").select(F.col("vec_id").alias("query_id"), "embedding")
    heads = asked.groupBy("embedding").agg(F.min("query_id").alias("head"))
    heads = materialize(heads, f"{tag}-heads")
    n = entries.count()
    index = fit(entries, dim, n)
    shared = spark.sparkContext.broadcast(index)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.cells(matrix(batch.column(1), dim)).astype(np.int32))], ["vec_id", "embedding", "cell"])

    entries = materialize(entries.mapInArrow(placed, f"vec_id long, embedding array<{kind}>, cell int"), f"{tag}-placed")
    count = np.zeros(len(index.one) * len(index.two), np.int64)
    for row in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MOST_CENTROIDS squared
        count[row["cell"]] = row["n"]
    index.pack(count)
    ready = spark.sparkContext.broadcast(index)
    enough = max(TAKE, int(TAKE_SHARE * n))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with their block: one of those of their cell, by id."""
        for batch in batches:
            cell, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            block = ready.value.first[cell] + ids % np.maximum(ready.value.split[cell], 1)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", "vec_id", "embedding", "cell"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to each block that holds a cell they take, with those cells."""
        known = ready.value
        for batch in batches:
            for row, q in enumerate(matrix(batch.column(0), dim)) if batch.num_rows else ():
                cells = np.array(known.taken(q, enough))
                times = known.split[cells]
                block = np.repeat(known.first[cells], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                order = np.argsort(block, kind="stable")
                block, cells = block[order], np.repeat(cells, times)[order]
                names, start = np.unique(block, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array([*start, len(cells)], pa.int32()), pa.array(cells, pa.int32()))
                take = pa.array(np.full(len(names), row))
                yield pa.RecordBatch.from_arrays([pa.array(names), batch.column(1).take(take), batch.column(0).take(take), lists], ["block", "head", "embedding", "cells"])

    # routing is a heap walk for each query: spread evenly, however few files the queries are in
    spread = heads.select("embedding", "head").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    queries = materialize(spread.mapInArrow(routed, f"block long, head long, embedding array<{kind}>, cells array<int>"), f"{tag}-routed")
    # a block that many queries reach is searched by several tasks, each with a part of them
    busy = queries.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("turns"))
    there = entries.mapInArrow(blocked, f"block long, vec_id long, embedding array<{kind}>, cell int").join(busy, "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    came = queries.join(busy, "block").withColumn("turn", F.pmod(F.hash("head"), "turns")).drop("turns")

    def rerank(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            mine = mine.sort_values("vec_id")
            v, ids = np.stack(mine["embedding"].to_numpy()).astype(np.float64), mine["vec_id"].to_numpy()
            names, cell = np.unique(mine["cell"].to_numpy(), return_inverse=True)
            for low in range(0, len(theirs), 128):
                some = theirs.iloc[low : low + 128]
                score = np.stack(some["embedding"].to_numpy()).astype(np.float64) @ v.T
                taken = np.stack([np.isin(names, c) for c in some["cells"]])
                score[~taken[:, cell]] = -np.inf
                for head, s in zip(some["head"], score, strict=True):
                    edge = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else -np.inf
                    at = np.flatnonzero((s >= edge) & (s > -np.inf))
                    at = at[np.argsort(-s[at], kind="stable")][: k + 1]
                    out.append(pd.DataFrame({"head": head, "vec_id": ids[at], "score": s[at]}))
        return pd.concat(out) if out else pd.DataFrame({"head": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = there.groupBy("block", "turn").cogroup(came.groupBy("block", "turn")).applyInPandas(rerank, "head long, vec_id long, score double")
    order = [F.col("score").desc(), F.col("vec_id")]
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy(*order))).where(F.col("place") <= k + 1)
    lists = best.groupBy("head").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))
    own = asked.join(heads, "embedding").join(lists, "head").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every row whose vec_id is divisible by 20, among all rows (see ``search`` for rows that take no part)."""
    return search(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), tag="op10")
