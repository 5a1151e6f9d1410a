"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are the leaves of binary tries. A node pair (P, Q) is joined by descending both sides together, adding one
differing bit whenever the sides turn apart, and is dropped once more than ``budget`` bits differ. To spread the work,
each fingerprint part is stored in ``budget + 1`` tries, one for each of its blocks turned to the front: two parts that
differ in at most ``budget`` bits agree in one block, so some trie holds them under one subtree root. Subtree roots are
the units of work. A unit may hold four times the leaves that an even spread gives it, up to LARGEST: its descent takes the frontier
in bounded pieces. One that holds more is replaced by its child pairs within the budget, only as many levels down as it takes, since
every level hands its leaves to more pairs; so no unit grows with the corpus, and nothing is capped or dropped.

Only distinct fingerprints take part, exact copies having been merged by a pre-aggregated minimum. Inside a unit the
links found are reduced to a minimum spanning forest by differing bits, which keeps every connection at every distance
without listing all pairs. Where a similarity is asked for, a link counts only if the shingle sets have it, unless the fingerprints
leave no doubt. There, fingerprints with an equal part are first linked to the smallest of them, which joins large groups of
copies; then the tries' node pairs are descended between clusters that are still apart, and pairs of nodes that lie in one cluster
are pruned as well. First this is done for each leaf's nearest link to another cluster. Only fingerprints that have such a link go
on: since clusters only grow, no other can get one. For them, more bits of fingerprint are made, which tell similarities
near the one asked for better apart, and nearest links are taken once more; then all links that are left between clusters. A pair
that several tries would find is listed by the first of them alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, handed_back, materialize, mix64, table

SEED = 42
#: Leaves of a unit, at most: some 30 MB in a task.
LARGEST = 1 << 17
#: Pairs of leaves that a descent looks at together, and links that it holds before it reduces them.
AT_ONCE, HELD = 1 << 19, 1 << 17


def shingle_hashes(text: bytes, size: int, distinct: bool) -> np.ndarray:
    """XXH64 of all word shingles of a lower-cased text; fewer words than ``size`` make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(len(words) - size + 1, 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends)), repeat(SEED)), np.uint64, n)
    return np.unique(hashes) if distinct else hashes


def majority_bits(hashes: np.ndarray, parts: int) -> np.ndarray:
    """``parts`` 64-bit words; a bit is 1 if it is set in over half the hashes. Words after the first use remixed hashes."""
    out = np.zeros(parts, np.uint64)
    n = len(hashes)
    for k in range(parts if n else 0):
        votes = np.zeros(64, np.int64)
        for low in range(0, n, 1 << 15):
            h = hashes[low : low + (1 << 15)]
            h = h if k == 0 else mix64(h ^ np.uint64(0xA24BAED4963EE407 * k & 0xFFFFFFFFFFFFFFFF))
            votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp): fp is binary, ``words`` big-endian 64-bit words. Null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handed_back(batches):
            fps = [majority_bits(shingle_hashes((t or "").encode("utf-8", "surrogatepass"), shingle, distinct), words).astype(">u8").tobytes() for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary")


# ---- units: node pairs of the tries --------------------------------------------------------------------------------

UNIT = ["trie", "depth", "a", "b", "used"]
ROWS = "trie int, depth int, a long, b long, used int, side int, node long, leaf long, root long, fp binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _parts(fps: np.ndarray, bits: int) -> np.ndarray:
    """(n, words) fingerprints cut into (n, parts) left-aligned 64-bit words of ``bits`` bits."""
    per = 64 // bits
    cols = [fps << np.uint64(bits * k) for k in range(per)]
    out = np.stack(cols, axis=2).reshape(len(fps), per * fps.shape[1])
    return out & np.uint64(((1 << bits) - 1) << (64 - bits))


def _rotate(x: np.ndarray, by: int, bits: int) -> np.ndarray:
    """Rotation within the upper ``bits`` bits."""
    if by == 0:
        return x
    keep = np.uint64(((1 << bits) - 1) << (64 - bits))
    return ((x << np.uint64(by)) | (x >> np.uint64(bits - by))) & keep


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(first bit, length) of budget + 1 blocks."""
    edges = [round(bits * k / (budget + 1)) for k in range(budget + 2)]
    return [(edges[k], edges[k + 1] - edges[k]) for k in range(budget + 1)]


def _words(column: pa.Array, words: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, words), np.uint64)
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[at[0] : at[-1]].view(">u8").astype(np.uint64).reshape(-1, words)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Trie:
    """How fingerprints of ``words`` 64-bit words are cut into parts, and which links count.

    rounds: how often they are cut, the bits being dealt anew into parts each time. further: words after these, which count for
    ``total`` alone. rooted: a last word names each node's cluster; all links between different clusters are listed, not a forest.
    nearest: of these only each leaf's nearest one in a unit. marked: leaves that have links, but none listed, are listed with themselves.
    """

    def __init__(self, words: int, bits: int, budget: int, total: int, step: int = 4, rooted: bool = False, nearest: bool = False, marked: bool = False, rounds: int = 1, further: int = 0) -> None:
        self.nearest, self.marked, self.held = nearest, marked, words + further
        self.words, self.bits, self.budget, self.total, self.step = words, bits, budget, total, step
        self.rooted, self.whole = rooted, self.held * 64 == bits
        self.blocks = _blocks(bits, budget)
        self.deals = [None, *(np.random.default_rng(r).permutation(words * 64) for r in range(1, rounds))]

    def parts(self, fps: np.ndarray) -> np.ndarray:
        """(n, words) fingerprints cut into (n, parts) left-aligned 64-bit words, all rounds' side by side."""
        out = []
        for deal in self.deals:
            if deal is not None:
                dealt = np.unpackbits(np.ascontiguousarray(fps.astype(">u8")).view(np.uint8).reshape(len(fps), 8 * self.words), axis=1)[:, deal]
                some = np.ascontiguousarray(np.packbits(dealt, axis=1)).view(">u8").astype(np.uint64)
            else:
                some = fps
            out.append(_parts(some, self.bits))
        return np.concatenate(out, axis=1)

    def units(self) -> int:
        """How many subtree roots all tries have together."""
        return len(self.deals) * (self.words * 64 // self.bits) * sum(1 << length for _, length in self.blocks)

    def roots(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each distinct fingerprint and trie: the self pair of the subtree root that it hangs under."""
        for batch in handed_back(batches):
            nodes, n = batch.column(0).cast(pa.int64()), batch.num_rows
            if not n:
                continue
            fps = _words(batch.column(1), self.held + self.rooted)
            root = pa.array(_signed(fps[:, -1])) if self.rooted else nodes
            held = pa.nulls(n, pa.binary()) if self.whole else pa.array([x[: 8 * self.held] for x in batch.column(1).to_pylist()], pa.binary())
            parts = self.parts(fps[:, : self.words])
            for p in range(parts.shape[1]):
                for k, (first, length) in enumerate(self.blocks):
                    leaf = _rotate(parts[:, p], first, self.bits)
                    prefix = pa.array(_signed(leaf >> np.uint64(64 - length)))
                    ints = lambda v: pa.array(np.full(n, v, np.int32))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([ints(p * len(self.blocks) + k), ints(length), prefix, prefix, ints(0), ints(2), nodes, pa.array(_signed(leaf)), root, held], NAMES)

    def split(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of units that hold too much, handed to the child pairs within the budget, as many levels down as the last column says."""
        for batch in batches:
            trie, depth, a, b, used, side = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            if not len(trie):
                continue
            leaf = batch.column(7).to_numpy().view(np.uint64)
            step = np.minimum(batch.column(10).to_numpy(), self.bits - depth)
            down = depth + step
            own = _signed(leaf >> (64 - down).astype(np.uint64))
            low = own & ((1 << step) - 1)
            for w in range(1 << self.step):
                cost = used + _popcount((low ^ w).astype(np.uint64))
                go = np.flatnonzero((w < (1 << step)) & (cost <= self.budget))
                if not len(go):
                    continue
                itself, left = side[go] == 2, side[go] == 0
                other = (np.where(left, b[go], a[go]) << step[go]) | w
                mine = own[go]
                ca = np.where(itself, np.minimum(mine, other), np.where(left, mine, other))
                cb = np.where(itself, np.maximum(mine, other), np.where(left, other, mine))
                sides = np.where(ca == cb, 2, np.where(ca == mine, 0, 1))
                sides = np.where(itself, sides, side[go])
                take = pa.array(go)
                yield pa.RecordBatch.from_arrays([pa.array(trie[go], pa.int32()), pa.array(down[go], pa.int32()), pa.array(ca), pa.array(cb), pa.array(cost[go], pa.int32()), pa.array(sides, pa.int32()), *(batch.column(k).take(take) for k in (6, 7, 8, 9))], NAMES)

    def join(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units, each with its leaves, to (a, b, far): a spanning forest of each unit's links, nearest first."""
        for batch in handed_back(batches):
            unit = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            leaves = batch.column(5)
            sizes = np.diff(leaves.offsets.to_numpy())
            row = 0
            while row < len(sizes):  # whole units, of a bounded number of leaves and of possible pairs together
                reach = np.cumsum(sizes[row:].astype(np.int64) * (sizes[row:] + 32))
                stop = row + max(1, int(np.searchsorted(reach, 1_000_000, "right")))
                some = leaves.slice(row, stop - row).flatten()
                of = np.repeat(np.arange(stop - row), sizes[row:stop])
                yield self._links(some, of, [x[row:stop] for x in unit])
                row = stop

    def _links(self, leaves: pa.StructArray, of: np.ndarray, unit: list[np.ndarray]) -> pa.RecordBatch:
        trie, depth, _, _, used = unit
        side, node, leaf, root = (leaves.field(k).to_numpy(zero_copy_only=False) for k in ("side", "node", "leaf", "root"))
        leaf = leaf.view(np.uint64)
        order = np.lexsort((leaf, side, of))
        side, node, leaf, of, root = side[order], node[order], leaf[order], of[order], root[order]
        fps = leaf[:, None] if self.whole else _words(leaves.field("fp"), self.held)[order]
        # a node is a run of sorted leaves; the frontier holds pairs of nodes and what they differ in so far
        first = np.searchsorted(of, np.arange(len(trie)))
        last = np.searchsorted(of, np.arange(len(trie)), "right")
        middle = first + np.bincount(of[side == 0], minlength=len(trie))
        both = np.array([side[f] == 2 if f < l else False for f, l in zip(first, last, strict=True)], bool)
        a0, a1 = first.copy(), np.where(both, last, middle)
        b0, b1 = np.where(both, first, middle), last.copy()
        diff, level = used.astype(np.int64), depth.astype(np.int64)
        # a run of leaves lies in one cluster if the cluster doesn't change within it
        turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])]) if len(root) else np.zeros(1, np.int64)
        inner = max(len(root) - 1, 0)
        links, found, size, ends = (np.zeros(0, np.int64),) * 3, [], 0, np.zeros(len(node), bool)
        waiting = [(a0, a1, b0, b1, diff, level)]
        while waiting:
            a0, a1, b0, b1, diff, level = waiting.pop()
            alive = (a1 > a0) & (b1 > b0) & (diff <= self.budget) & ~((a0 == b0) & (a1 - a0 < 2))
            af, al, bf, bl = (np.clip(x, 0, inner) for x in (a0, a1 - 1, b0, b1 - 1))
            if len(root):
                alive &= ~((turns[af] == turns[al]) & (turns[bf] == turns[bl]) & (root[af] == root[bf]))
            a0, a1, b0, b1, diff, level = (x[alive] for x in (a0, a1, b0, b1, diff, level))
            if not len(a0):
                continue
            times = (a1 - a0) * (b1 - b0)
            done = (times <= 32) | ((level >= self.bits) & (times <= AT_ONCE // 4))
            # as many as can be held at once; the others wait
            stop = max(1, int(np.searchsorted(np.cumsum(np.where(done, times, 32)), AT_ONCE, "right")))
            if stop < len(a0):
                waiting.append(tuple(x[stop:] for x in (a0, a1, b0, b1, diff, level)))
                a0, a1, b0, b1, diff, level, times, done = (x[:stop] for x in (a0, a1, b0, b1, diff, level, times, done))
            if done.any():  # the leaves below a small pair of nodes, all with all
                wide, times = (b1 - b0)[done], times[done]
                of_pair = np.repeat(np.arange(len(times)), times)
                place = np.arange(len(of_pair)) - np.repeat(np.cumsum(times) - times, times)
                p, q = a0[done][of_pair] + place // wide[of_pair], b0[done][of_pair] + place % wide[of_pair]
                near = (_popcount(leaf[p] ^ leaf[q]) <= self.budget) & (root[p] != root[q]) & ((p < q) | (a0 != b0)[done][of_pair])
                found.append(np.stack([p[near], q[near]]))
                size += found[-1].shape[1]
                if size > HELD:
                    links, found, size = self._reduced(links, found, node, fps, trie, of, ends), [], 0
            a0, a1, b0, b1, diff, level = (x[~done] for x in (a0, a1, b0, b1, diff, level))
            if not len(a0):
                continue
            # sides of equal leaves, which no bit parts, are halved
            whole = level >= self.bits
            bit = np.where(whole, 0, 63 - level).astype(np.uint64)
            am, bm = (np.where(whole, (low + high) >> 1, self._turn(leaf, low, high, bit)) for low, high in ((a0, a1), (b0, b1)))
            same, more = a0 == b0, np.where(whole, 0, 1)
            level = level + more
            pick = lambda lo, hi, lo2, hi2, more, mask=slice(None): tuple(x[mask] for x in (lo, hi, lo2, hi2, diff + more, level))  # noqa: E731, B023
            kids = [pick(a0, am, b0, bm, 0), pick(am, a1, bm, b1, 0), pick(a0, am, bm, b1, more), pick(am, a1, b0, bm, more, ~same)]
            waiting.append(tuple(np.concatenate(x) for x in zip(*kids, strict=True)))
        p, q, far = self._reduced(links, found, node, fps, trie, of, ends)
        if self.marked:
            ends[p] = ends[q] = False
            alone = np.flatnonzero(ends)
            p, q, far = np.concatenate([p, alone]), np.concatenate([q, alone]), np.concatenate([far, np.zeros(len(alone), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(node[p], pa.int64()), pa.array(node[q], pa.int64()), pa.array(far.astype(np.int32))], ["a", "b", "far"])

    def _reduced(self, links: tuple[np.ndarray, ...], found: list[np.ndarray], node: np.ndarray, fps: np.ndarray, trie: np.ndarray, of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(p, q, far): earlier ``links`` and those of the pairs ``found``, as far as they are listed; ``ends`` marks all leaves with links.

        What is listed of some links and of what others leave is what is listed of all together.
        """
        p, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        far = np.concatenate([links[0][:0], *(_popcount(fps[p[low : low + HELD]] ^ fps[q[low : low + HELD]]).sum(axis=1) for low in range(0, len(p), HELD))])
        near = (p != q) & (far <= self.total)
        p, q, far = p[near], q[near], far[near]
        if self.rooted:
            met, at = np.unique(np.concatenate([p, q]), return_inverse=True)
            own = self._own(self.parts(fps[met, : self.words]), at[: len(p)], at[len(p) :], trie[of[p]])
            p, q, far = p[own], q[own], far[own]
            ends[p] = ends[q] = True
        p, q, far = (np.concatenate(x) for x in zip(links, (p, q, far), strict=True))
        if not self.rooted:
            keep = self._forest(p, q, far, len(node))
        elif self.nearest:
            one, pair = np.concatenate([p, q]), np.tile(np.arange(len(p)), 2)
            order = np.lexsort((node[np.concatenate([q, p])], far[pair], one))
            keep = np.unique(pair[order[np.unique(one[order], return_index=True)[1]]])
        else:
            keep = slice(None)
        return p[keep], q[keep], far[keep]

    @staticmethod
    def _forest(p: np.ndarray, q: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
        """Places of links that span what all links connect, nearest first."""
        label, chosen = np.arange(n), [np.zeros(0, np.int64)]
        for level in np.unique(far):
            at = np.flatnonzero(far == level)
            while len(at := at[label[p[at]] != label[q[at]]]):
                # a link for each cluster that has one at this distance; two that say the same do no harm
                pick = at[np.unique(label[p[at]], return_index=True)[1]]
                chosen.append(pick)
                while True:
                    low = np.minimum(label[p[pick]], label[q[pick]])
                    new = label.copy()
                    np.minimum.at(new, label[p[pick]], low)
                    np.minimum.at(new, label[q[pick]], low)
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
        return np.concatenate(chosen)

    def _own(self, parts: np.ndarray, p: np.ndarray, q: np.ndarray, trie: np.ndarray) -> np.ndarray:
        """Which pairs are met in none of the tries before the given one: each pair of near leaves is so in just one of its tries."""
        part, block = trie // len(self.blocks), trie % len(self.blocks)
        own = np.ones(len(p), bool)
        for k in range(parts.shape[1]):
            differ = parts[p, k] ^ parts[q, k]
            own &= (k >= part) | (_popcount(differ) > self.budget)
            for j, (first, length) in enumerate(self.blocks):
                bits = np.uint64(((1 << length) - 1) << (64 - first - length))
                own &= (k != part) | (j >= block) | ((differ & bits) != 0)
        return own

    @staticmethod
    def _turn(leaf: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Where, within each sorted run, the given bit turns to 1: a binary search of all runs at once."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high) >> 1
            one = ((leaf[np.where(open_, mid, 0)] >> bit) & np.uint64(1)).astype(bool)
            high = np.where(open_ & one, mid, high)
            low = np.where(open_ & ~one, mid + 1, low)


def links(distinct: DataFrame, trie: Trie, tag: str, most: int = 2048) -> DataFrame:
    """Links (a, b, far) between the nodes of ``distinct`` (node, fp), all fingerprints being different: those that span what a part
    connects, or all between clusters, of at most ``trie.total`` differing bits (far) in the whole.

    ``most``: leaves that one unit may hold before it is split further, or more where the roots hold that many on average (see
    LARGEST); a memory bound, not a cap on links.
    """
    # a fingerprint becomes a row for each trie: spread evenly, however few files the fingerprints are in
    spread = distinct.select("node", "fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.mapInArrow(trie.roots, ROWS)
    out: DataFrame | None = None
    for depth in range(1, trie.bits + 2):
        rows = materialize(rows, f"{tag}-units{depth}") if depth > 1 else rows
        # units of one cluster have no links to list
        sizes = rows.groupBy(*UNIT).agg(F.count("*").alias("n"), F.min("side").alias("low"), F.max("side").alias("high"), (F.min("root") < F.max("root")).alias("apart")).where("apart and (low = 2 or low < high)")
        sizes = materialize(sizes.select(*UNIT, "n"), f"{tag}-sizes{depth}")
        if depth == 1:
            most = max(most, min(LARGEST, 4 * (sizes.agg(F.sum("n")).first()[0] or 0) // trie.units()))
        fits = (F.col("n") <= most) | (F.col("depth") >= trie.bits)
        small = rows.join(sizes.where(fits).drop("n"), UNIT)
        units = small.groupBy(*UNIT).agg(F.collect_list(F.struct("side", "node", "leaf", "root", "fp")).alias("leaves"))
        some = units.mapInArrow(trie.join, "a long, b long, far int")
        out = some if out is None else out.unionByName(some)
        large = sizes.where(~fits)
        if large.isEmpty():
            break
        levels = F.least(F.lit(trie.step), F.ceil(F.log2(F.col("n") / most)) + F.when(F.col("side") == 2, 1).otherwise(0))
        rows = rows.join(large, UNIT).select(*NAMES, levels.cast("long").alias("levels")).mapInArrow(trie.split, ROWS)
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return out.select(*ends, "far") if trie.rooted else out.groupBy(*ends).agg(F.min("far").alias("far"))


def stars(distinct: DataFrame, trie: Trie, tag: str) -> DataFrame:
    """(a, b, far): fingerprints with an equal part, each linked to the smallest node among them; ``trie.total`` bits differ at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = _parts(_words(batch.column(1), trie.words), trie.bits)
                for p in range(parts.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, p, np.int32)), pa.array(_signed(parts[:, p])), batch.column(0), batch.column(1)], ["part", "value", "node", "fp"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _popcount(_words(batch.column(2), trie.words) ^ _words(batch.column(3), trie.words)).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], ["a", "b", "far"]).filter(pa.array(far <= trie.total))

    rows = materialize(distinct.select("node", "fp").mapInArrow(cut, "part int, value long, node long, fp binary"), f"{tag}-parts")
    least = rows.groupBy("part", "value").agg(F.min(F.struct("node", "fp")).alias("least"), F.count("*").alias("n")).where("n > 1")
    least = materialize(least.select("part", "value", "least.node", "least.fp").toDF("part", "value", "low", "low_fp"), f"{tag}-least")
    both = rows.join(least, ["part", "value"]).where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"), F.col("low_fp").alias("x"), F.col("fp").alias("y"))
    return both.dropDuplicates(["a", "b"]).mapInArrow(measured, "a long, b long, far int")


def similar(edges: DataFrame, docs: DataFrame, shingle: int, least: float, tag: str) -> DataFrame:
    """Those of ``edges`` (a, b: doc_ids) whose sets of word shingles have a Jaccard similarity of ``least`` or more."""
    edges = materialize(edges.select("a", "b"), f"{tag}-open")
    wanted = edges.select(F.col("a").alias("doc_id")).unionByName(edges.select(F.col("b").alias("doc_id"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handed_back(batches):
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                sets = [shingle_hashes((t.as_py() or "").encode("utf-8", "surrogatepass"), shingle, True).view(np.int64) for t in some.column(1)]
                cut = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(cut, pa.array(np.concatenate(sets)))], ["node", "grams"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = materialize(texts.mapInArrow(run, "node long, grams array<long>"), f"{tag}-sets")
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b")


def extended(nodes: DataFrame, docs: DataFrame, shingle: int, words: int, further: int, distinct: bool) -> DataFrame:
    """``nodes`` (node, fp) with ``further`` words more in fp, made of the node's text."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(nodes.select(F.col("node").alias("doc_id")), "doc_id")
    longer = fingerprints(wanted.groupBy("doc_id").agg(F.min("text").alias("text")), shingle, words + further, distinct)
    after = longer.select(F.col("doc_id").alias("node"), F.substring("fp", 8 * words + 1, 8 * further).alias("after"))
    return nodes.join(after, "node").select("node", F.concat("fp", "after").alias("fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, bits: int = 64, budget: int = 2, rounds: int = 1, total: int | None = None, distinct: bool = False, similarity: float | None = None, sure: int = 0, further: int = 0, further_total: int = 0, tag: str = "simhash") -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    A fingerprint has ``words`` 64-bit words cut into parts of ``bits`` bits, ``rounds`` times. Two documents are linked if some part
    differs in at most ``budget`` bits and the whole in at most ``total`` (default: ``budget``). With a ``similarity``,
    links of more than ``sure`` bits stand only if the shingle sets have that Jaccard similarity; fingerprints with links between clusters
    get ``further`` words more, and ``further_total`` is the bound on bits for all words together. component_id is the smallest
    doc_id reachable over links. Null, empty and blank texts share fingerprint zero and are linked like any other.
    Rows with a null doc_id are returned with a null component. Repeated doc_ids are one node; where a similarity is asked for,
    the first of their texts in order stands for them. An empty table gives none.
    """
    trie = Trie(words, bits, budget, budget if total is None else total, rounds=rounds)
    prints = materialize(fingerprints(docs, shingle, words, distinct), f"{tag}-fps")
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), f"{tag}-nodes")
    if similarity is None:
        edges = links(nodes, trie, tag)
    else:
        every, first = nodes, materialize(stars(nodes, trie, tag), f"{tag}-stars")
        seen = first.select("a", "b")
        held = first.where(F.col("far") <= sure).select("a", "b").unionByName(similar(first.where(F.col("far") > sure), docs, shingle, similarity, tag))
        held = materialize(held, f"{tag}-held")
        root = F.unhex(F.lpad(F.hex(F.coalesce("root", "node")), 16, "0"))
        for turn, (marked, nearest) in enumerate([(True, True), (False, True), (False, False)]):
            part, more = f"{tag}-turn{turn}", 0 if marked else further
            near = Trie(words, bits, budget, further_total if more else trie.total, rooted=True, nearest=nearest, marked=marked, rounds=rounds, further=more)
            rooted = materialize(nodes.join(components(held, part), "node", "left").select("node", F.concat("fp", root).alias("fp")), f"{part}-rooted")
            listed = materialize(links(rooted, near, part), f"{part}-listed")
            if marked:
                nodes_left = listed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                nodes = materialize(extended(nodes.join(nodes_left, "node"), docs, shingle, words, further, distinct), f"{part}-nodes")
            new = materialize(listed.where("a <> b").join(seen, ["a", "b"], "left_anti"), f"{part}-links")
            certain = F.col("far") <= sure * near.held // words
            found = new.where(certain).select("a", "b").unionByName(similar(new.where(~certain), docs, shingle, similarity, part))
            held = materialize(held.unionByName(found), f"{part}-held")
            seen = seen.unionByName(new.select("a", "b"))
        nodes, edges = every, held
    roots = components(edges, tag)
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    named = materialize(named, f"{tag}-named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: 256 bits over distinct 5-word shingles, dealt twice into eight 32-bit parts. A Jaccard similarity of 0.8 of two sets of one
#: size is a cosine of 0.889, an angle of 0.151 of a half turn: 38.7 of 256 bits are expected to differ, give or take 5.7. Links of
#: up to 54 bits are looked at (2.7 deviations more); up to 12 bits (4.7 less) they are sure. One of sixteen parts differs in 3 bits
#: or fewer with a probability of 0.99. With twelve words more, 154.4 of 1,024 bits are expected to differ, give or take 11.5, and
#: links of up to 187 are looked at (2.9 deviations more).
NEAR = {"shingle": 5, "words": 4, "bits": 32, "budget": 3, "rounds": 2, "total": 54, "distinct": True, "similarity": 0.8, "sure": 12, "further": 12, "further_total": 187}


def one_of_each_group(docs: DataFrame, tag: str = "simhash-stage") -> DataFrame:
    """Documents without those that another document of their group stands for (the smallest doc_id stays).

    Five-word shingles, Jaccard similarity 0.8 or more (see NEAR). Blank documents aren't copies of each other and all stay,
    as do rows with a null doc_id; of rows that share a doc_id, all stay or go.
    """
    spoken = docs.where(F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    found = near_duplicates(spoken, **NEAR, tag=tag)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's fingerprint and component; null and blank texts have fingerprint zero, and repeated rows each get theirs."""
    found = near_duplicates(table(spark, sf_dir, "documents"), tag="op1")
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
