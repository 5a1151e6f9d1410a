"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered from all training documents by pre-aggregated sums. The count c of a pair is
quantised to the level q = 1 + floor(log2 c), and the pair is put into the filter with each of 1..q; a reader probes 1, 2, ...
until one is missing, so a false positive costs at most a step, ever less likely, and a level stands for 2^(q-1), a count that
the pair surely has. The probability of word w after v is (c(vw) + K(v) * P(w)) / (c(v) + K(v)), that of a first word P(w), with
P(w) = (c(w) + 1) / (N + V + 1). K(v) = A * (c(v) + 1)^B stands for the number of words that follow v, which grows like that; A and B are
set by the likelihood of held-out documents (README).

The filter's size follows the corpus, so it is never in one place: it is dealt into segments by the pairs' hashes, as many as
keep a segment's share near SEGMENT_TOKENS training tokens, and is probed where it lies. Documents are taken together in chunks; a chunk sends each
segment its pairs with the rows that hold them, and each segment sends back a number for each row: log10 P(w|v) falls into
a part that the pair's segment finds, log10(c(vw) + K(v) * P(w)), and one that the chunk knows, -log10(c(v) + K(v)), so parts are
simply added. One shuffle carries the questions, one the answers; texts stay where they are.

The HEAD most frequent words and their exact counts are broadcast: a fixed size. Where there are more, other words ask the segment that
their own hash leads to, which holds their exact counts. Between words of the head, K(v) * P(w) is sent in steps of a
sixth of a power of two, rounded down. A pair with another word, or beyond the steps, asks its segment for the level alone and stays with the chunk,
where its logs are taken once all counts are there, exactly. So every count enters the model as it is, and the
probabilities after a context never add up to more than 1. Trigrams would add some 8 bytes a token to the questions and half as much to the counts, beyond the disk that is given (README).

Words are known by 64-bit hashes, pairs by 32 bits and their segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, buffers, discard, handed_back, held_out, materialize, mix64, table, word_hashes

#: The token that ends every document.
END = 0x1D3C5B79A8E6F402
HEAD = 1 << 20
A, B = 2.0, 0.85
#: Bits for each stored (pair, level) and probes: about 0.13 % of false positives.
BITS, PROBES = 14, 8
#: Bytes of text whose pairs are asked for together.
CHUNK_BYTES = 1 << 22
#: Training tokens for each segment, about.
SEGMENT_TOKENS = 1 << 21
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Steps of K(v) * P(w) to a power of two, and the least that one stands for.
_STEPS, _LEAST = 6, -30


def tokens(column: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds) of runs of rows, 2^16 at most; every row ends with END."""
    data, offsets = buffers(column)
    for first, last in blocks(offsets, limit):
        for low in range(first, last, 1 << 16):
            words, bounds = word_hashes(data, offsets[low : min(last, low + (1 << 16)) + 1], lower=True)
            yield low, np.insert(words, bounds[1:], np.uint64(END)), bounds + np.arange(len(bounds))


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix64(before * _PAIR + (after ^ np.uint64(0x2545F4914F6CDD1D)))


def adjacent(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of words that have a predecessor in their row."""
    inner = np.ones(len(words), bool)
    inner[bounds[:-1][bounds[:-1] < len(words)]] = False
    return np.flatnonzero(inner)


class Dealer:
    """Segments by the upper bits of a hash; pairs keep the 32 bits that follow."""

    def __init__(self, bits: int) -> None:
        self.bits = bits

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def key(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(32 - self.bits)).astype(np.uint32)


def dealer(total: int) -> Dealer:
    return Dealer(min(24, max(3, (max(total, 1) // SEGMENT_TOKENS).bit_length())))


class Flow:
    """Hashes of a partition, summed and handed on whenever ``most`` have come together."""

    def __init__(self, most: int = 1 << 21) -> None:
        self.most, self.held, self.size = most, [], 0

    def add(self, h: np.ndarray) -> bool:
        self.held.append(h)
        self.size += len(h)
        return self.size >= self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        return h, n


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (h, n)."""
    flow = Flow()
    give = lambda h, n: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
    for batch in handed_back(batches):
        for _, words, _ in tokens(batch.column(0), 1 << 21):
            if flow.add(words):
                yield give(*flow.take())
    if flow.size:
        yield give(*flow.take())


def _cuts(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments that occur in a sorted array, and where each begins (and the last ends)."""
    start = np.flatnonzero(np.append(True, segments[1:] != segments[:-1])) if len(segments) else np.zeros(0, np.int64)
    return segments[start], np.append(start, len(segments))


def pair_counter(deal: Dealer):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to (g, once, many, times): for each segment the keys of pairs counted once, and of others with counts."""

        def give(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            names, cut = _cuts(deal.segment(h))
            key, one = deal.key(h).astype("<u4"), n == 1
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                o = one[a:b]
                rows.append((key[a:b][o].tobytes(), key[a:b][~o].tobytes(), n[a:b][~o].astype("<i8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], ["g", "once", "many", "times"])

        flow = Flow()
        for batch in handed_back(batches):
            for _, words, bounds in tokens(batch.column(0), 1 << 21):
                at = adjacent(words, bounds)
                if flow.add(pair_hash(words[at - 1], words[at])):
                    yield give(*flow.take())
        if flow.size:
            yield give(*flow.take())

    return run


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, [(once, many, times)]) to (g, bits): a segment of the filter."""
    for batch in batches:
        for g, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            once, many, times = (np.frombuffer(b"".join(x.as_py() for x in parts.values.field(k)), kind) for k, kind in enumerate(("<u4", "<u4", "<i8")))
            keys, back = np.unique(np.concatenate([once, many]), return_inverse=True)
            n = np.bincount(back, np.concatenate([np.ones(len(once)), times]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([segment(keys, levels_of(n))], pa.binary())], ["g", "bits"])


def levels_of(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n), without rounding; 0 for 0."""
    return np.frexp(n.astype(np.float64))[1]


def probe(key: np.ndarray, level: int, k: int, size: np.ndarray) -> np.ndarray:
    """Place of probe ``k`` for a pair's level in a segment of ``size`` bits."""
    one = mix64(key.astype(np.uint64) ^ np.uint64(level * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
    two = (one >> np.uint64(17)) | np.uint64(1)
    return (one + np.uint64(k) * two) % size


def segment(key: np.ndarray, level: np.ndarray) -> bytes:
    """A segment with BITS bits for each entry."""
    size = max(1, -(-int(level.sum()) * BITS // 8)) * 8
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = key[level >= q]
        for k in range(PROBES):
            bits[probe(own, q, k, np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def levels_in(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Probe level after level until one is missing."""
    level, open_, size = np.zeros(len(key), np.int64), np.arange(len(key)), np.uint64(len(bits) * 8)
    if not size:
        return level
    for q in range(1, 64):
        for k in range(PROBES):
            at = probe(key[open_], q, k, size).astype(np.int64)
            open_ = open_[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
            if not len(open_):
                return level
        level[open_] = q
    return level


class Head:
    """Exact counts of the most frequent words."""

    def __init__(self, h: np.ndarray, n: np.ndarray, total: int, distinct: int) -> None:
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]
        self.bottom = float(np.log10(total + distinct + 1))
        #: What words outside have: no count, if the head holds all words, or one that only their segment knows.
        self.missing = -1 if distinct > len(h) else 0

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Exact counts; -1 for words that others may know."""
        if not len(self.h):
            return np.full(len(words), self.missing, np.int64)
        h = words.view(np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.n[at], self.missing)

    def logs(self, n: np.ndarray) -> np.ndarray:
        """log10 P(w) of words by their counts."""
        return np.log10(n.clip(0) + 1.0) - self.bottom


def pull(context: np.ndarray) -> np.ndarray:
    """K(v) by the count of v."""
    return A * (context + 1.0) ** B


def step_of(log10: np.ndarray) -> np.ndarray:
    """Steps; there are 256, from 0."""
    return np.floor(_STEPS * (log10 / np.log10(2) - _LEAST)).astype(np.int64)


#: What each step stands for.
_VALUES = 2.0 ** (np.arange(256) / _STEPS + _LEAST)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each led by its length."""
    return b"".join(x for a in arrays for x in (np.array([len(a)], "<u4").tobytes(), a.tobytes()))


def _unpack(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(data, "<u4", 1, at)[0])
        out.append(np.frombuffer(data, kind, n, at + 4))
        at += 4 + n * np.dtype(kind).itemsize
    return out


#: Distinct pairs of a chunk in a segment (key, step of K(v) * P(w), times), the rows of each; keys of pairs whose level is asked for; words outside the head.
_QUESTION = ("<u4", "u1", "u1", "<u2", "<u4", "<i8")
#: The segment; rows with the sum of their pairs' logs; levels and counts, in the order asked.
_ANSWER = ("<i8", "<u2", "<f4", "u1", "<i8")
#: A chunk's own part: id, whether there is one, tokens, known tokens, base score, score; words outside the head (row, which, whether first);
#: open pairs (row, which, count of either word, or -1 less which word outside the head it is).
_OWN = ("<i8", "u1", "<i8", "<i8", "<f8", "<f8", "<u2", "<u4", "u1", "<u2", "<u4", "<i8", "<i8")
_ROWS = "g int, chunk long, kind int, data binary"


def _row(g: int, chunk: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["g", "chunk", "kind", "data"])


def _sums(row: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, x, rows).astype(np.float64)


def questions(words: np.ndarray, bounds: np.ndarray, head: Head, deal: Dealer) -> tuple[list[tuple[int, bytes]], list[np.ndarray]]:
    """What a chunk asks of each segment; and tokens, known tokens, base score and score as far as the chunk knows them, by row."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(bounds))
    n = head.counts(words)
    inside, logs = n >= 0, head.logs(n)
    known = np.bincount(row[n > 0], minlength=rows)
    base = _sums(row[inside], logs[inside], rows)
    # words outside the head, in order of segment
    other, which = np.unique(words[~inside], return_inverse=True)
    of = deal.segment(mix64(other))
    order = np.argsort(of, kind="stable")
    other, of, which = other[order], of[order], np.argsort(order, kind="stable")[which]
    count = n.copy()
    count[~inside] = -1 - which
    at = adjacent(words, bounds)
    first = np.ones(len(words), bool)
    first[at] = False
    score = _sums(row[first & inside], logs[first & inside], rows)
    context = n[at - 1].clip(0)
    step = step_of(logs[at] + np.log10(pull(context)))
    h = pair_hash(words[at - 1], words[at])
    plain = inside[at - 1] & inside[at] & (step >= 0) & (step < 256)
    open_h, pair = np.unique(h[~plain], return_inverse=True)
    still = at[~plain]
    at, context, step, h = at[plain], context[plain], step[plain].astype(np.uint8), h[plain]
    score += _sums(row[at], -np.log10(context + pull(context)), rows)
    # pairs in order of segment and key; a pair of over 255 rows is named again for each 255
    order = np.argsort(h, kind="stable")
    h, of_row, second = h[order], row[at][order].astype("<u2"), step[order]
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    place = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    start = np.flatnonzero(place % 255 == 0)
    times = np.diff(np.append(start, len(h))).astype("u1")
    key, edge = deal.key(h[start]).astype("<u4"), np.append(start, len(h))
    spans = []
    for segments in (deal.segment(h[start]), deal.segment(open_h), of):
        names, cut = _cuts(segments)
        spans.append({int(g): (a, b) for g, a, b in zip(names, cut[:-1], cut[1:], strict=True)})
    open_key, other = deal.key(open_h).astype("<u4"), other.view(np.int64).astype("<i8")
    asked = []
    for g in sorted(set().union(*spans)):
        (a, b), (c, d), (e, f) = (x.get(g, (0, 0)) for x in spans)
        asked.append((g, _pack(key[a:b], second[start[a:b]], times[a:b], of_row[edge[a] : edge[b]] if b > a else of_row[:0], open_key[c:d], other[e:f])))
    return asked, [np.diff(bounds), known, base, score, row[~inside], which, first[~inside], row[still], pair, count[still - 1], count[still]]


def answer(g: int, data: bytes, bits: np.ndarray, h: np.ndarray, n: np.ndarray) -> bytes:
    """What a segment knows of a question: sums by row, levels and counts."""
    key, step, times, rows, open_key, word = _unpack(data, _QUESTION)
    got = levels_in(bits, key)
    log = np.log10(np.where(got > 0, 2.0 ** (got - 1), 0) + _VALUES[step])
    sums = np.bincount(rows, np.repeat(log, times)) if len(rows) else np.zeros(0)
    here = np.unique(rows)
    at = np.minimum(np.searchsorted(h, word), max(len(h) - 1, 0))
    c = np.where(h[at] == word, n[at], 0) if len(h) else np.zeros(len(word), np.int64)
    return _pack(np.array([g], "<i8"), here.astype("<u2"), sums[here].astype("<f4"), levels_in(bits, open_key).astype("u1"), c.astype("<i8"))


def closed(own: list[np.ndarray], answers: list[bytes], head: Head) -> list[np.ndarray]:
    """Tokens, known tokens, base score and score by row: a chunk's own part with all answers."""
    n_tokens, known, base, score, rows, which, first, pair_rows, pair, before, after = own
    # answers by segment: the order of the words and pairs asked for, and the same one each time for the sums
    parts = sorted((_unpack(data, _ANSWER) for data in answers), key=lambda x: int(x[0][0]))
    known, base, score = known.copy(), base.copy(), score.copy()
    for _, some, log, _, _ in parts:
        score[some] += log
    level, counts = (np.concatenate([np.zeros(0, np.int64), *(x[k].astype(np.int64) for x in parts)]) for k in (3, 4))
    c = counts[which]
    known += np.bincount(rows[c > 0], minlength=len(known))
    base += _sums(rows, head.logs(c), len(base))
    score += _sums(rows[first > 0], head.logs(c[first > 0]), len(score))
    v, w = before.astype(np.int64), after.astype(np.int64)
    for x in (v, w):
        x[x < 0] = counts[-1 - x[x < 0]]
    level = level[pair]
    log = np.log10(np.where(level > 0, 2.0 ** (level - 1), 0) + pull(v) * 10 ** head.logs(w)) - np.log10(v + pull(v))
    return [n_tokens, known, base, score + _sums(pair_rows, log, len(score))]


def scores(docs: DataFrame, segments: DataFrame, head: Head, deal: Dealer) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of the rows of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in handed_back(batches):
            for first, words, bounds in tokens(batch.column(1), CHUNK_BYTES):
                asked, own = questions(words, bounds, shared.value, deal)
                for g, data in asked:
                    yield _row(g, chunk, 1, data)
                ids = batch.column(0).slice(first, len(bounds) - 1)
                yield _row(chunk % (1 << deal.bits), chunk, 2, _pack(ids.fill_null(0).to_numpy().astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype("u1"), *(x.astype(kind) for x, kind in zip(own, _OWN[2:], strict=True))))
                chunk += 1

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of segment, its own (kind 0) first; chunks' own parts (kind 2) go on as they are."""
        held, bits, h, n = -1, np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in handed_back(batches):
            out: list[tuple[int, int, bytes]] = []
            for g, chunk, kind, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                data, kind = data.as_py(), kind.as_py()
                if kind == 0:
                    held, (bits, h, n) = g.as_py(), _unpack(data, ("u1", "<i8", "<i8"))
                elif kind == 2:
                    out.append((chunk.as_py(), 2, data))
                else:
                    if g.as_py() != held:  # a segment without any pair or word
                        held, bits, h, n = g.as_py(), bits[:0], h[:0], n[:0]
                    out.append((chunk.as_py(), 1, answer(g.as_py(), data, bits, h, n)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["chunk", "kind", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column(1):
                kind, data = parts.values.field("kind").to_pylist(), parts.values.field("data").to_pylist()
                ids, valid, *own = _unpack(data[kind.index(2)], _OWN)
                n_tokens, known, base, score = closed(own, [d for d, k in zip(data, kind, strict=True) if k == 1], shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), *map(pa.array, (n_tokens, known, base, score))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    asked = docs.select("doc_id", "text").mapInArrow(ask, _ROWS)
    both = asked.unionByName(segments.select("g", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("kind"), "data"))
    replied = both.repartition("g").sortWithinPartitions("g", "kind", "chunk").mapInArrow(reply, "chunk long, kind int, data binary")
    return replied.groupBy("chunk").agg(F.collect_list(F.struct("kind", "data")).alias("parts")).mapInArrow(add, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, training: DataFrame, tag: str = "lm") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    Learns from the texts of ``training``, all of them. Null and empty texts have the end token alone. Every row has a result of its
    own: repeated rows, and rows with null or repeated doc_ids, too; equal texts have equal scores. Without training rows every
    probability is 1 / (0 + 0 + 1), so scores are 0. The scan of ``docs`` must give its rows in the same order when a task is
    run again, as scans of files do.
    """
    single = materialize(training.select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), f"{tag}-words")
    size = single.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"] or 0, size["v"]
    most = single.orderBy(F.col("n").desc(), "h").limit(HEAD).select("h", "n").toArrow()
    head = Head(most.column("h").to_numpy(), most.column("n").to_numpy(), total, distinct)
    deal = dealer(total)
    tail = single.limit(0)
    if distinct > HEAD:
        last_n, last_h = most.column("n")[-1].as_py(), most.column("h")[-1].as_py()
        tail = single.where((F.col("n") < last_n) | ((F.col("n") == last_n) & (F.col("h") > last_h)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            g = deal.segment(mix64(h.view(np.uint64)))
            order = np.argsort(g, kind="stable")
            names, cut = _cuts(g[order])
            h, n = h[order], batch.column(1).to_numpy()[order]
            parts = [(h[a:b].astype("<i8").tobytes(), n[a:b].astype("<i8").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([x[k] for x in parts], pa.binary()) for k in (0, 1))], ["g", "h", "n"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(g, bits, [(h, n)]) to (g, data)."""
        for batch in batches:
            for g, bits, words in zip(*(batch.column(k) for k in range(3)), strict=True):
                h, n = (np.frombuffer(b"".join(words.values.field(k).to_pylist()) if words.is_valid else b"", "<i8") for k in (0, 1))
                order = np.argsort(h)
                data = _pack(np.frombuffer(bits.as_py() or b"", "u1"), h[order], n[order])
                yield pa.RecordBatch.from_arrays([pa.array([g.as_py()], pa.int32()), pa.array([data], pa.binary())], ["g", "data"])

    pairs = training.select("text").mapInArrow(pair_counter(deal), "g int, once binary, many binary, times binary")
    pairs = pairs.groupBy("g").agg(F.collect_list(F.struct("once", "many", "times")).alias("parts")).mapInArrow(_merge_pairs, "g int, bits binary")
    words = tail.mapInArrow(placed, "g int, h binary, n binary").groupBy("g").agg(F.collect_list(F.struct("h", "n")).alias("words"))
    segments = pairs.join(words, "g", "full").select("g", "bits", "words").mapInArrow(joined, "g int, data binary")
    segments = materialize(segments, f"{tag}-segments")
    discard(single)
    return scores(docs, segments, head, deal).select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's scores. A null text is an empty one, a null doc_id is not held out; repeated rows each get theirs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(docs, docs.where(~held_out("doc_id", 7)), tag="op3")
    return out.select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
