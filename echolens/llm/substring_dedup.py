"""Substring deduplication by prefix-partitioned suffix trees.

Every word position with WINDOW words ahead starts a suffix, read to a depth of WINDOW words. Suffixes are dealt out by prefix, and
those that share one meet in one place, where they are sorted by their words and the common lengths of neighbours are taken:
a subtree in order. Runs of neighbours that have WINDOW words or more in common are its deep internal nodes; the suffixes of a node
outside its smallest document are repeats, and repeats that touch in a document make up its maximal repeats.

Two things keep the subtrees few. Of documents with one word sequence only the smallest takes part; the others are repeats
throughout. And a suffix can only reach a deep node if a passage in it is in another document too: the anchor of a suffix is the
passage of SAMPLE words in its window with the smallest hash, the first of equals. Equal windows have equal anchors in equal
places, so suffixes are kept by anchor, and only those whose anchor is in two documents take part. The suffixes of one anchor
begin within WINDOW - SAMPLE words before it, so one record of words holds them all.

The prefix that deals a record out is the beginning of its anchor, as long as it takes: of the lengths PREFIXES the first that no more
than MOST suffixes share. Records whose whole anchor is shared by more are dealt out by document besides; the records that
hold the first document of a window, found by a pre-aggregated minimum, then go to every part, so each part's nodes know their
smallest document. So a subtree holds about MOST suffixes, whatever repeats.

Words are known by 48 bits of a hash, in the order of which suffixes are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, buffers, discard, materialize, range_hash, row_key, table, word_hashes

WINDOW, SAMPLE = 50, 20
#: Words of the anchor that deal records out, shortest first; the last is the whole anchor.
PREFIXES = (2, 5, 10, SAMPLE)
#: Suffixes of one subtree, about.
MOST = 50_000
WORD_BYTES = 6
#: Bits of the map of documents that are read again: a fixed size; a false hit costs some shuffle and nothing else.
MAP_BITS = 1 << 23
NOTHING = hashlib.sha256(b"").hexdigest()


def windows(words: np.ndarray, bounds: np.ndarray, window: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, rows, anchors, hashes): the windows of the rows, where their anchors begin, and the anchors' hashes."""
    starts = np.arange(max(len(words) - window + 1, 0))
    rows = np.searchsorted(bounds, starts, "right") - 1
    whole = starts + window <= bounds[rows + 1]
    if not whole.any():
        return starts[:0], rows[:0], starts[:0], np.zeros(0, np.uint64)
    at = np.arange(len(words) - sample + 1)
    passage, have, need = range_hash(words, at, at + sample), 1, window - sample + 1
    while have < need:  # the first of the smallest among twice as many, until all passages of a window are in
        step = min(have, need - have)
        one, two = at[: len(at) - step], at[step:]
        at = np.where(passage[one] <= passage[two], one, two)
        have += step
    at = at[: len(starts)][whole]
    return starts[whole], rows[whole], at, passage[at]


def sorted_suffixes(suffixes: np.ndarray, word_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of rows of bytes: their order by words, and how many words each has in common with the one before it."""
    n, width = suffixes.shape
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{width}").ravel(), kind="stable")
    common = np.zeros(n, np.int64)
    for low in range(1, n, 1 << 16):
        here = suffixes[order[low - 1 : low + (1 << 16)]]
        other = here[1:] != here[:-1]
        common[low : low + len(other)] = np.where(other.any(axis=1), other.argmax(axis=1), width) // word_bytes
    return order, common


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of sorted suffixes below an internal node of ``depth`` or more, half-open: two suffixes at least."""
    inside = np.concatenate([common >= depth, [False]])
    inside[0] = False
    first = np.flatnonzero(~inside[:-1] & inside[1:])
    last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return first, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Windows:
    def __init__(self, window: int, sample: int, prefixes: tuple[int, ...]) -> None:
        self.window, self.sample, self.prefixes = window, sample, prefixes

    def survey(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, k, text) to (doc_id, k, n_words, one, two, sha, anchors)."""
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for first, last in blocks(offsets):
                words, bounds = word_hashes(data, offsets[first : last + 1], lower=False)
                _, rows, _, anchors = windows(words, bounds, self.window, self.sample)
                cut = np.searchsorted(rows, np.arange(last - first + 1))
                lists = [np.unique(anchors[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                one = range_hash(words, bounds[:-1], bounds[1:])
                two = range_hash(words ^ np.uint64(0x5851F42D4C957F2D), bounds[:-1], bounds[1:])
                sha = [hashlib.sha256(b" ".join(data[a:b].tobytes().split())).hexdigest() for a, b in zip(offsets[first:last], offsets[first + 1 : last + 1], strict=True)]
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), _signed(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(np.diff(bounds)), _signed(one), _signed(two), pa.array(sha), flat], ["doc_id", "k", "n_words", "one", "two", "sha", "anchors"])

    def records(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, k, text, wanted) to (k, doc_id, pos, n, words, p0, p1, ...), one row for each wanted anchor.

        pos: the place of the first suffix of the anchor; n: how many follow one another from there; words: those of all.
        """
        names = ["k", "doc_id", "pos", "n", "words", *(f"p{j}" for j in range(len(self.prefixes)))]
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for first, last in blocks(offsets):
                words, bounds = word_hashes(data, offsets[first : last + 1], lower=False)
                starts, rows, at, anchors = windows(words, bounds, self.window, self.sample)
                go = np.zeros(len(starts), bool)
                cut = np.searchsorted(rows, np.arange(last - first + 1))
                for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    go[a:b] = np.isin(anchors[a:b], batch.column(3)[first + r].values.to_numpy().view(np.uint64))
                starts, rows, at = starts[go], rows[go], at[go]
                head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))) if len(at) else np.zeros(0, np.int64)
                n = np.diff(np.append(head, len(at)))
                low, row = starts[head], rows[head]
                high = low + n + self.window - 1
                raw = words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
                held = pa.array([raw[a:b] for a, b in zip((low * WORD_BYTES).tolist(), (high * WORD_BYTES).tolist(), strict=True)], pa.binary())
                take = pa.array(first + row)
                prefixes = [_signed(range_hash(words, at[head], at[head] + p)) for p in self.prefixes]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(0).take(take), pa.array((low - bounds[row]).astype(np.int32)), pa.array(n.astype(np.int32)), held, *prefixes], names)

    def spread(self, n: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffixes, record, offset): all suffixes of the records, a row of bytes each."""
        width, out = self.window * WORD_BYTES, []
        for data in words:
            flat = np.frombuffer(data, np.uint8)
            out.append(np.lib.stride_tricks.sliding_window_view(flat, width)[::WORD_BYTES])
        record = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
        return np.concatenate(out) if out else np.zeros((0, width), np.uint8), record, offset

    def named(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, doc_id, pos, n, words) to (one, two, doc_id, k, pos): 128 bits for each suffix, with the record it is in."""
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                n = some.column(3).to_numpy()
                suffixes, record, _ = self.spread(n, some.column(4).to_pylist())
                both = np.frombuffer(b"".join(hashlib.md5(x.tobytes()).digest() for x in suffixes), np.int64).reshape(-1, 2)
                take = pa.array(record)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), some.column(1).take(take), some.column(0).take(take), some.column(2).take(take)], ["one", "two", "doc_id", "k", "pos"])

    def subtrees(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records in order of (level, prefix, part) to (k, start): the suffixes below deep nodes, but for those of a node's first document."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(j).to_numpy().astype(np.int64) for j in (5, 6, 7)])
            cut = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for a, b in zip(cut, np.append(cut[1:], batch.num_rows), strict=True):
                name = tuple(key[:, a])
                if name != last and held:
                    yield self.repeats_of(held)
                    held = []
                last = name
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield self.repeats_of(held)

    def repeats_of(self, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """One subtree."""
        rows = pa.Table.from_batches(held).combine_chunks()
        n, docs = rows.column("n").to_numpy(), rows.column("doc_id").to_numpy()
        suffixes, record, offset = self.spread(n, rows.column("words").to_pylist())
        order, common = sorted_suffixes(suffixes, WORD_BYTES)
        first, last = deep_nodes(common, self.window)
        node = np.repeat(np.arange(len(first)), last - first)
        leaves = order[np.repeat(first, last - first) + np.arange(len(node)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)]
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, node, docs[record[leaves]])
        found = leaves[docs[record[leaves]] > least[node]]
        start = rows.column("pos").to_numpy()[record[found]] + offset[found]
        k = rows.column("k").combine_chunks() if isinstance(rows.column("k"), pa.ChunkedArray) else rows.column("k")
        return pa.RecordBatch.from_arrays([pa.array(k.take(pa.array(record[found])).to_pylist(), pa.binary()), pa.array(start.astype(np.int32))], ["k", "start"])

    def remains(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, text, starts of repeats) to (k, n_removed, sha, spans); spans are maximal repeats, in words, half-open."""
        for batch in batches:
            removed, shas, spans = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                turn = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts.values.to_numpy())
                np.add.at(turn, at, 1)
                np.add.at(turn, at + self.window, -1)
                gone = np.cumsum(turn)[:-1] > 0
                shas.append(hashlib.sha256(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])).hexdigest())
                removed.append(int(gone.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append(edge.reshape(-1, 2).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["k", "n_removed", "sha", "spans"])


def _listed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` that a fixed-size bit map of the keys lets through: all that ``keys`` has and few others."""
    place = F.pmod(F.hash("k"), F.lit(MAP_BITS))
    got = keys.select(F.shiftright(place, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32))).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 32, np.int64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bits.astype("<u4").view(np.uint8), bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = shared.value[batch.column(3).to_numpy()].astype(bool)
            yield batch.select([0, 1, 2]).filter(pa.array(here))

    return docs.select("doc_id", "k", "text", place.alias("place")).mapInArrow(run, "doc_id long, k binary, text string")


def repeats(docs: DataFrame, window: int = WINDOW, sample: int = SAMPLE, prefixes: tuple[int, ...] = PREFIXES, most: int = MOST, tag: str = "substring") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for every row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller doc_id. spans: the maximal
    repeats that go, in words. Null texts have no words. Rows without a doc_id are returned whole and make nothing else go.
    Rows are told apart by 128 bits of id and text, so repeated rows get the same result and don't repeat each other, nor do
    different texts of one doc_id. An empty table gives none. ``prefixes``: the last must be ``sample``.
    """
    step = Windows(window, sample, prefixes)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", row_key("doc_id"))
    survey = keyed.select("doc_id", "k", "text").mapInArrow(step.survey, "doc_id long, k binary, n_words long, one long, two long, sha string, anchors array<long>")
    survey = materialize(survey, f"{tag}-survey")
    long = survey.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = long.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # tables of their own: the joins' exchanges then stand alone, and adaptive execution can split what is everywhere
    firsts = materialize(firsts.where("first < last").drop("last"), f"{tag}-firsts")
    copies = long.select("k", "doc_id", "one", "two").join(firsts, ["one", "two"]).where("doc_id > first").select("k").distinct()
    copies = materialize(copies, f"{tag}-copies")
    own = long.join(copies, "k", "left_anti").select("k", "doc_id", F.explode("anchors").alias("anchor"))
    shared = own.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = materialize(shared, f"{tag}-shared")
    lists = materialize(own.select("k", "anchor").join(shared, "anchor").groupBy("k").agg(F.collect_set("anchor").alias("wanted")), f"{tag}-lists")
    texts = _listed(keyed, lists.select("k")).join(lists, "k").dropDuplicates(["k"])
    names = [f"p{j}" for j in range(len(prefixes))]
    records = texts.select("doc_id", "k", "text", "wanted").mapInArrow(step.records, "k binary, doc_id long, pos int, n int, words binary, " + ", ".join(f"{p} long" for p in names))
    records = materialize(records, f"{tag}-records")
    level, dealt, made = F.lit(len(prefixes)), records, []
    for j, p in reversed(list(enumerate(names))):
        crowded = materialize(records.groupBy(p).agg(F.sum("n").alias(f"n{j}")).where(F.col(f"n{j}") > most), f"{tag}-crowded{j}")
        made.append(crowded)
        dealt = dealt.join(crowded, p, "left")
        level = F.when(F.col(f"n{j}").isNull(), F.lit(j)).otherwise(level)
    prefix = F.coalesce(*[F.when(level == j, F.col(p)) for j, p in enumerate(names)], F.col(names[-1]))
    dealt = dealt.select("k", "doc_id", "pos", "n", "words", level.alias("level"), prefix.alias("prefix"), F.ceil(F.col(f"n{len(names) - 1}") / most).cast("int").alias("parts"))
    hot = dealt.where(F.col("level") == len(prefixes))
    plain = dealt.where(F.col("level") < len(prefixes)).select("k", "doc_id", "pos", "n", "words", "level", "prefix", F.lit(0).alias("part"))
    if not made[0].isEmpty():
        hot = materialize(hot, f"{tag}-hot")
        many = hot.select("k", "doc_id", "pos", "n", "words").mapInArrow(step.named, "one long, two long, doc_id long, k binary, pos int")
        leads = many.groupBy("one", "two").agg(F.min(F.struct("doc_id", "k", "pos")).alias("low"), F.max("doc_id").alias("high")).where("low.doc_id < high").select("low.k", "low.pos").distinct()
        leads = materialize(leads, f"{tag}-leads")
        parts = hot.select("k", "doc_id", "pos", "n", "words", "level", "prefix", F.pmod(F.hash("k"), "parts").alias("part"))
        everywhere = hot.join(leads, ["k", "pos"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(F.col("part") != F.pmod(F.hash("k"), "parts"))
        plain = plain.unionByName(parts).unionByName(everywhere.select(parts.columns))
        made += [hot, leads]
    ordered = plain.repartition("level", "prefix", "part").sortWithinPartitions("level", "prefix", "part").select("k", "doc_id", "pos", "n", "words", "level", "prefix", "part")
    found = ordered.mapInArrow(step.subtrees, "k binary, start int")
    starts = materialize(found.groupBy("k").agg(F.collect_set("start").alias("starts")), f"{tag}-starts")
    changed = _listed(keyed, starts.select("k")).select("k", "text").join(starts, "k").dropDuplicates(["k"]).mapInArrow(step.remains, "k binary, n_removed long, new_sha string, spans array<array<int>>")
    meta = survey.select("doc_id", "k", "n_words", "sha").join(copies.withColumn("copy", F.lit(True)), "k", "left").join(changed, "k", "left")
    discard(firsts, shared, lists, records, *made)
    copy, none = F.coalesce("copy", F.lit(False)), F.array().cast("array<array<int>>")
    return meta.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.array(F.lit(0), F.col("n_words").cast("int")))).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every row; null texts have no words, and repeated rows get the same result."""
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), tag="op4").select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS low FROM wins GROUP BY win),
cover AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM wins JOIN firsts USING (win) WHERE doc_id > low),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM cover GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
