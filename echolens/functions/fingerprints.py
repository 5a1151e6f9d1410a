"""SimHash and MinHash over shingles and tokens, with their bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

SIMHASH, MINHASH, SEED = "simhash_v1", "minhash_v1", "news_flash_dedup_v1"
PERMUTATIONS, BANDS = 128, 32


#: Features whose hashes a worker keeps, and those with all permutations; beyond that it starts anew. Rows that it returns at once.
REMEMBERED, PERMUTED, ROWS = 200_000, 50_000, 1000


class Hashes(dict):
    """The hash of each feature of a kind that was met."""

    def __init__(self, kind: str) -> None:
        self.lead = f"{SIMHASH}|{kind}|".encode()

    def __missing__(self, feature: str) -> int:
        value = self[feature] = int.from_bytes(hashlib.sha256(self.lead + feature.encode("utf-8", "surrogatepass")).digest()[:8], "big")
        return value

    def of(self, found: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


class Permuted(dict):
    """The place of each shingle that was met among ``rows``, its hashes by permutation."""

    def __init__(self, permutations: int) -> None:
        self.prefix = [f"{MINHASH}|{SEED}|{p}|".encode() for p in range(permutations)]
        self.rows = np.zeros((1024, permutations), np.uint64)

    def __missing__(self, shingle: str) -> int:
        at = self[shingle] = len(self)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        tail = shingle.encode()
        self.rows[at] = [int.from_bytes(hashlib.sha256(p + tail).digest()[:8], "big") for p in self.prefix]
        return at

    def least(self, found: list[str]) -> np.ndarray:
        if len(self) > PERMUTED:
            self.clear()
        out = np.full(len(self.prefix), (1 << 64) - 1, np.uint64)
        for low in range(0, len(found), 4096):
            at = np.fromiter(map(self.__getitem__, found[low : low + 4096]), np.int64)
            out = np.minimum(out, self.rows[at].min(axis=0))
        return out


def voted(h: np.ndarray) -> np.int64:
    """A bit is 1 if more of the hashes have it than not."""
    votes = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 15):
        votes += np.unpackbits(h[low : low + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0]


def as_hex(signatures: np.ndarray) -> pa.Array:
    """Rows of words as lists of 16 hex digits."""
    n, width = signatures.shape
    digits = np.frombuffer(signatures.astype(">u8").tobytes().hex().encode(), np.uint8)
    words = pa.StringArray.from_buffers(n * width, pa.py_buffer(np.arange(0, 16 * n * width + 1, 16, dtype=np.int32)), pa.py_buffer(digits))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), words)


def prints(items: DataFrame, key: str = "record_id", text: str = "text", permutations: int = PERMUTATIONS, sim: bool = True, least: bool = True) -> DataFrame:
    """(key, simhash, signature), or one of the two, by one Arrow pass without a shuffle. Blank texts have no row.

    A text comes with its distinct shingles and tokens each in one string: lists of them would be many objects for all rows of a batch.
    A shingle is three code points, or the whole of a shorter text; a token holds no line feed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, words, places = Hashes("char"), Hashes("token"), Permuted(permutations)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                piece = batch.slice(low, ROWS)
                sims, signatures = np.zeros(piece.num_rows, np.int64), np.zeros((piece.num_rows, permutations), np.uint64)
                for row in range(piece.num_rows):
                    joined = piece.column("chars")[row].as_py()
                    found = [joined[x : x + 3] for x in range(0, len(joined), 3)]
                    if sim:
                        spoken = piece.column("words")[row].as_py()
                        sims[row] = voted(np.concatenate([chars.of(found), words.of(spoken.split("\n") if spoken else [])]))
                    if least:
                        signatures[row] = places.least(found)
                yield pa.RecordBatch.from_arrays([piece.column(0), *([pa.array(sims)] if sim else []), *([as_hex(signatures)] if least else [])], names)

    names = [key, *(["simhash"] if sim else []), *(["signature"] if least else [])]
    kinds = [items.schema[key].dataType.simpleString(), *(["long"] if sim else []), *(["array<string>"] if least else [])]
    normal = T.normalized(F.col(text))
    spoken = [F.array_join(T.tokens(normal), "\n").alias("words")] if sim else []
    ready = items.where(T.indexable(F.col(text))).select(key, F.array_join(T.shingles(normal), "").alias("chars"), *spoken)
    return ready.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def simhash(items: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """(key, simhash): a bit is 1 if more features have it than not. Blank texts have no row."""
    return prints(items, key, text, least=False)


def hex64(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def simhash_bands(value: Column) -> Column:
    digits = hex64(value)
    return F.array(*[F.concat(F.lit(f"{SIMHASH}:{k}:"), F.substring(digits, 4 * k + 1, 4)) for k in range(4)])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def minhash(items: DataFrame, key: str = "record_id", text: str = "text", permutations: int = PERMUTATIONS) -> DataFrame:
    """(key, signature): for each permutation the smallest hash over the shingles, as 16 hex digits. Blank texts have no row."""
    return prints(items, key, text, permutations, sim=False)


def packed(signature: Column) -> Column:
    """A signature in bytes."""
    return F.unhex(F.array_join(signature, ""))


def band_bytes(simhash: Column, signature: Column) -> Column:
    """What the bands hold, in bytes: those of a SimHash, then those of a packed signature. A band beyond its end is null."""
    sims = [F.substring(F.unhex(hex64(simhash)), 2 * k + 1, 2) for k in range(4)]
    return F.array(*sims, *[F.when(F.length(signature) >= 32 * (k + 1), F.substring(signature, 32 * k + 1, 32)) for k in range(BANDS)])


def band_name(number: Column, held: Column) -> Column:
    """The name of a band by its place in ``band_bytes`` and what it holds."""
    sim = F.concat(F.lit(f"{SIMHASH}:"), number, F.lit(":"), F.lower(F.hex(held)))
    return F.when(number < 4, sim).otherwise(F.concat(F.lit(f"{MINHASH}:"), number - 4, F.lit(":"), F.sha2(held, 256)))


def minhash_bands(signature: Column, bands: int = BANDS) -> Column:
    packed = lambda k: F.sha2(F.unhex(F.concat(*[F.get(signature, F.lit(4 * k + j)) for j in range(4)])), 256)
    return F.array(*[F.concat(F.lit(f"{MINHASH}:{k}:"), packed(k)) for k in range(bands)])


def agreement(a: Column, b: Column) -> Column:
    """The share of equal positions of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)
