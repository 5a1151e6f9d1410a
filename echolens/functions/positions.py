"""Places in texts, in code points, half-open: spans before and after normalisation, windows, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, BACK, OVERLAP = 512, 64, 64
#: The tail that marks a source and the lengths that are enough with and without it (fixed values).
SHELL, SHELL_LEAST, BARE_LEAST = "（产联社）", 15, 20


def original_span(text: Column, start: Column, end: Column) -> Column:
    """The span of the text as it came that a span of its normalised form stands for: each line end takes a place more."""
    pieces = F.split(text, "\r\n", -1)
    state = lambda at, s, e: F.struct(at.alias("at"), s.alias("s"), e.alias("e"))

    def step(x: Column, piece: Column) -> Column:
        """One line end further: at is its place in the normalised text; s and e count those before the span's ends."""
        place = x["at"] + F.length(piece)
        return state(place + 1, x["s"] + (place < start).cast("int"), x["e"] + (place < end).cast("int"))

    lines = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), state(F.lit(0), F.lit(0), F.lit(0)), step)
    return F.struct((start + lines["s"]).alias("start"), (end + lines["e"]).alias("end"))


def windows(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Fixed windows (chunk, start, stop, chunk_hash); an empty text has one empty window."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    one = lambda i: F.struct(i.alias("chunk"), (i * step).alias("start"), F.least(i * step + size, F.length(text)).alias("stop"), F.sha2(F.substring(text, i * step + 1, F.lit(size)), 256).alias("chunk_hash"))
    return F.transform(F.sequence(F.lit(0), count - 1), one)


def cut(text: str) -> list[tuple[int, int]]:
    """Chunks of at most CHUNK: they end after a sentence if one ends in the last BACK places, and overlap by OVERLAP."""
    out, start = [], 0
    while start < len(text):
        end = min(start + CHUNK, len(text))
        if end < len(text):
            last = max((k for k in range(end - 1, end - BACK - 1, -1) if text[k] in "。！？!?；;.\n"), default=None)
            end = last + 1 if last is not None else end
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - OVERLAP, start + 1)
    return out


def chunks(items: DataFrame) -> DataFrame:
    """(record_id, chunk, start, stop): where a chunk ends depends on the one before, so one Arrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, k, a, b) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (a, b) in enumerate(cut(t or ""))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:])], ["record_id", "chunk", "start", "stop"])

    return items.select("record_id", "text").mapInArrow(run, "record_id string, chunk int, start int, stop int")


def shell_passes(text: Column) -> Column:
    """Long enough: SHELL_LEAST code points besides the source tail, or BARE_LEAST without one."""
    tail = F.endswith(text, F.lit(SHELL))
    return F.when(tail, F.length(text) - len(SHELL) >= SHELL_LEAST).otherwise(F.length(text) >= BARE_LEAST)


def all_spans(text: Column, quote: str) -> Column:
    """Starts of every place of the quote: a look-ahead meets overlapping ones, and the gaps between give the places."""
    pattern = "(?s)(?=" + "".join(f"\\x{{{ord(c):x}}}" for c in quote) + ")"
    gaps = F.split(F.concat(F.lit("\x00"), text), pattern, -1)
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    empty = F.array().cast("array<int>")
    return F.when(F.contains(text, F.lit(quote)), F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), state(F.lit(-1), empty), lambda s, g: state(s["at"] + F.length(g), F.concat(s["out"], F.array(s["at"] + F.length(g)))), lambda s: s["out"])).otherwise(empty)
