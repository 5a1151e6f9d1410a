"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once. At each position its output links name the pieces that end
there, longest first, and each is relaxed against the best way to where it starts:

* unigram models: the largest sum of scores (Viterbi);
* BPE models, whose merges the sum of scores does not reproduce: a piece is taken if it can follow the last piece of the
  best way to its start, that is, if merging the two alone leaves them as they are. One piece at each position can, so the
  pass is as linear as Viterbi's and its result is that of the merges.

Characters without a piece fall back to bytes (or the unknown id). Pieces don't reach over the start of a word, so words are
encoded one by one and remembered, in a table of a bounded size. The tokenizer's file is read by the driver and broadcast.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, handed_back, table, with_columns_after

#: The tokenizer's file; only ever read.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Words, and pairs of pieces, that a worker remembers: when so many are new, those that were not asked for since are dropped.
REMEMBERED = 200_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """A tokenizer: (piece, score, type) by id, and how texts are prepared."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool = True, squeeze: bool = False) -> None:
        self.pieces, self.bpe, self.dummy_prefix, self.squeeze = pieces, bpe, dummy_prefix, squeeze
        self.ids = {p: k for k, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[1:-1], 16): k for k, (p, _, t) in enumerate(pieces) if t == BYTE}
        if any(t == USER for _, _, t in pieces):
            raise ValueError("user-defined pieces are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that reach over the start of a word are not supported")
        self.lowest = min((pieces[k][1] for k in self.ids.values()), default=0.0) - 10
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: A newline without a piece stands between words as a space does.
        self.newline = None if not bpe or "\n" in self.ids else array("i", self.fallback("\n")).tobytes()
        self.pairs: dict[tuple[int, int], bool] = {}
        #: For merges: whether a piece, by its id and that of the piece before, can follow; and where states go on a character, as far as met.
        self.after: list[dict[int, bool]] = [{} for _ in pieces]
        self.moves: list[dict[str, int]] = []
        self.n_after = self.n_moves = 0
        self.rank = {p: -pieces[k][1] for p, k in self.ids.items()}
        self.trees: dict[int, tuple[list[tuple[str, float]], list[tuple[str, float]]] | None] = {}
        self._automaton()
        self.surfaces = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]

    @classmethod
    def load(cls, data: bytes) -> Pieces:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                got = dict(fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif number in (2, 3):
                (trainer if number == 2 else normalizer).update(fields(value))
        if normalizer.get(2):
            raise ValueError("a table of character replacements is not supported")
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, trainer.get(3, 1) == 2, bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))

    def _automaton(self) -> None:
        """goto, fail and output links. ends: (length, id) of the piece that a state spells; also: the next state that does."""
        goto: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int] | None] = [None]
        for piece, k in self.ids.items():
            state = 0
            for c in piece:
                if c not in goto[state]:
                    goto[state][c] = len(goto)
                    goto.append({})
                    self.ends.append(None)
                state = goto[state][c]
            self.ends[state] = (len(piece), k)
        self.goto, self.fail, self.also = goto, [0] * len(goto), [0] * len(goto)
        queue = list(goto[0].values())
        for state in queue:
            for c, child in goto[state].items():
                queue.append(child)
                back = self.fail[state]
                while back and c not in goto[back]:
                    back = self.fail[back]
                self.fail[child] = goto[back].get(c, 0)
            back = self.fail[state]
            self.also[state] = back if self.ends[back] else self.also[back]
        #: All pieces that end in a state, longest first.
        self.outputs: list[tuple[tuple[int, int], ...]] = [()] * len(goto)
        for state in [0, *queue]:
            rest = self.outputs[self.also[state]] if self.also[state] else ()
            self.outputs[state] = (self.ends[state], *rest) if self.ends[state] else rest
        self.moves = [{} for _ in goto]

    def _move(self, state: int, c: str) -> int:
        """Where a state goes on a character, remembered."""
        if self.n_moves >= REMEMBERED:
            self.moves[:], self.n_moves = [{} for _ in self.goto], 0
        at = state
        while at and c not in self.goto[at]:
            at = self.fail[at]
        self.moves[state][c] = found = self.goto[at].get(c, 0)
        self.n_moves += 1
        return found

    def _can_follow(self, one: int, two: int) -> bool:
        """``follows``, remembered."""
        if self.n_after >= REMEMBERED:
            self.after[:], self.n_after = [{} for _ in self.pieces], 0
        self.after[two][one] = found = self.follows(one, two)
        self.n_after += 1
        return found

    def by_merges(self, text: str) -> list[int]:
        """The pass over a run of text, for BPE models."""
        moves, outputs, after = self.moves, self.outputs, self.after
        ids: list[int | None] = [None] * (len(text) + 1)  # id of the piece that ends here; -1: no piece
        sizes = [1] * (len(text) + 1)
        ids[0] = -1
        state = i = 0
        for c in text:
            i += 1
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            for n, k in outputs[state]:
                before = ids[i - n]
                if before is None:
                    continue
                if before < 0:
                    fits = self.tree(k) is not None
                else:
                    fits = after[k].get(before)
                    if fits is None:
                        fits = self._can_follow(before, k)
                if fits:
                    ids[i], sizes[i] = k, n
                    break
            else:
                if c not in self.ids:
                    ids[i] = -1
        out, i = [], len(text)
        while i:
            k = ids[i]
            if k >= 0:
                out.append(k)
            else:
                out.extend(reversed(self.fallback(text[i - 1])))
            i -= sizes[i]
        out.reverse()
        return out

    def merged(self, text: str) -> list[int]:
        """Plain BPE: the best-scored adjacent pair is merged, the first of equals, until none is a piece."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = right[a]
            if a >= 0 and b < len(parts) and (k := self.ids.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.pieces[k][1], a, both))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            if parts[a] is None or right[a] >= len(parts) or parts[a] + parts[right[a]] != both:
                continue
            b = right[a]
            parts[a], parts[b], right[a] = both, None, right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return [k for p in parts if p is not None for k in ([self.ids[p]] if p in self.ids else self.fallback(p))]

    def fallback(self, character: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")]

    def tree(self, k: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """What a piece is made of, on its left and its right edge: (part, rank of the merge that takes it up), the piece first.

        None for a piece that its own characters don't merge to.
        """
        if k not in self.trees:
            parts = list(self.pieces[k][0])
            halves: dict[str, tuple[str, str]] = {}
            while len(parts) > 1:
                ranked = [(self.rank.get(x + y, math.inf), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
                best, i = min(ranked)
                if best == math.inf:
                    break
                halves.setdefault(parts[i] + parts[i + 1], (parts[i], parts[i + 1]))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            edges = []
            for side in (0, 1):
                at, edge = parts[0], [(parts[0], math.inf)]
                while at in halves:
                    taken = self.rank[at]
                    at = halves[at][side]
                    edge.append((at, taken))
                edges.append(edge)
            self.trees[k] = (edges[0], edges[1]) if len(parts) == 1 else None
        return self.trees[k]

    def follows(self, one: int, two: int) -> bool:
        """Whether merging the two pieces together leaves them as they are: no part on the inner edges meets before it is taken up.

        On equal ranks the merge further left comes first, so it is the left piece's own before one across the gap, and that
        before the right piece's own.
        """
        left, right = self.tree(one), self.tree(two)
        if left is None or right is None:
            return False
        rank = self.rank.get
        for x, takes_x in left[1]:
            for y, takes_y in right[0]:
                met = rank(x + y)
                if met is not None and met < takes_x and met <= takes_y:
                    return False
        return True

    def best(self, text: str) -> list[int]:
        """The pass over a run of text."""
        goto, fail, also, ends, pairs = self.goto, self.fail, self.also, self.ends, self.pairs
        if len(pairs) >= REMEMBERED:
            pairs.clear()
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)  # (length, id) of the piece that ends here; id -1: no piece
        score = [0.0] + [-1e300] * len(text)
        state = 0
        for i, c in enumerate(text, 1):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            at = state if ends[state] else also[state]
            while at:
                n, k = ends[at]
                start = i - n
                if self.bpe:
                    before = last[start]
                    if start == 0 or before is not None and before[1] < 0:
                        fits = self.tree(k) is not None
                    elif before is None:
                        fits = False
                    else:
                        fits = pairs.get((before[1], k))
                        if fits is None:
                            fits = pairs[before[1], k] = self.follows(before[1], k)
                    if fits:
                        last[i] = ends[at]
                        break
                elif (s := score[start] + self.pieces[k][1]) > score[i]:
                    score[i], last[i] = s, (n, k)
                at = also[at]
            if self.bpe:
                if last[i] is None and c not in self.ids:
                    last[i] = (1, -1)
            elif c not in self.ids and (s := score[i - 1] + self.lowest) > score[i]:
                score[i], last[i] = s, (1, -1)
        out, i = [], len(text)
        while i:
            n, k = last[i]
            out.append([k] if k >= 0 else self.fallback(text[i - 1]))
            i -= n
        return [k for some in reversed(out) for k in some]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; an empty text has none."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return np.zeros(0, np.int32)
        out: list[bytes] = []
        parts = text.split(" ")
        if not self.dummy_prefix or SPACE in text or "" in parts:
            whole = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
            parts = _CHUNK.findall(whole)
        else:
            parts = [SPACE + p for p in parts]
        words, get, keep = self.words, self.words.get, out.append
        for part in parts:
            got = get(part)
            if got is None:
                got = self._word(part)
                if words is not self.words:
                    words, get = self.words, self.words.get
            keep(got)
        return np.frombuffer(b"".join(out), np.int32)

    def _word(self, part: str) -> bytes:
        """Ids of a word that isn't among the newest: from the older ones, or by the pass."""
        got = self.older.get(part)
        if got is None:
            if self.newline is not None and "\n" in part and not part.startswith(SPACE * 2):
                lines = part.split("\n")
                got = self.newline.join((self.words.get(x) or self._word(x)) if x else b"" for x in lines)
                if len(lines) > 1:
                    return got
            else:
                # equal scores of runs of spaces leave the order of merges open to the place: the merges themselves decide
                ids = self.merged(part) if self.bpe and part.startswith(SPACE * 2) else self.by_merges(part) if self.bpe else self.best(part)
                got = array("i", ids).tobytes()
        if len(part) < 64:
            if len(self.words) >= REMEMBERED:
                self.older, self.words = self.words, {}
            self.words[part] = got
        return got

    def forget(self) -> None:
        """Drop what was remembered, so that an idle worker holds the tokenizer alone."""
        self.words, self.older = {}, {}
        self.pairs.clear()
        self.after[:], self.n_after = [{} for _ in self.pieces], 0
        self.moves[:], self.n_moves = [{} for _ in self.goto], 0

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes join to characters, and the prefix space goes."""
        text = b"".join(map(self.surfaces.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_LOADED: dict[int, Pieces] = {}


def known(data: bytes) -> Pieces:
    """The tokenizer of a file's bytes, made once in each worker."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces.load(data)
    return _LOADED[key]


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: Characters of text, about, and rows that one step encodes.
STEP_CHARS, STEP_ROWS = 1 << 21, 256


def tokenized(docs: DataFrame, model: bytes, n_tokens: str = "n_tokens", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``n_tokens``, ``ids`` and ``decoded`` (the text that the ids give back) to ``docs``, in place of columns of these names.

    A null or empty text has no ids and decodes to an empty one. Equal texts have equal ids; repeated rows each get theirs, and all
    other columns, whatever their names, are handed on as they are. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, keep = docs.columns.index("text"), with_columns_after(docs.columns, [n_tokens, ids, decoded])
    names = [docs.columns[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = known(shared.value)
        try:
            for batch in handed_back(batches):
                texts, low = batch.column(at), 0
                while low < batch.num_rows:
                    got, size, high = [], 0, low
                    while high < batch.num_rows and high - low < STEP_ROWS and size < STEP_CHARS:
                        text = texts[high].as_py() or ""
                        got.append(tokenizer.encode(text))
                        size, high = size + len(text), high + 1
                    cut = np.cumsum([0, *map(len, got)])
                    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(got)))
                    part = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(np.diff(cut)), lists, pa.array([tokenizer.decode(x) for x in got], pa.string())], [*names, n_tokens, ids, decoded])
                    low = high
        finally:
            tokenizer.forget()

    schema = "".join(f"`{docs.schema[k].name}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.mapInArrow(run, f"{schema}`{n_tokens}` long, `{ids}` array<int>, `{decoded}` string")


def decoded_texts(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with each text as its ids decode to it, and with ``n_tokens`` and ``ids`` (in place of columns of these names)."""
    decoded = free_name([*docs.columns, "n_tokens", "ids"], "decoded")
    out = tokenized(docs, model, decoded=decoded)
    kept = [docs.columns[k] for k in with_columns_after(docs.columns, ["n_tokens", "ids"])]
    return out.select(*[F.col(decoded).alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], "n_tokens", "ids")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, with whether they decode to the very text (a text with U+2581 doesn't: it decodes to a space).

    A null text is an empty one; repeated rows each get theirs.
    """
    out = tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"), read_model())
    return out.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
