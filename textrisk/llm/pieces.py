"""SentencePiece vocabularies: best segmentation by a max-plus scan, and back.

A text is cut into the pieces with the largest sum of scores, which the
vocabulary file gives.  This is a longest path over positions, that is, a product
of max-plus matrices, and such products can be bracketed freely: a long document
is split into chunks, each chunk becomes a matrix from what reaches into it to
what reaches out of it, the matrices are combined, and each chunk is then walked
back on its own.

A space stands for the word mark of the vocabulary, and one is put before the
text.  Characters without a piece become pieces of their UTF-8 bytes, a word mark
written in the text too, so decoding gives back every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.storage import store

#: Public vocabulary that the registered queries use; a parameter everywhere.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 65_536
REMEMBERED = 300_000
_MARK = "▁"
_LOWEST = -np.inf


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores; byte pieces by value."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        """Read a vocabulary file on the driver; tasks get its pieces."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        bytes_ = [model.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace(_MARK, " ")
                ids[piece], scores[piece] = i, model.get_score(i)
        return cls(ids, scores, bytes_)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.scores), default=1)

    @cached_property
    def fallback(self) -> float:
        """Score of a character without a piece: under every piece."""
        return min(self.scores.values(), default=0.0) - 10

    @cached_property
    def unit(self) -> re.Pattern:
        """What can be segmented on its own: no piece goes from a word on to a space, or over a character without a piece."""
        if any(" " in p.lstrip(" ") for p in self.scores):
            return re.compile(r".+", re.DOTALL)
        loose = "".join(re.escape(c) for c in "\n\t\r" + _MARK if not any(c in p for p in self.scores))
        return re.compile(f" *[^ {loose}]+| +|[{loose}]") if loose else re.compile(r" *[^ ]+| +")

    @cached_property
    def tree(self) -> dict[str, tuple]:
        """Pieces by their characters: (what may follow, score or None)."""
        root: dict[str, tuple] = {}
        for piece in sorted(self.scores):
            level = root
            for c in piece[:-1]:
                level = level.setdefault(c, ({}, None))[0]
            below = level.get(piece[-1], ({}, None))[0]
            level[piece[-1]] = (below, self.scores[piece])
        return root

    @cached_property
    def surface(self) -> list[bytes]:
        """Bytes of each id."""
        table = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes_)}
        return [table.get(i, b"") for i in range(max(table, default=-1) + 1)]

    def paths(self, text: str, start: int = 0) -> tuple[list[float], list[int]]:
        """Best score of each position of ``text`` from ``start`` on, and where its last piece begins.

        Of equal sums the one with the longer last piece is taken.  Positions
        past the end of a chunk are what its last pieces reach into.
        """
        n = len(text)
        best, back = [_LOWEST] * (n + 1), [-1] * (n + 1)
        best[start] = 0.0
        root, low = self.tree, self.fallback
        for i in range(start, n):
            base = best[i]
            if base == _LOWEST:
                continue
            node = root.get(text[i])
            if (node is None or node[1] is None) and base + low > best[i + 1]:
                best[i + 1], back[i + 1] = base + low, i
            j = i + 1
            while node is not None:
                below, score = node
                if score is not None and base + score > best[j]:
                    best[j], back[j] = base + score, i
                if j == n:
                    break
                node = below.get(text[j])
                j += 1
        return best, back

    def tokens(self, text: str, start: int, end: int, back: list[int]) -> list[int]:
        """Ids along the way back from ``end`` to ``start``."""
        found: list[int] = []
        ids = self.ids
        while end > start:
            begin = back[end]
            known = ids.get(text[begin:end])
            if known is None:
                found.extend(self.bytes_[b] for b in reversed(text[begin:end].encode()))
            else:
                found.append(known)
            end = begin
        found.reverse()
        return found

    def segment(self, text: str) -> list[int]:
        """Ids of a text without chunks or memory, for short texts."""
        return self.tokens(text, 0, len(text), self.paths(text)[1])

    def decode(self, ids: list[int]) -> str:
        """The text of whole-document ids: without the space put in front."""
        return b"".join(map(self.surface.__getitem__, ids)).decode()[1:]


class Chunk:
    """A slice of a document (with the space in front), and what follows it.

    A state at a border is how many characters the piece over it reaches on.
    """

    def __init__(self, text: str, ahead: str, vocabulary: Vocabulary):
        self.v, self.text, self.whole = vocabulary, text, text + ahead
        self.n, self.states = len(text), vocabulary.longest
        # Units that lie wholly inside need no state; the first and the last may be shared with the neighbours.
        units = [m.span() for m in vocabulary.unit.finditer(text)]
        self.first = units[0][1] if units else 0
        self.last = units[-1][0] if units else 0
        self.inner = units[1:-1]

    def _edge(self, begin: int, end: int, start: int) -> tuple[list[float], list[int]]:
        best, back = self.v.paths(self.whole[begin:end], start - begin)
        return best, back

    def matrix(self, known: _Segments) -> np.ndarray:
        """Best score from each state in to each state out."""
        size, n = self.states, self.n
        result = np.full((size, size), _LOWEST)
        reach = min(len(self.whole), n + size - 1)
        if self.first <= self.last:
            middle = sum(known[self.text[a:b]][1] for a, b in self.inner)
            out, _ = self._edge(self.last, reach, self.last)
            tail = np.full(size, _LOWEST)
            for s in range(reach - n + 1):
                tail[s] = self._out(out, s, self.last)
            for s in range(min(size, self.first + 1)):
                inside = self._edge(0, self.first, s)[0][self.first]
                result[s] = inside + middle + tail
            return result
        for s in range(min(size, n + 1)):
            best, _ = self._edge(0, reach, s)
            for t in range(reach - n + 1):
                result[s, t] = self._out(best, t, 0)
        for s in range(n + 1, size):  # a piece that reaches over the whole chunk
            result[s, s - n] = 0.0
        return result

    def _out(self, best: list[float], state: int, begin: int) -> float:
        return self._last(best, state, begin)[0]

    def _last(self, best: list[float], state: int, begin: int) -> tuple[float, int]:
        """Score of reaching ``state`` past the end by a piece that begins inside, and where it begins."""
        n = self.n
        if state == 0:
            return best[n - begin], n
        found, at = _LOWEST, -1
        end = n + state
        for i in range(max(begin, end - self.v.longest), n):
            score = self.v.scores.get(self.whole[i:end])
            if score is not None and best[i - begin] + score > found:
                found, at = best[i - begin] + score, i
        return found, at

    def ids(self, state: int, out: int, known: _Segments) -> list[int]:
        """Tokens that begin in this chunk, between the given states."""
        reach = min(len(self.whole), self.n + self.states - 1)
        if state > self.n:
            return []
        if self.first <= self.last:
            found = self.v.tokens(self.whole[: self.first], state, self.first, self._edge(0, self.first, state)[1])
            for a, b in self.inner:
                found += known[self.text[a:b]][0]
            begin = start = self.last
        else:
            found, begin, start = [], 0, state
        best, back = self._edge(begin, reach, start)
        _, at = self._last(best, out, begin)
        piece = self.whole[begin:reach]
        found += self.v.tokens(piece, start - begin, at - begin, back)
        if out:
            found.append(self.v.ids[self.whole[at : self.n + out]])
        return found


class _Segments(dict):
    """Ids and score of units, each worked out once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def __missing__(self, unit: str) -> tuple[tuple[int, ...], float]:
        if len(self) >= REMEMBERED:
            self.clear()
        best, back = self.v.paths(unit)
        value = tuple(self.v.tokens(unit, 0, len(unit), back)), best[-1]
        if len(unit) <= 64:
            self[unit] = value
        return value


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of stacks of matrices: associative, the first runs first."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def borders(matrices: np.ndarray) -> np.ndarray:
    """States at the borders of a document's chunks on a best path, from 0 to 0.

    A scan in about log2(n) products gives the best score from the beginning to
    each border; the way back then takes one row per chunk.
    """
    prefix, step = matrices.copy(), 1
    while step < len(prefix):
        prefix[step:] = combine(prefix[:-step], prefix[step:])
        step *= 2
    states = np.zeros(len(matrices) + 1, np.int32)
    for k in range(len(matrices) - 1, 0, -1):
        states[k] = int(np.argmax(prefix[k - 1][0] + matrices[k][:, states[k + 1]]))
    return states


def encode(
    docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """One row per row of ``docs``: (id, n_chars, n_tokens, ids, decoded).

    ``decoded`` is the text that the ids give back.  A null text has null ids and
    a null ``decoded``; an empty text is the one space put in front.  Repeated
    rows stay; a null id too.

    Every text is cut into chunks of ``chunk`` characters.  A text of one chunk
    has border states 0 and is walked at once.  The chunks of longer texts are
    stored with their matrices, so that the chunks of one document are worked on
    by many tasks; only matrices meet in one task, some 2 KB per chunk.
    """
    if chunk < vocabulary.longest:
        raise ValueError("chunk must be at least as long as the longest piece")
    id_kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text") >= chunk, F.lit(False))
    size = vocabulary.longest

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Segments(vocabulary)
        units = vocabulary.unit.findall
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                flat: list[int] = []
                ends, decoded = [0], []
                texts = part.column(1).to_pylist()
                cut = [units(" " + value) if value is not None else [] for value in texts]
                for value, own in zip(texts, cut, strict=True):
                    found: list[int] = []
                    for u in own:
                        found += known[u][0]
                    flat += found
                    ends.append(len(flat))
                    decoded.append(None if value is None else vocabulary.decode(found))
                missing = part.column(1).is_null()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=missing)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                value = " " + value.as_py()
                cuts = range(0, len(value), chunk)
                parts = [value[c : c + chunk] for c in cuts]
                ahead = [value[c + chunk : c + chunk + size - 1] for c in cuts]
                for start in range(0, len(parts), 64):
                    stop = min(start + 64, len(parts))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key.as_py()] * (stop - start), pa.string()),
                            pa.array(range(start, stop), pa.int32()),
                            pa.array(parts[start:stop], pa.string()),
                            pa.array(ahead[start:stop], pa.string()),
                        ],
                        names=["key", "k", "part", "ahead"],
                    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Segments(vocabulary)
        for batch in batches:
            found = []
            for part, ahead in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found.append(Chunk(part, ahead, vocabulary).matrix(known).ravel())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=["key", "k", "part", "ahead", "matrix"]
            )

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        states = borders(np.stack([m.reshape(size, size) for m in frame["matrix"]]))
        return pd.DataFrame({"key": frame["key"].to_numpy(), "k": frame["k"].to_numpy(), "inward": states[:-1], "outward": states[1:]})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Segments(vocabulary)
        for batch in batches:
            found = []
            for part, ahead, inward, outward in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                found.append(Chunk(part, ahead, vocabulary).ids(inward, outward, known))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["key", "k", "ids"]
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = [vocabulary.decode(ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=["key", "ids", "decoded"])

    schema = f"id {id_kind}, ids array<int>, decoded string"
    ones = rows.where(~long).mapInArrow(short, schema)
    # Long texts by content, so that repeated rows and null ids need no numbers; equal texts are worked on once.
    giants = rows.where(long).withColumn("key", F.sha2("text", 256))
    cut = giants.select("key", "text").mapInArrow(split, "key string, k int, part string, ahead string").dropDuplicates(["key", "k"])
    chunks = store(cut.mapInArrow(weigh, "key string, k int, part string, ahead string, matrix array<double>"), "chunks").table
    states = chunks.select("key", "k", "matrix").groupBy("key").applyInPandas(scan, "key string, k int, inward int, outward int")
    walked = chunks.drop("matrix").join(states, ["key", "k"]).select("key", "k", "part", "ahead", "inward", "outward")
    tokens = walked.mapInArrow(walk, "key string, k int, ids array<int>")
    whole = tokens.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda c: c["ids"])).alias("ids"))
    decoded = whole.mapInArrow(join, "key string, ids array<int>, decoded string")
    many = giants.select("id", "key").join(decoded, "key").select("id", "ids", "decoded")
    return ones.unionByName(many).select(
        F.col("id").alias(id_column), F.length("decoded").cast("long").alias("n_chars"), F.size("ids").alias("n_tokens"), "ids", "decoded"
    )
