"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: corpus-level merge replay. All distinct pieces of the texts at hand that have no ids yet are
laid out as one row of symbols; an inverted index leads from each pair of neighbouring symbols to its
positions; the merges are then applied in rank order, each at all its positions, and only the
neighbours of a merged pair are indexed anew. A piece never reaches past white space, so what one
block of texts yields holds for all: every task replays the merges for its own new pieces and keeps
their ids while its worker lives. Texts are never shuffled; the vocabulary goes out as a broadcast of
fixed size.

The empty and the null text have no ids: an empty list.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewords.llm.tokens import portions

TOKENIZERS = "/opt/tokenizers"
#: Pieces whose ids a worker keeps at most; past it, it starts afresh.
MOST = 400_000

# The white space of Unicode, and the public tokenizer's own pattern of pieces.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""".replace(r"^\s", f"^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")
#: A run without white space and the one space before it, or the white space left: no piece crosses these.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in prints else next(free)) for b in range(256)]


class Merges:
    """A vocabulary: ids of the single bytes, and of each pair that merges its rank and the merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.bytes = [ids[c] for c in alphabet()]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}


def replay(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each piece. All pieces are worked on together, merge by merge in rank order."""
    single, pairs = merges.bytes, merges.pairs
    symbol: list[int] = [-1]
    first = []
    for p in pieces:
        first.append(len(symbol))
        symbol += [single[b] for b in p]
        symbol.append(-1)
    left = list(range(-1, len(symbol) - 1))
    right = list(range(1, len(symbol) + 1))
    where: dict[tuple[int, int], list[int]] = {}
    heap = []
    for i in range(1, len(symbol) - 1):
        pair = (symbol[i], symbol[i + 1])
        if pair in where:
            where[pair].append(i)
        elif pair in pairs:
            where[pair] = [i]
            heap.append((pairs[pair][0], pair))
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        a, b = pair
        new = pairs[pair][1]
        for i in sorted(where.pop(pair)):  # from the left, so that of overlapping pairs the first merges
            j = right[i]
            if symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], symbol[j] = new, -2
            right[i] = k = right[j]
            left[k] = i
            for at, other in ((left[i], (symbol[left[i]], new)), (i, (new, symbol[k]))):
                if other in where:
                    where[other].append(at)
                elif other in pairs:
                    where[other] = [at]
                    heapq.heappush(heap, (pairs[other][0], other))
    out = []
    for i in first:
        ids = []
        while symbol[i] != -1:
            ids.append(symbol[i])
            i = right[i]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts; keeps the ids of chunks it has met."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pattern = regex.compile(PIECE)
        self._fresh()

    def _fresh(self) -> None:
        self.rows: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        if len(self.rows) > MOST:
            self._fresh()
        split = [self.pattern.findall(c) for c in chunks]
        new = list({p: None for s in split for p in s if p not in self.pieces})
        self.pieces |= zip(new, replay([p.encode() for p in new], self.merges), strict=True)
        ids = [[i for p in s for i in self.pieces[p]] for s in split]
        self.rows |= zip(chunks, range(len(self.rows), len(self.rows) + len(chunks)), strict=True)
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in ids])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's end."""
        if len(self.rows) > MOST:
            self._fresh()
        chunks = [CHUNK.findall(t) if t else [] for t in texts]
        if new := list({c: None for x in chunks for c in x if c not in self.rows}):
            self._learn(new)
        get = self.rows.__getitem__
        rows = np.fromiter((r for x in chunks for r in map(get, x)), np.int64)
        size = np.diff(self.start)[rows]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.start[rows], size)]
        words = np.cumsum([len(x) for x in chunks])
        return ids, np.concatenate([[0], ends])[words]


_HELD: dict[int, Encoder] = {}


def encoded(df: DataFrame, keep: list[str], text: str = "text", *, path: str = f"{TOKENIZERS}/byte_bpe_50k.json", out: str = "ids") -> DataFrame:
    """``keep`` columns of df and ``out ARRAY<INT>``, the ids of ``text`` without special tokens.

    One row for every row. Null and empty texts have an empty list. ``path`` is the tokenizer's file,
    read on the driver; other columns are dropped.
    """
    sent = df.sparkSession.sparkContext.broadcast(Merges(path))
    key = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Encoder(sent.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in portions(texts):
                ids, ends = _HELD[key].encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), lists], [*keep, out])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` array<int>"])
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
