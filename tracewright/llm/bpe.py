"""Operator 4: byte-level BPE encoding and decoding by monoid tree reduction.

Encodings of a piece's halves, found recursively, are joined by re-encoding a window of tokens around the boundary. The
window grows (doubling on the side that isn't stable) until its outer tokens are compatible with their neighbours: two
neighbouring tokens are compatible if encoding their joined bytes gives the two again. A sequence of tokens of which all
neighbours are compatible is the BPE encoding of its bytes, so what stands outside the window provably stays. Halves and
boundary pairs recur, so both are remembered up to a fixed number. Pieces, the pattern's matches, are joined by
concatenation alone. Decoding concatenates the tokens' bytes up the same kind of tree.

As in the tiktoken library, a piece that is a token as a whole is that token.

Defined results: a null or empty text has no ids. Other columns are kept by the caller's choice; repeated rows give one
row each. Very long texts are taken piece by piece; a piece of any length takes O(n log n) steps.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import by_text, strings

#: Entries that each memory holds before it starts anew; entries are of at most REMEMBER bytes.
MEMORY, REMEMBER = 400_000, 32
#: Pieces of a text that are in memory at once.
PIECES = 1 << 17


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.nodes: dict[bytes, tuple[int, ...]] = {}
        self.packed: dict[str, bytes] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Plain BPE of a window: the lowest-ranked neighbours are merged first, from the left."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) <= 48:
            while len(parts) > 1:
                best = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                if best[0] == 1 << 62:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return tuple(ranks[p] for p in parts)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(ranks[parts[i] + parts[i + 1]], i, 2) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and (joined := parts[k] + parts[after[k]]) in ranks:
                    heapq.heappush(heap, (ranks[joined], k, len(joined)))
        return tuple(ranks[p] for p in parts if p)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b])
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        i, j = 1, 1  # tokens of the window on either side
        while True:
            if i == j == 1:
                window = self.pair(left[-1], right[0])
            else:
                window = self.merged(b"".join([self.tokens[t] for t in left[-i:] + right[:j]]))
            fixed_left = i == len(left) or self.pair(left[-i - 1], window[0]) == (left[-i - 1], window[0])
            fixed_right = j == len(right) or self.pair(window[-1], right[j]) == (window[-1], right[j])
            if fixed_left and fixed_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if fixed_left else min(len(left), 2 * i)
            j = j if fixed_right else min(len(right), 2 * j)

    def tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) == 1:
            return (self.ranks[data],)
        found = self.nodes.get(data)
        if found is None:
            half = len(data) // 2
            found = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= REMEMBER:
                if len(self.nodes) >= MEMORY:
                    self.nodes.clear()
                self.nodes[data] = found
        return found

    def piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        return np.array(self.tree(data) if whole is None else (whole,), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, matches = [], (m.group() for m in self.pattern.finditer(text)) if len(text) > PIECES else iter(self.pattern.findall(text))
        packed = self.packed
        while some := list(islice(matches, PIECES)):
            ids = list(map(packed.get, some))
            for at, x in enumerate(ids):
                if x is None:
                    ids[at] = x = packed.get(some[at]) or self.piece(some[at])
                    if len(some[at]) <= REMEMBER:
                        if len(packed) >= 2 * MEMORY:
                            packed.clear()
                        packed[some[at]] = x
            out.append(b"".join(ids))
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text); ids: little-endian unsigned 32-bit integers. decode: also decoded, the bytes
    that the ids stand for."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = codec(ranks, pattern)
        ids = [made.encode(t) for t in strings(batch.column("text")).to_pylist()]
        columns = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())}
        if decode:
            columns["decoded"] = pa.array([made.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.binary())
        return pa.record_batch(columns)

    return docs.mapInArrow(lambda batches: by_text(batches, "text", work), "doc_id long, ids binary" + ", decoded binary" * decode)


def decoded(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks, pattern)
        for batch in batches:
            out = [made.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "decoded": pa.array(out, pa.binary())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
