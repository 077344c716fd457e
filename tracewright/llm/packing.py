"""Operator 1: packing documents into fixed-length token sequences, in order.

A dynamic program over cut positions minimises, in tokens, the padding, SEQUENCE for each sequence, and a penalty for every
cut that truncates a document: none at a document's end, SENTENCE at a sentence's end, INSIDE within a sentence of over LONG
tokens (shorter ones are never cut). The best sequence start for each cut lies in a sliding window of `length` tokens, so a
monotone queue gives each transition in constant time on average. A sequence whose length is a power of two needs no
padding, so such lengths are transitions of their own; their sequences cost SEQUENCE like any other.

Documents are packed in the order in which a task reads them and sequences don't cross tasks, so nothing is shuffled or
sorted; at most one sequence in a task, its very last, is shorter for want of more documents. A task plans BLOCK tokens at
a time and hands out the sequences on which the best ways to all positions still open agree, so the plan is the best of the
whole task, not of a block; should they agree on none for HELD tokens, the best way so far is taken.

Defined results: a null or empty text is a document of one token, the end token. Ties between cuts go to the first found.
Repeated rows are packed once each, null doc_ids too. An empty table gives no rows. doc_id must be castable to long; other
columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import strings, text_spans

SENTENCE, INSIDE, SEQUENCE = 24, 128, 24
#: Tokens without a sentence's end after which cuts inside are offered, and how far apart.
LONG, EVERY = 256, 64
#: Tokens that are planned at once.
BLOCK, HELD = 1 << 17, 1 << 20
#: Texts of these characters alone are split alike by both tokenizer libraries.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]")


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file. With the ranks of the same vocabulary, plain
    texts take the faster library, whose ids are the same."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                held = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=held, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not _PLAIN.search(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def sentence_ends(self) -> np.ndarray:
        """Whether an id's text ends a sentence or a line."""
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return np.array([(t := self.tokenizer.decode([i])) != "" and t.rstrip(" ")[-1:] in ".!?\n。！？" and t.strip(" ") != "" for i in range(size)])


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None, pattern: str | None) -> tuple[Encoder, np.ndarray]:
    made = Encoder(path, ranks, pattern)
    return made, made.sentence_ends()


def plan(at: list[int], penalty: list[int], length: int) -> list[float]:
    """Least cost of cutting at each position, and the start of the sequence that ends there.

    at: ascending positions from 0; consecutive ones are at most length apart. Cost of a sequence: SEQUENCE, its padding, and
    the penalty of its end.
    """
    n = len(at)
    cost, back = [0.0] * n, [0] * n
    places = np.array(at)
    jumps: dict[int, list[int]] = {}
    size = 1
    while size < length:
        j = np.searchsorted(places, places - size)
        for i in np.flatnonzero((places >= size) & (places[j] == places - size)).tolist():
            jumps.setdefault(i, []).append(int(j[i]))
        size *= 2
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for i in range(1, n):
        here = at[i]
        while queue[0][1] < here - length:
            queue.popleft()
        value, _, j = queue[0]
        best = value + length - here
        if i in jumps:
            for k in jumps[i]:
                if cost[k] < best:
                    best, j = cost[k], k
        best += penalty[i] + SEQUENCE
        cost[i], back[i] = best, j
        value = best + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, here, i))
    return cost, back


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which tokens may be cut, from 0, and their penalties."""
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[1:][ends[ids]] = SENTENCE
    penalty[doc_ends] = 0
    penalty[0] = 0
    at = np.append(np.flatnonzero(penalty >= 0), len(ids))
    for i in np.flatnonzero(np.diff(at) > LONG).tolist():
        penalty[at[i] + EVERY : at[i + 1] : EVERY] = INSIDE
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def agreed(back: list[int], live: range) -> int:
    """The last position that lies on the best ways to all live positions."""
    heap = [-i for i in live]
    heapq.heapify(heap)
    while True:
        last = heapq.heappop(heap)
        while heap and heap[0] == last:
            heapq.heappop(heap)
        if not heap:
            return -last
        heapq.heappush(heap, -back[-last])


def split(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, length: int, last: bool) -> list[int]:
    """Cuts of the tokens held, from 0: all if no more tokens follow, else those that no later token can change."""
    at, penalty = candidates(ids, doc_ends, ends)
    cost, back = plan(at.tolist(), penalty.tolist(), length)
    i = len(at) - 1
    if not last:
        # later tokens may add cuts after the last one found, whose sequences begin less than length before it
        live = range(int(np.searchsorted(at, at[-1] - length)), len(at))
        i = agreed(back, live)
        if not i and len(ids) >= HELD:
            i = min(live, key=lambda k: (cost[k] / max(1, at[k]), -at[k]))
    cuts = [int(at[i])]
    while i:
        i = back[i]
        cuts.append(int(at[i]))
    return cuts[::-1]


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, piece_end string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("piece_end", pa.string())])


def pieces(ids: np.ndarray, cuts: list[int], docs: list[tuple], ends: np.ndarray, first_sequence: int) -> pa.RecordBatch:
    """Rows for the stretches that cuts and documents' ends leave. docs: (doc_id, tokens in all, start in the document,
    tokens here) of the block's documents in order."""
    bounds = np.cumsum([0] + [d[3] for d in docs])
    starts = np.union1d(np.array(cuts[:-1], dtype=np.int64), bounds[:-1][bounds[:-1] < cuts[-1]])
    stops = np.append(starts[1:], cuts[-1])
    doc = np.searchsorted(bounds, starts, side="right") - 1
    sequence = np.searchsorted(cuts, starts, side="right") - 1
    within = starts - bounds[doc] + np.array([d[2] for d in docs], dtype=np.int64)[doc]
    totals = np.array([d[1] for d in docs], dtype=np.int64)[doc]
    end = np.where(within + stops - starts == totals, "document", np.where(ends[ids[stops - 1]], "sentence", "inside"))
    data = pa.py_buffer(ids[: cuts[-1]].astype("<u4").tobytes())
    places = pa.py_buffer(np.append(starts, cuts[-1]).astype(np.int32) * 4)
    return pa.record_batch(
        [pa.array([docs[d][0] for d in doc.tolist()], pa.int64()), pa.array(within), pa.array(stops - starts), pa.Array.from_buffers(pa.binary(), len(starts), [None, places, data]), pa.array(totals), pa.array(first_sequence + sequence), pa.array(starts - np.array(cuts)[sequence]), pa.array(end.tolist(), pa.string())],
        schema=_ARROW,
    )


def _pack(path: str, ranks: str | None, pattern: str | None, end: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, ends = encoder(path, ranks, pattern)
        sequence = TaskContext.get().partitionId() << 33
        held: list[np.ndarray] = []
        docs: list[tuple] = []
        n, more = 0, BLOCK  # tokens held, and how many make the next plan

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, docs, n, sequence, more
            ids = np.concatenate(held)
            ends_at = np.array([stop for stop, d in zip(np.cumsum([d[3] for d in docs]), docs) if d[2] + d[3] == d[1]], dtype=np.int64)
            cuts = split(ids, ends_at, ends, length, last)
            more = len(ids) - cuts[-1] + BLOCK
            if len(cuts) == 1:
                held = [ids]
                return None
            out = pieces(ids, cuts, docs, ends, sequence)
            sequence += len(cuts) - 1
            done, rest, at = cuts[-1], [], 0
            for doc_id, total, start, size in docs:
                if at + size > done:
                    skip = max(0, done - at)
                    rest.append((doc_id, total, start + skip, size - skip))
                at += size
            held, docs, n = [ids[done:]], rest, len(ids) - done
            return out

        for batch in batches:
            column, names = strings(batch.column("text")), batch.column("doc_id").to_pylist()
            for start, stop in text_spans(column):
                for name, text in zip(names[start:stop], column.slice(start, stop - start).to_pylist()):
                    ids = np.append(encode.ids(text), np.uint32(end))
                    for at in range(0, len(ids), BLOCK):
                        part = ids[at : at + BLOCK]
                        held.append(part)
                        docs.append((name, len(ids), at, len(part)))
                        n += len(part)
                        if n >= more and (out := flush(False)):
                            yield out
        if n:
            yield flush(True)

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end: int = 1, length: int = 2048) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most length tokens.

    Of each piece: doc_id, start (tokens of its document before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens (of its document, end token included), sequence_id, offset (in the sequence, gapless from 0) and piece_end
    (`document`, `sentence` or `inside`: where it ends).
    tokenizer: a file of the tokenizers library. ranks, pattern: the same vocabulary for the tiktoken library.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer, ranks, pattern, end, length), SCHEMA)
