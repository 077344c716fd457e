"""Words of many texts at once, found and hashed over their UTF-8 bytes without a loop over words.

A text's hash parts are sums of byte values times powers of an odd base modulo 2**64, so that any stretch's hash
follows from prefix sums; a final mixing spreads it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}

#: `[\x20\x09-\x0D]`
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: `[\x00-\x2F\x3A-\x60\x7B-\x7F]`
NOT_ALNUM = np.array([c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= 1 << 23:
            _POWERS[base] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Words:
    """data: bytes of all texts, one after another. offsets: where each text starts, and the end. starts, ends, doc: of
    each word. sums: prefix sums for hashes."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    sums: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Of the words, or of the given stretches of bytes."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        h = (self.sums[ends] - self.sums[starts]) * _powers(_INVERSE, len(self.data) + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(apart: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of bytes that aren't apart; none crosses the end of a text."""
    n = len(apart)
    inside = ~apart
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """What hashes of stretches of the bytes are taken from."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(_BASE, len(data) + 1)[: len(data)], out=sums[1:])
    return sums


def words(column: pa.Array, separators: np.ndarray = SPACES, lower: bool = True) -> Words:
    """The words of a string column: stretches without separator bytes; A-Z in lower case if asked for."""
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    starts, ends = spans(separators[data], offsets)
    return Words(data, offsets, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, prefix_sums(data))


_SHINGLE = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)


def shingles(found: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of size words; a text of fewer words gives its whole sequence, one without words nothing."""
    h = found.hashes() if hashes is None else hashes
    counts, first = found.counts(), found.first()
    n = len(h)
    docs, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total = mix(total + h[k : n - size + 1 + k] * _SHINGLE[k])
        whole = found.doc[: n - size + 1] == found.doc[size - 1 :]
        docs.append(found.doc[: n - size + 1][whole])
        out.append(total[whole])
    for doc in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        total = np.zeros(1, np.uint64)
        for k in range(counts[doc]):
            total = mix(total + h[first[doc] + k : first[doc] + k + 1] * _SHINGLE[k])
        docs.append(np.array([doc]))
        out.append(mix(total + U(int(counts[doc]))))
    return np.concatenate(docs), np.concatenate(out)


def sets(docs: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash), in this order."""
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    bounds = np.searchsorted(docs, np.arange(n_docs + 1))
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hashes[start:stop].sort()
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]
