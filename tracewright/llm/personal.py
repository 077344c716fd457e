"""Operator 9: personal data, by fixed patterns and by bootstrapped contextual extraction.

Four kinds have fixed patterns (email, ip, card, phone). Their spans, and tokens of the documented key shapes, are the seeds.
The two and the three words or signs before a place, within its line, are its lexical patterns; every identifier-like token
(with a digit, of LEAST characters or more) in the corpus is an instance of the patterns before it. Spark scores this graph by
turns. A pattern's confidence is the share of all places in the corpus where its words stand, whatever follows them, that an
instance follows, weighted by the instances' scores; it is trusted if that is TRUST or more and its distinct instances'
scores sum up to SUPPORT. An instance scores 1 if it is a seed, else KEEP times the confidence of its best trusted pattern,
so what one turn discovers supports further patterns in the next. At last every identifier-like token after a trusted
pattern becomes a span of kind `id`, whatever it looks like: phones and cards in other notations, account numbers, keys.

Defined results: null or empty text: no spans. Spans are offsets in code points, end exclusive. Spans of one kind don't
overlap; an `id` span overlaps no other span. At the start of a line a sign stands for the missing word; a token with no word
before it in its line is no instance. Repeated rows give one row each, and their places count as often (instances are
distinct). Ties don't arise: scores are compared with thresholds only. In redacted text overlapping spans are one. doc_id
must be castable to long; other columns stay, whatever their names. Lines, contexts and tokens may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import words as W
from tracewright.llm.shared import by_text, settled, staged, strings

KINDS = ("email", "ip", "card", "phone", "id")
#: Least sum of the scores of a trusted pattern's instances, its least confidence, turns of scoring, what a turn's score keeps.
SUPPORT, TRUST, TURNS, KEEP = 3.0, 0.5, 4, 0.9
#: Least characters of an identifier-like token.
LEAST = 5
#: Patterns up to which they are broadcast; beyond, they are joined.
BROADCAST_PATTERNS = 1 << 17

_LOCAL = "".join(chr(c) for c in range(128) if chr(c).isalnum()) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_APART = r"\s\"'`<>(){}\[\],;|"
_TOKEN = re.compile(rf"(?<![^{_APART}])[^{_APART}0-9]*+[0-9][^{_APART}]*+")
#: Shapes of keys whose tokens are seeds: hexadecimal digests, UUIDs, prefixed access tokens.
SEED_SHAPES = (
    r"(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"sk-[A-Za-z0-9_-]{20,}",
)
_SEED = re.compile("|".join(SEED_SHAPES))
_EDGE = ".:!?#$%&*=\\/"
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern's leftmost matches, in linear time: a match is the longest local part before an @ and its domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as in KINDS, then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m.group().split("."))] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


#: Of bytes: 0 white space, 1 letters and all beyond ASCII, 2 digits, 3 signs.
_CLASS = np.array([0 if W.SPACES[c] else 1 if c >= 0x80 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], dtype=np.uint8)
_DIGITS, _LINE = W.U(0x6D1C7B0F35E24A91), W.U(0x2F8B64D09A3C71E5)


@dataclass
class Contexts:
    """Of the runs of letters, digits or signs in all texts of a column: where they end, their line, the hashes of the patterns
    that end with them (two: of it and the one before; three: also the one before that, 0 if there is none), and whether
    something follows them in their line. lines: the line of each byte."""

    offsets: np.ndarray
    ends: np.ndarray
    line: np.ndarray
    two: np.ndarray
    three: np.ndarray
    followed: np.ndarray
    lines: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Contexts:
        data, offsets = W.raw(column)
        kind, plain = _CLASS[data], W.LOWER[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets] = True
        inside = kind > 0
        starts, ends = np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside) + 1
        # a text's end ends a line
        breaks = (data == 10).astype(np.int64)
        np.add.at(breaks, offsets[1:-1][offsets[1:-1] < len(data)], 1)
        lines = np.cumsum(breaks)
        line = lines[starts] if len(starts) else np.zeros(0, np.int64)
        h = W.Words(plain, offsets, starts, ends, line, W.prefix_sums(plain)).hashes()
        h = np.where(kind[starts] == 2, _DIGITS, h) if len(starts) else h
        before, first = np.full(len(h), _LINE), np.ones(len(h), bool)
        first[1:] = line[1:] != line[:-1]
        before[1:] = np.where(first[1:], _LINE, h[:-1])
        two = W.mix(W.mix(before) * W.U(3) + h)
        earlier = np.full(len(h), _LINE)
        earlier[1:] = np.where(first[1:], _LINE, before[:-1])
        three = np.where(first, W.U(0), W.mix(W.mix(earlier) * W.U(5) + two))
        followed = np.zeros(len(h), bool)
        followed[:-1] = ~first[1:]
        return cls(offsets, ends, line, two.view(np.int64), three.view(np.int64), followed, lines, data)

    def before(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The patterns (two, three) that end last before each place (a byte); 0 for none."""
        if not len(self.ends) or not len(places):
            return np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        at = np.searchsorted(self.ends, places, side="right") - 1
        there = (at >= 0) & (self.line[at] == self.lines[places])
        return np.where(there, self.two[at], 0), np.where(there, self.three[at], 0)


def _hashed(texts: list[str]) -> np.ndarray:
    found = W.words(pa.array(texts, pa.string()), np.zeros(256, bool), lower=False)
    out = np.zeros(len(texts), np.uint64)
    out[found.doc] = found.hashes()
    return out.view(np.int64)


def identifiers(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, bool, int, int]]:
    """(token, whether it is a seed, start, end) of each identifier-like token that overlaps no base span."""
    out = []
    if not _DIGIT.search(text):
        return out
    free = 0  # up to here tokens are compared with base spans; `taken` holds those that end later, by start
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    for m in _TOKEN.finditer(text):
        token = m.group().strip(_EDGE)
        a = m.start() + len(m.group()) - len(m.group().lstrip(_EDGE))
        if any(c in token for c in ":="):
            cut = max(token.rfind(c) for c in ":=") + 1
            a, token = a + cut, token[cut:]
        b = a + len(token)
        while k < len(taken) and taken[k][0] < b:
            free = max(free, taken[k][1])
            k += 1
        # all spans that begin before b have been seen: one that ends after a overlaps the token
        if len(token) >= LEAST and _DIGIT.search(token) and free <= a:
            out.append((token, bool(_SEED.fullmatch(token)), a, b))
    return out


@dataclass
class Instances:
    """Of all texts of a column: base spans of each, and of each instance its text's number, patterns, token, whether it is a
    seed, start and end; is_base tells those that base spans give."""

    base: list[list[tuple[str, int, int]]]
    doc: np.ndarray
    two: np.ndarray
    three: np.ndarray
    tokens: list[str]
    seed: np.ndarray
    spans: list[tuple[int, int]]
    is_base: np.ndarray
    contexts: Contexts

    @classmethod
    def of(cls, column: pa.Array) -> Instances:
        texts = column.to_pylist()
        base = [base_spans(t) for t in texts]
        contexts = Contexts.of(column)
        rows, places = [], []
        for i, (text, spans) in enumerate(zip(texts, base)):
            own = [(text[a:b], True, a, b, True) for _, a, b in spans] + [(*x, False) for x in identifiers(text, spans)]
            if own:
                start, stop = contexts.offsets[i], contexts.offsets[i + 1]
                at = np.array([x[2] for x in own])
                if stop - start != len(text):
                    at = np.flatnonzero((contexts.data[start:stop] & 0xC0) != 0x80)[at]
                places.append(start + at)
                rows += [(i, *x) for x in own]
        two, three = contexts.before(np.concatenate(places) if places else np.zeros(0, np.int64))
        column_of = lambda k, kind: np.array([r[k] for r in rows], kind)
        return cls(base, column_of(0, np.int64), two, three, [r[1] for r in rows], column_of(2, bool), [(r[3], r[4]) for r in rows], column_of(5, bool), contexts)

    def trusted(self, hit: np.ndarray) -> list[list[tuple[str, int, int]]]:
        """Spans of each text: base ones, and the other instances that are hit."""
        out = [list(x) for x in self.base]
        for k in np.flatnonzero(hit & ~self.is_base).tolist():
            out[self.doc[k]].append(("id", *self.spans[k]))
        return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Instances.of(strings(batch.column("text")))
        instance, seed = _hashed(found.tokens), found.seed.astype(np.float64)
        pattern = np.concatenate([found.two, found.three])
        there = pattern != 0
        return pa.record_batch({"pattern": pa.array(pattern[there]), "instance": pa.array(np.tile(instance, 2)[there]), "seed": pa.array(np.tile(seed, 2)[there])})

    return by_text(batches, "text", work)


def _standing(known: np.ndarray | None):
    """(pattern, n): how often patterns stand where something follows them; of the sorted known ones, or all."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Contexts.of(strings(batch.column("text")))
        stand = np.concatenate([found.two[found.followed], found.three[found.followed]])
        if known is not None:
            at = np.minimum(np.searchsorted(known, stand), max(0, len(known) - 1))
            stand = stand[known[at] == stand] if len(known) else stand[:0]
        pattern, n = np.unique(stand[stand != 0], return_counts=True)
        return pa.record_batch({"pattern": pa.array(pattern), "n": pa.array(n.astype(np.int64))})

    return lambda batches: by_text(batches, "text", work)


def scored_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, confidence, support, trusted) of the lexical patterns with enough instances; patterns are hashes."""
    docs = docs.select("text")
    edges = docs.mapInArrow(_edges, "pattern long, instance long, seed double").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("times"))
    edges = staged(edges)
    wide = staged(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("pattern"))
    few = wide.count() <= BROADCAST_PATTERNS
    known = np.sort(np.array([r["pattern"] for r in wide.collect()], np.int64)) if few else None
    standing = docs.mapInArrow(_standing(known), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    standing = staged(standing if few else standing.join(wide, "pattern"))
    edges = staged(edges.join(standing, "pattern"))
    scores = edges.groupBy("instance").agg(F.max("seed").alias("score"))
    for turn in range(TURNS):
        scores = staged(scores)
        own = edges.join(scores, "instance").groupBy("pattern").agg(F.sum(F.col("times") * F.col("score")).alias("hits"), F.sum("score").alias("support"), F.max("n").alias("n"))
        confidence = F.least(F.lit(1.0), F.col("hits") / F.greatest("n", F.lit(1)))
        own = own.select("pattern", confidence.alias("confidence"), "support")
        patterns = staged(own.withColumn("trusted", (F.col("confidence") >= TRUST) & (F.col("support") >= SUPPORT)))
        if turn + 1 < TURNS:
            kept = patterns.select("pattern", F.when(F.col("trusted"), KEEP * F.col("confidence")).otherwise(0.0).alias("kept"))
            scores = edges.join(kept, "pattern").groupBy("instance").agg(F.greatest(F.max("seed"), F.max("kept")).alias("score"))
    return patterns


def trusted_patterns(docs: DataFrame) -> DataFrame:
    """(pattern) of the trusted ones."""
    return settled(lambda: scored_patterns(docs).where("trusted").select("pattern"))


def _applied(docs: DataFrame, make, schema) -> DataFrame:
    """make(batch, spans of each text) over docs, with the trusted patterns at hand."""
    trusted = trusted_patterns(docs)
    if trusted.count() <= BROADCAST_PATTERNS:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["pattern"] for r in trusted.collect()], np.int64)))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = Instances.of(strings(batch.column("text")))
            return make(batch, found.trusted(np.isin(found.two, shared.value) | np.isin(found.three, shared.value)))

        return docs.mapInArrow(lambda batches: by_text(batches, "text", work), schema)
    free = next(x for x in (f"__trusted_{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    key = f"{free}_key"
    keyed = docs.withColumn(key, F.sha2("text", 256))

    def seen(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Instances.of(strings(batch.column("text")))
        patterns = [[] for _ in range(batch.num_rows)]
        for doc, two, three in zip(found.doc.tolist(), found.two.tolist(), found.three.tolist()):
            patterns[doc] += [two, three]
        return pa.record_batch({"key": batch.column("key"), "patterns": pa.array([sorted(set(x) - {0}) for x in patterns], pa.list_(pa.int64()))})

    own = keyed.select(F.col(key).alias("key"), "text").where("text is not null").mapInArrow(lambda batches: by_text(batches, "text", seen), "key string, patterns array<long>")
    own = own.select("key", F.explode("patterns").alias("pattern")).distinct().join(trusted, "pattern").groupBy("key").agg(F.collect_set("pattern").alias(free))

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Instances.of(strings(batch.column("text")))
        sets = [frozenset(x or ()) for x in batch.column(free).to_pylist()]
        hit = np.array([a in sets[d] or b in sets[d] for d, a, b in zip(found.doc.tolist(), found.two.tolist(), found.three.tolist())], bool)
        return make(batch.drop_columns([free]), found.trusted(hit))

    own = own.withColumnRenamed("key", key)
    return keyed.join(own, key, "left").drop(key).mapInArrow(lambda batches: by_text(batches, "text", joined), schema)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of docs (doc_id, text); a span: kind, start, end, text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def make(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        texts = strings(batch.column("text")).to_pylist()
        rows = [[{"kind": k, "start": a, "end": b, "text": t[a:b]} for k, a, b in s] for t, s in zip(texts, spans)]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(rows, kind)})

    return _applied(docs, make, "doc_id long, spans array<struct<kind: string, start: long, end: long, text: string>>")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, free = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if b > free:
            if a >= free:
                out += [text[free:a], f"[{kind.upper()}]"]
            free = b
    return "".join([*out, text[free:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...), each span replaced by its kind in brackets; n_chars, if there, follows. Null text stays."""
    columns = docs.columns

    def make(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        texts = [None if t is None else masked(t, s) for t, s in zip(batch.column("text").to_pylist(), spans)]
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            at = batch.schema.field("n_chars").type
            new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column("n_chars").to_pylist())]).cast(at)
        return pa.record_batch({c: new.get(c, batch.column(c)) for c in columns})

    return _applied(docs, make, docs.schema)
