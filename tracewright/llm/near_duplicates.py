"""Operator 10: near-duplicate documents by SuperMinHash.

Each document's set of distinct word shingles gets a SuperMinHash signature: every element walks a random permutation of
the signature's slots, its j-th step offering the value j + r at its j-th slot, and the walk stops once no slot can still
fall (the early stop). Slots of one document are thus filled without repetition, which makes the estimate's variance lower
than plain MinHash's. Signatures are cut into bands; documents that share a band are candidates.

No bucket's pairs are written out. Documents with one and the same set are one representative. Then
1. each representative is checked against the lowest representative it shares most bands with, and confirmed links are
   grouped by union-find (within tasks, then by minimum labels over the cluster);
2. representatives that share a bucket share the bucket's lowest one, its lead. The representatives of a lead that still
   are of different groups are searched in pairs of blocks of bounded size: within a task, pairs of different groups whose
   signatures agree enough (a pair at the threshold is left out with a chance under 1e-7) are compared, the likeliest
   first, and union-find skips what has become one group. Only the links that join groups leave the task, fewer than it
   has rows, however large a group of copies is.
Every link is confirmed on the two full sets of 64-bit shingle hashes.

Defined results: null or empty text, or text without words: n_shingles 0, own component, kept. Fewer words than the shingle
size: the whole sequence is one shingle. Repeated rows: one row each, all with the id's result. Null doc_id: the row is
returned with its n_shingles, a null component and kept null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import words as W
from tracewright.llm.shared import by_text, staged, strings

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Ids up to which a set of ids is broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1 << 20
#: Representatives, and shingles of theirs, that a block holds on average.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
_STEP = W.U(0x9E3779B97F4A7C15)


def superminhash(docs: np.ndarray, hashes: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs, slots) of the sets given as sorted (text, hash); a value is step << 32 | random part.

    All elements take their j-th step together. A document leaves when its largest value is below the next step's least.
    """
    values = np.full(n_docs * slots, ~W.U(0))
    at = np.arange(len(docs))
    picks: list[np.ndarray] = []  # of each step so far: the index swapped with the step's own, and what was put there
    placed: list[np.ndarray] = []
    state = None
    for j in range(slots):
        z = W.mix(hashes[at] + W.U((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        r = (z & W.U(0xFFFFFFFF)) | W.U(j << 32)
        k = j + (((z >> W.U(32)) * W.U(slots - j)) >> W.U(32)).astype(np.int64)
        if j < 3:
            here, own = k.copy(), np.full(len(k), j)
            for pick, put in zip(picks, placed):
                here, own = np.where(pick == k, put, here), np.where(pick == j, put, own)
            picks.append(k)
            placed.append(own)
        else:
            if state is None:
                state = np.tile(np.arange(slots, dtype=np.int16), (len(at), 1))
                row = np.arange(len(at))
                for step, (pick, put) in enumerate(zip(picks, placed)):
                    state[row, step] = state[row, pick]
                    state[row, pick] = put
            row = np.arange(len(at))
            here = state[row, k].astype(np.int64)
            state[row, k] = state[:, j]
            state[:, j] = here
        np.minimum.at(values, docs[at] * slots + here, r)
        open_docs = values.reshape(n_docs, slots).max(axis=1) >= W.U((j + 1) << 32)
        stay = open_docs[docs[at]]
        if not stay.any():
            break
        at = at[stay]
        picks, placed = [x[stay] for x in picks], [x[stay] for x in placed]
        state = None if state is None else state[stay]
    return values.reshape(n_docs, slots)


def bands(signatures: np.ndarray) -> np.ndarray:
    """(n_docs, BANDS) keys; a key holds its band's number."""
    cut = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, cut.shape[:2]).copy()
    for k in range(ROWS):
        key = W.mix(key ^ cut[:, :, k]) + _STEP
    return key.view(np.int64)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (text, hash) and the bounds of each text in them."""
    found = W.words(column)
    docs, hashes = W.sets(*W.shingles(found, size), found.n_docs)
    return docs, hashes, np.searchsorted(docs, np.arange(found.n_docs + 1))


def _prints(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, hashes, bounds = shingle_sets(strings(batch.column("text")), size)
        n = batch.num_rows
        signatures = superminhash(docs, hashes, n)
        keys = bands(signatures)
        sketch = W.mix(signatures).astype(np.uint16)
        counts = np.diff(bounds)
        none = counts == 0
        set_key = [None if a == b else hashlib.sha256(hashes[a:b].tobytes()).digest()[:16] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]).astype(np.int32)), pa.array(keys[~none].ravel()))
        return pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(set_key, pa.binary()), lists, pa.array([None if e else x.tobytes() for e, x in zip(none.tolist(), sketch)], pa.binary())], schema=schema)

    return lambda batches: by_text(batches, "text", work)


def _similar(size: int, least: int, of: int):
    """Pairs whose sets have of * intersection >= least * union."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        (_, left, a), (_, right, b) = (shingle_sets(strings(batch.column(c)), size) for c in ("text_a", "text_b"))
        keep = []
        for i in range(batch.num_rows):
            x, y = left[a[i] : a[i + 1]], right[b[i] : b[i + 1]]
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
            keep.append(common > 0 and of * common >= least * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lambda batches: by_text(batches, "text_a", work)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same groups as the batch's links, as one link from each node to its root (union-find)."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        pairs = [(find(x), x) for x in list(root)]
        yield pa.record_batch([pa.array([p[0] for p in pairs if p[0] != p[1]], pa.int64()), pa.array([p[1] for p in pairs if p[0] != p[1]], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of each id in links (a, b): the smallest id that it is linked with over any number of links."""
    links = links.mapInArrow(_forest, "a long, b long")
    both = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = staged(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.min("u")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "comp"), "v").groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        step = staged(step.join(up, "comp", "left").select("id", "old", F.coalesce("up", "comp").alias("comp")))
        if not step.where("comp <> old").head(1):
            return labels
        labels = step.select("id", "comp")


def only(docs: DataFrame, ids: DataFrame, column: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """docs whose id is in ids (or isn't, left_anti). The ids are broadcast if they are few; else the join shuffles."""
    ids = staged(ids.select(F.col(ids.columns[0]).alias(column)).distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def _shingles(size: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, hashes, bounds = shingle_sets(strings(batch.column("text")), size)
        return pa.record_batch({"id": batch.column("id"), "shingles": pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())})

    return lambda batches: by_text(batches, "text", work)


def _block_links(floor: int, least: int, of: int):
    """Of a pair of blocks (side 0 and 1, or side 0 alone): links that join different groups."""

    def work(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["side", "id"], kind="stable")
        ids, side, n = pdf["id"].to_numpy(), pdf["side"].to_numpy(), len(pdf)
        sketch = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint16).reshape(n, SLOTS)
        sizes = np.array([len(x) // 8 for x in pdf["shingles"]])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        known, elements = np.unique(np.frombuffer(b"".join(pdf["shingles"]), dtype=np.uint64), return_inverse=True)
        _, group = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        mark = np.zeros(len(known), bool)
        cross = (side == 1).any()
        out = []
        for i in np.flatnonzero(side == 0).tolist():
            rest = np.flatnonzero(side == 1) if cross else np.arange(i + 1, n)
            rest = rest[group[rest] != group[i]]
            agree = (sketch[rest] == sketch[i]).sum(axis=1)
            rest = rest[np.argsort(-agree, kind="stable")[: (agree >= floor).sum()]]
            mark[elements[bounds[i] : bounds[i + 1]]] = True
            some = 4
            while len(rest):
                now, rest = rest[:some], rest[some:]
                some *= 8
                for j in now.tolist():
                    if group[j] != group[i]:
                        common = int(mark[elements[bounds[j] : bounds[j + 1]]].sum())
                        if of * common >= least * (sizes[i] + sizes[j] - common):
                            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                            group[group == group[j]] = group[i]
                rest = rest[group[rest] != group[i]]
            mark[elements[bounds[i] : bounds[i + 1]]] = False
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return work


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Documents are linked if similarity[1] * |intersection| >= similarity[0] * |union|; a component is what links connect.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least, of = similarity
    floor = int(max(0.0, least / of - 0.18) * SLOTS)
    prints = staged(docs.mapInArrow(_prints(shingle_words), "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"))
    filled = prints.where("set_key is not null and doc_id is not null")
    copies = staged(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    reps = staged(filled.join(copies, "set_key").where("doc_id = rep").select(F.col("rep").alias("id"), "n_shingles", "bands", "sketch"))
    members = reps.select("id", F.explode("bands").alias("bucket"))
    # staged, so that the join below reads both sides from shuffles and a hot bucket's rows can be split
    shared = staged(members.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("bucket", "lead"))
    members = staged(members.join(shared, "bucket").groupBy("lead", "id").count())
    best = members.where("lead < id").groupBy("id").agg(F.min_by("lead", F.struct(-F.col("count"), "lead")).alias("lead"))
    texts = staged(only(docs, members.select("id")).where("doc_id is not null").select(F.col("doc_id").alias("id"), "text"))
    links = staged(
        best.select(F.col("lead").alias("a"), F.col("id").alias("b"))
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .mapInArrow(_similar(shingle_words, least, of), "a long, b long")
    )
    grouped = members.select("lead", "id").join(components(links), "id", "left").select("lead", "id", F.coalesce("comp", "id").alias("comp"))
    grouped = grouped.join(reps.select("id", "n_shingles"), "id")
    mixed = grouped.groupBy("lead").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("size")).where("low < high")
    mixed = staged(mixed.select("lead", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    open_rows = staged(grouped.join(mixed, "lead").select("lead", "id", "comp", "blocks"))
    sets = only(texts, open_rows.select("id"), "id").mapInArrow(_shingles(shingle_words), "id long, shingles binary")
    rows = open_rows.join(reps.select("id", "sketch"), "id").join(sets.dropDuplicates(["id"]), "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    sides = rows.withColumn("own", own).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    sides = sides.select("lead", "id", "comp", "sketch", "shingles", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), F.expr("if(own <= with, 0, 1)").alias("side"))
    joined = staged(sides.groupBy("lead", "p", "q").applyInPandas(_block_links(floor, least, of), "a long, b long"))
    labels = components(links.union(joined))
    comp = filled.select("doc_id", "set_key").join(copies, "set_key").select("doc_id", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    comp = comp.groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("comp"))
    out = prints.select("doc_id", "n_shingles").join(comp, "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
