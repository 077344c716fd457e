"""Operator 6: toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of a few characters, each hashed to 64 bits. Of a bounded sample of
labelled documents, the terms whose counts in the two classes differ beyond chance (likelihood ratio) become features, and
so do both terms of a pair that tells beyond chance more together than either alone; pairs are counted among the FEATURES
terms that stand in most documents. A feature's value grows with the logarithm of its count. The machine's score is a logistic function of a bias, linear weights
and all pairwise products of latent vectors, so that two terms together can weigh more, or less, than the sum of both. It
is fitted by Adagrad on the driver, from the features alone.

Defined results: null or empty text: the score of a text without any feature. Without labelled rows of both classes the
score is the share of label 1 (0.5 if there are no labels). Repeated rows give one row each. Ties at the limit of features
go to the lower hash. A doc_id labelled twice is sampled once for each label, one with several texts with the least of them;
labels without a document don't count. doc_id must be castable to long; other columns are ignored or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import words as W
from tracewright.llm.shared import by_text, staged, strings

#: Bounds: labelled documents of each class in the sample, and features.
SAMPLE, FEATURES = 4000, 4096
PREFIXES = (4, 5, 6, 7)
RANK, EPOCHS, RATE, DECAY = 6, 60, 0.05, 1e-4
#: Least likelihood ratio (chi-squared with one degree of freedom) for a feature: chance alone gives one in 1e9 terms.
CHANCE = 38.0
SEPARATORS = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, hash) of each word and each word's beginnings, and the number of texts."""
    lowered = pa.array([t.lower() for t in strings(column).to_pylist()], pa.string())
    found = W.words(lowered, SEPARATORS, lower=False)
    chars = np.flatnonzero((found.data & 0xC0) != 0x80)
    edge = np.append(chars, len(found.data))
    first, stop = np.searchsorted(chars, found.starts), np.searchsorted(chars, found.ends)
    docs, hashes = [found.doc], [found.hashes()]
    for n in PREFIXES:
        longer = stop - first > n
        docs.append(found.doc[longer])
        hashes.append(found.hashes(found.starts[longer], edge[first[longer] + n]) ^ W.U(0x5555 + n))
    return np.concatenate(docs), np.concatenate(hashes), found.n_docs


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, a, b): in how many texts of label 1 and of label 0 each term stands."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, hashes, n = terms(batch.column("text"))
        docs, hashes = W.sets(docs, hashes, n)
        toxic = np.asarray(batch.column("toxic")) == 1
        known, back = np.unique(hashes, return_inverse=True)
        a = np.bincount(back, weights=toxic[docs], minlength=len(known)).astype(np.int64)
        return pa.record_batch({"term": pa.array(known.view(np.int64)), "a": pa.array(a), "b": pa.array(np.bincount(back, minlength=len(known)) - a)})

    return by_text(batches, "text", work)


class Machine:
    def __init__(self, known: np.ndarray, bias: float, linear: np.ndarray, latent: np.ndarray) -> None:
        self.known, self.bias, self.linear, self.latent = known, bias, linear, latent

    def score(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 of n texts, from their (text, feature, value)."""
        total = self.bias + np.bincount(doc, weights=self.linear[feature] * value, minlength=n)
        for k in range(self.latent.shape[1]):
            part = self.latent[feature, k] * value
            total += 0.5 * (np.bincount(doc, weights=part, minlength=n) ** 2 - np.bincount(doc, weights=part**2, minlength=n))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(text, feature, value) of a column, and the number of texts."""
        docs, hashes, n = terms(column)
        if not len(self.known) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), n
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        pairs, counts = np.unique(docs[hit] * len(self.known) + at[hit], return_counts=True)
        return pairs // len(self.known), pairs % len(self.known), np.log2(1.0 + counts), n

    def predict(self, column: pa.Array) -> np.ndarray:
        return self.score(*self.features(column))


def fit(known: np.ndarray, rows: list[tuple[list[int], list[float]]], labels: np.ndarray, seed: int = 11) -> Machine:
    """A machine over the sorted term hashes known, from (features, values) and label of each document."""
    share = labels.mean() if len(labels) else 0.5
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    rng = np.random.default_rng(seed)
    made = Machine(known, bias, np.zeros(len(known)), rng.normal(0, 0.01, (len(known), RANK)))
    if not len(rows) or not 0 < share < 1:
        return made
    chosen = known
    sizes = [len(r[0]) for r in rows]
    doc = np.repeat(np.arange(len(rows)), sizes)
    feature = np.array([f for r in rows for f in r[0]], dtype=np.int64)
    value = np.array([v for r in rows for v in r[1]], dtype=np.float64)
    grads = [np.full(len(chosen), 1e-8), np.full((len(chosen), RANK), 1e-8)]
    bias_grad, bounds = 1e-8, np.searchsorted(doc, np.arange(len(rows) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            picked = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in batch])
            local = np.repeat(np.arange(len(batch)), bounds[batch + 1] - bounds[batch])
            f, x = feature[picked], value[picked]
            error = (made.score(local, f, x, len(batch)) - labels[batch]) / len(batch)
            made.bias -= RATE * error.sum() / np.sqrt(bias_grad := bias_grad + error.sum() ** 2)
            if not len(f):
                continue
            step = np.bincount(f, weights=error[local] * x, minlength=len(chosen))
            step += DECAY * made.linear * (step != 0)
            grads[0] += step**2
            made.linear -= RATE * step / np.sqrt(grads[0])
            for k in range(RANK):
                v = made.latent[f, k]
                whole = np.bincount(local, weights=v * x, minlength=len(batch))
                step = np.bincount(f, weights=error[local] * x * (whole[local] - v * x), minlength=len(chosen))
                step += DECAY * made.latent[:, k] * (step != 0)
                grads[1][:, k] += step**2
                made.latent[:, k] -= RATE * step / np.sqrt(grads[1][:, k])
    return made


def pair_ratios(doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, pool: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Of each feature, the greatest likelihood ratio of a pair with another of the pool that exceeds those of both by
    CHANCE; 0 without one. From the distinct (doc, feature) and each document's label."""
    best, place = np.zeros(len(single)), np.full(len(single), -1)
    place[pool] = np.arange(len(pool))
    inside = place[feature] >= 0
    there = []
    for label in (1, 0):
        rows = np.cumsum(toxic == label) - 1
        own = inside & (toxic[doc] == label)
        there.append(np.zeros((int((toxic == label).sum()), len(pool)), np.float32))
        there[-1][rows[doc[own]], place[feature[own]]] = 1
    n = [float(len(x)) for x in there]

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(expected, 1e-300)), 0.0)

    for start in range(0, len(pool), 256):
        own = slice(start, start + 256)
        together = [(x[:, own].T @ x).astype(np.float64) for x in there]
        share = (together[0] + together[1]) / sum(n)
        ratio = 2 * sum(part(c, m * share) + part(m - c, m * (1 - share)) for c, m in zip(together, n))
        alone = np.maximum(single[pool[own]][:, None], single[pool][None, :])
        best[pool[own]] = np.where(ratio - alone >= CHANCE, ratio, 0).max(axis=1)
    return best


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, features: int = FEATURES) -> Machine:
    """A machine from docs (doc_id, text) and labels (doc_id, toxic): of each class the per_class labelled documents with
    the lowest hash of doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").distinct()
    sample = []
    for label in (0, 1):
        sample += labels.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    if not sample:
        return fit(np.zeros(0, np.uint64), [], np.zeros(0))
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in sample], "doc_id long, toxic int")
    texts = staged(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    there = {r["toxic"]: float(r["count"]) for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = there.get(1, 0.0), there.get(0, 0.0)
    if not there:
        return fit(np.zeros(0, np.uint64), [], np.array([r["toxic"] for r in sample], np.float64))
    tallied = texts.mapInArrow(_tallied, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    mean = (F.col("a") + F.col("b")) / (n1 + n0)

    def part(x, of: float, share):
        return F.when(x > 0, x * F.log(x / (of * share))).otherwise(0.0)

    ratio = 2 * (part(F.col("a"), n1, mean) + part(F.col("b"), n0, mean) + part(n1 - F.col("a"), n1, 1 - mean) + part(n0 - F.col("b"), n0, 1 - mean))
    known = pool = np.zeros(0, np.uint64)
    ratios = {}
    if n0 and n1:
        counted = staged(tallied.withColumn("ratio", ratio))
        single = counted.where(F.col("ratio") >= CHANCE).orderBy(F.desc("ratio"), "term").limit(features).collect()
        common = counted.orderBy(F.desc(F.col("a") + F.col("b")), "term").limit(features).collect()
        ratios = {r["term"]: r["ratio"] for r in single + common}
        pool = np.sort(np.array([r["term"] for r in common], dtype=np.int64).view(np.uint64))
        known = np.sort(np.array(list(ratios), dtype=np.int64).view(np.uint64))
    empty = docs.sparkSession.sparkContext.broadcast(Machine(known, 0.0, np.zeros(len(known)), np.zeros((len(known), 0))))

    def featured(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, feature, value, n = empty.value.features(batch.column("text"))
        bounds = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "features": lists[0], "counts": lists[1]})

    found = texts.mapInArrow(lambda batches: by_text(batches, "text", featured), "doc_id long, toxic int, features array<int>, counts array<float>").toArrow()
    ids, toxic = (found.column(x).to_numpy() for x in ("doc_id", "toxic"))
    lists = [x for x in found.column("features").chunks]
    doc = np.repeat(np.arange(len(ids)), np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy() for x in lists)]).astype(np.int64))
    feature = np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in lists)])
    value = np.concatenate([np.zeros(0, np.float32), *(x.flatten().to_numpy() for x in found.column("counts").chunks)])
    del found, lists  # the driver's memory holds them once
    score = np.array([ratios[t] for t in known.view(np.int64).tolist()], np.float64)
    if len(pool):
        score = np.maximum(score, pair_ratios(doc, feature, toxic, np.searchsorted(known, pool), score))
    chosen = np.flatnonzero(score >= CHANCE)
    chosen = np.sort(chosen[np.lexsort((known[chosen].view(np.int64), -score[chosen]))][:features])
    held = np.isin(feature, chosen)
    doc, feature, value = doc[held], np.searchsorted(chosen, feature[held]), value[held]
    bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
    rows = [(d, t, feature[i:j].tolist(), value[i:j].tolist()) for d, t, i, j in zip(ids.tolist(), toxic.tolist(), bounds[:-1], bounds[1:])]
    rows.sort(key=lambda r: r[:3])
    return fit(known[chosen], [r[2:] for r in rows], np.array([r[1] for r in rows], np.float64))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(shared.value.predict(batch.column("text")), pa.float64())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda batches: by_text(batches, "text", work), "doc_id long, score double")


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.predict(batch.column("text")) < threshold))

    return docs.mapInArrow(lambda batches: by_text(batches, "text", work), docs.schema)
