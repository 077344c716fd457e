"""Operator 3: language identification, words first, then shorter and shorter character n-grams.

Training counts words and the character n-grams of distinct words for each language on a bounded sample of the labelled
documents; each count becomes a log frequency, above a floor that all
languages share, so that one of few documents isn't favoured by what it lacks. Words are runs of letters; one of over WHOLE characters, as scripts
without spaces have them, is learned and looked up by its n-grams alone. A word the model knows adds its log frequencies; a word it doesn't
know is looked up by its n-grams, longest first: what the longest length leaves without any known n-gram falls back to the
next length. The language with the highest sum wins; the score is its share after a softmax of the mean per word times the
square root of the number of words, so long texts are surer than short ones without overflowing to 1 at once.

Defined results: a null text, or one without a letter: `und`, score 0. A text with letters but nothing known: the language
with the most training documents, score 1 / languages. Without training rows every prediction is `und`, score 0. Ties go
to the first language in order. Repeated rows give one row each; a doc_id is sampled once for each label, with the least
of its texts; labels of null language aren't learned. Of more than LANGUAGES languages the most frequent are learned, and
documents of the others get one of those. doc_id must be castable to long; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tracewright.llm import words as W
from tracewright.llm.shared import by_text, staged, strings

#: Bounds of the training sample (documents of each language, languages) and of the model (entries).
SAMPLE, LANGUAGES, ENTRIES = 1500, 200, 150_000
LENGTHS = (5, 4, 3, 2, 1)
#: Characters up to which a word is learned as a whole.
WHOLE = 40
#: What a word found by n-grams counts for against a known word.
BACKOFF = 0.5
SEPARATORS = np.array([c < 0x80 and not chr(c).isalpha() for c in range(256)])
_LETTER = re.compile(r"[^\W\d_]")
_APART = re.compile(r"[^\x00-\x7f\w]+")


def plain(text: str) -> str:
    """In lower case, with signs beyond ASCII that no word holds as blanks."""
    text = text.lower()
    return text if text.isascii() else _APART.sub(" ", text)


def _word_grams(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[i : i + n] for n in LENGTHS for i in range(len(marked) - n + 1)} - {"^", "$"}


_SPLIT = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for text, lang in zip(strings(batch.column("text")).to_pylist(), batch.column("lang").to_pylist()):
            found.setdefault(lang, Counter()).update(w for w in _SPLIT.split(plain(text)) if w)
        rows: Counter = Counter()
        for lang, counts in found.items():
            for word, n in counts.items():
                if len(word) <= WHOLE:
                    rows[lang, f"w{word}"] += n
                for gram in _word_grams(word):
                    rows[lang, f"g{gram}"] += 1
        yield pa.record_batch([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["lang", "item", "n"])


class Model:
    """known: sorted hashes of words and n-grams. logs: a row of log frequencies for each."""

    def __init__(self, languages: list[str], rows: list[tuple[str, str, int]], prior: dict[str, int]) -> None:
        self.languages = languages
        self.prior = max(range(len(languages)), key=lambda i: prior.get(languages[i], 0), default=0)
        place = {x: i for i, x in enumerate(languages)}
        items = sorted({item for _, item, _ in rows})
        at = {item: i for i, item in enumerate(items)}
        counts = np.zeros((len(items), max(1, len(languages))))
        for lang, item, n in rows:
            counts[at[item], place[lang]] += n
        logs = np.zeros_like(counts)
        for kind in "wg":
            own = np.array([x[0] == kind for x in items], bool)
            if own.any():
                total = counts[own].sum(axis=0)
                logs[own] = np.log(counts[own] / np.maximum(total, 1) + 0.5 / max(1, total.max()))
        hashes = W.words(pa.array([x[1:] for x in items], pa.string()), np.zeros(256, bool), lower=False)
        keys = np.zeros(len(items), np.uint64)
        keys[hashes.doc] = hashes.hashes()
        keys ^= np.where([x[0] == "g" for x in items], W.U(0xA5A5A5A5A5A5A5A5), W.U(0)).astype(np.uint64) if items else W.U(0)
        order = np.argsort(keys)
        self.known, self.logs = keys[order], logs[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, at, -1)

    def unseen(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log frequencies of the longest known n-grams of each word, and whether there are any."""
        found = W.words(pa.array([f"^{w}$" for w in words], pa.string()), np.zeros(256, bool), lower=False)
        chars = np.flatnonzero((found.data & 0xC0) != 0x80)
        owner = np.searchsorted(found.offsets, chars, side="right") - 1
        edge = np.append(chars, len(found.data))
        scores, left = np.zeros((len(words), len(self.languages)), np.float64), np.ones(len(words), bool)
        for n in LENGTHS:
            if len(chars) < n or not left.any():
                continue
            whole = (owner[: len(chars) - n + 1] == owner[n - 1 :]) & left[owner[: len(chars) - n + 1]]
            at = np.flatnonzero(whole)
            rows = self.find(found.hashes(chars[at], edge[at + n]) ^ W.U(0xA5A5A5A5A5A5A5A5))
            hit = rows >= 0
            own = owner[at[hit]]
            n_hits = np.bincount(own, minlength=len(words))
            for k in range(len(self.languages)):
                scores[:, k] += np.bincount(own, weights=self.logs[rows[hit], k], minlength=len(words)) / np.maximum(n_hits, 1)
            left &= n_hits == 0
        return scores * BACKOFF, ~left

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n, size = len(texts), len(self.languages)
        lowered = [plain(t) for t in strings(texts).to_pylist()]
        letters = np.array([bool(_LETTER.search(t)) for t in lowered], bool)
        if not size:
            return ["und"] * n, np.zeros(n)
        found = W.words(pa.array(lowered, pa.string()), SEPARATORS, lower=False)
        keys, first, back = np.unique(found.hashes(), return_index=True, return_inverse=True)
        rows = self.find(keys)
        logs = np.where(rows[:, None] >= 0, self.logs[rows] if len(self.known) else 0.0, 0.0).astype(np.float64)
        usable = rows >= 0
        missing = np.flatnonzero(~usable)
        if len(missing):
            starts, ends = found.starts[first[missing]], found.ends[first[missing]]
            held = found.data.tobytes()
            logs[missing], usable[missing] = self.unseen([held[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
        total = np.stack([np.bincount(found.doc, weights=logs[back, k], minlength=n) for k in range(size)], axis=1)
        heard = np.bincount(found.doc, weights=usable[back], minlength=n)
        scaled = total / np.maximum(np.sqrt(heard), 1)[:, None]
        share = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = np.where(heard > 0, share.argmax(axis=1), self.prior)
        score = np.where(letters, np.where(heard > 0, share[np.arange(n), best], 1.0 / size), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())], score


def sample(labelled: DataFrame, per_language: int, prior: dict[str, int]) -> DataFrame:
    """(doc_id, lang): of each language in prior per_language documents, those of the lowest hash of doc_id.

    The number of a language's distinct ids, as sketched, gives a hash below which per_language of them lie but for one
    chance in a billion; only ids below it are ranked, so no task sorts more than about per_language ids of a language.
    """
    space = 1 << 32
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    ids = labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).where(F.col("lang").isin(list(prior)))
    reach = per_language + 6 * per_language**0.5 + 36
    limits = F.broadcast(ids.select("lang", F.least(F.lit(space), F.ceil(space * reach / (0.88 * F.col("n")))).alias("limit")))
    near = labelled.select("doc_id", "lang").join(limits, "lang").where(hashed < F.col("limit")).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Over.partitionBy("lang").orderBy(hashed, "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang")


def train(labelled: DataFrame, per_language: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """A model from labelled (doc_id, text, lang): of each language the per_language documents of the lowest hash.

    The sample is at most per_language * LANGUAGES documents, the model at most `entries` words and n-grams, the most
    frequent in the sample.
    """
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null")
    counted = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    prior = {r["lang"]: r["count"] for r in counted}
    if not prior:
        return Model([], [], {})
    chosen = staged(sample(labelled, per_language, prior))
    texts = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    counts = texts.select("text", "lang").mapInArrow(_count, "lang string, item string, n long").groupBy("item", "lang").agg(F.sum("n").alias("n"))
    items = counts.groupBy("item").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("langs")).orderBy(F.desc("n"), "item").limit(entries)
    rows = [(x["lang"], r["item"], x["n"]) for r in items.select("item", "langs").toLocalIterator() for x in r["langs"]]
    return Model(sorted(prior), rows, prior)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = shared.value.predict(batch.column("text"))
        return pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda batches: by_text(batches, "text", work), "doc_id long, lang_pred string, score double")
