"""Operator 8: quality rules from tokeniser fertility.

Public vocabularies, one of pieces with byte fallback and one of byte-level BPE, measure each document: characters per token,
the share of tokens that are fallback bytes (pieces) or parts of characters (byte-level), and the entropy of its tokens
(bits, divided by the most that so many tokens can have). The quartiles of the documents that pass the plain rules give
rejection bands for each language (as labelled, within a script), so that what a vocabulary splits finely is compared with
its like: a document is rejected if a measure lies more than `width` interquartile ranges (and at least a small margin)
outside the quartiles. A language's quartiles are blended with its script's, and those with the whole corpus's, as if
`least` documents more had the wider group's: so a rare language leans on its script, and no count switches from one band to
another. Measures of short texts scatter, so below `settled` words a band widens with the root of settled / words. Documents
of few words fail the plain rules first: fewer than 50 words, or more than half of the words in repeated 3-word windows.

Quartiles are taken from exact counts of the measures in steps of 1/STEPS, so they don't depend on how rows are dealt.

Defined results: null text: no words, which fails. A text without a letter is of script `none`. A null language is a
language of its own. A document without tokens has measures 0. Repeated rows count and are returned once each. An empty
table gives no rows. doc_id must be castable to long; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tracewright.llm import words as W
from tracewright.llm.shared import by_text, staged, strings

#: Measures and the least margin of their bands; those of the byte-level vocabulary begin with `bytes_`.
MEASURES = {"chars_per_token": 0.1, "fallback_share": 0.02, "token_entropy": 0.05, "bytes_chars_per_token": 0.1, "bytes_fallback_share": 0.02, "bytes_token_entropy": 0.05}
#: Steps of a measure's unit in which it is counted for quartiles.
STEPS = 512
#: Bands up to which they are broadcast; beyond, the join shuffles.
BROADCAST_BANDS = 10_000
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏḀ-ỿ",
    "cyrillic": "Ѐ-ԯ",
    "greek": "Ͱ-Ͽἀ-῿",
    "arabic": "؀-ۿݐ-ݿ",
    "hebrew": "֐-׿",
    "devanagari": "ऀ-ॿ",
    "han": "㐀-䶿一-鿿",
    "kana": "぀-ヿ",
    "hangul": "가-힣ᄀ-ᇿ",
}
_SCRIPTS = {name: re.compile(f"[{ranges}]") for name, ranges in SCRIPTS.items()}
_NOT_LATIN = re.compile(r"[^\x00-ɏ -⁯]")
_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_NEWLINE = np.arange(256) == 10


def script(text: str) -> str:
    """The script of most of a text's letters."""
    if not _NOT_LATIN.search(text):
        return "latin" if _SCRIPTS["latin"].search(text) else "none"
    counts = {name: sum(1 for _ in pattern.finditer(text)) for name, pattern in _SCRIPTS.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] else "none"


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: made.encode(text, num_threads=1), np.array([made.is_byte(i) for i in range(made.get_piece_size())])


def _cut(token: bytes) -> bool:
    """Whether a token holds a part of a character."""
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


@lru_cache(maxsize=2)
def _bytes(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    made = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    cut = np.zeros(max(ranks.values()) + 1, bool)
    cut[[rank for token, rank in ranks.items() if _cut(token)]] = True
    return made.encode_ordinary, cut


def fertility(text: str, encode, is_part: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, share of parts, entropy of the tokens."""
    ids = np.array(encode(text), dtype=np.int64)
    if not len(ids):
        return 0.0, 0.0, 0.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    most = np.log2(max(2, min(len(ids), len(is_part))))
    return len(text) / len(ids), float(is_part[ids].mean()), float(-(share * np.log2(share)).sum() / most)


def counted(column: pa.Array) -> dict[str, np.ndarray]:
    """The plain counts of each text of a column without nulls."""
    found = W.words(column, W.SPACES, lower=False)
    n, docs = found.n_docs, found.doc
    text_of = np.repeat(np.arange(n), np.diff(found.offsets))
    chars = ((found.data & 0xC0) != 0x80) & ~W.SPACES[found.data]
    out = {"n_words": found.counts(), "word_chars": np.bincount(text_of[chars], minlength=n), "n_symbols": np.bincount(text_of[_SYMBOLS[found.data]], minlength=n)}
    starts, ends = W.spans(_NEWLINE[found.data], found.offsets)
    filled = np.concatenate([[0], np.cumsum(~W.SPACES[found.data])])
    wordy = filled[ends] > filled[starts]
    starts, ends = starts[wordy], ends[wordy]
    line_docs, line_hashes = np.searchsorted(found.offsets, starts, side="right") - 1, found.hashes(starts, ends)
    distinct = W.sets(line_docs, line_hashes.copy(), n)[0]
    out["n_dup_lines"] = np.bincount(line_docs, minlength=n) - np.bincount(distinct, minlength=n)
    h = found.hashes()
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        whole = np.flatnonzero(docs[:-2] == docs[2:])
        window = W.mix(W.mix(W.mix(h[:-2]) + h[1:-1] * W.U(3)) + h[2:] * W.U(5))[whole]
        keys = W.mix(window + docs[whole].astype(np.uint64) * W.U(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        for k in range(3):
            covered[whole[again] + k] = True
    out["n_repeat_words"] = np.bincount(docs[covered], minlength=n)
    return out


def _measure(pieces: str, ranks: str, pattern: str):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = strings(batch.column("text"))
        texts, out = column.to_pylist(), counted(column)
        vocabularies = _pieces(pieces), _bytes(ranks, pattern)
        measures = np.array([[x for v in vocabularies for x in fertility(text, *v)] for text in texts]).reshape(len(texts), len(MEASURES))
        columns = {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), **{k: pa.array(v.astype(np.int64)) for k, v in out.items()}, "script": pa.array([script(t) for t in texts], pa.string())}
        return pa.record_batch(columns | {m: pa.array(measures[:, k].copy(), pa.float64()) for k, m in enumerate(MEASURES)})

    return lambda batches: by_text(batches, "text", work)


SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, " + ", ".join(f"{m} double" for m in MEASURES)


def _quartiles(steps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, measure, <name>: n, low, high) from (keys, measure, step, n): the least values with a quarter, and with three
    quarters, of the documents up to them."""
    steps = steps.groupBy(*keys, "measure", "step").agg(F.sum("n").alias("n"))
    order = Over.partitionBy(*keys, "measure").orderBy("step")
    steps = steps.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Over.partitionBy(*keys, "measure")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("step"))) / STEPS
    return steps.groupBy(*keys, "measure").agg(F.struct(F.max("all").alias("n"), at(0.25).alias("low"), at(0.75).alias("high")).alias(name))


def bands(good: DataFrame, least: int) -> DataFrame:
    """(script, lang, band): of each measure low and high, blended, from the measured documents that pass the plain rules."""
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * STEPS).alias("step")) for m in MEASURES))
    steps = staged(good.select("script", "lang", F.inline(each)).groupBy("script", "lang", "measure", "step").agg(F.count("*").alias("n")))
    scripts = _quartiles(steps, ["script"], "of_script").join(_quartiles(steps, [], "of_all"), "measure")
    own = _quartiles(steps, ["script", "lang"], "own").join(scripts, ["script", "measure"])

    def blended(end: str) -> Column:
        wide = (F.col(f"of_script.{end}") * F.col("of_script.n") + F.col(f"of_all.{end}") * least) / (F.col("of_script.n") + least)
        return ((F.col(f"own.{end}") * F.col("own.n") + wide * least) / (F.col("own.n") + least)).alias(end)

    values = (F.max(F.when(F.col("measure") == m, F.struct(blended("low"), blended("high")))).alias(m) for m in MEASURES)
    return own.groupBy("script", "lang").agg(*values).select("script", "lang", F.struct(*MEASURES).alias("band"))


def judged(docs: DataFrame, pieces: str, ranks: str, pattern: str, width: float = 3.0, settled: int = 400, least: int = 100) -> DataFrame:
    """Counts, measures, base_failed, outside (names of measures outside their band) and kept of docs (doc_id, text; lang if
    there is one). pieces: a sentencepiece model; ranks, pattern: of the tiktoken library."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    measured = staged(docs.mapInArrow(_measure(pieces, ranks, pattern), SCHEMA))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = staged(bands(measured.where(~failed), least)).select(F.col("script").alias("of_script"), F.col("lang").alias("of_lang"), "band")
    found = F.broadcast(found) if found.count() <= BROADCAST_BANDS else found
    rows = measured.join(found, (F.col("script") == F.col("of_script")) & F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    wider = F.greatest(F.lit(1.0), F.sqrt(settled / F.greatest(F.col("n_words"), F.lit(1))))
    outside = []
    for m, margin in MEASURES.items():
        low, high = F.col(f"band.{m}.low"), F.col(f"band.{m}.high")
        reach = F.greatest(F.lit(margin), width * (high - low) * wider)
        outside.append(F.when((F.col(m) < low - reach) | (F.col(m) > high + reach), F.lit(m)))
    rows = rows.withColumn("base_failed", failed).withColumn("outside", F.array_compact(F.array(*outside)))
    return rows.drop("band", "of_script", "of_lang").withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
