"""Queries opN_<name>: thin uses of the operators on the driver's tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, fingerprint, language, licenses, line_dedup, oracles, packing, personal, quality, toxicity
from tracewright.llm.near_duplicates import near_duplicates
from tracewright.llm.shared import let, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "piece_end")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs, and how many characters went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars_before"))
    rows = line_dedup.without_repeats(docs)
    return rows.select("doc_id", "chars_before", (F.col("chars_before") - F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars_removed"), "text")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = language.identify(docs, language.train(docs.where(~held_out)))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    words, base = F.col("places.word"), F.col("places.label")

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    best = F.array_max(F.col("blocks.containment"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("blocks.template"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out)))
    return rows.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    rows = fingerprint.with_next(docs, "doc_id", F.xxhash64("text"), ["text", "own"], {"n_chars": F.length("text"), "own": fingerprint.tree(F.col("text"))})
    swapped = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - swapped), F.substring(F.col("next.text"), F.lit(1), swapped))
    rows = rows.select("doc_id", "n_chars", "own", F.col("next.own").alias("following"), let(edited, lambda t: F.struct(F.sha2(t, 256).alias("sha"), fingerprint.tree(t).alias("tree"))).alias("edited"))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("edited.sha").alias("edited_sha256"),
        fingerprint.printed(F.col("own")).alias("fingerprint"),
        fingerprint.printed(F.col("edited.tree")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("own"), F.col("edited.tree")).alias("near_edited"),
        fingerprint.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    rows = quality.judged(table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *quality.MEASURES)


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal.found(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in personal.KINDS[:4]]
    return rows.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "id")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def queries():
    return {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_language, op4_bpe, op5_licenses, op6_toxicity, op7_fingerprint, op8_quality, op9_personal, op10_near_duplicates)}


def oracle_sql():
    return {"op5_licenses": oracles.licenses(), "op10_near_duplicates": oracles.near_duplicates()}
