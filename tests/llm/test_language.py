import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import catalog, language

SMALL = "/root/testdata/sf0.01"


def test_language_learns_words_and_backs_off(spark, docs, none):
    words = {"x": "alpha beta gamma delta", "y": "omikron sigma lambda kappa"}
    rows = [(i, " ".join(words["xy"[i % 2]].split()[k % 4] for k in range(i, i + 6)), "xy"[i % 2]) for i in range(40)] + [(99, "noise", None)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "beta alpha"), (2, "SIGMA"), (3, "alphabet"), (4, "omikronik kappa"), (5, None), (6, "12 ..."), (7, ""), (8, "漢字")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["x", "y", "x", "y", "und", "und", "und"]
    assert got[8] == ("x", 0.5) and got[5][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert language.identify(docs, model).count() == docs.count()
    assert language.identify(none, model).collect() == []
    empty = language.train(none)
    assert {(r.lang_pred, r.score) for r in language.identify(docs, empty).collect()} == {("und", 0.0)}


def by_loop(model, known, text):
    """Word by word: known words, else the longest n-grams that are known."""
    if not text or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    total, heard = np.zeros(len(model.languages)), 0
    for word in re.split(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", language.plain(text)):
        if not word:
            continue
        logs = known.get("w" + word)
        if logs is None:
            marked = f"^{word}$"
            for n in (5, 4, 3, 2, 1):
                found = [known["g" + marked[i : i + n]] for i in range(len(marked) - n + 1) if "g" + marked[i : i + n] in known]
                if found:
                    logs = language.BACKOFF * sum(found) / len(found)
                    break
        if logs is not None:
            total, heard = total + logs, heard + 1
    if not heard:
        return model.languages[model.prior], 1 / len(model.languages)
    scaled = total / math.sqrt(heard)
    share = np.exp(scaled - scaled.max())
    return model.languages[int(share.argmax())], float(share.max() / share.sum())


def test_predictions_equal_a_loop_over_words(spark, docs, corpus):
    rng = random.Random(4)
    texts = {"aa": "der die das und nicht wasser straße", "bb": "the of and water not street naïve", "cc": "вода улица и не это", "zh": "水街道不是这个"}
    rows = [(i, " ".join(rng.choice(t.split()) if " " in t else "".join(rng.choice(t) for _ in range(70)) for _ in range(9)), lang) for i, (lang, t) in enumerate(list(texts.items()) * 30)]
    rows += [(5, "ein anderer text", "aa")]
    held = {}

    class Kept(language.Model):
        def __init__(self, languages, rows, prior):
            super().__init__(languages, rows, prior)
            counts = {}
            for lang, item, n in rows:
                counts.setdefault(item, np.zeros(len(languages)))[languages.index(lang)] += n
            for kind in "wg":
                own = {k: v for k, v in counts.items() if k[0] == kind}
                total = sum(own.values())
                held.update({k: np.log(v / np.maximum(total, 1) + 0.5 / total.max()).astype(np.float32).astype(float) for k, v in own.items()})

    before, language.Model = language.Model, Kept
    try:
        model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    finally:
        language.Model = before
    asked = [(i, t) for i, (_, t, *_) in enumerate(corpus)] + [(100, "水道水街"), (101, "nichtig wasserstraße"), (102, "waters“and”streets"), (103, "水" * 5000), (104, "вод")]
    plain = before.__new__(before)
    plain.__dict__.update(model.__dict__)
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string").repartition(3), plain).collect()}
    for doc, text in asked:
        lang, score = by_loop(model, held, text)
        assert got[doc].lang_pred == lang and got[doc].score == pytest.approx(score, abs=1e-4), text[:40]
    assert got[100].lang_pred == got[103].lang_pred == "zh" and got[102].lang_pred == "bb"


def test_the_sample_is_bounded_and_holds_the_lowest_hashes(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    rows = rows.unionByName(spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("c").alias("lang"))).unionByName(spark.range(40).select(F.col("id").alias("doc_id"), F.lit("c").alias("lang")))
    chosen = language.sample(rows, 300, {"a": 1, "b": 1, "c": 1})
    want = rows.distinct().withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))).orderBy("lang", "h", "doc_id").collect()
    for lang, n in (("a", 300), ("b", 300), ("c", 40)):
        assert sorted(r.doc_id for r in chosen.collect() if r.lang == lang) == sorted([r.doc_id for r in want if r.lang == lang][:n])


def test_held_out_documents_get_their_language(spark):
    rows = catalog.op3_language(spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    both = rows.join(truth, "doc_id").where("held_out and lang is not null and length(text) >= 40")
    n, right = both.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right >= 0.99 * n
    assert rows.where("held_out <> (crc32(cast(doc_id as string)) % 3 = 1)").count() == 0
