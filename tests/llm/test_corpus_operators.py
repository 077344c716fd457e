import os
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tracewright.llm import near_duplicates, shared, words

# words


def test_words_and_shingles_equal_a_loop():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB é\n\t漢x") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", " ", "a"]
    found = words.words(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in t.encode().lower().split()]
    got = [(int(d), found.data[a:b].tobytes()) for d, a, b in zip(found.doc, found.starts, found.ends)]
    assert got == want
    by_word = defaultdict(set)
    for (_, w), h in zip(want, found.hashes().tolist()):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({h for v in by_word.values() for h in v}) == len(by_word)
    docs, hashes = words.sets(*words.shingles(found, 3), found.n_docs)
    sizes = [len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if w else 0 for w in (t.encode().lower().split() for t in texts)]
    assert np.bincount(docs, minlength=len(texts)).tolist() == sizes


# near duplicates


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size, least=80, of=100):
    sets = [(doc, shingle_set(text, size)) for doc, text in rows]
    up = {doc: doc for doc, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            common = len(s & t)
            if common and of * common >= least * (len(s) + len(t) - common):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {doc: (len(s), find(doc)) for doc, s in sets}


def checked(spark, rows, size):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(frame, size).collect()}
    assert got == brute_components(rows, size)


def test_near_duplicates_equal_brute_force(spark, docs, corpus, none):
    for size in (4, 5):
        rows = near_duplicates.near_duplicates(docs, size).collect()
        want = brute_components([(r[0], r[1]) for r in corpus], size)
        assert len(rows) == len(corpus)
        assert all((r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id) for r in rows)
    assert near_duplicates.near_duplicates(none).collect() == []


def test_one_group_of_near_copies_and_chains_of_links(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 15)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows, chain = [], list(base)
    for i in range(120):
        if i % 2:
            chain[(7 * i) % 90] = f"c{i}"
            rows.append((i, " ".join(chain)))
        else:
            other = list(base)
            for k in rng.sample(range(90), rng.randint(0, 6)):
                other[k] = f"n{rng.random()}"
            rows.append((i, " ".join(other)))
    rows += [(500 + i, " ".join(base)) for i in range(40)] + [(900, None), (901, ""), (902, "w1 w2")]
    rng.shuffle(rows)
    checked(spark, rows, 4)


def test_superminhash_estimates_similarity_with_less_variance_than_minhash():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(300):
        pool = rng.integers(1, 1 << 62, 120).astype(np.uint64)
        a, b = np.sort(pool[:100]), np.sort(pool[20:])
        docs = np.repeat([0, 1], 100)
        s = near_duplicates.superminhash(docs, np.concatenate([a, b]), 2)
        errors.append((s[0] == s[1]).mean() - 80 / 120)
    plain = np.sqrt(2 / 3 * 1 / 3 / near_duplicates.SLOTS)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.95 * plain


def one_by_one(hashes, slots):
    """SuperMinHash of a set, element by element, without early stop."""
    values = [None] * slots
    for h in hashes:
        order = list(range(slots))
        for j in range(slots):
            z = int(words.mix(np.array([h + np.uint64((j + 1) * int(near_duplicates._STEP) & (1 << 64) - 1)]))[0])
            k = j + ((z >> 32) * (slots - j) >> 32)
            order[j], order[k] = order[k], order[j]
            value = z & 0xFFFFFFFF | j << 32
            if values[order[j]] is None or value < values[order[j]]:
                values[order[j]] = value
    return values


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_superminhash_with_early_stop_equals_the_full_walk(size):
    hashes = np.sort(np.random.default_rng(size).integers(1, 1 << 62, size).astype(np.uint64))
    got = near_duplicates.superminhash(np.zeros(size, np.int64), hashes, 1, 32)[0].tolist()
    assert got == one_by_one(hashes, 32)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 105), (103, 105)], "a long, b long").repartition(5)
    got = {r.id: r.comp for r in near_duplicates.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 103: 100, 105: 100}


# the pipeline and the registry


def test_every_operator_is_registered():
    names = entry.queries()
    assert {re.match(r"op\d+", x).group() for x in names if x.startswith("op")} == {f"op{n}" for n in range(1, 11)}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_stages_bear_odd_rows_and_keep_columns(spark, docs, corpus, tmp_path):
    spark.createDataFrame([(1, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = stage(spark, rows, str(tmp_path))
        if name != "packing":
            assert rows.columns == docs.columns, name
            assert set(r.doc_id for r in rows.select("doc_id").collect()) <= set(r[0] for r in corpus)
            rows = corpus_pipeline.settled(lambda rows=rows: rows)
        else:
            assert rows.agg(F.countDistinct("doc_id")).first()[0] == before.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows.count()


def test_pipeline_of_no_rows(spark, none, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert P.PATTERN


def test_staging_needs_a_shared_folder_off_this_machine():
    class Elsewhere:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Elsewhere

        @staticmethod
        def getCheckpointDir():
            return Elsewhere

        @staticmethod
        def isDefined():
            return False

    class Session:
        sparkContext = Elsewhere

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared.shared_folder(Session)


def test_settled_tables_stay_and_those_on_the_way_go(spark):
    inner = []

    def make():
        inner.append(shared.staged(spark.range(5)))
        return inner[0].where("id > 1")

    out = shared.settled(make)
    assert out.count() == 3
    place = inner[0].inputFiles()
    assert place and not any(os.path.exists(p.removeprefix("file://")) for p in place)
