import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.llm import catalog, fingerprint

STARTS = set("aAdDlLmMsS0123456789")


def phrases(line):
    """Cut one character at a time."""
    out, start = [], 0
    for i in range(1, len(line)):
        if (line[i - 1] in " \t\n\x0b\f\r" and line[i] in STARTS) or line[i - 1] in "。！？、，" or i - start == 64:
            out.append(line[start:i])
            start = i
    return [*out, line[start:]] if line else []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines(text):
    return re.split(r"(?<=\n)", text)


def dice(a, b):
    if a == b:
        return 1.0
    x, y = (Counter(p for line in lines(t) for p in phrases(line)) for t in (a, b))
    shared = sum(len(p) * n for p, n in (x & y).items())
    return min(2 * shared / (len(a) + len(b)), 1 - 1 / (len(a) + len(b) + 1))


def near(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").repartition(4)
    both = rows.select("i", fingerprint.tree(F.col("a")).alias("a"), fingerprint.tree(F.col("b")).alias("b"))
    found = both.select("i", fingerprint.likeness(F.col("a"), F.col("b")).alias("s"), fingerprint.likeness(F.col("b"), F.col("a")).alias("back"), (F.col("a.root") == F.col("b.root")).alias("same")).collect()
    return {r.i: (r.s, r.back, r.same) for r in found}


def checked(spark, pairs):
    got = near(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        a, b = a or "", b or ""
        assert got[i][0] == pytest.approx(dice(a, b)) and got[i][1] == pytest.approx(got[i][0])
        assert got[i][2] == (a == b) and (got[i][0] == 1) == (a == b)
    return [got[i][0] for i in range(len(pairs))]


def test_likeness_equals_the_bags_of_phrases(spark, corpus):
    texts = [r[1] for r in corpus]
    checked(spark, [(a, b) for a in texts for b in texts[::3]])


def test_edits_cost_what_they_touch_at_every_length(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9)))
    base = " ".join(word() for _ in range(400))
    pairs = [(base[:n], base[: n - 1]) for n in range(395, 407)]
    pairs += [(base[:n], base[:k] + "x" + base[k:n]) for n in (399, 400, 401, 1200) for k in (1, n // 2, n - 1)]
    assert all(0.75 < s < 1 for s in checked(spark, pairs))
    turned = [("a b c " * 200, "b c a " * 200), ("a b c " * 200, "x" + "a b c " * 100 + "y" + "a b c " * 100), (base, base[1000:] + base[:1000])]
    assert all(0.9 < s < 1 for s in checked(spark, turned))
    assert all(s < 0.2 for s in checked(spark, [(base[:800], base[900:1700]), ("", base), ("x" * 300, "y" * 300)]))
    assert 0.65 < checked(spark, [(base, base[: len(base) * 3 // 4] + "".join(rng.choice("uvwxyz ") for _ in range(len(base) // 4)))])[0] < 0.85


def merkle(text):
    blank, digests = sha("\n")[:32], []
    sections, now = [], ""
    for line in lines(text):
        digests.append(sha(line)[:32])
        now += "?=" + digests[-1] + ","
        if digests[-1][0] in "01" or digests[-1] == blank:
            sections.append(now)
            now = ""
    return [*sections, now] if now else sections


def test_the_fingerprint_holds_the_tree(spark, docs, corpus):
    rows = docs.select("doc_id", fingerprint.tree(F.col("text")).alias("t")).select("doc_id", "t.root", fingerprint.printed(F.col("t")).alias("f")).distinct().collect()
    text = {r[0]: r[1] or "" for r in corpus}
    assert len({r.root for r in rows}) == len(set(text.values()))
    for r in rows:
        root, _, rest = r.f.partition(":")
        found = re.findall(r"([0-9a-f]{16})\[([^\]]*)\]", rest)
        assert root == r.root and "".join(f"{d}[{e}]" for d, e in found) == rest
        assert [re.sub(r"[0-9a-f.]*=", "?=", e) for _, e in found] == merkle(text[r.doc_id])
        assert [sha(e)[:16] for _, e in found] == [d for d, _ in found]
        assert root == sha(",".join(sha(e) for _, e in found))


def test_edits_are_located_from_fingerprints(spark):
    paragraphs = [f"paragraph {i} says something\n" for i in range(40)]
    changed, swapped = list(paragraphs), list(paragraphs)
    changed[17] = "changed\n"
    swapped[3], swapped[30] = swapped[30], swapped[3]
    after = {1: changed, 2: paragraphs, 3: swapped, 4: [*paragraphs, paragraphs[5]], 5: paragraphs[:10] + ["new\n"] + paragraphs[10:], 6: paragraphs[:20] + paragraphs[21:]}
    rows = [(k, "".join(paragraphs), "".join(v)) for k, v in after.items()] + [(None, "a", "b"), (7, "a", "b"), (7, "a", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, a string, b string")
    prints = [frame.select("doc_id", fingerprint.printed(fingerprint.tree(F.col(x))).alias("fingerprint")) for x in "ab"]
    place = {x: {} for x in "ab"}
    for k in after:
        for x, text in (("a", paragraphs), ("b", after[k])):
            section = paragraph = 0
            for i, line in enumerate([*text, ""]):
                place[x][k, i] = (section, paragraph)
                paragraph += 1
                if sha(line)[0] in "01":
                    section, paragraph = section + 1, 0
    got = {(r.doc_id, r.change, r.section, r.paragraph) for r in fingerprint.edits(*prints).collect()}
    want = {(1, "removed", *place["a"][1, 17]), (1, "added", *place["b"][1, 17]), (3, "moved", *place["b"][3, 3]), (3, "moved", *place["b"][3, 30])}
    want |= {(4, "added", *place["b"][4, 40]), (5, "added", *place["b"][5, 10]), (6, "removed", *place["a"][6, 20])}
    assert got == want
    assert fingerprint.edits(*(p.limit(0) for p in prints)).collect() == []


@pytest.mark.parametrize("bucket", [1, 3, 1024])
def test_next_rows_equal_a_loop(spark, monkeypatch, bucket):
    monkeypatch.setattr(fingerprint, "BUCKET", bucket)
    monkeypatch.setattr(fingerprint, "TASK_ROWS", 5)
    rng = random.Random(bucket)
    ids = [-(2**63), 2**63 - 1, 0, 5, 5, 5, 5, 5, 5, 7, None, None, None] + [rng.randint(-(2**40), 2**40) for _ in range(40)]
    rows = [(d, f"t{i}") for i, d in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text")).repartition(4)
    order = sorted(((r.doc_id, r.h, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {r.text: r.next.text for r in fingerprint.with_next(frame, "doc_id", F.col("h"), ["text"]).collect()}
    assert got == {r[2]: order[(i + 1) % len(order)][2] for i, r in enumerate(order)}
    assert fingerprint.with_next(frame.limit(0), "doc_id", F.lit(0), ["text"]).collect() == []


def test_the_query_equals_a_loop(spark, docs, corpus, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: r[0])
    frame = catalog.op7_fingerprint(spark, str(tmp_path))
    assert not re.search("Python|Pandas|ArrowEval", frame._jdf.queryExecution().toString())
    got = {r.doc_id: r for r in frame.collect()}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        if i + 1 < len(rows) and rows[i + 1][0] == doc:
            continue
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        assert (r.near_edited, r.near_next) == (pytest.approx(dice(text, edited)), pytest.approx(dice(text, after)))
