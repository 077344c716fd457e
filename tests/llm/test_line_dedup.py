import random
import re
from collections import defaultdict

import pytest
import xxhash

import corpus_pipeline
from tracewright.llm import line_dedup

LEAST = line_dedup.LEAST_WORDS
SIGN = "[⺀-〿぀-鿿가-힯豈-﫿]"
TOKEN = re.compile(rf"{SIGN}|(?:(?!{SIGN})[^ \t\n\x0b\f\r])+")


def tokens(text):
    return TOKEN.findall(text or "")


def parts(text):
    """Words with the white space before them, and the last one's after it."""
    at = [m.start() for m in TOKEN.finditer(text)]
    ends = [m.end() for m in TOKEN.finditer(text)]
    cuts = [0, *ends[:-1], len(text)] if at else [0, len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def hashed(word):
    return xxhash.xxh64_intdigest(word.encode(), 42)


def fingerprints(text):
    """Places of a text's fingerprints, word by word."""
    words, hashes = tokens(text), []
    hashes = [hashed(w) for w in words]
    grams = range(len(words) - LEAST + 1)
    anchors = [i for i, h in enumerate(hashes) if h >> 9 & 31 < line_dedup.ANCHORS]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    found = set(anchors[:1] + anchors[-1:])
    for a, b in zip(anchors, anchors[1:]):
        found |= {x for x in (a, b) if signed[x] == min(signed[a], signed[b])}
    start = 0
    for line in text.split("\n"):
        n = len(tokens(line))
        if n >= LEAST:
            found.add(start)
        start += n
    marked = set(anchors)
    for i in range(LEAST, len(words)):
        near = [k for k in range(i - LEAST, i + 1) if k in marked]
        if len(near) < 2:
            found.add(near[0] if near else i)
    return {i: tuple(words[i : i + LEAST]) for i in found if i in grams}


def model(rows):
    """Texts after deletion, with loops: rows are (doc, text), one for each doc."""
    rows = sorted((d, t) for d, t in rows if d is not None and t is not None)
    words = {d: tokens(t) for d, t in rows}
    seen, out, first, matches = {}, {}, {}, defaultdict(dict)
    for d, t in rows:
        if t.strip() and seen.setdefault(t, d) != d:
            out[d] = ""
    for d, t in rows:
        if d not in out:
            for i, gram in sorted(fingerprints(t).items()):
                place = first.setdefault(gram, (d, i))
                if place != (d, i):
                    matches[d][i] = place
    gone = defaultdict(set)
    for d, places in matches.items():
        runs = []
        for i in sorted(places):
            if runs and i <= runs[-1][-1] + LEAST:
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            low, high = run[0], run[-1] + LEAST - 1
            for step, edge, i in ((-1, low, run[0]), (1, high, run[-1])):
                d0, shift, at = places[i][0], i - places[i][1], edge
                for _ in range(LEAST):
                    at += step
                    if not (0 <= at < len(words[d]) and 0 <= at - shift < len(words[d0]) and words[d][at] == words[d0][at - shift]):
                        at -= step
                        break
                low, high = min(low, at), max(high, at)
            gone[d] |= set(range(low, high + 1))
    for d, t in rows:
        out.setdefault(d, "".join(x for i, x in enumerate(parts(t)) if i not in gone[d]))
    return out, gone


def standing_earlier(rows, least):
    """Words of runs of least words that stand earlier, by all windows."""
    seen, out = {}, defaultdict(set)
    for d, t in sorted((d, t) for d, t in rows if d is not None and t is not None):
        w = tokens(t)
        for i in range(len(w) - least + 1):
            if seen.setdefault(tuple(w[i : i + least]), (d, i)) != (d, i):
                out[d].update(range(i, i + least))
    return out


def checked(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(frame).collect() if r.doc_id is not None}
    want, gone = model(rows)
    assert {d: t for d, t in got.items() if t is not None} == want
    some, sure = standing_earlier(rows, LEAST), standing_earlier(rows, 2 * LEAST + 1)
    for d, t in rows:
        if want.get(d):
            assert gone[d] <= some[d]
            left = sure[d] - gone[d]
            run = [i for i in left if all(i + k in left for k in range(LEAST + 1))]
            assert not run, "a stretch of a long repeated run was left"
    return got


def made(rng, n, ends=("",)):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}{rng.choice(ends)}" for _ in range(n)]


def test_only_runs_that_stand_earlier_in_one_piece_go(spark):
    rng = random.Random(1)
    a, b, line, text, nine = made(rng, 24), made(rng, 24), made(rng, 40), made(rng, 30), made(rng, 9)
    rows = [(40, " ".join(made(rng, 20) + a)), (41, " ".join(b + made(rng, 5))), (42, " ".join(made(rng, 6) + a + b + made(rng, 6)))]
    rows += [(50 + i, " ".join(made(rng, 12)) + "\n" + " ".join(line) + "\n" + " ".join(made(rng, 8))) for i in range(3)]
    rows += [(60, " ".join(text)), (61, " ".join(text)), (62, " ".join(nine)), (63, " ".join(nine)), (64, " ".join(nine) + " more")]
    got = checked(spark, rows)
    assert got[42] == rows[2][1]
    assert all(len(tokens(got[d])) == 20 and line[7] not in got[d] for d in (51, 52)) and line[7] in got[50]
    assert (got[60], got[61], got[62], got[63], got[64]) == (rows[6][1], "", rows[8][1], "", rows[10][1])


def test_passages_of_51_words_go_wherever_they_stand(spark):
    rng = random.Random(12)
    plain, two = made(rng, 51), [*made(rng, 30), "end.", *made(rng, 28), "end.", *made(rng, 29)]
    rows = [(1, " ".join(plain)), (2, " ".join(two)), (3, " ".join([*made(rng, 9), *plain, *made(rng, 9)])), (4, " ".join([*made(rng, 7), *two, *made(rng, 7)])), (5, "\n".join(plain)), (6, " ".join(plain[:24]))]
    rows += [(7, " \n" + "\t".join(made(rng, 3) + plain + two) + "  "), (8, "same " * 80), (9, None), (10, ""), (11, " \n"), (12, "same " * 200), (13, "xy " + "same same " * 60)]
    got = checked(spark, rows)
    assert [len(tokens(got[d])) for d in (3, 4, 5, 7)] == [18, 14, 0, 3] and got[10] == "" and got[11] == " \n"


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_equal_a_loop(spark, seed, monkeypatch):
    if seed == 3:  # ids too far apart to be packed
        held = line_dedup._places
        monkeypatch.setattr(line_dedup, "_places", lambda texts: held(texts.unionByName(texts.sparkSession.createDataFrame([(-(2**63), None, 1, False), (2**63 - 1, None, 1, False)], texts.schema))))
    rng = random.Random(seed)
    pool = [made(rng, rng.randint(5, 90), ("", "", ".", ",")) for _ in range(8)]
    rows = [(i, "".join(w + rng.choice([" "] * 9 + ["\n", "  ", "\n\n"]) for _ in range(rng.randint(0, 5)) for w in (rng.choice(pool) if rng.random() < 0.6 else made(rng, 20)))) for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice(["x", "y."]) for _ in range(rng.randint(0, 90)))) for i in range(20)]
    checked(spark, rows)


def test_scripts_without_spaces_are_compared_sign_by_sign(spark):
    rng = random.Random(6)
    sign = lambda n: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))
    held = sign(60)
    got = checked(spark, [(1, f"ab {held}。"), (2, f"{sign(10)} {held[:30]} {held[30:]}cd ef"), (3, held[:20])])
    assert len(got[2]) == 10 + 5 and held[40] not in got[2] and got[3] == held[:20]


def test_rows_of_the_corpus_and_defined_results(spark, docs, corpus, none):
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("n_chars <> length(text)").count() == 0
    want, _ = model({(r[0], r[1]) for r in corpus})
    assert {r.doc_id: r.text for r in out.collect() if r.text is not None} == want
    left = line_dedup.without_repeats(docs, drop_emptied=True).select("doc_id", "text").collect()
    assert {r.doc_id for r in left} == {r[0] for r in corpus if not ((r[1] or "").strip() and want[r[0]] == "")}
    assert line_dedup.without_repeats(none).collect() == []
    assert not re.search("Python|Pandas|ArrowEval", out._jdf.queryExecution().toString())


def test_repeated_and_null_ids(spark):
    text = " ".join(made(random.Random(4), 70))
    rows = [(1, text), (1, text), (2, "x " + text), (3, text), (3, "other"), (None, text), (None, text), (4, text), (4, text), (-5, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __of", "2 as runs", "3 as sha", "4 as at", "5 as word")
    got = sorted(((r.doc_id or 0, r.text) for r in line_dedup.without_repeats(frame).select("doc_id", "text").collect()), key=str)
    want = [(1, text), (1, text), (2, "x"), (3, text), (3, "other"), (0, text), (0, text), (4, ""), (4, ""), (-5, "y")]
    assert got == sorted(want, key=str)


def test_the_pipeline_drops_what_is_emptied(spark):
    rng = random.Random(3)
    text = " ".join(made(rng, 70))
    rows = [(1, text), (2, text), (3, "\n".join(text.split())), (4, ""), (5, None), (6, "own words " + text)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {1: text, 4: "", 5: None, 6: "own words"}


def test_fingerprints_equal_a_loop_and_are_hashed_in_compiled_code(spark):
    rng = random.Random(8)
    texts = ["", " ", "\n", "same " * 80, " \n".join(made(rng, 70)), "\n" + " ".join(made(rng, 25)) + "  \n\n " + "  ".join(made(rng, 30)), "\t".join(made(rng, 60)), "漢字 " * 20 + " ".join(made(rng, 30)), "\U0001f600 é " * 30]
    texts += ["".join(w + rng.choice("    \n") for w in made(rng, n)) for n in (1, 24, 25, 26, 51, 52, 900)]
    chosen = line_dedup.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = chosen.collect()
    assert {(r.doc_id, r.pos) for r in got} == {(i, pos) for i, t in enumerate(texts) for pos in fingerprints(t)}
    grams = {(r.h, r.c): fingerprints(texts[r.doc_id])[r.pos] for r in got}
    assert all(fingerprints(texts[r.doc_id])[r.pos] == grams[r.h, r.c] for r in got) and len(set(grams.values())) == len(grams)
    plan = chosen._jdf.queryExecution().executedPlan().toString().split("\n")
    hashing = [x for x in plan if "xxhash64(slice(" in x]
    assert hashing and all(re.match(r"\W*\*\(\d+\) Project", x) for x in hashing)
    assert not any("Filter" in x and "split(" in x for x in plan), "texts are cut twice"
