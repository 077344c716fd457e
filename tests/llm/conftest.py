import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars) with what operators must bear: nulls, empty and odd texts, copies,
    near copies, shared passages, personal data, licenses, one long text, a repeated row."""
    rng = random.Random(5)
    syllables = ["ba", "do", "ki", "lu", "men", "ter", "son", "gra", "pel", "ist"]

    def words(n):
        return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)]

    texts = [None, "", " \n\t", "x", "É", "1234", "..."]
    base = words(120)
    texts += [" ".join(base)] * 3
    for k in (2, 4, 30):
        other = list(base)
        for i in rng.sample(range(120), k):
            other[i] = "zz"
        texts.append(" ".join(other))
    passage = "\n".join(" ".join(words(9)) + "." for _ in range(8))
    for _ in range(4):
        texts.append(" ".join(words(60)) + "\n" + passage + "\n" + " ".join(words(40)))
    texts += [
        "Mail a.b@c.org or +1 (017) 555-7713, card 4532015112830366, host 10.0.300.1 and 10.0.3.1",
        "Licensed under the Apache License, Version 2.0. Released under the MIT License. CC BY-NC 4.0, cc by cc by",
        "same same same " * 40,
        "line one\nline one\nline one\n\n \nline two",
        "#*$%&|<> ß İ ﬁ 漢字かな 한글 привет " * 8,
        " ".join(words(4000)),
    ]
    rows = [(i, t, "ab", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[8]]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    frame = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("word", "id", "comp", "bucket", "key", "spans", "ids", "start", "score"):
        frame = frame.selectExpr("*", f"'other' as {extra}")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
