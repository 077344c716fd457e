"""Operator 7: document fingerprints by a Merkle tree over paragraphs and sections. DataFrame functions only.

Paragraphs (lines) are hashed by SHA-256; a section is a run of paragraphs that ends after a blank one or where a
paragraph's hash begins with 0 or 1, so that an edit moves no later section's ends; sections' and the root's hashes are
SHA-256 of their children's entries. Equal roots mean equal texts. A paragraph's own branches are its phrases: it is cut
before words that begin with some letters, after ideographic punctuation, and at 64 characters since the last cut, so what
is inserted moves no later cut. A phrase has a short hash and a length.

A fingerprint carries the whole tree, so two of them tell which sections, paragraphs and phrases differ (`edits`), and how
alike the texts are: 1 for equal roots, else Dice's coefficient of the two bags of phrases, weighted by length, and always
below 1. An edit costs the phrases that it touches, wherever it stands, at every length of text.

Defined results: null text counts as empty. The empty text has a root; two empty texts are alike by 1, an empty and another
by 0. Texts with the same phrases in another order are alike by almost 1. Repeated rows give one row each; equal rows
follow one another. Null doc_id sorts first. doc_id may be any long; another type raises where it can't be cast. Other
columns are ignored. A phrase's hash has 28 bits and is compared within two texts only; equality rests on the root alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tracewright.llm.shared import let

#: Rows that a range of the order by doc_id holds on average, and the most ranges there are (a bound of what is broadcast).
BUCKET, BUCKETS = 1024, 1 << 16
#: Ranges' rows that a task takes.
TASK_ROWS = 8192
_PARAGRAPH = r"(?<=\n)"
_PHRASE = r"(?s)(?<=\s)(?=[aAdDlLmMsS0-9])|(?<=[。！？、，])|(?<=\G.{64})"
_BLANK = "01ba4719c80b6fe911b091a7c05124b6"
_SECTION = f"(?<==[01][0-9a-f]{{31}},)|(?<=={_BLANK},)"


def _phrases(paragraph: Column) -> Column:
    """Of each phrase a number of 36 bits: hash, length (7 bits), a bit for the side in comparisons."""

    def one(p: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(p), 28).bitwiseAND(F.lit(-256)).bitwiseOR(F.shiftleft(F.least(F.length(p), F.lit(127)).cast("long"), 1))

    return F.filter(F.transform(F.split(paragraph, _PHRASE, -1), one), lambda x: x.bitwiseAND(F.lit(254)) > 0)


def _paragraph(paragraph: Column) -> Column:
    """(entry, phrases): the phrases' numbers, and the paragraph's hash at the end."""

    def of(phrases: Column) -> Column:
        listed = F.array_join(F.transform(phrases, lambda x: F.lower(F.hex(x))), ".")
        return F.struct(F.concat(listed, F.lit("="), F.substring(F.sha2(paragraph, 256), 1, 32), F.lit(",")).alias("entry"), phrases.alias("phrases"))

    return let(_phrases(paragraph), of)


def tree(text: Column) -> Column:
    """(root, sections (digest, entry), phrases, size) of a text."""

    def of(size: Column, parts: Column) -> Column:
        entries = F.array_join(F.transform(parts, lambda p: p["entry"]), "")
        sections = F.transform(F.filter(F.split(entries, _SECTION, -1), lambda s: s != ""), lambda s: F.struct(F.sha2(s, 256).alias("digest"), s.alias("entry")))
        return let(
            sections,
            lambda s: F.struct(
                F.sha2(F.array_join(F.transform(s, lambda x: x["digest"]), ","), 256).alias("root"),
                s.alias("sections"),
                F.flatten(F.transform(parts, lambda p: p["phrases"])).alias("phrases"),
                size.cast("long").alias("size"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.transform(F.split(t, _PARAGRAPH, -1), _paragraph), lambda parts: of(F.length(t), parts)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two values of tree(); their root, phrases and size are read."""
    long = lambda n: F.lit(n).cast("long")
    both = F.sort_array(F.concat(a["phrases"], F.transform(b["phrases"], lambda x: x.bitwiseOR(long(1)))))
    none = F.struct(long(-1).alias("phrase"), long(0).alias("spare"), long(0).alias("shared"))

    def step(held: Column, x: Column) -> Column:
        # a phrase's numbers of a stand before those of b; spare counts those of a that b hasn't met yet
        phrase = x.bitwiseAND(long(-2))
        same = held["phrase"] == phrase
        met = F.struct(phrase.alias("phrase"), (held["spare"] - 1).alias("spare"), (held["shared"] + F.shiftright(x.bitwiseAND(long(254)), 1)).alias("shared"))
        more = F.struct(phrase.alias("phrase"), F.when(same, held["spare"] + 1).otherwise(long(1)).alias("spare"), held["shared"].alias("shared"))
        return F.when(x.bitwiseAND(long(1)) == 0, more).when(same & (held["spare"] > 0), met).otherwise(held)

    size = a["size"] + b["size"]
    dice = 2 * F.aggregate(both, none, step, lambda held: held["shared"]) / size
    return F.when(a["root"] == b["root"], 1.0).otherwise(F.least(dice, 1 - 1 / (size + 1)))


def printed(a: Column) -> Column:
    """A value of tree() as a string: root:section[phrase.phrase=paragraph,...]section[...]"""
    return F.concat(a["root"], F.lit(":"), F.array_join(F.transform(a["sections"], lambda s: F.concat(F.substring(s["digest"], 1, 16), F.lit("["), s["entry"], F.lit("]"))), ""))


def _differing(prints: DataFrame, others: DataFrame) -> DataFrame:
    """(doc_id, place, section, paragraph, digest) of prints' paragraphs in sections that others' fingerprint hasn't."""
    listed = F.regexp_extract_all("fingerprint", F.lit(r"([0-9a-f]{16})\[([^\]]*)\]"), F.lit(0))
    own = prints.select("doc_id", listed.alias("own")).join(others.select("doc_id", listed.alias("other")), "doc_id")
    numbered = F.transform("own", lambda s, i: F.struct(i.alias("section"), s.alias("s")))
    first = F.coalesce(F.array_min(F.filter(F.transform("own", lambda s, i: F.when(~s.eqNullSafe(F.get("other", i)), i)), lambda i: i.isNotNull())), F.lit(0))
    places = own.select("doc_id", F.explode(F.filter(numbered, lambda s: s["section"] >= first)).alias("s")).select("doc_id", "s.section", F.posexplode(F.split(F.regexp_extract("s.s", r"\[(.*),\]", 1), ",")).alias("paragraph", "entry"))
    return places.withColumn("digest", F.substring_index("entry", "=", -1)).drop("entry")


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, change, section, paragraph) from two tables of (doc_id, fingerprint), of ids whose roots differ.

    change: `removed` with places of before, `added` with places of after (section, paragraph; from 0): the paragraphs, from
    the first differing section on, that the other text has fewer times (its last ones count), or, where both have the same
    paragraphs, `moved` with the places of after whose paragraph is another one. Repeated and null ids aren't compared.
    """
    keys = ["doc_id", "digest", "nth"]
    prints = []
    for side in (before, after):
        once = side.groupBy("doc_id").agg(F.min("fingerprint").alias("fingerprint"), F.count("*").alias("n")).where("n = 1 and doc_id is not null")
        prints.append(once.select("doc_id", "fingerprint"))
    changed = prints[0].alias("b").join(prints[1].alias("a"), "doc_id").where(F.substring_index("b.fingerprint", ":", 1) != F.substring_index("a.fingerprint", ":", 1)).select("doc_id", F.col("b.fingerprint").alias("b"), F.col("a.fingerprint").alias("a"))
    sides = [changed.select("doc_id", F.col(x).alias("fingerprint")) for x in ("b", "a")]
    nth = F.row_number().over(Over.partitionBy("doc_id", "digest").orderBy("section", "paragraph"))
    old, new = (_differing(x, y).withColumn("nth", nth) for x, y in (sides, sides[::-1]))
    removed = old.join(new.select(keys), keys, "left_anti").select("doc_id", F.lit("removed").alias("change"), "section", "paragraph")
    added = new.join(old.select(keys), keys, "left_anti").select("doc_id", F.lit("added").alias("change"), "section", "paragraph")
    found = removed.unionByName(added)
    order = Over.partitionBy("doc_id").orderBy("section", "paragraph")
    line = [x.select("doc_id", F.row_number().over(order).alias("k"), "digest", "section", "paragraph") for x in (old, new)]
    moved = line[1].join(line[0].select("doc_id", "k", F.col("digest").alias("was")), ["doc_id", "k"]).where("digest <> was")
    moved = moved.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(moved.select("doc_id", F.lit("moved").alias("change"), "section", "paragraph"))


def _below(bounds: list[int], value: Column, or_equal: bool) -> Column:
    """How many of the ascending bounds are below value (or equal), by halves."""
    array = F.lit(bounds).cast("array<long>")

    def search(at: Column, step: int) -> Column:
        if not step:
            return at
        there = F.get(array, at + (step - 1))
        return let(F.when((there <= value) if or_equal else (there < value), at + step).otherwise(at), lambda x: search(x, step // 2))

    return search(F.lit(0), 1 << (len(bounds).bit_length() - 1)) if bounds else F.lit(0)


def with_next(docs: DataFrame, order: str, tie: Column, carried: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """docs with next: the carried columns of the next row by `order` (long, nulls first), then `tie` (an even hash); the last
    row's next is the first. `derived` columns are worked out after the shuffle, from docs' own.

    Rows are dealt by ranges of `order` between sampled quantiles; a value that stands on several quantiles has its rows dealt
    by ranges of `tie`. The first row of a range is also sent to the range before, so one shuffle does.
    """
    long = lambda n: F.lit(n).cast("long")
    rows, filled = docs.agg(F.count("*"), F.count(order)).first()
    shares = max(1, min(BUCKETS, filled // BUCKET))
    bounds = []
    if shares > 1:
        bounds = docs.agg(F.percentile_approx(order, [i / shares for i in range(1, shares)], max(10_000, 8 * shares))).first()[0]
    nulls = max(1, min(BUCKETS, (rows - filled) // BUCKET))
    part = F.col("_tie") / 2.0**64 + 0.5
    low, high = _below(bounds, F.col(order), False), _below(bounds, F.col(order), True)
    among = lambda first, n: first + F.least(F.floor(part * n).cast("int"), n - 1)
    bucket = F.when(F.col(order).isNull(), among(F.lit(0), F.lit(nulls))).otherwise(nulls + let(F.struct(low.alias("low"), high.alias("high")), lambda x: among(x["low"], x["high"] - x["low"] + 1)))
    dealt = docs.withColumn("_tie", tie).withColumn("_bucket", bucket)
    key = F.struct(F.col(order).alias("k"), F.col("_tie").alias("t"))
    every, last = Over.orderBy("_own"), Over.orderBy(F.desc("_own"))
    heads = dealt.groupBy(F.col("_bucket").alias("_own")).agg(F.min(key).alias("_head"))
    heads = F.broadcast(heads.select("_own", "_head", F.coalesce(F.lag("_own").over(every), F.first("_own").over(last)).alias("_before")))
    sent = dealt.join(heads, (F.col("_bucket") == F.col("_own")) & key.eqNullSafe(F.col("_head")), "left")
    copies = F.array_compact(F.array(F.struct(F.col("_bucket").alias("to"), F.lit(0).alias("extra")), F.when(F.col("_own").isNotNull(), F.struct(F.col("_before").alias("to"), F.lit(1).alias("extra")))))
    sent = sent.withColumn("_copy", F.explode(copies)).drop("_own", "_head", "_before", "_bucket").withColumns({"_to": F.col("_copy.to"), "_extra": F.col("_copy.extra")}).drop("_copy")
    sent = sent.repartition(max(1, min(len(bounds) + nulls, rows // TASK_ROWS)), "_to").withColumns(derived or {})
    window = Over.partitionBy("_to").orderBy("_extra", F.col(order).asc_nulls_first(), "_tie")
    sent = sent.withColumn("next", F.lead(F.struct(*carried)).over(window))
    return sent.where("_extra = 0").drop("_to", "_extra", "_tie")
