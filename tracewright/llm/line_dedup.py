"""Operator 2: removal of repeated passages by winnowing. DataFrame functions only.

A passage may begin anywhere in a line, so lines are cut into words. A run of `least_words` words that begins at an
anchor may be a fingerprint; an anchor is a word whose hash says so, one in eight. Of every two consecutive anchors
the one of the lower hash is one. So are the runs at the starts of lines of that many words, and those at places before which few anchors stand.
Hence two copies of a run of 2 * least_words + 1 words or more, and of a whole line of least_words words or more, always
share a fingerprint; shorter runs down to least_words words do if an anchor's run lies within them.

A fingerprint's place (document, word) is joined with its first place: from there on `least_words` words of both are equal.
Matches that touch are one run. At either end it is extended, word by word, along the diagonal of its outermost match (the
first document, and the distance there) as long as both places have the same words, up to `least_words` - 1 words, beyond
which another fingerprint takes over. Later runs are deleted, whatever white space stands between their words. So nothing is deleted but runs of least_words words or more that stand, in one
piece, in an earlier document (by doc_id) or earlier in the same one; the earliest always stays. Documents whose whole
text equals an earlier one's become empty, however few words they have. Shorter repeated runs and lines stay.

Hashes are joined with their first place alone, never with each other, and are aggregated before they are shuffled, so a
passage in a third of all documents costs no more than its occurrences. Texts aren't shuffled, but for those that match.
Runs are compared by 96 bits (xxHash64 of all words, Murmur3 of three of them), extensions by 64 bits a word, whole texts by
SHA-256.

Defined results: null text stays null; an empty text stays empty; a document all of whose text stands earlier becomes
empty, or is dropped if so asked. Repeated rows (equal doc_id and text) are one document and stay alike; rows of a doc_id
with several texts, and of null doc_id, are kept as they are and nothing is compared with them. Ideographs, kana and hangul
syllables are words of their own. Ties: equal hashes of two anchors are both fingerprints. Other columns stay, whatever their
names. doc_id must be castable to long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tracewright.llm.near_duplicates import only
from tracewright.llm.shared import let, settled, staged

LEAST_WORDS = 25
#: So many words in 32 are anchors.
ANCHORS = 4
_BLANK = " \t\n\x0b\f\r"
#: Signs that are words of their own: ideographs, kana, hangul syllables.
_SIGN = "[⺀-〿぀-鿿가-힯豈-﫿]"
_AMONG = rf"\s+|(?<={_SIGN})(?=\S)|(?<=\S)(?={_SIGN})"
#: What texts of plain words have none of: white space but blanks and line feeds, and all from the first sign on.
_ODD = "[\t\r\x0b\f⺀-\U0010ffff]"
#: A word with its white space: what stands before it, and after the last word.
_PIECE = r"\s*+\S++(?:\s++\z)?+"
_PIECE_AMONG = rf"(?<=\S)(?=\s+\S)|(?<={_SIGN})(?=\S)|(?<=\S)(?={_SIGN})"


def _signs(text: Column) -> Column:
    return (F.octet_length(text) > F.length(text)) & text.rlike(_SIGN)


def _lines(text: Column) -> Column:
    """The words of each line."""
    other = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\f")
    plain = F.when(other, F.regexp_replace(text, r"[\t\r\x0b\f]", " ")).otherwise(text)
    words = lambda x: F.array_remove(F.split(x, " ", -1), "")
    among = lambda x: F.array_remove(F.split(x, _AMONG, -1), "")
    return F.when(_signs(text), F.transform(F.split(text, "\n", -1), among)).otherwise(F.transform(F.split(plain, "\n", -1), words))


def _pieces(text: Column) -> Column:
    """The words, of which there are some, with the white space that belongs to them."""
    return F.when(_signs(text), F.split(text, _PIECE_AMONG, -1)).otherwise(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)))


def _number(n: int) -> Column:
    return F.lit(n).cast("long")


def _hashes(text: Column) -> Column:
    """Hashes of the words of each line; lines of plain words are cut at blanks alone."""
    plain = lambda x: F.array_remove(F.transform(F.split(x, " ", -1), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    other = F.transform(_lines(text), lambda words: F.transform(words, lambda w: F.xxhash64(w)))
    return F.when(text.rlike(_ODD), other).otherwise(F.transform(F.split(text, "\n", -1), plain))


def _sums(values: Column, steps: int = 24) -> Column:
    """Sums of the values before each, by doubling: 2 ** steps values at most."""
    if not steps:
        return values
    half = _sums(values, steps - 1)
    reach = 1 << (steps - 1)
    return let(half, lambda v: F.when(F.size(v) > reach, F.transform(v, lambda x, i: x + F.coalesce(F.get(v, i - reach), F.lit(0)))).otherwise(v))


def _line_starts(lines: Column, least: int) -> Column:
    """The first words of lines of `least` words or more."""

    def starts(counts: Column) -> Column:
        return let(_sums(counts), lambda s: F.array_compact(F.transform(s, lambda x, i: F.when(F.get(counts, i) >= least, x - F.get(counts, i)))))

    return F.when(F.exists(lines, lambda x: F.size(x) >= least), let(F.transform(lines, lambda x: F.size(x)), starts)).otherwise(F.array().cast("array<int>"))


def _ends(hashes: Column) -> Column:
    """Places of the anchors, from 0, and the number of words."""
    bits = _number((32 - ANCHORS) << 9)  # none is set where hash >> 9 & 31 < ANCHORS, a power of two
    return F.concat(F.array_remove(F.transform(hashes, lambda h, i: F.when(h.bitwiseAND(bits) == _number(0), i).otherwise(-1)), -1), F.array(F.size(hashes)))


def _chosen(least: int) -> Column:
    """Of the k-th end (words, starts, ends, k, end): its place if it is an anchor and a fingerprint, the places at the end of a
    stretch of least + 1 words without any anchor before it, and at the first end all line starts."""
    none = F.array().cast("array<int>")
    end, size = F.col("end"), F.size("words")
    before, after = F.get("ends", F.col("k") - 1), F.get("ends", F.col("k") + 1)
    own = F.get("words", end)
    lower = F.coalesce(own <= F.get("words", before), F.lit(True)) | F.coalesce(own <= F.get("words", after), F.lit(True))
    low = F.coalesce(before, F.lit(-1)) + (least + 1)
    alone = F.greatest(end, low, F.lit(least)) <= F.least(after - 1, end + least)  # in a stretch of least + 1 words
    high = F.least(end - 1, size - least)
    return F.concat(F.when(own.isNotNull() & (lower | alone), F.array(end)).otherwise(none), F.when(low <= high, F.sequence(low, high)).otherwise(none), F.when(F.col("k") == 0, F.col("starts")).otherwise(none))


def fingerprints(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, pos, h, c): the fingerprints of docs (doc_id, text); pos is a word, from 0. A line's start may come twice."""

    # lambda functions are interpreted, so what needs none is left to rows in compiled code; of an outer explode Spark infers no
    # filter, which would work all out twice
    texts = docs.select("doc_id", _hashes(F.col("text")).alias("lines")).select("doc_id", F.flatten("lines").alias("words"), _line_starts(F.col("lines"), least_words).alias("starts"))
    texts = texts.select("doc_id", "words", "starts", F.when(F.size("words") >= least_words, _ends(F.col("words"))).alias("ends"))
    ends = texts.select("doc_id", "words", "starts", "ends", F.posexplode_outer("ends").alias("k", "end")).where("k is not null")
    rows = ends.select("doc_id", "words", F.explode_outer(_chosen(least_words)).alias("pos")).where(F.col("pos") <= F.size("words") - least_words)
    check = F.hash(*(F.get("words", F.col("pos") + k) for k in (0, least_words // 2, least_words - 1)))
    return rows.select("doc_id", "pos", F.xxhash64(F.slice("words", F.col("pos") + 1, least_words)).alias("h"), check.alias("c"))


def _places(texts: DataFrame) -> tuple[Column, Callable[[Column], tuple[Column, Column]]]:
    """A place (doc_id, pos) as one value that sorts like it, and how to take it apart: a number where ids and lengths leave
    room for both in 62 bits, which is cheaper to aggregate, else a struct."""
    low, high, longest = texts.agg(F.min("doc_id"), F.max("doc_id"), F.max("n")).first()
    bits = int(longest or 0).bit_length()
    if low is None or (high - low + 1).bit_length() + bits > 62:
        return F.struct("doc_id", "pos"), lambda p: (p["doc_id"], p["pos"])
    packed = F.shiftleft(F.col("doc_id") - _number(low), bits).bitwiseOR(F.col("pos").cast("long"))
    return packed, lambda p: (F.shiftright(p, bits) + _number(low), p.bitwiseAND(_number((1 << bits) - 1)).cast("int"))


def _matches(prints: DataFrame, apart: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """(doc_id, pos, doc0, pos0): later places of fingerprints (place, h, c) with their first place."""
    # what a hot hash is joined with is staged, so that both sides come from shuffles and the hot one can be split
    first = staged(prints.groupBy("h", "c").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("h", "c", "first"))
    later = prints.join(first, ["h", "c"]).where("place > first")
    (doc, pos), (doc0, pos0) = apart(F.col("place")), apart(F.col("first"))
    return later.select(doc.alias("doc_id"), pos.alias("pos"), doc0.alias("doc0"), pos0.alias("pos0"))


def _runs(matches: DataFrame, least: int) -> DataFrame:
    """(doc_id, first, last, left, right): matches that touch, as one run; left and right: the first places (doc0, pos0) that
    its first and last word have on the diagonals of its first and last match."""
    order = Over.partitionBy("doc_id").orderBy("pos")
    rows = matches.withColumn("before", F.lag("pos").over(order))
    rows = rows.withColumn("run", F.sum(F.when(F.col("pos") > F.col("before") + least, 1).otherwise(0)).over(order))
    left = F.min(F.struct("pos", "doc0", "pos0"))
    right = F.max(F.struct("pos", "doc0", "pos0"))
    runs = rows.groupBy("doc_id", "run").agg(left.alias("l"), right.alias("r"))
    end = least - 1
    return runs.select("doc_id", F.col("l.pos").alias("first"), (F.col("r.pos") + end).alias("last"), F.struct(F.col("l.doc0").alias("doc"), F.col("l.pos0").alias("pos")).alias("left"), F.struct(F.col("r.doc0").alias("doc"), (F.col("r.pos0") + end).alias("pos")).alias("right"))


def _extended(runs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, first, last): runs, extended both ways along the diagonals of their ends."""
    reach = least
    ends = F.explode(F.array(*(F.struct(F.lit(after).alias("after"), F.col(edge).alias("pos"), F.col(side).alias("other")) for after, edge, side in ((False, "first", "left"), (True, "last", "right")))))
    ends = staged(runs.select("doc_id", "first", ends.alias("e")).select("doc_id", "first", "e.after", "e.pos", F.col("e.other.doc").alias("doc0"), F.col("e.other.pos").alias("pos0")))
    asked = ends.select(F.col("doc_id").alias("at"), "after", "pos").union(ends.select("doc0", "after", "pos0")).distinct()
    places = staged(asked.groupBy(F.col("at").alias("doc_id")).agg(F.collect_list(F.struct("after", "pos")).alias("places")))

    texts = only(docs, places.select("doc_id")).join(places, "doc_id").select(F.col("doc_id").alias("at"), _hashes(F.col("text")).alias("lines"), "places")
    rows = texts.select("at", F.flatten("lines").alias("hashes"), F.explode_outer("places").alias("p")).select("at", "hashes", "p.after", "p.pos")
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.when(F.col("after"), F.slice("hashes", F.col("pos") + 2, reach)).otherwise(F.reverse(F.slice("hashes", low + 1, F.col("pos") - low)))
    words = staged(rows.select("at", "after", "pos", around.alias("words")))
    own = ends.join(words.select(F.col("at").alias("doc_id"), "after", "pos", F.col("words").alias("own")), ["doc_id", "after", "pos"])
    both = own.join(words.select(F.col("at").alias("doc0"), "after", F.col("pos").alias("pos0"), F.col("words").alias("other")), ["doc0", "after", "pos0"])
    alike = let(F.array_position(F.zip_with("own", "other", lambda x, y: x.eqNullSafe(y)), False), lambda k: F.when(k > 0, k - 1).otherwise(F.size("own"))).cast("int")
    edge = F.when(F.col("after"), F.col("pos") + alike).otherwise(F.col("pos") - alike)
    return both.select("doc_id", F.col("first").alias("run"), edge.alias("edge")).groupBy("doc_id", "run").agg(F.min("edge").alias("first"), F.max("edge").alias("last")).drop("run")


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, runs): of each document with later repeated runs, the words (first, last; from 0) of each; runs may overlap. Of
    a document whose whole text equals an earlier one's, runs is null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = staged(docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").alias("n"), (F.ltrim("text", F.lit(_BLANK)) != "").alias("filled")))
    repeated = staged(texts.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("sha") != F.max("sha")).alias("several")).where("n > 1"))
    several, alike = repeated.where("several").select("doc_id"), repeated.where("not several").select("doc_id")
    single = only(texts, several, how="left_anti").where("filled")
    twice = staged(single.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("sha", "low"))
    copies = staged(single.join(twice, "sha").where("doc_id > low").select("doc_id").distinct())
    if alike.head(1):
        docs = only(docs, alike, how="left_anti").unionByName(only(docs, alike).select("doc_id", "text").dropDuplicates(["doc_id"]))
    docs = only(docs, several.union(copies), how="left_anti")
    place, apart = _places(texts)
    prints = staged(fingerprints(docs, least_words).select(place.alias("place"), "h", "c"))
    runs = staged(_runs(_matches(prints, apart), least_words))
    found = _extended(runs, docs, least_words).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))
    return found.unionByName(copies.withColumn("runs", F.lit(None).cast(found.schema["runs"].dataType)))


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, drop_emptied: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) without later repeated runs; n_chars, if there, follows. drop_emptied: documents that lose all
    their words go."""
    runs = settled(lambda: repeated_runs(docs, least_words).select(F.col("doc_id").alias("__of"), F.col("runs").alias("__repeated_runs")))

    def rebuilt(pieces: Column) -> Column:
        """What stands between the runs; both their first and their last words rise."""
        runs = F.col("__repeated_runs")

        def between(k: Column) -> Column:
            start = F.coalesce(F.get(runs, k - 1)["last"] + 1, F.lit(0))
            return F.slice(pieces, start + 1, F.greatest(F.coalesce(F.get(runs, k)["first"], F.size(pieces)) - start, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), between)), "")

    keyed = docs.withColumn("__of", F.col("doc_id").cast("long"))
    changed = only(keyed, runs.select("__of"), "__of").join(runs, "__of").withColumn("text", F.when(F.col("text").isNotNull(), F.when(F.col("__repeated_runs").isNull(), "").otherwise(let(_pieces(F.col("text")), rebuilt))))
    if drop_emptied:
        changed = changed.where(F.ltrim("text", F.lit(_BLANK)) != "")
    changed = changed.select(docs.columns)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return only(keyed, runs.select("__of"), "__of", "left_anti").select(docs.columns).unionByName(changed)
