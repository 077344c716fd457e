"""Column functions on text and dates: canonical keys, strict dates, leading date tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that full case folding changes otherwise than F.lower does, by rule: each with what it becomes. A single lower-case
#: letter that lower case alone gives is left out.
FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x1FBD0)) if c.lower() == c != c.casefold()}
#: The letters that folding turns into two or three.
LENGTHENED = {n: [c for c in map(chr, range(0x80, 0x1FBD0)) if len(c.casefold()) == n] for n in (2, 3)}
#: White space as Unicode has it, and the four separators of ASCII.
SPACE = r"[\s\x1c-\x1f]"
#: Month names.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10,
    "nov": 11, "november": 11, "dec": 12, "december": 12,
}
#: Units of relative dates, each with what it counts in.
UNITS = {"day": "days", "days": "days", "week": "weeks", "weeks": "weeks", "month": "months", "months": "months", "year": "years", "years": "years"}
#: Patterns of a line's leading token.
ISO_TOKEN = rf"(?U)^{SPACE}*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?![0-9])"
US_TOKEN = rf"(?U)^{SPACE}*([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})(?![0-9])"
NAMED_TOKEN = rf"(?U)^{SPACE}*([A-Za-z]{{3,9}}){SPACE}+([0-9]{{1,2}}){SPACE}+([0-9]{{4}})(?![0-9])"
SINCE_TOKEN = rf"(?iU)^{SPACE}*since{SPACE}+"
AGO_TOKEN = rf"(?iU)^{SPACE}*([0-9]{{1,4}}){SPACE}+(day|days|week|weeks|month|months|year|years){SPACE}+(?:ago|prior|earlier)\b"
PAST_TOKEN = rf"(?iU)^{SPACE}*(?:for{SPACE}+the{SPACE}+past|past){SPACE}+([0-9]{{1,4}}){SPACE}+(day|days|week|weeks|month|months|year|years)\b"
FREQUENCY_TOKEN = (
    rf"(?iU)^{SPACE}*(?:q[0-9]{{1,2}}{SPACE}?(?:hrs|hr|h|wks|wk|w|mo|months|month|weeks|week|days|day|d)|qhs|qid|tid|bid|qd"
    rf"|once{SPACE}+daily|twice{SPACE}+daily|daily|every{SPACE}+[0-9]{{1,3}}{SPACE}+(?:day|days|week|weeks|month|months))\b"
)
PARTIAL_TOKEN = rf"(?U)^{SPACE}*([A-Za-z]{{3,9}}){SPACE}+([0-9]{{4}})(?![0-9])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


_SINGLE = {c: x for c, x in FOLDED.items() if len(x) == 1}
_LONGER = {c: x for c, x in FOLDED.items() if len(x) > 1}


def one_of(letters: Iterable[str]) -> str:
    """A pattern of one of the letters, none of them ASCII: neighbours as ranges, and ASCII ruled out first, as a long class is
    slow."""
    codes = set(map(ord, letters))
    starts, ends = (sorted(c for c in codes if c + step not in codes) for step in (-1, 1))
    ranges = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))
    return rf"[\x{{80}}-\x{{10ffff}}&&[{ranges}]]"


def folded(text: Column) -> Column:
    """Full case folding; text without letters beyond ASCII takes lower case alone. Letters that become several are replaced
    one kind at a time, as few kinds stand in a text; what they become holds none of them."""
    longer = F.str_to_map(F.lit(";".join(f"{c}={x}" for c, x in _LONGER.items())), F.lit(";"), F.lit("="))
    pattern = one_of(_LONGER)

    def spread(plain: Column) -> Column:
        kinds = F.array_distinct(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)))
        return F.when(plain.rlike(pattern), F.aggregate(kinds, plain, lambda x, c: F.replace(x, c, F.element_at(longer, c)))).otherwise(plain)

    plain = F.translate(F.lower(text), "".join(_SINGLE), "".join(_SINGLE.values()))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(let(plain, spread))


def normalized(text: Column) -> Column:
    """White space collapsed and trimmed, case folded."""
    return folded(F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " ")))


def fold_literal(text: str) -> str:
    """normalized() of a Python string."""
    return " ".join(text.split()).casefold()


def strict_date(text: Column) -> Column:
    """The date of a `YYYY-MM-DD` string of a real day from year 1 on, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~text.startswith("0000"), text.try_cast("date"))


def iso(day: Column) -> Column:
    """A date as `YYYY-MM-DD`. The cast is much the faster, and the same from year 1 to 9999."""
    return F.when(F.year(day).between(1, 9999), day.cast("string")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def month_number(name: Column) -> Column:
    months = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(months, F.lower(name))


def leading_date(line: Column) -> Column:
    """(day, offset) of a line that begins with an explicit date: ISO, M/D/YYYY or Mon D YYYY. The first form whose token
    matches decides; if it isn't a real day, the result is null, as for lines without a token."""

    def parsed(day: Column, token: str) -> Column:
        return F.when(day.isNotNull(), F.struct(day.alias("day"), F.length(F.regexp_extract(line, token, 0)).alias("offset")))

    us = F.regexp_extract(line, US_TOKEN, 1)
    us = F.when(~us.endswith("/0000"), F.try_to_date(us, "M/d/yyyy"))
    month, day, year = (F.regexp_extract(line, NAMED_TOKEN, i) for i in (1, 2, 3))
    named = strict_date(F.concat_ws("-", year, F.lpad(month_number(month).cast("string"), 2, "0"), F.lpad(day, 2, "0")))
    named = F.when(month_number(month).isNotNull(), named)
    return (
        F.when(line.rlike(ISO_TOKEN), parsed(strict_date(F.regexp_extract(line, ISO_TOKEN, 1)), ISO_TOKEN))
        .when(line.rlike(US_TOKEN), parsed(us, US_TOKEN))
        .when(line.rlike(NAMED_TOKEN), parsed(named, NAMED_TOKEN))
    )


def before(anchor: Column, n: Column, unit: Column) -> Column:
    """The day n units before anchor; months and years end at the month's last day. Null before year 1."""
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), F.lower(unit))
    day = F.when(kind == "days", F.date_sub(anchor, n)).when(kind == "weeks", F.date_sub(anchor, n * 7)).when(kind == "months", F.add_months(anchor, -n)).otherwise(F.add_months(anchor, n * -12))
    return F.when(F.year(day) >= 1, day)


def leading_temporal(line: Column, anchor: Column, relative: bool) -> Column:
    """(kind, day, phrase, offset) of a line's leading token, else null. phrase: where it begins, null if explicit.

    Kinds: explicit; with `relative` also relative, unresolved (no anchor, or before year 1), frequency and partial.
    """
    return let(line, lambda text: let(leading_date(text), lambda explicit: _temporal(text, explicit, anchor, relative)))


def _temporal(line: Column, explicit: Column, anchor: Column, relative: bool) -> Column:
    margin = F.length(F.regexp_extract(line, rf"(?U)^{SPACE}*", 0))

    def found(kind: Column, day: Column, offset: Column, phrase: Column = margin) -> Column:
        return F.struct(kind.alias("kind"), day.cast("date").alias("day"), phrase.cast("int").alias("phrase"), offset.cast("int").alias("offset"))

    def offset(token: str) -> Column:
        return F.length(F.regexp_extract(line, token, 0))

    none = F.lit(None)
    result = F.when(explicit.isNotNull(), found(F.lit("explicit"), explicit["day"], explicit["offset"], none))
    if not relative:
        return result
    rest = leading_date(F.substring(line, offset(SINCE_TOKEN) + 1, F.length(line)))
    result = result.when(line.rlike(SINCE_TOKEN) & rest.isNotNull(), found(F.lit("relative"), rest["day"], offset(SINCE_TOKEN) + rest["offset"]))
    for token in (AGO_TOKEN, PAST_TOKEN):
        n = F.regexp_extract(line, token, 1).try_cast("int")
        day = before(anchor, n, F.regexp_extract(line, token, 2))
        result = result.when(line.rlike(token), found(F.when(day.isNull(), "unresolved").otherwise("relative"), day, offset(token)))
    result = result.when(line.rlike(FREQUENCY_TOKEN), found(F.lit("frequency"), none, offset(FREQUENCY_TOKEN)))
    name = F.regexp_extract(line, PARTIAL_TOKEN, 1)
    return result.when(line.rlike(PARTIAL_TOKEN) & month_number(name).isNotNull(), found(F.lit("partial"), none, offset(PARTIAL_TOKEN)))
