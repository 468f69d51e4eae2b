"""Dates that a query asks for and dates in session headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in English and French.
MONTHS = {
    "january": 1, "janvier": 1, "february": 2, "fevrier": 2, "février": 2, "march": 3, "mars": 3, "april": 4, "avril": 4, "may": 5, "mai": 5,
    "june": 6, "juin": 6, "july": 7, "juillet": 7, "august": 8, "aout": 8, "août": 8, "september": 9, "septembre": 9, "october": 10, "octobre": 10,
    "november": 11, "novembre": 11, "december": 12, "decembre": 12, "décembre": 12,
}
NAMES = "|".join(MONTHS)
ISO = r"(?:^|[^0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[^0-9]|$)"
DAY_FIRST = rf"(?i)\b([0-9]{{1,2}})(?:st|nd|rd|th|er)?\s+({NAMES})\s+([0-9]{{4}})\b"
MONTH_FIRST = rf"(?i)\b({NAMES})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})\b"
RANGE = r"(?i)\b(?:before|after|since|until|between|avant|apres|après|depuis|entre)\s+(?:(?:the|le|la date du)\s+)?[0-9]"
HEADER = r"(?i)^Session [a-f0-9-]+\s+-\s+([0-9]{4}-[0-9]{2}-[0-9]{2})\s+-"


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in (kv[0], f"{kv[1]:02d}")])
    return F.element_at(table, F.lower(name))


def requested_date(query: Column) -> Column:
    """The ISO date of a query about one session on one explicit date, else null."""
    found = lambda regex, g: F.regexp_extract_all(query, F.lit(regex), F.lit(g))
    day = lambda d: F.lpad(d, 2, "0")
    joined = lambda y, m, d: F.zip_with(F.zip_with(y, m, lambda a, b: F.concat(a, F.lit("-"), _month(b), F.lit("-"))), d, lambda a, b: F.concat(a, day(b)))
    every = F.concat(found(ISO, 1), joined(found(DAY_FIRST, 3), found(DAY_FIRST, 2), found(DAY_FIRST, 1)), joined(found(MONTH_FIRST, 3), found(MONTH_FIRST, 1), found(MONTH_FIRST, 2)))
    valid = F.forall(every, lambda x: F.try_to_date(x, "yyyy-MM-dd").isNotNull())
    one = F.array_distinct(every)
    asked = query.rlike(r"(?i)\bsessions?\b") & ~query.rlike(RANGE)
    return F.when(asked & valid & (F.size(one) == 1), F.element_at(one, 1))


def header_date(kind: Column, content: Column) -> Column:
    """The date in the header of a session chunk (an episode has a ``[session/..]`` line before it), else null."""
    lines = F.split(content, "\r?\n|\r")
    second = F.when(F.size(lines) > 1, F.get(lines, F.lit(1)))
    line = F.when(kind == "session", F.get(lines, F.lit(0))).when((kind == "episode") & F.get(lines, F.lit(0)).startswith("[session/"), second)
    date = F.regexp_extract(line, HEADER, 1)
    return F.when(date != "", date)
