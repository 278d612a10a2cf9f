"""Date formats with percent directives: one table that says which are valid and how they are read."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The directives with the pattern of the text each stands for and the part of a date it gives (None: none).
DIRECTIVES = {
    "%Y": (r"\d{4}", "year"), "%y": (r"\d{2}", "short_year"), "%m": (r"\d{1,2}", "month"), "%b": (r"[A-Za-z]{3,9}", "name"), "%B": (r"[A-Za-z]{3,9}", "name"), "%h": (r"[A-Za-z]{3,9}", "name"),
    "%d": (r"\d{1,2}", "day"), "%e": (r" ?\d{1,2}", "day"), "%s": (r"-?\d{1,12}", "seconds"), "%H": (r"\d{1,2}", None), "%I": (r"\d{1,2}", None), "%M": (r"\d{1,2}", None), "%S": (r"\d{1,2}", None),
    "%OS": (r"\d{1,2}(?:[.,]\d+)?", None), "%p": (r"[AaPp]\.?[Mm]\.?", None), "%z": (r"[+-]\d{2}:?\d{2}", None), "%Z": (r"[A-Za-z][A-Za-z0-9_/+-]*", None), "%a": (r"[A-Za-z]{3}", None), "%A": (r"[A-Za-z]{3,9}", None),
    "%.": (r"\D", None), "%+": (r"\D+", None), "%*": (r"\D*", None), "%%": ("%", None),
}
# Directives that stand for several.
SHORT = {"%D": "%m/%d/%y", "%F": "%Y-%m-%d", "%x": "%y/%m/%d", "%T": "%H:%M:%S", "%R": "%H:%M", "%AT": "%H:%M"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: The format that takes year, month and day between any of three marks, and what it is written as.
FLEXIBLE = ("", "%AD")
_TOKEN = re.compile(r"%(?:AD|AT|OS|.)|[^%]+|%", re.DOTALL)


def tokens(form: str) -> list[str]:
    """Directives and literal texts of a format, shortcuts taken apart; ValueError for an unknown directive."""
    out = []
    for t in _TOKEN.findall(form):
        if t in SHORT:
            out += tokens(SHORT[t])
        elif t[0] == "%" and t not in DIRECTIVES:
            raise ValueError(f"no such directive: {t}")
        else:
            out.append(t)
    return out


def is_valid(form: str) -> bool:
    """Whether a date can be read by a format: it is the flexible one, or all its directives are known and one of them is a part of a date."""
    if form in FLEXIBLE:
        return True
    try:
        return any(DIRECTIVES.get(t, ("", None))[1] for t in tokens(form))
    except ValueError:
        return False


def read_date(text: Column, form: str) -> Column:
    """A date by format; the flexible one reads year, month, day. Null where the whole value doesn't fit or names no day.

    Parts that the format lacks are those of 1970-01-01; two-digit years below 69 are 20xx, as usual for such formats.
    """
    parts: dict[str, int] = {}
    if form in FLEXIBLE:
        pattern, parts = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", {"year": 1, "month": 2, "day": 3}
    else:
        pattern = ""
        for t in tokens(form):
            regex, part = DIRECTIVES.get(t, (re.escape(t), None))
            if part and part not in parts:
                parts[part] = len(parts) + 1
                regex = f"({regex})"
            pattern += regex
    whole = rf"^\s*{pattern}\s*$"
    get = lambda p: F.trim(F.regexp_extract(text, whole, parts[p]))
    if "seconds" in parts:
        return F.when(text.rlike(whole), F.timestamp_seconds(get("seconds").try_cast("bigint")).cast("date"))
    year = get("year") if "year" in parts else F.lit("1970")
    if "short_year" in parts and "year" not in parts:
        year = F.concat(F.when(get("short_year") < "69", "20").otherwise("19"), get("short_year"))
    month, day = get("month") if "month" in parts else F.lit("1"), get("day") if "day" in parts else F.lit("1")
    if "name" in parts and "month" not in parts:
        short = F.lower(F.substring(get("name"), 1, 3))
        month = reduce(lambda c, m: F.when(short == m[1], str(m[0])).otherwise(c), enumerate(MONTHS, 1), F.lit(None).cast("string"))
    return F.when(text.rlike(whole), F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date"))
