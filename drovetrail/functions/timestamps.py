"""Reading dates, timestamps and counts of mixed form.

``read_instants`` adds, for a string column, whether the value is missing, valid or invalid, its wall-clock time and
what it says about its zone. Values are read by Arrow batches, each distinct value of a batch once; the conversion to
instants is built-in again.
"""

from __future__ import annotations

import datetime
import functools
import re
import zoneinfo
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING, VALID, INVALID = "missing", "valid", "invalid"

# Month names (English and Swedish, full and short), zone letters with minutes east of UTC, and regions.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {"maj": 5, "okt": 10}
MONTH = (
    r"jan(?:uary|uari)?|feb(?:ruary|ruari)?|mar(?:ch|s)?|apr(?:il)?|ma[yj]|june?|juni|july?|juli"
    r"|aug(?:ust|usti)?|sep(?:t|tember)?|o[ck]t(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
ZONE_LETTERS = {"Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180}
# Names of weekdays, English and Swedish, full and short.
WEEKDAY = (
    "mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:r(?:s(?:day)?)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
    "|m[åÅ]n(?:dag)?|tis(?:dag)?|ons(?:dag)?|tors?(?:dag)?|fre(?:dag)?|l[öÖ]r(?:dag)?|s[öÖ]n(?:dag)?"
)

_TIME = r"(?:(?:T|,?[ ]+(?:at[ ]+|kl\.?[ ]*)?)(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<us>\d+))?)?(?:[ ]?(?P<half>[ap])\.?m\.?)?)?"
_ZONE = rf"(?:[ ]?(?P<z>{'|'.join(sorted(ZONE_LETTERS, key=len, reverse=True))}|[+-]\d\d(?::?\d\d)?))?(?:[ ]?\[(?P<region>[A-Za-z][\w+/-]*)\])?"
_WEEKDAY = rf"(?:(?:{WEEKDAY})\.?,?[ ]+)?"
_FORMS = (
    rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_TIME}{_ZONE}",
    rf"(?P<d>\d{{1,2}})[-/.](?P<m>\d{{1,2}})[-/. ](?P<y>\d{{4}}|\d{{2}}){_TIME}{_ZONE}",
    rf"{_WEEKDAY}(?:den[ ]+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th|\.)?[ -]+(?P<name>{MONTH})\.?,?[ -]+(?P<y>\d{{4}}|\d{{2}}){_TIME}{_ZONE}",
    rf"{_WEEKDAY}(?P<name>{MONTH})\.?[ ]+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?[ ]+(?P<y>\d{{4}}){_TIME}{_ZONE}",
    rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)T(?P<h>\d\d):?(?P<mi>\d\d)(?::?(?P<s>\d\d)(?:[.,](?P<us>\d+))?)?{_ZONE}",
    rf"(?P<y>\d{{4}})-?W(?P<week>\d\d)-?(?P<wd>\d){_TIME}{_ZONE}",
    rf"(?P<y>\d{{4}})-(?P<doy>\d{{3}}){_TIME}{_ZONE}",
    rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)(?:(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?)?",
)
_READERS = [re.compile(f, re.ASCII | re.IGNORECASE) for f in _FORMS]
_SIX = re.compile(r"(?P<y>\d\d)(?P<m>\d\d)(?P<d>\d\d)", re.ASCII)
_EPOCH = re.compile(r"\d{10}(?:\d{3})?", re.ASCII)
_DAY0 = datetime.date(1970, 1, 1).toordinal()

Reading = tuple[str, int | None, int | None, str | None, bool | None]
_BAD: Reading = (INVALID, None, None, None, None)


def is_missing(value: Column) -> Column:
    """Null, the empty string and NA stand for no value; they are never faults."""
    return value.isNull() | value.isin("", "NA")


def _day(g: dict[str, str | None]) -> int:
    """Days since 1970; ValueError if there is no such day."""
    year = int(g["y"]) + 2000 * (len(g["y"]) == 2)
    if "week" in g:
        return datetime.date.fromisocalendar(year, int(g["week"]), int(g["wd"])).toordinal() - _DAY0
    if "doy" in g:
        day = datetime.date(year, 1, 1) + datetime.timedelta(int(g["doy"]) - 1)
        if day.year != year:
            raise ValueError("no such day of the year")
        return day.toordinal() - _DAY0
    month = MONTHS[g["name"][:3].lower()] if "name" in g else int(g["m"])
    return datetime.date(year, month, int(g["d"])).toordinal() - _DAY0


def _clock(g: dict[str, str | None]) -> int:
    """Microseconds since midnight; ValueError if there is no such time of day. Digits beyond the microsecond are dropped."""
    hour, minute, second = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    if g.get("half"):
        if not 1 <= hour <= 12:
            raise ValueError("no such hour")
        hour = hour % 12 + 12 * (g["half"].lower() == "p")
    if hour > 23 or minute > 59 or second > 59:
        raise ValueError("no such time of day")
    return ((hour * 60 + minute) * 60 + second) * 1_000_000 + int(((g.get("us") or "") + "000000")[:6])


def _offset(zone: str) -> int:
    letters = ZONE_LETTERS.get(zone.upper())
    if letters is not None:
        return letters
    minutes = int(zone[1:3]) * 60 + int(zone[3:].lstrip(":") or 0)
    if minutes > 1080 or int(zone[3:].lstrip(":") or 0) > 59:
        raise ValueError("no such offset")
    return -minutes if zone[0] == "-" else minutes


@functools.cache
def _region(name: str) -> zoneinfo.ZoneInfo | None:
    """The region of that name in the time zone database, None if there is none."""
    try:
        return zoneinfo.ZoneInfo(name) if name in zoneinfo.available_timezones() else None
    except (ValueError, OSError):
        return None


def local_offset(wall: int, zone: datetime.tzinfo) -> int:
    """Seconds east of UTC of a wall-clock time (microseconds as if in UTC): the earlier instant of two, the offset before a gap."""
    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=wall)
    return round(at.replace(tzinfo=zone).utcoffset().total_seconds())


def read_text(text: str | None, six_digits: bool) -> Reading:
    """State, wall-clock microseconds as if in UTC, minutes east of UTC, named region, whether there is a time of day."""
    if text is None or text in ("", "NA"):
        return (MISSING, None, None, None, None)
    text = text.strip(" \t\r\n")
    if _EPOCH.fullmatch(text):
        return (VALID, int(text) * (1_000_000 if len(text) == 10 else 1000), 0, None, True)
    found = next((m for r in (*_READERS, *([_SIX] if six_digits else ())) if (m := r.fullmatch(text))), None)
    if found is None:
        return _BAD
    g = found.groupdict()
    try:
        wall = _day(g) * 86_400_000_000 + _clock(g)
        offset = _offset(g["z"]) if g.get("z") else None
    except ValueError:
        return _BAD
    region = g.get("region")
    if region:
        zone = _region(region)
        if zone is None:
            return _BAD
        if offset is None:  # offsets before standard time have seconds, which go into the time
            seconds = local_offset(wall, zone)
            wall, offset = wall - seconds % 60 * 1_000_000, seconds // 60
    return (VALID, wall, offset, region, g.get("h") is not None)


def read_instants(df: DataFrame, value: str, prefix: str, zone: str, six_digits: bool = False) -> DataFrame:
    """Add what a text column says about time.

    New columns, all named after ``prefix``: ``_state`` (missing, valid, invalid), ``_wall`` (wall-clock microseconds as
    if in UTC), ``_offset`` (minutes east of UTC if the value says so or names a region of the time zone database), ``_named`` (that region),
    ``_timed`` (whether it has a time of day) and ``_micros`` (the instant: microseconds since 1970 UTC, null unless
    valid). A value without zone is wall-clock time of ``zone``: of two possible instants the earlier one, of a skipped
    time the one by the offset before the change. No time of day means midnight there. Digits beyond the microsecond
    are dropped. Surrounding blanks don't matter. Texts of any length are read; only the whole value can be a form.
    """
    added = [T.StructField(f"{prefix}_{n}", t()) for n, t in (("state", T.StringType), ("wall", T.LongType), ("offset", T.IntegerType), ("named", T.StringType), ("timed", T.BooleanType))]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
    names = [f.name for f in added]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index(value)).dictionary_encode("encode")
            readings = list(zip(*(read_text(v, six_digits) for v in codes.dictionary.to_pylist()), strict=True)) or [()] * 5
            columns = [pa.array(c, t).take(codes.indices) for c, t in zip(readings, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    out = df.mapInArrow(read, T.StructType([*df.schema.fields, *added]))
    c = lambda n: F.col(f"{prefix}_{n}")
    return out.withColumn(f"{prefix}_micros", F.when(c("state") == VALID, instant(c("wall"), c("offset"), zone)))


def instant(wall: Column, offset: Column, zone: str) -> Column:
    """Microseconds since 1970 UTC of a wall-clock time, by its own offset, else by the given zone."""
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))
    return F.when(offset.isNotNull(), wall - offset.cast("bigint") * 60_000_000).otherwise(local)


def quantity(value: Column) -> Column:
    """A count as bigint: digits, optionally a point and zeros only, within blanks; null if it isn't one (or beyond bigint)."""
    return F.when(is_quantity(value), F.regexp_extract(value, r"([0-9]+)", 1)).try_cast("bigint")


def is_quantity(value: Column) -> Column:
    return value.rlike(r"\A[ \t\r\n]*[0-9]+(?:\.0+)?[ \t\r\n]*\z")
