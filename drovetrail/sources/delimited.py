"""Delimited files and tables of text into one typed schema, as a configuration says."""

from __future__ import annotations

import re
import unicodedata
import warnings

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dateformats import read_date
from ..functions.grid import add_degrees
from .config import COORDS, PREFIX, REQUIRED, Config

# Letters that normalisation doesn't take apart, and words that can't be names as they are.
LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "œ": "oe", "Œ": "OE", "ı": "i"}
RESERVED = {"if", "else", "repeat", "while", "function", "for", "next", "break", "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA", "in"}

def asciify(names: list[str]) -> list[str]:
    """Names in ASCII, valid and unique: other characters become points, a leading digit gets an X, repeats get .1, .2."""
    out: list[str] = []
    for name in names:
        # Letters are taken apart, their marks dropped; what has no ASCII form becomes a point each.
        apart = unicodedata.normalize("NFKD", "".join(LETTERS.get(c, c) for c in name))
        plain = re.sub(r"[^A-Za-z0-9._]", ".", "".join(c for c in apart if not unicodedata.combining(c)))
        if not plain or not re.match(r"[A-Za-z.]", plain) or re.match(r"\.[0-9]", plain):
            plain = f"X{plain}"
        plain = f"{plain}." if plain in RESERVED else plain
        n, base = 0, plain
        while plain in out:
            n += 1
            plain = f"{base}.{n}"
        out.append(plain)
    return out


#: Holds records whose number of fields isn't the header's.
TORN = "__torn_record"


def _reader(spark: SparkSession, path: str, options: dict, multi_line: bool | None) -> tuple[DataFrameReader, list[str]]:
    """A reader of text columns and the header. Quotation marks within quotes are doubled (RFC 4180)."""
    reader = spark.read.options(header=True, sep=options["separator"], encoding=options["encoding"], nullValue="NA", emptyValue="", quote='"', escape='"', inferSchema=False)
    if multi_line is None:
        # Files whose lines all have whole quotes can be split between tasks, others can't.
        marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).filter(marks % 2 == 1).isEmpty()
    return reader.option("multiLine", multi_line), reader.csv(path).columns


def scan(spark: SparkSession, path: str, options: dict, multi_line: bool | None = None) -> DataFrame:
    """A delimited file, every column as text, with names in ASCII. NA and nothing are null.

    Line breaks may stand in quoted fields; by default a look at the lines finds out whether any do (``multi_line``). ValueError
    if records have another number of fields than the header; ``scan_torn`` gives the others and those apart.
    """
    good, torn = scan_torn(spark, path, options, multi_line)
    n = torn.count()
    if n:
        raise ValueError(f"{path}: {n} records don't have the header's {len(good.columns)} fields, the first is {torn.first()['record'][:200]!r}")
    return good


def scan_torn(spark: SparkSession, path: str, options: dict, multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """The records of a delimited file with as many fields as its header, and the others as they are (``record``)."""
    reader, header = _reader(spark, path, options, multi_line)
    fields = [T.StructField(c, T.StringType()) for c in header]
    df = reader.option("columnNameOfCorruptRecord", TORN).schema(T.StructType([*fields, T.StructField(TORN, T.StringType())])).csv(path)
    good = df.filter(F.col(TORN).isNull()).select(*(F.col(f"`{c}`") for c in header))
    # A query of that column alone isn't allowed, so the condition names the others too.
    named = F.length(F.concat_ws("", *(F.col(f"`{c}`") for c in header))) >= 0
    return good.toDF(*asciify(header)), df.filter(F.col(TORN).isNotNull() & named).select(F.col(TORN).alias("record"))


def from_table(df: DataFrame) -> DataFrame:
    """A table as a source: every column as text, names in ASCII."""
    return df.select([F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(df.columns, asciify(df.columns), strict=True)])


def resolve(columns: list[str], cols: dict, required: tuple[str, ...]) -> dict[str, str]:
    """Roles to column names: numbers count from 1. Missing required columns raise one error that lists them all, missing optional ones are dropped with a warning."""
    found, missing, dropped = {}, [], []
    for role, at in cols.items():
        name = (columns[at - 1] if 1 <= at <= len(columns) else None) if isinstance(at, int) else asciify([at])[0]
        if name in columns and name not in found.values():
            found[role] = name
        elif name in found.values():
            raise ValueError(f"{role}: column {name} has another role already")
        else:
            (missing if role in required else dropped).append(f"{role} ({at})")
    if missing:
        raise ValueError(f"Can't find the following mandatory columns: {', '.join(missing)}")
    if dropped:
        warnings.warn(f"Can't find the following requested columns, which are left out: {', '.join(dropped)}", stacklevel=3)
    return found


def with_names(config: Config, kind: str, columns: list[str]) -> Config:
    """The configuration with columns that are given by number under their names in a table; roles it lacks are left out."""
    roles = resolve(columns, config.cols(kind), REQUIRED[kind]["cols"])
    return Config({**config.groups, f"{PREFIX[kind]}_cols": roles})


def number(text: Column, decimal: str) -> Column:
    """A number with the given decimal mark and no grouping mark; null where it isn't one."""
    form = rf"^\s*[+-]?(?:[0-9]+(?:{re.escape(decimal)}[0-9]*)?|{re.escape(decimal)}[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
    return F.when(text.rlike(form), F.replace(F.trim(text), F.lit(decimal), F.lit("."))).cast("double")


def guess_types(df: DataFrame, columns: list[str], decimal: str) -> DataFrame:
    """Further columns by their values: logical, number, date, timestamp, else text. One job looks at all of them."""
    if not columns:
        return df
    kinds = {
        "boolean": lambda c: F.when(c.rlike("^(?:T|F|TRUE|FALSE|true|false|True|False)$"), F.upper(F.substring(c, 1, 1)) == "T"),
        "double": lambda c: number(c, decimal),
        "date": lambda c: read_date(c, ""),
        "timestamp": lambda c: F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), c).try_cast("timestamp"),
    }
    tests = [F.count_if(F.col(c).isNotNull() & read(F.col(c)).isNull()).alias(f"{k}|{c}") for c in columns for k, read in kinds.items()]
    some = [F.count(c).alias(f"any|{c}") for c in columns]
    seen = df.agg(*tests, *some).first().asDict()
    pick = lambda c: next((k for k in kinds if seen[f"any|{c}"] and not seen[f"{k}|{c}"]), None)
    return df.withColumns({c: kinds[k](F.col(c)) for c in columns if (k := pick(c))})


def standardise(source: DataFrame, config: Config, kind: str) -> DataFrame:
    """Required columns first and typed, further configured ones after them with guessed types, under the source's names.

    Columns of text are checked in one job, and all failures are raised together: numbers that don't read (or have
    grouping marks), dates that don't fit the format or hold no digits. Null stays null. An empty table passes.
    """
    options, required = config.fileopts(kind), REQUIRED[kind]["cols"]
    roles = resolve(source.columns, config.cols(kind), required)
    decimal = options["decimal"]
    first = [*required, *(r for r in ("type", "herd_size", *COORDS) if kind == "holding" and r in roles)]
    extra = [r for r in roles if r not in first]
    numbers = [roles[r] for r in ("weight", "herd_size", *COORDS) if r in roles and r in first]
    dates = [roles["date"]] if "date" in roles else []
    df = source.select(*(roles[r] for r in [*first, *extra]))
    typed = {c: number(F.col(c), decimal) for c in numbers} | {c: read_date(F.col(c), options["date_format"]) for c in dates}
    checks = [F.count_if(F.col(c).isNotNull() & t.isNull()).alias(f"bad|{c}") for c, t in typed.items()]
    digits = [F.count_if(F.col(c).rlike("[0-9]")).alias(f"digits|{c}") for c in dates]
    if typed:
        seen, problems = df.agg(*checks, *digits).first(), []
        for c in numbers:
            if seen[f"bad|{c}"]:
                problems.append(f"Column {c} must be numeric and can't contain a grouping mark: {seen[f'bad|{c}']} values don't read")
        for c in dates:
            if seen[f"bad|{c}"]:
                why = f"don't match the date format {options['date_format'] or 'year, month, day'}" if seen[f"digits|{c}"] else "contain no digits; is it a date column?"
                problems.append(f"Column {c}: {seen[f'bad|{c}']} values {why}")
        if problems:
            raise ValueError("\n".join(problems))
        df = df.withColumns(typed)
    df = guess_types(df, [roles[r] for r in extra], decimal)
    if kind == "holding" and all(c in roles for c in COORDS):
        x, y = (roles[c] for c in COORDS)
        df = add_degrees(df, x, y, options["coord_EPSG_code"], "coordinates")
        lead = [roles[r] for r in first if r not in COORDS]
        df = df.select(*lead, "coordinates", *(roles[r] for r in extra))
    return df


def read_delimited(spark: SparkSession, path: str, config: Config, kind: str) -> DataFrame:
    return standardise(scan(spark, path, config.fileopts(kind)), config, kind)


def read_jdbc(spark: SparkSession, url: str, table: str, date_column: str, start: str, end: str, **options: str) -> DataFrame:
    """Movements of a database from start up to end, not included; the bounds are evaluated there."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.filter((F.col(date_column) >= F.lit(start).cast("date")) & (F.col(date_column) < F.lit(end).cast("date")))
