"""Rows that fail to parse, apart from the valid ones and with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timestamps as T
from ..runtime import SENT_ROWS, cut, salted_lookup

#: Stands for the delimiter of a record's file while records of all files are read by one pattern, and what stands for
#: that character itself and for its stand-in (two characters, so that it can be put back).
MARK, ESCAPED = "\u0001", {"\u0002": "\u0002b", "\u0001": "\u0002a"}
_FIELD = f'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{MARK}]*+)'
_RECORD = rf"\A{_FIELD}(?:{MARK}{_FIELD})*+\z"


def structure(raw: Column, delim: Column, columns: int, wanted: dict[str, int]) -> dict[str, Column]:
    """What a raw record's structure says: ``fault`` (quoting, column_count or null) and the wanted fields (1-based).

    Quoting is right if every field either holds no quotation mark, or begins and ends with one and doubles each between;
    delimiters and line breaks may stand inside. The patterns are possessive: they read texts of any length without
    backtracking. A null record has no columns. Wanted fields are unquoted, and null where the structure is wrong.
    """
    escaped = raw
    for c, stand_in in ESCAPED.items():
        escaped = F.replace(escaped, F.lit(c), F.lit(stand_in))
    own = delim.isin(*ESCAPED)  # rare, and as it is: the stand-ins would hold it
    line = F.when(own, F.replace(raw, delim, F.lit(MARK))).otherwise(F.replace(escaped, delim, F.lit(MARK)))
    bare = F.regexp_replace(line, '"[^"]*+"', "")
    sound = F.when(raw.contains('"'), line.rlike(_RECORD)).otherwise(True)
    count = F.length(bare) - F.length(F.replace(bare, F.lit(MARK), F.lit(""))) + 1
    fault = F.when(raw.isNull(), "column_count").when(~sound, "quoting").when(count != columns, "column_count")
    out = {"fault": fault}
    for name, i in wanted.items():
        field = F.regexp_extract(line, rf"\A(?:{_FIELD}{MARK}){{{i - 1}}}({_FIELD})", 1)
        plain = F.when(field.startswith('"'), F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)
        back = F.replace(plain, F.lit(MARK), delim)
        for c, stand_in in reversed(ESCAPED.items()):
            back = F.when(own, back).otherwise(F.replace(back, F.lit(stand_in), F.lit(c)))
        out[name] = F.when(fault.isNull(), back)
    return out


def long_values(rows: DataFrame) -> DataFrame:
    """check (date or quantity) and value of the records of sound structure, missing values left out."""
    pairs = F.array(F.struct(F.lit("date").alias("check"), F.col("date").alias("value")), F.struct(F.lit("quantity").alias("check"), F.col("quantity").alias("value")))
    return rows.filter("fault is null").select(F.explode(pairs).alias("p")).select("p.*").filter(~T.is_missing(F.col("value")))


def invalid_values(values: DataFrame, zone: str) -> DataFrame:
    """The dictionary of invalid values: check, value, reason and how many rows hold it.

    ``values`` has the columns check (date or quantity) and value. Every distinct value is cast once; rows are counted
    before the shuffle, so a value that fills a third of all rows is one partial row per task.
    """
    distinct = values.groupBy("check", "value").agg(F.count("*").alias("n"))
    read = T.read_instants(distinct.withColumn("date", F.when(F.col("check") == "date", F.col("value"))), "date", "t", zone)
    bad_date = (F.col("check") == "date") & (F.col("t_state") == T.INVALID)
    bad_quantity = (F.col("check") == "quantity") & ~T.is_quantity(F.col("value"))
    return read.filter(bad_date | bad_quantity).select("check", "value", F.when(F.col("check") == "date", "bad_date").otherwise("bad_quantity").alias("reason"), "n")


def judged_rows(rows: DataFrame, zone: str, sent_rows: int = SENT_ROWS) -> DataFrame:
    """All records with a ``reason``: the first that applies of quoting, column_count, bad_date, bad_quantity; null if they are usable.

    ``rows``: src_table, rec_id, fault (from ``structure``, null if sound or not raw), date, quantity. Each distinct
    value is cast once, into a dictionary of the invalid ones, which is joined back to the rows: from a copy on each
    executor if it has at most ``sent_rows`` entries, else by a lookup that spreads frequent values over tasks. Null, the empty string
    and NA are missing, never faults. Repeated rows come out repeatedly; of several faults the first counts.
    """
    bad = cut(invalid_values(long_values(rows), zone))
    parts = {check: bad.filter(F.col("check") == check).select(F.col("value").alias(check), F.col("reason").alias(f"{check}_reason"), "n") for check in ("date", "quantity")}
    small = bad.count() <= sent_rows
    for check, part in parts.items():
        rows = rows.join(F.broadcast(part.drop("n")), check, "left") if small else salted_lookup(rows, part, check, F.col("rec_id"), "n")
    reason = F.coalesce("fault", "date_reason", "quantity_reason")
    return rows.select("src_table", "rec_id", "date", "quantity", reason.alias("reason"))
