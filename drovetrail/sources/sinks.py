"""Sinks: GeoJSON features, delimited files, Parquet, small HTML tables."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geojson(df: DataFrame, line: str, properties: list[str]) -> DataFrame:
    """feature: one GeoJSON feature (a line string) as text for each row; written as text it is newline-delimited GeoJSON."""
    points = F.transform(line, lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), points.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_geojson(df: DataFrame, path: str, line: str, properties: list[str]) -> None:
    geojson(df, line, properties).write.mode("overwrite").text(path)


def write_feature_collection(df: DataFrame, path: str, line: str, properties: list[str]) -> int:
    """One GeoJSON file with a FeatureCollection, for maps; how many features it has. Rows pass through the driver one by one."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for row in geojson(df, line, properties).toLocalIterator():
            f.write(("," if n else "") + "\n" + row["feature"])
            n += 1
        f.write("\n]}\n")
    return n


def write_delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").options(header=True, sep=separator, nullValue="NA").csv(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def html_table(df: DataFrame, title: str, rows: int = 1000) -> str:
    """A report table for people; at most ``rows`` rows are shown, and it says so if there are more."""
    got = df.limit(rows + 1).collect()
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in got[:rows])
    more = f"<p>The first {rows} rows.</p>" if len(got) > rows else ""
    return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>{more}"


def report(tables: dict[str, DataFrame], path: str, title: str, rows: int = 1000) -> str:
    """A report: every table whole as Parquet in a folder, and a page that shows their first rows; the page's path."""
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    parts = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(str(folder / name))
        parts.append(html_table(df.sparkSession.read.parquet(str(folder / name)), name, rows))
    page = folder / "report.html"
    page.write_text(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(parts)}", encoding="utf-8")
    return str(page)
