"""Streaming windows agree with the batch result of the same rows."""

from drovetrail.streaming import windows
from pyspark.sql import functions as F


def test_stream_of_files(spark, tmp_path):
    rows = spark.range(2000).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 1800).alias("ts"), (F.col("id") % 37).cast("string").alias("user"), F.lit(1.0).alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), rows.schema)
    windows.once(windows.activity(stream, "ts", "user", 7, late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    windows.once(windows.daily_totals(stream, "ts", "user", "value", late="0 seconds"), str(tmp_path / "days"), str(tmp_path / "cp2"))
    batch = {r["w"]["start"]: r["n"] for r in rows.groupBy(F.window("ts", "7 days").alias("w")).agg(F.count("*").alias("n")).collect()}
    out = spark.read.schema("start timestamp, end timestamp, events bigint, active bigint").parquet(str(tmp_path / "out")).collect()
    assert all(batch[r["start"]] == r["events"] and abs(r["active"] - 37) <= 2 for r in out)
    assert spark.read.schema("user string, day date, total double").parquet(str(tmp_path / "days")).count() >= 0
