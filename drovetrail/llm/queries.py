"""The pN_ queries of the text problems over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks, spans, tokens


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/eval_items.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_documents(spark, d), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents and tokens there are, and of how many documents the decoded ids aren't the text."""
    docs = _documents(spark, d)
    encoded = tokens.encode_corpus(docs, "doc_id", "text")
    back = tokens.decode_corpus(encoded, "doc_id", "ids").select("doc_id", F.xxhash64("text").alias("got"))
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("had"))
    return back.join(texts, "doc_id", "full").agg(F.count("*").alias("n_docs"), F.count_if(~F.col("got").eqNullSafe(F.col("had"))).alias("n_wrong"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that come back from the ids."""
    return tokens.decode_corpus(p7_ids(spark, d), "doc_id", "ids")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return leaks.build_index(_documents(spark, d), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_index(spark, d), _items(spark, d), "item_id", "passage")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leaks.near_items(_index(spark, d), _items(spark, d), "item_id", "passage")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents per item with an exact run and with its rare words near each other, by two searches of one index."""
    index, items = _index(spark, d), _items(spark, d)
    exact = leaks.leaked_items(index, items, "item_id", "passage").select("item_id", F.lit(1).alias("exact"), F.lit(0).alias("near"))
    near = leaks.near_items(index, items, "item_id", "passage").select("item_id", F.lit(0).alias("exact"), F.lit(1).alias("near"))
    return exact.unionAll(near).groupBy("item_id").agg(F.sum("exact").alias("docs_exact"), F.sum("near").alias("docs_near"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.covered_words(spans.shared_runs(_documents(spark, d), "doc_id", "text"), "shared_words")


def p9_removable(spark: SparkSession, d: str) -> DataFrame:
    """Words that removing all but the first occurrence of shared runs would take from each document."""
    return spans.covered_words(spans.shared_runs(_documents(spark, d), "doc_id", "text", later_only=True), "repeated_words")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The texts without the sentences that a lower document has as part of a shared run."""
    return spans.without_repeats(_documents(spark, d), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p7_ids, p7_roundtrip, p7_decoded, p8_found, p8_near, p8_report, p9_found, p9_removable, p9_clean)}

_WINDOWS = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 62)) AS i, ws FROM w WHERE len(ws) >= 64),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 63], ' ')) AS h FROM g)"""

ORACLE: dict[str, str] = {
    "p7_roundtrip": "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_wrong FROM documents",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"""{_WINDOWS}, s AS (SELECT h FROM k GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 64)) AS word FROM k WHERE h IN (SELECT h FROM s))
SELECT doc_id, count(*) AS shared_words FROM c GROUP BY doc_id""",
    "p9_removable": f"""{_WINDOWS}, s AS (SELECT h, min(doc_id) AS lowest FROM k GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 64)) AS word FROM k JOIN s USING (h) WHERE doc_id > lowest)
SELECT doc_id, count(*) AS repeated_words FROM c GROUP BY doc_id""",
}
