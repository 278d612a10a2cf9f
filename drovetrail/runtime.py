"""What operators share about running on a cluster: checkpoints and skew-proof lookups."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of one key that a lookup gives to a task; keys with more are spread over several.
ROWS_PER_TASK = 1 << 19
#: Most keys that can count as frequent, whatever the number of rows: it bounds the table of them that is broadcast.
HOT_KEYS = 100_000
#: Most rows of a table that is sent to every executor; larger ones take the other way, a shuffle.
SENT_ROWS = 1 << 17


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a session without one (tests, local runs) gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="drovetrail-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager)
    # The optimizer's guess of the size stays with a checkpoint, and that of a join is a product: over the rounds of a loop it
    # would become a number of millions of digits, which take longer to multiply than the rounds. Beyond any size it is dropped.
    if kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 2**62:
        jvm = kept.sparkSession._jsparkSession
        kept = DataFrame(jvm.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), kept.sparkSession)
    return kept


def fresh(name: str) -> str:
    """A column name that no input column can clash with."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def salted_lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    row_id: Column,
    weight: str,
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join rows to a table that is unique by key, without one task getting all rows of a frequent key.

    ``weight`` is a column of the table that counts the probing rows of the key. A key with more than ``rows_per_task`` of
    them gets as many salts as it takes, without limit; only the list of those keys is broadcast. It has at most HOT_KEYS
    entries: where rows are so many that it could have more, tasks get more rows instead. All other keys go through one
    ordinary shuffle join on (key, 0). Null keys of rows match nothing and are spread evenly. The weight column is dropped
    from the result.
    """
    total = table.agg(F.sum(weight).alias("n")).first()["n"] or 0
    most = max(rows_per_task, math.ceil(total / HOT_KEYS))
    salt, salts = fresh("salt"), fresh("salts")
    n_salts = F.ceil(F.col(weight) / F.lit(most)).cast("int")
    hot = table.filter(F.col(weight) > F.lit(most)).select(key, n_salts.alias(salts))
    spread = F.pmod(F.xxhash64(row_id), F.coalesce(F.col(salts), F.lit(1))).cast("int")
    probe = rows.join(F.broadcast(hot), key, "left").withColumn(
        salt, F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(row_id), F.lit(2**30)).cast("int")).otherwise(spread)
    ).drop(salts)
    many = F.when(F.col(weight) > F.lit(most), n_salts).otherwise(F.lit(1))
    build = table.withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1))).drop(weight)
    return probe.join(build, [key, salt], how).drop(salt)


def rounds_needed(pieces: int, fan_in: int) -> int:
    """Rounds of combining fan_in states into one until a single one is left."""
    rounds, left = 1, max(pieces, 1)
    while left > fan_in:
        rounds, left = rounds + 1, math.ceil(left / fan_in)
    return rounds


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that is read more than once."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a compressed table, by default in the shared folder, and go on from there: columns can be read apart."""
    path = path or shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
