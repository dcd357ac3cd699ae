"""Folders on storage that every executor sees, and sizes that decide about broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one
    if the executors run on this machine; elsewhere that is an error, as no other machine sees it."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    jsc = spark.sparkContext._jsc.sc()
    if not path and jsc.getCheckpointDir().isDefined():
        path = jsc.getCheckpointDir().get()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "gleanwork-checkpoints")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already; nothing is left to tell
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later readers neither compute it
    anew nor depend on the executors that made it. It goes with ``release``, or when the process ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing lazy depends on any more."""
    for df in tables:
        _remove(df.sparkSession, df.written_to)


def doc_key(*cols: str):
    """A non-null 64-bit key of a row's values."""
    return F.xxhash64(*[F.col(c) for c in cols])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while the table has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less its columns of these names in any case: an operator's own columns replace them."""
    made = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in made]
    return df.drop(*clash) if clash else df


def meet(rows: DataFrame, table: DataFrame, key: str, copies: str, hot: int, salts: int = 64) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for some keys and in ``copies`` (dropped) the number of rows of each.

    Where the table is small Spark broadcasts it. Beyond that, keys of ``hot`` rows or more are broadcast alone, at most
    rows / hot of them: their rows are dealt to ``salts`` tasks, and the table has a copy of theirs for each. Null keys meet nothing."""
    salt, frequent = free_name(rows, "_salt"), free_name(rows, "_hot")
    many = table.where(F.col(copies) >= hot).select(F.col(key).alias(frequent))
    rows = rows.join(F.broadcast(many), F.col(key) == F.col(frequent), "left")  # rows / hot keys at most
    dealt = F.when(F.col(frequent).isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    every = F.explode(F.when(F.col(copies) >= hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn(salt, dealt).drop(frequent).join(table.withColumn(salt, every).drop(copies), [key, salt], "left").drop(salt)
