"""Paths on any storage that the session's Hadoop configuration reaches."""

from __future__ import annotations

import atexit
import contextlib
import os
import socket
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    fs.setVerifyChecksum(False)  # the file may have been edited by hand
    stream = fs.open(p)
    try:
        data = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
    finally:
        stream.close()
    return bytes(data).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it, then renamed."""
    p, fs = _fs(spark, path)
    temporary, _ = _fs(spark, path + ".new")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(temporary, p):
        raise OSError(f"{path} can't be written")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one if the executors
    run on this machine; elsewhere that is an error, as no other machine sees it."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/") or "file://" + os.path.join(tempfile.gettempdir(), "gleanwork-checkpoints")


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again; it goes when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    forget_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_forget, spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session is gone already; nothing is left to tell
        pass


class Locked(RuntimeError):
    """Another process holds the lock."""


@contextlib.contextmanager
def lock(spark: SparkSession, path: str, lease: float = 24 * 3600.0):
    """Hold a lock on storage: a file that only one process can create. One older than ``lease`` seconds
    was left by a process that died and is taken over."""
    p, fs = _fs(spark, path)
    if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > lease:
        fs.delete(p, False)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        raise Locked(f"{path} is held by {(read_text(spark, path) or 'another process').strip()}") from e
    try:
        stream.write(bytearray(f"{socket.gethostname()} {os.getpid()}".encode()))
        stream.close()
        yield
    finally:
        fs.delete(p, False)
