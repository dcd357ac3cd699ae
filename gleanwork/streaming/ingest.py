"""Micro-batch ingestion: an append-only way to bring new observations or files into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.control import RunControl
from gleanwork.functions import text as T
from gleanwork.operators import index, manifest
from gleanwork.sources.extract import Router, extract
from gleanwork.sources.storage import delete, exists, forget_at_exit, shared_dir

#: Files of one micro-batch: a commit each.
FILES_PER_BATCH = 500


def stream_table(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """A stream of the rows of a Parquet file or folder, file by file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # a stream reads folders: a single file is the folder's files of that name
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def upsert_stream(stream: DataFrame, target: str, key: str, order: tuple[str, ...]):
    """Keep in ``target`` the latest row of each key. Every micro-batch writes a new version beside the
    old one and names it by its batch, so a batch that runs again replaces its own output only.
    Returns the finished query; read the table with :func:`read_version`."""
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        old = f"{target}/v{number - 1}"
        rows = batch if not number or not exists(spark, old) else spark.read.parquet(old).unionByName(batch)
        manifest.latest(rows, key, *order).write.mode("overwrite").parquet(f"{target}/v{number}")
        delete(spark, f"{target}/v{number - 2}")  # the last one stays, should this batch run again

    run = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def read_version(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of a table that :func:`upsert_stream` keeps."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(target)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    newest = max(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return spark.read.parquet(f"{target}/v{newest}")


def latest_stream(spark: SparkSession, path: str, key: str, order: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """The latest row of each key, read as a stream to its present end."""
    target = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    forget_at_exit(spark, target)
    upsert_stream(stream_table(spark, path).select(*columns), target, key, order)
    return read_version(spark, target).select(*columns)


def stream_files(spark: SparkSession, root: str, extensions: list[str], files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New files below a root as a stream (path, extension, size_bytes, last_write_time, content).

    It sees files that appear; changed and removed ones are found by the snapshot difference."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    read = read.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    ext = T.extension("path")
    return read.where(ext.isin([e.lstrip(".").lower() for e in extensions])).select("path", ext.alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_write_time"), "content")


def ingest_stream(files: DataFrame, table, profile_id: str, router: Router, checkpoint: str, control: RunControl | None = None):
    """Extract and index a stream's files, a segment for each micro-batch; pausing and cancelling take
    effect between batches. A batch that runs again replaces its own rows. Returns the finished query."""

    def one(batch: DataFrame, number: int) -> None:
        if control:
            control.checkpoint()
        got = extract(batch, router).withColumnRenamed("content", "text")
        rows = batch.drop("content").join(got, "path").select(
            "path", "extension", "size_bytes", "last_write_time", F.coalesce("text", F.lit("")).alias("content"), F.col("success").alias("content_indexed"), F.col("failure_reason").alias("skip_reason")
        )
        table.upsert(index.map_documents(rows, profile_id))

    with table.lock():
        run = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    return run
