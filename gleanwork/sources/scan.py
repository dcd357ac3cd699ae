"""Scans of a directory tree: metadata first, contents only of the files that changed."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions import text as T
from gleanwork.sources.storage import exists, stored

SCAN = "path string, extension string, size_bytes long, last_write_time timestamp"
#: Directories that wait when the rest of a walk is dealt to tasks.
DEALT = 256
#: Up to so many changed files are opened by name; beyond, the tree is read and joined to them.
BY_NAME = 10_000


class SourceUnavailable(Exception):
    """The root can't be reached; nothing may be concluded about its files."""


def _local(root: str) -> str | None:
    """The root as a local path, or None where it lies elsewhere."""
    if root.startswith("file:"):
        return "/" + root.removeprefix("file:").lstrip("/")
    return root if "://" not in root else None


def walk(root: str, extensions: Iterable[str], most: int | None = None) -> tuple[list[tuple], list[str], list[str], list[str]]:
    """Files of a local tree (path, extension, size, mtime), directories that can't be read, files that
    vanished meanwhile, and directories left to others once ``most`` wait. An unreadable directory
    doesn't stop its siblings."""
    wanted = {e.lstrip(".").lower() for e in extensions}
    files, closed, failed, todo = [], [], [], deque([root])
    while todo and (most is None or len(todo) < most):
        here = todo.popleft()
        try:
            with os.scandir(here) as entries:
                found = list(entries)
        except OSError:
            closed.append(here)
            continue
        for e in found:
            try:
                if e.is_dir(follow_symlinks=False):
                    todo.append(e.path)
                    continue
                ext = os.path.splitext(e.name)[1].lstrip(".").lower()
                if ext in wanted:
                    s = e.stat()
                    files.append((e.path, ext, s.st_size, datetime.fromtimestamp(int(s.st_mtime * 1000) / 1000, timezone.utc)))
            except OSError:
                failed.append(e.path)
    return files, closed, failed, list(todo)


def _walk_each(extensions: list[str]):
    """Walks of the directories that a task is given: a row per file, closed directory and vanished file."""

    def run(batches):
        for batch in batches:
            for here in batch.column("path").to_pylist():
                files, closed, failed, _ = walk(here, extensions)
                rows = [("file", *f) for f in files] + [(kind, path, None, None, None) for kind, paths in (("closed", closed), ("failed", failed)) for path in paths]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["kind", "path", "extension", "size_bytes", "last_write_time"])

    return run


def scan(spark: SparkSession, root: str, extensions: Iterable[str]) -> tuple[DataFrame, list[str], list[str]]:
    """(files, closed directories, vanished files).

    A local tree (one that all machines mount, on a cluster) is walked by the driver until DEALT directories wait; those
    are dealt to tasks. Either survives what can't be read. Other storage is listed
    by Spark, in parallel for large trees, and filtered by extension; no content is read."""
    extensions = list(extensions)
    path = _local(root)
    if path is not None:
        if not os.path.isdir(path):
            raise SourceUnavailable(root)
        files, closed, failed, rest = walk(path, extensions, DEALT)
        found = spark.createDataFrame(files, SCAN)
        if rest:
            dealt = spark.createDataFrame([(d,) for d in rest], "path string").repartition(len(rest), "path")
            rows = stored(dealt.mapInArrow(_walk_each(extensions), f"kind string, {SCAN}"), "scan")
            found = found.unionByName(rows.where("kind = 'file'").drop("kind"))
            odd = rows.where("kind <> 'file'").select("kind", "path").collect()
            closed, failed = closed + [r.path for r in odd if r.kind == "closed"], failed + [r.path for r in odd if r.kind == "failed"]
        return found, closed, failed
    if not exists(spark, root):
        raise SourceUnavailable(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    files = found.select("path", T.extension("path").alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_write_time"))
    return files.where(F.col("extension").isin([e.lstrip(".").lower() for e in extensions])), [], []


def contents(spark: SparkSession, root: str, changed: DataFrame, max_bytes: int) -> DataFrame:
    """(path, extension, content) of the changed files (path, extension) that are not too large."""
    few = [r.path for r in changed.select("path").limit(BY_NAME + 1).collect()]
    local = _local(root) is not None
    name = F.regexp_replace("path", "^file:/+", "/") if local else F.col("path")
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    if not few:
        return spark.createDataFrame([], "path string, extension string, content binary")
    if len(few) <= BY_NAME:
        read = reader.load([_escaped(("file://" if local else "") + p) for p in few])
    else:
        read = reader.option("recursiveFileLookup", "true").load(root)
    read = read.where(F.col("length") <= max_bytes).select(name.alias("path"), "content")
    return read.join(changed.select("path", "extension"), "path")


def _escaped(path: str) -> str:
    """A path that is not taken for a pattern."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)
