"""An index's tables on storage: segments that are written once, and a file that names the live ones.

A commit writes the new documents, their postings and manifest rows as a segment, and the keys that they
replace or remove as its tombstones; then it moves CURRENT. It costs what it writes, whatever the index
holds, and a crash leaves the old state. A tombstone hides a key's rows in older segments only. Segments
of like size are merged when there are ``FANOUT`` of them, so a row is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork import schemas
from gleanwork.operators import index, manifest
from gleanwork.sources import storage

#: Segments of like size that are merged into one, and the share of hidden rows from which all are.
FANOUT, HIDDEN = 8, 0.5
#: Commits for which merged segments stay for readers of older states.
KEPT = 2
TABLES = {"docs": schemas.DOCS, "postings": schemas.POSTINGS, "manifest": schemas.MANIFEST, "terms": schemas.TERMS}
GONE = "profile_id string, path string"


class IndexTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ state

    def _state(self) -> dict | None:
        raw = storage.read_text(self.spark, f"{self.path}/CURRENT")
        return json.loads(raw) if raw and raw.strip() else None

    def current(self) -> int | None:
        """Number of the last commit."""
        state = self._state()
        return state["n"] if state else None

    def exists(self) -> bool:
        return self._state() is not None

    def segments(self) -> list[dict]:
        return (self._state() or {"segments": []})["segments"]

    def lock(self):
        """Held while a process writes; see ``storage.lock``."""
        return storage.lock(self.spark, f"{self.path}/LOCK")

    # ------------------------------------------------------------ reading

    def read(self, table: str) -> DataFrame:
        """The live rows of a table; none before the first commit. ``terms`` may have some of hidden rows too."""
        return self._live(table, self.segments())

    def _live(self, table: str, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], TABLES[table])
        rows = self._files(table, TABLES[table], segments)
        if table == "terms" or not any(s["gone"] for s in segments[1:]):
            return rows
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/segments/(\d+)/", 1).cast("long")
        names = rows.columns
        rows = rows.withColumn("_segment", number)
        by = [c for c in ("profile_id", "path") if c in names]
        gone = self._files("gone", GONE, [s for s in segments if s["gone"]]).withColumn("_gone", number).groupBy(*by).agg(F.max("_gone").alias("_gone"))
        gone = gone.select(*[F.col(c).alias(f"_{c}") for c in by], "_gone")
        same = F.col("_segment") < F.col("_gone")
        for c in by:
            same = same & (F.col(c) == F.col(f"_{c}"))
        return rows.join(gone, same, "left_anti").select(*names)

    def _files(self, table: str, schema: str, segments: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/segments/{s['id']}/{table}" for s in segments])

    def count(self) -> int:
        return self.read("docs").count()

    # ------------------------------------------------------------ writing

    def commit(self, docs: DataFrame, files: DataFrame, gone: DataFrame | None = None, everything: bool = False) -> int:
        """Add documents and manifest rows of keys that no live row has once those of ``gone`` (profile_id,
        path) are hidden; ``everything`` hides all that there was. Returns the commit's number."""
        state = self._state() or {"n": 0, "segments": [], "trash": []}
        n = state["n"] + 1
        if everything:
            state["trash"] += [[s["id"], n] for s in state["segments"]]
            state["segments"] = []
        gone = self.spark.createDataFrame([], GONE) if gone is None or not state["segments"] else gone.select("profile_id", "path").distinct()
        state["segments"].append(self._write(n, docs, files, gone))
        tail = self._to_merge(state["segments"])
        if len(tail) > 1:
            n += 1
            first = len(tail) == len(state["segments"])
            older = self.spark.createDataFrame([], GONE) if first else self._files("gone", GONE, tail).distinct()
            merged = self._write(n, self._live("docs", tail), self._live("manifest", tail), older)
            state["trash"] += [[s["id"], n] for s in tail]
            state["segments"] = [*state["segments"][: -len(tail)], merged]
        for number, since in state["trash"]:
            if n - since >= KEPT:
                storage.delete(self.spark, f"{self.path}/segments/{number}")
        state["trash"] = [x for x in state["trash"] if n - x[1] < KEPT]
        storage.write_text(self.spark, f"{self.path}/CURRENT", json.dumps(state | {"n": n}))
        return n

    def _write(self, number: int, docs: DataFrame, files: DataFrame, gone: DataFrame) -> dict:
        """One segment. Postings are sorted by term, so that a search reads few row groups."""
        to = f"{self.path}/segments/{number}"
        docs.write.mode("overwrite").parquet(f"{to}/docs")
        files.write.mode("overwrite").parquet(f"{to}/manifest")
        gone.write.mode("overwrite").parquet(f"{to}/gone")
        stored = self.spark.read.schema(schemas.DOCS).parquet(f"{to}/docs")
        index.postings(stored).repartitionByRange("field", "term", "path").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{to}/postings")
        terms = self.spark.read.schema(schemas.POSTINGS).parquet(f"{to}/postings").select("field", "term").distinct()
        terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{to}/terms")
        return {"id": number, "rows": stored.count(), "gone": self.spark.read.schema(GONE).parquet(f"{to}/gone").count()}

    @staticmethod
    def _to_merge(segments: list[dict]) -> list[dict]:
        """The newest segments, as many as are of like size; all where much is hidden."""
        size = lambda s: s["rows"] + s["gone"] + 1
        if sum(s["gone"] for s in segments) > HIDDEN * sum(s["rows"] for s in segments) and len(segments) > 1 and segments[0]["rows"] < FANOUT * sum(s["gone"] for s in segments):
            return segments
        at, total = len(segments) - 1, size(segments[-1])
        while at and size(segments[at - 1]) <= total * FANOUT / 2:
            at -= 1
            total += size(segments[at])
        return segments[at:] if len(segments) - at >= FANOUT else []

    def upsert(self, new: DataFrame) -> int:
        """Documents in place of those of equal key; of a key that ``new`` holds several times the latest file."""
        new = manifest.latest(new, ("profile_id", "path"), "last_write_time")
        return self.commit(new, files_of(new), new)

    def append(self, new: DataFrame) -> int:
        return self.commit(new, files_of(new))

    def delete(self, gone: DataFrame) -> int:
        """Remove the documents of some paths."""
        keys = self.read("docs").select("profile_id", "path").join(gone.select("path").distinct(), "path", "left_semi")
        return self.commit(self.spark.createDataFrame([], schemas.DOCS), self.spark.createDataFrame([], schemas.MANIFEST), keys)

    def truncate(self) -> int:
        return self.commit(self.spark.createDataFrame([], schemas.DOCS), self.spark.createDataFrame([], schemas.MANIFEST), everything=True)


def files_of(docs: DataFrame) -> DataFrame:
    """Manifest rows of documents, whether or not their text could be read."""
    return docs.select("path", "size_bytes", "last_write_time", F.current_timestamp().alias("indexed_at"), "content_indexed")
