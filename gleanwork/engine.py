"""The engine: profiles, indexing and search.

A run brings an index up to its root's present state in commits of some hundred files, each a segment
(see ``segments.py``): between them it can be paused or cancelled, and what was committed stays.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork import catalog, schemas
from gleanwork.control import Progress, RunControl
from gleanwork.functions import text as T
from gleanwork.operators import highlight, index, manifest
from gleanwork.plans import planner
from gleanwork.plans.query import Query, Scope, parse
from gleanwork.profiles import Profile, ProfileStore, evaluate_status
from gleanwork.segments import IndexTable, files_of
from gleanwork.sources import extract as ex
from gleanwork.sources import scan as sc
from gleanwork.sources import storage
from gleanwork.sources.extract.router import NAME_ONLY_REASON, UNKNOWN_TYPE

#: Files of a commit; where a run has more commits than this, each takes more files, up to as many as can be opened by name.
COMMIT_EVERY, FEW_COMMITS = manifest.COMMIT_EVERY, 64


@dataclass(frozen=True)
class IndexingSummary:
    added: int
    updated: int
    removed: int
    unchanged: int
    failed: int
    final_count: int


@dataclass(frozen=True)
class SearchResult:
    """A page of rows, and the number of all hits before the page was cut."""

    df: DataFrame
    total_hits: int


class Engine:
    def __init__(self, spark: SparkSession, home: str, router: ex.Router | None = None):
        self.spark, self.router = spark, router or ex.Router()
        self.profiles = ProfileStore(spark, f"{home.rstrip('/')}/registry.json")
        self._running: set[str] = set()
        self._searches, self._tag = 0, f"search-{id(self)}"

    # ------------------------------------------------------------ profiles

    def create_profile(self, *args, **more) -> Profile:
        profile = Profile.create(*args, **more)
        self.profiles.save(profile)
        return profile

    def all_profiles(self) -> list[Profile]:
        """Profiles with fresh counts and status; places without one are unregistered."""
        found, gone = self.profiles.load_all()
        for path in gone:
            self.profiles.unregister(path)
        for p in found:
            table = IndexTable(self.spark, p.storage_path)
            row = manifest.stats(table.read("manifest")).first()
            p.file_count, p.total_size_bytes = row.n_records, row.total_size
            p.status = evaluate_status(storage.exists(self.spark, p.root_path), table.exists(), p.file_count)
        return found

    # ------------------------------------------------------------ indexing

    def index(self, profile: Profile, rebuild: bool = False, control: RunControl | None = None, on_progress: Callable[[Progress], None] | None = None) -> IndexingSummary:
        """Bring the index up to the root's present state.

        A rebuild reads every file again and is one commit. While one process indexes, others that try
        get ``storage.Locked``. Rows below directories that can't be read stay; a root
        that can't be reached leaves the index as it is and raises SourceUnavailable."""
        if profile.id in self._running:
            raise RuntimeError(f"{profile.name} is being indexed")
        self._running.add(profile.id)
        try:
            with IndexTable(self.spark, profile.storage_path).lock():
                return self._index(profile, rebuild, control or RunControl(), on_progress or (lambda _: None))
        finally:
            self._running.discard(profile.id)

    def _index(self, profile: Profile, rebuild: bool, control: RunControl, on_progress) -> IndexingSummary:
        began = time.monotonic()
        table = IndexTable(self.spark, profile.storage_path)
        incremental = profile.incremental_enabled and not rebuild
        control.checkpoint()
        files, closed, failed = sc.scan(self.spark, profile.root_path, profile.included_extensions)
        files = files.withColumn("path", T.normalize_path("path")).persist()
        old_files = table.read("manifest")
        if rebuild:
            old_files = old_files.limit(0)
        changes = manifest.diff(files, old_files, incremental=incremental)
        hidden = F.lit(False)
        for d in [*(c.rstrip("/") + "/" for c in closed), *failed]:
            hidden = hidden | F.col("path").startswith(d)
        if not incremental:  # rows that a full pass doesn't meet stay, as it reports nothing removed
            hidden = F.lit(True)
        changes = changes.where((F.col("status") != schemas.REMOVED) | ~hidden).persist()
        counts = {r.status: r.n for r in changes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        progress = Progress(total=sum(counts.values()) - counts.get(schemas.REMOVED, 0), unchanged=counts.get(schemas.UNCHANGED, 0), removed=counts.get(schemas.REMOVED, 0), failed=len(failed))
        progress.scanned = progress.unchanged
        on_progress(progress)
        control.checkpoint()

        todo = files.join(changes.where(F.col("status").isin(schemas.ADDED, schemas.UPDATED)).select("path", "status"), "path")
        known, name_only = catalog.category(F.col("extension")).isNotNull() | F.col("extension").isin([*self.router.readers]), F.coalesce(catalog.strategy_of(F.col("extension")) == catalog.NAME_ONLY, F.lit(False))
        todo = todo.withColumn("gate", manifest.gate(known, name_only, F.col("size_bytes"), profile.max_content_bytes)).persist()
        n_todo = counts.get(schemas.ADDED, 0) + counts.get(schemas.UPDATED, 0)
        size = max(COMMIT_EVERY, min(sc.BY_NAME // 2, -(-n_todo // FEW_COMMITS)))  # few enough to be opened by name
        parts = 1 if rebuild else max(1, -(-n_todo // size))
        own = F.lit(profile.id).alias("profile_id")
        removed = changes.where(F.col("status") == schemas.REMOVED).select(own, "path")
        for i in range(parts):
            control.checkpoint()
            part = todo.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == i).persist()
            if n_todo or counts.get(schemas.REMOVED) or not table.exists() or rebuild:
                fresh = self._read(profile, part)
                gone = part.where(F.col("status") == schemas.UPDATED).select(own, "path")
                table.commit(fresh, files_of(fresh), removed.unionByName(gone) if i == 0 else gone, everything=rebuild)
            done = part.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size")).first()
            part.unpersist()
            progress.indexed, progress.bytes_indexed = progress.indexed + done.n, progress.bytes_indexed + done.size
            progress.scanned = progress.unchanged + progress.indexed
            progress.seconds = time.monotonic() - began - control.total_paused()
            on_progress(progress)
        final = table.count()
        for df in (files, changes, todo):
            df.unpersist()
        stats = manifest.stats(table.read("manifest")).first()
        profile.file_count, profile.total_size_bytes, profile.status = stats.n_records, stats.total_size, "Ok"
        profile.last_updated_at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        self.profiles.save(profile)
        n = lambda s: counts.get(s, 0)
        return IndexingSummary(n(schemas.ADDED), n(schemas.UPDATED), n(schemas.REMOVED), n(schemas.UNCHANGED), len(failed), final)

    def _read(self, profile: Profile, todo: DataFrame) -> DataFrame:
        """The documents of some files; those that aren't or can't be read have a reason in place of their text."""
        read = sc.contents(self.spark, profile.root_path, todo.where("gate = 'extract'"), profile.max_content_bytes)
        got = ex.extract(read, self.router)
        limit = profile.max_content_bytes // 2**20
        reason = F.when(F.col("gate") == "unknown_type", UNKNOWN_TYPE).when(F.col("gate") == "name_only", NAME_ONLY_REASON).when(F.col("gate") == "too_large", f"文件超过 {limit} MB 上限").otherwise(F.coalesce("failure_reason", F.when(F.col("success").isNull(), F.lit("文件无法读取"))))
        done = F.coalesce("success", F.lit(False))
        new = todo.join(got, "path", "left").select("path", "extension", "size_bytes", "last_write_time", F.when(done, F.col("content")).otherwise("").alias("content"), done.alias("content_indexed"), F.when(~done, reason).alias("skip_reason"))
        return index.map_documents(new, profile.id)

    # ------------------------------------------------------------ search

    def search(self, raw: str | None, scope: Scope = Scope.BOTH, profile_ids: list[str] | None = None, k: int = planner.TOP, highlights: bool = True, category: str | None = None, filter_before_limit: bool = False, norm: str = "lucene") -> SearchResult:
        """The k best documents of the chosen profiles (all where none is named) with marked names and
        fragments. A category filters the page, not the number of hits, unless asked to come first.
        A new search ends the jobs of the engine's last one."""
        self.spark.interruptTag(self._tag)
        self._searches += 1
        self._tag = f"search-{id(self)}-{self._searches}"
        self.spark.addTag(self._tag)
        try:
            return self._search(raw, scope, profile_ids, k, highlights, category, filter_before_limit, norm)
        finally:
            self.spark.removeTag(self._tag)

    def _search(self, raw, scope, profile_ids, k, highlights, category, filter_before_limit, norm) -> SearchResult:
        found, _ = self.profiles.load_all()
        chosen = [p for p in found if not profile_ids or p.id in profile_ids]
        tables = [t for p in chosen if (t := IndexTable(self.spark, p.storage_path)).exists()]
        query = parse(raw, scope)
        if query is None or not tables:
            return SearchResult(self.spark.createDataFrame([], schemas.RESULT), 0)
        docs, postings, terms = (_union([t.read(name) for t in tables]) for name in ("docs", "postings", "terms"))
        return search(query, docs, postings, k, highlights, category, filter_before_limit, norm, terms)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def search(query: Query, docs: DataFrame, postings: DataFrame, k: int = planner.TOP, highlights: bool = True, category: str | None = None, filter_before_limit: bool = False, norm: str = "lucene", terms: DataFrame | None = None) -> SearchResult:
    """Search over tables. Stored columns are joined and marked for the k best only."""
    plan = planner.Plan(query, docs, postings, norm, terms)
    hits = plan.matches().persist()
    total = hits.count()
    wanted = None if category in (None, "all") else catalog.category(T.extension("path")) == category
    if wanted is not None and filter_before_limit:
        hits = hits.where(wanted)
    best = planner.top(hits, k)
    if wanted is not None and not filter_before_limit:
        best = best.where(wanted)
    rows = best.collect()  # k at most; the hits needn't be kept any longer
    hits.unpersist()
    best = docs.sparkSession.createDataFrame(rows, best.schema)
    page = docs.join(F.broadcast(best), list(planner.KEYS))
    marks = ("file_name_highlight", "content_highlight")
    page = highlight.with_highlights(page, query) if highlights else page.withColumns({c: F.lit(None).cast("string") for c in marks})
    columns = [c.split()[0] for c in schemas.RESULT.split(", ")]
    return SearchResult(page.select(*columns).orderBy(F.desc("score"), *planner.KEYS), total)
