"""The manifest of indexed files: difference to a scan, upsert, removal, statistics, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.schemas import ADDED, FAILED, REMOVED, UNCHANGED, UPDATED
from gleanwork.sources.storage import stored

COMMIT_EVERY = 500


def diff(current: DataFrame, previous: DataFrame, key: str = "path", same: tuple[str, ...] = ("size_bytes", "last_write_time"), incremental: bool = True) -> DataFrame:
    """(key, status) of each file of the scan and, if incremental, of the manifest.

    One full outer equi-join finds added, updated, unchanged and removed files. Without
    ``incremental`` known files are updated and none is removed."""
    cur = current.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in same], F.lit(True).alias("_here"))
    old = previous.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in same], F.lit(True).alias("_there"))
    both = cur.join(old, key, "full_outer" if incremental else "left")
    equal = F.lit(incremental)
    for c in same:
        equal = equal & F.col(f"_new_{c}").eqNullSafe(F.col(f"_old_{c}"))
    status = F.when(F.col("_there").isNull(), ADDED).when(F.col("_here").isNull(), REMOVED).when(equal, UNCHANGED).otherwise(UPDATED)
    return both.select(key, status.alias("status"))


def latest(rows: DataFrame, key: str | tuple[str, ...], *order: str) -> DataFrame:
    """Of each key the row with the greatest ``order`` columns, and of those the greatest in the rest, by one
    aggregation that combines before the shuffle; no window sorts a key's rows."""
    keys = (key,) if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys and c not in order]
    if not rest and not order:
        return rows.distinct()
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upsert(table: DataFrame, changes: DataFrame, key: str = "path", order: tuple[str, ...] = ()) -> DataFrame:
    """The table with the rows of ``changes`` in place of those of equal key. Of a key that
    ``changes`` holds several times the row with the greatest ``order`` wins."""
    return delete(table, changes, key).unionByName(latest(changes.select(*table.columns), key, *order))


def delete(table: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def removed(previous: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    return previous.join(current.select(key), key, "left_anti")


def stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"))


def summary(changes: DataFrame) -> DataFrame:
    """One row: counts by status, and the documents that stay."""
    n = lambda s: F.count_if(F.col("status") == s)
    return changes.agg(
        n(ADDED).alias("added"), n(UPDATED).alias("updated"), n(REMOVED).alias("removed"), n(UNCHANGED).alias("unchanged"), n(FAILED).alias("failed"),
        F.count_if(~F.col("status").isin(REMOVED, FAILED)).alias("final_count"),
    )


def _ranged(rows: DataFrame, order: str) -> DataFrame:
    """The rows with ``_b``, the number of the range of ``order`` that each lies in. Ranges come from
    sampled quantiles, so keys may be of any type that sorts and lie however they like; they are
    written once, so that later passes see the same ones."""
    return stored(rows.repartitionByRange(order).withColumn("_b", F.spark_partition_id()), "ranges")


def progress(changes: DataFrame, order: str) -> DataFrame:
    """Running counters in ``order``: scanned, unchanged, removed.

    Rows are counted by range of ``order`` first, so that each range's running counts are made by
    its own task from the sums before it; no task sees all rows."""
    flags = {"scanned": F.col("status") != REMOVED, "unchanged_so_far": F.col("status") == UNCHANGED, "removed_so_far": F.col("status") == REMOVED}
    rows = _ranged(changes.select(order, "status"), order)
    ints = {k: v.cast("long") for k, v in flags.items()}
    sums = rows.groupBy("_b").agg(*[F.sum(v).alias(f"_s_{k}") for k, v in ints.items()])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = sums.select("_b", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_p_{k}") for k in ints])
    own = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(F.broadcast(sums), "_b").select(order, "status", *[(F.sum(v).over(own) + F.col(f"_p_{k}")).alias(k) for k, v in ints.items()])


def commit_batches(writes: DataFrame, order: str, every: int = COMMIT_EVERY) -> DataFrame:
    """(batch, n_writes): index writes in ``order``, committed every ``every``."""
    rows = _ranged(writes.select(order), order)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_p"))
    n = F.row_number().over(Window.partitionBy("_b").orderBy(order)) + F.col("_p")
    return rows.join(F.broadcast(sums), "_b").select(F.floor((n - 1) / every).cast("long").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("n_writes"))


def gate(extension_known: Column, name_only: Column, size: Column, max_bytes: int) -> Column:
    """Whether a file's content is read, in the order that costs least."""
    return F.when(~extension_known, "unknown_type").when(name_only, "name_only").when(size > max_bytes, "too_large").otherwise("extract")


def evaluate_status(root_exists: Column, index_exists: Column, file_count: Column) -> Column:
    built = index_exists & (file_count > 0)
    return F.when(root_exists & built, "Ok").when(root_exists, "NeedsUpdate").otherwise("SourceUnavailable")
