"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Every row gets a global number in [0, N). A Feistel network over Z_a x Z_b, with a and b near
the root of N, permutes [0, a*b); cycle walking applies it again while the image is N or more,
which restricts it to a permutation of [0, N). The shard is the image modulo the shard count
and the slot the quotient, so a row's place is computed, not drawn, and shard sizes differ by
one at most. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.llm.shared import free_name, without

#: Rounds of the network.
ROUNDS = 6
#: Buckets that row numbers are counted in; each is numbered by its own task.
BUCKETS = 4096
#: Walks beyond the first. An image is out of range with probability below 1/sqrt(N) + 1/N.
WALKS = 64


def permute(df: DataFrame, number: str, total: str, seed: int, out: str) -> DataFrame:
    """Add ``out``, the image of column ``number`` in [0, column ``total``)."""
    a, b, x = (free_name(df, c) for c in ("_fa", "_fb", "_fx"))
    df = df.withColumn(a, F.greatest(F.lit(1), F.ceil(F.sqrt(F.col(total)))).cast("long"))
    df = df.withColumn(b, F.greatest(F.lit(1), F.ceil(F.col(total) / F.col(a))).cast("long"))

    def turn(k: int):
        key = F.lit(seed + k)
        if k % 2 == 0:
            return lambda t: F.struct(F.pmod(t["l"] + F.pmod(F.xxhash64(t["r"], key), F.col(a)), F.col(a)).alias("l"), t["r"].alias("r"))
        return lambda t: F.struct(t["l"].alias("l"), F.pmod(t["r"] + F.pmod(F.xxhash64(t["l"], key), F.col(b)), F.col(b)).alias("r"))

    def step(v: Column) -> Column:
        # the halves travel as a struct so that each round reads the last one's value once
        s = F.struct((v - F.pmod(v, F.col(b))).alias("d"), F.pmod(v, F.col(b)).alias("r"))
        s = F.transform(F.array(s), lambda t: F.struct((t["d"] / F.col(b)).cast("long").alias("l"), t["r"].alias("r")))
        for k in range(ROUNDS):
            s = F.transform(s, turn(k))
        return F.element_at(F.transform(s, lambda t: t["l"] * F.col(b) + t["r"]), 1)

    df = df.withColumn(x, step(F.col(number)))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.col(x), lambda v, _: F.when(v >= F.col(total), step(v)).otherwise(v))
    df = df.withColumn(x, F.when(F.col(x) >= F.col(total), walked).otherwise(F.col(x)))
    done = F.when(F.col(x) < F.col(total), F.col(x)).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))
    return df.withColumn(out, done).drop(a, b, x)


def number_rows(df: DataFrame, out: str, total: str, buckets: int = BUCKETS) -> DataFrame:
    """Add a gapless global row number from 0 that depends on the rows' values alone, and the
    row count. Equal rows are counted before the shuffle and numbered as one range, so no
    repeated row, however frequent, gathers in a task. The order is by a hash of all columns."""
    cols = df.columns
    h, n, bucket, start, base = (free_name(df, c) for c in ("_h", "_n", "_bucket", "_start", "_base"))
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    rows = rows.withColumn(h, F.xxhash64(*cols)).withColumn(bucket, F.pmod(F.col(h), F.lit(buckets)))
    counts = rows.groupBy(bucket).agg(F.sum(n).alias("_c"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # over `buckets` rows at most
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select(F.col(bucket), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias(base), F.sum("_c").over(everything.orderBy(bucket)).alias(total))
    own = Window.partitionBy(bucket).orderBy(h, *cols).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(start, F.coalesce(F.sum(n).over(own), F.lit(0)))
    rows = rows.join(F.broadcast(counts), bucket)  # `buckets` rows of 24 bytes at most
    first = F.col(base) + F.col(start)
    return rows.select(*cols, F.col(total), F.explode(F.sequence(first, first + F.col(n) - 1)).alias(out))


def shard(df: DataFrame, shards: int, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``df`` with columns row_number, position, shard and slot.

    Law: row counts of shards differ by one at most; slots are gapless from 0. Nulls are values
    like others, repeated rows each get a place, an empty table gives an empty one. They replace
    columns of these names.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = without(df, "row_number", "position", "shard", "slot")
    total = free_name(df, "_total")
    out = permute(number_rows(df, "row_number", total, buckets), "row_number", total, seed, "position")
    return out.drop(total).withColumns({"shard": F.pmod("position", F.lit(shards)).cast("int"), "slot": F.floor(F.col("position") / shards).cast("long")})


def place(number: int, total: int, shards: int, hash64, seed: int = 17) -> tuple[int, int]:
    """Shard and slot of one row number, for readers that seek a row; ``hash64(value, salt)`` is
    Spark's xxhash64 of a long and an int."""
    a = max(1, math.isqrt(total - 1) + 1 if total > 1 else 1)
    b = max(1, -(-total // a))
    x = number
    while True:
        left, right = divmod(x, b)
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = (left + hash64(right, seed + k) % a) % a
            else:
                right = (right + hash64(left, seed + k) % b) % b
        x = left * b + right
        if x < total:
            return x % shards, x // shards


def write_shards(df: DataFrame, path: str) -> None:
    """Sharded rows as Parquet, a folder for each shard, sorted by slot within each file."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(rows, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
