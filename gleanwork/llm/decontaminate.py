"""Benchmark passages in documents, by SimHash of item-sized windows. DataFrame functions only.

1. Five-word shingles of every document are hashed; positions whose shingle stands in some item are
   active. Windows have the lengths of items and start where a shingle of an item of that length
   stands. That loses no pair: without the shingles before an item's first one a window is no less similar to it.
2. A bound on what a window can share with items of its length drops those that cannot reach the
   threshold.
3. Each window and item has a 64-bit SimHash, a window's from running counts of bits. It is cut into
   BLOCKS blocks; two fingerprints within the radius differ in at most RADIUS // BLOCKS bits of at least one,
   so an equi-join of windows' blocks with all values that near to items' blocks finds every pair within it.
4. Pairs within the radius are verified: the weighted Jaccard similarity of the shingle multisets.

For an item, its own shingles weigh 1 / (1 + ln(items with the shingle)) and all others 1. Sums over
windows are running sums over positions, so work grows with texts and not with texts times windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.llm.shared import materialise

WIDTH = 5
THRESHOLD = 0.8
#: Sets of equal size at similarity 0.8 differ in 9.7 bits of 64 on average, with deviation 2.9.
RADIUS = 19
BLOCKS = 5
#: Tables of shingles and of items' blocks are broadcast up to so many rows (about 100 bytes each).
BROADCAST_ROWS = 1_000_000
#: Characters that part words.
PART = r"[^\p{L}\p{N}]+"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), PART), "")


def shingles(text: Column) -> Column:
    """Hashes of a text's five-word runs in order; of all words where there are 1 to 4, none where there are none."""

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - WIDTH + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WIDTH)))
        return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<bigint>"))

    return once(words(text), hashes)


#: A running sum holds two counters of 32 bits: bit k of the hashes, and bit k + 32.
LANES = [f"_b{k}" for k in range(32)]


def lanes(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, k).bitwiseAND(0x0000000100000001).alias(c) for k, c in enumerate(LANES)]


def majority(n: Column) -> Column:
    """The SimHash of n hashes whose bits the columns LANES count."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LANES):
        for bit, count in ((k, F.col(c).bitwiseAND(0xFFFFFFFF)), (k + 32, F.shiftrightunsigned(c, 32))):
            out = out.bitwiseOR(F.when(count * 2 > n, F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cuts(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    at = [64 * i // blocks for i in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(at[:-1], at[1:], strict=True)]


def part(fp: Column, lo: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, lo).bitwiseAND((1 << width) - 1)


def window_blocks(fp: Column, blocks: int = BLOCKS) -> Column:
    """(block, value) of a fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("block"), part(fp, lo, width).alias("value")) for i, (lo, width) in enumerate(cuts(blocks))])


def item_blocks(fp: Column, radius: int, blocks: int = BLOCKS) -> Column:
    """(block, value) of all values that differ from a fingerprint's block in radius // blocks bits at most."""
    near = [F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= radius // blocks) for _, width in cuts(blocks)]
    probe = lambda i, lo, width: lambda m: F.struct(F.lit(i).alias("block"), part(fp, lo, width).bitwiseXOR(m.cast("long")).alias("value"))
    return F.concat(*[F.transform(near[i], probe(i, lo, width)) for i, (lo, width) in enumerate(cuts(blocks))])


def first_block(one: Column, two: Column, radius: int, blocks: int = BLOCKS) -> Column:
    """The first block in which two fingerprints are near."""
    x = one.bitwiseXOR(two)
    return F.coalesce(*[F.when(F.bit_count(part(x, lo, width)) <= radius // blocks, F.lit(i)) for i, (lo, width) in enumerate(cuts(blocks))])


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def prepare(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items' shingles (item_key, item_id, n, h, c, w, item_weight, n_total: rows of this table) and fingerprints
    (item_key, n, item_fp). Items are told apart by id and text; repeated rows count once."""
    text = F.col("text").cast("string")
    bench = items.select("item_id", F.xxhash64("item_id", text).alias("item_key"), shingles(text).alias("sh")).where(F.size("sh") > 0).dropDuplicates(["item_key"])
    bench = materialise(bench.withColumn("n", F.size("sh").cast("long")), "bench-items")
    each = bench.select("item_key", "item_id", "n", F.explode("sh").alias("h"))
    prints = each.select("item_key", "n", *lanes(F.col("h"))).groupBy("item_key", "n").agg(*[F.sum(c).alias(c) for c in LANES]).select("item_key", "n", majority(F.col("n")).alias("item_fp"))
    weight = each.groupBy("h").agg(F.countDistinct("item_key").alias("items")).select("h", (1 / (1 + F.log("items"))).alias("w"))
    counted = each.groupBy("item_key", "item_id", "n", "h").agg(F.count(F.lit(1)).alias("c")).join(weight, "h")
    total = counted.groupBy("item_key").agg(F.sum(F.col("w") * F.col("c")).alias("item_weight"))
    return materialise(counted.join(total, "item_key"), "bench-shingles"), materialise(prints, "bench-prints")


def windows(rows: DataFrame, shingled: DataFrame, threshold: float) -> DataFrame:
    """(row_key, total, n, start) of the windows of rows (row_key, text) that could reach the threshold.
    ``shingled`` has the items' shingles."""
    lengths = shingled.groupBy("n").agg(F.min("item_weight").alias("least"))
    known = shingled.select("h", "w", "n").distinct().join(F.broadcast(lengths), "n")  # a row per length
    known = materialise(known.groupBy("h").agg(F.max("w").alias("w"), F.collect_list(F.struct("n", "least")).alias("ns")), "bench-known")
    known = _hint(known, known.count())
    active = rows.select("row_key", shingles(F.col("text")).alias("sh")).select("row_key", F.size("sh").cast("long").alias("total"), F.posexplode("sh").alias("start", "h"))
    active = active.join(known.select("h"), "h", "left_semi").distinct().join(known, "h")  # repeated rows once
    active = active.select("row_key", "total", F.col("start").cast("long").alias("start"), "w", F.explode("ns").alias("s")).select("row_key", "total", "start", "w", "s.n", "s.least")
    own = Window.partitionBy("row_key", "n")
    before = own.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    active = active.withColumns({"w0": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "c0": F.count(F.lit(1)).over(before)})
    # at a window's end, before what stands there, the running sums are read again
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("adds")), F.struct((F.col("start") + F.col("n")).alias("at"), F.lit(0).alias("adds")))
    run = own.orderBy("at", "adds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = active.withColumn("e", F.explode(ends)).withColumns({"at": F.col("e.at"), "adds": F.col("e.adds")})
    seen = seen.withColumns({"w1": F.sum(F.col("w") * F.col("adds")).over(run), "c1": F.sum("adds").over(run)}).where("adds = 0")
    on = F.col("w1") - F.col("w0")
    # at most `on` is shared, and the window's other shingles weigh 1 each
    others = F.least("n", F.col("total") - F.col("start")) - (F.col("c1") - F.col("c0"))
    return seen.where(on >= threshold * (F.greatest(on, F.col("least")) + others) - 1e-9).select("row_key", "total", "n", "start")


def fingerprints(found: DataFrame, positions: DataFrame) -> DataFrame:
    """The windows ``found`` with their SimHash fp, from the hashes at all ``positions`` (row_key, at, h) that they cover."""
    stop = F.least(F.col("start") + F.col("n"), F.col("total"))
    reads = F.array(F.struct(F.col("start").alias("at"), F.lit(-1).cast("long").alias("sign")), F.struct(stop.alias("at"), F.lit(1).cast("long").alias("sign")))
    asks = found.withColumn("e", F.explode(reads)).select("row_key", "e.at", F.lit(0).alias("adds"), "e.sign", "n", "start", "total", *[F.lit(0).cast("long").alias(c) for c in LANES])
    nothing = [F.lit(None).cast("long").alias(c) for c in ("sign", "n", "start", "total")]
    adds = positions.select("row_key", "at", F.lit(1).alias("adds"), *nothing, *lanes(F.col("h")))
    run = Window.partitionBy("row_key").orderBy("at", "adds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = asks.unionByName(adds).select("row_key", "adds", "sign", "n", "start", "total", *[F.sum(c).over(run).alias(c) for c in LANES]).where("adds = 0")
    between = summed.groupBy("row_key", "n", "start", "total").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in LANES])
    return between.select("row_key", "n", "start", "total", majority(F.least(F.col("n"), F.col("total") - F.col("start"))).alias("fp"))


def verify(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """``pairs`` (row_key, item_key, n, start, total, item_weight) with the similarity of window and item.

    ``matches`` (row_key, item_key, at, h, c, w) are the positions of the item's shingles. One is in the windows
    that start after ``at`` - n and up to ``at``, and shared by those that start after the c-th occurrence before it."""
    number = Window.partitionBy("row_key", "item_key", "h").orderBy("at")
    each = matches.withColumn("k", F.row_number().over(number))
    # each occurrence meets the one c before it
    met = F.explode(F.array(F.struct(F.col("k"), F.col("at"), F.lit(None).cast("long").alias("q")), F.struct((F.col("k") + F.col("c")).alias("k"), F.lit(None).cast("long").alias("at"), F.col("at").alias("q"))))
    each = each.select("row_key", "item_key", "n", "h", "w", met.alias("e")).groupBy("row_key", "item_key", "n", "h", "w", "e.k").agg(F.max("e.at").alias("at"), F.max("e.q").alias("q")).where("at is not null")
    event = lambda at, shared, inside, count: F.struct(at.alias("at"), shared.alias("shared"), inside.alias("inside"), F.lit(count).cast("long").alias("count"))
    zero, w = F.lit(0.0), F.col("w")
    first = F.col("at") - F.col("n") + 1
    steps = F.array(event(first, zero, w, 1), event(F.greatest(first, F.coalesce(F.col("q") + 1, first)), w, zero, 0), event(F.col("at") + 1, -w, -w, -1))
    steps = each.select("row_key", "item_key", F.explode(steps).alias("e")).select("row_key", "item_key", "e.*", F.lit(0).alias("asks"), *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("total", "long"), ("item_weight", "double"))])
    asks = pairs.select("row_key", "item_key", F.col("start").alias("at"), zero.alias("shared"), zero.alias("inside"), F.lit(0).cast("long").alias("count"), F.lit(1).alias("asks"), "n", "total", "item_weight")
    run = Window.partitionBy("row_key", "item_key").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.unionByName(asks).withColumns({c: F.sum(c).over(run) for c in ("shared", "inside", "count")}).where("asks = 1")
    window = F.col("inside") + F.least("n", F.col("total") - F.col("at")) - F.col("count")
    return sums.select("row_key", "item_key", F.col("at").alias("start"), (F.col("shared") / (F.col("item_weight") + window - F.col("shared"))).alias("similarity"))


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row per document row with a passage and item: row_key (xxhash64 of doc_id and text),
    doc_id, item_id, similarity (of the best window, to 6 places), start (its first word, from 0;
    the earliest of the best that begin with a shingle of the item) and n_windows (verified ones).

    Repeated rows of a document give one row. Null and empty texts hold nothing, items without
    words match nothing, and items of 1 to 4 words match whole texts of that many words."""
    shingled, prints = prepare(items)
    n_shingles, n_items = shingled.count(), prints.count()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = materialise(windows(rows, shingled, threshold), "bench-windows")

    covered = found.groupBy("row_key").agg(F.min("start").alias("lo"), F.max(F.least(F.col("start") + F.col("n"), F.col("total"))).alias("hi"))
    texts = rows.join(covered, "row_key").groupBy("row_key").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "lo", "hi")])
    texts = texts.select("row_key", "doc_id", "lo", F.slice(shingles(F.col("text")), F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")).alias("sh"))
    positions = texts.select("row_key", "doc_id", "lo", F.posexplode("sh").alias("k", "h")).select("row_key", "doc_id", (F.col("lo") + F.col("k")).alias("at"), "h")
    positions = materialise(positions, "bench-positions")

    prints_of = fingerprints(found, positions)
    left = prints_of.withColumn("b", F.explode(window_blocks(F.col("fp")))).select("*", "b.block", "b.value")
    probes = sum(sum(1 for m in range(1 << width) if m.bit_count() <= radius // BLOCKS) for _, width in cuts())
    right = prints.withColumn("b", F.explode(item_blocks(F.col("item_fp"), radius))).select("item_key", "n", "item_fp", "b.block", "b.value")
    pairs = left.join(_hint(right, n_items * probes), ["n", "block", "value"])
    # a pair that is near in several blocks is kept in the first of them
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) & (F.col("block") == first_block(F.col("fp"), F.col("item_fp"), radius))
    pairs = materialise(pairs.where(near).select("row_key", "item_key", "n", "start", "total"), "bench-pairs")

    matches = positions.join(_hint(shingled, n_shingles), "h").join(pairs.select("row_key", "item_key").distinct(), ["row_key", "item_key"], "left_semi")
    matches = materialise(matches.select("row_key", "doc_id", "item_key", "item_id", "n", "at", "h", "c", "w", "item_weight"), "bench-matches")
    # windows that begin with another item's shingle are no better than those that begin with this one's
    pairs = pairs.join(matches.select("row_key", "doc_id", "item_key", "item_id", F.col("at").alias("start"), "item_weight"), ["row_key", "item_key", "start"])
    verified = verify(pairs, matches).where(F.col("similarity") >= threshold - 1e-9)
    best = F.max(F.struct(F.round("similarity", 6).alias("s"), (-F.col("start")).alias("at")))
    names = matches.groupBy("row_key", "item_key").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"))
    out = verified.join(names, ["row_key", "item_key"]).groupBy("row_key", "item_id").agg(F.first("doc_id").alias("doc_id"), best.alias("best"), F.count(F.lit(1)).alias("n_windows"))
    return out.select("row_key", "doc_id", "item_id", F.col("best.s").alias("similarity"), (-F.col("best.at")).cast("long").alias("start"), "n_windows")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row_key", "n_windows")


#: The same by brute force: every window of an item's length at every start that has one of its shingles,
#: without bounds and fingerprints.
OP8_SQL = r"""
WITH b AS (SELECT item_id, row_number() OVER () AS item, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END AS sh
           FROM (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
  bi AS (SELECT item, len(sh) AS n, unnest(sh) AS h FROM b),
  k AS (SELECT h, 1 / (1 + ln(count(DISTINCT item))) AS w FROM bi GROUP BY h),
  bc AS (SELECT item, n, h, count(*) AS c, any_value(w) AS w FROM bi JOIN k USING (h) GROUP BY ALL),
  iw AS (SELECT item, sum(c * w) AS weight FROM bc GROUP BY ALL),
  d AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END AS sh
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) WHERE len(w) > 0),
  dp AS (SELECT doc_id, len(sh) AS total, unnest(sh) AS h, generate_subscripts(sh, 1) - 1 AS pos FROM d),
  x AS (SELECT doc_id, total, item, n, h, c, w, pos, unnest(range(greatest(0, pos - n + 1), pos + 1)) AS s FROM dp JOIN bc USING (h)),
  y AS (SELECT doc_id, total, item, n, s, h, c, w, count(*) AS f, max(CAST(pos = s AS INTEGER)) AS begins FROM x GROUP BY ALL),
  z AS (SELECT doc_id, item, s, max(begins) AS begins, sum(w * least(c, f)) AS shared, sum(w * f) + least(n, total - s) - sum(f) AS weight FROM y GROUP BY doc_id, item, s, n, total),
  v AS (SELECT doc_id, item_id, s, begins, shared / (iw.weight + z.weight - shared) AS exact FROM z JOIN iw USING (item) JOIN b USING (item)),
  m AS (SELECT doc_id, item_id, round(max(exact), 6) AS similarity FROM v GROUP BY ALL HAVING max(exact) >= 0.8 - 1e-9)
SELECT doc_id, item_id, similarity, min(s) AS start FROM v JOIN m USING (doc_id, item_id) WHERE begins = 1 AND round(exact, 6) = similarity GROUP BY ALL
"""
