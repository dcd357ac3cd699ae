"""Self-join of documents on the Jaccard similarity of their word n-grams.

1. Documents of equal shingle sets are one class; each class is compared once.
2. Bands of MinHash values name candidates: a pair at the threshold shares none of ``BANDS`` bands
   with probability (1 - 0.8**ROWS)**BANDS = 5e-6.
3. A pair is looked at in the first band that it shares, and nowhere else. Its MinHash values are compared
   ``STEP`` at a time; it goes as soon as the posterior probability that its similarity reaches the
   threshold falls below ``TOLERANCE``.
4. Members with a pair that survives bring their texts to that band's bucket, where such pairs are verified on the exact
   sets. Only candidates are verified: a chain of texts each like the next costs its links, not their closure.

Pairs are never emitted. A bucket of many members is dealt to tasks as pairs of blocks of its members, which
compare within memory and return one row per member.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import textbytes as tb
from gleanwork.llm.components import components
from gleanwork.llm.shared import materialise, release

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
#: MinHash values kept, a byte each, for the incremental comparison.
KEPT, STEP = 128, 16
TOLERANCE = 1e-6
#: Members of a block.
BLOCK = 256
#: Pairs compared at once.
PAIRS = 250_000
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def set_key(s: np.ndarray) -> np.uint64:
    """A 64-bit key of a set of hashes."""
    m = tb.mix(s)
    return tb.mix(np.array([np.add.reduce(m)], np.uint64) ^ tb.mix(np.array([np.bitwise_xor.reduce(m) if len(m) else 0], np.uint64) + np.uint64(len(s))))[0]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets: a row each."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS):
        h = (x ^ _XOR[i]) * _MUL[i]
        h ^= h >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(h, starts)
    return out


def _sketch(batches):
    names = ["set_key", "n_shingles", "bands", "marks", "sig"]
    for batch in batches:
        buf, offs = tb.column(batch.column("text"))
        for lo, hi, b, o in tb.pieces(buf, offs):
            sets = tb.shingle_sets(b, o, WIDTH)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, bands, marks, sigs = ([None] * len(sets) for _ in range(4))
            if full:
                m = minhashes([sets[i] for i in full])
                h = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    h = tb.mix(h * np.uint64(0xD1342543DE82EF95) + m[:, r::ROWS].astype(np.uint64))
                h, short, small = h.view(np.int64), (h >> np.uint64(32)).astype(np.uint32), (m[:, :KEPT] * np.uint32(2654435769) >> np.uint32(24)).astype(np.uint8)
                for at, i in enumerate(full):
                    keys[i], bands[i], marks[i], sigs[i] = int(set_key(sets[i]).view(np.int64)), h[at], short[at].tobytes(), small[at].tobytes()
            made = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("text_key").slice(lo, hi - lo), *made], ["doc_id", "text_key", *names])


@cache
def least_matches(threshold: float = THRESHOLD) -> np.ndarray:
    """For each step, the fewest equal values with which a pair lives on: below, P(similarity >=
    threshold | matches) < TOLERANCE under a uniform prior (a Beta posterior)."""
    grid = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(STEP, KEPT + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= TOLERANCE:
                break
        out.append(m)
    return np.array(out)


def first_shared(marks: np.ndarray, number: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Positions of the pairs that share no band before that of their number; marks are 32 bits of each band."""
    alive = np.arange(len(left))
    for k in range(int(number.max()) if len(number) else 0):
        own = marks[:, k]
        alive = alive[(number[left[alive]] <= k) | (own[left[alive]] != own[right[alive]])]
    return alive


def survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Positions of the pairs that incremental comparison does not drop."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (sig[left[alive], part] == sig[right[alive], part]).sum(1)
        on = matches >= least
        alive, matches = alive[on], matches[on]
    return alive


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == old).all():
            return label


def grouped(batches, keys: list[str]):
    """Tables of whole groups from sorted batches, with the groups' bounds. A group is carried
    over a batch's end; groups are blocks, so that is little."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not held.num_rows:
            continue
        edge = _edges(held, keys)
        if len(edge) > 2:
            yield held.slice(0, int(edge[-2])), edge[:-1]
            held = held.slice(int(edge[-2]))
    if held is not None and held.num_rows:
        yield held, _edges(held, keys)


def _edges(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.concatenate([np.flatnonzero(new), [t.num_rows]])


@cache
def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def pairs_of(edge: np.ndarray, block: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of each group: within a block, or across the group's two blocks."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        if one[lo] == two[lo]:
            a, b = _all_pairs(int(hi - lo))
            left.append(a + lo)
            right.append(b + lo)
        else:
            rows = np.arange(lo, hi)
            first, second = rows[block[lo:hi] == one[lo]], rows[block[lo:hi] == two[lo]]
            left.append(np.repeat(first, len(second)))
            right.append(np.tile(second, len(first)))
    return np.concatenate(left), np.concatenate(right)


def _bytes_matrix(col: pa.ChunkedArray) -> np.ndarray:
    buf, offs = tb.column(col)
    return buf.reshape(len(offs) - 1, -1)


def _candidates(t: pa.Table, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of each bucket block that are this band's and survive."""
    sig, marks = _bytes_matrix(t.column("sig")), _bytes_matrix(t.column("marks")).view(np.uint32)
    number, columns = t.column("number").to_numpy(), [t.column(c).to_numpy() for c in ("block", "one", "two")]
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(edge) - 1:  # some blocks at a time
        upto = at + 1
        while upto < len(edge) - 1 and (edge[upto + 1] - edge[at]) * BLOCK < PAIRS:
            upto += 1
        left, right = pairs_of(edge[at : upto + 1], *columns)
        for lo in range(0, len(left), PAIRS):
            a, b = left[lo : lo + PAIRS], right[lo : lo + PAIRS]
            own = first_shared(marks, number, a, b)
            own = own[survivors(sig, a[own], b[own])]
            lefts.append(a[own])
            rights.append(b[own])
        at = upto
    return np.concatenate(lefts), np.concatenate(rights)


UNIT = ["band", "one", "two"]
_MEMBER = "band long, one int, two int, block int, set_key long"


def _active(batches):
    """Members of bucket blocks that have a pair which survives there."""
    for t, edge in grouped(batches, UNIT):
        left, right = _candidates(t, edge)
        some = np.unique(np.concatenate([left, right]))
        if len(some):
            yield from t.select(["band", "one", "two", "block", "set_key"]).take(pa.array(some)).to_batches()


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: of few by merging, of many by products of blocks of columns."""
    if len(left) < 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    n = len(sets)
    ids, count = np.unique(np.concatenate(sets), return_counts=True)
    ids = ids[count > 1]
    out = np.zeros((n, n), np.float64)
    for lo in range(0, len(ids), 4096):
        part = ids[lo : lo + 4096]
        x = np.zeros((n, len(part)), np.float32)
        for i, s in enumerate(sets):
            own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
            at = np.searchsorted(part, own)
            at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == own)]
            x[i, at] = 1
        out += x @ x.T
    return out[left, right].astype(np.int64)


_LINKS = pa.schema([("set_key", pa.int64()), ("n_links", pa.int64()), ("n_class_links", pa.int64()), ("root", pa.int64())])


def _verify(batches):
    """Every member's exact links that are its bucket block's, and a forest of them."""
    for t, edge in grouped(batches, UNIT):
        left, right = _candidates(t, edge)
        keys, docs, text = t.column("set_key").to_numpy(), t.column("n_docs").to_numpy(), t.column("text")
        of = np.searchsorted(edge, left, "right")
        for unit in np.unique(of):
            a, b = left[of == unit], right[of == unit]
            rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            a, b = at[: len(a)], at[len(a) :]
            sets = tb.shingle_sets(*tb.column(text.take(pa.array(rows))), WIDTH)
            both, sizes = common(sets, a, b), np.array([len(s) for s in sets])
            # in whole numbers: both / union >= threshold
            linked = both * 1000 >= round(THRESHOLD * 1000) * (sizes[a] + sizes[b] - both)
            a, b = a[linked], b[linked]
            links, classes = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            np.add.at(links, a, docs[rows[b]])
            np.add.at(links, b, docs[rows[a]])
            np.add.at(classes, a, 1)
            np.add.at(classes, b, 1)
            some = np.flatnonzero(classes)
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows[some]]), pa.array(links[some]), pa.array(classes[some]), pa.array(keys[rows[roots(len(rows), a, b)[some]]])], schema=_LINKS)


def _blocks(rows: DataFrame, size: str, block: int, *keys: str) -> DataFrame:
    """Deal each group's rows to the pairs of its blocks, sorted by group. ``size`` is the group's row count."""
    n = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumns({"blocks": n, "block": F.pmod(F.xxhash64("set_key", F.lit(7)), n).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other", "blocks", size)
    return rows.repartition(*keys, "one", "two").sortWithinPartitions(*keys, "one", "two", "block")


def similarity_join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key (xxhash64 of the text),
    class_id, n_links, n_class_links, group_id.

    class_id is the least doc_id of the rows with the same shingle set; n_links counts the other
    rows at a similarity of THRESHOLD or more, copies included; n_class_links counts linked
    classes; group_id is the least doc_id of the connected component. Words are lower-cased (A-Z)
    runs of other than white space; a text of 1 to 4 words has one shingle. A null text, or one
    without words, has no links and is a class of its own, named by its doc_id.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    made = rows.mapInArrow(_sketch, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, set_key long, n_shingles long, bands array<long>, marks binary, sig binary")
    sketches = materialise(made, "ngram-sketches")
    classes = sketches.where("set_key is not null").groupBy("set_key").agg(
        *[F.first(c).alias(c) for c in ("bands", "marks", "sig")], F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_key")).alias("of")
    )
    classes = materialise(classes, "ngram-classes")
    bands = classes.select("set_key", F.posexplode("bands").alias("number", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = bands.join(shared, "band").join(classes.select("set_key", "marks", "sig"), "set_key")
    active = _blocks(buckets, "members", BLOCK, "band").select("band", "one", "two", "block", "number", "set_key", "marks", "sig").mapInArrow(_active, _MEMBER)
    active = materialise(active, "ngram-active")
    # one row of each class brings its text; the pair of keys keeps copies of one text apart
    members = active.select("set_key").distinct().join(classes.select("set_key", "n_docs", "marks", "sig", "bands", "of"), "set_key")
    texts = members.join(rows.withColumnRenamed("doc_id", "row_id"), (F.col("of.text_key") == F.col("text_key")) & F.col("of.doc_id").eqNullSafe(F.col("row_id"))).dropDuplicates(["set_key"])
    texts = materialise(texts.select("set_key", "n_docs", "marks", "sig", "bands", "text"), "ngram-texts")
    dealt = active.join(texts, "set_key").withColumn("number", F.array_position("bands", F.col("band")).cast("int") - 1)
    dealt = dealt.repartition(*UNIT).sortWithinPartitions(*UNIT, "block")
    links = dealt.select("band", "one", "two", "block", "number", "set_key", "marks", "sig", "n_docs", "text").mapInArrow(_verify, "set_key long, n_links long, n_class_links long, root long")
    links = materialise(links, "ngram-links")
    group = components(links.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    per_class = links.groupBy("set_key").agg(F.sum("n_links").alias("n_links"), F.sum("n_class_links").alias("n_class_links")).join(group.withColumnRenamed("node", "set_key"), "set_key")
    named = per_class.join(classes.select("set_key", "class_id"), "set_key")
    least = named.groupBy("label").agg(F.min("class_id").alias("group_id"))
    per_class = named.join(least, "label").select("set_key", "n_links", "n_class_links", "group_id")
    per_class = classes.select("set_key", "class_id", "n_docs").join(per_class, "set_key", "left")
    per_class = materialise(per_class, "ngram-classes")
    release(classes, active, texts, links)
    # texts without words have no class to meet, and are apart from the join
    out = sketches.where("set_key is not null").select("doc_id", "text_key", "set_key").join(per_class, "set_key", "left")
    out = out.unionByName(sketches.where("set_key is null").select("doc_id", "text_key", "set_key"), allowMissingColumns=True)
    links_of = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        "text_key",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(links_of("n_links") + F.col("n_docs") - 1, F.lit(0)).alias("n_links"),
        links_of("n_class_links").alias("n_class_links"),
        F.coalesce("group_id", "class_id", "doc_id").alias("group_id"),
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group; of equal rows one. Rows without a
    doc_id stay where no row of their group has one."""
    keys = similarity_join(docs).where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy(F.col("doc_id").alias("_kept"), F.col("text_key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    keys = materialise(keys, "ngram-kept")
    same = F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.xxhash64("text") == F.col("_key"))
    once = docs.join(keys.where("_n = 1"), same, "left_semi")
    again = docs.join(keys.where("_n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])  # only rows that are repeated are shuffled for it
    return once.unionByName(again)


#: All pairs with a common shingle, counted.
OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM t),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
  p AS (SELECT a, b, inter = na.n AND inter = nb.n AS same FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE inter * 10 >= 8 * (na.n + nb.n - inter)),
  k AS (SELECT documents.doc_id, least(documents.doc_id, coalesce(min(b), documents.doc_id)) AS class_id FROM documents LEFT JOIN p ON a = documents.doc_id AND same GROUP BY documents.doc_id),
  r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT k.doc_id, class_id, (SELECT count(*) FROM p WHERE a = k.doc_id) AS n_links, (SELECT count(DISTINCT o.class_id) FROM p JOIN k o ON o.doc_id = p.b WHERE p.a = k.doc_id AND NOT same) AS n_class_links,
  least(k.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = k.doc_id), k.doc_id)) AS group_id FROM k
"""
