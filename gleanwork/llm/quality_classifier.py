"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed: shapes of three bytes (letter case, digit, blank, each mark), words, and a word
that repeats the one before. Inverse document frequencies count every document. Labelled
documents, a sample of at most ``SAMPLE``, span the latent space by a singular value decomposition
and are broadcast in it; every document is compared with all of them in blocks of exact cosines,
and its nearest neighbours vote with their similarity. Only texts enter the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import textbytes as tb
from gleanwork.llm.shared import without

SHAPES, WORDS = 512, 256
TERMS = SHAPES + WORDS + 1
#: Labelled documents that are broadcast, half of each label where there are enough: SAMPLE * DIMS * 4 bytes.
SAMPLE = 4096
DIMS = 48
NEIGHBOURS = 15
#: Power of the similarity that a neighbour votes with.
SHARPNESS = 4
THRESHOLD = 0.3
#: Similarities this near count as equal, and neighbours tied with the last one vote too.
TIE = 1e-5

#: Class of each byte: 0 blank, 1 line end, 2 lower or beyond ASCII, 3 upper, 4 digit, then each mark.
KIND = np.zeros(256, np.uint32)
KIND[:] = np.arange(256) + 5
KIND[[32, 9, 11, 12, 13]] = 0
KIND[10] = 1
KIND[97:123] = 2
KIND[128:] = 2
KIND[65:91] = 3
KIND[48:58] = 4


def term_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of every term: a row per text."""
    n = len(offs) - 1
    kind = KIND[buf]
    of = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    out = np.zeros((n, TERMS), np.float32)
    if len(buf) > 2:
        code = ((kind[:-2] * np.uint32(521) + kind[1:-1]) * np.uint32(521) + kind[2:]) * np.uint32(2654435769) >> np.uint32(32 - 9)
        inside = of[:-2] == of[2:]
        out[:, :SHAPES] = np.bincount(of[:-2][inside] * SHAPES + code[inside], minlength=n * SHAPES).reshape(n, SHAPES)
    low = tb.LOWER[buf]
    s, e, doc = tb.spans(low, offs)
    h = tb.hashes(low, s, e)
    out[:, SHAPES:-1] = np.bincount(doc * WORDS + (h >> np.uint64(56)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    echo = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, -1] = np.bincount(doc[1:][echo], minlength=n)
    return out


def _blocks(batch):
    buf, offs = tb.column(batch.column("text"))
    for lo, hi, b, o in tb.pieces(buf, offs, 1 << 18):
        yield lo, hi, term_counts(b, o)


def _frequencies(batches):
    df, n = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for _, _, x in _blocks(batch):
            df += (x > 0).sum(0)
            n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[n], df]))], ["term", "df"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Of each term over all documents: TERMS numbers, summed before they reach the driver."""
    rows = docs.select("text").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = {r.term: r.df for r in rows}
    return np.array([np.log((1 + df.get(-1, 0)) / (1 + df.get(t, 0))) + 1 for t in range(TERMS)], np.float32)


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised weights: square roots of counts times inverse document frequency."""
    x = np.sqrt(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def labelled_ids(labels: DataFrame, label: str, learn: Column, sample: int) -> list[tuple[int, int]]:
    """At most ``sample`` labelled documents, half of each label where possible, those of the
    smallest hashes. Repeated rows of a document count once, by their mean."""
    rows = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(10)))
    sides = [[(r.doc_id, r.y) for r in rows.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample).collect()] for y in (0, 1)]
    half = sample // 2
    few = min(sides, key=len)
    if len(few) < half:
        return [x for side in sides for x in (side if side is few else side[: sample - len(few)])]
    return [x for side in sides for x in side[:half]]


def chosen_rows(docs: DataFrame, ids: list[tuple]) -> DataFrame:
    """doc_id, text and y of the chosen documents, one row each: of rows with one doc_id that of the
    least text. The keys are compared as text, so doc_id may have any type."""
    keys = docs.sparkSession.createDataFrame([(str(i), y) for i, y in ids], "_key string, y int")  # as many rows as were chosen
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(keys), F.col("doc_id").cast("string") == F.col("_key"))
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _counts_out(batches):
    for batch in batches:
        for lo, hi, x in _blocks(batch):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "y")), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "y", "counts"])


def is_learnt() -> Column:
    """Rows whose labels may be learnt."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0  # a null counts as held out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: idf, projection, vectors and labels. Documents repeated under one doc_id count once."""
    ids = labelled_ids(labels, "quality", is_learnt(), sample)
    idf = inverse_frequencies(docs)
    rows = chosen_rows(docs, ids)
    rows = sorted(rows.mapInArrow(_counts_out, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, counts binary").collect(), key=lambda r: (str(r.doc_id), bytes(r.counts)))
    if not rows:
        return {"idf": idf, "project": np.zeros((TERMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "y": np.zeros(0, np.float32)}
    x = weigh(np.frombuffer(b"".join(r.counts for r in rows), np.float32).reshape(-1, TERMS), idf)
    y = np.array([r.y for r in rows], np.float32)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))  # right singular vectors of x
    project = vectors[:, ::-1][:, :DIMS].astype(np.float32)
    return {"idf": idf, "project": project, "vectors": unit(x @ project), "y": y}


def vote(x: np.ndarray, model: dict) -> np.ndarray:
    """Scores of texts by their term counts; one without terms or neighbours has the score 0."""
    z = unit(weigh(x, model["idf"]) @ model["project"])
    t, y = model["vectors"], model["y"]
    if not len(t):
        return np.where(x.any(1), 0.5, 0.0)
    sims = np.round(z @ t.T, 5)
    few = min(int(y.sum()), len(y) - int(y.sum()))
    k = min(NEIGHBOURS, max(3, few // 3), len(t))  # a rare label's vectors must be able to win
    last = np.partition(sims, len(t) - k, axis=1)[:, len(t) - k]
    w = np.where(sims >= last[:, None] - TIE, np.maximum(sims, 0) ** SHARPNESS, 0)
    total = w.sum(1)
    return np.where(x.any(1) & (total > 0), np.minimum((w @ y) / np.maximum(total, 1e-9), 1.0), 0.0).astype(np.float64)


def score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """Every row of ``docs`` with a column of scores, which replaces one of its name."""
    docs = without(docs, column)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            parts = [vote(x, sent.value) for _, _, x in _blocks(batch)]
            made = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], [*names, column])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with doc_id, score and predicted. A null text is empty and has the score 0."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = score(rows, train(rows, labels)).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).select("doc_id", (~is_learnt()).alias("held_out"), "score", "predicted")
