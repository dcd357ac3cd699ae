"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each model sees the text's features and the
probabilities of the categories before it. A later model learns from out-of-fold probabilities of
the earlier ones, so it meets in training what it will meet in use. Features are the presence of
word beginnings of 3 to 8 bytes, and of runs of as many bytes from every character of every word,
hashed, chosen by chi-square against the label, anew for each fold on the documents outside it. Words are cut at blanks and ASCII marks; those of scripts without blanks are
long, and have features throughout.

Labels know only ``toxic``. The categories before it are three groups of the features that tell
toxic texts in the sample, whatever its words and languages; their names are those of the columns
and no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import textbytes as tb
from gleanwork.llm.quality_classifier import chosen_rows, is_learnt, labelled_ids
from gleanwork.llm.shared import materialise, without

#: Labelled documents learnt from, half of each label where there are enough.
SAMPLE = 4000
FEATURES = 1024
BITS = 20
GRAMS = range(3, 9)
#: Tells a word's beginning from the same run elsewhere.
BEGINS = np.uint64(0x5851F42D4C957F2D)
#: Letters, digits and all bytes beyond ASCII; the rest cuts words.
PLAIN = np.full(256, 32, np.uint8)
for _first, _last in ((48, 57), (97, 122), (128, 255)):
    PLAIN[_first : _last + 1] = np.arange(_first, _last + 1)
PLAIN[65:91] = np.arange(97, 123)
FOLDS = 5
#: Bytes of text whose features are made at once, and tasks that count the sample's features.
PIECE, COUNTERS = 1 << 18, 8
RIDGE = 1e-4
#: Categories before the label itself: groups of telling features.
GROUPS = ("insult", "contempt", "disgust")
CHAIN = (*GROUPS, "toxic")
#: Chi-square from which a feature tells; none of 2**BITS features without meaning is expected there.
TELLS = 30.0


def grams(buf: np.ndarray, offs: np.ndarray):
    """(text number, bucket) of the beginning of every word and of the runs of bytes from every
    character of it, for each length in turn."""
    low = PLAIN[buf]
    s, e, doc = tb.spans(low, offs)
    for k in GRAMS:
        ok = e - s >= k
        yield doc[ok], (tb.mix(tb.hashes(low, s[ok], s[ok] + k) ^ BEGINS) >> np.uint64(64 - BITS)).astype(np.int64)
    begins = np.zeros(len(low), np.int32)
    begins[s] = 1
    at = np.flatnonzero((low != 32) & ((low & 0xC0) != 0x80))
    word = np.cumsum(begins, dtype=np.int32)[at] - 1
    room, of = e[word] - at, doc[word]
    for k in GRAMS:
        ok = room >= k
        at, room, of = at[ok], room[ok], of[ok]
        yield of, (tb.hashes(low, at, at + k) >> np.uint64(64 - BITS)).astype(np.int64)


def fold_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(FOLDS)), F.lit(FOLDS)).cast("int")


def _present(batches):
    """How many documents of each cell (label and fold) have each bucket."""
    size, cells = 1 << BITS, 2 * FOLDS
    have = np.zeros((cells, size), np.int32)
    for batch in batches:
        buf, offs = tb.column(batch.column("text"))
        cell = batch.column("y").to_numpy() * FOLDS + batch.column("fold").to_numpy()
        for lo, hi, b, o in tb.pieces(buf, offs, PIECE):
            seen = np.unique(np.concatenate([doc << BITS | at for doc, at in grams(b, o)] or [np.zeros(0, np.int64)]))
            np.add.at(have.reshape(-1), cell[lo:hi][seen >> BITS].astype(np.int64) * size + (seen & (size - 1)), 1)
    some = np.flatnonzero(have.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.FixedSizeListArray.from_arrays(pa.array(have[:, some].T.reshape(-1).astype(np.int64)), cells).cast(pa.list_(pa.int64()))], ["bucket", "n"])


def _bits(columns: np.ndarray, table: np.ndarray):
    """Of each document, which of the chosen buckets it has."""

    def run(batches):
        for batch in batches:
            buf, offs = tb.column(batch.column("text"))
            for lo, hi, b, o in tb.pieces(buf, offs, PIECE):
                x = _features(b, o, table, len(columns))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "y", "fold")), pa.array([row.tobytes() for row in np.packbits(x.astype(bool), axis=1)], pa.binary())], ["doc_id", "y", "fold", "bits"])

    return run


def choose(counts: DataFrame, totals: np.ndarray) -> list[np.ndarray]:
    """Buckets with the largest chi-square against the label: outside each fold, and over all.
    ``counts`` has how many documents of each cell have a bucket; FEATURES rows of it are taken at a time."""
    out = []
    for f in range(FOLDS + 1):
        inside = [k for k in range(FOLDS) if k != f]
        n0, n1 = (float(totals[y, inside].sum()) for y in (0, 1))
        neg, pos = (sum((F.col("n")[y * FOLDS + k] for k in inside), F.lit(0)) for y in (0, 1))
        both = pos + neg
        chi = F.pow(pos * n0 - neg * n1, 2.0) / F.greatest(both * (n0 + n1 - both) * max(n1 * n0, 1.0), F.lit(1.0))
        rows = counts.select("bucket", chi.alias("chi")).where("chi > 0").orderBy(F.desc("chi"), "bucket").limit(FEATURES).collect()
        out.append(np.array(sorted(r.bucket for r in rows), np.int64))
    return out


def groups(x: np.ndarray, y: np.ndarray, chi: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Group of each feature, -1 of those that don't tell toxic texts (``more``: those commoner in them).

    The telling features, three at least where there are, are ordered by how they occur together
    over the toxic texts and cut into groups of equal number."""
    out = np.full(x.shape[1], -1)
    order = np.flatnonzero(more)[np.argsort(-chi[more], kind="stable")]
    tell = order[: max(int((chi[order] >= TELLS).sum()), len(GROUPS))]
    if len(tell):
        a = x[y == 1][:, tell].T.astype(np.float64)
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        a -= a.mean(0)
        along = np.linalg.eigh(a @ a.T)[1][:, -1]
        along = np.round(along if along[0] >= 0 else -along, 6)
        out[tell[np.argsort(-along, kind="stable")]] = np.arange(len(tell)) * len(GROUPS) // len(tell)
    return out


def fit(x: np.ndarray, y: np.ndarray, steps: int = 150) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):  # the largest eigenvalue bounds the step
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    rate = 1 / (0.25 * np.linalg.norm(v) / len(x) + RIDGE)
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        new = z - rate * (x.T @ (p - y) / len(x) + RIDGE * z)
        z = new + k / (k + 3) * (new - w)
        w = new
    return w.astype(np.float32)


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The chain, or None without documents of both labels. ``without`` is the share of the
    sample's toxic rows that have no category.

    Features are counted by their hashes within tasks; the driver gets FEATURES numbers for each
    fold and the sample's bits for them. Documents repeated under one doc_id count once."""
    ids = labelled_ids(labels, "toxic", is_learnt(), sample)
    rows = chosen_rows(docs, ids).withColumn("fold", fold_of(F.col("doc_id").cast("string")))
    rows = materialise(rows, "toxic-sample")  # `sample` rows at most
    totals = np.zeros((2, FOLDS), np.int64)
    for r in rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        totals[r.y, r.fold] = r.n
    if not totals.sum(1).all():
        return None
    counts = rows.repartition(COUNTERS, "doc_id").mapInArrow(_present, "bucket long, n array<long>").groupBy("bucket")
    counts = materialise(counts.agg(F.array(*[F.sum(F.col("n")[k]) for k in range(2 * FOLDS)]).alias("n")), "toxic-counts")
    chosen = choose(counts, totals)
    columns = np.unique(np.concatenate(chosen))
    table = np.full(1 << BITS, -1, np.int32)
    table[columns] = np.arange(len(columns))
    found = sorted(rows.mapInArrow(_bits(columns, table), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, fold int, bits binary").collect(), key=lambda r: (str(r.doc_id), bytes(r.bits)))
    every = np.unpackbits(np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(len(found), (len(columns) + 7) // 8), axis=1)[:, : len(columns)].astype(np.float32)
    y, fold = np.array([r.y for r in found], np.float32), np.array([r.fold for r in found])
    return {"table": _table(chosen[-1])} | fit_chain(every, [np.searchsorted(columns, c) for c in chosen], y, fold, toxic_share(labels))


def toxic_share(labels: DataFrame) -> float:
    """Of the rows whose labels may be learnt."""
    return labels.where(is_learnt() & F.col("toxic").isNotNull()).agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0]


def _table(buckets: np.ndarray) -> np.ndarray:
    """Column of each bucket, -1 of those that aren't chosen."""
    table = np.full(1 << BITS, -1, np.int32)
    table[buckets] = np.arange(len(buckets))
    return table


def fit_chain(every: np.ndarray, chosen: list[np.ndarray], y: np.ndarray, fold: np.ndarray, share: float) -> dict:
    """Models of the chain. ``every`` has a row per document and a column per feature; ``chosen`` the
    columns that were chosen outside each fold and, last, over all.

    The documents of a fold are predicted from the columns chosen outside it, by models of the
    documents outside it. Categories are named by the features over all: they are what is
    predicted, not what it is predicted from."""
    x = every[:, chosen[-1]]
    pos, neg, n1, n0 = x[y == 1].sum(0), x[y == 0].sum(0), y.sum(), len(y) - y.sum()
    chi = (pos * n0 - neg * n1) ** 2 / np.maximum((pos + neg) * (len(y) - pos - neg) * n1 * n0, 1) * len(y)
    group = groups(x, y, chi, pos * n0 > neg * n1)
    truth = {c: (y * x[:, group == g].any(1)).astype(np.float32) for g, c in enumerate(GROUPS)} | {"toxic": y}
    before, models = np.zeros((len(y), 0), np.float32), []
    for c in CHAIN:
        t, outside = truth[c], np.zeros(len(y), np.float32)
        models.append(fit(np.hstack([x, before]), t))
        for f in np.unique(fold):
            held, own = fold == f, np.hstack([every[:, chosen[f]], before])
            outside[held] = predict(own[held], fit(own[~held], t[~held])) if not held.all() else t.mean()
        before = np.hstack([before, outside[:, None]])
    # the cut between documents is set on out-of-fold probabilities, with each label at its share of all labelled rows
    weight, p = np.where(y == 1, share / n1, (1 - share) / n0), before[:, -1]
    cuts = np.linspace(0.05, 0.95, 91)
    f1 = [2 * weight[(p >= c) & (y == 1)].sum() / max(weight[p >= c].sum() + weight[y == 1].sum(), 1e-12) for c in cuts]
    top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return {"models": models, "cut": float(cuts[top[len(top) // 2]]), "without": float(np.mean([not any(truth[c][i] for c in GROUPS) for i in np.flatnonzero(y)]))}


def _features(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, columns: int) -> np.ndarray:
    x = np.zeros((len(offs) - 1, columns), np.float32)
    for doc, at in grams(buf, offs):
        at = table[at]
        hit = at >= 0
        x[doc[hit], at[hit]] = 1
    return x


def _probabilities(buf, offs, model) -> np.ndarray:
    x = _features(buf, offs, model["table"], len(model["models"][0]) - 1)
    out = []
    for w in model["models"]:
        out.append(predict(x, w))
        x = np.hstack([x, out[-1][:, None].astype(np.float32)])
    return np.stack(out, 1)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """Every row of ``docs`` (with doc_id, text) with p_<category> and is_toxic, which replace
    columns of these names.

    A null or empty text has the probabilities of a text without any feature. Without a model
    they are 0 and nothing is toxic."""
    docs = without(docs, *(f"p_{c}" for c in CHAIN), "is_toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, *(f"p_{c}" for c in CHAIN), "is_toxic"]

    def run(batches):
        m = sent.value
        for batch in batches:
            buf, offs = tb.column(batch.column("text"))
            parts = [_probabilities(b, o, m) if m else np.zeros((hi - lo, len(CHAIN))) for lo, hi, b, o in tb.pieces(buf, offs, PIECE)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(CHAIN)))
            made = [pa.array(p[:, i].astype(np.float64)) for i in range(len(CHAIN))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(p[:, -1] >= (m["cut"] if m else 2))], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, fields + "".join(f", p_{c} double" for c in CHAIN) + ", is_toxic boolean")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = score(rows, train(rows, labels)).drop("text")
    return out.withColumns({"score": F.col("p_toxic"), "predicted": F.col("is_toxic").cast("int")})
