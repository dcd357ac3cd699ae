"""Log-likelihoods of whole documents under a gated recurrent language model learnt from the corpus.

Word counts cover every training document; the vocabulary and the model's first predictions come
from them. Texts are then turned into word numbers once, two bytes a token, on shared storage, which
learning and scoring read.

Learning runs in rounds, each over its share of all training documents. A round's documents are dealt
by a hash of their values to learners, whose number follows from the tokens of the corpus and whose
order of reading from the hash, so that the model does not depend on partitions. Every learner starts
from the parameters sent to it and goes over each of its tokens once; the results are averaged in a
tree. Scoring sends the parameters and the counts of the most frequent words, both of bounded size;
rarer words are joined to their counts by an equi-join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import gru
from gleanwork.llm import textbytes as tb
from gleanwork.llm.shared import materialise

VOCABULARY = 4096
#: Words whose counts are broadcast, 16 bytes each; the others' are joined.
SENT = 1 << 19
#: Rounds of learning; the training documents are dealt to them, so each is learnt from.
ROUNDS = 3
#: Tokens of a learner (more where a round would have over MOST learners), and of those it learns side by side.
LEARNER, MOST, SEGMENT = 2_000_000, 4096, 1_000_000
#: Tokens scored side by side in a task.
SCORED = 2_000_000
#: Bytes of text turned into numbers at once.
READ = 4 << 20
#: Counts up to this are told apart when the words to send are chosen, larger ones by 64 steps an octave.
APART = 65_536
END = np.uint64(0x2545F4914F6CDD1D)
#: Tail classes: what a word ends in (letter, digit, then groups of marks), times ASCII or not.
ENDING = np.full(256, 7, np.int64)
ENDING[97:123] = 0
ENDING[128:] = 0
ENDING[48:58] = 1
for _group, _marks in enumerate((b".!?", b",;:", b"*#", b"$%", b"&|<>"), 2):
    ENDING[list(_marks)] = _group


def held_out() -> Column:
    """Rows that nothing is learnt from. A null doc_id has the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of all tokens, text after text, and the offsets of the texts. Each
    text's words are followed by one end token."""
    n = len(offs) - 1
    hs, kinds, counts = [], [], []
    for lo, hi, b, o in tb.pieces(buf, offs):
        low = tb.LOWER[b]
        s, e, doc = tb.spans(low, o)
        hs.append(tb.hashes(low, s, e))
        high = np.zeros(len(low) + 1, np.int64)
        np.cumsum(low >= 128, out=high[1:])
        kinds.append((ENDING[low[e - 1]] * 2 + (high[e] > high[s])).astype(np.int8))
        counts.append(np.bincount(doc, minlength=hi - lo))
    sizes = np.concatenate(counts) + 1 if counts else np.ones(n, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    h, kind = np.full(ends[-1], END), np.zeros(ends[-1], np.int8)
    word = np.ones(ends[-1], bool)
    word[ends[1:] - 1] = False
    if hs:
        h[word], kind[word] = np.concatenate(hs), np.concatenate(kinds)
    return h, kind, ends


def _count(batches):
    for batch in batches:
        h, kind, _ = tokens(*tb.column(batch.column("text")))
        words, first, n = np.unique(h, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([tb.as_long(words), pa.array(kind[first].astype(np.int64)), pa.array(n)], ["word", "kind", "n"])


def word_counts(train: DataFrame) -> DataFrame:
    """(word, kind, n) of every training token, over all training documents."""
    return train.select("text").mapInArrow(_count, "word long, kind long, n long").groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    t = df.select(*names).toArrow()
    return [t.column(n).to_numpy() for n in names]


class Words:
    """The words that are sent: counts by hash, and the vocabulary's numbers."""

    def __init__(self, word: np.ndarray, n: np.ndarray, vocabulary: np.ndarray):
        order = np.argsort(word)
        self.word, self.n = word[order], n[order]
        self.number = np.argsort(vocabulary)  # the few words of the model apart: most tokens are theirs
        self.vocabulary = vocabulary[self.number]
        self.counts = self.n[np.searchsorted(self.word, self.vocabulary)] if len(vocabulary) else np.zeros(0, np.int64)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return at, self.vocabulary[at] == h

    def numbers(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Model numbers of tokens: a word's own, or that of its tail class."""
        tail = len(self.vocabulary) + kind.astype(np.int32)
        if not len(self.vocabulary):
            return tail
        at, hit = self._place(h)
        return np.where(hit, self.number[at].astype(np.int32), tail)

    def find(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model numbers and counts of tokens; the count of a word that isn't sent is -1."""
        number, n = len(self.vocabulary) + kind.astype(np.int32), np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        if len(self.vocabulary):
            at, hit = self._place(h)
            number, n = np.where(hit, self.number[at].astype(np.int32), number), np.where(hit, self.counts[at], n)
            rest = np.flatnonzero(~hit)
        if len(self.word):
            some, back = np.unique(h[rest], return_inverse=True)
            at = np.minimum(np.searchsorted(self.word, some), len(self.word) - 1)
            n[rest] = np.where(self.word[at] == some, self.n[at], -1)[back]
        return number, n


def _grade(n: Column) -> Column:
    """A number that rises with a count, with few values however large counts are."""
    return F.when(n <= APART, n).otherwise(APART + F.floor((F.log2(n) - math.log2(APART)) * 64)).cast("long")


def prepare(counts: DataFrame) -> dict:
    """Totals, the words to send and the first parameters. ``counts`` should be materialised."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    graded = counts.withColumn("grade", _grade(F.col("n")))
    least, words = 1, distinct
    for r in sorted(graded.groupBy("grade").agg(F.count(F.lit(1)).alias("w")).collect()):  # APART + 3000 rows at most
        if words <= SENT:
            break
        words, least = words - r.w, r.grade + 1
    word, kind, n = _arrays(graded.where(F.col("grade") >= least), "word", "kind", "n")
    word, top = word.view(np.uint64), counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    top_word, top_kind, top_n = top.column("word").to_numpy().view(np.uint64), top.column("kind").to_numpy(), top.column("n").to_numpy()
    more = ~np.isin(top_word, word)  # where more than SENT words are of the highest grade
    word, n = np.concatenate([word, top_word[more]]), np.concatenate([n, top_n[more]])
    tails = np.zeros(gru.TAILS)
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w")).collect():
        own = top_kind == r.kind
        tails[r.kind] = r.n - top_n[own].sum() + 0.1 * (r.w - own.sum())
    tails += 0.1  # of an unseen word
    heads = top_n.astype(np.float64)
    return {
        "total": total, "distinct": distinct, "least": least, "words": Words(word, n, top_word), "cuts": gru.split(heads),
        "log_tails": np.log10(tails), "params": gru.start(heads, tails), "end": int(np.flatnonzero(top_word == END)[0]) if END in top_word else -1,
    }


NAMES = ("input", "state", "class", "word")


def _pack(p: dict) -> bytes:
    return b"".join(p[n].tobytes() for n in NAMES)


def _unpack(data: bytes, like: dict) -> dict:
    out, at = {}, 0
    flat = np.frombuffer(data, np.float32)
    for n in NAMES:
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape).copy()
        at += like[n].size
    return out


def _average(batches):
    """The weighted mean of each group's parameters, added up in the order of learners."""
    sums: dict[int, list] = {}
    for batch in batches:
        for group, w, blob in zip(batch.column("group").to_pylist(), batch.column("weight").to_pylist(), batch.column("params"), strict=True):
            x = np.frombuffer(blob.as_py(), np.float32) * np.float64(w)
            have = sums.setdefault(group, [0.0, 0.0])
            have[0], have[1] = have[0] + x, have[1] + w
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array([*sums], pa.int32()), pa.array([w for _, w in sums.values()]), pa.array([(x / w).astype(np.float32).tobytes() for x, w in sums.values()], pa.binary())], ["group", "weight", "params"]
        )


def _runs(batches):
    """(learner, tokens) of the sorted rows of a task, each learner's in segments of whole texts."""
    now, held, size = None, [], 0
    for batch in batches:
        for learner, blob in zip(batch.column("learner").to_pylist(), batch.column("numbers"), strict=True):
            x = np.frombuffer(blob.as_buffer(), NUMBER)
            if held and (learner != now or size + len(x) > SEGMENT):
                yield now, np.concatenate(held)
                held, size = [], 0
            now = learner
            held.append(x)
            size += len(x)
    if held:
        yield now, np.concatenate(held)


def learn(numbers: DataFrame, model: dict) -> dict:
    """The model after ROUNDS rounds of averaged learning that together go over all training documents.

    Rows with the same doc_id and text are alike; they are counted, and dealt to learners as copies."""
    if model["end"] < 0 or not model["total"]:
        return model
    context = numbers.sparkSession.sparkContext
    rows = numbers.where("not held").select("key", "numbers")
    again = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lm-copies")  # its size decides about a broadcast
    copies = rows.join(again.select("key"), "key", "left_semi").groupBy("key").agg(F.first("numbers").alias("numbers"), F.count(F.lit(1)).alias("n"))
    copies = copies.select("key", "numbers", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    rows = rows.join(again.select("key"), "key", "left_anti").select("key", "numbers", F.lit(1).alias("copy")).unionByName(copies)
    learners = max(1, min(MOST, -(-model["total"] // (ROUNDS * LEARNER))))
    dealt = F.xxhash64("key", "copy", F.lit(6))
    rows = rows.withColumns({"round": F.pmod(dealt, F.lit(ROUNDS)), "learner": F.pmod(F.floor(dealt / ROUNDS), F.lit(learners)).cast("int")})
    groups = math.isqrt(learners) + 1
    for r in range(ROUNDS):
        sent = context.broadcast(model)

        def run(batches, sent=sent):
            m, now, learner, weight = sent.value, None, None, 0

            def result():
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([float(weight)]), pa.array([_pack(learner.p)], pa.binary())], ["learner", "weight", "params"])

            for i, words in _runs(batches):
                if i != now:
                    if learner:
                        yield result()
                    now, learner, weight = i, gru.Learner({n: v.copy() for n, v in m["params"].items()}, m["cuts"], m["end"]), 0
                learner.learn(words.astype(np.int64))
                weight += len(words)
            if learner:
                yield result()

        part = rows.where(F.col("round") == r).select("learner", "key", "copy", "numbers")
        part = part.repartitionById(learners, "learner").sortWithinPartitions("learner", "key", "copy")
        made = part.select("learner", "numbers").mapInArrow(run, "learner int, weight double, params binary").withColumn("group", F.pmod("learner", F.lit(groups)))
        made = made.repartition(groups, "group").sortWithinPartitions("group", "learner").select("group", "weight", "params").mapInArrow(_average, "group int, weight double, params binary").collect()  # one row a group
        if made:
            made = sorted(made, key=lambda x: x.group)
            mean = sum(np.frombuffer(x.params, np.float32) * np.float64(x.weight) for x in made) / sum(x.weight for x in made)
            model = model | {"params": _unpack(mean.astype(np.float32).tobytes(), model["params"])}
    return model


#: Numbers are below VOCABULARY + gru.TAILS.
NUMBER = np.dtype("<u2")
_READ = "row long, key long, held boolean, numbers binary, n_tokens long, n_known long, base double, tail double, rest array<struct<word:long,n:long>>"


def _read(buf: np.ndarray, offs: np.ndarray, m: dict) -> list[pa.Array]:
    """Numbers of the tokens of some texts, and what counts alone say of them: known tokens, the sum of
    log10(count + 0.1) over sent words, and that over tail words less their class's mass; words that weren't sent."""
    k = len(m["params"]["word"])
    h, kind, offs = tokens(buf, offs)
    number, n = m["words"].find(h, kind)
    size = len(offs) - 1
    doc = np.repeat(np.arange(size), np.diff(offs))
    sent = n >= 0
    logs = np.where(sent, np.log10(np.maximum(n, 0) + 0.1), 0.0)
    tail = np.flatnonzero(number >= k)
    sums = lambda at, weights: np.bincount(at, weights=weights, minlength=size).astype(np.float64)  # noqa: E731  (of nothing numpy makes whole numbers)
    tails = sums(doc[tail], logs[tail] - m["log_tails"][number[tail] - k])
    # words that weren't sent, with their number in each text
    at = np.flatnonzero(~sent)
    at = at[np.lexsort((h[at], doc[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (h[at[1:]] != h[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    rest = pa.StructArray.from_arrays([tb.as_long(h[at[first]]), pa.array(np.diff(np.append(first, len(at))))], ["word", "n"])
    bounds = np.searchsorted(doc[at[first]], np.arange(size + 1)).astype(np.int32)
    numbers = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((offs * NUMBER.itemsize).astype(np.int32)), pa.py_buffer(number.astype(NUMBER))])
    return [numbers, pa.array(np.diff(offs)), pa.array(np.bincount(doc[sent], minlength=size)), pa.array(sums(doc, logs)), pa.array(tails), pa.ListArray.from_arrays(pa.array(bounds), rest)]


def read(rows: DataFrame, model: dict) -> DataFrame:
    """Every row (doc_id, text) with what ``_read`` finds, a row number and a key of its values."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in tb.pieces(*tb.column(batch.column("text")), READ):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "row", "key", "held")), *_read(buf, offs, sent.value)], ["doc_id", "row", "key", "held", "numbers", "n_tokens", "n_known", "base", "tail", "rest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    given = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), held_out().alias("held"), "text")
    return materialise(given.mapInArrow(run, f"doc_id {kind}, {_READ}"), "lm-numbers")  # the row numbers are fixed from here


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """Word counts, texts as numbers, and the model learnt from them."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = materialise(word_counts(rows.where(~held_out())), "lm-counts")
    model = prepare(counts)
    numbers = read(rows, model)
    return counts, numbers, learn(numbers, model)


def score(docs: DataFrame) -> DataFrame:
    """Every row with doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null text is empty: its one token is the end. Without training documents every word is
    unknown and the model's first predictions stand. Repeated rows are learnt and scored each."""
    counts, numbers, model = fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            buf, offs = tb.column(batch.column("numbers"))
            for lo, hi, b, o in tb.pieces(buf, offs, SCORED * NUMBER.itemsize):
                made = gru.score(m["params"], m["cuts"], b.view(NUMBER).astype(np.int64), o // NUMBER.itemsize) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "row", "held", "n_tokens", "n_known", "base", "tail")), pa.array(made)], ["doc_id", "row", "held", "n_tokens", "n_known", "base", "tail", "model"])

    kind = numbers.schema["doc_id"].dataType.simpleString()
    scored = numbers.select("doc_id", "row", "held", "n_tokens", "n_known", "base", "tail", "numbers").mapInArrow(run, f"doc_id {kind}, row long, held boolean, n_tokens long, n_known long, base double, tail double, model double")
    rest = numbers.select("row", F.explode("rest").alias("x")).select("row", "x.word", F.col("x.n").alias("tf"))
    # a word that is in many documents was sent, unless only held-out ones have it; the join splits such a word
    rest = rest.join(counts.where(_grade(F.col("n")) < model["least"]).select("word", "n"), "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))), F.lit(0)).alias("known"))
    rest = materialise(rest, "lm-rest")  # its size decides about a broadcast
    base = float(np.log10(model["total"] + 0.1 * (model["distinct"] + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(model["total"])).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * base).alias("base_score"), (F.col("model") + F.col("tail") + more).alias("score"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
