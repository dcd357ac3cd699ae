"""Quality rules whose cutoffs come from the data: one quantile sketch per language and source.

Each rule's value goes into logarithmic buckets (a DDSketch: relative error ``ALPHA``). Bucket
counts add up, so sketches merge exactly and in any order: partial counts before the shuffle,
and the sketches of small groups into those of their language and of the whole table. A rule's
cutoff is read from the group's sketch alone: it stands beyond the group's upper quantile by
``FENCE`` times that quantile's distance from the median, or the mean excess over the median where
that is more, as it is in groups whose values are nearly all equal. Documents are joined to their
group's cutoffs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.llm import textbytes as tb
from gleanwork.llm.shared import materialise

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Bucket of the value 0.
ZERO = -1_000_000
#: Groups of fewer documents take the cutoffs of their language, languages those of the table.
MIN_GROUP = 100
#: Share of a group's documents beyond its upper (and its lower) quantile.
TAIL = 0.1
FENCE = 4.0
WINDOW = 8
#: Keeps a value within its own bucket's edges against rounding.
EDGE = 1e-9
#: Rule: (value as SQL, whether it has a lower cutoff too).
RULES = {
    "symbols": ("n_symbols / word_chars", False),
    "dup_lines": ("n_dup_lines / n_words", False),
    "repeats": ("n_repeat_words / n_words", False),
    "echoes": ("n_echoes / n_words", False),
    "upper": ("n_upper / word_chars", False),
    "word_length": ("word_chars / n_words", True),
    "line_words": ("n_lines / n_words", False),
}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_echoes")


def count_texts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of some texts, by name."""
    n = len(offs) - 1
    s, e, doc = tb.spans(buf, offs)
    word = ~tb.SPACE[buf]
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": tb.per_text(word & ((buf & 0xC0) != 0x80), offs),
        "n_symbols": tb.per_text(SYMBOLS[buf], offs),
        "n_upper": tb.per_text((buf >= 65) & (buf <= 90), offs),
    }
    # lines with a word; starts and ends pair up, as both run through the texts in order
    nl = np.flatnonzero(buf == 10)
    starts, ends = np.sort(np.concatenate([offs[:-1], nl + 1])), np.sort(np.concatenate([nl, offs[1:]]))
    of = np.repeat(np.arange(n), 1 + tb.per_text(buf == 10, offs))
    seen = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(word, out=seen[1:])
    full = seen[ends] > seen[starts]
    starts, ends, of = starts[full], ends[full], of[full]
    key = tb.mix(tb.hashes(buf, starts, ends) ^ tb.mix(of.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[first], minlength=n)
    words = tb.hashes(buf, s, e)
    out["n_echoes"] = np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=n)  # words like the one before
    roll, at = tb.rolling(words, doc, WINDOW)
    key = tb.mix(roll ^ tb.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    return out


def _measure(batches):
    for batch in batches:
        buf, offs = tb.column(batch.column("text"))
        parts = [count_texts(b, o) for _, _, b, o in tb.pieces(buf, offs)]
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        made = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in COUNTS]
        yield pa.RecordBatch.from_arrays(kept + made, names + list(COUNTS))


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts of each whole text. A null text has no words."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"), *(f"{c} long" for c in COUNTS)])
    return rows.mapInArrow(_measure, schema)


def _value(expr: str) -> Column:
    top, bottom = expr.split(" / ")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def bucket(x: Column) -> Column:
    return F.when(x <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(x) / math.log(GAMMA)).cast("int"))


def sketches(counts: DataFrame) -> DataFrame:
    """Bucket counts (lang, source, rule, bucket, n): the mergeable sketches."""
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), bucket(_value(sql)).alias("bucket")) for name, (sql, _) in RULES.items()])
    return counts.where("n_words > 0").select("lang", "source", F.explode(rules).alias("r")).groupBy("lang", "source", "r.rule", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """low, mid and high (quantiles TAIL, a half and 1 - TAIL; the outer ones as their buckets' outer edges), below and
    above (mean distances of the values under and over the median from it) and size of each group of
    ``by`` and rule, from merged bucket counts.

    A group has a few thousand buckets at most, however many documents."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    everything = Window.partitionBy(*by, "rule")
    merged = merged.withColumns({"upto": F.sum("n").over(everything.orderBy("bucket")), "total": F.sum("n").over(everything), "value": _edge(0.0, 2 / (GAMMA + 1))})
    at = lambda q, value: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), value))
    merged = merged.withColumn("mid", at(0.5, F.col("value")).over(everything))
    off = (F.col("value") - F.col("mid")) * F.col("n")
    return merged.groupBy(*by, "rule").agg(
        at(TAIL, _edge(-1.0, 1 - EDGE)).alias("low"), F.max("mid").alias("mid"), at(1 - TAIL, _edge(0.0, 1 + EDGE)).alias("high"),
        (F.sum(F.greatest(-off, F.lit(0.0))) / F.max("total")).alias("below"), (F.sum(F.greatest(off, F.lit(0.0))) / F.max("total")).alias("above"), F.max("total").alias("total"),
    )


def _edge(up: float, times: float) -> Column:
    return F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") + up) * times)


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, low_<rule>, high_<rule>): one row per group."""
    own = quantiles(sketch, "lang", "source")
    stats = [c for c in own.columns if c not in ("lang", "source", "rule")]
    lang = quantiles(sketch, "lang").select(F.col("lang").alias("l"), F.col("rule").alias("lr"), *[F.col(c).alias(f"l_{c}") for c in stats])
    whole = quantiles(sketch).select(F.col("rule").alias("ar"), *[F.col(c).alias(f"a_{c}") for c in stats])
    all_ = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("lr"))).join(F.broadcast(whole), F.col("rule") == F.col("ar"))  # one row per rule
    pick = lambda c: F.when(F.col("total") >= MIN_GROUP, F.col(c)).when(F.col("l_total") >= MIN_GROUP, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    all_ = all_.select("lang", "source", "rule", *[pick(c).alias(c) for c in stats])
    low = F.col("low") - FENCE * F.greatest(F.col("mid") - F.col("low"), F.col("below"))
    high = F.col("high") + FENCE * F.greatest(F.col("high") - F.col("mid"), F.col("above"))
    all_ = all_.select("lang", "source", "rule", low.alias("low"), high.alias("high"))
    of = lambda c, name: F.max(F.when(F.col("rule") == name, F.col(c))).alias(f"{c}_{name}")
    return all_.groupBy("lang", "source").agg(*[of("high", name) for name in RULES], *[of("low", name) for name, (_, below) in RULES.items() if below])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(counts: DataFrame) -> DataFrame:
    """Add base_failed, kept and failed_rules (names of the rules beyond their cutoffs).

    ``counts`` is read twice and should be materialised. Null languages and sources are groups of
    their own; documents without words fail the base."""
    limits = materialise(thresholds(sketches(counts)), "quality-limits").withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    rows = counts.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    broken = [F.when((_value(sql) > F.col(f"high_{name}")) | (_value(sql) < F.col(f"low_{name}") if below else F.lit(False)), F.lit(name)) for name, (sql, below) in RULES.items()]
    rows = rows.withColumns({"failed_rules": F.array_compact(F.array(*broken)), "base_failed": base_failed()})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_lang", "_source", *[c for c in limits.columns if c.startswith(("low_", "high_"))])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = materialise(measure(docs, "doc_id", "lang", "source"), "quality-counts")
    return judge(counts).select("doc_id", *COUNTS[:5], "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op3_sql() -> str:
    """The same in SQL, from the rules above."""
    gamma = repr(GAMMA)
    value = lambda sql: "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0.0 END".format(*sql.split(" / "))
    edge = lambda up, times: f"CASE WHEN bucket = {ZERO} THEN 0.0 ELSE power({gamma}, bucket + {up}) * {times!r} END"
    at = lambda q, value: f"min(CASE WHEN upto >= ceil(total * {q!r}) THEN {value} END)"
    stats = ("low", "mid", "high", "below", "above", "total")

    def quantile(by: str) -> str:
        keys = f"{by}, " if by else ""
        return f"""SELECT {keys}rule, {at(TAIL, edge(-1.0, 1 - EDGE))} AS low, max(mid) AS mid, {at(1 - TAIL, edge(0.0, 1 + EDGE))} AS high, sum(greatest((mid - value) * n, 0.0)) / max(total) AS below,
          sum(greatest((value - mid) * n, 0.0)) / max(total) AS above, max(total) AS total FROM (
          SELECT *, {at(0.5, "value")} OVER (PARTITION BY {keys}rule) AS mid FROM (
          SELECT {keys}rule, bucket, n, {edge(0.0, 2 / (GAMMA + 1))} AS value, sum(n) OVER (PARTITION BY {keys}rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}rule) AS total
          FROM (SELECT {keys}rule, bucket, sum(n) AS n FROM sketch GROUP BY ALL))) GROUP BY ALL"""

    picked = ", ".join(f"CASE WHEN own.total >= {MIN_GROUP} THEN own.{c} WHEN bylang.total >= {MIN_GROUP} THEN bylang.{c} ELSE whole.{c} END AS {c}" for c in stats)
    rules = " UNION ALL ".join(f"SELECT doc_id, lang, source, n_words, '{name}' AS rule, {str(below).lower()} AS under, {value(sql)} AS x FROM m" for name, (sql, below) in RULES.items())
    order = ", ".join(f"'{name}'" for name in RULES)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS pos, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS gram FROM t WHERE len(w) >= 8),
  g2 AS (SELECT doc_id, pos FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
  r AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS word FROM g2) GROUP BY doc_id),
  l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
  m AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) AS n_echoes FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
  v AS ({rules}),
  sketch AS (SELECT lang, source, rule, CASE WHEN x <= 0 THEN {ZERO} ELSE CAST(ceil(ln(x) / {math.log(GAMMA)!r}) AS INTEGER) END AS bucket, count(*) AS n FROM v WHERE n_words > 0 GROUP BY ALL),
  own AS ({quantile("lang, source")}), bylang AS ({quantile("lang")}), whole AS ({quantile("")}),
  f AS (SELECT own.lang, own.source, own.rule, {picked}
    FROM own JOIN bylang ON own.lang IS NOT DISTINCT FROM bylang.lang AND own.rule = bylang.rule JOIN whole ON own.rule = whole.rule),
  bad AS (SELECT doc_id, list(v.rule ORDER BY list_position([{order}], v.rule)) AS rules FROM v JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.rule = f.rule
    WHERE x > high + {FENCE} * greatest(high - mid, above) OR under AND x < low - {FENCE} * greatest(mid - low, below) GROUP BY doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND rules IS NULL AS kept, coalesce(array_to_string(rules, ','), '') AS failed_rules FROM m LEFT JOIN bad USING (doc_id)
"""
