"""Index tables: documents, and postings with positions and field lengths.

A document is one row, so its terms are gathered within the row: tokens are sorted with their
positions and cut into runs. Nothing is shuffled to make postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import text as T
from gleanwork.operators import manifest
from gleanwork.schemas import CONTENT, NAME


def map_documents(extracted: DataFrame, profile_id) -> DataFrame:
    """The stored columns of extracted files (path, extension, size_bytes, last_write_time, content,
    content_indexed, skip_reason)."""
    path = T.normalize_path("path")
    name = T.file_name(path)
    content = F.coalesce("content", F.lit(""))
    return extracted.select(
        (profile_id if not isinstance(profile_id, str) else F.lit(profile_id)).alias("profile_id"), path.alias("path"), T.directory(path).alias("directory_path"), name.alias("file_name"), F.lower(name).alias("file_name_lc"),
        F.lower(F.ltrim(F.col("extension"), F.lit("."))).alias("extension"), F.col("size_bytes").cast("long").alias("size_bytes"), "last_write_time", F.coalesce("content_indexed", F.lit(False)).alias("content_indexed"),
        content.alias("content"), "skip_reason", F.size(T.analyze(name)).cast("long").alias("name_len"), F.size(T.analyze(content)).cast("long").alias("content_len"),
    )


def tokens(docs: DataFrame, tokenizer=T.analyze) -> DataFrame:
    """(profile_id, path, field, field_len, pos, term): a row per token, in two narrow passes."""
    parts = []
    for field, column in ((NAME, "file_name"), (CONTENT, "content")):
        toks = docs.select("profile_id", "path", tokenizer(F.col(column)).alias("toks")).withColumn("field_len", F.size("toks").cast("long"))
        parts.append(toks.select("profile_id", F.lit(field).alias("field"), "path", "field_len", F.posexplode("toks").alias("pos", "term")))
    return parts[0].unionByName(parts[1])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def runs(toks: Column, only=None) -> Column:
    """(term, positions) of each distinct token of an array, in time that sorting it takes; of those alone
    that ``only`` holds for where it is given."""

    def cut(pairs: Column) -> Column:
        n = F.size(pairs)
        new = lambda k: (k == 1) | (F.get(pairs, k - 1)["term"] != F.get(pairs, F.greatest(k - 2, F.lit(0)))["term"])
        firsts = F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), new)).otherwise(F.array().cast("array<int>"))
        run = lambda ends: lambda k, j: F.struct(F.get(pairs, k - 1)["term"].alias("term"), F.transform(F.slice(pairs, k, F.coalesce(F.get(ends, j + 1), n + 1) - k), lambda p: p["pos"]).alias("positions"))
        return _let(firsts, lambda ends: F.transform(ends, run(ends)))

    pairs = F.transform(toks, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    return _let(F.array_sort(F.filter(pairs, lambda p: only(p["term"])) if only else pairs), cut)


def postings(docs: DataFrame, tokenizer=T.analyze, only=None, fields: tuple[str, ...] = (NAME, CONTENT)) -> DataFrame:
    """(profile_id, field, term, path, tf, positions, field_len): a row per document, field and term, of the
    terms alone that ``only`` (a function of columns) holds for where it is given."""
    parts = []
    for field in fields:
        column = "file_name" if field == NAME else "content"
        toks = docs.select("profile_id", "path", tokenizer(F.col(column)).alias("toks")).withColumn("field_len", F.size("toks").cast("long"))
        rows = toks.select("profile_id", "path", "field_len", F.explode(runs(F.col("toks"), only)).alias("run"))
        parts.append(rows.select("profile_id", F.lit(field).alias("field"), "run.term", "path", F.size("run.positions").cast("long").alias("tf"), "run.positions", "field_len"))
    return reduce(DataFrame.unionByName, parts)


def frequencies(docs: DataFrame, field: str = CONTENT, tokenizer=T.analyze) -> DataFrame:
    """(term, df): documents that have each term; distinct terms of a row are counted before the one shuffle."""
    column = "file_name" if field == NAME else "content"
    return docs.select(F.explode(F.array_distinct(tokenizer(F.col(column)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def update(docs: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("profile_id", "path"), order: tuple[str, ...] = ()) -> DataFrame:
    """Delete by key, then insert; of a key that ``new`` holds several times, its last row (see ``manifest.latest``)."""
    new = manifest.latest(new, keys, *order)
    return docs.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def remove(docs: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return manifest.delete(docs, gone, key)
