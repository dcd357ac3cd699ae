"""Registered queries of the search engine over the driver's tables, and their SQL.

Stand-ins: ``documents`` are extracted files (source is the profile, lang the extension), ``pages``
have paths (url) and markup, ``orders`` two snapshots of a manifest, ``events`` observations of
files, ``part`` file names and types, ``conversations`` chapters in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork import catalog
from gleanwork.functions import text as T
from gleanwork.operators import highlight, index, manifest
from gleanwork.plans import planner
from gleanwork.plans.query import Scope, parse
from gleanwork.streaming import ingest

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- stand-ins

SQL_TOKEN = r"'[a-z0-9]+|[^\sa-z0-9]'"
SQL_DOCS = f"""d AS (SELECT doc_id, '/data/' || source || '/doc' || doc_id || '.' || lang AS path, 'doc' || doc_id || '.' || lang AS file_name, source AS profile_id, lang AS extension,
  n_chars, text, regexp_extract_all(lower(coalesce(text, '')), {SQL_TOKEN}) AS toks, regexp_extract_all(lower('doc' || doc_id || '.' || lang), {SQL_TOKEN}) AS name_toks FROM documents)"""
SQL_TF = """p AS (SELECT path, profile_id, term, count(*) AS tf, max(len) AS len FROM (SELECT path, profile_id, unnest(toks) AS term, len(toks) AS len FROM d) GROUP BY ALL),
  n AS (SELECT count(*)::DOUBLE AS n FROM d), df AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as extracted files."""
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("/data/"), "source", F.lit("/doc"), "doc_id", F.lit("."), "lang")
    return d.select(
        F.col("source").alias("profile"), path.alias("path"), F.col("lang").alias("extension"), F.col("n_chars").alias("size_bytes"), F.timestamp_seconds(F.lit(1700000000)).alias("last_write_time"),
        F.col("text").alias("content"), F.lit(True).alias("content_indexed"), F.lit(None).cast("string").alias("skip_reason"),
    )


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return index.map_documents(files(spark, sf), F.col("profile"))


def plan(spark: SparkSession, sf: str, raw: str, scope: Scope = Scope.CONTENT, profiles: tuple[str, ...] = (), norm: str = "exact") -> planner.Plan:
    d = docs(spark, sf)
    if profiles:
        d = d.where(F.col("profile_id").isin(*profiles))
    q = parse(raw, scope)
    return planner.Plan(q, d, made_for(q, d), norm)


def made_for(q, d: DataFrame) -> DataFrame:
    """Postings of documents as far as a query reads them."""
    return index.postings(d, only=planner.wanted(q), fields=planner.fields(q))


def hits(spark: SparkSession, sf: str, raw: str, scope: Scope = Scope.CONTENT) -> DataFrame:
    q = parse(raw, scope)
    d = planner.candidates(docs(spark, sf), q)
    return planner.Plan(q, d, made_for(q, d)).matches(scored=False).select("path")


# ---------------------------------------------------------------- sources, projections, scalars


@query(r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file_name, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '' END AS directory,
  lower(regexp_extract(url, '\.([^./\\]*)$', 1)) AS extension FROM pages""")
def scan_file_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.file_name("url").alias("file_name"), T.directory("url").alias("directory"), T.extension("url").alias("extension"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def ext_filter(spark, sf):
    return table(spark, sf, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id", "lang")


_CATALOG_SQL = "(VALUES " + ", ".join(f"('{e}', '{c}', '{i}', '{s}')" for e, c, i, s in catalog.ROWS) + ") AS c(extension, category, icon_label, strategy)"
_EXT_SQL = "split_part('pdf docx xlsx PPT exe txt .md htm', ' ', CAST(p_partkey % 8 + 1 AS INTEGER))"


@query(f"""SELECT p_partkey, ext, category, coalesce(icon_label, upper(ext)) AS icon_label, strategy
  FROM (SELECT p_partkey, {_EXT_SQL} AS ext FROM part) LEFT JOIN {_CATALOG_SQL} ON c.extension = lower(ltrim(ext, '.'))""")
def catalog_lookup(spark, sf):
    exts = F.array(*[F.lit(e) for e in "pdf docx xlsx PPT exe txt .md htm".split()])
    p = table(spark, sf, "part").select("p_partkey", F.element_at(exts, (F.col("p_partkey") % 8 + 1).cast("int")).alias("ext"))
    return p.select("p_partkey", "ext", catalog.category(F.col("ext")).alias("category"), catalog.icon_label(F.col("ext")).alias("icon_label"), catalog.strategy_of(F.col("ext")).alias("strategy"))


@query("""SELECT doc_id, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown_type' WHEN lang = 'fr' THEN 'name_only' WHEN n_chars > 2000 THEN 'too_large' ELSE 'extract' END AS gate FROM documents""")
def extraction_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", manifest.gate(F.col("lang").isin("en", "de", "fr"), F.col("lang") == "fr", F.col("n_chars"), 2000).alias("gate"))


@query(f"""WITH {SQL_DOCS} SELECT profile_id, path, '/data/' || profile_id AS directory_path, file_name, lower(file_name) AS file_name_lc, extension, n_chars AS size_bytes,
  true AS content_indexed, length(text) AS content_chars, CAST(len(name_toks) AS BIGINT) AS name_len, CAST(len(toks) AS BIGINT) AS content_len FROM d""")
def doc_mapper(spark, sf):
    cols = ["profile_id", "path", "directory_path", "file_name", "file_name_lc", "extension", "size_bytes", "content_indexed"]
    return docs(spark, sf).select(*cols, F.length("content").cast("long").alias("content_chars"), "name_len", "content_len")


@query(r"""SELECT page_id, replace(w, '\', '/') AS path, regexp_replace(replace(w, '\', '/'), '/[^/]*$', '') AS directory FROM (SELECT page_id, replace(url, '/', '\') AS w FROM pages)""")
def path_normalize(spark, sf):
    p = T.normalize_path(F.translate("url", "/", "\\"))
    return table(spark, sf, "pages").select("page_id", p.alias("path"), T.directory(p).alias("directory"))


_FOLDS = {"a/b/c.html": "a/b/c.html", "a/../b.html": "b.html", "./a//b/./c": "a/b/c", "../x": "x", "a\\b\\..\\c": "a/c", "": "", "a/b/../../c": "c", "..": ""}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _FOLDS.items()) + ") AS t(raw, folded)")
def path_fold(spark, sf):
    return spark.createDataFrame([(k,) for k in _FOLDS], "raw string").select("raw", T.fold_path("raw").alias("folded"))


_ENTITIES_SQL = "replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query(f"""SELECT page_id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, regexp_replace({_ENTITIES_SQL}, '[ \\t]{{2,}}', ' ', 'g') AS t
  FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS x FROM pages))""")
def html_strip(spark, sf):
    t = table(spark, sf, "pages").select("page_id", T.strip_tags("html").alias("t"))
    return t.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id")
def spine_concat(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return c.select("conv_id", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("body"))


@query("""SELECT p_partkey, concat_ws(' | ', nullif(trim(p_name), ''), nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_brand END), ''), nullif(trim(p_type), '')) AS line FROM part""")
def row_cells_join(spark, sf):
    brand = F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", T.join_cells("p_name", brand, "p_type").alias("line"))


@query("""SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS BIGINT), 0) AS n FROM events""")
def try_parse_long(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", T.parse_long(raw).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN b >= 1099511627776 THEN format('{:,.1f} TB', b / 1099511627776) WHEN b >= 1073741824 THEN format('{:,.1f} GB', b / 1073741824)
  WHEN b >= 1048576 THEN format('{:,.1f} MB', b / 1048576) WHEN b >= 1024 THEN format('{:,.1f} KB', b / 1024) ELSE format('{:,.0f} B', b) END AS size
  FROM (SELECT l_orderkey, l_linenumber, floor(l_quantity) * (CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN 333 WHEN 2 THEN 77777 WHEN 3 THEN 55555555 ELSE 77777777777 END)::DOUBLE AS b FROM lineitem)""")
def humanize_bytes(spark, sf):
    scale = F.element_at(F.array(*[F.lit(float(x)) for x in (1, 333, 77777, 55555555, 77777777777)]), F.col("l_linenumber") % 5 + 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.humanize_bytes(F.floor("l_quantity") * scale).alias("size"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || ' 时 ' || s % 3600 // 60 || ' 分' WHEN s >= 60 THEN s // 60 || ' 分 ' || s % 60 || ' 秒' ELSE greatest(s, 1) || ' 秒' END AS duration
  FROM (SELECT event_id, CAST(floor(abs(value) * 37) AS BIGINT) AS s FROM events)""")
def humanize_duration(spark, sf):
    return table(spark, sf, "events").select("event_id", T.humanize_seconds(F.abs("value") * 37).alias("duration"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) * 10 + 621355968000000000 AS ticks, epoch_us(o_orderdate) AS back_us FROM orders")
def ticks_roundtrip(spark, sf):
    n = T.ticks("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", n.alias("ticks"), F.unix_micros(T.from_ticks(n)).alias("back_us"))


# ---------------------------------------------------------------- manifest

_PREV = "prev AS (SELECT o_orderkey AS path, o_totalprice AS size_bytes FROM orders WHERE o_orderkey % 10 <> 0)"
_CUR = "cur AS (SELECT o_orderkey AS path, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size_bytes FROM orders WHERE o_orderkey % 13 <> 0)"
_DIFF = f"""{_PREV}, {_CUR}, diff AS (SELECT coalesce(cur.path, prev.path) AS path, CASE WHEN prev.path IS NULL THEN 'Added' WHEN cur.path IS NULL THEN 'Removed'
  WHEN cur.size_bytes = prev.size_bytes THEN 'Unchanged' ELSE 'Updated' END AS status FROM cur FULL JOIN prev ON cur.path = prev.path)"""


def snapshots(spark, sf):
    o = table(spark, sf, "orders")
    prev = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size_bytes"))
    cur = o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("path"), (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("size_bytes"))
    return cur, prev


def changes(spark, sf):
    return manifest.diff(*snapshots(spark, sf), same=("size_bytes",))


@query(f"WITH {_DIFF} SELECT path, status FROM diff")
def manifest_diff(spark, sf):
    return changes(spark, sf)


@query(f"""WITH {_PREV}, {_CUR} SELECT cur.path, CASE WHEN prev.path IS NULL THEN 'Added' ELSE 'Updated' END AS status FROM cur LEFT JOIN prev ON cur.path = prev.path""")
def manifest_diff_full(spark, sf):
    return manifest.diff(*snapshots(spark, sf), same=("size_bytes",), incremental=False)


@query(f"WITH {_PREV}, {_CUR} SELECT path, size_bytes FROM prev WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.path = prev.path)")
def manifest_removed(spark, sf):
    cur, prev = snapshots(spark, sf)
    return manifest.removed(prev, cur)


@query(f"WITH {_PREV} SELECT path, size_bytes FROM prev WHERE path % 4 <> 0")
def manifest_delete(spark, sf):
    _, prev = snapshots(spark, sf)
    return manifest.delete(prev, prev.where("path % 4 = 0"))


_LATEST = "SELECT user_id, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(_LATEST)
def manifest_upsert(spark, sf):
    return manifest.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")


@query(f"WITH {_PREV} SELECT count(*) AS n_records, CAST(coalesce(sum(CAST(floor(size_bytes) AS BIGINT)), 0) AS BIGINT) AS total_size FROM prev")
def manifest_stats(spark, sf):
    _, prev = snapshots(spark, sf)
    return manifest.stats(prev.withColumn("size_bytes", F.floor("size_bytes").cast("long")))


@query(f"""WITH {_DIFF} SELECT count(*) FILTER (status = 'Added') AS added, count(*) FILTER (status = 'Updated') AS updated, count(*) FILTER (status = 'Removed') AS removed,
  count(*) FILTER (status = 'Unchanged') AS unchanged, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status NOT IN ('Removed', 'Failed')) AS final_count FROM diff""")
def index_summary(spark, sf):
    return manifest.summary(changes(spark, sf))


@query(f"""WITH {_DIFF} SELECT path, status, CAST(sum(CASE WHEN status <> 'Removed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS scanned, CAST(sum(CASE WHEN status = 'Unchanged' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS unchanged_so_far,
  CAST(sum(CASE WHEN status = 'Removed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS removed_so_far FROM diff WINDOW w AS (ORDER BY path ROWS UNBOUNDED PRECEDING)""")
def progress_running(spark, sf):
    return manifest.progress(changes(spark, sf), "path")


@query(f"""WITH {_DIFF} SELECT CAST(floor((rn - 1) / 500) AS BIGINT) AS batch, count(*) AS n_writes FROM (SELECT row_number() OVER (ORDER BY path) AS rn FROM diff WHERE status <> 'Unchanged') GROUP BY 1""")
def commit_batches(spark, sf):
    return manifest.commit_batches(changes(spark, sf).where("status <> 'Unchanged'"), "path")


@query("""SELECT o_orderkey, CASE WHEN m > 0 THEN least(100.0, 100.0 * done / m) ELSE 0.0 END AS percent, CASE WHEN done > 0 AND secs > 0 THEN greatest(total - done, 0) / (done / secs) END AS eta
  FROM (SELECT o_orderkey, CAST(o_orderkey % 97 AS DOUBLE) AS done, CAST(o_orderkey % 89 AS DOUBLE) AS total, CAST(o_orderkey % 31 AS DOUBLE) AS secs, greatest(o_orderkey % 97, o_orderkey % 89) AS m FROM orders)""")
def eta_projection(spark, sf):
    d, t, s = (F.col("o_orderkey").cast("double") % k for k in (97, 89, 31))
    return table(spark, sf, "orders").select("o_orderkey", T.percent_done(d, t).alias("percent"), T.eta_seconds(d, t, s).alias("eta"))


_COMBOS = [(r, i, n) for r in (True, False) for i in (True, False) for n in (0, 3)]


@query("""SELECT root_exists, index_exists, file_count, CASE WHEN root_exists AND index_exists AND file_count > 0 THEN 'Ok' WHEN root_exists THEN 'NeedsUpdate' ELSE 'SourceUnavailable' END AS status FROM (VALUES """ + ", ".join(f"({r}, {i}, {n})" for r, i, n in _COMBOS) + ") AS t(root_exists, index_exists, file_count)")
def status_eval(spark, sf):
    t = spark.createDataFrame(_COMBOS, "root_exists boolean, index_exists boolean, file_count int")
    return t.withColumn("status", manifest.evaluate_status(F.col("root_exists"), F.col("index_exists"), F.col("file_count")))


_STATES = [*T.STATUS_TEXT, "other"]


@query("SELECT status, CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STATUS_TEXT.items()) + f" ELSE '{T.STATUS_TEXT_ELSE}' END AS text, CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STATUS_BRUSH.items())
       + f" ELSE '{T.STATUS_BRUSH_ELSE}' END AS brush FROM (VALUES " + ", ".join(f"('{s}')" for s in _STATES) + ") AS t(status)")
def status_labels(spark, sf):
    return spark.createDataFrame([(s,) for s in _STATES], "status string").select("status", T.status_text("status").alias("text"), T.status_brush("status").alias("brush"))


@query(f"SELECT doc_id, CASE WHEN quality = 1 THEN '{T.NO_FRAGMENT}' ELSE '{T.NO_PREVIEW}' END AS hint FROM labels")
def preview_hint(spark, sf):
    return table(spark, sf, "labels").select("doc_id", T.preview_hint(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("hint"))


# ---------------------------------------------------------------- index


@query(f"WITH {SQL_DOCS} SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, '|')) AS digest FROM d")
def tokens_by_doc(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.analyze("text").alias("toks"))
    return t.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.md5(F.array_join("toks", "|")).alias("digest"))


@query(f"WITH {SQL_DOCS} SELECT path, CAST(len(name_toks) AS BIGINT) AS name_len, CAST(len(toks) AS BIGINT) AS content_len FROM d")
def doc_length(spark, sf):
    return docs(spark, sf).select("path", "name_len", "content_len")


@query(f"""WITH {SQL_DOCS} SELECT path, term, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT path, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM d) GROUP BY ALL""")
def postings_tf(spark, sf):
    p = index.postings(docs(spark, sf)).where("field = 'content'")
    return p.select("path", "term", "tf", F.element_at("positions", 1).cast("long").alias("first_pos"), F.element_at("positions", -1).cast("long").alias("last_pos"))


@query(f"WITH {SQL_DOCS} SELECT term, count(DISTINCT path) AS df FROM (SELECT path, unnest(toks) AS term FROM d) GROUP BY term")
def doc_freq(spark, sf):
    return index.frequencies(docs(spark, sf))


@query("SELECT count(DISTINCT doc_id) AS n FROM documents")
def num_docs(spark, sf):
    return table(spark, sf, "documents").agg(F.countDistinct("doc_id").alias("n"))


@query("""WITH new AS (SELECT doc_id, 'v2:' || lang AS content FROM documents WHERE doc_id % 5 = 0), old AS (SELECT doc_id, lang AS content FROM documents)
  SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.doc_id = old.doc_id) UNION ALL SELECT * FROM new""")
def index_update_replace(spark, sf):
    old = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("content"))
    return index.update(old, old.where("doc_id % 5 = 0").withColumn("content", F.concat(F.lit("v2:"), "content")), ("doc_id",))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 6 <> 0")
def index_delete(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return index.remove(d, d.where("doc_id % 6 = 0"), "doc_id")


# ---------------------------------------------------------------- search


@query(f"WITH {SQL_DOCS} SELECT path FROM d WHERE list_contains(toks, 'scum')")
def search_term(spark, sf):
    return hits(spark, sf, "scum")


@query(f"WITH {SQL_DOCS} SELECT path FROM d WHERE list_contains(toks, 'the') AND list_contains(toks, 'from') AND list_contains(toks, 'what')")
def search_and_terms(spark, sf):
    return hits(spark, sf, "the FROM what")


@query(f"WITH {SQL_DOCS} SELECT path FROM d WHERE list_contains(toks, 'de') OR list_contains(name_toks, 'de')")
def search_field_or(spark, sf):
    return hits(spark, sf, "de", Scope.BOTH)


def _phrase_sql(*words: str) -> str:
    joins = " ".join(f"JOIN t t{i} ON t{i}.path = t0.path AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"WITH {SQL_DOCS}, t AS (SELECT path, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM d) SELECT DISTINCT t0.path FROM t t0 {joins} WHERE t0.term = '{words[0]}'"


@query(_phrase_sql("of", "the"))
def search_phrase2(spark, sf):
    return hits(spark, sf, '"of the"')


@query(_phrase_sql("the", "and", "attion"))
def search_phrase3(spark, sf):
    return hits(spark, sf, '"the and attion"')


@query(f"WITH {SQL_DOCS} SELECT path FROM d WHERE list_contains(toks, 'the') AND NOT list_contains(toks, 'and')")
def search_exclude(spark, sf):
    return hits(spark, sf, "the -and")


@query(f"WITH {SQL_DOCS} SELECT path FROM d WHERE NOT list_contains(toks, 'the')")
def search_pure_negative(spark, sf):
    return hits(spark, sf, "-the")


@query(f"WITH {SQL_DOCS} SELECT DISTINCT path FROM (SELECT path, unnest(toks) AS term FROM d) WHERE regexp_full_match(term, 'th.*er.')")
def search_wildcard_star(spark, sf):
    return hits(spark, sf, "th*er?")


@query(f"WITH {SQL_DOCS} SELECT DISTINCT path FROM (SELECT path, unnest(toks) AS term FROM d) WHERE regexp_full_match(term, '.o.')")
def search_wildcard_qmark(spark, sf):
    return hits(spark, sf, "?o?")


@query(f"WITH {SQL_DOCS} SELECT path FROM d WHERE file_name LIKE '%.fr' OR len(list_filter(toks, lambda t: regexp_full_match(t, '.*\\.fr'))) > 0")
def search_wildcard_any(spark, sf):
    return hits(spark, sf, "*.fr", Scope.BOTH)


@query(f"WITH {SQL_DOCS} SELECT path FROM d WHERE file_name LIKE 'doc1%'")
def search_wildcard_name(spark, sf):
    return hits(spark, sf, "filename:DOC1*")


@query(f"WITH {SQL_DOCS} SELECT path FROM d WHERE list_contains(name_toks, 'en') AND list_contains(toks, 'scum')")
def search_prefix_scope(spark, sf):
    return hits(spark, sf, "filename:en content:scum", Scope.BOTH)


@query("SELECT CAST(NULL AS VARCHAR) AS path FROM documents WHERE false")
def search_empty(spark, sf):
    assert parse("  　 \"\"") is None
    return planner.none(docs(spark, sf)).select("path")


_SCORE = "sum(sqrt(tf) * power(1 + ln(n / (df + 1)), 2) / sqrt(len))"


def _topk_sql(words: list[str], where: str = "", weight: str = _SCORE, limit: int = 200) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    docs_sql = SQL_DOCS if not where else SQL_DOCS.replace("FROM documents", f"FROM documents WHERE {where}")
    return f"""WITH {docs_sql}, {SQL_TF} SELECT profile_id, path, round({weight}, 6) AS score FROM p JOIN df USING (term), n WHERE term IN ({listed})
      GROUP BY profile_id, path HAVING count(*) = {len(words)} ORDER BY round({weight}, 6) DESC, profile_id, path LIMIT {limit}"""


def _topk(p: planner.Plan, k: int = planner.TOP) -> DataFrame:
    return planner.top(p.matches().withColumn("score", F.round("score", 6)), k)


@query(_topk_sql(["the", "and", "to"]))
def search_topk(spark, sf):
    return _topk(plan(spark, sf, "the AND to"))


_BYTE_NORM = "(floor(power(2, -log2(sqrt(len)) - floor(-log2(sqrt(len)) + 1e-12)) * 4 + 1e-9) / 4 * power(2, floor(-log2(sqrt(len)) + 1e-12)))"


@query(_topk_sql(["the", "and"], weight=f"sum(sqrt(tf) * power(1 + ln(n / (df + 1)), 2) * {_BYTE_NORM})"))
def search_topk_lucene_norm(spark, sf):
    return _topk(plan(spark, sf, "the and", norm="lucene"))


@query(f"WITH {SQL_DOCS} SELECT count(*) AS total_hits FROM d WHERE list_contains(toks, 'the') AND list_contains(toks, 'and')")
def search_total_hits(spark, sf):
    return hits(spark, sf, "the and").agg(F.count(F.lit(1)).alias("total_hits"))


@query(_topk_sql(["the", "and"], "source IN ('src1', 'src3', 'src5')"))
def multi_profile_search(spark, sf):
    return _topk(plan(spark, sf, "the and", profiles=("src1", "src3", "src5")))


@query(f"SELECT t.* FROM ({_topk_sql(['de', 'la'])}) t WHERE path LIKE '%.fr'")
def category_post_filter(spark, sf):
    return _topk(plan(spark, sf, "de la")).where(T.extension("path") == "fr")


# ---------------------------------------------------------------- highlights

_MARK = r"regexp_replace(p_name, '\b(red|part|a|blue)\b', '<mark>\1</mark>', 'gi')"


@query(rf"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)\b(red|part|a|blue)\b') THEN {_MARK} END AS marked FROM part")
def highlight_filename(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.highlight_words("p_name", ["red", "part", "a", "blue"]).alias("marked"))


@query(f"""SELECT doc_id, number, fragment, n_terms FROM (SELECT doc_id, i AS number, s AS fragment, CAST(len(list_intersect(['the', 'from', 'what', 'and'], regexp_extract_all(lower(s), {SQL_TOKEN}))) AS BIGINT) AS n_terms
  FROM (SELECT doc_id, i, substring(text, i * 80 + 1, 80) AS s FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil(length(text) / 80.0) AS BIGINT), 1))) AS i FROM documents WHERE text IS NOT NULL)))
  WHERE n_terms > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_terms DESC, number) = 1""")
def highlight_fragment(spark, sf):
    best = highlight.slice_fragments(F.col("text"), ["the", "from", "what", "and"], T.analyze)
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", best.alias("b")).where("b.n_terms > 0")
    return d.select("doc_id", F.col("b.number").cast("long").alias("number"), F.col("b.text").alias("fragment"), F.col("b.n_terms").cast("long").alias("n_terms"))


@query(r"""WITH m AS (SELECT p_partkey, 'x ' || regexp_replace(p_name, '([aeiou]+)', '<mark>\1</mark>', 'g') || ' y' AS s FROM part),
  s AS (SELECT p_partkey, unnest(regexp_split_to_array(s, '</?mark>')) AS text, generate_subscripts(regexp_split_to_array(s, '</?mark>'), 1) AS i FROM m)
  SELECT p_partkey, text, i % 2 = 0 AS is_highlighted, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS BIGINT) AS pos FROM s WHERE text <> ''""")
def highlight_parse(spark, sf):
    m = F.concat(F.lit("x "), F.regexp_replace("p_name", "([aeiou]+)", "<mark>$1</mark>"), F.lit(" y"))
    segs = table(spark, sf, "part").select("p_partkey", F.posexplode(T.parse_highlight(m)).alias("pos", "s"))
    return segs.select("p_partkey", "s.text", "s.is_highlighted", F.col("pos").cast("long").alias("pos"))


@query(_LATEST)
def stream_manifest_upsert(spark, sf):
    return ingest.latest_stream(spark, f"{sf}/events.parquet", "user_id", ("ts", "event_id"), ("user_id", "ts", "event_id", "value"))
