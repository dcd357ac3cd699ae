"""WARC archives: revisit resolution, writing and reading.

Records are resolved on their headers alone: digests are grouped with a map-side maximum, and
each header is joined to the response chosen for its digest. Archives go out through Spark's own
writer, one archive per value, so they reach any storage that Spark writes to, and a lost task is
written again. Each record is a gzip member of its own, so that a reader can seek it; a file begins with a
warcinfo record and holds ``FILE_BYTES`` of records, or one larger one.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import textbytes as tb
from gleanwork.llm.shared import materialise, scratch

#: Payloads shorter than this are kept whole: a revisit record would save nothing.
MIN_BYTES = 1000
#: Bytes of an archive file's records before compression.
FILE_BYTES = 8 << 20
#: Copies from which a digest counts as hot; its decision is broadcast, that of at most rows / HOT digests.
HOT, SALTS = 10_000, 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member.
NOTHING = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes and payload_digest (SHA-1, lower-case hex) of each page.

    A null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})


def resolve(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Add record_type, refers_to, and for revisits kept_url and unique (whether one row only is the response).

    Of records with an equal digest and at least ``min_bytes``, those with the largest page_id
    are responses; others revisit it. Records without a page_id count as smaller than any.
    Repeated rows with the largest page_id are each a response. Only digests, ids and urls are shuffled
    to choose; the table of repeated digests is written first, so that its size is known when the
    join is planned: broadcast where small. Otherwise the decisions of hot digests are broadcast, their rows
    dealt anywhere, and the rest met by an equi-join without skew.
    """
    big = F.col("payload_bytes") >= min_bytes
    chosen = records.where(big).groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("_n"), F.min("url").alias("_url"))
    chosen = chosen.groupBy("payload_digest").agg(F.max(F.struct("page_id", "_n", "_url")).alias("_best"), F.sum("_n").alias("_copies")).where("_copies > 1")
    chosen = chosen.select(F.col("payload_digest").alias("_digest"), F.col("_best.page_id").alias("_kept"), (F.col("_best._n") == 1).alias("_one"), F.col("_best._url").alias("_url"), "_copies")
    chosen = materialise(chosen, "warc-chosen")
    hot = chosen.where(F.col("_copies") >= HOT).select(F.col("_digest").alias("_hot"))
    rows = records.join(F.broadcast(hot), F.col("payload_digest") == F.col("_hot"), "left")  # rows / HOT digests at most
    # a hot digest's decision is copied SALTS times, and its rows meet one of them
    salts = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(F.lit(0))
    every = F.explode(F.when(F.col("_copies") >= HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    joined = rows.withColumn("_salt", salts.cast("int")).join(chosen.withColumn("_at", every), (F.col("payload_digest") == F.col("_digest")) & (F.col("_salt") == F.col("_at")), "left")
    revisit = big & F.col("_kept").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_kept")))
    out = joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_kept")), "kept_url": F.when(revisit, F.col("_url")), "unique": F.col("_kept").isNotNull() & F.col("_one")})
    return out.drop("_digest", "_kept", "_one", "_url", "_copies", "_hot", "_salt", "_at")


def record_id(digest: str, page: int | None, unique: bool) -> str:
    """A record's id: the response of a repeated payload has one that follows from both, so that revisits can
    name it without a join; any other a new one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{page}') if unique else uuid.uuid4()}>"


def _record(fields: list[tuple[str, object]], body: bytes) -> bytes:
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _member(record: bytes, compression: str) -> bytes:
    if compression == "none":
        return record
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def _archives(compression: str):
    """Files of records, without their last byte, which is the writer's separator of lines: a line end, or,
    of gzip members, the zero that ends a member's size of less than 16 MB."""

    def whole(parts: list[bytes]) -> bytes:
        if compression != "none" and parts[-1][-1]:
            parts.append(NOTHING)
        return b"".join(parts)[:-1]

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            buf, offs = tb.column(batch.column("payload"))
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "kept_url", "unique")]
            for k, (page, url, digest, n, kind, refers, kept_url, unique) in enumerate(zip(*columns, strict=True)):
                revisit = kind == "revisit"
                fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(digest, page, unique and not revisit)), ("WARC-Date", _now()), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if revisit:
                    fields += [("WARC-Refers-To", record_id(digest, refers, True) if unique else None), ("WARC-Refers-To-Target-URI", kept_url), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", refers)]
                fields += [("X-Page", page), ("X-Payload-Length", n), ("Content-Type", "text/html; charset=utf-8")]
                record = _record(fields, b"" if revisit else buf[offs[k] : offs[k + 1]].tobytes())
                if parts and size + len(record) > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([whole(parts)], pa.binary())], ["value"])
                    parts = []
                if not parts:
                    info = b"software: gleanwork\r\nformat: WARC File Format 1.1\r\n"
                    parts, size = [_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("", None, False)), ("WARC-Date", _now()), ("Content-Type", "application/warc-fields")], info), compression)], 0
                parts.append(_member(record, compression))
                size += len(record)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([whole(parts)], pa.binary())], ["value"])

    return run


def write_archives(resolved: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives of resolved records below ``path``, a file a value."""
    rows = resolved.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to", "kept_url", "unique")
    files = rows.mapInArrow(_archives(compression), "value binary").select(F.col("value").cast("string"))  # bytes go through as they are
    files.write.option("lineSep", "\n" if compression == "none" else "\0").option("maxRecordsPerFile", 1).text(path)


def parse(data: bytes):
    """(headers, payload) of each record; a cut or malformed record is an error."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for raw in data[at:stop].split(b"\r\n")[1:]:
            key, _, value = raw.partition(b":")
            fields[key.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        body = data[stop + 4 : stop + 4 + size]
        if len(body) != size:
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, body
        at = stop + 4 + size + 4


def _unzip(data: bytes) -> bytes:
    """All gzip members of a file, or the bytes themselves."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        one = zlib.decompressobj(31)
        parts.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(parts)


READ_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_TYPES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def _read(batches):
    for batch in batches:
        for data in batch.column("content"):
            rows = {name: [] for name in _TYPES.names}
            for head, body in parse(_unzip(data.as_py())):
                if head["warc-type"] == "warcinfo":
                    continue
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                values = (_number(head.get("x-page")), head.get("warc-target-uri"), head["warc-type"], digest, int(head["x-payload-length"]), _number(head.get("x-refers-to-page")), body)
                for name, value in zip(_TYPES.names, values, strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=_TYPES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; payloads of responses are checked against their digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read, READ_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch(spark, "warc")
    records = headers(pages)
    write_archives(resolve(records), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH r AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     m AS (SELECT payload_digest AS d, max(page_id) AS kept FROM r WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM r LEFT JOIN m ON d = payload_digest AND payload_bytes >= 1000
"""
