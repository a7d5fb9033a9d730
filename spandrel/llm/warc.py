"""WARC archives: writing records from pages, reading them, and assembling captures from their records.

Writing makes three records for each page (response or revisit, request, metadata); request and metadata point at the
first by WARC-Concurrent-To.  A record ends with CRLF CRLF, which is just a line separator of Spark's text writer, so
the archives are written (gzipped) by executors through any file system that Spark knows.

Reading parses whole files by Content-Length, so payloads may hold anything, and takes size and digest of a payload from
its bytes.  `captures` groups the records of a capture by their concurrent-to identifiers and emits one nested row for
each, in one pass over the records.

Revisits: of pages with equal payloads of at least `min_revisit_bytes` bytes the one with the largest page_id (of equal
ids any one) is the response.  A revisit has the HTTP head only; its Content-Length and WARC-Payload-Digest are those
of the full payload.

Files: a page of up to SMALL_PAGE bytes shares a file with others, SMALL_RECORDS records at most (so a file unpacks to
350 MB at most); a larger one has a file of its own.  Equal payloads are equally large, so they stay together.

Defined results: null html is an empty payload; a null page_id is the smallest and is null when read; a null url is an
empty target; repeated rows are captures of their own (rows behind a shuffle are written once first, so that their
numbers stay); a very large page is a file by itself, up to the 2 GB of a cell; other columns, whatever their names,
are ignored; an empty table gives no files to read and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, materialize, table

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of a page that shares its file with others, and the records of such a file.
SMALL_PAGE, SMALL_RECORDS = 256 << 10, 4096


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hex digits (four letters) at a time."""
    digest = F.sha1(data)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record(kind: str, record_id: Column, uri: Column, content: str, block: Column, *more: Column) -> Column:
    """Header and block; `more` are further header lines, null where absent."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri), F.lit(f"Content-Type: {content}"), *more, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END), block)


def steady(df: DataFrame) -> DataFrame:
    """The rows, such that numbering them twice gives the same numbers: written once where they come out of a shuffle."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return materialize(df) if re.search(r"\b(Join|Aggregate|Repartition\w*|Rebalance\w*|Sort|Window|Sample|Union|\w*Limit)\b", plan) else df


def records(pages: DataFrame, min_revisit_bytes: int = 0, part_name: str = "") -> DataFrame:
    """A row `value` for each record of the pages (response or revisit, request, metadata); part_name keeps the identifiers of parts of a table apart."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", "").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("uid", F.concat(F.lit(part_name), F.hex(F.monotonically_increasing_id())))
    own = F.concat(F.lit("<urn:capture:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("uid"), F.lit(":"))
    rows = rows.withColumn("own", own)
    first = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.max_by("own", F.struct("page_id", "uid")).alias("leader"), F.count("*").alias("copies"))
    first = first.where("copies > 1").drop("copies")  # most payloads have no copy
    rows = rows.join(first, "digest", "left")
    part = lambda kind: F.concat("own", F.lit(f"{kind}>"))
    is_response = F.col("leader").isNull() | (F.col("leader") == F.col("own"))
    size = F.octet_length("html")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), size.cast("string"), F.lit(_END + _END))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    response = _record("response", part("response"), F.col("url"), "application/http; msgtype=response", F.concat(head, "html"), digest)
    refers = F.concat(F.lit("WARC-Refers-To: "), F.col("leader"), F.lit("response>"))
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    revisit = _record("revisit", part("response"), F.col("url"), "application/http; msgtype=response", head, digest, refers, profile)
    beside = F.concat(F.lit("WARC-Concurrent-To: "), part("response"))
    asked = F.concat(F.lit("GET "), F.when(F.col("url") == "", F.lit("/")).otherwise(F.col("url")), F.lit(f" HTTP/1.1{_END}{_END}"))
    request = _record("request", part("request"), F.col("url"), "application/http; msgtype=request", asked, beside)
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(_END))
    metadata = _record("metadata", part("metadata"), F.col("url"), "application/warc-fields", fields, beside)
    return rows.select(F.explode(F.array(F.when(is_response, response).otherwise(revisit), request, metadata)).alias("value"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, small_page: int = SMALL_PAGE, small_records: int = SMALL_RECORDS) -> None:
    """Write the archives below `path`."""
    pages = steady(pages.select("page_id", "url", "html"))
    large = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) > small_page
    for some, name, most in ((~large, "s", small_records), (large, "l", 3)):
        rows = records(pages.where(some), min_revisit_bytes, name)
        rows.write.mode("append").option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


_HEAD = re.compile(rb"WARC/\d[^\r\n]*\r?\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file, gzipped as one or several members or not."""
    if data[:2] == b"\x1f\x8b":
        out, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            out.append(z.decompress(rest))
            rest = z.unused_data
        data = b"".join(out)
    at = 0
    while m := _HEAD.search(data, at):
        end = data.find(b"\r\n\r\n", m.end())
        if end < 0:
            return
        fields: dict[str, str] = {}
        for line in data[m.end() : end].decode("utf-8", "replace").split("\r\n"):
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields.get("content-length") or 0)
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


RECORD = "record_id string, type string, date string, uri string, concurrent_to string, refers_to string, payload_digest string, http_status int, http_length long, payload binary"


def read_records(spark, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record: identifiers, HTTP status, the payload (HTTP body, or the block), its length and its digest.

    Length and digest are those of the bytes read, but for revisits, which leave their payload out: theirs are said by their headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        types = [pa.int32() if n == "http_status" else pa.int64() if n == "http_length" else pa.binary() if n == "payload" else pa.string() for n in names]
        for batch in batches:
            for blob in batch.column(0):
                rows, held = [], 0
                for f, block in parse_warc(blob.as_py()):
                    status = length = None
                    kind, digest = f.get("warc-type"), f.get("warc-payload-digest")
                    if f.get("content-type", "").startswith("application/http"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        first, *lines = head.decode("latin-1").split("\r\n")
                        if first.startswith("HTTP/"):
                            said = {k.lower().strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                            status, length = int(first.split()[1]), len(body)
                            if kind == "revisit":
                                length = int(said["content-length"]) if said.get("content-length", "").isdigit() else None
                            else:
                                digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
                        block = body
                    rows.append((f.get("warc-record-id"), kind, f.get("warc-date"), f.get("warc-target-uri"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), digest, status, length, block if with_payload or kind == "metadata" else None))
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc,txt}").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def captures(recs: DataFrame) -> DataFrame:
    """One nested row for each response or revisit, with its requests and metadata grouped by their concurrent-to identifiers.

    Records that name no known capture are left out; a capture without request or metadata has empty lists.
    """
    main = F.col("type").isin("response", "revisit")
    nested = recs.withColumn("key", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))).where("key is not null").groupBy("key").agg(
        F.first(F.when(main, F.struct("type", "date", "uri", "refers_to", "payload_digest", "http_status", "http_length", "payload")), ignorenulls=True).alias("response"),
        *[F.collect_list(F.when(F.col("type") == t, F.struct("record_id", "uri", "payload"))).alias(n) for t, n in (("request", "requests"), ("metadata", "metadata"))],
    )
    return nested.where(F.col("response").isNotNull()).select(F.col("key").alias("record_id"), "response", "requests", "metadata")


def _page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, "^<urn:capture:(-?[0-9]+):", 1).try_cast("long")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    nested = materialize(captures(read_records(spark, path, with_payload=False)).select("record_id", "response", "metadata"))
    # a revisit's size and digest are those of the payload it refers to, as read
    of = nested.where("response.type = 'response'").select(F.col("record_id").alias("of"), F.col("response.http_length").alias("of_length"), F.col("response.payload_digest").alias("of_digest"))
    joined = nested.join(of, F.coalesce("response.refers_to", "record_id") == F.col("of"), "left")
    page = F.regexp_extract(F.decode(F.get("metadata", F.lit(0))["payload"], "UTF-8"), "page-id: (-?[0-9]+)", 1).try_cast("long")
    return joined.select(
        page.alias("page_id"),
        F.col("of_length").alias("payload_bytes"),
        F.regexp_replace("of_digest", "^sha1:", "").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        _page_of(F.col("response.refers_to")).alias("refers_to"),
    )


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p),
e AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT)
  + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest FROM d),
m AS (SELECT payload_digest, max(page_id) AS leader FROM e GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM e JOIN m USING (payload_digest)
"""
