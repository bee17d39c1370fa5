r"""Op 10: WARC archives, written by Spark's text sink and read back into one nested row per capture.

A capture has three records: the request, the response (or a revisit of an equal payload) and the metadata; the
request and the metadata name the response in WARC-Concurrent-To, and a revisit names the response that holds its
payload in WARC-Refers-To. The reader parses the records of each file by their Content-Length and joins them by
these identifiers.

Records are text (payloads are UTF-8), separated by the format's CR LF CR LF, and each file is compressed as a whole,
since the sink makes one stream a file; the reader takes files of one stream a record as well. It holds a file's
compressed bytes and unpacks record by record, so memory is bounded by the file and its largest record. Files hold
about `file_bytes` of records by the mean record size.

Of records whose payloads are equal and at least `min_bytes` long, one of the largest page_id is the response; the
rest are revisits of it, but for repeated rows of that page_id, which are all responses. Shorter ones are responses. A
null html is an empty payload. A null page_id is never the largest unless all are null, when all are responses. Line
breaks in a url become %0D and %0A. Very large payloads are single records. No rows yield no captures. Columns other
than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, stage

CRLF = "\r\n"
RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, refers_to_record string, page_id long, payload binary, payload_bytes long, payload_digest string"
STEP, BATCH = 1 << 20, 8 << 20  # bytes unpacked at once, and of records in an Arrow batch


def urn(kind: str, number):
    """A record's identifier from its kind and the number of its page's row."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), number.cast("string")).cast("binary"))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """pages with n (a number per row), payload, payload_bytes, payload_digest and, for a revisit, kept_n and kept_page, the response's.

    Only digests, lengths and ids are grouped and joined, digests that occur once not at all.
    """
    full = pages.select(F.monotonically_increasing_id().alias("n"), "page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    full = stage(full.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))}), "warc-pages")
    groups = full.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
    kept = groups.agg(F.max_by("n", "page_id").alias("kept_n"), F.max("page_id").alias("kept_page"), F.count("*").alias("n")).where("n > 1 AND kept_page IS NOT NULL")
    joined = join_hot(full.withColumnRenamed("n", "row_n"), stage(kept, "warc-copies"), "payload_digest").withColumnRenamed("row_n", "n")
    own = F.col("page_id").eqNullSafe(F.col("kept_page"))
    return joined.withColumns({c: F.when(~own, F.col(c)) for c in ("kept_n", "kept_page")})


def _record(kind, record_id, headers: list, block):
    """A record's text: the named headers that aren't null, the length and the block."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 1000, file_bytes: int = 64 << 20) -> None:
    """Writes the archives (.gz) of pages (page_id, url, html). date: that of all records, since pages have none."""
    rows = plan_records(pages, min_bytes)
    mean = rows.agg(F.avg(F.col("payload_bytes") + 1500)).first()[0] or file_bytes  # about 1,500 bytes of headers a capture
    request_id, response_id, metadata_id = (urn(kind, F.col("n")) for kind in ("request", "response", "metadata"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    date_uri = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("kept_n").isNotNull()
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        response_id,
        [*date_uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), ("WARC-Profile", profile), ("WARC-Refers-To", F.when(revisit, urn("response", F.col("kept_n"))))],
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    request = _record(F.lit("request"), request_id, [*date_uri, ("WARC-Concurrent-To", response_id)], F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF * 2}")))
    metadata = _record(F.lit("metadata"), metadata_id, [*date_uri, ("WARC-Concurrent-To", response_id)], F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    per_file = max(3, int(3 * file_bytes / mean))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def unpacked(data) -> Iterator[bytes]:
    """The content of gzip streams one after the other, in steps."""
    view, at = memoryview(data), 0
    while at < len(view):
        stream = zlib.decompressobj(31)
        while not stream.eof:
            held = view[at : at + STEP]
            out = stream.decompress(held, STEP)
            at += len(held) - len(stream.unconsumed_tail) - len(stream.unused_data)
            if out:
                yield out
            elif not held and not stream.eof:
                raise ValueError("the archive ends within a stream")


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """The records of an archive as (headers by lower-case name, block). chunks: its uncompressed bytes."""
    held = bytearray()

    def more() -> bool:
        chunk = next(chunks, b"")
        held.extend(chunk)
        return bool(chunk)

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's headers")
                return
        lines = held[:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record begins where the last one ends")
        headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
        begin, size = end + 4, int(headers["content-length"])
        while len(held) < begin + size + 4 and more():
            pass
        if len(held) < begin + size:
            raise ValueError("the archive ends within a record")
        yield headers, bytes(held[begin : begin + size])
        del held[: begin + size + 4]


def _row(headers: dict, block: bytes) -> tuple:
    kind, page, payload, size, digest = headers["warc-type"], None, None, None, None
    if kind == "metadata":
        page = int(block.partition(b": ")[2]) if block.strip() != b"page_id:" else None
    elif kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if f"sha1:{digest}" != headers["warc-payload-digest"]:
            raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its digest")
    elif kind == "revisit":
        http = block.partition(b"\r\n\r\n")[0]
        size, digest = int(http.lower().partition(b"content-length: ")[2].split(b"\r\n")[0]), headers["warc-payload-digest"].removeprefix("sha1:")
    return headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), page, payload, size, digest


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in parse(unpacked(content.as_buffer())):
                    rows.append(_row(headers, block))
                    size += len(block) + 1000
                    if size >= BATCH:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with its request and metadata (null if missing).

    All records of a capture are grouped by the response's identifier at once; of several requests or metadata of
    a response those of the least identifier stay. `refers_to` is the page of the response that a revisit refers to. records
    is read twice, so it is best a written table.
    """
    of = lambda kind, c: F.first(F.when(kind, F.col(c)), ignorenulls=True)
    own_id = lambda kind: F.min(F.when(F.col("record_type") == kind, F.col("record_id")))
    page = F.min(F.when(F.col("record_type") == "metadata", F.struct("record_id", "page_id")))["page_id"]
    fields = ("record_type", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to_record")
    grouped = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("record_id")).agg(
        *(of(F.col("record_type").isin("response", "revisit"), c).alias(c) for c in fields), own_id("request").alias("request_id"), own_id("metadata").alias("metadata_id"), page.alias("page_id")
    )
    grouped = grouped.where("record_type IS NOT NULL")
    pages = records.where("record_type = 'metadata'").groupBy(F.col("concurrent_to").alias("refers_to_record")).agg(F.min(F.struct("record_id", "page_id"))["page_id"].alias("refers_to"))
    asked = records.where("record_type = 'revisit'").groupBy("refers_to_record").agg(F.count("*").alias("n"))
    found = stage(asked.join(pages, "refers_to_record"), "warc-referred")
    rows = join_hot(grouped.where("record_type = 'revisit'"), found, "refers_to_record").unionByName(grouped.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")))
    return rows.select(
        "target_uri",
        F.when(F.col("request_id").isNotNull(), F.struct(F.col("request_id").alias("record_id"))).alias("request"),
        F.struct("record_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to_record", "refers_to").alias("response"),
        F.when(F.col("metadata_id").isNotNull(), F.struct(F.col("metadata_id").alias("record_id"), "page_id")).alias("metadata"),
    )


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to FROM k
"""
