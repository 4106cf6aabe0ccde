"""WARC archives: records of pages with revisits and segments, written and read by Spark.

Writing: a page whose payload an earlier page has becomes a revisit.  A response is an
HTTP message with a chunked body; if it is longer than a segment it is split into a
first record and continuation records.

Reading: continuation records are grouped by the identifier of their origin, ordered by
segment number, checked against the total length, and the chunked framing is undone.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from gzip import GzipFile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import stored

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 2_048    # with SEGMENT_BYTES: a file unpacks to some 35 MB at most
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"
HTTP_HEAD = EOL.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""))
RECORD = ("record_id string, record_type string, page_id long, url string, digest string, refers_to long, "
          "origin_id string, segment int, total_length long, block binary")


# --- writing: column expressions -----------------------------------------------

def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: five bytes, which are ten hex digits, at a time."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 10 * g + 1, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _slices(data: Column, size: int) -> Column:
    """Byte ranges of ``data``: array of binary; none for empty data."""
    count = F.ceil(F.octet_length(data) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(
        data, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def chunked(data: Column, size: int = CHUNK_BYTES) -> Column:
    """Chunked transfer framing of binary ``data``, as bytes in a string."""
    frames = F.transform(_slices(data, size), lambda c: F.concat(
        F.lower(F.hex(F.octet_length(c).cast("long"))), F.lit(EOL), c.cast("string"), F.lit(EOL)))
    return F.concat(F.array_join(frames, ""), F.lit(f"0{EOL}{EOL}"))


def page_records(pages: DataFrame, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per WARC record of ``pages`` (page_id, url, html): its bytes in a string column.

    A null html is an empty payload.  Of pages with equal payloads of at least
    ``min_revisit_bytes`` the smallest page_id is the response; rows of that very id are
    all responses.  Null ids come last and are never referred to unless all are null.
    The smallest ids are found on digests alone; a payload that many pages share is one
    row of that table, and adaptive execution splits its join.
    """
    one_line = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    rows = pages.select("page_id", one_line.alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    firsts = (pages.select("page_id", base32_sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
                   .groupBy("digest").agg(F.min("page_id").alias("first_id")))
    rows = rows.join(firsts, "digest").withColumn("id", F.uuid())
    again = (F.octet_length("payload") >= min_revisit_bytes) & F.col("first_id").isNotNull() & ~F.col(
        "page_id").eqNullSafe(F.col("first_id"))
    block = F.when(again, F.lit(HTTP_HEAD).cast("binary")).otherwise(
        F.concat(F.lit(HTTP_HEAD), chunked(F.col("payload"))).cast("binary"))
    rows = rows.select("page_id", "url", "digest", "id", F.when(again, F.col("first_id")).alias("refers_to"),
                       again.alias("again"), block.alias("block"))
    rows = rows.withColumn("segments", _slices(F.col("block"), segment_bytes))
    rows = rows.select("*", F.size("segments").alias("n"), F.octet_length("block").alias("total"),
                       F.posexplode("segments").alias("at", "segment")).drop("segments", "block")
    first, last, split = F.col("at") == 0, F.col("at") + 1 == F.col("n"), F.col("n") > 1

    def line(name: str, *value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), *value, F.lit(EOL))
        return text if when is None else F.when(when, text)

    kind = F.when(F.col("again"), "revisit").when(first, "response").otherwise("continuation")
    own = F.when(first, F.col("id")).otherwise(F.concat("id", F.lit("-"), (F.col("at") + 1).cast("string")))
    head = F.concat_ws(
        "", F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", kind),
        line("WARC-Record-ID", F.lit("<urn:uuid:"), own, F.lit(">")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url"), when=F.col("url") != ""),
        line("WARC-Page-ID", F.col("page_id").cast("string"), when=F.col("page_id").isNotNull()),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), when=F.col("again")),
        line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string"), when=F.col("again")),
        line("WARC-Segment-Number", (F.col("at") + 1).cast("string"), when=split),
        line("WARC-Segment-Origin-ID", F.lit("<urn:uuid:"), F.col("id"), F.lit(">"), when=split & ~first),
        line("WARC-Segment-Total-Length", F.col("total").cast("string"), when=split & last),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("segment").cast("string")), F.lit(EOL))
    return rows.select(F.concat(head, F.col("segment").cast("string")).alias("record"))


def write_pages(pages: DataFrame, path: str, **options) -> None:
    """Write the records of ``pages`` as gzip-compressed WARC files of bounded size."""
    (page_records(pages, **options).write.option("lineSep", EOL * 2).option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


# --- reading ---------------------------------------------------------------------

def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file."""
    stream = GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.decode("ascii").lower()] = value.strip().decode()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise EOFError("a WARC record ends early")
        yield fields, block


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, chunked framing undone; a message of headers alone has none."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not body or b"transfer-encoding: chunked" not in head.lower():
        return body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2:end + 2 + size])
        if len(parts[-1]) != size:
            raise EOFError("a chunk ends early")
        at = end + 4 + size


def _row(fields: dict[str, str], block: bytes) -> tuple:
    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    return (fields["warc-record-id"], fields["warc-type"], number("warc-page-id"), fields.get("warc-target-uri"),
            fields.get("warc-payload-digest", "").removeprefix("sha1:"), number("warc-refers-to-page-id"),
            fields.get("warc-segment-origin-id", fields["warc-record-id"]), number("warc-segment-number"),
            number("warc-segment-total-length"), block)


def read_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The records that are parts of a segmented one, or those that are whole.

    Whole responses come with their payload as ``block``; files are read record by record.
    """
    names = [part.split()[0] for part in RECORD.split(", ")]
    numbers = ("page_id", "refers_to", "segment", "total_length")

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(dict.fromkeys(numbers, "Int64"))

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for fields, block in records(content):
                    if ("warc-segment-number" in fields) != segmented:
                        continue
                    if not segmented:
                        block = http_payload(block)
                    rows.append(_row(fields, block))
                    size += len(block)
                    if size > 4_000_000:
                        yield frame(rows)
                        rows, size = [], 0
                yield frame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD)


@F.pandas_udf(BinaryType())
def payload_of(blocks: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else http_payload(b) for b in blocks], dtype=object)


def reassembled(parts: DataFrame) -> DataFrame:
    """Whole records from segments: (record_id, record_type, page_id, url, digest, refers_to, payload).

    The group of one origin is one record.  ``payload`` is null where a segment is missing
    or the blocks together are not as long as the last segment says.
    """
    groups = parts.groupBy("origin_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total"),
        F.min(F.when(F.col("segment") == 1, F.struct("record_type", "page_id", "url", "digest", "refers_to"))).alias("head"))
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    whole = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    rows = groups.withColumn("block", F.when(whole, block))
    rows = rows.withColumn("block", F.when(F.octet_length("block") == F.col("total"), F.col("block")))
    return rows.select(F.col("origin_id").alias("record_id"), "head.*", payload_of("block").alias("payload"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: (record_id, record_type, page_id, url, digest, refers_to, payload).

    A revisit has an empty payload and the page_id of the response it repeats.
    """
    whole = read_records(spark, path, segmented=False).select(
        "record_id", "record_type", "page_id", "url", "digest", "refers_to", F.col("block").alias("payload"))
    return whole.unionByName(reassembled(read_records(spark, path, segmented=True)))


def page_digests(read: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of ``read_pages``.

    A revisit takes its figures from the response that it refers to.
    """
    found = stored(read.select(
        "page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest")), "warc-digests")
    again = F.col("record_type") == "revisit"
    responses = (found.filter(~again).select(F.struct("page_id", "payload_bytes", "payload_digest").alias("of"))
                      .dropDuplicates())
    revisits = found.filter(again).select("page_id", "digest", "record_type", "refers_to").join(
        responses, (F.col("refers_to") == F.col("of.page_id")) & (F.col("digest") == F.col("of.payload_digest")), "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return found.filter(~again).select(*columns).unionByName(
        revisits.select("page_id", "of.payload_bytes", "of.payload_digest", "record_type", "refers_to"))
