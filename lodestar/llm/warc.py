"""WARC transaction assembly (operator 3): archives written and read through Spark's own readers.

write_archives() gives every page a request, a response or revisit, and a metadata record; the request
and the metadata name the response in WARC-Concurrent-To. Records are lines of Spark's text writer whose
separator is the blank line pair that ends a WARC record, so the files are WARC files, gzipped as a
whole, in any store that Spark can write. Pages are written by classes of size, each with as many records
to a file as FILE_BYTES allow. read_records() parses files that Spark's binary reader brings, each in one
task, which unzips PIECE bytes at a time and so holds the zipped file and a record. captures() joins the records of a transaction through
their concurrent-to identifiers into one nested row, by one aggregation that keeps a value per kind.

Of records with equal payloads (SHA-1 and length) of SMALLEST bytes or more, that with the largest
page_id is the response and the others revisit it. Only digests are grouped, combined before the
shuffle; payloads meet their decision by a join whose hot keys adaptive execution splits.

Cases: a null html is an empty payload; a null url an empty target; a null page_id is the smallest;
rows with the same page_id are records of their own, and of those with the largest one is the response;
control characters in urls are escaped in headers and kept in the metadata; an empty table gives no
records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_path

SMALLEST = 1000
#: Bytes of pages in a file before it is zipped, at most, but for a page that is longer; bytes unzipped at once.
FILE_BYTES, PIECE = 64 << 20, 1 << 20
#: Pages below 4 kB, 16 kB and so on are written together; those above the last bound have a file each.
SIZES = [4096 * 4**i for i in range(7)]
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def _uuid(kind: str, page: str = "page_id", row: str = "row") -> Column:
    """A record's identifier: a hash of its kind, page and row, as a URN."""
    h = F.md5(F.concat_ws(":", F.lit(kind), F.col(row).cast("string"), F.col(page).cast("string")))
    parts = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, fields: list[tuple[str, Column]], kind_of_content: str, block: Column) -> Column:
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in fields:
        head += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    head += [
        F.lit(f"Content-Type: {kind_of_content}\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    ]
    return F.concat(*head, block)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes pages(page_id, url, html) as WARC files under path."""
    rows = pages.select(
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html")})
    rows, rows_path = cut(rows, "pages")  # so that all that follows sees the same row numbers
    # A row that repeats payload of its digest: the largest page_id, then row, is the response.
    place = F.struct("page_id", "row")
    groups = rows.where(F.col("size") >= SMALLEST).groupBy("digest", "size")
    groups = groups.agg(F.max(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups, groups_path = cut(groups.select("digest", "size", F.col("first.page_id").alias("to_page"), F.col("first.row").alias("to_row")), "payloads")
    rows = rows.join(groups, ["digest", "size"], "left")
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    host = F.regexp_extract(uri, r"^[a-zA-Z]+://([^/?#]*)", 1)
    target = F.regexp_replace(uri, r"^[a-zA-Z]+://[^/?#]*", "")
    response_id = _uuid("response")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(END),
    )
    common = [
        ("WARC-Record-ID", response_id),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
    ]
    refers = [("WARC-Refers-To", _uuid("response", "to_page", "to_row")), ("WARC-Profile", F.lit(PROFILE))]
    revisit = F.col("to_row").isNotNull() & (F.col("to_row") != F.col("row"))
    message = "application/http; msgtype="
    response = F.when(revisit, _record("revisit", common + refers, message + "response", http)).otherwise(
        _record("response", common, message + "response", F.concat(http, "html"))
    )
    beside = [("WARC-Concurrent-To", response_id), ("WARC-Target-URI", uri)]
    get = F.concat(
        F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)
    )
    request = _record("request", [("WARC-Record-ID", _uuid("request")), *beside], message + "request", get)
    about = F.concat(F.lit("page: "), F.to_json(F.struct("page_id", "url")), F.lit("\r\n"))
    metadata = _record(
        "metadata", [("WARC-Record-ID", _uuid("metadata")), *beside], "application/warc-fields", about
    )
    records = rows.select("size", F.explode(F.array(request, response, metadata)).alias("value"))
    classes = F.lit(len(SIZES))
    for i, most in reversed(list(enumerate(SIZES))):
        classes = F.when(F.col("size") < most, i).otherwise(classes)
    found = [r[0] for r in rows.select(classes).distinct().collect()]  # as many as there are classes, at most
    for i in sorted(found) or [0]:
        low, most = ([0, *SIZES][i], SIZES[i] if i < len(SIZES) else 2**31)
        own = records.where((F.col("size") >= low) & (F.col("size") < most)).select("value")
        pages_of = max(1, FILE_BYTES // most)
        writer = own.write.mode("append").option("lineSep", END).option("compression", "gzip")
        writer.option("maxRecordsPerFile", 3 * pages_of).text(path)
    for p in (rows_path, groups_path):
        drop_path(pages.sparkSession, p)


def unzipped(data: bytes) -> Iterator[bytes]:
    """Pieces of one gzip member or several."""
    while data:
        z = zlib.decompressobj(31)
        while not z.eof and data:
            yield z.decompress(data, PIECE)
            data = z.unconsumed_tail
        if not z.eof:
            raise ValueError("a gzip member ends too early")
        data = z.unused_data


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in small letters) and block of each record of an uncompressed archive."""
    held, at, source = bytearray(), 0, iter(pieces)

    def more() -> bool:
        nonlocal at
        piece = next(source, None)
        if piece is not None:
            del held[:at]
            at = 0
            held.extend(piece)
        return piece is not None

    def have(n: int) -> None:
        while len(held) - at < n:
            if not more():
                raise ValueError("an archive ends within a record")

    while len(held) > at or more():
        if len(held) == at:
            continue
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            have(len(held) - at + 1)
        lines = held[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        at = end + 4
        size = int(head["content-length"])
        have(size + 4)
        block = bytes(held[at : at + size])
        if held[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        at += size + 4
        yield head, block


RECORDS = (
    "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes long, page_id long, url string, payload binary"
)


def _row(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = head["warc-type"]
    digest, size, page, url, payload = head.get("warc-payload-digest"), None, None, None, None
    if kind in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            size = len(body)
            if digest != "sha1:" + hashlib.sha1(body).hexdigest():
                raise ValueError(f"the payload of {head['warc-record-id']} doesn't have its digest")
            payload = body if payloads else None
        else:
            size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = digest.removeprefix("sha1:")
    elif kind == "metadata":
        about = json.loads(block.decode().removeprefix("page: "))
        page, url = about.get("page_id"), about.get("url")
    return (
        kind,
        head["warc-record-id"],
        head.get("warc-concurrent-to"),
        head.get("warc-refers-to"),
        head.get("warc-target-uri"),
        digest,
        size,
        page,
        url,
        payload,
    )


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under path; with payloads, responses carry theirs."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for head, block in parse(unzipped(content.as_py())):
                    rows.append(_row(head, block, payloads))
                    size += len(rows[-1][-1] or b"")
                    if len(rows) >= 10_000 or size > 16 << 20:
                        yield batched(rows)
                        rows, size = [], 0
                if rows:
                    yield batched(rows)

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=schema.names
        )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: what a response or revisit, its request and its metadata say."""
    about = F.struct("record_id", "target_uri")
    response = F.struct("warc_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "refers_to")
    kind = F.col("warc_type")
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.max(F.when(kind == "request", about)).alias("request"),
        F.max(F.when(kind.isin("response", "revisit"), response)).alias("response"),
        F.max(F.when(kind == "metadata", F.struct("page_id", "url", "record_id"))).alias("metadata"),
    )


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, capture) read back from path."""
    whole, _ = cut(captures(read_records(spark, path)), "captures")
    wanted = whole.where("response.refers_to IS NOT NULL").select(F.col("response.refers_to").alias("id")).distinct()
    pages = whole.select(F.col("capture_id").alias("id"), F.col("metadata.page_id").alias("refers_to"))
    named, _ = cut(pages.join(wanted, "id", "left_semi"), "referred")
    # Captures that refer to none are dealt out by their own identifiers, not as nulls to one task.
    key = F.coalesce("response.refers_to", "capture_id")
    out = whole.withColumn("_key", key).join(named.withColumnRenamed("refers_to", "to"), F.col("_key") == F.col("id"), "left")
    out = out.withColumn("refers_to", F.when(F.col("response.refers_to").isNotNull(), F.col("to")))
    return out.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        "refers_to",
        F.struct("capture_id", "request", "response", "metadata").alias("capture"),
    )
