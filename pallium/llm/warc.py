"""WARC archives: records written by Spark's text sink, read back whole, and assembled into captures.

Writing: each record is its header, a blank line and its block; the text sink's line separator is the pair of
line ends that closes a record, so the files are plain WARC/1.1 made by Spark's own commit protocol on any file
system that Spark can write.  Reading: files plain or gzip by magic bytes, decompressed bit by bit and parsed by
Content-Length; the SHA-256 of each payload read is computed and held against its header.  Pages are written by size
classes, each with so many records a file that none is larger than FILE_BYTES, or one record.

Transaction assembly: request and metadata records name the response or revisit record they belong to in
WARC-Concurrent-To.  They are gathered by that identifier and joined to it; a capture is one nested row.

Defined results: null html is an empty payload; null ids are kept and never a revisit's target; repeated rows
with the smallest id of their payload are all responses; line ends in urls are percent-encoded; requests and
metadata that name no known record are returned by `unlinked`; a payload that differs from its header's digest is an
error, as is a cut archive; texts are kept whole at any length; other columns are not read; an empty table gives an
empty archive and no row.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pallium.llm.common import saved, scratch_path

CRLF = "\r\n"
#: Payloads from this many bytes on are stored once.
REVISIT_BYTES = 100
#: Bytes of one file before compression, about, and the largest payload of each size class; beyond them a file holds one record.
FILE_BYTES, CLASSES = 192 << 20, (64 << 10, 4 << 20)
#: Bytes that are decompressed at once.
STREAM_BYTES = 1 << 20
#: Payloads with copies that are broadcast at most, 25 MB of them.
BROADCAST_HEADS = 200_000
#: Parts of a payload's copies when there are more heads than that.
SALTS = 64
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def _headers(*pairs) -> "F.Column":
    """Header lines; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in pairs]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit(CRLF))


def transactions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Three WARC records for each page as text: its response or revisit, its request and its metadata."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload").cast("long")})
    # only payloads that occur again need a head; few of those are sent to the pages, many meet them in a shuffle
    heads = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    heads = saved(heads, "heads")
    if heads.count() <= BROADCAST_HEADS:
        rows = rows.join(F.broadcast(heads), "digest", "left")
    else:  # the many copies of one payload meet its head in SALTS tasks
        salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    revisit = F.coalesce((F.col("head") != F.col("id")) | (F.col("id").isNull() & F.col("head").isNotNull()), F.lit(False))
    # the number that Spark gives a row of this job tells apart repeated rows
    key = F.concat_ws(":", F.lit("urn:capture"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumns({"revisit": revisit, "key": key})

    def uri(kind):
        return F.concat(F.lit("<"), F.col("key"), F.lit(f":{kind}>"))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2)
    )
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    main_block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("payload")))
    target = F.when(F.col("revisit"), F.concat(F.lit("<urn:capture:"), F.col("head").cast("string"), F.lit(">")))
    main_id = uri("response")
    ask = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}User-Agent: pallium{CRLF * 2}"))
    note = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF))
    length = lambda block: F.octet_length(block).cast("string")
    common = lambda name, block: [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE)), ("Content-Type", F.lit(name)), ("Content-Length", length(block))]
    main = F.concat(
        _headers(
            ("WARC-Type", kind),
            ("WARC-Record-ID", main_id),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Refers-To", target),
            ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
            *common("application/http; msgtype=response", main_block),
        ),
        main_block,
    )
    request = F.concat(
        _headers(("WARC-Type", F.lit("request")), ("WARC-Record-ID", uri("request")), ("WARC-Concurrent-To", main_id), *common("application/http; msgtype=request", ask)), ask
    )
    metadata = F.concat(
        _headers(("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", uri("metadata")), ("WARC-Concurrent-To", main_id), *common("application/warc-fields", note)), note
    )
    return rows.select(F.explode(F.array(main, request, metadata)).alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip", largest: int = CLASSES[0]) -> None:
    """Write records (`value`: header, blank line, block) as WARC files; records hold `largest` bytes at most, or one is a file."""
    end, most = CRLF * 2, FILE_BYTES // largest if largest <= CLASSES[-1] else 1
    records.select("value").write.mode("append").option("lineSep", end).option("compression", compression).option("maxRecordsPerFile", most).text(path)


_FIELD = re.compile(rb"\r\n([A-Za-z-]+):[ \t]*([^\r\n]*)")


class Stream:
    """An archive's bytes in order; gzip members are decompressed STREAM_BYTES at a time."""

    def __init__(self, data: bytes):
        self.data, self.zipped = memoryview(data), data[:2] == b"\x1f\x8b"
        self.member, self.held, self.at = None, bytearray(), 0

    def more(self) -> bool:
        """Hold more bytes; false at the end."""
        if not self.zipped:
            self.held += self.data[:STREAM_BYTES]
            ended, self.data = not len(self.data), self.data[STREAM_BYTES:]
            return not ended
        while len(self.data) or (self.member and not self.member.eof):
            if self.member is None or self.member.eof:
                self.member = zlib.decompressobj(31)
            found = self.member.decompress(self.data, STREAM_BYTES)
            if self.member.eof:
                self.data = memoryview(self.member.unused_data)
            elif found or len(self.member.unconsumed_tail) < len(self.data):
                self.data = memoryview(self.member.unconsumed_tail)
            else:
                raise ValueError("an archive ends inside a compressed member")
            if found:
                self.held += found
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next mark, which is passed over; null at the end."""
        seen = self.at
        while (stop := self.held.find(mark, seen)) < 0:
            seen = max(self.at, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.held[self.at : stop])
        self.at = stop + len(mark)
        return out

    def take(self, n: int) -> bytes | None:
        while len(self.held) - self.at < n:
            if not self.more():
                return None
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        if self.at > STREAM_BYTES:
            del self.held[: self.at]
            self.at = 0
        return out


def parse(data: bytes):
    """The records of one archive as RECORD tuples."""
    source = Stream(data)
    while source.until(b"WARC/") is not None:
        head = source.until(b"\r\n\r\n")
        if head is None:
            raise ValueError("an archive ends in a record's header")
        fields = {k.lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head)}
        block = source.take(int(fields[b"content-length"]))
        if block is None:
            raise ValueError("an archive ends in a record's block")
        name, _, digest = fields.get(b"warc-payload-digest", "").rpartition(":")
        size = None
        if fields.get(b"content-type", "").startswith("application/http"):
            before, _, body = block.partition(b"\r\n\r\n")
            size = len(body)
            if fields[b"warc-type"] == "revisit":
                found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", before)
                size = int(found[1]) if found else None
            elif name.lower() == "sha256" and hashlib.sha256(body).hexdigest() != digest.lower():
                raise ValueError(f"the payload of {fields.get(b'warc-record-id')} differs from its digest")
        yield (
            fields.get(b"warc-record-id"),
            fields.get(b"warc-type"),
            fields.get(b"warc-target-uri"),
            fields.get(b"warc-concurrent-to"),
            fields.get(b"warc-refers-to"),
            digest or None,
            size,
            block,
        )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORD) of the archives at path."""

    def run(batches):
        schema = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RECORD])
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for record in parse(data.as_py()):
                    rows.append(record)
                    size += len(record[-1])
                    if len(rows) == 1000 or size > STREAM_BYTES * 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit record, with the requests and metadata concurrent to it.

    What belongs to one capture is gathered by its identifier before the join, so the join has one row a side.
    """
    main = records.filter(F.col("record_type").isin("response", "revisit"))
    other = records.filter(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    part = F.struct("record_id", "target_uri", "block")
    kinds = {name: F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, part))).alias(name) for name, kind in (("requests", "request"), ("metadata", "metadata"))}
    gathered = other.groupBy(F.col("concurrent_to").alias("_of")).agg(*kinds.values())
    none = lambda name: F.coalesce(F.col(name), F.array().cast(gathered.schema[name].dataType)).alias(name)
    return main.join(gathered, F.col("record_id") == F.col("_of"), "left").select(*main.drop("concurrent_to").columns, none("requests"), none("metadata"))


def unlinked(records: DataFrame) -> DataFrame:
    """Requests and metadata whose capture is not among the records."""
    main = records.filter(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("_id"))
    other = records.filter(F.col("record_type").isin("request", "metadata"))
    return other.join(main, F.col("concurrent_to") == F.col("_id"), "left_anti")


def archive(pages: DataFrame) -> DataFrame:
    """pages written as archives in the shared folder; their records read back.

    Each size class that occurs is written by itself; the heads of repeated payloads are found within a class, for
    equal payloads are of one size.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    bytes_of = F.coalesce(F.octet_length("html"), F.lit(0))
    largest = pages.agg(F.max(bytes_of)).first()[0] or 0
    low = -1
    for high in (*CLASSES, 1 << 62):
        write(transactions(pages if largest <= CLASSES[0] else pages.filter((bytes_of > low) & (bytes_of <= high))), path, largest=high)
        if largest <= high:
            break
        low = high
    return read(spark, path)


def page_captures(pages: DataFrame) -> DataFrame:
    """The captures of pages with the page_id that their metadata names: a round trip through archives."""
    found = captures(archive(pages))
    note = F.element_at("metadata", 1)["block"].cast("string")
    page = F.regexp_extract(note, "page-id: (-?[0-9]+)", 1)
    head = F.regexp_extract("refers_to", "<urn:capture:(-?[0-9]+)>", 1)
    number = lambda x: F.when(x != "", x.cast("long"))
    return found.withColumns({"page_id": number(page), "refers_to": number(head)})
