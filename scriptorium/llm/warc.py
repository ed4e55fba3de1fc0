"""WARC archives whose records are compressed one by one with a Zstandard dictionary.

Each task cuts its rows into archives of about ARCHIVE bytes. For each it builds a dictionary from the records of the
archive (every record counts; of very long ones the training takes the head), writes the dictionary as the payload of a
leading skippable frame, and then every record as a frame of its own, so that a record can be read by its offset alone.
Archives are rows (archive, records, content): Spark writes them, and a lost executor's archives are made again.
`export` puts them as .warc.zst files into a folder, and `archives` reads such files.

Equal payloads of at least LEAST bytes are stored once: the row with the smallest page_id is the response, the others
are revisits, which refer to it. A revisit keeps the HTTP header with the length of the payload, and its digest.

Cases: a null html is an empty payload. A null page_id never is what others refer to; its record has a random URI
fixed by the payload. Repeated rows of the smallest page_id are responses all of them. Null urls are empty; control
characters in a url are percent-encoded. An empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.shared import keep, small_or_shuffled

LEAST, ARCHIVE, DICTIONARY = 100, 8 << 20, 64 << 10
#: What the training of a dictionary takes from one record, and from all records of an archive.
SAMPLE, SAMPLES = 4096, 4 << 20
#: Fixed value: the magic number of a skippable frame that holds a dictionary, as in the public .warc.zst format.
MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
URI = "urn:x-page:"


def resolved(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_digest and refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    pages = pages.withColumn("payload_digest", F.sha2(F.encode("html", "utf-8"), 256))
    first = pages.where(F.octet_length("html") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    first = keep(first.where("n > 1 AND refers_to IS NOT NULL").drop("n"), "copies")
    out = pages.join(small_or_shuffled(first), "payload_digest", "left")
    return out.withColumn("refers_to", F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")).when(F.col("page_id").isNull(), F.col("refers_to")))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URI}{page_id if page_id is not None else 'sha256:' + digest}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URI}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The skippable frame with the dictionary, then a frame for each record."""
    import zstandard

    most = max(64, min(SAMPLE, SAMPLES // max(1, len(records))))
    samples = [r[:most] for r in records]
    total = sum(map(len, samples))
    content = b""
    if len(samples) >= 8 and total >= 4096:
        try:
            content = zstandard.train_dictionary(min(DICTIONARY, max(1024, total // 10)), samples).as_bytes()
        except zstandard.ZstdError:  # too uniform to train on
            content = b""
    content = content or b"".join(samples)[: min(DICTIONARY, total // 2)]
    kind = zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    press = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind) if content else None, write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(content)), content, *map(press.compress, records)])


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    data = content[8 : 8 + size]
    kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None)
    rest = memoryview(content)[8 + size :]
    while len(rest):
        one = press.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]


def parsed(data: bytes) -> dict:
    """Fields of one record: page_id, url, record_type, payload_digest, refers_to, payload_bytes and payload (None for a revisit)."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    uri = lambda x: int(x) if (x := x[1 + len(URI) : -1]).lstrip("-").isdigit() else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": uri(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "refers_to": uri(fields["WARC-Refers-To"]) if revisit else None,
        "payload_bytes": int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]) if revisit else len(payload),
        "payload": None if revisit else payload,
    }


def written(pages: DataFrame, size: int = ARCHIVE) -> DataFrame:
    """Archives (archive, records, content) of pages, kept in the shared folder."""

    def run(batches):
        from pyspark import TaskContext

        task, number, records, total = TaskContext.get().partitionId(), 0, [], 0

        def out():
            name = f"pages-{task:06d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [len(records)], "content": [archive(records)]}, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("content", pa.binary())]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*columns):
                one = record(page_id, url, html.encode(), digest, refers_to)
                if records and total + len(one) > size:
                    yield out()
                    number, records, total = number + 1, [], 0
                records.append(one)
                total += len(one)
        if records:
            yield out()

    rows = resolved(pages).select("page_id", "url", "html", "payload_digest", "refers_to")
    return keep(rows.mapInArrow(run, "archive string, records long, content binary"), "archives")


def read_back(content: DataFrame) -> DataFrame:
    """Records of archives (content): page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload."""
    names = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for one in frames(data.as_py()):
                    rows.append(parsed(one))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(names.items())))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(names.items())))

    return content.select("content").mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary")


def export(found: DataFrame, uri: str) -> DataFrame:
    """Put archives as files into a folder that all executors reach; returns archive, bytes. Lazy, and safe to repeat."""

    def run(batches):
        import uuid

        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(uri)
        files.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                part = f"{path}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as f:
                    f.write(content)
                files.move(part, f"{path}/{name}")
                yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [len(content)]})

    return found.select("archive", "content").mapInArrow(run, "archive string, bytes long")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files of a folder as rows (archive, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
