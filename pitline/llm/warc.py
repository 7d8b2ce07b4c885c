"""WARC archives compressed record by record with a Zstandard dictionary of their own records.

A dictionary is trained from a bounded sample of the records to be archived and put into every archive as a leading skippable
frame; each record follows as a frame of its own, compressed with the dictionary. An archive can so be read record by record, and
from any record on, with nothing but itself. Tasks write archives under names of their own into a shared folder and report them in a
manifest table; an archive of a lost or repeated task is in no manifest and so in no result. Payloads found before are written as
revisit records that carry the HTTP head and no payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.common import scratch_path

# fixed values: the frame that holds a dictionary, and the date and profile that records carry
DICTIONARY_MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The sample: at most so many records and bytes of them; and the dictionary's largest size.
SAMPLE_RECORDS = 2_000
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 110 << 10
LEVEL = 6
#: An archive is closed when its compressed size passes this.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20

CRLF = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str, url: str | None) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:page:none:{uuid.uuid5(uuid.NAMESPACE_URL, digest + (url or '')).hex}>"


def header_value(value: str) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest, url)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", header_value(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, "", None)), ("WARC-Truncated", "length")] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + CRLF + block + CRLF + CRLF


def train(spark: SparkSession, records: DataFrame) -> bytes:
    """A dictionary from the sample, made in one task; empty only if there are no records.

    records: (page_id, url, payload). The sample is about SAMPLE_RECORDS records chosen by a hash of their payload, so each task sends
    only those, whole ones until SAMPLE_BYTES are full.
    """
    one_in = max(1, records.count() // SAMPLE_RECORDS)
    chosen = F.pmod(F.xxhash64("payload", "page_id"), F.lit(one_in)) == 0
    sample = records.select("page_id", "url", "payload").where(chosen & (F.octet_length("payload") <= SAMPLE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                raw = record(r["page_id"], r["url"], r["payload"], None)
                if size + len(raw) <= SAMPLE_BYTES:
                    samples.append(raw)
                    size += len(raw)
        try:
            trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 10)), samples, k=200, d=8).as_bytes()
        except zstandard.ZstdError:  # too little to train on: the records themselves, as a dictionary of raw content
            trained = b"".join(samples)[:DICTIONARY_BYTES]
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([trained], pa.binary())})

    return max((r["dictionary"] for r in sample.repartition(1).mapInArrow(run, "dictionary binary").collect()), key=len, default=b"")


class Archive:
    """One archive being written."""

    def __init__(self, folder: str, dictionary: bytes):
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = system.open_output_stream(f"{root}/{self.name}", compression=None)  # the name would have it compressed again
        self.size, self.records = 0, 0
        if dictionary:
            self.put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)

    def put(self, raw: bytes) -> None:
        self.file.write(raw)
        self.size += len(raw)

    def add(self, raw: bytes) -> None:
        self.put(self.compressor.compress(raw))
        self.records += 1


def write(records: DataFrame, folder: str, examples: DataFrame | None = None) -> DataFrame:
    """Write records (page_id, url, payload, refers_to) into archives in `folder`; returns the manifest (path, records, bytes), itself a table.

    examples: records that the dictionary is made from where reading them costs less than reading `records` once more; the same rows else.
    Null payloads are empty, null urls leave out their header, and null page_ids get a record id from digest and url.
    """
    spark = records.sparkSession
    records = records.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"), "refers_to")
    dictionary = spark.sparkContext.broadcast(train(spark, records if examples is None else examples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []

        def close() -> None:
            archive.file.close()
            done.append((f"{folder}/{archive.name}", archive.records, archive.size))

        for batch in batches:
            for r in batch.to_pylist():
                archive = archive or Archive(folder, dictionary.value)
                archive.add(record(r["page_id"], r["url"], r["payload"], r["refers_to"]))
                if archive.size > ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive:
            close()
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    manifest = scratch_path(spark, "manifest")
    records.mapInArrow(run, "path string, records long, bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def frames(stream: io.RawIOBase) -> Iterator[bytes]:
    """Decompressed records of an archive, read in chunks."""
    pending = stream.read(8)
    dictionary = None
    if len(pending) == 8 and struct.unpack("<II", pending)[0] == DICTIONARY_MAGIC:
        length, raw = struct.unpack("<II", pending)[1], b""
        while len(raw) < length:
            more = stream.read(length - len(raw))
            if not more:
                raise EOFError("the dictionary is cut short")
            raw += more
        dictionary, pending = zstandard.ZstdCompressionDict(raw), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while pending or (pending := stream.read(CHUNK)):
        frame, out = decompressor.decompressobj(), []
        while True:
            out.append(frame.decompress(pending))
            if frame.eof:
                pending = frame.unused_data
                break
            pending = stream.read(CHUNK)
            if not pending:
                raise EOFError("the last record is cut short")
        yield b"".join(out)


def parsed(raw: bytes) -> dict:
    """Fields of a record; payload is null for a revisit."""
    head, _, block = raw.partition(CRLF + CRLF)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    length = next(int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    number = lambda name: int(n) if name in fields and (n := fields[name][10:-1]).lstrip("-").isdigit() else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not the one that was archived")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number("WARC-Refers-To"), "payload": None if revisit else payload,
    }


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_back(manifest: DataFrame, with_payloads: bool = True) -> DataFrame:
    """The records of the archives in a manifest, digests verified; one archive is one unit of work. with_payloads: False leaves payloads out.

    The paths are few and small, so the number of tasks is given: left to itself the planner would merge them into one.
    """
    archives = max(manifest.count(), 1)
    schema = READ if with_payloads else READ.remove(6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                rows, size = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for raw in frames(stream):
                        rows.append(parsed(raw))
                        size += len(raw) if with_payloads else 500
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    columns = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return manifest.select("path").repartitionByRange(archives, "path").mapInArrow(run, columns + (", payload binary" if with_payloads else ""))


def payloads(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload) of pages; null html is an empty payload."""
    return pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))


def with_revisits(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of pages with equal payloads of at least min_bytes, all but the smallest page_id refer to it.

    Null html is an empty payload. Rows that repeat the smallest page_id with its payload are all responses. Null page_ids revisit the
    smallest one that is not null; without one they are responses. Payloads are compared by SHA-256.
    """
    rows = payloads(pages, id, url, html)
    rows = rows.withColumn("same", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return rows.join(firsts, "same", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
