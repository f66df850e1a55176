"""WARC archives in Zstandard frames with an embedded dictionary: writer and reader."""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import fields, fresh_path, settle

# The skippable frame that holds the dictionary, as the .warc.zst convention has it.
DICT_MAGIC = (0x184D2A5D).to_bytes(4, "little")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: The dictionary's size, and the bytes that it is built from: evenly spaced records of its archive, of each long one as
#: many pieces, evenly spaced over the whole record, as PIECES.
DICT_BYTES, SAMPLE_BYTES, PIECES, PIECE_BYTES = 64 << 10, 4 << 20, 4, 8 << 10
#: Payload that an archive holds, about.
ARCHIVE_BYTES = 64 << 20
MANIFEST = fields(("path", T.StringType()), ("records", T.LongType()), ("bytes", T.LongType()))
RECORD = fields(("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("path", T.StringType()))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def header_value(text: str) -> str:
    """A header's value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length tells the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    head += [] if url is None else [f"WARC-Target-URI: {header_value(url)}"]
    head += [] if page_id is None else [f"Page-ID: {page_id}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [] if refers_to is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pieces(record: bytes) -> list[bytes]:
    """A record, or evenly spaced pieces of a long one, from its first byte to its last."""
    if len(record) <= PIECES * PIECE_BYTES:
        return [record]
    return [record[at : at + PIECE_BYTES] for k in range(PIECES) for at in [k * (len(record) - PIECE_BYTES) // (PIECES - 1)]]


def dictionary(records: list[bytes]) -> zstd.ZstdCompressionDict:
    """A dictionary from records; of too few to train on, their own bytes are the dictionary."""
    sizes = [min(len(r), PIECES * PIECE_BYTES) for r in records]
    step = max(1, -(-sum(sizes) // SAMPLE_BYTES))
    sample = [piece for r in records[::step] for piece in pieces(r)]
    try:
        return zstd.train_dictionary(DICT_BYTES, sample, k=256, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(sample)[-DICT_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to). Only ids and digests are grouped and joined, never payloads by digest."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keys = settle(rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest"), "digests")
    first = settle(keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first"), "first")
    again = settle(keys.join(first, "digest").where("page_id > first").select(F.col("page_id").alias("again"), F.col("digest").alias("same"), F.col("first").alias("refers_to")).distinct(), "again")
    return rows.join(again, (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("same")), "left").drop("again", "same")


def write_archives(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row to archives in ``directory`` (a URI all executors can write); returns their manifest.

    Of records with equal payloads of at least LEAST_REVISIT bytes that with the smallest id is a response and the
    others are revisits (rows that tie for the smallest id are all responses, and rows without an id too). A null html
    is an empty payload. An archive is a skippable frame with its dictionary, then a frame for each record. A task
    writes under its attempt's own name and moves the file into place when it is whole, so lost and repeated attempts
    leave no half archives. An empty table makes no archive. Other columns are not read.
    """
    rows = mark_revisits(pages, id_col, url_col, html_col)
    total = pages.select(F.sum(F.octet_length(F.col(html_col).cast("string")))).first()[0] or 0
    parts = max(1, -(-total // ARCHIVE_BYTES), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(directory)
        store.create_dir(base, recursive=True)
        chunk: list[bytes] = []
        held = made = 0

        def flush() -> dict:
            nonlocal chunk, held, made
            own, name = f"{base}/.{part}-{made}-{uuid.uuid4().hex}", f"{base}/pages-{part:06d}-{made:04d}.warc.zst"
            trained = dictionary(chunk)
            trained.precompute_compress(level=level)
            pack = zstd.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
            with store.open_output_stream(own, compression=None) as out:
                data = trained.as_bytes()
                size = out.write(DICT_MAGIC + len(data).to_bytes(4, "little") + data)
                for r in chunk:
                    size += out.write(pack.compress(r))
            store.move(own, name)
            done = {"path": name, "records": len(chunk), "bytes": size}
            chunk, held, made = [], 0, made + 1
            return done

        for b in batches:
            found = []
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                chunk.append(record(page_id, url, payload, digest, refers, date))
                held += len(chunk[-1])
                if held >= ARCHIVE_BYTES:
                    found.append(flush())
            yield pa.RecordBatch.from_pylist(found, schema=SCHEMA)
        if chunk:
            yield pa.RecordBatch.from_pylist([flush()], schema=SCHEMA)

    # rows without an id, or with one that many have, are dealt by their payload too
    return settle(rows.repartition(parts, "page_id", "digest").mapInArrow(write, MANIFEST), "manifest")


SCHEMA = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def parse(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in an uncompressed stream."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield headers, block


def open_archive(source) -> io.BufferedReader:
    """The records of an archive, uncompressed as they are read."""
    if source.read(4) != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    data = source.read(int.from_bytes(source.read(4), "little"))
    unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data))
    return io.BufferedReader(unpack.stream_reader(source, read_across_frames=True), 1 << 20)


def read_archives(manifest: DataFrame, directory: str, with_payload: bool = False) -> DataFrame:
    """A row (RECORD, and payload if asked for) for every record of the archives that ``manifest`` lists.

    Archives are read as streams, whatever their size. A response's payload is checked against its digest and length;
    a damaged archive raises. A revisit's length is the full payload's; its payload is null.
    """
    schema = T.StructType([*RECORD.fields, *[T.StructField("payload", T.BinaryType())] * with_payload])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(directory)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for headers, block in parse(open_archive(source)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                        row = {"page_id": number("Page-ID"), "url": headers.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("Refers-To-Page-ID"), "path": path}
                        rows.append(row | ({"payload": payload if kind == "response" else None} if with_payload else {}))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 5000 or held >= 32 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    paths = manifest.select("path")
    return paths.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(read, schema)


def archive_directory(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return fresh_path(spark, "warc")
