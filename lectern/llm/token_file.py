"""Token-id files: whole texts encoded, coded in independent checksummed blocks, and read back."""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import FEW, crc32_u32, fields, fresh_path, parts_for, settle
from lectern.llm.id_coder import TOGETHER, decode, encode, shape
from lectern.llm.tokens import word_cache

# Fixed values of the file format. A file is MAGIC and segments. A segment: SEGMENT (documents, ids, blocks, lanes of a
# block, steps of a lane, bytes of the table, CRC-32 of the table), the table (ids of documents as little-endian int64, a bit
# map of those that are null, lengths as uint32; deflated), then for each block BLOCK (bytes, CRC-32 of its ids) and its
# bytes. All blocks hold lanes x steps ids; zeros fill up the last.
MAGIC = b"LECTERN-IDS-2\n"
SEGMENT, BLOCK = struct.Struct("<IQIIIII"), struct.Struct("<II")
#: A segment is closed at so many ids, in blocks of about BLOCK_IDS.
SEGMENT_IDS, BLOCK_IDS = 8 << 20, 1 << 19
#: A file is made of about so many bytes of input, or fewer to use all of spark.sql.shuffle.partitions.
FILE_BYTES = 256 << 20
MANIFEST = fields(("path", T.StringType()), ("part", T.IntegerType()), ("documents", T.LongType()), ("ids", T.LongType()), ("bytes", T.LongType()))
ROW = fields(("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment of whole documents."""
    n = sum(map(len, ids))
    blocks, lanes, steps = shape(n, BLOCK_IDS)
    padded = np.zeros(blocks * lanes * steps, np.uint32)
    np.concatenate([np.zeros(0, np.uint32), *ids], out=padded[:n])
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits([d is None for d in doc_ids]).tobytes() + np.array([len(x) for x in ids], "<u4").tobytes()
    table = zlib.compress(table, 6)
    out = [SEGMENT.pack(len(doc_ids), n, blocks, lanes, steps, len(table), zlib.crc32(table)), table]
    # so many blocks at once that their state stays small
    rows, some = padded.reshape(blocks, -1), max(1, TOGETHER // lanes)
    for at in range(0, blocks, some):
        part = rows[at : at + some]
        for row, coded in zip(part, encode(part, steps)):
            out += [BLOCK.pack(len(coded), crc32_u32(row)), coded]
    return b"".join(out)


def read_exactly(source, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError("the file ends early")
    return data


def unpack_segments(source) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """(document ids, their token ids) of each segment of a stream; a damaged block raises."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    while head := source.read(SEGMENT.size):
        n_docs, n_ids, blocks, lanes, steps, table_size, table_crc = SEGMENT.unpack(head)
        table = read_exactly(source, table_size)
        if zlib.crc32(table) != table_crc:
            raise ValueError("a document table is damaged")
        table = zlib.decompress(table)
        docs, gone = np.frombuffer(table, "<i8", n_docs), np.unpackbits(np.frombuffer(table, np.uint8, -(-n_docs // 8), 8 * n_docs))[:n_docs]
        lengths = np.frombuffer(table, "<u4", n_docs, 8 * n_docs + -(-n_docs // 8))
        some = max(1, TOGETHER // lanes)
        parts = []
        for at in range(0, blocks, some):
            coded, sums = [], []
            for _ in range(min(some, blocks - at)):
                n, crc = BLOCK.unpack(read_exactly(source, BLOCK.size))
                coded.append(read_exactly(source, n))
                sums.append(crc)
            rows = decode(coded, lanes, steps).astype("<u4")
            if [zlib.crc32(r.data) for r in rows] != sums:
                raise ValueError("a block is damaged")
            parts.append(rows.reshape(-1))
        flat = np.concatenate(parts)[:n_ids]
        yield [None if g else int(d) for d, g in zip(docs, gone)], np.split(flat, np.cumsum(lengths)[:-1]) if n_docs else []


def write_ids(docs: DataFrame, directory: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Writes every document's ids and end id to files in ``directory``, in ascending order of id; returns their manifest.

    Documents are dealt by ranges of their ids, which are sorted within a file and rise from file to file; a null id
    comes first, equal ids in the order of their texts' hashes. A null text is empty. A task writes under its attempt's own name
    and moves the file into place when it is whole. An empty table makes no file. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = parts or parts_for(docs, FILE_BYTES)
    # equal ids, null ones among them, may fill several files: the hash of the text parts them
    rows = rows.withColumn("hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(directory)
        store.create_dir(base, recursive=True)
        own, name = f"{base}/.{part}-{uuid.uuid4().hex}", f"{base}/ids-{part:06d}.bin"
        cache = word_cache(tokenizer)
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        total = n_docs = n_held = size = 0
        out = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for doc, ids in zip(b.column(0).to_pylist(), cache.encode(b.column(1).to_pylist(), end_id)):
                    doc_ids.append(doc)
                    held.append(ids)
                    n_held += len(ids)
                    if n_held >= SEGMENT_IDS:
                        out = out or store.open_output_stream(own, compression=None)
                        size += out.write((MAGIC if not size else b"") + pack_segment(doc_ids, held))
                        total, n_docs, doc_ids, held, n_held = total + n_held, n_docs + len(doc_ids), [], [], 0
        if doc_ids:
            out = out or store.open_output_stream(own, compression=None)
            size += out.write((MAGIC if not size else b"") + pack_segment(doc_ids, held))
            total, n_docs = total + n_held, n_docs + len(doc_ids)
        if out:
            out.close()
            store.move(own, name)
            cols = ([name], [part], [n_docs], [total], [size])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=MANIFEST.names)

    return settle(dealt.mapInArrow(write, MANIFEST), "manifest", FEW)


def read_ids(manifest: DataFrame, directory: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and the ids themselves if asked for, for every document in the files.

    start: the ids of all documents before it. Only the files' paths and sizes, a row for each partition that wrote,
    pass through the driver. Every block is checked against its sum.
    """
    spark = manifest.sparkSession
    files = sorted((r["part"], r["path"], r["ids"]) for r in manifest.collect())
    paths, starts = [f[1] for f in files], np.cumsum([0, *[f[2] for f in files]])
    schema = T.StructType([*ROW.fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(directory)
        for b in batches:
            for k in b.column(0).to_pylist():
                start = int(starts[k])
                with store.open_input_stream(paths[k], compression=None) as source:
                    for doc_ids, ids in unpack_segments(io.BufferedReader(source, 1 << 20)):
                        sizes = np.array([len(x) for x in ids], np.int64)
                        at = start + np.cumsum(sizes) - sizes
                        start += int(sizes.sum())
                        cols = [pa.array(doc_ids, pa.int64()), pa.array(at, pa.int64()), pa.array(sizes), pa.array([zlib.crc32(x.data) for x in ids], pa.int64())]
                        cols += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] * with_ids
                        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    if not files:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(files), 1, len(files)).mapInArrow(read, schema)


def id_directory(spark: SparkSession) -> str:
    """A new folder for token-id files in the shared folder."""
    return fresh_path(spark, "ids")
