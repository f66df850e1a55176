"""Byte-level decoding of token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others moved up."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class _Bytes(dict):
    """For str.translate: the byte that a character stands for; characters that stand for none are left out."""

    def __missing__(self, code: int) -> None:
        return None


def _starts(keys: list[pa.Array], n: int) -> np.ndarray:
    """Where the rows' keys change; null equals null."""
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        one, two = k.slice(1), k.slice(0, n - 1)
        for differ in (pc.fill_null(pc.not_equal(one, two), False), pc.not_equal(pc.is_null(one), pc.is_null(two))):
            new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def decode_ids(tokens: DataFrame, vocabulary: DataFrame, end_id: int = 1, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(page_id, text) of tokens (page_id, pos, tok): pieces in order, end tokens and unknown ids left out.

    Pieces are joined first and mapped to bytes for the page as a whole, as a character may be split between pieces;
    bytes that are no UTF-8 become U+FFFD. ``keys`` are the columns that name a page, null ones like others.
    ``vocabulary`` (tok, piece), which does not grow with the tokens, is sent to them. Tokens of a page that stand
    together are made one row before pages are shuffled and sorted; a task holds a batch and the page it is at.
    """
    words = F.broadcast(vocabulary.select(F.col("tok"), F.col("piece").cast("string").alias("piece")))
    found = tokens.join(words, "tok", "left").select(*keys, F.col("pos").cast("long").alias("pos"), F.when(F.col("tok") != end_id, F.col("piece")).alias("piece"))
    many, named = len(keys), [tokens.schema[k] for k in keys]
    table = _Bytes({ord(c): chr(b) for c, b in byte_characters().items()})
    run_schema = T.StructType([*named, T.StructField("first", T.LongType()), T.StructField("pos", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("pieces", T.StringType())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ends = np.append(starts := _starts(b.columns[:many], b.num_rows), b.num_rows)
            pieces, at = pc.fill_null(b.column(many + 1), ""), pc.fill_null(b.column(many), 0).to_numpy()
            sizes = pc.utf8_length(pieces).to_numpy().astype(np.int32)
            cut = lambda v: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces), "")
            yield pa.RecordBatch.from_arrays([c.take(pa.array(starts)) for c in b.columns[:many]] + [pa.array(at[starts]), cut(at), cut(sizes), joined], names=run_schema.names)

    def text(parts: list[tuple[bytes, bytes, str]]) -> str:
        at = np.frombuffer(b"".join(p[0] for p in parts), np.int64)
        whole = "".join(p[2] for p in parts)
        if (at[1:] <= at[:-1]).any():
            to = np.cumsum(np.frombuffer(b"".join(p[1] for p in parts), np.int32)).tolist()
            whole = "".join(x for _, x in sorted(zip(at.tolist(), (whole[i:j] for i, j in zip([0, *to], to)))))
        return whole.translate(table).encode("latin-1").decode("utf-8", "replace")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple[bytes, bytes, str]] = []
        kinds: list[pa.DataType] = []

        def rows(done: list[tuple], texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)] + [pa.array(texts, pa.string())], names=[*keys, "text"])

        for b in slices(batches):
            kinds, done, texts = [c.type for c in b.columns[:many]], [], []
            for *now, _, at, sizes, pieces in zip(*(c.to_pylist() for c in b.columns)):
                if key is not None and tuple(now) != key:
                    done.append(key)
                    texts.append(text(held))
                    held = []
                key = tuple(now)
                held.append((at, sizes, pieces))
            yield rows(done, texts)
        if key is not None:
            yield rows([key], [text(held)])

    pages = found.mapInArrow(runs, run_schema).repartition(*keys).sortWithinPartitions(*keys, "first")
    return pages.mapInArrow(decoded, T.StructType([*named, T.StructField("text", T.StringType())]))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
