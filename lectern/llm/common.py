"""What the training-data operators share: reading tables, settled intermediate tables and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.scratch import scratch_path as fresh_path
from lectern.sources.scratch import WRITTEN, setting, settle, sweep  # noqa: F401

#: Texts that pass between Spark and Python at once, fewer than Spark's 10,000: both sides hold them in buffers.
TEXTS_AT_ONCE = 512
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": TEXTS_AT_ONCE}
#: What a Python worker keeps from task to task, by what it is for.
KEPT: dict[str, dict] = {}


def kept(what: str) -> dict:
    """What this process keeps from task to task for one purpose."""
    return KEPT.setdefault(what, {})


def let_go(*but: str) -> None:
    """Drops what this process keeps for other purposes than these, and gives freed memory back to the system.

    A Python worker serves stage after stage, and would hold the words of one while it works on the next.
    """
    for what in KEPT.keys() - set(but):
        if KEPT[what]:
            KEPT[what].clear()
            gc.collect()  # a cache and its parts may refer to each other
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_settled(df: DataFrame) -> None:
    """Deletes the settled tables that a frame reads; no later step may read them."""
    read = {f.rpartition("/")[0].removeprefix("file:").lstrip("/") for f in df.inputFiles()}
    sweep(df.sparkSession, [p for p in WRITTEN if p.removeprefix("file:").lstrip("/") in read])


def parts_for(df: DataFrame, each: int) -> int:
    """Partitions of about ``each`` bytes by Spark's estimate of the table's size, at least ``spark.sql.shuffle.partitions``.

    Where the plan tells no size (it is taken for endless then), that least number.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // each)) if size < 1 << 58 else least


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that little of a batch stands in Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def binary_text(batch: pa.RecordBatch, column: int | str) -> pa.Array:
    """A string column as UTF-8 bytes, without a copy; nulls stay."""
    col = batch.column(column)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())


def held_out(id_col: str, mod: int, rest: int):
    """True where crc32 of the id as text leaves ``rest`` on division by ``mod``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def crc32_u32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def fields(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])
