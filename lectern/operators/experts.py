"""Feed-forward blocks: experts with gate, up and down matrices, rows grouped by expert, and the block that mixes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrays import silu
from lectern.functions.core import dot, let

VECTOR = T.ArrayType(T.DoubleType())


def matvec(rows: Column, x: Column) -> Column:
    """A matrix (array of rows) times a vector."""
    return F.transform(rows, lambda r: dot(r, x))


def expert_mlp(x: Column, gate: Column, up: Column, down: Column) -> Column:
    """down (silu(gate x) * up x), for matrices that stand in the row."""
    hidden = F.zip_with(matvec(gate, x), matvec(up, x), lambda g, u: silu(g) * u)
    return let(hidden, lambda h: matvec(down, h))


def combine(rows: DataFrame, key: str, slot: str, weight: str, value: str) -> DataFrame:
    """(key, y): the weighted sum of a key's vectors in the order of their slots."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"), F.col(weight).alias("w"), F.col(value).alias("v")))).alias("l"))
    zero = F.transform(F.get("l", F.lit(0))["v"], lambda _: F.lit(0.0))
    return listed.select(key, F.aggregate("l", zero, lambda a, r: F.zip_with(a, r["v"], lambda p, q: p + r["w"] * q)).alias("y"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as a matrix, without going through Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _vectors(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def bulk_linear(rows: DataFrame, key: str, value: str, weights: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """(key, y): weights (outputs x inputs) times each vector, a batch at a time; vectors have one width."""
    schema = T.StructType([rows.schema[key], T.StructField("y", VECTOR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = _matrix(b.column(1)) @ weights.T
                yield pa.RecordBatch.from_arrays([b.column(0), _vectors(y if bias is None else y + bias)], names=schema.names)

    return rows.select(key, value).mapInArrow(run, schema)


def grouped_experts(rows: DataFrame, key: str, slot: str, expert: str, value: str, weights: Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(key, slot, y): each row through its expert; rows of one expert are neighbours, so that a batch takes few products.

    Rows are dealt by expert and a salt and sorted in their partition: a busy expert is spread over all tasks, and no
    group is held in memory. ``weights`` gives an expert's matrices in a task.
    """
    schema = T.StructType([rows.schema[key], rows.schema[slot], T.StructField("y", VECTOR)])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, slot, F.col(expert).cast("long").alias("e"), F.col(value).alias("x")).repartition(parts, "e", F.pmod(F.xxhash64(key), F.lit(parts))).sortWithinPartitions("e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            e, x = b.column(2).to_numpy(), _matrix(b.column(3))
            out = np.empty_like(x)
            for part in np.split(np.arange(len(e)), np.flatnonzero(np.diff(e)) + 1):
                gate, up, down = weights(int(e[part[0]]))
                g = x[part] @ gate.T
                out[part] = (g / (1 + np.exp(-g)) * (x[part] @ up.T)) @ down.T
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _vectors(out)], names=schema.names)

    return dealt.mapInArrow(run, schema)
