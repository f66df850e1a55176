"""Best-fit packing planned over the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import FEW, fields, let_go, settle, slices
from lectern.llm.tokens import word_cache

PIECES = fields(("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("ids", T.BinaryType()), ("part", T.IntegerType()), ("nth", T.LongType()))

PACKED = fields(("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType()))


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Every document's ids and end id, cut into pieces of ``size``; the last may be shorter.

    ids: little-endian unsigned integers of 32 bits, or of 16 if the vocabulary has at most 65,536 ids (see ``id_type``).
    ids_crc32: that of the ids as unsigned 32-bit integers. part and nth: the task that made the piece, and the piece's number (from 0) among those of its length there.

    A null text is empty: one piece that holds the end id alone. Repeated rows and ids give their pieces each; a null
    id stays null. An empty table gives no piece. Other columns are not read.
    """
    kind = id_type(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go("words")
        part, made = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        cache = word_cache(tokenizer, True, special_as_text)
        for b in slices(batches):
            ids = cache.encode(b.column(1).to_pylist(), end_id)
            many = np.array([-(-len(x) // size) for x in ids], np.int64)
            sums = [zlib.crc32(x[at : at + size].data) for x in ids for at in range(0, len(x), size)]
            flat = np.concatenate(ids).astype(kind)
            piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            sizes = np.array([len(x) for x in ids], np.int64)
            length = np.minimum(np.repeat(sizes, many) - piece * size, size)
            ends = np.concatenate([[0], np.cumsum(length)]) * kind.itemsize
            # the number within (task, length): places among equal lengths here, after those of the batches before
            order = np.argsort(length, kind="stable")
            here = np.bincount(length, minlength=size + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(here) - here, here)
            nth += made[length]
            made += here
            doc = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), many)))
            coded = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(length), pa.array(sums, pa.int64()), coded, pa.array(np.full(len(length), part, np.int32)), pa.array(nth)], names=PIECES.names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def id_type(tokenizer: str, end_id: int = 0) -> np.dtype:
    """The unsigned integers that hold a vocabulary's ids and the end id."""
    return np.dtype("<u2" if max(end_id, word_cache(tokenizer, True).most_id) < 1 << 16 else "<u4")


def plan(counts: dict[int, int], size: int = 2048) -> list[tuple[int, list[int]]]:
    """Sequence shapes (number of sequences, their lengths) that hold ``counts`` pieces of each length.

    Best-fit decreasing over lengths rather than pieces: open sequences of equal room and content are one entry with a
    count. The longest length left goes to the entries with the least room that holds it, as many copies to each
    sequence as fit, and to new sequences beyond those. An entry is split when only some of its sequences get one more.
    Entries number at most a few for each length, whatever the number of pieces.
    """
    rooms: list[int] = []
    opened: dict[int, Counter] = {}

    def put(room: int, content: tuple, n: int) -> None:
        if room not in opened:
            bisect.insort(rooms, room)
            opened[room] = Counter()
        opened[room][content] += n

    full: Counter = Counter()
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(size // length, left)
                n = left // each
                room, content, n_used = size - each * length, ((length, each),), n
            else:
                old = rooms[at]
                content, there = next(iter(opened[old].items()))
                each = min(old // length, left)
                n_used = min(there, left // each)
                opened[old][content] -= n_used
                if not opened[old][content]:
                    del opened[old][content]
                if not opened[old]:
                    del opened[old]
                    del rooms[at]
                room, content = old - each * length, (*content, (length, each))
            left -= each * n_used
            if room:
                put(room, content, n_used)
            else:
                full[content] += n_used
    shapes = full + sum(opened.values(), Counter())
    return [(n, [x for x, each in content for _ in range(each)]) for content, n in sorted(shapes.items(), reverse=True)]


def slots(shapes: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots (length, first rank, ranks, first sequence, copies in a sequence, offset of the first copy).

    Within a shape, a length's ranks go through its sequences one after another, all copies of one before the next.
    """
    used: Counter = Counter()
    out, sequence = [], 0
    for n, lengths in shapes:
        offset = 0
        for length, each in Counter(lengths).items():
            out.append((length, used[length], n * each, sequence, each, offset))
            used[length] += n * each
            offset += each * length
        sequence += n
    return out


def tallies(local: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Keys (task, length) in order, the pieces of that length in the tasks before each, and how many there are of each length.

    A piece is numbered within its task already; with what the tasks before have it has a rank among all of its length.
    No piece is moved for it. The driver gets a count for each length of each task, at most ``size`` numbers a task.
    """
    found = local.groupBy("part", "length").count().toArrow()
    part, length, n = (found.column(k).to_numpy().astype(np.int64) for k in range(3))
    order = np.lexsort((part, length))
    part, length, n = part[order], length[order], n[order]
    lengths, first = np.unique(length, return_index=True)
    ahead = np.cumsum(n) - n
    before = ahead - np.repeat(ahead[first], np.diff([*first, len(n)]))
    keys = part << 32 | length
    order = np.argsort(keys)
    return keys[order], before[order], {int(x): int(many) for x, many in zip(lengths, np.add.reduceat(n, first) if len(n) else [])}


def pack(cut: DataFrame, kind: np.dtype, size: int = 2048, with_ids: bool = True) -> DataFrame:
    """``pieces`` with their places: (doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids).

    Sequences hold at most ``size`` ids, gapless from 0. Pieces are written with their ids, which are checked
    against their sums when they are read; without ``with_ids`` places are told without reading them again.
    Only counts by task and length reach the driver (see ``tallies``); they go out with the plan's runs of slots, and
    pieces take theirs by their rank within their length, where they are: ids are neither shuffled nor sorted. Pieces are written once, as numbers within a task must
    not change. Ties are broken by the task and place of a piece; repeated rows, null ids and empty texts are pieces
    like others. An empty table gives an empty result.
    """
    local = settle(cut, "pieces", FEW)
    parts, before, total = tallies(local)
    runs = sorted(slots(plan(total, size)))
    keys = np.array([r[0] << 44 | r[1] for r in runs], dtype=np.int64)
    values = np.array([r[1:] for r in runs], dtype=np.int64).reshape(-1, 5)
    sent = local.sparkSession.sparkContext.broadcast((parts, before, keys, values))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        parts, before, keys, values = sent.value
        for b in slices(batches, 2048):
            doc, piece, start, lengths, sums, part, nth, *ids = b.columns
            length, part, nth = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (lengths, part, nth))
            rank = nth + before[np.searchsorted(parts, part << 32 | length)]
            first, _, sequence, each, offset = values[np.searchsorted(keys, length << 44 | rank, side="right") - 1].T
            at = rank - first
            if ids and sums.to_pylist() != [zlib.crc32(np.frombuffer(x.as_buffer(), kind).astype("<u4").data) for x in ids[0]]:
                raise ValueError("a piece is damaged")
            yield pa.RecordBatch.from_arrays([doc, piece, start, lengths, sums, pa.array(sequence + at // each), pa.array(offset + at % each * length), *ids], names=out.names)

    out = T.StructType([f for f in PACKED.fields if with_ids or f.name != "ids"])
    return local.select("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids).mapInArrow(place, out)
