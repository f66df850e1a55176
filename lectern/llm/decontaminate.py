"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import fields, kept, let_go, slices

#: Errors allowed, as a share of the item's characters.
ERROR_RATE = 0.1
#: Characters of test items that are searched for in one pass; more of them are searched in blocks.
BLOCK_CHARS = 4 << 20
MATCH = fields(("doc_id", T.LongType()), ("item_id", T.LongType()), ("distance", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()))


def normalise(text: str) -> str:
    """Lower case, with runs of white space as one space and none at the ends."""
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of the normalised text the place of its origin in ``text``."""
    out, gap = [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = True
        else:
            if gap and out:
                out.append(i - 1)
            gap = False
            out += [i] * len(c.lower())
    return out


def pieces(item: str, rate: float = ERROR_RATE) -> tuple[int, list[tuple[int, str]]]:
    """The error budget k of an item and its k + 1 pieces of about equal length, with their offsets.

    An occurrence with at most k errors holds at least one piece without any.
    """
    k = int(len(item) * rate)
    bounds = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


class Pattern:
    """Myers' bit-parallel approximate search for one item; a whole column is one integer."""

    def __init__(self, item: str):
        self.size = len(item)
        self.all, self.high = (1 << self.size) - 1, 1 << (self.size - 1)
        self.where: dict[str, int] = {}
        for i, c in enumerate(item):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The smallest edit distance to any substring of ``text``, and where the first such substring ends."""
        up, down, score, every = self.all, 0, self.size, self.all
        least, at = score, 0
        for j, c in enumerate(text, 1):
            eq = self.where.get(c, 0)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            plus = down | ~(horizontal | up) & every
            minus = up & horizontal
            if plus & self.high:
                score += 1
            elif minus & self.high:
                score -= 1
                if score < least:
                    least, at = score, j
            plus = plus << 1 & every
            minus = minus << 1 & every
            up = minus | ~(vertical | plus) & every
            down = plus & vertical
        return least, at


class Finder:
    """Finds items in texts: exact piece hits by an Aho-Corasick automaton, verified by bit-parallel distance.

    A hit is verified from small to large: s neighbouring pieces may have s - 1 errors, as an occurrence within the
    budget holds some such group, in it a smaller one, and in that a piece without errors. Chance hits mostly end at
    the smallest group.
    """

    #: Pieces in a group, from small to large.
    GROUPS = (2, 8)

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        hits: dict[str, list[tuple]] = {}
        for item_id, text in items:
            if norm := normalise(text):
                k, parts = pieces(norm, rate)
                bounds = [at for at, _ in parts] + [len(norm)]
                groups = {s: [(Pattern(norm[bounds[i] : bounds[min(i + s, k + 1)]]), bounds[i], min(s, k + 1 - i) - 1) for i in range(0, k + 1, s)] for s in self.GROUPS if s <= k}
                for i, (at, part) in enumerate(parts):
                    hits.setdefault(part, []).append((len(self.items), at, [groups[s][i // s] for s in groups]))
                self.items.append((item_id, norm, k, Pattern(norm), Pattern(norm[::-1])))
        for part, owners in hits.items():
            self.automaton.add_word(part, (len(part), owners))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) for each item in the text: its best occurrence, first of equals."""
        norm = normalise(text or "")
        if not norm or not self.items:
            return []
        exact: dict[int, int] = {}
        spots: dict[int, list[int]] = {}
        for end, (size, owners) in self.automaton.iter(norm):
            for item, at, groups in owners:
                begin = end + 1 - size - at
                if item in exact:
                    continue
                if begin >= 0 and norm.startswith(self.items[item][1], begin):
                    exact[item] = begin
                elif all(p.best(norm[max(0, begin + o - e) : max(0, begin + o + p.size + e)])[0] <= e for p, o, e in groups):
                    spots.setdefault(item, []).append(begin)
        out, origin = [], None
        for item in {**spots, **exact}:
            item_id, pattern, k, forward, backward = self.items[item]
            if item in exact:
                distance, start, end = 0, exact[item], exact[item] + len(pattern)
            else:
                distance, end = min((d, lo + e) for lo, hi in windows(spots[item], len(pattern), k) for d, e in [forward.best(norm[lo:hi])])
                if distance > k:
                    continue
                start = end - backward.best(norm[max(0, end - len(pattern) - k) : end][::-1])[1]
            origin = origin or places(text)
            out.append((item_id, distance, origin[start], origin[end - 1] + 1))
        return out


def windows(begins: list[int], size: int, k: int) -> Iterator[tuple[int, int]]:
    """Stretches in which an occurrence that begins about at one of the places lies; overlapping ones are joined."""
    lo = hi = None
    for b in sorted(set(begins)):
        if hi is not None and b - k <= hi:
            hi = b + size + k
        else:
            if hi is not None:
                yield max(0, lo), hi
            lo, hi = b - k, b + size + k
    if hi is not None:
        yield max(0, lo), hi


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``most`` characters at the most; one item is never split.

    Only one block is on the driver at a time. Items without text are left out; an item's id may be null.
    """
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = rows.select(F.sum(F.length("t"))).first()[0] or 0
    n = -(-2 * total // most) if total > most else 1
    for k in range(n):
        found = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        if found:
            yield [(r["i"], r["t"]) for r in found]


def finder(spark: SparkSession, items: list[tuple[int | None, str]], rate: float) -> Callable[[], Finder]:
    """Builds the finder once in each Python worker that needs it, from a broadcast of at most BLOCK_CHARS characters."""
    sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def get() -> Finder:
        made = kept("finder")
        if key not in made:
            made.clear()
            made[key] = Finder(sent.value, rate)
        return made[key]

    return get


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """One row (doc_id, item_id, distance, start, end) for each row of ``docs`` and item that occurs in it.

    An item occurs if a stretch of the text is within ``rate`` of its length in edits, after lower-casing and with
    white space evened out; start and end are in code points of the original text, end exclusive. Null and empty texts
    and items match nothing; an item without an id is reported with a null item_id. Repeated rows are reported as often as they occur; repeated items likewise. Documents are
    scanned once for each block of items and never shuffled; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in blocks(items, item_id_col, item_text_col):
        get = finder(docs.sparkSession, block, rate)

        def run(batches: Iterator[pa.RecordBatch], get: Callable[[], Finder] = get) -> Iterator[pa.RecordBatch]:
            let_go("finder")
            for b in slices(batches):
                found = [(doc, *m) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in get().find(t)]
                cols = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=MATCH.names)

        part = rows.mapInArrow(run, MATCH)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCH)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item; rows with a null text stay. Nothing is shuffled."""
    at = docs.columns.index(text_col)
    for block in blocks(items, item_id_col, item_text_col):
        get = finder(docs.sparkSession, block, rate)

        def run(batches: Iterator[pa.RecordBatch], get: Callable[[], Finder] = get) -> Iterator[pa.RecordBatch]:
            let_go("finder")
            for b in slices(batches):
                yield b.filter(pa.array([not get().find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
