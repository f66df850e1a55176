"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.core import unused
from lectern.llm.common import FEW, WRITTEN, binary_text, drop_settled, fields, let_go, setting, settle, slices, sweep
from lectern.llm.components import connected_components

#: Hashes whose bits are counted at once; bounds the memory of a very long text.
BLOCK = 1 << 15
#: Counters of shingles by the highest bits of their hashes, and how many make one row.
COUNTERS, ROW = 1 << 18, 1 << 12
#: Odd multiplier that orders shingles of one level, and a mask that orders ids, both pseudo-random.
ORDER, MASK = np.uint64(xxhash.xxh64_intdigest("order") | 1), xxhash.xxh64_intdigest("mask") >> 1


SKETCH = fields(("id", T.LongType()), ("fp", T.LongType()), ("whole", T.LongType()), ("size", T.LongType()), ("odd", T.BinaryType()), ("keys", T.ArrayType(T.LongType())))
PAIR = fields(("rep1", T.LongType()), ("whole1", T.LongType()), ("rep2", T.LongType()), ("whole2", T.LongType()))


def shingle_hashes(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles, repeats included, in blocks.

    Words are split at ASCII white space after lower-casing A-Z; a text of fewer words than a shingle is one shingle,
    a text without words (or null) has none.
    """
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if 0 < len(words) <= shingle_words:
        yield np.array([digest(b" ".join(words), seed)], dtype="<u8")
    elif words:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
        while len(part := np.fromiter((digest(g, seed) for g in islice(grams, BLOCK)), dtype="<u8")):
            yield part


def fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """SimHash of one text: a bit is set if it is set in over half the shingles' hashes; 0 without shingles."""
    return _fingerprint(shingle_hashes(text, shingle_words, seed))


def _fingerprint(blocks: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(64, dtype=np.int64), 0
    for part in blocks:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def levels_of(docs: DataFrame, text_col: str, shingle_words: int) -> np.ndarray:
    """How far above the mean each counter of shingles is, as a logarithm: 0 for most, more for shingles of many texts.

    A counter holds what any number of shingles have in common, so this only orders them; every text is counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts = np.zeros(COUNTERS, np.int64)
        for b in slices(batches):
            parts = [h for t in binary_text(b, 0) for h in shingle_hashes(t.as_py(), shingle_words)]
            if parts:
                counts += np.bincount((np.concatenate(parts) >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
        rows = counts.reshape(-1, ROW)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["at", "n"])

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(ROW, np.int64)
        for x in part.column("n"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"at": part.column("at").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    kind = fields(("at", T.IntegerType()), ("n", T.BinaryType()))
    with setting(docs.sparkSession, FEW):
        found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, kind).groupBy("at").applyInArrow(add, kind).collect()
    counts = np.zeros(COUNTERS, np.int64)
    for r in found:
        counts[r["at"] * ROW : (r["at"] + 1) * ROW] = np.frombuffer(bytes(r["n"]), np.int64)
    mean = counts.mean()
    return np.log2(1 + np.maximum(0, counts - mean) / (6 * np.sqrt(mean) + 16)).astype(np.uint8)


def sketch(text: bytes | None, shingle_words: int, similar: float, levels: np.ndarray) -> tuple[int, int, int, bytes, list[int]]:
    """(fingerprint, identity of the set of shingles, its size, its parities, its first shingles) of one text.

    All sets have their shingles in one order, by level, then pseudo-random. Of n the first n - similar * n + 1 are
    given: two sets that have none of these in common have less than similar * n of the larger in common.
    """
    blocks = list(shingle_hashes(text, shingle_words))
    if not blocks:
        return 0, 0, 0, b"", []
    distinct = np.unique(np.concatenate(blocks))
    n = len(distinct)
    order = np.lexsort((distinct * ORDER, levels[(distinct >> np.uint64(46)).astype(np.int64)]))
    keys = distinct[order[: n - int(np.ceil(similar * n - 1e-9)) + 1]]
    return _fingerprint(blocks), xxhash.xxh64_intdigest(distinct.tobytes(), 1), n, parities(distinct), keys.tolist()


def parities(distinct: np.ndarray) -> bytes:
    """Whether an odd number of a set's hashes end in each of the numbers of so many bits, one or two bits a hash."""
    width = max(6, len(distinct).bit_length())
    many = np.bincount((distinct & np.uint64((1 << width) - 1)).astype(np.int64), minlength=1 << width)
    return np.packbits(many & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """How many parities of two sets differ, which is no more than the hashes that only one of them has."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):  # to endings of one bit less
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp) for every row; fp is the unsigned fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in binary_text(b, 1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, fields(("id", T.LongType()), ("fp", T.LongType())))


def ball(fp: str, radius: int):
    """All values within ``radius`` (0 or 1) bits of a column, as an array."""
    if radius not in (0, 1):
        raise ValueError("half the radius must be 0 or 1")
    flips = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)] * radius
    return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.col(fp).bitwiseXOR(x))


def fingerprint_links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) of the reps of distinct fingerprints (fp, rep) that are at most ``radius`` (0 to 2) bits apart.

    Two values within the radius share a variant within half of it, so shuffling every fingerprint's ball on its
    variants brings each close pair together. All that meet at one variant lie in one ball (65 values at most), so a
    link from each to the smallest there keeps every component; each link is verified by its bit count. Only fingerprints
    are shuffled by variant; ids are looked up for the few that are linked.
    """
    variants = classes.select("fp", F.explode(ball("fp", (radius + 1) // 2)).alias("v"))
    met = variants.withColumn("lo", F.min("fp").over(Window.partitionBy("v"))).where(F.col("fp") != F.col("lo"))
    near = settle(met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("lo"))) <= radius).select("fp", "lo").distinct(), "near")
    reps = classes.select(F.col("fp").alias("of"), F.col("rep").alias("b"))
    return near.join(classes.select("fp", F.col("rep").alias("a")), "fp").join(reps, F.col("lo") == F.col("of")).select("a", "b")


def similar_links(docs: DataFrame, keyed: DataFrame, known: DataFrame, id_col: str, text_col: str, shingle_words: int, similar: float) -> DataFrame:
    """Links (a, b), ``known`` ones included, that join all ids whose sets of shingles are at least ``similar`` (Jaccard).

    ``keyed``: a settled row (rep, whole, size, odd, keys) for each set, deleted when its shingles have met. Sets meet at
    each of their first shingles (see ``sketch``), where any two similar ones do. Of a meeting all are first compared with
    two of them, the first by id and the first by another order of ids. Then all pairs of a meeting that no link joins yet
    are compared, none left out but those whose sizes and places of the shingle show that they are less similar: links
    inside a component add nothing to it. Shingles of many texts come last in the order, so that a passage brings together
    only texts that hold little else. A comparison is first of parities, which are small and rule out most; what they leave
    is compared by whole sets, for which only the texts of those pairs are read again.
    """
    classes = settle(keyed.drop("keys"), "classes")
    side = lambda n: classes.select(F.col("rep").alias(f"rep{n}"), F.col("whole").alias(f"whole{n}"), F.col("size").alias(f"size{n}"), F.col("odd").alias(f"odd{n}"))
    near = F.least("size1", "size2") >= F.lit(similar) * F.greatest("size1", "size2") - 1e-6
    held = set(WRITTEN)
    # taken apart twice rather than written: a written table of all first shingles is as large as the texts
    meeting = keyed.select("rep", "size", F.posexplode("keys").alias("at", "key"))
    ends = meeting.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min(F.col("rep").bitwiseXOR(F.lit(MASK))).alias("other")).where("lo < hi")
    drawn = settle(ends.select("key", "lo", F.col("other").bitwiseXOR(F.lit(MASK)).alias("other")), "drawn")
    met = settle(meeting.join(drawn, "key").select("key", "rep", "size", "at", "lo", "other"), "met")
    drop_settled(keyed)
    drop_settled(drawn)
    links, compared = known, None
    for kind in ("some", "rest"):
        if kind == "some":
            ends = met.select("rep", F.explode(F.array("lo", "other")).alias("c")).where("rep <> c")
            pairs = ends.select(F.least("rep", "c").alias("rep1"), F.greatest("rep", "c").alias("rep2")).distinct()
        else:
            groups = settle(connected_components(links), "groups")
            placed = met.join(groups, F.col("rep") == F.col("node"), "left").select("key", "rep", "size", "at", F.coalesce("component", "rep").alias("group"))
            open_keys = placed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
            rest = settle(placed.join(open_keys, "key", "left_semi"), "rest")
            drop_settled(met)
            one, two = (rest.select("key", *[F.col(c).alias(f"{c}{n}") for c in ("rep", "size", "at", "group")]) for n in (1, 2))
            # the sets share at most this shingle and those after it, if it is the first that they share
            most = 1 + F.least(F.col("size1") - F.col("at1"), F.col("size2") - F.col("at2")) - 1
            enough = most * (1 + similar) >= F.lit(similar) * (F.col("size1") + F.col("size2")) - 1e-6
            found = one.join(two, "key").where((F.col("rep1") < F.col("rep2")) & (F.col("group1") != F.col("group2")) & near & enough)
            pairs = found.select("rep1", "rep2").distinct().join(compared, ["rep1", "rep2"], "left_anti")
        drawn = settle(pairs, "pairs")
        if kind == "rest":
            drop_settled(rest)
        compared = drawn
        able = settle(_able(drawn.join(side(1), "rep1").join(side(2), "rep2").where(near), similar), "able", FEW)
        good = settle(_verified(docs, able, id_col, text_col, shingle_words, similar), "verified", FEW)
        links = links.unionByName(good.select(F.col("rep1").alias("a"), F.col("rep2").alias("b")))
    sweep(docs.sparkSession, [p for p in WRITTEN if p not in held], links)
    return links


def _able(pairs: DataFrame, similar: float) -> DataFrame:
    """(rep1, whole1, rep2, whole2) of the pairs with parities that do not rule out similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in slices(batches):
            # sets of a and b hashes, d of them in one only, are (a + b - d) / (a + b + d) similar
            most = (b.column(4).to_numpy() + b.column(5).to_numpy()) * (1 - similar) / (1 + similar) + 1e-6
            d = [apart(x.as_py(), y.as_py()) for x, y in zip(b.column(6), b.column(7))]
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=PAIR.names).filter(pa.array(np.array(d) <= most))

    return pairs.select(*PAIR.names, "size1", "size2", "odd1", "odd2").mapInArrow(run, PAIR)


def _verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, shingle_words: int, similar: float) -> DataFrame:
    """The pairs (rep1, whole1, rep2, whole2) whose sets of shingles are similar; a set is read from a text with the rep's id."""
    wanted = settle(pairs.select(F.explode(F.array("rep1", "rep2")).alias("rep")).distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(wanted, "rep", "left_semi")
    # a text stands once, however many rows have its id: dealt by id as it is, it need not be moved for that, nor need its set
    texts = texts.withColumn("hash", F.xxhash64("text")).dropDuplicates(["rep", "hash"]).select("rep", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in slices(batches):
            sets = [np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(t.as_py(), shingle_words)])).tobytes() for t in binary_text(b, 1)]
            wholes = np.array([xxhash.xxh64_intdigest(x, 1) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wholes), pa.array(sets, pa.binary())], names=["rep", "whole", "grams"])

    grams = texts.mapInArrow(read, fields(("rep", T.LongType()), ("whole", T.LongType()), ("grams", T.BinaryType())))
    # of an id with several texts all sets are here; only those asked for find a pair
    sets = settle(grams, "sets", FEW)
    side = lambda n: sets.select(*[F.col(c).alias(f"{c}{n}") for c in sets.columns])
    names = pairs.columns

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in slices(batches):
            good = []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similar * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=names).filter(pa.array(good, pa.bool_()))

    return pairs.join(side(1), ["rep1", "whole1"]).join(side(2), ["rep2", "whole2"]).select(*names, "grams1", "grams2").mapInArrow(check, pairs.schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """One row (doc_id, fingerprint, component_id, n_links) for every row of ``docs``.

    fingerprint: 16 hex digits. component_id: the smallest id reachable over links of at most ``radius`` differing
    bits, the row's own included; equal fingerprints are linked. n_links: the row's number of other rows with the same
    fingerprint. Null and empty texts have fingerprint 0 and are linked like any other. A row with a null id counts as
    a copy but names no component: if no row of its fingerprint has an id, its component_id is null. Other columns of
    ``docs`` are not read, whatever their names.
    """
    since = len(WRITTEN)
    prints = settle(simhash(docs, id_col, text_col, shingle_words), "prints")
    classes = settle(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    groups = connected_components(fingerprint_links(classes.where("rep is not null"), radius))
    named = settle(classes.join(groups, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "named")
    sweep(docs.sparkSession, WRITTEN[since:], prints, named)
    out = prints.join(named, "fp")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("n") - 1).alias("n_links"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, radius: int = 2, similar: float = 0.8) -> DataFrame:
    """(id, component) for every id that is in a group with another: the smallest id reachable.

    Linked are texts whose fingerprints over shingles of ``shingle_words`` differ in at most ``radius`` bits, and those
    whose sets of shingles have a Jaccard similarity of at least ``similar``, which lie far more than two bits apart;
    none are missed. One pass counts shingles, another computes fingerprints and first shingles. Null and empty texts
    have fingerprint 0 and are one group; rows with a null id belong to none.
    """
    levels = docs.sparkSession.sparkContext.broadcast(levels_of(docs, text_col, shingle_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in slices(batches):
            fp, whole, size, odd, keys = zip(*(sketch(t.as_py(), shingle_words, similar, levels.value) for t in binary_text(b, 1)))
            signed = lambda v: np.array(v, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed(fp)), pa.array(signed(whole)), pa.array(size, pa.int64()), pa.array(odd, pa.binary()), pa.array([signed(k) for k in keys], pa.list_(pa.int64()))], names=SKETCH.names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = settle(rows.mapInArrow(run, SKETCH), "sketches", FEW)
    placed = settle(sketches.where("id is not null").select("id", "fp", "whole"), "placed")
    firsts = [F.first(c).alias(c) for c in ("size", "odd", "keys")]
    keyed = settle(sketches.where("id is not null and size > 0").groupBy("whole").agg(F.min("id").alias("rep"), *firsts), "keyed")
    drop_settled(sketches)
    prints = settle(placed.groupBy("fp").agg(F.min("id").alias("rep")), "prints")
    whole = settle(placed.groupBy("fp", "whole").agg(F.min("id").alias("first")), "wholes")
    # equal fingerprints, and fingerprints near each other; then similar sets
    links = fingerprint_links(prints, radius).unionByName(whole.join(prints, "fp").where("first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b")))
    groups = connected_components(similar_links(docs, keyed, settle(links, "known"), id_col, text_col, shingle_words, similar))
    # a row's class is named by the smallest id with its set and fingerprint
    named = whole.join(groups, F.col("first") == F.col("node"), "left").select("fp", "whole", F.coalesce("component", "first").alias("component"))
    return placed.join(named, ["fp", "whole"]).groupBy("id").agg(F.min("component").alias("component"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, radius: int = 2, similar: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its group of ``similar_groups``.

    Rows that share an id are one document and stay or go together; rows with a null id, which cannot be told apart,
    stay. The anti-join is on ids alone, so texts are shuffled only if the list of ids to drop is too large to send.
    Other columns' names do not matter.
    """
    since, (name,) = len(WRITTEN), unused(docs, "gone")
    groups = similar_groups(docs, id_col, text_col, shingle_words, radius, similar)
    gone = settle(groups.where("id <> component").select(F.col("id").alias(name)), "gone")
    sweep(docs.sparkSession, WRITTEN[since:], gone)
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
