"""Operators on rows of vectors: blockwise top-k, attention inside sequences, n-gram bans and attention mass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrays import top_k
from lectern.functions.core import dot

# The prompt ids that end a reference.
PROMPT_IDS = (37460, 4366, 76466, 16)


def block_top_k(x: Column, block: int, each: int, k: int) -> Column:
    """The k largest of the ``each`` largest of every block of values, as array<struct<i, v>>."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / F.lit(block)).cast("int") - 1), lambda b: F.transform(top_k(F.slice(x, b * block + 1, block), each), lambda t: F.struct((-t["v"]).alias("n"), (t["i"] + b * block).alias("i"))))
    return F.transform(F.slice(F.array_sort(F.flatten(blocks)), 1, k), lambda t: F.struct(t["i"].alias("i"), (-t["n"]).alias("v")))


def attention(rows: DataFrame, mask: Column) -> DataFrame:
    """(seq, pos, keys, out): softmax-weighted mean of the vectors (seq, pos, x) that ``mask`` lets a query see.

    Only vectors of one sequence meet, whose length is bounded by its making; the scale is 1 / sqrt of the width. The
    weighted sum is merged pairwise from (max, sum, vector) states, as for parts of a sequence.
    """
    pairs = rows.alias("q").join(rows.alias("k"), (F.col("q.seq") == F.col("k.seq")) & mask)
    scored = pairs.select(F.col("q.seq").alias("seq"), F.col("q.pos").alias("pos"), F.col("k.x").alias("v"), (dot(F.col("q.x"), F.col("k.x")) / F.sqrt(F.size("q.x").cast("double"))).alias("s"), F.col("k.pos").alias("at"))
    lists = scored.groupBy("seq", "pos").agg(F.count("*").alias("keys"), F.max("s").alias("m"), F.array_sort(F.collect_list(F.struct("at", "s", "v"))).alias("l"))
    zero = F.struct(F.lit(0.0).alias("z"), F.transform(F.get("l", F.lit(0))["v"], lambda _: F.lit(0.0)).alias("acc"))

    def add(a: Column, r: Column) -> Column:
        w = F.exp(r["s"] - F.col("m"))
        return F.struct((a["z"] + w).alias("z"), F.zip_with(a["acc"], r["v"], lambda p, q: p + w * q).alias("acc"))

    return lists.select("seq", "pos", "keys", F.aggregate("l", zero, add, lambda a: F.transform(a["acc"], lambda v: v / a["z"])).alias("out"))


def ngram_bans(tokens: DataFrame, n: int) -> DataFrame:
    """(stream, step, banned) for tokens (stream, step, tok): what would repeat an n-token run that the stream has had.

    A run is found by joining on the stream and its last n - 1 tokens; the earlier one must end before.
    """
    w = Window.partitionBy("stream").orderBy("step")
    gram = F.array(*[F.lag("tok", k).over(w) for k in range(n - 2, 0, -1)], F.col("tok"))
    g = tokens.select("stream", "step", gram.alias("gram"), F.lead("tok").over(w).alias("next"), F.row_number().over(w).alias("nth")).where(F.col("nth") >= n - 1)
    # of equal runs with the same successor only the first is needed, so that no run of many repeats meets itself
    old = g.where(F.col("next").isNotNull()).groupBy("stream", "gram", F.col("next").alias("banned")).agg(F.min("step").alias("before"))
    return g.select("stream", "gram", "step").join(old, ["stream", "gram"]).where("before < step").select("stream", "step", "banned")


def reference_ids(n: Column) -> Column:
    """bos, n visual places (negative: -1, -2, ...), and the prompt."""
    visual = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: -1 - i)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0)), visual, F.array(*[F.lit(i) for i in PROMPT_IDS]))


def mean_mass(rows: DataFrame) -> DataFrame:
    """(page, head, target, mass): attention mass by page, head and target, over the page's steps."""
    steps = rows.groupBy("page").agg(F.count("*").alias("n"))
    return rows.groupBy("page", "head", "target").agg(F.sum("mass").alias("s")).join(steps, "page").select("page", "head", "target", (F.col("s") / F.col("n")).alias("mass"))


def mass_behind(means: DataFrame, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(lag, mean_mass, max_mass): mass on targets at least ``lag`` pages behind: mean over heads then pages, and largest."""
    cells = means.withColumn("lag", F.explode(F.array(*[F.lit(x).cast("long") for x in lags]))).where("page >= lag")
    behind = cells.groupBy("lag", "page", "head").agg(F.sum(F.when(F.col("target") <= F.col("page") - F.col("lag"), F.col("mass")).otherwise(0.0)).alias("b"))
    pages = behind.groupBy("lag", "page").agg(F.avg("b").alias("m"), F.max("b").alias("x"))
    return pages.groupBy("lag").agg(F.avg("m").alias("mean_mass"), F.max("x").alias("max_mass"))


TOKENS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("tokens", T.StringType())])


def stub_model(vectors: np.ndarray) -> list[list[int]]:
    """A fixed stand-in for a model: the places of the eight largest values, then the end token."""
    return [[*map(int, row), 1] for row in np.argsort(-vectors, axis=1, kind="stable")[:, :8]]


def infer(rows: DataFrame, model: Callable[[np.ndarray], list[list[int]]]) -> DataFrame:
    """Runs a model over Arrow batches of (vec_id, x); the extension point for inference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            out = model(x) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([",".join(map(str, t)) for t in out], pa.string())], names=["vec_id", "tokens"])

    return rows.mapInArrow(run, TOKENS)
