"""Page features from token-confidence traces, and the rules that read them.

A trace has one row a step: (stream, step from 1, p1, ent, eos, newline). Streams are cut at their first end token, and
start with a prefill step of certainty ``CONF0`` and entropy 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The feature rules' constants.
CONF0, ENT0 = 1.0, 0.0
LOW, WINDOW, REGION, P10_LIMIT = 0.5, 32, 24, 0.85
DEGENERATE_RISK = 0.95
OLD_CONF, OLD_LOW = 0.80, 0.20
#: Steps after which a stream is given up.
MAX_STEPS = 4096


def cut_at_end(trace: DataFrame) -> DataFrame:
    """Steps up to and with each stream's first end token."""
    first = F.min(F.when(F.col("eos"), F.col("step"))).over(Window.partitionBy("stream"))
    return trace.withColumn("__end", first).where("__end is null or step <= __end").drop("__end")


def cap_steps(trace: DataFrame, most: int = MAX_STEPS) -> DataFrame:
    """(stream, steps, truncated): how many steps of a stream count, and whether it was cut before an end token came."""
    cut = cut_at_end(trace.where(F.col("step") <= most))
    return cut.groupBy("stream").agg(F.count("*").alias("steps"), (~F.max("eos")).alias("open")).select("stream", "steps", (F.col("open") & (F.col("steps") >= most)).alias("truncated"))


def with_prefill(trace: DataFrame) -> DataFrame:
    """Adds step 0, the prefill token, to each stream."""
    start = trace.select("stream").distinct().select("stream", F.lit(0).alias("step"), F.lit(CONF0).alias("p1"), F.lit(ENT0).alias("ent"), F.lit(False).alias("eos"), F.lit(False).alias("newline"))
    return trace.select("stream", "step", "p1", "ent", "eos", "newline").unionByName(start)


def basics(full: DataFrame) -> DataFrame:
    """(stream, conf, lowf, emean, ntok, p10) of streams with their prefill step; p10 is a sample value, not interpolated."""
    return full.groupBy("stream").agg(
        F.avg("p1").alias("conf"), F.avg((F.col("p1") < LOW).cast("double")).alias("lowf"), F.avg("ent").alias("emean"), F.count("*").alias("ntok"),
        F.sort_array(F.collect_list("p1")).alias("p"),
    ).withColumn("p10", F.get("p", F.floor((F.size("p") - 1) * F.lit(0.1)).cast("int"))).drop("p")


def windows(full: DataFrame) -> DataFrame:
    """(stream, wminp, wment): extremes of the means of full sliding windows, or the stream's mean if none is full."""
    w = Window.partitionBy("stream").orderBy("step").rowsBetween(1 - WINDOW, 0)
    means = full.withColumns({"wp": F.avg("p1").over(w), "we": F.avg("ent").over(w)})
    inside = F.col("step") >= WINDOW - 1
    out = means.groupBy("stream").agg(F.count("*").alias("m"), F.min(F.when(inside, F.col("wp"))).alias("lo"), F.max(F.when(inside, F.col("we"))).alias("hi"), F.avg("p1").alias("conf"), F.avg("ent").alias("emean"))
    short = F.col("m") <= WINDOW
    return out.select("stream", F.when(short, F.col("conf")).otherwise(F.col("lo")).alias("wminp"), F.when(short, F.col("emean")).otherwise(F.col("hi")).alias("wment"))


def regions(trace: DataFrame) -> DataFrame:
    """(stream, regp): the smallest mean of a line region, without the prefill step.

    A region ends at a line's end once it has REGION steps, and at the stream's end; a short last one counts only if it
    is the only one.
    """
    steps = F.array_sort(F.collect_list(F.struct("step", "p1", "newline")))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("best"))

    def add(a: Column, x: Column) -> Column:
        s, n = a["s"] + x["p1"], a["n"] + 1
        close = x["newline"] & (n >= REGION)
        return F.struct(F.when(close, 0.0).otherwise(s).alias("s"), F.when(close, 0).otherwise(n).alias("n"), F.when(close, F.least(a["best"], s / n)).otherwise(a["best"]).alias("best"))

    def end(a: Column) -> Column:
        last = (a["n"] > 0) & ((a["n"] >= REGION) | a["best"].isNull())
        return F.when(last, F.least(a["best"], a["s"] / F.greatest(a["n"], F.lit(1)))).otherwise(a["best"])

    return trace.groupBy("stream").agg(F.aggregate(steps, start, add, end).alias("regp"))


def page_features(trace: DataFrame) -> DataFrame:
    """All eight features of every stream."""
    cut = cut_at_end(trace)
    full = with_prefill(cut)
    out = basics(full).join(windows(full), "stream").join(regions(cut), "stream", "left")
    return out.withColumn("regp", F.coalesce("regp", "conf"))


def risk(p10: Column, degenerate: Column) -> Column:
    return F.greatest(1 - p10, F.when(degenerate, DEGENERATE_RISK).otherwise(0.0))


def flagged(p10: Column, degenerate: Column) -> Column:
    """Whether a page is to be read again; compared on p10 itself, as 1 - p10 rounds."""
    return (p10 < P10_LIMIT) | degenerate


def verdict(conf: Column, lowf: Column, degenerate: Column) -> Column:
    """struct(bad, chip) of the older rule on means: a loop first, then low confidence."""
    chip = F.concat(F.lit("conf "), F.floor(conf * 100 + 0.5).cast("string"), F.lit("%"))
    low = (conf < OLD_CONF) | (lowf > OLD_LOW)
    return F.when(degenerate, F.struct(F.lit(True).alias("bad"), F.lit("loop").alias("chip"))).when(conf > 0, F.struct(low.alias("bad"), chip.alias("chip"))).otherwise(F.struct(F.lit(False).alias("bad"), F.lit("").alias("chip")))
