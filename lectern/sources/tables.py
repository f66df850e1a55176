"""The input tables, and adapters that shape them like a document engine's jobs, pages, traces and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Block types that the adapters deal out, in order.
BLOCK_TYPES = ("text", "title", "table", "header", "list")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tagged): every line of a document behind a layout tag whose type and box follow from its place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    types = F.array(*[F.lit(t) for t in BLOCK_TYPES])

    def tag(line, k):
        x0, y0 = (F.col("doc_id") * 7 + k * 13) % 400, (F.col("doc_id") * 3 + k * 29) % 800
        return F.concat(F.lit("<|det|>"), F.get(types, k % 5), F.lit(" ["), x0, F.lit(", "), y0, F.lit(", "), x0 + 100 + (k * 17) % 500, F.lit(", "), y0 + 6 + (k * 11) % 150, F.lit("]<|/det|>"), line)

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), tag), "").alias("tagged"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, step, p1, ent, eos, newline) from events: a user is a stream, its events in order of time are steps."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.coalesce("value", F.lit(0.0))
    return events.select(F.col("user_id").alias("stream"), F.row_number().over(w).alias("step"), (50 / (50 + value)).alias("p1"), F.log1p(value).alias("ent"), (F.col("event_id") % 97 == 0).alias("eos"), (F.col("event_type") == "view").alias("newline"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, slot, role, text) from conversations: a conversation is a job, its turns are pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("slot"), "role", F.coalesce("text", F.lit("")).alias("text"))
