"""Streaming queries; each must give what the same batch query gives, which the SQL states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.core import r6
from lectern.plans.confidence import TRACE
from lectern.sources.tables import table, turns
from lectern.streaming import jobs as S

# Places of a class, and shares that they are divided among.
PLACES, SHARES = 16, 4


def stream_admission(spark, sf_dir):
    """Pages' places: a page is done when the fourth after it in its share arrives, so that a place is free again just then."""
    t = turns(spark, sf_dir).select(F.when(F.col("role") == "assistant", "big").otherwise("base").alias("class"), (F.col("job_id") * 1000 + F.col("slot")).alias("page"))
    w = Window.partitionBy("class", F.col("page") % SHARES).orderBy("page")
    arrivals = t.withColumns({"at": F.col("page") * 2 + 1, "done": F.lit(False)})
    ends = t.withColumn("next", F.lead("page", PLACES // SHARES).over(w)).where("next is not null").select("class", "page", (F.col("next") * 2).alias("at"), F.lit(True).alias("done"))
    return S.drain(S.admit(S.stream_parts(arrivals.unionByName(ends), "at"), PLACES, SHARES), "admission").select("class", "share", "page", F.col("place").cast("long").alias("place"))


def stream_retire(spark, sf_dir):
    """Streams at their end token: events by number, in four batches."""
    e = table(spark, sf_dir, "events")
    steps = e.select(F.col("user_id").alias("stream"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", (50 / (50 + F.coalesce("value", F.lit(0.0)))).alias("p1"), (F.col("event_id") % 97 == 0).alias("eos"))
    order = Window.partitionBy("stream").orderBy("us", "event_id")
    return S.drain(S.retire(S.stream_parts(steps.withColumn("at", F.row_number().over(order).cast("long")).drop("us", "event_id"), "at")), "retire").select("stream", "ntok", r6(F.col("conf"), "conf"))


def stream_completion(spark, sf_dir):
    """Jobs when all their pages are done; pages come by slot, so that a job is spread over the batches."""
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    t = turns(spark, sf_dir)
    pages = t.select("job_id", F.col("slot").alias("page"), n.cast("long").alias("words")).join(t.groupBy("job_id").agg(F.count("*").alias("pages")), "job_id")
    return S.drain(S.complete(S.stream_parts(pages, "page")), "completion")


def stream_retry(spark, sf_dir):
    """Pages of each batch: pass 1, flagged if over a fifth of its words repeat; flagged ones take their second pass."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def each(batch):
        share = F.transform(F.array(w), lambda x: F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)))[0]
        first = batch.select("job_id", "slot", share.alias("p10"), F.size(w).cast("long").alias("words"))
        again = first.where("p10 < 0.8").select("job_id", "slot", (F.col("words") * 2).alias("words2"))
        return first.join(again, ["job_id", "slot"], "left").select("job_id", "slot", F.coalesce("words2", "words").alias("words"), F.col("words2").isNotNull().alias("retried"))

    return S.drain_batches(S.stream_parts(turns(spark, sf_dir), "job_id"), "retry", each, "job_id long, slot long, words long, retried boolean")


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
QUERIES = {f.__name__: f for f in (stream_admission, stream_retire, stream_completion, stream_retry)}
SQL = {
    "stream_admission": """WITH t AS (SELECT CASE WHEN role = 'assistant' THEN 'big' ELSE 'base' END AS class, conv_id * 1000 + turn AS page FROM conversations)
        SELECT class, page % 4 AS share, page, (row_number() OVER (PARTITION BY class, page % 4 ORDER BY page) - 1) % 4 AS place FROM t""",
    "stream_retire": f"WITH {TRACE} SELECT f.stream, count(*) AS ntok, round(avg(p1), 6) + 0.0::DOUBLE AS conf FROM f JOIN ends USING (stream) GROUP BY f.stream",
    "stream_completion": f"SELECT conv_id AS job_id, count(*) AS pages, sum(len({WORDS}))::BIGINT AS words FROM conversations GROUP BY conv_id",
    "stream_retry": f"WITH p AS (SELECT conv_id AS job_id, turn AS slot, {WORDS} AS w FROM conversations), q AS (SELECT job_id, slot, len(w) AS n, len(list_distinct(w)) / greatest(len(w), 1) < 0.8 AS retried FROM p) SELECT job_id, slot, (CASE WHEN retried THEN 2 * n ELSE n END)::BIGINT AS words, retried FROM q",
}
