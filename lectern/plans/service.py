"""Queries of requests, responses and counters, and their SQL. A conversation is a job, a turn a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import request as Q
from lectern.functions.core import r6
from lectern.operators import confidence as C
from lectern.plans.confidence import TRACE, hundredths, pages
from lectern.plans.jobs import TURNS, WORDS, jobs
from lectern.sources.tables import table, traces, turns


def request_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads made of the pages' urls and taken apart again; every ninth has no end, every eleventh is too long."""
    i = F.col("page_id")
    raw = F.concat(F.when(i % 2 == 0, "POST ").otherwise("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: h\r\nCONTENT-length:  "), (i * 977).cast("string"), F.when(i % 5 == 0, "\r\nContent-Length: 7").otherwise(""), F.when(i % 11 == 3, F.concat(F.lit("\r\nX: "), F.repeat(F.lit("y"), 17000))).otherwise(""), F.when(i % 9 == 1, "\r\n").otherwise("\r\n\r\n"))
    h = table(spark, sf_dir, "pages").where("url is not null").select("page_id", Q.parse_head(raw).alias("h"))
    return h.select("page_id", "h.method", "h.target", F.size("h.headers").cast("long").alias("n_headers"), F.array_join(Q.header_values(F.col("h.headers"), "Content-Length"), ",").alias("lengths"))


def body_spool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of taking in bodies whose length and seconds follow from orders."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.spool_status(k * 99991 % 400000000, F.when(k % 7 == 0, k * 99991 % 400000000 - 1).otherwise(k * 99991 % 400000000), k % 300).cast("long").alias("status"))


def expand_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs' outcomes when their documents are opened; every seventh cannot be read, every eighth is empty."""
    i = F.col("job_id")
    n = F.when(i % 7 == 6, None).when(i % 8 == 5, 0).otherwise(F.col("n_pages"))
    j = jobs(spark, sf_dir).select("job_id", Q.expand_status(n, F.col("list")).alias("s"))
    return j.select("job_id", F.col("s.status").cast("long").alias("status"), "s.error")


def alive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of jobs that are still good."""
    good = expand_status(spark, sf_dir).where("status = 200").select("job_id")
    return turns(spark, sf_dir).select("job_id", "slot").join(good, "job_id", "left_semi")


def job_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of each job's pages: 16 streams in a row are a job."""
    full = C.with_prefill(C.cut_at_end(traces(spark, sf_dir)))
    return C.basics(full).groupBy(F.floor(F.col("stream") / 16).cast("long").alias("job_id")).agg(r6(F.avg("conf"), "mean_conf"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, pages, tokens, truncated, millis) of each conversation; an answer takes a millisecond a word."""
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    t = turns(spark, sf_dir)
    return t.groupBy("job_id").agg(F.count("*").alias("pages"), F.sum(n).cast("long").alias("tokens"), F.sum(((F.col("text") != "") & ~F.col("text").endswith(".")).cast("long")).alias("truncated")).withColumn("millis", F.col("tokens"))


def job_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response's counting headers as a map, shown by name."""
    names = {"X-Pages": "pages", "X-Tokens": "tokens", "X-Truncated-Pages": "truncated", "X-Millis": "millis"}
    headers = F.create_map(*[c for k, v in names.items() for c in (F.lit(k), F.col(v).cast("string"))])
    h = totals(spark, sf_dir).select("job_id", headers.alias("h"))
    return h.select("job_id", F.array_join(F.transform(F.array_sort(F.map_entries("h")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n").alias("headers"))


def conf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-joined confidences of jobs of up to MAX_CONF_PAGES pages; larger jobs have no such header.

    Here a job is all streams of one remainder of 3, cut to two decimals, and the limit 40 pages.
    """
    p = pages(spark, sf_dir).select((F.col("stream") % 3).alias("job_id"), "stream", hundredths(F.col("conf")).alias("c"))
    few = p.groupBy("job_id").agg(F.count("*").alias("n"))
    listed = p.join(few.where(F.col("n") <= 40).select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("stream", "c"))).alias("p"))
    return few.join(listed, "job_id", "left").select("job_id", "n", F.array_join("p.c", ",").alias("conf"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's line of each conversation as a finished job."""
    i = F.col("job_id")
    mode = F.when(i % 3 == 0, "auto-hires").when(i % 3 == 1, "hires").otherwise("base")
    return totals(spark, sf_dir).select("job_id", Q.job_log(mode, F.col("pages"), F.col("tokens"), F.col("truncated"), (i % 5) * 0.25, F.when(i % 10 == 0, 422).otherwise(200), F.col("millis").cast("double")).alias("line"))


def health_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done, failed and still queued jobs at the end of each hour, from events: a purchase ends a job well, a click badly, all others queue one."""
    e = table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "click").alias("failed"), F.count("*").alias("seen"))
    so_far = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # 24 rows at most
    return e.select("hour", *[F.sum(c).over(so_far).alias(c) for c in ("done", "failed")], F.greatest(F.lit(0), F.sum(F.col("seen") - 2 * F.col("done") - 2 * F.col("failed")).over(so_far)).alias("queued"))


def connection_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections by second of arrival in each hour: 64 at a time are served, others are told when to try again."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.date_trunc("hour", "ts").alias("h"))
    nth = F.row_number().over(Window.partitionBy("h").orderBy("ts", "event_id"))
    return e.withColumn("nth", nth).select("event_id", F.when(F.col("nth") <= 64, 200).otherwise(503).cast("long").alias("status"), F.when(F.col("nth") > 64, Q.RETRY_AFTER).cast("long").alias("retry_after"))


def step_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that count of each stream, and whether it was cut; the cap is 60 here, as no stream has as many as the engine's."""
    return C.cap_steps(traces(spark, sf_dir), 60)


def job_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each job's last page is done: an order is a job, its lines are pages, done at their ship date."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("pages"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("done_at"), F.count_if(F.col("l_linestatus") == "O").alias("pending"))
    return li.select("job_id", "pages", "pending", F.when(F.col("pending") == 0, F.col("done_at")).alias("done_at"))


QUERIES = {f.__name__: f for f in (request_head, body_spool, expand_status, alive_pages, job_confidence, job_headers, conf_header, job_log, health_counters, connection_admit, step_cap, job_completion)}
JOBS = "j AS (SELECT job_id, count(*) AS n0 FROM t GROUP BY job_id), x AS (SELECT job_id, CASE WHEN job_id % 7 = 6 THEN NULL WHEN job_id % 8 = 5 THEN 0 ELSE n0 END AS n, CASE WHEN job_id % 3 = 1 THEN [n0 - 1, 0, job_id % 5] END AS l FROM j), m AS (SELECT *, list_filter(l, lambda p: p >= n)[1] AS missing FROM x)"
STATUS = f"""{TURNS}, {JOBS}, st AS (SELECT job_id, CASE WHEN n IS NULL OR n = 0 THEN 422 WHEN missing IS NOT NULL THEN 400 ELSE 200 END::BIGINT AS status,
    CASE WHEN n IS NULL THEN 'cannot open document' WHEN n = 0 THEN 'empty document' WHEN missing IS NOT NULL THEN 'page ' || (missing + 1) || ' out of range (document has ' || n || ')' ELSE '' END AS error FROM m)"""
TOTALS = f"{TURNS}, nw AS (SELECT *, len({WORDS}) AS k FROM t), tt AS (SELECT job_id, count(*) AS pages, sum(k)::BIGINT AS tokens, count_if(text <> '' AND NOT ends_with(text, '.'))::BIGINT AS truncated FROM nw GROUP BY job_id)"
SQL = {
    "request_head": """SELECT page_id, CASE WHEN good THEN CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END END AS method, CASE WHEN good THEN url END AS target,
        CASE WHEN good THEN 2 + (page_id % 5 = 0)::INT END::BIGINT AS n_headers, CASE WHEN good THEN (page_id * 977) || CASE WHEN page_id % 5 = 0 THEN ',7' ELSE '' END END AS lengths
        FROM (SELECT *, page_id % 9 <> 1 AND page_id % 11 <> 3 AND NOT contains(url, ' ') AS good FROM pages WHERE url IS NOT NULL)""",
    "body_spool": "SELECT o_orderkey, CASE WHEN o_orderkey * 99991 % 400000000 > 268435456 THEN 413 WHEN o_orderkey % 7 = 0 OR o_orderkey % 300 > greatest(60, (o_orderkey * 99991 % 400000000) // 1048576) THEN 400 ELSE 200 END::BIGINT AS status FROM orders",
    "expand_status": f"WITH {STATUS} SELECT * FROM st",
    "alive_pages": f"WITH {STATUS} SELECT t.job_id, slot FROM t JOIN st USING (job_id) WHERE status = 200",
    "job_confidence": f"WITH {TRACE} SELECT stream // 16 AS job_id, round(avg(conf), 6) + 0.0::DOUBLE AS mean_conf FROM basic GROUP BY 1",
    "job_headers": f"WITH {TOTALS} SELECT job_id, 'X-Millis: ' || tokens || chr(10) || 'X-Pages: ' || pages || chr(10) || 'X-Tokens: ' || tokens || chr(10) || 'X-Truncated-Pages: ' || truncated AS headers FROM tt",
    "conf_header": f"""WITH {TRACE}, c AS (SELECT stream % 3 AS job_id, stream, floor(conf * 100 + 0.5)::BIGINT AS h FROM basic)
        SELECT job_id, count(*) AS n, CASE WHEN count(*) <= 40 THEN string_agg((h // 100) || '.' || lpad((h % 100)::VARCHAR, 2, '0'), ',' ORDER BY stream) END AS conf FROM c GROUP BY job_id""",
    "job_log": f"""WITH {TOTALS} SELECT job_id, '[job] ' || CASE job_id % 3 WHEN 0 THEN 'auto-hires' WHEN 1 THEN 'hires' ELSE 'base' END || ' pages=' || pages || ' tok=' || tokens || ' trunc=' || truncated
        || ' conf=' || printf('%.2f', (job_id % 5) * 0.25::DOUBLE) || ' status=' || CASE WHEN job_id % 10 = 0 THEN 422 ELSE 200 END || ' ' || tokens || ' ms' AS line FROM tt""",
    "health_counters": """WITH e AS (SELECT hour(ts)::BIGINT AS hour, count_if(event_type = 'purchase') AS done, count_if(event_type = 'click') AS failed, count(*) AS seen FROM events GROUP BY 1)
        SELECT hour, sum(done) OVER w::BIGINT AS done, sum(failed) OVER w::BIGINT AS failed, greatest(0, sum(seen - 2 * done - 2 * failed) OVER w)::BIGINT AS queued FROM e WINDOW w AS (ORDER BY hour)""",
    "connection_admit": "WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS nth FROM events) SELECT event_id, CASE WHEN nth <= 64 THEN 200 ELSE 503 END::BIGINT AS status, CASE WHEN nth > 64 THEN 5 END::BIGINT AS retry_after FROM n",
    "step_cap": "WITH t AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id % 97 = 0 AS eos FROM events), c AS (SELECT stream, count(*) AS n, min(step) FILTER (eos) AS last FROM t GROUP BY stream) SELECT stream, least(coalesce(last, n), n, 60) AS steps, coalesce(last, 1000000) > 60 AND n >= 60 AS truncated FROM c",
    "job_completion": "SELECT l_orderkey AS job_id, count(*) AS pages, count_if(l_linestatus = 'O') AS pending, CASE WHEN count_if(l_linestatus = 'O') = 0 THEN strftime(max(l_shipdate), '%Y-%m-%d') END AS done_at FROM lineitem GROUP BY l_orderkey",
}
