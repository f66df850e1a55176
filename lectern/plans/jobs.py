"""Job queries, and their SQL. A conversation is a job, a turn a page, an assistant's page hi-res."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.core import r6
from lectern.operators import jobs as J
from lectern.operators.ranking import cumulate
from lectern.sources.tables import table, turns

# Page specifications that the adapter deals out, in order.
SPECS = ("3", "2,1", "3,", ",1", "0", "1,0", "a", "", "1,1,2")


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(*[F.lit(s) for s in SPECS])
    return table(spark, sf_dir, "pages").select("page_id", "url", F.get(items, (F.col("page_id") % len(SPECS)).cast("int")).alias("spec"))


def page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = specs(spark, sf_dir).select("page_id", J.page_spec(F.col("spec")).alias("p"))
    return s.select("page_id", F.col("p.status").cast("long").alias("status"), F.col("p.first").cast("long").alias("first_n"), F.array_join("p.list", ",").alias("pages"))


def url_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", J.url_param(F.col("url"), "page").alias("page"), J.url_param(F.col("url"), "ref").alias("ref"), J.url_param(F.col("url"), "utm_source").alias("source"))
    return p.withColumn("m", J.mode_flags(F.col("page"), F.col("ref"), F.col("page"))).select("page_id", "page", "ref", "source", "m.hires", "m.auto", "m.feats")


def pick(c: Column, *values: str | None) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (c % len(values)).cast("int"))


def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    r = specs(spark, sf_dir).select(
        "page_id", pick(i, "POST", "POST", "GET", "POST", "HEAD", "POST").alias("method"), pick(F.floor(i / 6), "/ocr", "/ocr", "/ocr", "/healthz", "/", "/ocr", "/x").alias("path"),
        ((i * 977) % 20000).alias("head"), (i % 13 == 5).alias("te"), F.when(i % 11 == 3, F.array(F.lit("5"), F.lit("5"))).when(i % 11 == 4, F.array(F.lit("x1"))).when(i % 11 == 5, F.array().cast("array<string>")).otherwise(F.array((i * 1299709).cast("string"))).alias("lengths"),
        F.when(i % 2 == 0, F.col("spec")).alias("spec"), (i % 19).alias("queued"),
    )
    return r.select("page_id", J.request_status(*[F.col(c) for c in ("method", "path", "head", "te", "lengths", "spec", "queued")]).cast("long").alias("status"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, n_pages, first, list): every third job asks for its first two pages, every next one for a list."""
    sizes = turns(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("n_pages"))
    i = F.col("job_id")
    return sizes.select("job_id", "n_pages", F.when(i % 3 == 0, 2).alias("first"), F.when(i % 3 == 1, F.array((F.col("n_pages") - 1).cast("int"), F.lit(0), (i % 5).cast("int"))).alias("list"))


def expand_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = J.expand_pages(jobs(spark, sf_dir))
    pages = turns(spark, sf_dir).select("job_id", F.col("slot").alias("pdfpage"), "role")
    return items.join(pages, ["job_id", "pdfpage"]).select("job_id", F.col("slot").cast("long").alias("slot"), F.col("pdfpage").cast("long").alias("pdfpage"), "role")


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's turn: one page of each job at a time, jobs in order, each class of pages for itself."""
    t = turns(spark, sf_dir).withColumn("class", F.when(F.col("role") == "assistant", "big").otherwise("base"))
    nth = F.row_number().over(Window.partitionBy("job_id", "class").orderBy("slot")) - 1
    t = t.select("job_id", "slot", "class", nth.alias("round"), F.lit(1).cast("long").alias("n"))
    # the first round has a page of every job: places in a round are numbered in buckets, not in a task
    inside = cumulate(t, "job_id", ["class", "round"], name="inside")
    per = t.groupBy("class", "round").agg(F.sum("n").alias("n"))
    before = cumulate(per, "round", ["class"], name="before").drop("n")
    return inside.join(before, ["class", "round"]).select("job_id", "slot", "class", (F.col("before") + F.col("inside")).alias("turn"))


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass 1 of every page, and pass 2 of the assistant's, a word longer."""
    first = turns(spark, sf_dir).withColumn("pass", F.lit(1))
    return first.unionByName(first.where("role = 'assistant'").withColumns({"pass": F.lit(2), "text": F.concat("text", F.lit(" (again)"))}))


def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.retry_merge(passes(spark, sf_dir), ["job_id", "slot"], "pass")
    return out.select("job_id", "slot", F.col("pass").cast("long").alias("pass"), F.length("text").cast("long").alias("n_chars"))


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a made-up confidence quantile: the share of distinct words."""
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return turns(spark, sf_dir).withColumn("p10", F.transform(F.array(w), lambda x: F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)))[0])


def auto_hires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are read again in high resolution: flagged, not yet in it, of jobs that ask for no resolution; 512 a job."""
    flagged = risks(spark, sf_dir).where((F.col("p10") < 0.85) & (F.col("role") != "assistant") & (F.col("job_id") % 4 != 0))
    w = Window.partitionBy("job_id").orderBy("slot")
    return flagged.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 512).select("job_id", "slot", F.col("n").cast("long").alias("retry_no"), r6(F.col("p10"), "p10"))


def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, words and truncated pages (those that end without a full stop) of each job."""
    t = turns(spark, sf_dir)
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    return t.groupBy("job_id").agg(F.count("*").alias("pages"), F.sum(n).cast("long").alias("tokens"), F.sum(((F.col("text") != "") & ~F.col("text").endswith(".")).cast("long")).alias("truncated"), r6(F.avg(n), "mean_tokens"))


def queue_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by hour: the first 16 of each minute are admitted, later ones rejected."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.date_trunc("minute", "ts").alias("minute"))
    w = Window.partitionBy("minute").orderBy("ts", "event_id")
    a = e.withColumn("ok", F.row_number().over(w) <= 16)
    return a.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.sum(F.col("ok").cast("long")).alias("admitted"), F.sum((~F.col("ok")).cast("long")).alias("rejected"))


def glyph_p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glyph for each character above a space of the pages' urls, sized by its place; pages under 12 pixels go to hi-res."""
    chars = F.filter(F.split("url", ""), lambda c: c > " ")
    p = table(spark, sf_dir, "pages").select("page_id", J.glyph_p25(F.transform(chars, lambda c, i: ((F.col("page_id") * 7 + i * 3) % 90) * 0.25)).alias("px10"))
    return p.select("page_id", "px10", F.coalesce((F.col("px10") >= 0) & (F.col("px10") < J.GLYPH_LIMIT), F.lit(False)).alias("hires"))


def pair_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with both passes, side by side."""
    p = passes(spark, sf_dir)
    base = p.where("pass = 1").select("job_id", "slot", F.length("text").cast("long").alias("base_chars"))
    high = p.where("pass = 2").select("job_id", "slot", F.length("text").cast("long").alias("hires_chars"))
    return base.join(high, ["job_id", "slot"])


def todo_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label yet."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def split_cal_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for calibration (even, of known sources) and for the test (odd, or of source src0)."""
    d = table(spark, sf_dir, "documents")
    part = F.when((F.col("source") != "src0") & (F.col("doc_id") % 2 == 0), "calibrate").otherwise("test")
    return d.groupBy("source", part.alias("part")).agg(F.count("*").alias("pages"))


def fixture_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest and mean absolute difference between the embeddings and themselves in steps of 1/128, by label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x"))
    d = F.abs(F.col("x").cast("double") - F.rint(F.col("x").cast("double") * 128) / 128)
    return e.groupBy("label").agg(r6(F.max(d), "max_abs"), r6(F.avg(d), "mean_abs"))


def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: events and their mean value by day and type."""
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean_value"))
    return e.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean_value")


def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: events in two-day windows that start every day."""
    e = table(spark, sf_dir, "events").select(F.explode(F.array(F.date_trunc("day", "ts"), F.date_trunc("day", "ts") - F.expr("interval 1 day"))).alias("start"))
    return e.groupBy("start").agg(F.count("*").alias("n")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: sessions of a user, apart by more than six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")
    e = table(spark, sf_dir, "events").withColumn("new", F.coalesce(gap > 21600, F.lit(True)).cast("long"))
    return e.groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("n"))


def revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: revenue by return flag and line status, with totals."""
    li = table(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg((F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)).alias("revenue"), F.count("*").alias("n"))


SPEC_SQL = "specs AS (SELECT page_id, url, ['3','2,1','3,',',1','0','1,0','a','','1,1,2'][page_id % 9 + 1] AS spec FROM pages)"
PARSED = r"""parsed AS (SELECT *, regexp_full_match(spec, '[0-9,]+') AS chars, contains(spec, ',') AS many, string_split(regexp_replace(spec, ',$', ''), ',') AS e FROM specs),
    spec2 AS (SELECT *, CASE WHEN chars AND NOT many AND TRY_CAST(spec AS BIGINT) >= 1 THEN TRY_CAST(spec AS BIGINT) END AS first_n,
    CASE WHEN chars AND many AND list_bool_and(list_transform(e, lambda x: regexp_full_match(x, '[0-9]{1,9}') AND coalesce(TRY_CAST(x AS BIGINT), 0) >= 1)) THEN list_transform(e, lambda x: TRY_CAST(x AS BIGINT) - 1) END AS pages FROM parsed)"""


def _param(name: str) -> str:
    q = rf"list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: starts_with(p, '{name}='))"
    return f"url_decode(substring({q}[1], {len(name) + 2}))"


TURNS = "t AS (SELECT conv_id AS job_id, turn AS slot, role, coalesce(text, '') AS text FROM conversations)"
WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
R = "round({0}, 6) + 0.0::DOUBLE AS {0}"
PASSES = f"{TURNS}, p AS (SELECT *, 1 AS pass FROM t UNION ALL SELECT job_id, slot, role, text || ' (again)', 2 FROM t WHERE role = 'assistant')"

QUERIES = {f.__name__: f for f in (request_status, page_spec, url_param, expand_pages, round_robin, retry_merge, auto_hires, job_summary, queue_admit, glyph_p25, pair_modes, todo_anti, split_cal_test, fixture_diff, event_tumbling, event_sliding, event_session, revenue_rollup)}
SQL = {
    "page_spec": f"WITH {SPEC_SQL}, {PARSED} SELECT page_id, CASE WHEN first_n IS NOT NULL OR pages IS NOT NULL THEN 200 ELSE 400 END::BIGINT AS status, first_n, array_to_string(pages, ',') AS pages FROM spec2",
    "url_param": f"""WITH p AS (SELECT page_id, {_param('page')} AS page, {_param('ref')} AS ref, {_param('utm_source')} AS source FROM pages)
        SELECT *, coalesce(page = '1', false) AS hires, coalesce(ref <> '0', true) AS auto, coalesce(page = '1', false) AS feats FROM p""",
    "request_status": f"""WITH {SPEC_SQL}, {PARSED}, r AS (SELECT page_id, ['POST','POST','GET','POST','HEAD','POST'][page_id % 6 + 1] AS method, ['/ocr','/ocr','/ocr','/healthz','/','/ocr','/x'][(page_id // 6) % 7 + 1] AS path,
        (page_id * 977) % 20000 AS head, page_id % 13 = 5 AS te, page_id % 11 AS m, page_id * 1299709 AS len, page_id % 2 = 0 AS has_spec, first_n IS NOT NULL OR pages IS NOT NULL AS spec_ok, page_id % 19 AS queued FROM spec2)
        SELECT page_id, CASE WHEN head > 16384 THEN 400 WHEN path = '/healthz' THEN CASE WHEN method IN ('GET','HEAD') THEN 200 ELSE 405 END WHEN path = '/' AND method IN ('GET','HEAD') THEN 200 WHEN path <> '/ocr' THEN 404
        WHEN method <> 'POST' THEN 405 WHEN te THEN 501 WHEN m IN (3, 4) THEN 400 WHEN m = 5 THEN 411 WHEN len > 268435456 THEN 413 WHEN has_spec AND NOT spec_ok THEN 400 WHEN queued >= 16 THEN 503 ELSE 200 END::BIGINT AS status FROM r""",
    "expand_pages": f"""WITH {TURNS}, j AS (SELECT job_id, count(*) AS n FROM t GROUP BY job_id), l AS (SELECT job_id, n, CASE WHEN job_id % 3 = 1 THEN [n - 1, 0, job_id % 5] WHEN job_id % 3 = 0 THEN range(0, least(n, 2)) ELSE range(0, n) END AS l FROM j),
        x AS (SELECT job_id, unnest(l) AS pdfpage, generate_subscripts(l, 1) - 1 AS slot FROM l WHERE list_max(l) < n) SELECT x.job_id, x.slot, pdfpage, role FROM x JOIN t ON t.job_id = x.job_id AND t.slot = x.pdfpage""",
    "round_robin": f"""WITH {TURNS}, c AS (SELECT *, CASE WHEN role = 'assistant' THEN 'big' ELSE 'base' END AS class FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY job_id, class ORDER BY slot) AS rd FROM c)
        SELECT job_id, slot, class, row_number() OVER (PARTITION BY class ORDER BY rd, job_id) - 1 AS turn FROM n""",
    "retry_merge": f"WITH {PASSES} SELECT job_id, slot, max(pass)::BIGINT AS pass, length(arg_max(text, pass)) AS n_chars FROM p GROUP BY job_id, slot",
    "auto_hires": f"""WITH {TURNS}, q AS (SELECT *, len(list_distinct({WORDS})) / greatest(len({WORDS}), 1) AS p10 FROM t), f AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY slot) AS retry_no FROM q WHERE p10 < 0.85 AND role <> 'assistant' AND job_id % 4 <> 0)
        SELECT job_id, slot, retry_no, {R.format('p10')} FROM f WHERE retry_no <= 512""",
    "job_summary": f"WITH {TURNS}, n AS (SELECT *, len({WORDS}) AS k FROM t) SELECT job_id, count(*) AS pages, sum(k)::BIGINT AS tokens, count_if(text <> '' AND NOT ends_with(text, '.'))::BIGINT AS truncated, round(avg(k), 6) + 0.0::DOUBLE AS mean_tokens FROM n GROUP BY job_id",
    "queue_admit": "WITH a AS (SELECT ts, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) <= 16 AS ok FROM events) SELECT hour(ts)::BIGINT AS hour, count_if(ok)::BIGINT AS admitted, count_if(NOT ok)::BIGINT AS rejected FROM a GROUP BY 1",
    "glyph_p25": """WITH c AS (SELECT page_id, list_sort(list_transform(list_filter(string_split(url, ''), lambda x: x > ' '), lambda x, i: ((page_id * 7 + (i - 1) * 3) % 90) * 0.25::DOUBLE)) AS s FROM pages),
        p AS (SELECT page_id, CASE WHEN len(s) >= 20 THEN floor(s[len(s) // 4 + 1] * 10)::BIGINT END AS px10 FROM c) SELECT page_id, px10, coalesce(px10 >= 0 AND px10 < 120, false) AS hires FROM p""",
    "pair_modes": f"WITH {PASSES} SELECT b.job_id, b.slot, length(b.text) AS base_chars, length(h.text) AS hires_chars FROM p b JOIN p h ON b.job_id = h.job_id AND b.slot = h.slot AND b.pass = 1 AND h.pass = 2",
    "todo_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "split_cal_test": "SELECT source, CASE WHEN source <> 'src0' AND doc_id % 2 = 0 THEN 'calibrate' ELSE 'test' END AS part, count(*) AS pages FROM documents GROUP BY ALL",
    "fixture_diff": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings), d AS (SELECT label, abs(x - round_even(x * 128, 0) / 128) AS d FROM x) SELECT label, round(max(d), 6) + 0.0::DOUBLE AS max_abs, round(avg(d), 6) + 0.0::DOUBLE AS mean_abs FROM d GROUP BY label",
    "event_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) + 0.0::DOUBLE AS mean_value FROM events GROUP BY ALL",
    "event_sliding": "WITH s AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) SELECT strftime(start, '%Y-%m-%d') AS start, count(*) AS n FROM s GROUP BY 1",
    "event_session": "WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, count_if(gap IS NULL OR gap > 21600000000)::BIGINT AS sessions, count(*) AS n FROM g GROUP BY user_id",
    "revenue_rollup": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
