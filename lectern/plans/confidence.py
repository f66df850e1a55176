"""Confidence queries over event traces, and their SQL. A stream's page text is the document of the same number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.core import r6
from lectern.operators import confidence as C
from lectern.plans.text import DOCS, _degenerate, degenerate
from lectern.sources.tables import traces


def cut_at_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cut_at_end(traces(spark, sf_dir)).select("stream", F.col("step").cast("long").alias("step"), r6(F.col("p1"), "p1"))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_prefill(C.cut_at_end(traces(spark, sf_dir)))


def conf_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.basics(full(spark, sf_dir)).select("stream", "ntok", r6(F.col("conf"), "conf"), r6(F.col("lowf"), "lowf"), r6(F.col("emean"), "emean"))


def conf_p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.basics(full(spark, sf_dir)).select("stream", r6(F.col("p10"), "p10"))


def conf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.windows(full(spark, sf_dir)).select("stream", r6(F.col("wminp"), "wminp"), r6(F.col("wment"), "wment"))


def conf_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.regions(C.cut_at_end(traces(spark, sf_dir))).select("stream", r6(F.col("regp"), "regp"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, degenerate, risk and flag of every stream."""
    bad = degenerate(spark, sf_dir).select(F.col("doc_id").alias("stream"), "degenerate")
    p = C.page_features(traces(spark, sf_dir)).join(bad, "stream", "left").withColumn("degenerate", F.coalesce("degenerate", F.lit(False)))
    return p.withColumns({"risk": C.risk(F.col("p10"), F.col("degenerate")), "flagged": C.flagged(F.col("p10"), F.col("degenerate"))})


def page_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("stream", r6(F.col("risk"), "risk"))


def flagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where("flagged").select("stream", r6(F.col("p10"), "p10"), "degenerate")


def verdict_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("stream", C.verdict(F.col("conf"), F.col("lowf"), F.col("degenerate")).alias("v")).select("stream", "v.bad", "v.chip")


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by job: 16 streams in a row make a job, in order."""
    return pages(spark, sf_dir).withColumns({"job_id": F.floor(F.col("stream") / 16).cast("long"), "slot": F.col("stream") % 16})


def hundredths(c) -> Column:
    """A value with two decimals, half up, as text."""
    n = F.floor(c * 100 + 0.5).cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def thousandths(c) -> Column:
    n = F.floor(c * 1000 + 0.5).cast("long")
    return F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-joined confidences, low shares and risks of a job's pages, two decimals each."""
    rows = job_pages(spark, sf_dir).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("slot", hundredths(F.col("conf")).alias("c"), hundredths(F.col("lowf")).alias("l"), hundredths(F.col("risk")).alias("k")))).alias("p"))
    return rows.select("job_id", *[F.array_join(F.col(f"p.{n}"), ",").alias(name) for n, name in (("c", "conf"), ("l", "low_conf"), ("k", "risk"))])


def feats_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10:wminp:emean:wment:regp:ntok of a job's pages, joined by semicolons."""
    one = F.concat_ws(":", *[thousandths(F.col(c)) for c in ("p10", "wminp", "emean", "wment", "regp")], F.col("ntok").cast("string"))
    rows = job_pages(spark, sf_dir).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("slot", one.alias("f")))).alias("p"))
    return rows.select("job_id", F.array_join(F.transform("p", lambda x: x["f"]), ";").alias("feats"))


TRACE = """trace AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, 50 / (50 + value) AS p1, ln(1 + value) AS ent, event_id % 97 = 0 AS eos, event_type = 'view' AS newline FROM events),
    ends AS (SELECT stream, min(step) AS last FROM trace WHERE eos GROUP BY stream),
    cut AS (SELECT t.* FROM trace t LEFT JOIN ends e USING (stream) WHERE e.last IS NULL OR t.step <= e.last),
    f AS (SELECT stream, step, p1, ent FROM cut UNION ALL SELECT DISTINCT stream, 0, 1.0::DOUBLE, 0.0::DOUBLE FROM cut),
    basic AS (SELECT stream, count(*) AS ntok, avg(p1) AS conf, avg((p1 < 0.5)::INT) AS lowf, avg(ent) AS emean, list_sort(list(p1))[floor(0.1::DOUBLE * (count(*) - 1))::INT + 1] AS p10 FROM f GROUP BY stream),
    slid AS (SELECT *, avg(p1) OVER w AS wp, avg(ent) OVER w AS we FROM f WINDOW w AS (PARTITION BY stream ORDER BY step ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)),
    win AS (SELECT stream, CASE WHEN count(*) <= 32 THEN avg(p1) ELSE min(wp) FILTER (step >= 31) END AS wminp, CASE WHEN count(*) <= 32 THEN avg(ent) ELSE max(we) FILTER (step >= 31) END AS wment FROM slid GROUP BY stream)"""
REGION = """fold AS (SELECT stream, step, CASE WHEN newline AND 1 >= 24 THEN 0 ELSE 1 END AS n, p1 AS s, NULL::DOUBLE AS best FROM cut WHERE step = 1
    UNION ALL SELECT c.stream, c.step, CASE WHEN c.newline AND f.n + 1 >= 24 THEN 0 ELSE f.n + 1 END, CASE WHEN c.newline AND f.n + 1 >= 24 THEN 0 ELSE f.s + c.p1 END,
    CASE WHEN c.newline AND f.n + 1 >= 24 THEN least(f.best, (f.s + c.p1) / (f.n + 1)) ELSE f.best END FROM fold f JOIN cut c ON c.stream = f.stream AND c.step = f.step + 1),
    reg AS (SELECT stream, arg_max(CASE WHEN n > 0 AND (n >= 24 OR best IS NULL) THEN least(best, s / greatest(n, 1)) ELSE best END, step) AS regp FROM fold GROUP BY stream)"""
PAGES = f"""{TRACE}, {REGION}, {DOCS}, {_degenerate('d', 'strlen(text)')}, pages AS (SELECT b.*, w.wminp, w.wment, coalesce(r.regp, b.conf) AS regp, coalesce(n.enough AND n.n_distinct / (n.n_words - 7) < 0.35, false) AS degenerate
    FROM basic b JOIN win w USING (stream) LEFT JOIN reg r USING (stream) LEFT JOIN n ON n.doc_id = b.stream), rated AS (SELECT *, greatest(1 - p10, CASE WHEN degenerate THEN 0.95 ELSE 0.0 END)::DOUBLE AS risk, p10 < 0.85 OR degenerate AS flagged FROM pages)"""


def _decimals(c: str, k: int) -> str:
    n = f"floor({c} * {10**k} + 0.5)::BIGINT"
    return f"(({n} // {10**k}) || '.' || lpad(({n} % {10**k})::VARCHAR, {k}, '0'))"


R = "round({0}, 6) + 0.0::DOUBLE AS {0}"
QUERIES = {f.__name__: f for f in (cut_at_eos, conf_basic, conf_p10, conf_windows, conf_regions, page_risk, flagged_pages, verdict_v1, page_headers, feats_header)}
SQL = {
    "cut_at_eos": f"WITH {TRACE} SELECT stream, step, {R.format('p1')} FROM cut",
    "conf_basic": f"WITH {TRACE} SELECT stream, ntok, {R.format('conf')}, {R.format('lowf')}, {R.format('emean')} FROM basic",
    "conf_p10": f"WITH {TRACE} SELECT stream, {R.format('p10')} FROM basic",
    "conf_windows": f"WITH {TRACE} SELECT stream, {R.format('wminp')}, {R.format('wment')} FROM win",
    "conf_regions": f"WITH RECURSIVE {TRACE}, {REGION} SELECT stream, {R.format('regp')} FROM reg",
    "page_risk": f"WITH RECURSIVE {PAGES} SELECT stream, {R.format('risk')} FROM rated",
    "flagged_pages": f"WITH RECURSIVE {PAGES} SELECT stream, {R.format('p10')}, degenerate FROM rated WHERE flagged",
    "verdict_v1": f"""WITH RECURSIVE {PAGES} SELECT stream, degenerate OR (conf > 0 AND (conf < 0.80 OR lowf > 0.20)) AS bad,
        CASE WHEN degenerate THEN 'loop' WHEN conf > 0 THEN 'conf ' || floor(conf * 100 + 0.5)::BIGINT || '%' ELSE '' END AS chip FROM rated""",
    "page_headers": f"""WITH RECURSIVE {PAGES} SELECT stream // 16 AS job_id, string_agg({_decimals('conf', 2)}, ',' ORDER BY stream) AS conf, string_agg({_decimals('lowf', 2)}, ',' ORDER BY stream) AS low_conf,
        string_agg({_decimals('risk', 2)}, ',' ORDER BY stream) AS risk FROM rated GROUP BY 1""",
    "feats_header": f"""WITH RECURSIVE {PAGES} SELECT stream // 16 AS job_id, string_agg({" || ':' || ".join(_decimals(c, 3) for c in ('p10', 'wminp', 'emean', 'wment', 'regp'))} || ':' || ntok, ';' ORDER BY stream) AS feats FROM rated GROUP BY 1""",
}
