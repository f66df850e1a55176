"""Requests, jobs and pages: validation, page lists, routing, retries and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the request rules.
MAX_HEAD, MAX_BODY, MAX_QUEUE, MAX_LIST, MAX_SPEC = 16384, 268435456, 16, 512, 4096
VIEWER_PATHS = ("/", "/index.html", "/pdf.mjs", "/pdf.worker.mjs")
GLYPHS, GLYPH_LIMIT = 20, 120
END_TOKEN = 1


def request_status(method: Column, path: Column, head_bytes: Column, transfer_encoding: Column, lengths: Column, pages: Column, queued: Column) -> Column:
    """The status of a request: the first rule that applies decides, 200 if none does.

    ``lengths`` holds the Content-Length headers' values in order; ``pages`` the page specification, null if there is none.
    """
    length = F.get(lengths, F.lit(0))
    number = (F.size(lengths) == 1) & F.coalesce(length.rlike("^[0-9]{1,19}$"), F.lit(False))
    return (
        F.when(head_bytes > MAX_HEAD, 400)
        .when(path == "/healthz", F.when(method.isin("GET", "HEAD"), 200).otherwise(405))
        .when(path.isin(*VIEWER_PATHS) & method.isin("GET", "HEAD"), 200)
        .when(path != "/ocr", 404)
        .when(method != "POST", 405)
        .when(transfer_encoding, 501)
        .when((F.size(lengths) > 0) & ~number, 400)
        .when(F.size(lengths) == 0, 411)
        .when(length.try_cast("decimal(20,0)") > MAX_BODY, 413)
        .when(pages.isNotNull() & (page_spec(pages)["status"] != 200), 400)
        .when(queued >= MAX_QUEUE, 503)
        .otherwise(200)
    )


def page_spec(spec: Column) -> Column:
    """struct(status, first, list) of a page specification.

    ``N`` asks for the first N pages; a list with commas for exactly those, from 1, in order and with repeats, given
    here from 0. One trailing comma is allowed. Anything else is a bad request.
    """
    entries = F.split(F.regexp_replace(spec, ",$", ""), ",")
    good_list = F.contains(spec, F.lit(",")) & F.forall(entries, lambda e: e.rlike("^[0-9]{1,9}$") & (F.coalesce(e.try_cast("int"), F.lit(0)) >= 1)) & (F.size(entries) <= MAX_LIST)
    good = (F.length(spec) <= MAX_SPEC) & spec.rlike("^[0-9,]+$")
    first = F.when(good & ~F.contains(spec, F.lit(",")) & spec.rlike("^[0-9]{1,9}$") & (spec.try_cast("int") >= 1), spec.try_cast("int"))
    pages = F.when(good & good_list, F.transform(entries, lambda e: e.try_cast("int") - 1))
    return F.struct(F.when(first.isNotNull() | pages.isNotNull(), 200).otherwise(400).alias("status"), first.alias("first"), pages.alias("list"))


def url_param(url: Column, name: str) -> Column:
    """The first value of a query parameter, percent-decoded (as it stands if it cannot be); null if it is absent."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    hits = F.filter(F.split(query, "&"), lambda p: p.startswith(f"{name}="))
    value = F.substr(F.get(hits, F.lit(0)), F.lit(len(name) + 2))
    return F.coalesce(F.try_url_decode(value), value)


def mode_flags(hires: Column, auto: Column, feats: Column) -> Column:
    """struct(hires, auto, feats): on for ``1``; auto is on unless ``0``."""
    on = lambda c: F.coalesce(c == "1", F.lit(False))
    return F.struct(on(hires).alias("hires"), F.coalesce(auto != "0", F.lit(True)).alias("auto"), on(feats).alias("feats"))


def expand_pages(jobs: DataFrame) -> DataFrame:
    """(job_id, slot, pdfpage) for jobs (job_id, n_pages, first, list): the listed pages, or the first ones, or all.

    A list with a page that is not there makes no items; a job without pages makes none either.
    """
    limit = F.least("n_pages", F.coalesce("first", F.col("n_pages"))).cast("int")
    counted = F.when(limit > 0, F.sequence(F.lit(0), limit - 1)).otherwise(F.array().cast("array<int>"))
    pages = F.when(F.col("list").isNull(), counted).when(F.exists("list", lambda p: p >= F.col("n_pages")), F.array().cast("array<int>")).otherwise(F.col("list"))
    return jobs.select("job_id", F.posexplode(pages).alias("slot", "pdfpage"))


def retry_merge(passes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the latest pass for each key; applying it again changes nothing."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return passes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def glyph_p25(sizes: Column) -> Column:
    """The lower quartile of glyph sizes in tenths of a pixel, null for fewer than 20 glyphs."""
    return F.when(F.size(sizes) >= GLYPHS, F.floor(F.get(F.sort_array(sizes), F.floor(F.size(sizes) / 4).cast("int")) * 10).cast("long"))
