"""Requests as they come in: the head's parts, the body's limits, and what is answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.core import let

# Largest head and body in bytes, the body's least seconds, and seconds after which to try again.
MAX_HEAD, MAX_BODY, LEAST_SECONDS, RETRY_AFTER = 16384, 268435456, 60, 5
#: Pages up to which confidences, and features, fit into headers.
MAX_CONF_PAGES, MAX_FEATURE_PAGES = 2048, 512


def parse_head(raw: Column) -> Column:
    """struct(method, target, headers) of a request's head; null if it has no end, is too long or has no such first line.

    headers: array<struct<name, value>> in order, names in lower case, values without white space around them.
    """
    end = F.instr(raw, "\r\n\r\n")
    lines = F.split(F.substring(raw, F.lit(1), F.greatest(end - 1, F.lit(0))), "\r\n")
    first = F.split(F.get(lines, F.lit(0)), " ")
    rest = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.instr(x, ":") > 1)
    headers = F.transform(rest, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    good = (end > 0) & (end + 3 <= MAX_HEAD) & (F.size(first) == 3) & F.startswith(F.get(first, F.lit(2)), F.lit("HTTP/1."))
    return F.when(good, F.struct(F.get(first, F.lit(0)).alias("method"), F.get(first, F.lit(1)).alias("target"), headers.alias("headers")))


def header_values(headers: Column, name: str) -> Column:
    """The values of a header in order, whatever the case of its name."""
    return F.transform(F.filter(headers, lambda h: h["name"] == name.lower()), lambda h: h["value"])


def spool_status(length: Column, arrived: Column, seconds: Column) -> Column:
    """The outcome of taking in a body: 413 if it is announced too long, 400 if it is short or late, else 200.

    A body may take a second for each mebibyte, at least LEAST_SECONDS.
    """
    allowed = F.greatest(F.lit(LEAST_SECONDS), F.floor(length / (1 << 20)))
    return F.when(length > MAX_BODY, 413).when((arrived < length) | (seconds > allowed), 400).otherwise(200)


def expand_status(n_pages: Column, pages: Column) -> Column:
    """struct(status, error) of a job whose document is open: n_pages is null if it cannot be read."""
    return let(
        F.get(F.filter(pages, lambda p: p >= n_pages), F.lit(0)),
        lambda missing: F.when(n_pages.isNull(), F.struct(F.lit(422).alias("status"), F.lit("cannot open document").alias("error")))
        .when(n_pages == 0, F.struct(F.lit(422).alias("status"), F.lit("empty document").alias("error")))
        .when(missing.isNotNull(), F.struct(F.lit(400).alias("status"), F.concat(F.lit("page "), (missing + 1).cast("string"), F.lit(" out of range (document has "), n_pages.cast("string"), F.lit(")")).alias("error")))
        .otherwise(F.struct(F.lit(200).alias("status"), F.lit("").alias("error"))),
    )


def job_log(mode: Column, pages: Column, tokens: Column, truncated: Column, conf: Column, status: Column, millis: Column) -> Column:
    """A finished job's line in the log. Its wording is a fixed value."""
    return F.format_string("[job] %s pages=%d tok=%d trunc=%d conf=%.2f status=%d %.0f ms", mode, pages, tokens, truncated, conf, status, millis)
