"""Queries of image kernels, routing by experts, responses and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import pixels as P
from lectern.functions.core import r6, total
from lectern.plans.layout import boxes
from lectern.plans.tensor import E_, LONG, vectors
from lectern.sources.tables import table, turns


def weighted(v):
    """A vector result in two numbers: its sum, and its sum weighted by place."""
    return [r6(total(v), "s1"), r6(total(F.transform(v, lambda x, i: x * (i + 1))), "s2")]


def conv3x3(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", P.sharpened("x").alias("y")).select("vec_id", *weighted(F.col("y")))


def im2col_patches(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", P.patch_sums("x").alias("y")).select("vec_id", *weighted(F.col("y")))


def resize_bilinear(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", P.resized("x").alias("y")).select("vec_id", *weighted(F.col("y")))


def resize_bicubic(spark, sf_dir):
    """Square tables of positions at 5/8 of their side, by cubic weights."""
    return vectors(spark, sf_dir).select("vec_id", P.shrunk("x").alias("y")).select("vec_id", *weighted(F.col("y")))


def relpos_table(spark, sf_dir):
    """A table of 15 relative positions spread over the pairs of eight places: entry (q, k) is that of q - k."""
    place = F.sequence(F.lit(0), F.lit(7))
    y = F.flatten(F.transform(place, lambda q: F.transform(place, lambda k: F.get("x", q - k + 7))))
    return vectors(spark, sf_dir).select("vec_id", y.alias("y")).select("vec_id", *weighted(F.col("y")))


def split_heads(spark, sf_dir):
    """Each vector as four parts (query, key, value, and the gate) of two heads of eight values: the parts' sums."""
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.lit(h).cast("long").alias("head"), F.slice("x", k * 16 + h * 8 + 1, 8).alias("v")) for k, n in enumerate("qkvg") for h in (0, 1)])
    return vectors(spark, sf_dir).select("vec_id", F.inline(parts)).select("vec_id", "part", "head", r6(total(F.col("v")), "s"))


def tile_split(spark, sf_dir):
    """An 8 x 8 image in four tiles, rows first: each tile's first and last value."""
    v = vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v"))
    row, col = F.floor(F.col("i") / 8), F.col("i") % 8
    t = v.withColumns({"tile": (F.floor(row / 4) * 2 + F.floor(col / 4)).cast("long"), "cell": ((row % 4) * 4 + col % 4).cast("long")})
    return t.groupBy("vec_id", "tile").agg(r6(F.max(F.when(F.col("cell") == 0, F.col("v"))), "first"), r6(F.max(F.when(F.col("cell") == 15, F.col("v"))), "last"))


def box_percent(spark, sf_dir):
    """Boxes as percent of the page: left, top, width, height."""
    b = boxes(spark, sf_dir)
    return b.select("page_id", r6(100 * F.col("x0") / F.col("pw"), "left_pct"), r6(100 * F.col("y0") / F.col("ph"), "top_pct"), r6(100 * (F.col("x1") - F.col("x0")) / F.col("pw"), "width_pct"), r6(100 * (F.col("y1") - F.col("y0")) / F.col("ph"), "height_pct"))


def expert_combine(spark, sf_dir):
    """Line items' rows go to their expert, come back scaled by its weight, and are added up in the order of their slots."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 64).alias("expert"), F.col("l_quantity").alias("x"))
    weights = li.groupBy("expert").agg((1 / F.count("*")).alias("w"))
    done = li.join(weights, "expert").select("l_orderkey", "l_linenumber", (F.col("x") * F.col("w")).alias("y"))
    rows = done.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "y"))).alias("l"))
    return rows.select("l_orderkey", r6(F.aggregate("l", F.lit(0.0), lambda a, s: a + s["y"]), "y"))


def weight_lookup(spark, sf_dir):
    """Nations by name in a table of tensors; those that are not there are left out."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("shape"))
    asked = table(spark, sf_dir, "region").select(F.col("r_name").alias("asked"), F.col("r_regionkey").cast("long").alias("shape"))
    return asked.join(names, "shape").groupBy("asked").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def fifo_take(spark, sf_dir):
    """The order in which each minute's requests are taken: by arrival, then by number."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "ts", F.date_trunc("minute", "ts").alias("m"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("m").orderBy("ts", "event_id")).cast("long")).select("event_id", "place")


def error_response(spark, sf_dir):
    """Status lines of the requests' outcomes."""
    from lectern.plans.jobs import request_status

    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return request_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).select("status", F.concat(F.lit("HTTP/1.1 "), F.col("status"), F.lit(" "), F.element_at(reasons, F.col("status").cast("int"))).alias("line"), "n")


def mode_headers(spark, sf_dir):
    """The modes of a job's pages, b or g, comma-joined."""
    rows = turns(spark, sf_dir).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("slot", F.when(F.col("role") == "assistant", "g").otherwise("b").alias("m")))).alias("p"))
    return rows.select("job_id", F.array_join("p.m", ",").alias("modes"))


# The reasons of statuses.
REASONS = {200: "OK", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 411: "Length Required", 413: "Payload Too Large", 422: "Unprocessable Content", 500: "Internal Server Error", 501: "Not Implemented", 503: "Service Unavailable"}
W2 = "round(sum(y), 6) + 0.0::DOUBLE AS s1, round(sum(y * (k + 1)), 6) + 0.0::DOUBLE AS s2"
GRID = f"{LONG}, c AS (SELECT vec_id, i // 8 AS r, i % 8 AS q, v FROM l)"
AXIS = "a AS (SELECT m, floor(s)::BIGINT AS lo, least(floor(s)::BIGINT + 1, 7) AS hi, s - floor(s) AS f FROM (SELECT m, greatest(0.0::DOUBLE, least(7.0::DOUBLE, (m + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE)) AS s FROM range(0, 12) t(m)))"
QUERIES = {f.__name__: f for f in (conv3x3, im2col_patches, resize_bilinear, resize_bicubic, relpos_table, split_heads, tile_split, box_percent, expert_combine, weight_lookup, fifo_take, error_response, mode_headers)}


def _sql() -> dict[str, str]:
    from lectern.plans.jobs import SQL as JOBS
    from lectern.plans.layout import BOXES

    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in REASONS.items())
    return {
        "conv3x3": f"WITH {E_}, {GRID}, y AS (SELECT a.vec_id, a.r * 8 + a.q AS k, sum(b.v * CASE WHEN a.r = b.r AND a.q = b.q THEN 5 ELSE -1 END) AS y FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.r - b.r) + abs(a.q - b.q) <= 1 GROUP BY ALL) SELECT vec_id, {W2} FROM y GROUP BY vec_id",
        "im2col_patches": f"WITH {E_}, {GRID}, y AS (SELECT vec_id, r // 2 * 4 + q // 2 AS k, sum(v) AS y FROM c GROUP BY ALL) SELECT vec_id, {W2} FROM y GROUP BY vec_id",
        "resize_bilinear": f"""WITH {E_}, {AXIS}, y AS (SELECT vec_id, r.m * 12 + q.m AS k, (x[r.lo * 8 + q.lo + 1] * (1 - q.f) + x[r.lo * 8 + q.hi + 1] * q.f) * (1 - r.f) + (x[r.hi * 8 + q.lo + 1] * (1 - q.f) + x[r.hi * 8 + q.hi + 1] * q.f) * r.f AS y
            FROM e, a r, a q) SELECT vec_id, {W2} FROM y GROUP BY vec_id""",
        "resize_bicubic": f"""WITH {E_}, w0 AS (SELECT m, j, abs(j - ((m + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE)) / 1.6::DOUBLE AS t FROM range(0, 5) a(m), range(0, 8) b(j)),
            w1 AS (SELECT m, j, CASE WHEN t < 1 THEN 1.5 * t ** 3 - 2.5 * t ** 2 + 1 WHEN t < 2 THEN -0.5 * t ** 3 + 2.5 * t ** 2 - 4 * t + 2 ELSE 0 END::DOUBLE AS w FROM w0), w AS (SELECT m, j, w / sum(w) OVER (PARTITION BY m) AS w FROM w1),
            y AS (SELECT vec_id, r.m * 5 + q.m AS k, sum(x[r.j * 8 + q.j + 1] * r.w * q.w) AS y FROM e, w r, w q GROUP BY ALL) SELECT vec_id, {W2} FROM y GROUP BY vec_id""",
        "relpos_table": f"WITH {E_}, y AS (SELECT vec_id, q * 8 + k0 AS k, x[q - k0 + 8] AS y FROM e, range(0, 8) a(q), range(0, 8) b(k0)) SELECT vec_id, {W2} FROM y GROUP BY vec_id",
        "split_heads": f"WITH {E_}, p AS (SELECT vec_id, x, unnest(range(0, 8)) AS k FROM e) SELECT vec_id, ['q','k','v','g'][k // 2 + 1] AS part, k % 2 AS head, round(list_sum(x[k * 8 + 1:k * 8 + 8]), 6) + 0.0::DOUBLE AS s FROM p",
        "tile_split": f"WITH {E_}, p AS (SELECT vec_id, x, unnest(range(0, 4)) AS tile FROM e) SELECT vec_id, tile, round(x[tile // 2 * 32 + tile % 2 * 4 + 1], 6) + 0.0::DOUBLE AS first, round(x[tile // 2 * 32 + tile % 2 * 4 + 28], 6) + 0.0::DOUBLE AS last FROM p",
        "box_percent": f"WITH {BOXES} SELECT page_id, round(100 * x0 / pw, 6) + 0.0::DOUBLE AS left_pct, round(100 * y0 / ph, 6) + 0.0::DOUBLE AS top_pct, round(100 * (x1 - x0) / pw, 6) + 0.0::DOUBLE AS width_pct, round(100 * (y1 - y0) / ph, 6) + 0.0::DOUBLE AS height_pct FROM bx",
        "expert_combine": "WITH w AS (SELECT l_partkey % 64 AS expert, 1 / count(*) AS w FROM lineitem GROUP BY 1) SELECT l_orderkey, round(sum(l_quantity * w), 6) + 0.0::DOUBLE AS y FROM lineitem JOIN w ON l_partkey % 64 = expert GROUP BY l_orderkey",
        "weight_lookup": "SELECT r_name AS asked, count(*) AS n, min(n_name) AS first_name FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
        "fifo_take": "SELECT event_id, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) AS place FROM events",
        "error_response": f"WITH q AS ({JOBS['request_status']}) SELECT status, 'HTTP/1.1 ' || status || ' ' || CASE status {cases} END AS line, count(*) AS n FROM q GROUP BY status",
        "mode_headers": "SELECT conv_id AS job_id, string_agg(CASE WHEN role = 'assistant' THEN 'g' ELSE 'b' END, ',' ORDER BY turn) AS modes FROM conversations GROUP BY conv_id",
    }


SQL = _sql()
