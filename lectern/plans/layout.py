"""Layout and source queries, and their SQL. Page sizes follow from customers' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import layout as L
from lectern.functions.bpe import byte_characters, decode_ids
from lectern.functions.core import r6
from lectern.sources.files import engine_output, parse_manifest_line, scrape_log
from lectern.sources.tables import table, turns


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pw, ph) in points."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("page_id"), (F.col("c_custkey") * 37 % 1300 + 300).cast("double").alias("pw"), (F.col("c_custkey") * 91 % 1300 + 300).cast("double").alias("ph"))


def tiles(spark, sf_dir) -> DataFrame:
    return sizes(spark, sf_dir).withColumn("t", L.tile_choice(F.col("pw"), F.col("ph"))).select("page_id", F.col("t.w").cast("long").alias("w"), F.col("t.h").cast("long").alias("h"))


def tile_choice(spark, sf_dir):
    return tiles(spark, sf_dir)


def tile_tokens(spark, sf_dir):
    return tiles(spark, sf_dir).select("page_id", L.tile_tokens(F.col("w"), F.col("h")).alias("tokens"))


def letterbox_geom(spark, sf_dir):
    px = lambda c: F.rint(F.col(c) * L.DPI / L.POINTS)
    g = sizes(spark, sf_dir).select("page_id", L.letterbox(px("pw"), px("ph")).alias("g"))
    return g.select("page_id", "g.*")


def boxes(spark, sf_dir) -> DataFrame:
    i = F.col("page_id")
    s = sizes(spark, sf_dir).withColumns({"x0": i * 13 % 500, "y0": i * 29 % 500}).withColumns({"x1": F.col("x0") + i * 7 % 500, "y1": F.col("y0") + i * 11 % 500})
    pts = L.unproject(F.col("pw"), F.col("ph"), [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return s.select("page_id", "pw", "ph", *[p.alias(n) for p, n in zip(pts, ("x0", "y0", "x1", "y1"))])


def box_unproject(spark, sf_dir):
    return boxes(spark, sf_dir).select("page_id", *[r6(F.col(c), c) for c in ("x0", "y0", "x1", "y1")])


def crop_plan(spark, sf_dir):
    p = boxes(spark, sf_dir).select("page_id", L.crop_plan(F.col("pw"), F.col("ph"), [F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("p"))
    return p.where("p is not null").select("page_id", *[r6(F.col(f"p.{c}"), c) for c in ("x0", "y0", "x1", "y1", "zoom")])


def assemble_base(spark, sf_dir):
    t = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(L.BASE_TOKENS - 1))).alias("t"))
    return t.select("page_id", F.col("t").cast("long").alias("t"), L.base_token(F.col("t")).alias("b")).select("page_id", "t", "b.*")


def assemble_tiles(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), (F.col("n_nationkey") % 4 + 1).cast("long").alias("w"), (F.col("n_nationkey") % 3 + 1).cast("long").alias("h"))
    t = n.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), L.tile_tokens(F.col("w"), F.col("h")) - 1)))
    return t.select("page_id", "t", L.tile_token(F.col("t"), F.col("w"), F.col("h")).alias("b")).select("page_id", "t", "b.*")


def grid_partition(spark, sf_dir):
    """Cells of a grid by 14 x 14 window, and the zeros that fill each window up."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), (F.col("n_nationkey") + 40).alias("gs"))
    c = n.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("gs") * F.col("gs") - 1)))
    row, col = F.floor(F.col("cell") / F.col("gs")), F.col("cell") % F.col("gs")
    return c.groupBy("page_id", F.floor(row / L.WINDOW).cast("long").alias("wr"), F.floor(col / L.WINDOW).cast("long").alias("wc")).agg(F.count("*").alias("cells"), (L.WINDOW * L.WINDOW - F.count("*")).alias("zeros"))


def grid_merge(spark, sf_dir):
    """All cells of all windows, the padding's too, put back into the grid: cells by row, and the sum of their columns."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), (F.col("n_nationkey") + 40).alias("gs"))
    w = n.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.ceil(F.col("gs") / L.WINDOW), F.lit(2)).cast("long") - 1)))
    c = w.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(L.WINDOW * L.WINDOW - 1).cast("long")))).withColumn("at", L.grid_cell(F.col("window"), F.col("cell"), F.col("gs")))
    back = L.window_cell(F.col("at.row"), F.col("at.col"), F.col("gs"))
    same = c.where("at is not null").withColumn("same", (back["window"] == F.col("window")) & (back["cell"] == F.col("cell")))
    return same.groupBy("page_id", F.col("at.row").alias("row")).agg(F.count("*").alias("cells"), F.sum("at.col").alias("columns"), F.every("same").alias("inverse"))


def engine_outputs(spark, sf_dir):
    """Whole engine outputs made of orders' numbers, taken apart: pages, tokens and what follows; every sixth has none."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("TTFT (page 0): 1 ms\n"), F.when(k % 6 == 0, "failed").otherwise(F.concat(F.lit("===== OCR ("), k % 30, F.lit(" page(s), "), k * 7, F.lit(" tokens) =====\n<PAGE>a "), k.cast("string"), F.lit(" ===== b"))))
    o = table(spark, sf_dir, "orders").select("o_orderkey", engine_output(text).alias("o"))
    return o.select("o_orderkey", "o.pages", "o.tokens", "o.body")


def log_scrape(spark, sf_dir):
    """Bench figures from logs made of orders' numbers; every fifth log has no decode line."""
    k = F.col("o_orderkey")
    log = F.concat(F.lit("TTFT (page 0 first token): "), k % 900, F.lit(" ms\nprefill (batched): 3/3 pages in "), k % 700, F.lit(" ms\n"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("decode: "), k % 5000, F.lit(" tok in "), k % 3000, F.lit(" ms ("), k % 4000, F.lit(" tok/s), "), k % 300 + 1, F.lit(" steps, "), k % 100, F.lit("% batch util\n"))),
        F.lit("windowed: W=8 "), k % 40, F.lit(" admissions "), k % 90, F.lit(" ms\n===== OCR <|det|>text [0, 0, 1, 1]<|/det|>a"), F.repeat(F.lit("<|det|>"), (k % 4).cast("int")))
    return table(spark, sf_dir, "orders").select(k.alias("o_orderkey"), *scrape_log(log))


def manifest_scan(spark, sf_dir):
    """Tensor rows from manifest lines made of parts."""
    k = F.col("p_partkey")
    line = F.concat(F.lit("layer."), k, F.lit(".weight\t"), F.when(k % 2 == 0, "BF16").otherwise("F32"), F.lit("\t"), k % 7 + 1, F.lit(","), k % 5 + 1, F.lit("\t"), k * 4096, F.lit("\t"), (k % 7 + 1) * (k % 5 + 1) * 4)
    m = table(spark, sf_dir, "part").select(parse_manifest_line(line).alias("m"))
    return m.select("m.name", "m.dtype", F.array_join("m.shape", "x").alias("shape"), F.aggregate("m.shape", F.lit(1).cast("long"), lambda a, x: a * x).alias("elements"), "m.offset", "m.nbytes")


def bpe_decode(spark, sf_dir):
    """Turns as the ids of their bytes and an end token, decoded again through a byte-level vocabulary.

    A row is a page, whether or not another has its number.
    """
    pages = turns(spark, sf_dir).select((F.col("job_id") * 1000 + F.col("slot")).alias("page_id"), F.monotonically_increasing_id().alias("row"), "text")
    ids = pages.select("page_id", "row", F.posexplode(F.concat(F.transform(F.filter(F.split(F.hex(F.encode("text", "UTF-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int") + 2), F.array(F.lit(1)))).alias("pos", "tok"))
    vocabulary = spark.createDataFrame([(b + 2, c) for c, b in byte_characters().items()], "tok int, piece string")
    return decode_ids(ids, vocabulary, keys=("page_id", "row")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


SIZES = "s AS (SELECT c_custkey AS page_id, (c_custkey * 37 % 1300 + 300)::DOUBLE AS pw, (c_custkey * 91 % 1300 + 300)::DOUBLE AS ph FROM customer)"
TILES = f"""{SIZES}, o AS (SELECT i, j, i * j AS n FROM range(1, 33) a(i), range(1, 33) b(j) WHERE i * j BETWEEN 2 AND 32),
    d AS (SELECT page_id, pw * ph AS area, i, j, n, abs((pw::FLOAT / ph::FLOAT)::FLOAT - (i::DOUBLE / j)::FLOAT)::FLOAT AS d FROM s, o), b AS (SELECT *, min(d) OVER (PARTITION BY page_id) AS m FROM d),
    q AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n, i, j) AS k FROM b WHERE d = m), tl AS (SELECT page_id, arg_max(i, k) FILTER (k = 1 OR area > 0.5 * 640 * 640 * n) AS w, arg_max(j, k) FILTER (k = 1 OR area > 0.5 * 640 * 640 * n) AS h FROM q GROUP BY page_id)"""
BOXES = f"""{SIZES}, b0 AS (SELECT *, page_id * 13 % 500 AS x0, page_id * 29 % 500 AS y0, 1024.0::DOUBLE / greatest(pw, ph) AS sc FROM s), b1 AS (SELECT *, x0 + page_id * 7 % 500 AS x1, y0 + page_id * 11 % 500 AS y1 FROM b0),
    bx AS (SELECT page_id, pw, ph, """ + ", ".join(f"greatest(0.0::DOUBLE, least({s}, ({v} / 1000.0::DOUBLE * 1024 - (1024 - {s} * sc) / 2) / sc)) AS {v}" for v, s in (("x0", "pw"), ("y0", "ph"), ("x1", "pw"), ("y1", "ph"))) + " FROM b1)"
R = "round({0}, 6) + 0.0::DOUBLE AS {0}"
QUERIES = {f.__name__: f for f in (tile_choice, tile_tokens, letterbox_geom, box_unproject, crop_plan, assemble_base, assemble_tiles, grid_partition, grid_merge, engine_outputs, log_scrape, manifest_scan, bpe_decode)}
SQL = {
    "tile_choice": f"WITH {TILES} SELECT page_id, w, h FROM tl",
    "tile_tokens": f"WITH {TILES} SELECT page_id, h * 10 * (w * 10 + 1) + 273 AS tokens FROM tl",
    "letterbox_geom": f"""WITH {SIZES}, p AS (SELECT page_id, round_even(pw * 120 / 72, 0) AS w, round_even(ph * 120 / 72, 0) AS h FROM s), c AS (SELECT *, least(1024.0::DOUBLE / w, 1024.0::DOUBLE / h) AS sc FROM p),
        n AS (SELECT page_id, floor(w * sc + 0.5)::BIGINT AS w, floor(h * sc + 0.5)::BIGINT AS h FROM c) SELECT page_id, w, h, (1024 - w) // 2 AS x, (1024 - h) // 2 AS y FROM n""",
    "box_unproject": f"WITH {BOXES} SELECT page_id, {', '.join(R.format(c) for c in ('x0', 'y0', 'x1', 'y1'))} FROM bx",
    "crop_plan": f"""WITH {BOXES}, m AS (SELECT *, greatest(x1 - x0, y1 - y0) * 0.06::DOUBLE AS m FROM bx), g AS (SELECT page_id, greatest(0.0::DOUBLE, x0 - m) AS x0, greatest(0.0::DOUBLE, y0 - m) AS y0, least(pw, x1 + m) AS x1, least(ph, y1 + m) AS y1 FROM m),
        z AS (SELECT *, 1024.0::DOUBLE / greatest(x1 - x0, y1 - y0) AS zoom FROM g WHERE x1 - x0 > 4 AND y1 - y0 > 4) SELECT page_id, {', '.join(R.format(c) for c in ('x0', 'y0', 'x1', 'y1', 'zoom'))} FROM z""",
    "assemble_base": "SELECT r_regionkey::BIGINT AS page_id, t, CASE WHEN t = 272 THEN 'separator' WHEN t % 17 = 16 THEN 'newline' ELSE 'visual' END AS kind, CASE WHEN t <> 272 AND t % 17 <> 16 THEN t // 17 * 16 + t % 17 END AS src FROM region, range(0, 273) r(t)",
    "assemble_tiles": """WITH n AS (SELECT n_nationkey::BIGINT AS page_id, (n_nationkey % 4 + 1)::BIGINT AS w, (n_nationkey % 3 + 1)::BIGINT AS h FROM nation), x AS (SELECT *, unnest(range(0, h * 10 * (w * 10 + 1) + 273)) AS t FROM n),
        y AS (SELECT *, t // (w * 10 + 1) AS r, t % (w * 10 + 1) AS c, t < h * 10 * (w * 10 + 1) AS local FROM x) SELECT page_id, t, CASE WHEN NOT local THEN 'global' WHEN c = w * 10 THEN 'newline' ELSE 'visual' END AS kind,
        CASE WHEN local AND c < w * 10 THEN r // 10 * w + c // 10 END AS tile, CASE WHEN local AND c < w * 10 THEN r % 10 * 10 + c % 10 WHEN NOT local THEN t - h * 10 * (w * 10 + 1) END AS cell FROM y""",
    "grid_partition": """WITH n AS (SELECT n_nationkey::BIGINT AS page_id, n_nationkey + 40 AS gs FROM nation), c AS (SELECT page_id, gs, unnest(range(0, gs * gs)) AS cell FROM n)
        SELECT page_id, cell // gs // 14 AS wr, cell % gs // 14 AS wc, count(*) AS cells, 196 - count(*) AS zeros FROM c GROUP BY ALL""",
    "grid_merge": "WITH n AS (SELECT n_nationkey::BIGINT AS page_id, n_nationkey + 40 AS gs FROM nation), r AS (SELECT *, unnest(range(0, gs)) AS row FROM n) SELECT page_id, row, gs::BIGINT AS cells, (gs * (gs - 1) // 2)::BIGINT AS columns, true AS inverse FROM r",
    "engine_outputs": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 30 END AS pages, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey * 7 END AS tokens, CASE WHEN o_orderkey % 6 <> 0 THEN chr(10) || '<PAGE>a ' || o_orderkey || ' ===== b' END AS body FROM orders",
    "log_scrape": """SELECT o_orderkey, o_orderkey % 900 AS ttft_ms, o_orderkey % 700 AS prefill_ms, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5000 END AS tok, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3000 END AS decode_ms,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4000 END AS tok_s, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 300 + 1 END AS steps, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END AS util_pct,
        round(CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 3000)::DOUBLE / (o_orderkey % 300 + 1) END, 6) AS step_ms, o_orderkey % 40 AS admissions, o_orderkey % 4 + 1 AS det_els FROM orders""",
    "manifest_scan": "SELECT 'layer.' || p_partkey || '.weight' AS name, CASE WHEN p_partkey % 2 = 0 THEN 'BF16' ELSE 'F32' END AS dtype, (p_partkey % 7 + 1) || 'x' || (p_partkey % 5 + 1) AS shape, (p_partkey % 7 + 1) * (p_partkey % 5 + 1) AS elements, p_partkey * 4096 AS \"offset\", (p_partkey % 7 + 1) * (p_partkey % 5 + 1) * 4 AS nbytes FROM part",
    "bpe_decode": "SELECT conv_id * 1000 + turn AS page_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM conversations",
}
