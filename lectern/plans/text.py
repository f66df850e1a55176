"""Text queries and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.core import r6
from lectern.functions.edit import pseudo_cer as cer
from lectern.functions.edit import word_edit as words_apart
from lectern.sources.tables import table, tagged_documents, turns


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_of(spark, sf_dir).select("doc_id", X.degenerate_stats(F.col("text"), F.octet_length("text")).alias("d"))
    return d.select("doc_id", F.col("d.words").cast("long").alias("n_words"), F.col("d.distinct").cast("long").alias("n_distinct"), F.col("d.bad").alias("degenerate"))


def degenerate_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tagged_documents(spark, sf_dir).select("doc_id", X.parse_blocks(F.col("tagged")).alias("b"))
    text = blocks.select("doc_id", F.array_join(F.transform("b", lambda b: b["text"]), " ").alias("text"))
    d = text.select("doc_id", X.degenerate_stats(F.col("text"), X.utf16_length(F.col("text"))).alias("d"))
    return d.select("doc_id", F.col("d.words").cast("long").alias("n_words"), F.col("d.distinct").cast("long").alias("n_distinct"), F.col("d.bad").alias("degenerate"))


def degen_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", r6(X.degen_score(F.col("text")), "score"))


def strip_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tagged_documents(spark, sf_dir).select("doc_id", X.strip_layout(F.concat(F.lit("<PAGE>"), F.col("tagged"))).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, blk, type, x0, y0, x1, y1, text) of the tagged documents, parsed back."""
    rows = tagged_documents(spark, sf_dir).select("doc_id", F.posexplode(X.parse_blocks(F.col("tagged"))).alias("blk", "b"))
    return rows.select("doc_id", F.col("blk").cast("long").alias("blk"), "b.*")


def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = [F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return block_rows(spark, sf_dir).select("doc_id", "blk", "type", *boxes, F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def odd_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged documents with pages that begin at titles, and with odd spaces in the tags of two documents in three."""
    t = F.replace("tagged", F.lit("<|det|>title"), F.lit("<PAGE><|det|>title"))
    kind = F.col("doc_id") % 3
    odd = F.when(kind == 0, F.replace(t, F.lit("["), F.lit("[ "))).when(kind == 1, F.replace(t, F.lit("<|det|>"), F.lit("<|det|> "))).otherwise(t)
    return tagged_documents(spark, sf_dir).select("doc_id", odd.alias("tagged"))


def page_blocks(spark: SparkSession, sf_dir: str, parse) -> DataFrame:
    pages = odd_tagged(spark, sf_dir).select("doc_id", F.posexplode(parse(F.col("tagged"))).alias("page", "b"))
    rows = pages.select("doc_id", F.col("page").cast("long").alias("page"), F.posexplode("b").alias("blk", "b"))
    return rows.withColumn("blk", F.col("blk").cast("long"))


def parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(spark, sf_dir, X.parse_strict).select("doc_id", "page", "blk", "b.type", F.col("b.x0").cast("long").alias("x0"), F.md5("b.text").alias("digest"))


def parse_viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(spark, sf_dir, X.parse_viewer).select("doc_id", "page", "blk", "b.type", F.col("b.x0").cast("long").alias("x0"), F.md5("b.text").alias("digest"))


def viewer_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(spark, sf_dir, X.parse_viewer).select("doc_id", "page", "blk", X.viewer_element(F.col("b")).alias("element"))


def garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", X.garbled(F.col("text")).alias("garbled"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks, and which are worth a second reading: garbled, or with glyphs lower than 13 pixels at 1024 a page."""
    b = block_rows(spark, sf_dir).withColumns({"w": (F.col("x1") - F.col("x0")) * 1.024, "h": (F.col("y1") - F.col("y0")) * 1.024})
    lines = F.greatest(F.lit(1.0), F.length("text") / F.greatest(F.lit(8.0), F.col("w") / 7.5))
    able = F.col("type").isin("text", "table", "title", "header", "footer") & (F.col("text") != "") & (F.col("h") >= 8) & (F.col("w") >= 8)
    b = b.withColumns({"glyph": F.col("h") / lines, "garbled": F.when(able, X.garbled(F.col("text"))).otherwise(False)})
    return b.withColumn("selected", able & (F.col("garbled") | (F.col("glyph") < 13)))


def recrop_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).where("selected").select("doc_id", "blk", "type", r6(F.col("glyph"), "glyph"), "garbled")


def reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reading of the selected blocks (every third empty, every third its first third, others a word longer).

    It is derived from the blocks, so it stands beside them and no join is needed; nulls where a block is not selected.
    """
    kind = (F.col("doc_id") + F.col("blk")) % 3
    again = F.when(kind == 0, "").when(kind == 1, F.substring("text", F.lit(1), (F.length("text") / 3).cast("int"))).otherwise(F.concat("text", F.lit(" again")))
    s = judged(spark, sf_dir).withColumn("text2", F.when(F.col("selected"), again))
    return s.withColumn("accepted", X.accepted(F.col("text"), F.col("text2"))).withColumn("rejected", (F.col("text2") != "") & ~F.col("accepted"))


def merge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reread(spark, sf_dir).where("selected").select("doc_id", "blk", "accepted", "rejected")


def crop_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks, with the second reading's text where it was accepted."""
    replaced = F.coalesce("accepted", F.lit(False))
    return reread(spark, sf_dir).select("doc_id", "blk", F.md5(F.when(replaced, F.col("text2")).otherwise(F.col("text"))).alias("digest"), replaced.alias("replaced"))


def merged_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tagged_documents(spark, sf_dir).select("doc_id", X.page_markdown(F.col("doc_id") + 1, X.parse_blocks(F.col("tagged"))).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = turns(spark, sf_dir).select("job_id", "slot", F.translate("text", "\f", " ").alias("text"))
    whole = pages.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("slot", "text"))).alias("p"))
    t = whole.select("job_id", F.size("p").cast("long").alias("pages"), F.array_join(F.transform("p", lambda p: p["text"]), "\f").alias("t"))
    return t.select("job_id", "pages", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before it in its conversation."""
    w = Window.partitionBy("job_id").orderBy("slot")
    return turns(spark, sf_dir).withColumn("before", F.lag("text").over(w)).where("before is not null")


def word_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("job_id", "slot", words_apart(F.col("before"), F.col("text")).alias("distance"))


def pseudo_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("job_id", "slot", r6(cer(F.col("before"), F.col("text")), "cer"))


def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, degenerate, score, garbled) of every document."""
    d = docs_of(spark, sf_dir)
    return d.select("doc_id", "source", X.degenerate_stats(F.col("text"), F.octet_length("text"))["bad"].alias("degenerate"), X.degen_score(F.col("text")).alias("score"), X.garbled(F.col("text")).alias("garbled"))


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged pages and mean scores of each source, beside its labelled pages."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    f = quality_features(spark, sf_dir).join(labels, "doc_id", "left")
    flag = F.col("degenerate") | F.col("garbled") | (F.col("score") > 0.35)
    return f.groupBy("source").agg(
        F.count("*").alias("pages"), F.sum(flag.cast("long")).alias("flagged"), r6(F.avg("score"), "mean_score"),
        F.count("quality").alias("labelled"), F.coalesce(F.sum((flag & (F.col("quality") == 0)).cast("long")), F.lit(0)).alias("bad_caught"),
    ).orderBy("source")


SP = r"[\x20\x09-\x0D]+"
WS = f"regexp_split_to_array({{0}}, '{SP}')"


def sql_words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{SP}'), lambda x: x <> '')"


def sql_shingles(w: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def sql_garbled(t: str) -> str:
    """A subquery that tells whether a text column is garbled."""
    return f"""(SELECT CASE WHEN length(g.t) < 40 THEN false ELSE
        (len(g.w) >= 8 AND len(list_distinct({sql_shingles('g.w', 2)})) / greatest(len(g.w) - 1, 1) < 0.45)
        OR coalesce(list_bool_or(list_transform(list_distinct(string_split(g.t, '')), lambda c: c <> chr(10) AND contains(g.t, repeat(c, 8)))), false) END
        FROM (SELECT {t} AS t, {sql_words(t)} AS w) g)"""


DOCS = "d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"
TAGGED = """tagged AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i:
    '<|det|>' || ['text','title','table','header','list'][(i - 1) % 5 + 1] || ' [' || ((doc_id * 7 + (i - 1) * 13) % 400) || ', ' || ((doc_id * 3 + (i - 1) * 29) % 800)
    || ', ' || ((doc_id * 7 + (i - 1) * 13) % 400 + 100 + ((i - 1) * 17) % 500) || ', ' || ((doc_id * 3 + (i - 1) * 29) % 800 + 6 + ((i - 1) * 11) % 150) || ']<|/det|>' || l), '') AS tagged FROM documents)"""
HEAD = r"^\s*([a-z_]+)\s*\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]<\|/det\|>"
BLOCKS = TAGGED + rf""", pieces AS (SELECT doc_id, unnest(string_split(tagged, '<|det|>')[2:]) AS p, generate_subscripts(string_split(tagged, '<|det|>')[2:], 1) - 1 AS blk FROM tagged),
    blocks AS (SELECT doc_id, blk, regexp_extract(p, '{HEAD}', 1) AS type, regexp_extract(p, '{HEAD}', 2)::BIGINT AS x0, regexp_extract(p, '{HEAD}', 3)::BIGINT AS y0,
    regexp_extract(p, '{HEAD}', 4)::BIGINT AS x1, regexp_extract(p, '{HEAD}', 5)::BIGINT AS y1, regexp_replace(regexp_replace(p, '{HEAD}', ''), '^\s+|\s+$', '', 'g') AS text FROM pieces)"""
SELECTED = BLOCKS + f""", sized AS (SELECT *, (x1 - x0) * 1.024::DOUBLE AS w, (y1 - y0) * 1.024::DOUBLE AS h FROM blocks),
    judged AS (SELECT *, h / greatest(1.0::DOUBLE, length(text) / greatest(8.0::DOUBLE, w / 7.5)) AS glyph, {sql_garbled('text')} AS garbled FROM sized
    WHERE type IN ('text','table','title','header','footer') AND text <> '' AND h >= 8 AND w >= 8), selected AS (SELECT * FROM judged WHERE garbled OR glyph < 13)"""
REREAD = SELECTED + f""", again AS (SELECT *, CASE (doc_id + blk) % 3 WHEN 0 THEN '' WHEN 1 THEN substring(text, 1, length(text) // 3) ELSE text || ' again' END AS text2 FROM selected),
    reread AS (SELECT *, text2 <> '' AND NOT {sql_garbled('text2')} AND length(text2) >= 0.5 * length(text) AS accepted FROM again)"""


ODD = TAGGED + r""", odd0 AS (SELECT doc_id, doc_id % 3 AS kind, replace(tagged, '<|det|>title', '<PAGE><|det|>title') AS t FROM tagged),
    odd AS (SELECT doc_id, kind, CASE kind WHEN 0 THEN replace(t, '[', '[ ') WHEN 1 THEN replace(t, '<|det|>', '<|det|> ') ELSE t END AS t FROM odd0)"""


def _page_blocks(pages: str, where: str) -> str:
    """Blocks by page, where a tag's form is the same all over a document."""
    head = r"^\s*([a-z_]+)\s*\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]<\|/det\|>"
    return rf"""{ODD}, pg AS (SELECT doc_id, {pages} AS pages FROM odd WHERE {where}), pl AS (SELECT doc_id, unnest(pages) AS p, generate_subscripts(pages, 1) - 1 AS page FROM pg),
    bl AS (SELECT doc_id, page, unnest(string_split(p, '<|det|>')[2:]) AS b, generate_subscripts(string_split(p, '<|det|>')[2:], 1) - 1 AS blk FROM pl),
    bk AS (SELECT doc_id, page, blk, regexp_extract(b, '{head}', 1) AS type, {', '.join(f"regexp_extract(b, '{head}', {k + 2})::BIGINT AS {n}" for k, n in enumerate(('x0', 'y0', 'x1', 'y1')))},
    regexp_replace(regexp_replace(b, '{head}', ''), '^\s+|\s+$', '', 'g') AS text FROM bl)"""


STRICT = _page_blocks("CASE WHEN contains(t, '<PAGE>') THEN string_split(t, '<PAGE>')[2:] ELSE [t] END", "kind = 2")
VIEWER = _page_blocks(r"list_filter(string_split(t, '<PAGE>'), lambda p: regexp_matches(p, '\S'))", "true")


def _degenerate(source: str, size: str) -> str:
    return f"""m AS (SELECT doc_id, {size} AS size, {sql_words("regexp_replace(text, '[0-9]+', '#', 'g')")} AS w FROM {source}),
    n AS (SELECT doc_id, size >= 3000 AND len(w) >= 200 AS enough, len(w)::BIGINT AS n_words, CASE WHEN size >= 3000 AND len(w) >= 200 THEN len(list_distinct({sql_shingles('w', 8)})) ELSE 0 END::BIGINT AS n_distinct FROM m)"""


DEGEN_SCORE = rf"""stripped AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(replace(text, '<PAGE>', ' '), '(?s)<\|det\|>.*?<\|/det\|>', ' ', 'g'), '{SP}', ' ', 'g')) AS t, text FROM d),
    sw AS (SELECT doc_id, t, {sql_words("regexp_replace(t, '\\p{Nd}+', '#', 'g')")} AS w FROM stripped),
    ds AS (SELECT doc_id, greatest(CASE WHEN len(w) >= 40 THEN 1 - len(list_distinct({sql_shingles('w', 8)})) / (len(w) - 7) ELSE 0.0 END::DOUBLE,
    least(1.0::DOUBLE, 10 * length(regexp_replace(t, '[\p{{L}}\p{{N}}\s.,;:!?()\[\]{{}}%&/+\-*''"|<>=_#@€$£~^\\]', '', 'g')) / greatest(length(t), 1))) AS score FROM sw)"""

# words of both texts as printable characters (there are fewer than 94 in a pair here), of one alone as chr(1) or chr(2)
EDIT = f"""t AS (SELECT conv_id AS job_id, turn AS slot, {sql_words("coalesce(text, '')")} AS wb FROM conversations), pr AS (SELECT *, lag(wb) OVER (PARTITION BY job_id ORDER BY slot) AS wa FROM t),
    cm AS (SELECT *, list_distinct(list_intersect(wa, wb)) AS c FROM pr WHERE wa IS NOT NULL), ed AS (SELECT job_id, slot, wa, wb, """ + "levenshtein({}, {})".format(*[f"array_to_string(list_transform({w}, lambda x: CASE WHEN list_contains(c, x) THEN chr((32 + list_position(c, x))::INT) ELSE chr({k}) END), '')" for k, w in ((1, "wa"), (2, "wb"))]) + " AS d FROM cm)"

QUERIES = {f.__name__: f for f in (page_quality, degenerate, degenerate_v1, degen_score, strip_layout, parse_blocks, parse_strict, parse_viewer, viewer_elements, garbled, recrop_select, merge_gate, crop_splice, merged_markdown, page_join, word_edit, pseudo_cer)}

SQL = {
    "degenerate": f"WITH {DOCS}, {_degenerate('d', 'strlen(text)')} SELECT doc_id, n_words, n_distinct, enough AND n_distinct / (n_words - 7) < 0.35 AS degenerate FROM n",
    "degenerate_v1": f"""WITH {BLOCKS}, d AS (SELECT t.doc_id, coalesce(string_agg(b.text, ' ' ORDER BY b.blk), '') AS text FROM tagged t LEFT JOIN blocks b USING (doc_id) GROUP BY t.doc_id),
        {_degenerate('d', r"length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g'))")} SELECT doc_id, n_words, n_distinct, enough AND n_distinct / (n_words - 7) < 0.35 AS degenerate FROM n""",
    "degen_score": f"WITH {DOCS}, {DEGEN_SCORE} SELECT doc_id, round(score, 6) + 0.0::DOUBLE AS score FROM ds",
    "strip_layout": rf"WITH {TAGGED}, s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace('<PAGE>' || tagged, '<PAGE>', ' '), '(?s)<\|det\|>.*?<\|/det\|>', ' ', 'g'), '{SP}', ' ', 'g')) AS t FROM tagged) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM s",
    "parse_blocks": f"WITH {BLOCKS} SELECT doc_id, blk, type, x0, y0, x1, y1, length(text) AS n_chars, md5(text) AS digest FROM blocks",
    "parse_strict": f"WITH {STRICT} SELECT doc_id, page, blk, type, x0, md5(text) AS digest FROM bk",
    "parse_viewer": f"WITH {VIEWER} SELECT doc_id, page, blk, type, x0, md5(text) AS digest FROM bk",
    "viewer_elements": f"""WITH {VIEWER}, pc AS (SELECT *, round(x0 / 10, 3) AS l, round(y0 / 10, 3) AS t, round((x1 - x0) / 10, 3) AS w, round((y1 - y0) / 10, 3) AS h FROM bk)
        SELECT doc_id, page, blk, '{{"type":"' || type || '","box":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || '],"l":' || l || ',"t":' || t || ',"w":' || w || ',"h":' || h || ',"text":' || to_json(text) || '}}' AS element FROM pc""",
    "garbled": f"WITH {DOCS} SELECT doc_id, {sql_garbled('text')} AS garbled FROM d",
    "recrop_select": f"WITH {SELECTED} SELECT doc_id, blk, type, round(glyph, 6) + 0.0::DOUBLE AS glyph, garbled FROM selected",
    "merge_gate": f"WITH {REREAD} SELECT doc_id, blk, accepted, text2 <> '' AND NOT accepted AS rejected FROM reread",
    "crop_splice": f"WITH {REREAD} SELECT b.doc_id, b.blk, md5(coalesce(r.text2, b.text)) AS digest, r.text2 IS NOT NULL AS replaced FROM blocks b LEFT JOIN (SELECT * FROM reread WHERE accepted) r USING (doc_id, blk)",
    "merged_markdown": f"""WITH {BLOCKS}, m AS (SELECT doc_id, '## page ' || (doc_id + 1) || chr(10) || string_agg('[' || type || '] ' || text, chr(10) ORDER BY blk) AS t FROM blocks GROUP BY doc_id)
        SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM m""",
    "page_join": """WITH p AS (SELECT conv_id AS job_id, count(*) AS pages, string_agg(replace(coalesce(text, ''), chr(12), ' '), chr(12) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
        SELECT job_id, pages, length(t) AS n_chars, md5(t) AS digest FROM p""",
    "word_edit": f"WITH {EDIT} SELECT job_id, slot, d AS distance FROM ed",
    "pseudo_cer": f"WITH {EDIT} SELECT job_id, slot, round(CASE WHEN len(wb) = 0 THEN CASE WHEN len(wa) = 0 THEN 0 ELSE 1 END ELSE least(1.0::DOUBLE, d / len(wb)) END, 6) + 0.0::DOUBLE AS cer FROM ed",
    "page_quality": f"""WITH {DOCS}, {_degenerate('d', 'strlen(text)')}, {DEGEN_SCORE}, f AS (SELECT d.doc_id, d.source, n.enough AND n.n_distinct / (n.n_words - 7) < 0.35 AS degenerate, ds.score, {sql_garbled('d.text')} AS garbled
        FROM d JOIN n USING (doc_id) JOIN ds USING (doc_id)), g AS (SELECT f.*, degenerate OR garbled OR score > 0.35 AS flag, quality FROM f LEFT JOIN labels USING (doc_id))
        SELECT source, count(*) AS pages, count_if(flag)::BIGINT AS flagged, round(avg(score), 6) + 0.0::DOUBLE AS mean_score, count(quality) AS labelled, coalesce(count_if(flag AND quality = 0), 0)::BIGINT AS bad_caught FROM g GROUP BY source ORDER BY source""",
}
