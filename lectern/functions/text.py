"""Text analytics as column expressions: words, shingles, degeneration, garble and layout tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.core import let

#: ASCII white space, written out: regular-expression dialects differ on what ``\s`` holds.
SPACE = r"[\x20\x09-\x0D]+"

# Thresholds of the degeneration and garble rules.
DEGENERATE_BYTES, DEGENERATE_WORDS, SHINGLE, DEGENERATE_RATIO = 3000, 200, 8, 0.35
REPEAT_WORDS = 40
GARBLED_CHARS, GARBLED_WORDS, GARBLED_RATIO, GARBLED_RUN = 40, 8, 0.45, 8

# Fixed value: characters besides letters, digits and white space that are not junk.
NOT_JUNK = r"""[\p{L}\p{N}\s.,;:!?()\[\]{}%&/+\-*'"|<>=_#@€$£~^\\]"""

# Fixed value: a layout tag: type and four coordinates.
TAG = r"\s*([a-z_]+)\s*\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]<\|/det\|>"
# The same tag with single spaces only, and with any spaces around the numbers.
STRICT_TAG = r"(\w+) \[(\d+), (\d+), (\d+), (\d+)\]<\|/det\|>"
LOOSE_TAG = r"\s*([a-z_]+)\s*\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]<\|/det\|>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def shingles(w: Column, n: int) -> Column:
    """64-bit hashes of all runs of n words of an array; empty if there are fewer. Evaluates ``w`` once."""

    def build(h: Column) -> Column:
        count = F.greatest(F.size(h) - (n - 1), F.lit(0))
        out = F.slice(h, 1, count)
        for k in range(1, n):
            out = F.zip_with(out, F.slice(h, k + 1, count), lambda a, b: F.xxhash64(a, b))
        return out

    return let(F.transform(w, lambda x: F.xxhash64(x)), build)


def distinct_counts(w: Column, n: int) -> Column:
    """struct(total, distinct) of an array's n-word shingles."""
    return let(shingles(w, n), lambda s: F.struct(F.size(s).alias("total"), F.size(F.array_distinct(s)).alias("distinct")))


def masked_words(text: Column, digit: str = "[0-9]+") -> Column:
    """Words with each run of digits as one ``#``."""
    return words(F.regexp_replace(text, digit, "#"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def degenerate_stats(text: Column, size: Column) -> Column:
    """struct(words, distinct, bad): whether a text of enough ``size`` and words mostly repeats its 8-word shingles."""

    def judge(w: Column) -> Column:
        enough = (size >= DEGENERATE_BYTES) & (F.size(w) >= DEGENERATE_WORDS)
        distinct = F.when(enough, distinct_counts(w, SHINGLE)["distinct"]).otherwise(0)
        return let(distinct, lambda d: F.struct(F.size(w).alias("words"), d.alias("distinct"), (enough & (d / (F.size(w) - SHINGLE + 1) < DEGENERATE_RATIO)).alias("bad")))

    return let(masked_words(text), judge)


def strip_layout(text: Column) -> Column:
    """Text without page marks and layout tags, white space evened out."""
    bare = F.regexp_replace(F.replace(text, F.lit("<PAGE>"), F.lit(" ")), r"(?s)<\|det\|>.*?<\|/det\|>", " ")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def degen_score(text: Column) -> Column:
    """Badness from 0 to 1: the share of repeated 8-word shingles or ten times the share of junk characters."""

    def score(t: Column) -> Column:
        w = masked_words(t, r"\p{Nd}+")
        counts = let(w, lambda x: F.struct(F.size(x).alias("n"), distinct_counts(x, SHINGLE).alias("c")))
        rep = let(counts, lambda c: F.when(c["n"] >= REPEAT_WORDS, 1 - c["c"]["distinct"] / c["c"]["total"]).otherwise(0.0))
        junk = F.length(F.regexp_replace(t, NOT_JUNK, "")) / F.greatest(F.length(t), F.lit(1))
        return F.greatest(rep, F.least(F.lit(1.0), junk * 10))

    return let(strip_layout(text), score)


def garbled(text: Column) -> Column:
    """Whether a block's text repeats itself: few distinct word pairs, or a long run of one character."""

    def judge(w: Column) -> Column:
        c = distinct_counts(w, 2)
        return (F.size(w) >= GARBLED_WORDS) & let(c, lambda x: x["distinct"] / F.greatest(x["total"], F.lit(1)) < GARBLED_RATIO)

    return F.when(F.length(text) < GARBLED_CHARS, False).otherwise(let(words(text), judge) | text.rlike(r"([^\n])\1{%d,}" % (GARBLED_RUN - 1)))


def _block(piece: Column, tag: str) -> Column:
    """A block from a text that starts with the inside of a tag."""
    body = F.regexp_replace(F.regexp_replace(piece, "^" + tag, ""), r"^\s+|\s+$", "")
    parts = [F.regexp_extract(piece, "^" + tag, k + 1) for k in range(5)]
    return F.struct(parts[0].alias("type"), *[p.cast("int").alias(n) for p, n in zip(parts[1:], ("x0", "y0", "x1", "y1"))], body.alias("text"))


def parse_blocks(text: Column, tag: str = TAG) -> Column:
    """array<struct<type, x0, y0, x1, y1, text>> of a tagged text; what stands before the first tag is left out.

    A block ends at the next tag of this form; others are part of its text.
    """
    pieces = F.split(text, r"<\|det\|>(?=" + tag + ")", -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: _block(p, tag))


def parse_strict(text: Column) -> Column:
    """The blocks of each page (an array of arrays) in an engine's output: single spaces only, pages begin with <PAGE>."""
    cut = F.split(text, "<PAGE>", -1)
    pages = F.when(F.size(cut) > 1, F.slice(cut, 2, F.size(cut) - 1)).otherwise(cut)
    return F.transform(pages, lambda p: parse_blocks(p, STRICT_TAG))


def parse_viewer(text: Column) -> Column:
    """The blocks of each page that is not blank: any spaces in a tag; a block ends at the next <|det|>, whatever follows it."""
    pages = F.filter(F.split(text, "<PAGE>", -1), lambda p: p.rlike(r"\S"))

    def blocks(p: Column) -> Column:
        pieces = F.split(p, r"<\|det\|>", -1)
        good = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: x.rlike("^" + LOOSE_TAG))
        return F.transform(good, lambda x: _block(x, LOOSE_TAG))

    return F.transform(pages, blocks)


def viewer_element(block: Column) -> Column:
    """A block as a viewer's JSON record: its box, and left, top, width and height in percent of the page."""
    percent = lambda a, b: F.round((a - b) / 1000 * 100, 3)
    box = F.array(*[block[k] for k in ("x0", "y0", "x1", "y1")])
    return F.to_json(F.struct(
        block["type"].alias("type"), box.alias("box"), percent(block["x0"], F.lit(0)).alias("l"), percent(block["y0"], F.lit(0)).alias("t"),
        percent(block["x1"], block["x0"]).alias("w"), percent(block["y1"], block["y0"]).alias("h"), block["text"].alias("text"),
    ))


def accepted(text: Column, again: Column) -> Column:
    """Whether a second reading may replace the first: not empty, not garbled and at least half as long; null without one."""
    return F.when(again.isNotNull(), (again != "") & ~garbled(again) & (F.length(again) >= 0.5 * F.length(text)))


def page_markdown(number: Column, blocks: Column) -> Column:
    """A page as ``## page n`` and a line ``[type] text`` for each block."""
    lines = F.transform(blocks, lambda b: F.concat(F.lit("["), b["type"], F.lit("] "), b["text"]))
    return F.array_join(F.concat(F.array(F.concat(F.lit("## page "), number.cast("string"))), lines), "\n")
