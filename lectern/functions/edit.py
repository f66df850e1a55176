"""Word-level edit distance, through the built-in distance of characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.core import let
from lectern.functions.text import strip_layout, words

#: Code points that stand for the words of both texts start here; those of one text alone are the two before.
FIRST = 0x10000


def word_edit(a: Column, b: Column) -> Column:
    """Edit distance in words; a null text has none.

    A word that both texts have becomes a character of its own. Words of one text alone never match, so that one
    character stands for all of them on either side; up to a million common words fit.
    """
    wa, wb = words(F.coalesce(a, F.lit(""))), words(F.coalesce(b, F.lit("")))

    def spelled(w: Column, common: Column, other: int) -> Column:
        place = lambda x: F.array_position(common, x)
        code = F.transform(w, lambda x: F.when(place(x) > 0, place(x) + FIRST).otherwise(other))
        return F.decode(F.unhex(F.array_join(F.transform(code, lambda n: F.lpad(F.hex(n), 8, "0")), "")), "UTF-32")

    def distance(s: Column) -> Column:
        return let(F.array_intersect(s["a"], s["b"]), lambda c: F.levenshtein(spelled(s["a"], c, 1), spelled(s["b"], c, 2)))

    return let(F.struct(wa.alias("a"), wb.alias("b")), distance).cast("long")


def pseudo_cer(base: Column, gold: Column) -> Column:
    """Share of the gold text's words that are wrong in the base text, at most 1; layout tags do not count."""
    a, b = strip_layout(base), strip_layout(gold)
    n = F.when(b == "", 0).otherwise(F.size(F.split(b, " ")))
    empty = F.when(a == "", 0.0).otherwise(1.0)
    return F.when(n == 0, empty).otherwise(F.least(F.lit(1.0), word_edit(a, b) / n))
