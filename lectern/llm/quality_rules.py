"""Quality rules in DataFrame functions: text statistics, base rules, and robust multivariate outliers.

Outliers are judged by the minimum-covariance-determinant estimate of their language and source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.core import unused
from lectern.llm.common import settle

SPACE = r"[\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics, and for each the smallest deviation that counts as one standard deviation: most texts
#: have no symbols or repeated lines at all, and without a floor their estimate would be singular.
FEATURES = {"length": 0.5, "word_length": 0.5, "symbols": 0.15, "dup_lines": 0.3, "repeats": 0.1}
#: Rows that a group's estimate takes over from that of its language, and a language's from that of all rows.
PRIOR_ROWS = 20.0
#: Share of a group that the estimate covers. Half of it, so that up to nearly half of a group can be junk, copies of one
#: text included, without drawing the estimate to itself.
COVER = 0.5
#: Concentration steps at most; they end when no group's log determinant falls by more than CLOSE.
STEPS, CLOSE = 8, 0.02
#: Medians are read off bins of this many to a unit of a feature, distances off bins of this many to a doubling.
UNIT_BINS, OCTAVE_BINS = 64, 64
#: Chance that a normal row of a group is rejected. The features have longer tails than normal ones, so that it must be
#: far smaller than the share of texts that may be lost; the README has figures.
TAIL = 1e-11


def tail_5(x: float) -> float:
    """Chance that chi-squared with five degrees of freedom exceeds x."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)


def _solve(f, target: float, low: float = 0.0, high: float = 1000.0) -> float:
    """Where a falling function has a value."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > target else (low, mid)
    return high


#: Largest squared distance that is kept: about 60.
CUTOFF = _solve(tail_5, TAIL)
_HALF = _solve(tail_5, 1 - COVER)
#: Makes the covariance of the inner COVER of a normal group that of the whole: COVER over the share of chi-squared with
#: seven degrees of freedom below the quantile of that with five.
CONSISTENCY = COVER / (1 - tail_5(_HALF) - math.sqrt(2 / math.pi) * _HALF**2.5 * math.exp(-_HALF / 2) / 15)


def text_stats(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, kept columns, STATS) for every row; a null text has no words.

    n_repeat_words counts the words in three-word windows found twice or more; windows are compared by 64-bit hashes.
    Only texts in which some window repeats are sorted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(c) for c in keep], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = rows.select("id", *keep, "text", F.transform(F.filter(F.split("text", SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    grams = F.zip_with(pairs, F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    basic = words.select(
        "id", *keep, F.size("w").cast("long").alias("n_words"), grams.alias("g"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(F.contains("text", F.lit("\n")), F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]).otherwise(0).cast("long").alias("n_dup_lines"),
    )
    repeats = F.when(F.size("g") == F.size(F.array_distinct("g")), F.lit(0)).otherwise(_covered(F.col("g")))
    return basic.select("id", *keep, *STATS[:4], repeats.cast("long").alias("n_repeat_words"))


def _covered(grams: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more, given the hashes in order of place."""
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        n = F.size(s)
        same = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: a["h"] == b["h"])
        edge = F.array(F.lit(False))
        twice = F.zip_with(F.concat(edge, same), F.concat(same, edge), lambda a, b: a | b)
        return F.sort_array(F.transform(F.filter(F.arrays_zip(s.alias("s"), twice.alias("t")), lambda x: x["t"]), lambda x: x["s"]["i"]))

    at = F.transform(F.array(placed), places)[0]
    begin = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(at, begin, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])


def transformed() -> list[Column]:
    """The statistics on scales on which ordinary texts are roughly normal, in units of their floors."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = (F.log1p("n_words"), F.col("word_chars") / n, F.sqrt(F.col("n_symbols") / n), F.log1p("n_dup_lines"), F.sqrt(F.col("n_repeat_words") / n))
    return [(v / floor).alias(f"x{i}") for i, (v, floor) in enumerate(zip(values, FEATURES.values()))]


D = len(FEATURES)
TRIANGLE = [(i, j) for i in range(D) for j in range(i + 1)]


V = [f"v{i}{j}" for i, j in TRIANGLE]
C = [f"c{i}" for i in range(D)]
L = [f"l{i}{j}" for i, j in TRIANGLE]


def _estimate(rows: DataFrame, keys: list[str], prior: DataFrame | None, factor: float) -> DataFrame:
    """(keys, c, v, l, logdet): the rows' centre and covariance, with PRIOR_ROWS of the prior's, and what distances need.

    l is the Cholesky factor of ``factor`` times the covariance plus the floors' unit variance; logdet is its log
    determinant, the one that is minimised (the regularised form of the estimate, its target the identity).
    """
    sums = [F.count("*").alias("m"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in TRIANGLE]]
    est = rows.groupBy(*keys).agg(*sums)
    if prior is not None:
        own = [k for k in keys if k in prior.columns]
        est = est.join(prior.select(*own, *[F.col(c).alias(f"p{c}") for c in (*C, *V)]), own)
        k = F.lit(PRIOR_ROWS)
        est = est.select(*keys, (F.col("m") + k).alias("m"), *[(F.col(f"s{i}") + k * F.col(f"pc{i}")).alias(f"s{i}") for i in range(D)], *[(F.col(f"q{i}{j}") + k * (F.col(f"pv{i}{j}") + F.col(f"pc{i}") * F.col(f"pc{j}"))).alias(f"q{i}{j}") for i, j in TRIANGLE])
    est = est.select(*keys, "m", *[(F.col(f"s{i}") / F.col("m")).alias(f"c{i}") for i in range(D)], *[F.col(f"q{i}{j}") for i, j in TRIANGLE])
    est = est.select(*keys, *C, *[(F.col(f"q{i}{j}") / F.col("m") - F.col(f"c{i}") * F.col(f"c{j}")).alias(f"v{i}{j}") for i, j in TRIANGLE])
    for i, j in TRIANGLE:
        rest = factor * F.col(f"v{i}{j}") + (1.0 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    return est.withColumn("logdet", sum((F.ln(F.col(f"l{i}{i}")) * 2 for i in range(D)), F.lit(0.0)))


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution with the centre and factor that each row carries."""
    names = [f"z{i}" for i in range(D)]
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"c{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(z) * F.col(z) for z in names), F.lit(0.0))).drop(*names, *C, *V, *L, "logdet")


def _bins(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, bin): the first bin up to which a share of a group's rows lies, from (keys, bin) rows.

    Rows are counted by bin in every task first, so that no group meets in one; a group has a few hundred bins.
    """
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.select(*keys, "bin", F.sum("n").over(so_far).alias("so_far"), F.sum("n").over(Window.partitionBy(*keys)).alias("of"))
    return reached.where(F.col("so_far") >= share * F.col("of")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def mcd(rows: DataFrame, keys: list[str], prior: DataFrame | None, name: str) -> DataFrame:
    """Minimum-covariance-determinant estimates (keys, c, v, l) of x0.. for each group of ``keys``.

    Concentration steps from two deterministic starts (all rows, and the coordinatewise medians): each takes the COVER
    share of a group's rows with the smallest distance under the last estimate, to the end of its bin, and estimates
    anew, with the prior's rows; a step of both starts is one pass. They go on until they have converged (STEPS), and the start
    with the smaller determinant wins. Only counts by bin and partial sums are shuffled.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") * UNIT_BINS).alias("bin")) for i in range(D)]))
    middle = _bins(rows.select(*keys, each.alias("e")).select(*keys, "e.i", "e.bin"), [*keys, "i"], 0.5).groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, (F.col("bin") + 0.5) / UNIT_BINS)).alias(f"c{i}") for i in range(D)])
    unit = [F.lit(1.0 if i == j else 0.0) for i, j in TRIANGLE]
    at_median = middle.select(*keys, *C, *[F.lit(0.0).alias(v) for v in V], *[u.alias(l) for u, l in zip(unit, L)], F.lit(0.0).alias("logdet"))
    params = settle(_estimate(rows, keys, prior, 1.0).withColumn("start", F.lit("all")).unionByName(at_median.withColumn("start", F.lit("median"))), f"{name}-starts")
    by, last = [*keys, "start"], None
    for k in range(STEPS):
        near = with_distance(rows.join(params, keys))
        # distances below 1 / 256 share the lowest bins
        near = near.withColumn("bin", F.floor(F.log2(F.greatest("d2", F.lit(1 / 256))) * OCTAVE_BINS))
        cut = settle(_bins(near.select(*by, "bin"), by, COVER).withColumnRenamed("bin", "cut"), f"{name}-{k}-cut")
        inside = near.join(cut, by).where("bin <= cut").drop("bin", "cut", "d2")
        params = settle(_estimate(inside, by, prior, CONSISTENCY), f"{name}-{k}")
        now = params.select(*by, F.col("logdet").alias("now"))
        if last is not None:
            fall = last.join(now, by).agg(F.max(F.abs(F.col("was") - F.col("now")))).first()[0]
            if fall is None or fall <= CLOSE:
                break
        last = now.withColumnRenamed("now", "was")
    best = params.groupBy(*keys).agg(F.min(F.struct("logdet", "start", *C, *V, *L)).alias("b"))
    return settle(best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in (*C, *V, *L)], F.col("b.logdet").alias("logdet")), f"{name}-best")


def judge(stats: DataFrame, keys: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """Adds base_failed, d2 and kept to the statistics.

    A text fails the base rules with fewer than 50 words, or if over half its words stand in repeated windows; others are
    rejected if their squared distance from their group's estimate exceeds ``cutoff``. Null keys form groups of their
    own. Estimates are made from the texts that pass the base rules. Every group has one, however small: it leans on
    its language's by PRIOR_ROWS rows, and that on the one of all rows. d2 is null where no text of a group passes.
    """
    lang, source = keys
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    null = "\x00"
    one, by_lang, by_source = levels = unused(stats, "all_rows", "lang_key", "source_key")
    keyed = stats.withColumns({"base_failed": failed, one: F.lit(1), by_lang: F.coalesce(F.col(lang).cast("string"), F.lit(null)), by_source: F.coalesce(F.col(source).cast("string"), F.lit(null))})
    keyed = settle(keyed.select("*", *transformed()), "stats")
    good = keyed.where(~F.col("base_failed")).select(*levels, *[f"x{i}" for i in range(D)])
    params = None
    for k in range(3):
        params = mcd(good, levels[: k + 1], params, f"mcd{k}")
    far = with_distance(keyed.join(params, levels, "left"))
    return far.select(*stats.columns, "base_failed", "d2", (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).alias("kept"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """One row (id, lang, source, STATS, base_failed, d2, kept) for every row of ``docs``; ``keys`` name its two key columns.

    Null texts have no words and fail; repeated rows are counted and judged as often as they occur; an empty table
    gives an empty result; other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(keys[0]).alias("lang"), F.col(keys[1]).alias("source"))
    return judge(settle(text_stats(named, "id", "text", "lang", "source"), "textstats"), ("lang", "source"), cutoff)
