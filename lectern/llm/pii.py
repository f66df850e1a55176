"""Personal data by weak supervision, in DataFrame functions only.

Regex, gazetteer, context and shape labelers vote on candidate spans; expectation-maximisation over the counted vote
patterns estimates their reliabilities; a logistic span classifier is trained on the resulting posteriors.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")

# The base patterns. Java's possessive groups match what the plain ones do here, as nothing follows them,
# but without recursion; a run's inner characters cannot start a match if its first one did not, so only \G (the end of
# the match before) or the start of a run is tried, which keeps very long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}

#: What may stand for a dot, and cues after which a shape alone is a candidate.
DOT = r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\)|\.)\x20?"
CARD_CUE, PHONE_CUE = "card|visa|mastercard|amex|karte|carte|tarjeta", "phone|tel|fax|mobile|call|telefon|teléfono"
#: Shapes near the base ones, as further candidates: written-out addresses; written-out and spaced dots, and addresses of
#: eight groups; other separators, thirteen digits, and any check digit behind a cue; national forms, a double zero for the
#: plus, and any number behind a cue.
NEAR = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?[a-z0-9-]{{1,63}}+(?:{DOT}[a-z0-9-]{{1,63}}+){{1,8}}"
    r"|(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20at\x20[a-z0-9-]{1,63}+(?:\x20dot\x20[a-z0-9-]{1,63}+){1,4}",
    "ip": rf"(?i)(?<![0-9.])[0-9]{{1,3}}+(?:{DOT}[0-9]{{1,3}}+){{3}}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}+:){{7}}[0-9A-Fa-f]{{1,4}}+(?![0-9A-Fa-f:])",
    "card": rf"(?<![0-9])(?:[0-9]{{13}}(?![0-9])|[0-9]{{3,6}}+(?:(?:\x20\x20|\x20?[._/–-]\x20?)[0-9]{{2,6}}+){{2,5}}(?![0-9])|(?<=(?i:{CARD_CUE})[\x20:]{{1,3}})[0-9](?:[\x20-]?[0-9]){{13,18}}(?![0-9]))",
    "phone": r"(?<![0-9+(.-])(?<!\+[0-9]\x20)(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])|00[1-9](?:[\x20().-]{0,2}[0-9]){8,13}(?![0-9])|0[1-9][0-9]{1,3}[\x20/-][0-9]{3,8}(?:[\x20-][0-9]{2,4})?(?![0-9])"
    rf"|(?<=(?i:{PHONE_CUE})[\x20:.]{{1,3}})[0-9](?:[\x20().-]{{0,2}}[0-9]){{6,14}}(?![0-9]))",
}
#: A text without this has no near shape of the kind.
NEAR_NEEDS = {"email": r"(?i)[(\[{]at[)\]}]|\x20at\x20", "ip": r"(?i)[0-9]\x20?[(\[{]?(?:\.|dot)[)\]}]?\x20?[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{2}(?:[0-9]|[\x20._/–-]{1,3}[0-9])", "phone": r"[0-9]{3}[)\x20./-]|[0-9]{7}|00[1-9]|[0-9][\x20().-]{1,2}[0-9]"}

# Gazetteers and context words, in natural order.
TOP_LEVEL = "com|org|net|edu|gov|info|de|fr|es|uk|eu|io"
COUNTRY_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|52|54|55|61|64|65|81|82|86|90|91"
CARD_ISSUERS = "4|5[1-5]|34|37|6011|65|35"
CONTEXT = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|adresse",
    "ip": "ip|host|server|address|adresse|login|client",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta|payment",
    "phone": "phone|tel|telephone|telefon|telefono|teléfono|call|fax|mobile|cell",
}
AGAINST = "version|release|isbn|issn|doi|section|chapter|order|ticket|build|figure|no"

#: Characters before a span in which the context labeler looks.
REACH = 32
LABELERS = ("regex", "gazetteer", "context", "shape")
#: Log-odds of a vote at the start, and the pseudo-votes of each labeler that are right and wrong.
START, PSEUDO = 1.4, (2.0, 0.5)
#: Rounds of expectation-maximisation and of gradient ascent.
EM_ROUNDS, FIT_ROUNDS = 25, 200


def _let(value: Column, body) -> Column:
    """Evaluates a column once and hands it to an expression that uses it often."""
    return F.transform(F.array(value), body)[0]


#: Values that a running total takes together; the totals of such blocks are summed up first, so that time stays linear.
TOGETHER = 64


def running(values: Column, zero: int, op) -> Column:
    """An array's running total by an associative ``op``, each value included."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(zero), op)

    def inside(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out")), lambda acc: acc["out"])

    def whole(vs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / TOGETHER).cast("int")), lambda k: F.slice(vs, k * TOGETHER + 1, TOGETHER))
        start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))

        def begins(bs: Column) -> Column:
            return F.aggregate(F.transform(bs, total), start, lambda acc, t: F.struct(op(acc["at"], t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

        return _let(parts, lambda bs: F.flatten(F.zip_with(bs, begins(bs), inside)))

    return _let(values, lambda vs: F.when(F.size(vs) == 0, F.array().cast("array<int>")).otherwise(whole(vs)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before>> of a pattern's leftmost matches, in code points.

    The pieces between matches give the places: each match starts after all pieces and matches before it. ``before`` is
    the end of the piece before the match, REACH characters at most.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    found = F.filter(zipped, lambda p: p["match"].isNotNull())
    pairs = F.transform(found, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("n"), p["match"].alias("match"), F.right(p["gap"], F.lit(REACH)).alias("before")))

    def placed(ps: Column) -> Column:
        ends = running(F.transform(ps, lambda p: p["gap"] + p["n"]), 0, lambda a, b: a + b)
        return F.zip_with(ps, ends, lambda p, e: F.struct((e - p["n"]).alias("start"), e.alias("end"), p["match"].alias("match"), p["before"].alias("before")))

    return _let(pairs, placed)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes Luhn's check; evaluates its input once."""
    places = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.get(F.array(*[F.lit(d * 2 - 9 * (d > 4)) for d in range(10)]), c.try_cast("int"))))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def numbers(match: Column) -> Column:
    return F.transform(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)), lambda n: n.try_cast("double"))


def valid(kind: str, base: bool, match: Column) -> Column:
    """Whether a match counts: the base rules, or what makes a near shape a candidate."""
    if kind == "ip":
        small = F.forall(numbers(match), lambda n: n <= 255)
        return small if base else small | F.contains(match, F.lit(":"))
    if kind == "card":
        n = F.length(digits(match))
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False) if base else n.between(13, 19)
    if kind == "phone":
        return F.length(digits(match)).between(10 if base else 7, 15)
    return F.lit(True)


def votes(kind: str, base: bool, match: Column, before: Column) -> list[Column]:
    """A vote of 1, -1 or 0 (no opinion) from each labeler."""
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    gazetteer = {
        "email": F.when(F.lower(match).rlike(rf"[.)\]}}\x20]({TOP_LEVEL})$"), yes).otherwise(none),
        "ip": F.when(F.get(numbers(match), F.lit(0)).isin(0.0, 127.0, 255.0), no).otherwise(none),
        "card": F.when(digits(match).rlike(f"^({CARD_ISSUERS})"), yes).otherwise(no),
        "phone": F.when(match.rlike(rf"^(\+|00)({COUNTRY_CODES})(?![0-9]{{3}})"), yes).when(match.rlike(r"555"), yes).otherwise(none),
    }[kind]
    cue = F.lower(before)
    context = F.when(cue.rlike(rf"(?<![a-z])({CONTEXT[kind]})[^a-z]*$"), yes).when(cue.rlike(rf"(?<![a-z])({AGAINST})[\x20.:#]*$"), no).otherwise(none)
    shape = {
        "email": F.when(F.length(match).between(6, 64), yes).otherwise(no),
        "ip": F.when(match.rlike(r"(^|[^0-9])0[0-9]") & ~F.contains(match, F.lit(":")), no).when(F.exists(numbers(match), lambda n: n > 9), yes).otherwise(none),
        "card": F.when(F.length(digits(match)).between(13, 19) & luhn(digits(match)), yes).otherwise(no),
        "phone": F.when(F.length(digits(match)).between(10, 13), yes).when(F.length(digits(match)) < 10, none).otherwise(no),
    }[kind]
    return [yes if base else none, gazetteer, context, shape]


#: Beyond any place in a text.
FAR = (1 << 31) - 1
FOUND = "array<struct<start:int,kind:int,end:int,base:boolean,v:array<int>>>"


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, base, v>>: each base span of a text, and each near shape that touches none, with its votes."""

    def of(kind: str, base: bool) -> Column:
        pattern, needs = (BASE[kind], NEEDS[kind]) if base else (NEAR[kind], NEAR_NEEDS[kind])
        ok = F.filter(matches(text, pattern), lambda m: valid(kind, base, m["match"]))
        seen = F.transform(ok, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), F.lit(base).alias("base"), F.array(*votes(kind, base, m["match"], m["before"])).alias("v")))
        there = F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs)
        return F.when(there, seen).otherwise(F.array().cast(FOUND))

    def free(found: Column) -> Column:
        """Leaves out near shapes that a base span begins before and reaches into, or begins in."""
        reach = running(F.transform(found, lambda s: F.when(s["base"], s["end"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
        ahead = F.reverse(running(F.reverse(F.transform(found, lambda s: F.when(s["base"], s["start"]).otherwise(FAR))), FAR, lambda a, b: F.least(a, b)))
        placed = F.arrays_zip(found.alias("s"), reach.alias("reach"), ahead.alias("ahead"))
        return F.transform(F.filter(placed, lambda x: x["s"]["base"] | ((x["reach"] <= x["s"]["start"]) & (x["ahead"] >= x["s"]["end"]))), lambda x: x["s"])

    both = F.struct(F.concat(*[of(k, True) for k in KINDS]).cast(FOUND).alias("base"), F.concat(*[of(k, False) for k in KINDS]).cast(FOUND).alias("near"))
    return _let(both, lambda s: F.when(F.size(s["near"]) == 0, s["base"]).otherwise(_let(F.sort_array(F.concat(s["base"], s["near"])), free)))


def patterns(found: DataFrame) -> DataFrame:
    """(kind, base, v, n): how often each vote pattern occurs; at most kinds x 2 x 3^labelers rows."""
    return found.select(F.explode("found").alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.base").alias("base"), F.col("s.v").alias("v")).agg(F.count("*").alias("n"))


def _posterior(p: Column, state: Column) -> Column:
    """P(span is real | votes): prior log-odds plus the log-likelihood ratio of each vote that was cast."""
    votes = F.aggregate(F.zip_with(p["v"], state["ratio"], lambda x, r: F.when(x == 1, r["yes"]).when(x == -1, r["no"]).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    score = votes + F.when(p["base"], state["base"]).otherwise(state["near"])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))


def fit(counted: DataFrame) -> DataFrame:
    """One row (kind, weights) for each kind: the span classifier's bias and weights.

    Expectation-maximisation starts from labelers that are right four times in five, and even priors. A labeler that
    casts no vote says nothing. Base and near spans have priors of their own, so that the many base spans do not decide
    on the near ones, and share the labelers' reliabilities; pseudo-votes that agree with the start keep labelers that
    rarely vote defined. The posteriors are the targets of a logistic regression on for- and against-indicators of each
    labeler, fitted by gradient ascent with weight decay. Both are folds over the counted patterns, so their cost does
    not depend on the number of spans.
    """
    k = len(LABELERS)
    per = counted.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("base", "v", "n"))).alias("p"))
    even = F.struct(F.lit(START).alias("yes"), F.lit(-START).alias("no"))
    begin = F.struct(F.lit(0.0).alias("near"), F.lit(0.0).alias("base"), F.array(*[even] * k).alias("ratio"))

    def em(state: Column) -> Column:
        weighed = F.transform("p", lambda p: _let(_posterior(p, state), lambda q: F.struct(p["base"].alias("base"), p["v"].alias("v"), (p["n"] * q).alias("y"), (p["n"] * (1 - q)).alias("z"))))

        def update(w: Column) -> Column:
            def total(f) -> Column:
                return F.aggregate(w, F.lit(0.0), lambda a, x: a + f(x))

            def ratio(j: int) -> Column:
                right, wrong = PSEUDO
                yy, yn = (total(lambda x, o=o: F.when(x["v"][j] == o, x["y"]).otherwise(0.0)) for o in (1, -1))
                zy, zn = (total(lambda x, o=o: F.when(x["v"][j] == o, x["z"]).otherwise(0.0)) for o in (1, -1))
                real, unreal = yy + yn + right + wrong, zy + zn + right + wrong
                return F.struct((F.ln((yy + right) / real) - F.ln((zy + wrong) / unreal)).alias("yes"), (F.ln((yn + wrong) / real) - F.ln((zn + right) / unreal)).alias("no"))

            def prior(base: bool) -> Column:
                ys, zs = (total(lambda x, c=c: F.when(x["base"] == base, x[c]).otherwise(0.0)) for c in "yz")
                return F.ln((ys + 1) / (zs + 1))

            return F.struct(prior(False).alias("near"), prior(True).alias("base"), F.array(*[ratio(j) for j in range(k)]).alias("ratio"))

        return _let(weighed, update)

    soft = per.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), begin, lambda s, _: em(s)))
    soft = soft.select("kind", F.transform(F.arrays_zip("p", F.array_repeat("state", F.size("p")).alias("state")), lambda x: F.struct(_features(x["p"]["v"]).alias("f"), x["p"]["n"].alias("n"), _posterior(x["p"], x["state"]).alias("y"))).alias("p"))
    zero = F.array(*[F.lit(0.0)] * (2 * k + 1))
    size = F.aggregate("p", F.lit(0.0), lambda a, x: a + F.sqrt(x["n"].cast("double")))

    def ascend(w: Column) -> Column:
        # a pattern weighs the root of its count, or rare ones would not be learnt beside the base spans
        grad = F.aggregate("p", zero, lambda g, x: _let(F.sqrt(x["n"].cast("double")) * (x["y"] - _sigmoid(w, x["f"])), lambda e: F.zip_with(g, x["f"], lambda a, f: a + e * f)))
        return F.zip_with(w, grad, lambda a, g: a * 0.999 + g * 2.0 / size)

    return soft.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), zero, lambda w, _: ascend(w)).alias("weights"))


def _features(v: Column) -> Column:
    """A one, then for each labeler whether it votes for and whether it votes against."""
    return F.concat(F.array(F.lit(1.0)), F.flatten(F.transform(v, lambda x: F.array((x == 1).cast("double"), (x == -1).cast("double")))))


def _sigmoid(w: Column, f: Column) -> Column:
    return 1 / (1 + F.exp(-F.aggregate(F.zip_with(w, f, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)))


def _accepted(found: Column, weights: dict[int, list[float]], threshold: float) -> Column:
    """Of the candidates the base spans and those that the classifier accepts."""
    zero = [0.0] * (2 * len(LABELERS) + 1)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in weights.get(k, zero)]) for k in range(len(KINDS))])
    return F.filter(found, lambda s: s["base"] | (_sigmoid(F.get(table, s["kind"]), _features(s["v"])) > threshold))


def _spans(found: Column) -> Column:
    return F.sort_array(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"])))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, list[float]]]:
    """(id, found) of every row, written once, and the trained weights by kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = settle(docs.select(F.col(id_col).cast("long").alias("id"), candidates(text).alias("found")), "pii")
    return found, {r["kind"]: r["weights"] for r in fit(patterns(found)).collect()}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row (id, base, spans) for every row of ``docs``.

    base: the base patterns' spans; spans: these and the near shapes that the trained classifier accepts at
    ``threshold``; both arrays of (start, kind, end), sorted, in code points, end exclusive, kind an index into KINDS.
    A null text counts as empty and has no spans; repeated rows give a row each; an empty table gives an empty result;
    other columns are not read. Only the classifier's few weights, of four kinds at most, pass through the driver.
    """
    found, weights = _scan(docs, id_col, text_col)
    return found.select("id", _spans(F.filter("found", lambda s: s["base"])).alias("base"), _spans(_accepted(F.col("found"), weights, threshold)).alias("spans"))


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; all rows and other columns stay, whatever their names.

    The classifier is trained over all rows; then each text is looked at again in its own row, so that ids need not be
    unique and no text is shuffled. Overlapping spans are replaced as one, by the kind of the first. A null text stays.
    """
    _, weights = _scan(docs, id_col, text_col)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col(text_col).cast("string")
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(marks, s["kind"])))
        return F.struct(F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    spans = _spans(_accepted(candidates(F.coalesce(text, F.lit(""))), weights, threshold))
    clean = _let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(F.aggregate(s, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))))
    return docs.withColumn(text_col, clean)
