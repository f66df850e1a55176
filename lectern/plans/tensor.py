"""Vector queries over the embeddings (64 values each), routing queries over line items, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import arrays as A
from lectern.functions.core import dot, r6, total
from lectern.operators import tensor as O
from lectern.operators.ranking import cumulate
from lectern.sources.tables import table, traces


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("x"), F.col("label").cast("long").alias("label"))


def summary(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    """A vector result in three numbers: its sum, its sum of squares, and its sum weighted by place."""
    v = vectors(spark, sf_dir).select("vec_id", value.alias("v"))
    return v.select("vec_id", r6(total(F.col("v")), "s1"), r6(dot(F.col("v"), F.col("v")), "s2"), r6(total(F.transform("v", lambda x, i: x * (i + 1) / 64.0)), "s3"))


X = F.col
WEIGHTS = [[((3 * o + 5 * d) % 7 - 3) / 8.0 for d in range(64)] for o in range(4)]


def rmsnorm(spark, sf_dir):
    return summary(spark, sf_dir, A.rms_norm(X("x")))


def layernorm(spark, sf_dir):
    return summary(spark, sf_dir, A.layer_norm(X("x")))


def swiglu(spark, sf_dir):
    return summary(spark, sf_dir, A.swiglu(F.slice("x", 1, 32), F.slice("x", 33, 32)))


def quickgelu(spark, sf_dir):
    return summary(spark, sf_dir, A.quick_gelu(X("x")))


def gelu_udf(spark, sf_dir):
    return summary(spark, sf_dir, A.gelu(X("x")))


def rope(spark, sf_dir):
    return summary(spark, sf_dir, A.rope(X("x"), X("vec_id") % 128))


def softmax(spark, sf_dir):
    return summary(spark, sf_dir, A.softmax(X("x")))


def linear(spark, sf_dir):
    y = vectors(spark, sf_dir).select("vec_id", A.linear(X("x"), WEIGHTS).alias("y"))
    return y.select("vec_id", *[r6(X("y")[k], f"y{k}") for k in range(4)])


def softmax_entropy(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", A.softmax_entropy(X("x"), F.array_max("x")).alias("e"))
    return v.select("vec_id", r6(X("e.p1"), "p1"), r6(X("e.entropy"), "entropy"))


def split_softmax(spark, sf_dir):
    v = vectors(spark, sf_dir)
    ramp = F.transform("x", lambda _, i: i / 64.0)
    direct = A.softmax(X("x"))
    return v.select("vec_id", r6(A.split_softmax(X("x"), ramp, 5), "split"), r6(dot(direct, ramp), "direct"))


def argmax(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", A.argmax(X("x")).cast("long").alias("at"))


def topk_route(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", F.posexplode(A.top_k(A.softmax(X("x")), 6)).alias("slot", "t"))
    return v.select("vec_id", X("slot").cast("long").alias("slot"), X("t.i").cast("long").alias("expert"), r6(X("t.v"), "weight"))


def block_topk(spark, sf_dir):
    """Two stages: the best two of each block of eight values, then the best four of these."""
    v = vectors(spark, sf_dir).select("vec_id", F.posexplode(O.block_top_k(X("x"), 8, 2, 4)).alias("rank", "t"))
    return v.select("vec_id", X("rank").cast("long").alias("rank"), X("t.i").cast("long").alias("i"), r6(X("t.v"), "value"))


def rescore(spark, sf_dir):
    """The two best candidates by 4-bit codes, scored again exactly: the winner and its value."""
    v = vectors(spark, sf_dir).withColumn("rough", F.flatten(F.transform(A.quant_int4(X("x"), 16), lambda g: F.transform(g["codes"], lambda c: c * g["scale"]))))
    v = v.select("vec_id", F.array_sort(F.transform(A.top_k(X("rough"), 4), lambda t: F.struct((-F.get("x", t["i"])).alias("n"), t["i"].alias("i"))))[0].alias("b"))
    return v.select("vec_id", X("b.i").cast("long").alias("at"), r6(-X("b.n"), "value"))


def quant_int4(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", F.posexplode(A.quant_int4(X("x"), 16)).alias("g", "q"))
    return v.select("vec_id", X("g").cast("long").alias("g"), r6(X("q.scale"), "scale"), F.array_join("q.codes", ",").alias("codes"))


def quant_fp8_scale(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(A.fp8_scale(X("x")), 9).alias("scale"))


def quant_fp8_codes(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.array_join(A.fp8_codes(X("x")), ",").alias("codes"))


def nibble(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 256).cast("int").alias("byte")).agg(F.count("*").alias("n"))
    return b.select(X("byte").cast("long").alias("byte"), A.nibble(X("byte"), False).cast("long").alias("low"), A.nibble(X("byte"), True).cast("long").alias("high"), "n")


def pages_of(spark, sf_dir) -> DataFrame:
    """Vectors in sequences of 32 neighbours, with their place."""
    return vectors(spark, sf_dir).select(F.floor(X("vec_id") / 32).cast("long").alias("seq"), (X("vec_id") % 32).alias("pos"), "x")


def causal_attn(spark, sf_dir):
    out = O.attention(pages_of(spark, sf_dir), X("k.pos") <= X("q.pos"))
    return out.select("seq", "pos", "keys", r6(total(X("out")), "s1"), r6(dot(X("out"), X("out")), "s2"))


def rswa_frame(spark, sf_dir):
    """The first eight vectors of a sequence are seen by all later ones, besides the last four."""
    near = (X("k.pos") <= X("q.pos")) & ((X("k.pos") < 8) | (X("k.pos") > X("q.pos") - 4))
    out = O.attention(pages_of(spark, sf_dir), near).where("pos >= 8")
    return out.select("seq", "pos", "keys", r6(total(X("out")), "s1"), r6(dot(X("out"), X("out")), "s2"))


def ring_slot(spark, sf_dir):
    t = traces(spark, sf_dir).select("stream", X("step").cast("long").alias("step"))
    pf = X("stream") % 300 + 1
    return t.select("stream", "step", (pf + F.pmod(X("step") - 1, F.lit(128))).alias("slot"))


def tokens(spark, sf_dir) -> DataFrame:
    """(t, slot, expert) from line items: an order's line is a token, its part its expert of 64."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((X("l_orderkey") * 8 + X("l_linenumber")).alias("t"), (X("l_suppkey") % 6).alias("slot"), (X("l_partkey") % 64).alias("expert"), X("l_quantity").alias("w"))


def expert_hist(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("expert").agg(F.count("*").alias("n"))


def expert_offsets(spark, sf_dir):
    h = expert_hist(spark, sf_dir)  # one row an expert, 64 in all
    return h.select("expert", F.coalesce(F.sum("n").over(Window.orderBy("expert").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))


def expert_bins(spark, sf_dir):
    """Each expert's tokens in order of (token, slot), in bins of 64: first and last token and their number."""
    t = tokens(spark, sf_dir).groupBy("expert", "t").agg(F.count("*").alias("n"))
    # a token's places start at its first; 64 experts are too few keys to sort by
    b = cumulate(t, "t", ["expert"]).select("expert", "t", F.explode(F.sequence(X("below"), X("below") + X("n") - 1)).alias("nth")).withColumn("bin", F.floor(X("nth") / 64).cast("long"))
    return b.groupBy("expert", "bin").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


def gather_join(spark, sf_dir):
    """Each line item's part vector: joined by number, summed by return flag."""
    v = vectors(spark, sf_dir).select("vec_id", X("x")[0].alias("x0"), X("x")[63].alias("x63"))
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", X("l_partkey").alias("vec_id"))
    return li.join(v, "vec_id").groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.avg("x0"), "x0"), r6(F.avg("x63"), "x63"))


def ngram_ban(spark, sf_dir):
    """Tokens that would repeat a four-token run of their stream: at each step the banned successors."""
    t = traces(spark, sf_dir).select("stream", "step", F.floor(X("p1") * 3).cast("long").alias("tok"))
    return O.ngram_bans(t, 4).groupBy("stream", X("step").cast("long").alias("step")).agg(F.array_join(F.array_sort(F.collect_set("banned")), ",").alias("banned"))


def assemble_ref(spark, sf_dir):
    """A reference of bos, visual rows and four prompt ids, with places: its length and checksum by job of 32 vectors."""
    n = vectors(spark, sf_dir).groupBy(F.floor(X("vec_id") / 32).cast("long").alias("job")).agg(F.count("*").alias("n"))
    parts = n.select("job", F.posexplode(O.reference_ids(X("n"))).alias("pos", "id"))
    return parts.groupBy("job").agg(F.count("*").alias("len"), F.sum(X("id") * (X("pos") + 1)).cast("long").alias("checksum"))


def masses(spark, sf_dir) -> DataFrame:
    """(page, head, target, mass): a trace's certainty as attention mass, its place dealt to pages of 16 steps."""
    t = traces(spark, sf_dir)
    return t.select(F.floor((X("step") - 1) / 16).cast("long").alias("page"), (X("stream") % 4).alias("head"), F.floor((X("step") - 1) * X("p1") / 16).cast("long").alias("target"), X("p1").alias("mass"))


def mass_by_block(spark, sf_dir):
    return O.mean_mass(masses(spark, sf_dir)).select("page", "head", "target", r6(X("mass"), "mass"))


def mass_lag(spark, sf_dir):
    return O.mass_behind(O.mean_mass(masses(spark, sf_dir))).select("lag", r6(X("mean_mass"), "mean_mass"), r6(X("max_mass"), "max_mass"))


def infer_stub(spark, sf_dir):
    """The place where a model would run: a fixed stand-in that maps a vector to token ids. It is not text recognition."""
    return O.infer(vectors(spark, sf_dir).select("vec_id", "x"), O.stub_model)


E_ = "e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings)"


def _sum(v: str) -> str:
    return f"""round(list_sum({v}), 6) + 0.0::DOUBLE AS s1, round(list_sum(list_transform({v}, lambda a: a * a)), 6) + 0.0::DOUBLE AS s2,
        round(list_sum(list_transform({v}, lambda a, i: a * i / 64.0::DOUBLE)), 6) + 0.0::DOUBLE AS s3"""


def _map(v: str) -> str:
    return f"WITH {E_}, v AS (SELECT vec_id, {v} AS v FROM e) SELECT vec_id, {_sum('v')} FROM v"


SM = "sm AS (SELECT vec_id, x, list_transform(x, lambda a: exp(a - list_max(x))) AS ex FROM e), p AS (SELECT vec_id, x, list_transform(ex, lambda a: a / list_sum(ex)) AS p FROM sm)"
LONG = "l AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM e)"
Q4 = """g AS (SELECT vec_id, i // 16 AS g, max(abs(v)) AS peak FROM l GROUP BY ALL), gs AS (SELECT *, CASE WHEN peak = 0 THEN 1.0::DOUBLE ELSE peak END / 7 AS scale FROM g),
    q AS (SELECT l.vec_id, l.i, l.v, gs.g, gs.scale, greatest(-7, least(7, round_even(v / scale, 0)::INT)) AS code FROM l JOIN gs ON gs.vec_id = l.vec_id AND gs.g = l.i // 16)"""
T_ = "t AS (SELECT l_orderkey * 8 + l_linenumber AS t, l_suppkey % 6 AS slot, l_partkey % 64 AS expert FROM lineitem)"
TR = "tr AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, 50 / (50 + value) AS p1 FROM events)"


def _attn(mask: str, where: str = "true") -> str:
    return f"""WITH {E_}, s AS (SELECT vec_id // 32 AS seq, vec_id % 32 AS pos, x FROM e),
        w AS (SELECT q.seq, q.pos, k.x AS kx, list_sum(list_transform(list_zip(q.x, k.x), lambda z: z[1] * z[2])) / 8 AS s FROM s q JOIN s k ON q.seq = k.seq AND {mask}),
        m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, pos)) AS ew FROM w), n AS (SELECT *, ew / sum(ew) OVER (PARTITION BY seq, pos) AS a FROM m),
        d AS (SELECT seq, pos, a, unnest(kx) AS v, generate_subscripts(kx, 1) AS i FROM n), o AS (SELECT seq, pos, i, sum(a * v) AS o, count(*) AS keys FROM d GROUP BY ALL)
        SELECT seq, pos, max(keys) AS keys, round(sum(o), 6) + 0.0::DOUBLE AS s1, round(sum(o * o), 6) + 0.0::DOUBLE AS s2 FROM o WHERE {where} GROUP BY seq, pos"""


MASS = f"""{TR}, ms AS (SELECT (step - 1) // 16 AS page, stream % 4 AS head, floor((step - 1) * p1 / 16)::BIGINT AS target, p1 FROM tr), c AS (SELECT page, count(*) AS n FROM ms GROUP BY page),
    mm AS (SELECT page, head, target, sum(p1) / max(n) AS mass FROM ms JOIN c USING (page) GROUP BY page, head, target)"""
QUERIES = {f.__name__: f for f in (rmsnorm, layernorm, swiglu, quickgelu, rope, linear, softmax, softmax_entropy, argmax, topk_route, block_topk, rescore, quant_int4, quant_fp8_scale, quant_fp8_codes, nibble, split_softmax, causal_attn, rswa_frame, ring_slot, gather_join, expert_hist, expert_offsets, expert_bins, ngram_ban, assemble_ref, mass_by_block, mass_lag, gelu_udf, infer_stub)}
SQL = {
    "rmsnorm": _map("list_transform(x, lambda a: a / sqrt(list_sum(list_transform(x, lambda b: b * b)) / 64 + 1e-6))"),
    "layernorm": _map("list_transform(x, lambda a: (a - list_avg(x)) / sqrt(list_sum(list_transform(x, lambda b: (b - list_avg(x)) ** 2)) / 64 + 1e-6))"),
    "swiglu": _map("list_transform(range(1, 33), lambda i: x[i] / (1 + exp(-x[i])) * x[i + 32])"),
    "quickgelu": _map("list_transform(x, lambda a: a / (1 + exp(-1.702::DOUBLE * a)))"),
    "rope": _map("""list_concat(list_transform(range(1, 33), lambda i: x[i] * cos((vec_id % 128) * 10000.0::DOUBLE ** (-2.0::DOUBLE * (i - 1) / 64)) - x[i + 32] * sin((vec_id % 128) * 10000.0::DOUBLE ** (-2.0::DOUBLE * (i - 1) / 64))),
        list_transform(range(1, 33), lambda i: x[i + 32] * cos((vec_id % 128) * 10000.0::DOUBLE ** (-2.0::DOUBLE * (i - 1) / 64)) + x[i] * sin((vec_id % 128) * 10000.0::DOUBLE ** (-2.0::DOUBLE * (i - 1) / 64))))"""),
    "softmax": f"WITH {E_}, {SM} SELECT vec_id, {_sum('p')} FROM p",
    "linear": f"WITH {E_} SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(x, lambda a, i: a * ((3 * {o} + 5 * (i - 1)) % 7 - 3) / 8.0::DOUBLE)), 6) + 0.0::DOUBLE AS y{o}" for o in range(4)) + " FROM e",
    "softmax_entropy": f"WITH {E_}, z AS (SELECT vec_id, list_transform(x, lambda a: a - list_max(x)) AS s FROM e), q AS (SELECT vec_id, list_sum(list_transform(s, lambda a: exp(a))) AS z, list_sum(list_transform(s, lambda a: exp(a) * a)) AS zx FROM z) SELECT vec_id, round(1 / z, 6) + 0.0::DOUBLE AS p1, round(ln(z) - zx / z, 6) + 0.0::DOUBLE AS entropy FROM q",
    "split_softmax": f"WITH {E_}, {SM}, r AS (SELECT vec_id, round(list_sum(list_transform(p, lambda a, i: a * (i - 1) / 64.0::DOUBLE)), 6) + 0.0::DOUBLE AS s FROM p) SELECT vec_id, s AS split, s AS direct FROM r",
    "argmax": f"WITH {E_}, {LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM l) SELECT vec_id, i AS at FROM r WHERE n = 1",
    "topk_route": f"WITH {E_}, {SM}, l AS (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS i FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM l) SELECT vec_id, n - 1 AS slot, i AS expert, round(v, 6) + 0.0::DOUBLE AS weight FROM r WHERE n <= 6",
    "block_topk": f"WITH {E_}, {LONG}, b AS (SELECT *, row_number() OVER (PARTITION BY vec_id, i // 8 ORDER BY v DESC, i) AS n FROM l), r AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM b WHERE n <= 2) SELECT vec_id, n - 1 AS rank, i, round(v, 6) + 0.0::DOUBLE AS value FROM r WHERE n <= 4",
    "rescore": f"WITH {E_}, {LONG}, {Q4}, c AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY code * scale DESC, i) AS n FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM c WHERE n <= 4) SELECT vec_id, i AS at, round(v, 6) + 0.0::DOUBLE AS value FROM r WHERE k = 1",
    "quant_int4": f"WITH {E_}, {LONG}, {Q4} SELECT vec_id, g, round(max(scale), 6) + 0.0::DOUBLE AS scale, string_agg(code, ',' ORDER BY i) AS codes FROM q GROUP BY vec_id, g",
    "quant_fp8_scale": f"WITH {E_} SELECT vec_id, round(CASE WHEN list_max(list_transform(x, lambda a: abs(a))) = 0 THEN 1.0::DOUBLE ELSE list_max(list_transform(x, lambda a: abs(a))) END / 448, 9) AS scale FROM e",
    "nibble": "WITH b AS (SELECT l_partkey % 256 AS byte, count(*) AS n FROM lineitem GROUP BY 1) SELECT byte, CASE WHEN byte % 16 >= 8 THEN byte % 16 - 16 ELSE byte % 16 END AS low, CASE WHEN byte // 16 >= 8 THEN byte // 16 - 16 ELSE byte // 16 END AS high, n FROM b",
    "causal_attn": _attn("k.pos <= q.pos"),
    "rswa_frame": _attn("k.pos <= q.pos AND (k.pos < 8 OR k.pos > q.pos - 4)", "pos >= 8"),
    "ring_slot": f"WITH {TR} SELECT stream, step, stream % 300 + 1 + (step - 1) % 128 AS slot FROM tr",
    "expert_hist": f"WITH {T_} SELECT expert, count(*) AS n FROM t GROUP BY expert",
    "expert_offsets": f"WITH {T_}, h AS (SELECT expert, count(*) AS n FROM t GROUP BY expert) SELECT expert, coalesce(sum(n) OVER (ORDER BY expert ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM h",
    "expert_bins": f"WITH {T_}, b AS (SELECT *, (row_number() OVER (PARTITION BY expert ORDER BY t, slot) - 1) // 64 AS bin FROM t) SELECT expert, bin, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM b GROUP BY expert, bin",
    "gather_join": f"WITH {E_} SELECT l_returnflag, count(*) AS n, round(avg(x[1]), 6) + 0.0::DOUBLE AS x0, round(avg(x[64]), 6) + 0.0::DOUBLE AS x63 FROM lineitem JOIN e ON l_partkey = vec_id GROUP BY l_returnflag",
    "ngram_ban": f"""WITH {TR}, k AS (SELECT stream, step, floor(p1 * 3)::BIGINT AS tok FROM tr), g AS (SELECT *, lag(tok, 1) OVER w AS a, lag(tok, 2) OVER w AS b, lead(tok) OVER w AS nxt FROM k WINDOW w AS (PARTITION BY stream ORDER BY step)),
        j AS (SELECT DISTINCT n.stream, n.step, o.nxt AS banned FROM g n JOIN g o ON n.stream = o.stream AND o.step < n.step AND o.tok = n.tok AND o.a = n.a AND o.b = n.b) SELECT stream, step, string_agg(banned, ',' ORDER BY banned) AS banned FROM j GROUP BY stream, step""",
    "assemble_ref": "WITH n AS (SELECT vec_id // 32 AS job, count(*) AS n FROM embeddings GROUP BY 1), r AS (SELECT job, list_concat([0], list_concat(list_transform(range(0, n), lambda i: -1 - i), [37460, 4366, 76466, 16])) AS ids FROM n) SELECT job, len(ids) AS len, list_sum(list_transform(ids, lambda a, i: a * i))::BIGINT AS checksum FROM r",
    "mass_by_block": f"WITH {MASS} SELECT page, head, target, round(mass, 6) + 0.0::DOUBLE AS mass FROM mm",
    "mass_lag": f"""WITH {MASS}, hd AS (SELECT DISTINCT page, head FROM ms), g AS (SELECT lag, hd.page, hd.head, coalesce(sum(mass), 0) AS behind FROM (SELECT unnest([1, 2, 3])::BIGINT AS lag) z JOIN hd ON hd.page >= lag
        LEFT JOIN mm ON mm.page = hd.page AND mm.head = hd.head AND mm.target <= hd.page - lag GROUP BY ALL), p AS (SELECT lag, page, avg(behind) AS m, max(behind) AS mx FROM g GROUP BY lag, page)
        SELECT lag, round(avg(m), 6) + 0.0::DOUBLE AS mean_mass, round(max(mx), 6) + 0.0::DOUBLE AS max_mass FROM p GROUP BY lag""",
}
