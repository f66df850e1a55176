"""Queries of a network's blocks over the embeddings, with weights from rules, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import arrays as A
from lectern.functions.core import dot, let, r6, total
from lectern.operators import experts as X
from lectern.plans.tensor import E_, LONG, vectors
from lectern.sources.files import f32_bytes, f32_values

# Width of the vectors and of the hidden layers, experts, and how many each vector goes to.
WIDTH, HIDDEN, EXPERTS, TOP = 64, 8, 8, 2
GATES, PLACES = 8, 7


def rule(a: int, b: int, c: int, m: int, rows: int, columns: int) -> np.ndarray:
    """A matrix of small numbers: (a row + b column + c) mod m, centred, in eighths."""
    r, k = np.arange(rows)[:, None], np.arange(columns)[None, :]
    return ((a * r + b * k + c) % m - m // 2) / 8.0


def matrices(expert: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An expert's gate and up (HIDDEN x WIDTH) and down (WIDTH x HIDDEN)."""
    return rule(3, 5, expert, 7, HIDDEN, WIDTH), rule(5, 3, 2 * expert, 7, HIDDEN, WIDTH), rule(1, 2, expert, 5, WIDTH, HIDDEN)


def lit(m: np.ndarray):
    return F.lit(m.tolist()) if m.ndim == 1 else F.array(*[F.lit(r.tolist()) for r in m])


def two(spark: SparkSession, value) -> list:
    return [r6(total(value), "s1"), r6(total(F.transform(value, lambda v, i: v * (i + 1))), "s2")]


def gate_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's router logits, one for each expert: a product with a small matrix."""
    y = vectors(spark, sf_dir).select("vec_id", X.matvec(lit(rule(3, 5, 0, 7, GATES, WIDTH)), F.col("x")).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, x, slot, expert, w): the experts of each vector, by the softmax of its logits."""
    v = vectors(spark, sf_dir).withColumn("p", A.softmax(X.matvec(lit(rule(3, 5, 0, 7, EXPERTS, WIDTH)), F.col("x"))))
    return v.select("vec_id", "x", F.posexplode(A.top_k(F.col("p"), TOP)).alias("slot", "t")).select("vec_id", "x", "slot", F.col("t.i").alias("expert"), F.col("t.v").alias("w"))


def moe_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts' matrices joined to the rows routed to them, and the results added up by weight, in the order of slots."""
    rows = [(e, *(m.tolist() for m in matrices(e))) for e in range(EXPERTS)]
    weights = spark.createDataFrame(rows, "expert int, gate array<array<double>>, up array<array<double>>, down array<array<double>>")
    done = routed(spark, sf_dir).join(weights, "expert").select("vec_id", "slot", "w", X.expert_mlp(F.col("x"), F.col("gate"), F.col("up"), F.col("down")).alias("y"))
    return X.combine(done, "vec_id", "slot", "w", "y").select("vec_id", *two(spark, F.col("y")))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routed(spark, sf_dir)
    done = X.grouped_experts(r, "vec_id", "slot", "expert", "x", matrices)
    return X.combine(done.join(r.select("vec_id", "slot", "w"), ["vec_id", "slot"]), "vec_id", "slot", "w", "y")


def moe_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with rows grouped by expert, a matrix product for each run of them."""
    return grouped(spark, sf_dir).select("vec_id", *two(spark, F.col("y")))


def shared(x):
    """The expert that all vectors go to: the matrices after the last."""
    return X.expert_mlp(x, *[lit(m) for m in matrices(EXPERTS)])


def dense_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = vectors(spark, sf_dir).select("vec_id", shared(F.col("x")).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def moe_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of a layer: layer 0 is dense; in others the routed experts' sum and the shared expert's output are added.

    A vector's label is its layer.
    """
    v = vectors(spark, sf_dir).select("vec_id", (F.col("label") == 0).alias("dense"), shared(F.col("x")).alias("s"))
    y = v.join(grouped(spark, sf_dir), "vec_id").select("vec_id", F.when(F.col("dense"), F.col("s")).otherwise(A.add(F.col("y"), F.col("s"))).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def linear_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product with a 32 x 64 matrix and a bias, a batch of vectors at a time."""
    y = X.bulk_linear(vectors(spark, sf_dir), "vec_id", "x", rule(3, 5, 1, 7, 32, WIDTH), rule(1, 1, 0, 5, 1, 32)[0])
    return y.select("vec_id", *two(spark, F.col("y")))


def gemv_fp8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as 8-bit floats and back, times a small matrix, plus a bias."""
    m, bias = rule(5, 3, 0, 7, GATES, WIDTH), rule(1, 1, 0, 5, 1, GATES)[0]
    y = vectors(spark, sf_dir).select("vec_id", A.add(X.matvec(lit(m), A.fp8_round(F.col("x"))), lit(bias)).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def lm_head_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an output matrix ranked by 4-bit codes of the vector: the four best, scored again exactly, and the winner."""
    head = lit(rule(7, 3, 0, 11, 16, WIDTH))
    v = vectors(spark, sf_dir).select("vec_id", "x", A.top_k(X.matvec(head, A.dequant_int4(A.quant_int4(F.col("x"), 16))), 4).alias("t"))
    exact = F.transform("t", lambda t: F.struct((-dot(F.get(head, t["i"]), F.col("x"))).alias("n"), t["i"].alias("i")))
    best = v.select("vec_id", F.array_sort(exact)[0].alias("b"))
    return best.select("vec_id", F.col("b.i").cast("long").alias("at"), r6(-F.col("b.n"), "value"))


def candidate_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certainty and entropy over the eight largest values alone, shifted by the largest."""
    v = vectors(spark, sf_dir).select("vec_id", F.transform(A.top_k(F.col("x"), 8), lambda t: t["v"]).alias("c"))
    e = v.select("vec_id", A.softmax_entropy(F.col("c"), F.array_max("c")).alias("e"))
    return e.select("vec_id", r6(F.col("e.p1"), "p1"), r6(F.col("e.entropy"), "entropy"))


def weights_of(c: int):
    return lit(rule(1, 3, c, 5, 1, WIDTH)[0])


def norm_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector plus its reverse, normed with weights: the sum is kept beside it."""
    n = vectors(spark, sf_dir).select("vec_id", A.add_rms_norm(F.col("x"), F.reverse("x"), weights_of(1)).alias("n"))
    return n.select("vec_id", r6(total(F.col("n.sum")), "kept"), *two(spark, F.col("n.normed")))


def norm_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer norm with weights and a bias."""
    y = vectors(spark, sf_dir).select("vec_id", A.scaled(A.layer_norm(F.col("x"), 1e-5), weights_of(2), weights_of(3)).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def norm_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer norm over four channels of 16 cells."""
    y = vectors(spark, sf_dir).select("vec_id", A.channel_norm(F.col("x"), 4, lit(np.array([0.5, 1.0, 1.5, 2.0])), lit(np.array([0.0, 0.25, 0.5, 0.75]))).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def bias_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = vectors(spark, sf_dir).select("vec_id", A.add(F.col("x"), weights_of(4)).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def add_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of positions for each place in a tile of 49 vectors, added to the vector there."""
    rows = spark.createDataFrame([(k, rule(1, 3, k, 5, 1, WIDTH)[0].tolist()) for k in range(PLACES * PLACES)], "place long, row array<double>")
    v = vectors(spark, sf_dir).withColumn("place", F.col("vec_id") % (PLACES * PLACES)).join(rows, "place")
    return v.select("vec_id", A.add(F.col("x"), F.col("row")).alias("y")).select("vec_id", *two(spark, F.col("y")))


def to_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 cells of 4 channels, turned into 4 channels of 16 cells."""
    y = vectors(spark, sf_dir).select("vec_id", A.transposed(F.col("x"), 16).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two encoders' features side by side: a vector without its first value, then the transposed one."""
    y = vectors(spark, sf_dir).select("vec_id", F.concat(F.slice("x", 2, WIDTH - 1), A.transposed(F.col("x"), 8)).alias("y"))
    return y.select("vec_id", F.size("y").cast("long").alias("n"), *two(spark, F.col("y")))


def merge_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four heads of 16 values split off each vector and put together again in reverse order."""
    y = vectors(spark, sf_dir).select("vec_id", F.flatten(F.reverse(A.rows_of(F.col("x"), 4))).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def conv1x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 4 channels and 16 cells with its channels mixed into 2."""
    m = lit(rule(3, 5, 0, 7, 2, 4))
    cells = F.transform(A.rows_of(A.transposed(F.col("x"), 4), 16), lambda c: X.matvec(m, c))
    y = vectors(spark, sf_dir).select("vec_id", A.transposed(F.flatten(cells), 16).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def rope_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector turned by its place and put into the ring: the reference's rows first, then 128 that are used in turn."""
    pf, step = F.col("vec_id") % 30 + 1, F.col("vec_id")
    y = vectors(spark, sf_dir).select("vec_id", (pf + F.pmod(step, F.lit(128))).alias("slot"), A.rope(F.col("x"), pf + step).alias("y"))
    return y.select("vec_id", "slot", *two(spark, F.col("y")))


def fixture_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest difference by layer between vectors and their 32-bit bytes read back in steps of 1/64; a twelfth is a layer."""
    back = f32_values(f32_bytes(F.col("x")))
    v = vectors(spark, sf_dir).withColumn("back", back).select((F.col("vec_id") % 12).alias("layer"), F.array_max(F.zip_with("x", "back", lambda a, b: F.abs(a - F.rint(b * 64) / 64))).alias("d"))
    return v.groupBy("layer").agg(r6(F.max("d"), "max_abs"))


def relpos_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention of 16 cells (4 x 4, 4 values each) with a bias by their distance in rows and in columns."""
    q = A.rows_of(F.col("x"), 16)
    cell = F.sequence(F.lit(0), F.lit(15))

    def bias(i, j):
        down, right = F.floor(i / 4) - F.floor(j / 4) + 3, i % 4 - j % 4 + 3
        return (down * 2 % 7 - 3) / 8.0 + (right * 3 % 7 - 3) / 8.0

    def row(rows, i):
        own = F.get(rows, i)
        p = A.softmax(F.transform(cell, lambda j: dot(own, F.get(rows, j)) / 2.0 + bias(i, j)))
        return let(p, lambda w: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: dot(w, F.transform(rows, lambda r: F.get(r, c)))))

    y = vectors(spark, sf_dir).select("vec_id", F.flatten(let(q, lambda rows: F.transform(cell, lambda i: row(rows, i)))).alias("y"))
    return y.select("vec_id", *two(spark, F.col("y")))


def _m(a: int, b: int, c: str, m: int, row: str, col: str) -> str:
    return f"((({a} * ({row}) + {b} * ({col}) + {c}) % {m} - {m // 2}) / 8.0::DOUBLE)"


def _dot(x: str, weight: str) -> str:
    """Sum of x times a weight in which ``k`` is the place from 0."""
    return f"list_sum(list_transform({x}, lambda a, i: a * {weight.replace('@', '(i - 1)')}))"


def _rows(n: int, body: str) -> str:
    return f"list_transform(range(0, {n}), lambda o: {body})"


def _two(v: str = "y") -> str:
    return f"round(list_sum({v}), 6) + 0.0::DOUBLE AS s1, round(list_sum(list_transform({v}, lambda a, i: a * i)), 6) + 0.0::DOUBLE AS s2"


def _each(v: str, extra: str = "", more: str = "") -> str:
    return f"WITH {E_}, {more} yy AS (SELECT vec_id, {extra} {v} AS y FROM e) SELECT vec_id, {extra and extra.split(' AS ')[1].split(',')[0] + ', '}{_two()} FROM yy"


def _mlp(x: str, e: str) -> str:
    """An expert's output for x, as SQL over lists."""
    gate, up = _dot(x, _m(3, 5, e, 7, "o", "@")), _dot(x, _m(5, 3, f"2 * {e}", 7, "o", "@"))
    hidden = _rows(HIDDEN, f"{gate} / (1 + exp(-({gate}))) * {up}")
    return f"list_transform([{hidden}], lambda h: {_rows(WIDTH, _dot('h', _m(1, 2, e, 5, 'o', '@')))})[1]"


LOGITS = _rows(EXPERTS, _dot("x", _m(3, 5, "0", 7, "o", "@")))
ROUTED = f"""{E_}, lg AS (SELECT vec_id, x, {LOGITS} AS g FROM e), ex AS (SELECT vec_id, x, list_transform(g, lambda a: exp(a - list_max(g))) AS q FROM lg),
    pr AS (SELECT vec_id, x, unnest(q) / list_sum(q) AS w, generate_subscripts(q, 1) - 1 AS expert FROM ex), rt AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, expert) <= {TOP}),
    ye AS (SELECT vec_id, list_transform({_mlp('x', 'expert')}, lambda a: a * w) AS y FROM rt), yv AS (SELECT vec_id, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM ye),
    ys AS (SELECT vec_id, i, sum(v) AS v FROM yv GROUP BY ALL), ym AS (SELECT vec_id, list(v ORDER BY i) AS y FROM ys GROUP BY vec_id)"""
MOE = f"WITH {ROUTED} SELECT vec_id, {_two()} FROM ym"
W = lambda c: _m(1, 3, str(c), 5, "0", "@")
FP8 = """f0 AS (SELECT vec_id, x, CASE WHEN list_max(list_transform(x, lambda a: abs(a))) = 0 THEN 1.0::DOUBLE ELSE list_max(list_transform(x, lambda a: abs(a))) END / 448 AS s FROM e), f1 AS (SELECT vec_id, s, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM f0),
    f2 AS (SELECT *, least(abs(v / s), 448.0::DOUBLE) AS a FROM f1), f3 AS (SELECT *, 2.0::DOUBLE ** (greatest(floor(log2(greatest(a, 2.0::DOUBLE ** -20))), -6) - 3) AS u FROM f2),
    f4 AS (SELECT vec_id, list(sign(v) * least(round_even(a / u, 0) * u, 448.0::DOUBLE) * s ORDER BY i) AS x FROM f3 GROUP BY vec_id)"""
Q4ROWS = """l4 AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM e), g4 AS (SELECT vec_id, i // 16 AS g, max(abs(v)) AS pk FROM l4 GROUP BY ALL),
    q4 AS (SELECT l4.vec_id, i, CASE WHEN pk = 0 THEN 1.0::DOUBLE ELSE pk END / 7 AS s, v FROM l4 JOIN g4 ON g4.vec_id = l4.vec_id AND g = i // 16), d4 AS (SELECT vec_id, list(greatest(-7, least(7, round_even(v / s, 0)::INT)) * s ORDER BY i) AS z FROM q4 GROUP BY vec_id)"""
_t = lambda rows, cols: f"list_transform(range(0, 64), lambda k: x[(k % {rows}) * {cols} + k // {rows} + 1])"
QUERIES = {f.__name__: f for f in (gate_logits, moe_forward, moe_grouped, dense_mlp, moe_block, linear_bulk, gemv_fp8, lm_head_rank, candidate_entropy, norm_residual, norm_affine, norm_channels, bias_add, add_positions, to_channels, feature_concat, merge_heads, conv1x1, rope_ring, fixture_layers, relpos_attention)}
SQL = {
    "gate_logits": _each(LOGITS),
    "moe_forward": MOE,
    "moe_grouped": MOE,
    "dense_mlp": _each(_mlp("x", str(EXPERTS))),
    "moe_block": f"WITH {ROUTED}, sh AS (SELECT vec_id, label, {_mlp('x', str(EXPERTS))} AS s FROM e), yb AS (SELECT vec_id, CASE WHEN label = 0 THEN s ELSE list_transform(s, lambda a, i: a + y[i]) END AS y FROM sh JOIN ym USING (vec_id)) SELECT vec_id, {_two()} FROM yb",
    "linear_bulk": _each(_rows(32, f"{_dot('x', _m(3, 5, '1', 7, 'o', '@'))} + {_m(1, 1, '0', 5, '0', 'o')}")),
    "gemv_fp8": f"WITH {E_}, {FP8}, yy AS (SELECT vec_id, {_rows(GATES, _dot('x', _m(5, 3, '0', 7, 'o', '@')) + ' + ' + _m(1, 1, '0', 5, '0', 'o'))} AS y FROM f4) SELECT vec_id, {_two()} FROM yy",
    "lm_head_rank": f"""WITH {E_}, {Q4ROWS}, h AS (SELECT vec_id, unnest(range(0, 16)) AS o, z FROM d4), sc AS (SELECT vec_id, o, {_dot('z', _m(7, 3, '0', 11, 'o', '@'))} AS r FROM h),
        tp AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, o) <= 4), xs AS (SELECT vec_id, o, {_dot('x', _m(7, 3, '0', 11, 'o', '@'))} AS v FROM tp JOIN e USING (vec_id))
        SELECT vec_id, o AS at, round(v, 6) + 0.0::DOUBLE AS value FROM xs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, o) = 1""",
    "candidate_entropy": f"""WITH {E_}, c AS (SELECT vec_id, list_sort(x, 'DESC')[1:8] AS c FROM e), s AS (SELECT vec_id, list_transform(c, lambda a: a - c[1]) AS s FROM c),
        q AS (SELECT vec_id, list_sum(list_transform(s, lambda a: exp(a))) AS z, list_sum(list_transform(s, lambda a: exp(a) * a)) AS zx FROM s) SELECT vec_id, round(1 / z, 6) + 0.0::DOUBLE AS p1, round(ln(z) - zx / z, 6) + 0.0::DOUBLE AS entropy FROM q""",
    "norm_residual": f"""WITH {E_}, s AS (SELECT vec_id, list_transform(x, lambda a, i: a + x[65 - i]) AS s FROM e), n AS (SELECT vec_id, s, sqrt(list_sum(list_transform(s, lambda a: a * a)) / 64 + 1e-6) AS d FROM s),
        yy AS (SELECT vec_id, s, list_transform(s, lambda a, i: a / d * {W(1).replace('@', '(i - 1)')}) AS y FROM n) SELECT vec_id, round(list_sum(s), 6) + 0.0::DOUBLE AS kept, {_two()} FROM yy""",
    "norm_affine": _each(f"list_transform(x, lambda a, i: (a - list_avg(x)) / sqrt(list_sum(list_transform(x, lambda b: (b - list_avg(x)) ** 2)) / 64 + 1e-5) * {W(2).replace('@', '(i - 1)')} + {W(3).replace('@', '(i - 1)')})"),
    "norm_channels": f"""WITH {E_}, {LONG}, c AS (SELECT vec_id, i, i // 16 AS ch, i % 16 AS cell, v FROM l), m AS (SELECT vec_id, cell, avg(v) AS m, sqrt(var_pop(v) + 1e-6) AS d FROM c GROUP BY ALL),
        yv AS (SELECT c.vec_id, i, (v - m) / d * (0.5::DOUBLE + ch * 0.5::DOUBLE) + ch * 0.25::DOUBLE AS y FROM c JOIN m ON m.vec_id = c.vec_id AND m.cell = c.cell), yy AS (SELECT vec_id, list(y ORDER BY i) AS y FROM yv GROUP BY vec_id) SELECT vec_id, {_two()} FROM yy""",
    "bias_add": _each(f"list_transform(x, lambda a, i: a + {W(4).replace('@', '(i - 1)')})"),
    "add_positions": _each(f"list_transform(x, lambda a, i: a + {W('vec_id % 49').replace('@', '(i - 1)')})"),
    "to_channels": _each(_t(16, 4)),
    "feature_concat": f"WITH {E_}, yy AS (SELECT vec_id, list_concat(x[2:64], {_t(8, 8)}) AS y FROM e) SELECT vec_id, len(y) AS n, {_two()} FROM yy",
    "merge_heads": _each("list_concat(list_concat(x[49:64], x[33:48]), list_concat(x[17:32], x[1:16]))"),
    "conv1x1": _each(f"list_transform(range(0, 32), lambda k: {' + '.join(f'x[{c * 16} + k % 16 + 1] * ' + _m(3, 5, '0', 7, 'k // 16', str(c)) for c in range(4))})"),
    "rope_ring": f"""WITH {E_}, r AS (SELECT vec_id, vec_id % 30 + 1 + vec_id % 128 AS slot, vec_id % 30 + 1 + vec_id AS p, x FROM e), yy AS (SELECT vec_id, slot, list_concat(
        list_transform(range(1, 33), lambda i: x[i] * cos(p * 10000.0::DOUBLE ** (-2.0::DOUBLE * (i - 1) / 64)) - x[i + 32] * sin(p * 10000.0::DOUBLE ** (-2.0::DOUBLE * (i - 1) / 64))),
        list_transform(range(1, 33), lambda i: x[i + 32] * cos(p * 10000.0::DOUBLE ** (-2.0::DOUBLE * (i - 1) / 64)) + x[i] * sin(p * 10000.0::DOUBLE ** (-2.0::DOUBLE * (i - 1) / 64)))) AS y FROM r) SELECT vec_id, slot, {_two()} FROM yy""",
    "fixture_layers": f"WITH {E_} SELECT vec_id % 12 AS layer, round(max(list_max(list_transform(x, lambda a: abs(a - round_even(a * 64, 0) / 64)))), 6) + 0.0::DOUBLE AS max_abs FROM e GROUP BY 1",
    "relpos_attention": f"""WITH {E_}, c AS (SELECT vec_id, unnest(range(0, 16)) AS i, x FROM e), s AS (SELECT vec_id, i, j, x, (x[i * 4 + 1] * x[j * 4 + 1] + x[i * 4 + 2] * x[j * 4 + 2] + x[i * 4 + 3] * x[j * 4 + 3] + x[i * 4 + 4] * x[j * 4 + 4]) / 2
        + (((i // 4 - j // 4 + 3) * 2) % 7 - 3) / 8.0::DOUBLE + (((i % 4 - j % 4 + 3) * 3) % 7 - 3) / 8.0::DOUBLE AS s FROM c, range(0, 16) r(j)),
        w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id, i)) AS ew FROM s), a AS (SELECT *, ew / sum(ew) OVER (PARTITION BY vec_id, i) AS a FROM w),
        o AS (SELECT vec_id, i * 4 + k AS pos, sum(a * x[j * 4 + k + 1]) AS y FROM a, range(0, 4) q(k) GROUP BY ALL), yy AS (SELECT vec_id, list(y ORDER BY pos) AS y FROM o GROUP BY vec_id) SELECT vec_id, {_two()} FROM yy""",
}
