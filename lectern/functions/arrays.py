"""Vector kernels as expressions over arrays of doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.core import dot, half_even, let, mean, total

# Smallest and largest codes of the 4-bit format, and the largest value of the 8-bit one.
INT4_MAX, FP8_MAX = 7, 448.0


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    return let(1 / F.sqrt(mean(F.transform(x, lambda v: v * v)) + eps), lambda s: F.transform(x, lambda v: v * s))


def layer_norm(x: Column, eps: float = 1e-6) -> Column:
    def scaled(m: Column) -> Column:
        return let(F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m))) + eps), lambda s: F.transform(x, lambda v: (v - m) / s))

    return let(mean(x), scaled)


def silu(v: Column) -> Column:
    return v / (1 + F.exp(-v))


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(gate, up, lambda g, u: silu(g) * u)


def quick_gelu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (1 + F.exp(v * -1.702)))


def rope(x: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotates the pairs (x[d], x[d + D/2]) by position * theta^(-2d/D)."""

    def turn(half: Column) -> Column:
        pairs = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        angles = F.transform(pairs, lambda p, d: F.struct(p["a"].alias("a"), p["b"].alias("b"), (position * F.pow(F.lit(theta), d * -2.0 / (half * 2))).alias("t")))
        return let(angles, lambda r: F.concat(F.transform(r, lambda p: p["a"] * F.cos(p["t"]) - p["b"] * F.sin(p["t"])), F.transform(r, lambda p: p["b"] * F.cos(p["t"]) + p["a"] * F.sin(p["t"]))))

    return let((F.size(x) / 2).cast("int"), turn)


def linear(x: Column, rows: list[list[float]]) -> Column:
    """x times a small constant matrix, given as one list of weights for each output."""
    return F.array(*[dot(x, F.array(*[F.lit(float(w)) for w in r])) for r in rows])


def softmax(x: Column) -> Column:
    def share(e: Column) -> Column:
        return let(total(e), lambda z: F.transform(e, lambda v: v / z))

    return let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp(v - m)), share))


def softmax_entropy(x: Column, emitted: Column) -> Column:
    """struct(p1, entropy) of logits, shifted by the emitted one; logits at -1e29 or below are banned."""
    kept = F.filter(x, lambda v: v > -1e29)

    def of(s: Column) -> Column:
        z, zx = total(F.transform(s, lambda v: F.exp(v))), total(F.transform(s, lambda v: F.exp(v) * v))
        return let(F.struct(z.alias("z"), zx.alias("zx")), lambda r: F.struct((1 / r["z"]).alias("p1"), (F.ln(r["z"]) - r["zx"] / r["z"]).alias("entropy")))

    return let(F.transform(kept, lambda v: v - emitted), of)


def split_softmax(x: Column, v: Column, parts: int) -> Column:
    """Softmax-weighted mean of v in chunks: each gives (max, sum, weighted sum), rescaled and added up at the end."""
    chunk = F.ceil(F.size(x) / F.lit(parts)).cast("int")
    pairs = F.zip_with(x, v, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def partial(c: Column) -> Column:
        return let(F.array_max(F.transform(c, lambda p: p["a"])), lambda m: F.struct(m.alias("m"), total(F.transform(c, lambda p: F.exp(p["a"] - m))).alias("l"), total(F.transform(c, lambda p: F.exp(p["a"] - m) * p["b"])).alias("acc")))

    def merge(ps: Column) -> Column:
        return let(F.array_max(F.transform(ps, lambda p: p["m"])), lambda m: total(F.transform(ps, lambda p: F.exp(p["m"] - m) * p["acc"])) / total(F.transform(ps, lambda p: F.exp(p["m"] - m) * p["l"])))

    def split(s: Column) -> Column:
        some = F.filter(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(s["p"], k * s["c"] + 1, s["c"])), lambda c: F.size(c) > 0)
        return let(F.transform(some, partial), merge)

    return let(F.struct(pairs.alias("p"), chunk.alias("c")), split)


def top_k(x: Column, k: int) -> Column:
    """array<struct<i, v>> of the k largest values, of equal ones the first, largest first."""
    ranked = F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("n"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["i"].alias("i"), (-r["n"]).alias("v")))


def argmax(x: Column) -> Column:
    return top_k(x, 1)[0]["i"]


def quant_int4(x: Column, group: int) -> Column:
    """array<struct<scale, codes>>: each group's largest magnitude is 7; an all-zero group has scale 1/7."""
    groups = F.transform(F.sequence(F.lit(0), (F.size(x) / group).cast("int") - 1), lambda g: F.slice(x, g * group + 1, group))

    def code(g: Column) -> Column:
        peak = F.array_max(F.transform(g, lambda v: F.abs(v)))
        return let(F.when(peak == 0, 1.0).otherwise(peak) / INT4_MAX, lambda s: F.struct(s.alias("scale"), F.transform(g, lambda v: F.greatest(F.lit(-INT4_MAX), F.least(F.lit(INT4_MAX), half_even(v / s).cast("int")))).alias("codes")))

    return F.transform(groups, code)


def fp8_scale(x: Column) -> Column:
    peak = F.array_max(F.transform(x, lambda v: F.abs(v)))
    return F.when(peak == 0, 1.0).otherwise(peak) / FP8_MAX


def nibble(byte: Column, high: bool) -> Column:
    """The low or high four bits of a byte as a two's-complement number."""
    n = (F.shiftright(byte, 4) if high else byte).bitwiseAND(15)
    return n - 16 * (n >= 8).cast("int")


def fp8_values() -> np.ndarray:
    """The value of each of the 256 codes of the e4m3 format, built from its rule; the two all-ones codes are NaN."""
    code = np.arange(256)
    sign, exponent, fraction = np.where(code & 128, -1.0, 1.0), code >> 3 & 15, code & 7
    out = sign * np.where(exponent == 0, fraction / 8 * 2.0**-6, (1 + fraction / 8) * 2.0 ** (exponent - 7.0))
    return np.where((code & 127) == 127, np.nan, out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def fp8_codes(x: pd.Series) -> pd.Series:
    """The nearest e4m3 code of each value divided by the row's scale, of two equally near ones the even; saturating."""
    values = fp8_values()[:127]

    def row(v: np.ndarray) -> list[int]:
        v = np.asarray(v, dtype=np.float64)
        peak = np.abs(v).max() if len(v) else 0.0
        y = np.minimum(np.abs(v / ((peak or 1.0) / FP8_MAX)), FP8_MAX)
        up = np.clip(np.searchsorted(values, y), 1, 126)
        low, high = values[up - 1], values[up]
        pick = np.where((y - low < high - y) | ((y - low == high - y) & (up % 2 == 1)), up - 1, up)
        return (pick + 128 * (v < 0)).tolist()

    return x.map(row)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gelu(x: pd.Series) -> pd.Series:
    """0.5 x (1 + erf(x / sqrt 2)), whole batches at once."""
    sizes = x.map(len)
    flat = np.concatenate([np.asarray(v, dtype=np.float64) for v in x]) if len(x) else np.zeros(0)
    # Abramowitz and Stegun 7.1.26, error below 1.5e-7.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = np.abs(flat) / np.sqrt(2)
    t = 1 / (1 + p * z)
    erf = np.sign(flat) * (1 - t * np.polyval(a[::-1], t) * np.exp(-z * z))
    return pd.Series([v.tolist() for v in np.split(0.5 * flat * (1 + erf), np.cumsum(sizes)[:-1])] if len(x) else [], dtype=object)


def scaled(x: Column, weight: Column, bias: Column | None = None) -> Column:
    """x times a weight for each place, plus a bias for each."""
    y = F.zip_with(x, weight, lambda a, w: a * w)
    return y if bias is None else add(y, bias)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def add_rms_norm(x: Column, y: Column, weight: Column, eps: float = 1e-6) -> Column:
    """struct(sum, normed): the residual sum, and its root-mean-square norm times the weights."""
    return let(add(x, y), lambda s: F.struct(s.alias("sum"), scaled(rms_norm(s, eps), weight).alias("normed")))


def channel_norm(x: Column, channels: int, weight: Column, bias: Column, eps: float = 1e-6) -> Column:
    """Layer norm over the channels of each cell; x holds the channels one after another."""

    def of(rows: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(1), F.size(rows[0])), lambda k: scaled(layer_norm(F.transform(rows, lambda r: F.element_at(r, k)), eps), weight, bias))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(channels)), lambda c: F.transform(cells, lambda v: F.element_at(v, c))))

    return let(rows_of(x, channels), of)


def rows_of(x: Column, n: int) -> Column:
    """x as n rows of equal length."""
    return let((F.size(x) / n).cast("int"), lambda w: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(x, k * w + 1, w)))


def transposed(x: Column, n: int) -> Column:
    """A matrix of n rows, given row by row, column by column."""
    return let(rows_of(x, n), lambda rows: F.flatten(F.transform(F.sequence(F.lit(1), F.size(rows[0])), lambda k: F.transform(rows, lambda r: F.element_at(r, k)))))


def dequant_int4(groups: Column) -> Column:
    """The values that groups of (scale, codes) stand for."""
    return F.flatten(F.transform(groups, lambda g: F.transform(g["codes"], lambda c: c * g["scale"])))


def fp8_round(x: Column) -> Column:
    """Each value as the nearest e4m3 number times the row's scale: three bits behind the leading one, halves to even."""

    def value(v: Column, s: Column) -> Column:
        y = F.least(F.abs(v / s), F.lit(FP8_MAX))
        unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(y, F.lit(2.0**-20)))), F.lit(-6)).cast("double") - 3)
        return F.signum(v) * F.least(F.rint(y / unit) * unit, F.lit(FP8_MAX)) * s

    return let(fp8_scale(x), lambda s: F.transform(x, lambda v: value(v, s)))
