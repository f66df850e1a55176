"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.core import unused
from lectern.llm.common import FEW, let_go, settle, slices

# The base kinds in their order, and the kind of spans that the tests add.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 32 or more is what ``[0-9a-f]+`` matches and the length keeps.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: A run of an encoding's symbols that is long enough to test, with its padding.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# Alphabets in the order in which an encoding is inferred; a token takes the first that holds all of it.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
ENCODINGS = tuple(ALPHABETS)
VALUES = np.full((len(ENCODINGS), 256), -1, dtype=np.int64)
for _i, _a in enumerate(ALPHABETS.values()):
    VALUES[_i, list(_a.encode())] = np.arange(len(_a))
SIZES = np.array([len(a) for a in ALPHABETS.values()])
#: Shortest length of each class; tokens are compared with ordinary text of their own class.
CLASSES = (16, 20, 28, 40, 64)
#: Scores are counted in so many equal bins.
BINS = 256
#: Letters whose windows are scored at once; bounds the memory of a very long text.
LETTERS = 1 << 17
#: Words with digits are left out of ordinary text: secrets are among them.
HAS_DIGIT, WITH_DIGIT = re.compile(r"[0-9]"), re.compile(r"\S*[0-9]\S*")
NOT_LETTERS = bytes(i for i in range(256) if not chr(i).isascii() or not chr(i).isalpha())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of x >= 0, to 1.2e-7 (a rational Chebyshev fit)."""
    t = 1 / (1 + 0.5 * x)
    # The fit's coefficients from the constant term upwards.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    return t * np.exp(-x * x + np.polyval(c[::-1], t))


def _two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / np.sqrt(2))


def randomness(values: np.ndarray, alphabet: int) -> np.ndarray:
    """For each row of symbol values: the combined p-value of three tests of randomness (large: looks random).

    Uniformity: chi-squared over as many equal cells as leave two symbols a cell on average. Runs: Wald and
    Wolfowitz's count above and below the middle of the alphabet. Serial correlation at lag one. Combined by Fisher.
    """
    m, n = values.shape
    cells = 1 << max(1, min(alphabet.bit_length() - 1, int(np.log2(max(2, n / 2)))))
    cell = values * cells // alphabet
    counts = np.bincount((np.arange(m)[:, None] * cells + cell).ravel(), minlength=m * cells).reshape(m, cells)
    chi = ((counts - n / cells) ** 2).sum(axis=1) * cells / n
    d = cells - 1
    z = ((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / np.sqrt(2 / (9 * d))  # Wilson and Hilferty
    p1 = np.where(z > 0, 0.5 * _erfc(np.abs(z) / np.sqrt(2)), 1 - 0.5 * _erfc(np.abs(z) / np.sqrt(2)))
    high = values * 2 >= alphabet
    up = high.sum(axis=1)
    down = n - up
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * up * down / n
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    p2 = np.where(np.minimum(up, down) > 0, _two_sided((runs - mean) / np.sqrt(var)), 0.0)
    x = values - values.mean(axis=1, keepdims=True)
    power = (x * x).sum(axis=1)
    r = (x[:, 1:] * x[:, :-1]).sum(axis=1) / np.maximum(power, 1e-9)
    p3 = np.where(power > 0, _two_sided((r + 1 / n) * np.sqrt(n)), 0.0)
    half = -np.log(np.clip(np.stack([p1, p2, p3]), 1e-30, 1)).sum(axis=0)  # half of Fisher's statistic, 6 degrees
    return np.exp(-half) * (1 + half + half * half / 2)


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def encoding(token: bytes) -> int:
    """Index of the first alphabet that holds the token; -1 for none, or for digits alone."""
    codes = np.frombuffer(token, dtype=np.uint8)
    if token.isdigit():
        return -1
    return next((i for i in range(len(ENCODINGS)) if (VALUES[i, codes] >= 0).all()), -1)


def code(enc: int, cls: int, score: np.ndarray) -> np.ndarray:
    """Encoding, length class and score bin as one integer."""
    return (enc * len(CLASSES) + cls) * BINS + np.minimum((score * BINS).astype(np.int64), BINS - 1)


def candidates(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text (start, end, code) of every token that can be tested; those of equal shape are tested together."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    shapes: dict[tuple[int, int], list[tuple[int, int, int, bytes]]] = {}
    for k, text in enumerate(texts):
        for m in CANDIDATE.finditer(text):
            token = m[0].rstrip("=").encode()
            if (enc := encoding(token)) >= 0:
                shapes.setdefault((enc, len(token)), []).append((k, m.start(), m.end(), token))
    for (enc, n), found in shapes.items():
        values = VALUES[enc][np.frombuffer(b"".join(f[3] for f in found), dtype=np.uint8)].reshape(len(found), n)
        for (k, start, end, _), c in zip(found, code(enc, length_class(n), randomness(values, int(SIZES[enc])))):
            out[k].append((start, end, int(c)))
    return [sorted(x) for x in out]


def ordinary(texts: list[str]) -> np.ndarray:
    """How many windows of the texts' letters have each code: what ordinary text scores in each class and encoding.

    For each class all consecutive windows of its shortest length, from a text's first letter to the last that fills
    one. The letters' places in the alphabet are spread over the encoding's symbols as the encoding itself would
    (base64 keeps them as they are, shorter alphabets take them modulo their size), so encodings of one size share
    their scores.
    """
    size = len(ENCODINGS) * len(CLASSES) * BINS
    counts = np.zeros(size, dtype=np.int64)
    letters = [np.frombuffer((WITH_DIGIT.sub("", t) if HAS_DIGIT.search(t) else t).encode().translate(None, NOT_LETTERS), dtype=np.uint8) for t in texts]
    for cls, n in enumerate(CLASSES):
        raw = np.concatenate([np.zeros(0, np.uint8), *[x[: len(x) // n * n] for x in letters]]).reshape(-1, n)
        for at in range(0, len(raw), LETTERS // n):
            part, scores = raw[at : at + LETTERS // n], {}
            for enc, name in enumerate(ENCODINGS):
                k = int(SIZES[enc])
                if k not in scores:
                    scores[k] = randomness(VALUES[enc][part] if name.startswith("base64") else (part & 31).astype(np.int64) % k, k)
                counts += np.bincount(code(enc, cls, scores[k]), minlength=size)
    return counts


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))
TESTED = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("code", T.IntegerType())]))
WINDOWS = T.ArrayType(T.StructType([T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType())]))
#: Texts that are scanned together.
TOGETHER = 256


def scan(docs: DataFrame, text_col: str, base: str = "base", tested: str = "tested", ordinary_col: str = "ordinary") -> DataFrame:
    """``docs`` with three more columns: base spans, tested tokens, and counts of windows; one pass over the whole texts.

    The windows of texts that are scanned together are counted by code on the first of their rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*docs.schema.fields, T.StructField(base, SPAN), T.StructField(tested, TESTED), T.StructField(ordinary_col, WINDOWS)])
    kinds, at, names = [f.type for f in to_arrow_schema(out)][-3:], docs.columns.index(text_col), out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in slices(batches, TOGETHER):
            texts = [t or "" for t in b.column(at).to_pylist()]
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in base_spans(t)] for t in texts]
            tokens = [[{"start": s, "end": e, "code": c} for s, e, c in row] for row in candidates(texts)]
            n = ordinary(texts)
            windows = [[{"code": int(c), "n": int(n[c])} for c in np.flatnonzero(n)], *[[]] * (len(texts) - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v, t) for v, t in zip((spans, tokens, windows), kinds)]], names=names)

    return docs.mapInArrow(run, out)


def cuts(scanned: DataFrame, rate: float = 0.01, tested: str = "tested", ordinary_col: str = "ordinary") -> dict[int, int]:
    """For each encoding and length class the lowest score bin that is flagged; classes that flag nothing are absent.

    A token's p-value is the share of ordinary windows of its class and encoding that score as high (one added to
    both counts); Benjamini and Hochberg's rule at ``rate`` over all tokens of all classes sets the largest p-value that
    is flagged. A class with w windows gives no p-value below 1 / (w + 1): in a table with fewer windows than tokens
    tested for each one flagged, times 1 / rate, nothing is flagged. Only the counts by bin reach the driver: at most
    encodings x classes x bins x 2 of them.
    """
    size = len(ENCODINGS) * len(CLASSES) * BINS
    counts = np.zeros((2, size), dtype=np.int64)
    windows = scanned.select(F.explode(ordinary_col).alias("w")).select(F.col("w.code").alias("c"), F.col("w.n").alias("n"))
    tokens = scanned.select(F.explode(F.col(tested)["code"]).alias("c"), F.lit(1).alias("n"))
    for side, rows in ((0, windows), (1, tokens)):
        for r in rows.groupBy("c").agg(F.sum("n").alias("n")).collect():
            counts[side, r["c"]] = r["n"]
    return discoveries(*counts.reshape(2, -1, BINS), rate)


def discoveries(null: np.ndarray, seen: np.ndarray, rate: float) -> dict[int, int]:
    """The flagged bins by class, from (class, bin) counts of ordinary windows and of tokens."""
    above = lambda n: n[:, ::-1].cumsum(axis=1)[:, ::-1]
    p = (1 + above(null)) / (1 + null.sum(axis=1, keepdims=True))
    order = np.argsort(p, axis=None, kind="stable")
    ranked, upto = p.ravel()[order], seen.ravel()[order].cumsum()
    # equal p-values are taken together
    last = np.append(ranked[1:] != ranked[:-1], True)
    good = np.flatnonzero(last & (upto > 0) & (ranked <= rate * upto / max(1, seen.sum())))
    if not len(good):
        return {}
    most = ranked[good[-1]]
    return {g: int(np.flatnonzero(p[g] <= most)[0]) for g in range(len(p)) if p[g, -1] <= most and seen[g].sum()}


def flagged(tested, cut: dict[int, int], base):
    """Of an array of tested tokens those at or over their cut that touch no base span, as spans."""
    if not cut:
        return F.filter(base, lambda b: F.lit(False))
    table = F.array(*[F.lit(cut.get(g, BINS)) for g in range(len(ENCODINGS) * len(CLASSES))])
    new = F.filter(tested, lambda t: (t["code"] % BINS >= F.get(table, F.floor(t["code"] / BINS).cast("int"))) & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return F.transform(new, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """One row (id, base, spans) for every row of ``docs``.

    base: spans of the fixed patterns; spans: these and the tokens that pass the randomness battery, each an array of
    (start, kind, end) sorted, in code points, end exclusive, kind an index into KINDS. A null text counts as empty
    and has no spans; repeated rows and ids give a row each; an empty table gives an empty result. Other columns are
    not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = settle(scan(narrow, "text").drop("text"), "secrets")
    new = flagged(F.col("tested"), cuts(scanned, rate), F.col("base"))
    return scanned.select("id", "base", F.sort_array(F.concat("base", new)).alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", rate: float = 0.01) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``; other columns and all rows stay, whatever their names.

    Overlapping spans are replaced as one. The rows are written with what the one scan found beside their texts, so
    these are neither scanned again nor shuffled. A null text stays null, and so does a null ``length_col``'s row if its
    text has no secret; ``length_col``, if there, is set to the new text's length. Repeated rows and ids do not matter.
    """
    base, tested, windows = unused(docs, "base", "tested", "ordinary")
    scanned = settle(scan(docs, text_col, base, tested, windows), "secrets", FEW)
    spans = F.sort_array(F.concat(F.col(base), flagged(F.col(tested), cuts(scanned, rate, tested, windows), F.col(base))))
    text = F.col(text_col)
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        more = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.transform(F.array(spans), lambda s: F.when(F.size(s) == 0, text).otherwise(F.aggregate(s, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))))[0]
    out = scanned.withColumn(text_col, clean).drop(base, tested, windows)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def spans_string(spans, kinds: tuple[str, ...] = KINDS):
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
