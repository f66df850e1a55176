"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import FEW, binary_text, fields, let_go, setting

#: Bytes that the network reads in one go; a text is cut into windows of this length, the last one padded with zeros.
WINDOW = 128
HIDDEN = 8
#: Training sample: about so many documents of each language, so many evenly spaced windows of each at the most.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 300, 16
STEPS, BATCH, RATE = 300, 128, 0.02
#: Windows scored together.
BLOCK = 2048
SHARES = 1 << 20


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): the network's squashing function, whose slope is (1 - |y|)^2."""
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """Per direction: input table (256, 3H) for each byte, recurrent weights (H, 3H) and bias; then one output layer.

    Gates in the order keep, reset, candidate; the new state is keep * old + (1 - keep) * candidate.
    """

    table: np.ndarray
    recur: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    labels: list[str]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        return cls(f(2, 256, 3 * hidden, scale=0.5), f(2, hidden, 3 * hidden, scale=0.3), np.zeros((2, 1, 3 * hidden), np.float32), f(2 * hidden, len(labels), scale=0.3), np.zeros(len(labels), np.float32), labels)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.bias, self.out, self.out_bias]

    def states(self, windows: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Both directions' states after each byte: (2, length, batch, hidden), the second in reading order backwards."""
        b, n = windows.shape
        h = self.recur.shape[1]
        codes = np.ascontiguousarray(np.stack([windows, windows[:, ::-1]]).transpose(0, 2, 1)).astype(np.intp)
        old = np.zeros((2, b, h), np.float32)
        out = np.empty((2, n, b, h), np.float32)
        given = np.empty((2, b, 3 * h), np.float32)
        for t in range(n):
            for d in (0, 1):
                np.take(self.table[d], codes[d, t], axis=0, out=given[d])
            back = np.matmul(old, self.recur)
            back += self.bias
            gates = given[..., : 2 * h] + back[..., : 2 * h]
            gates /= 1 + np.abs(gates)
            gates *= 0.5
            gates += 0.5
            keep, reset = gates[..., :h], gates[..., h:]
            new = reset * back[..., 2 * h :]
            new += given[..., 2 * h :]
            new /= 1 + np.abs(new)
            now = old - new
            now *= keep
            now += new
            if trace is not None:
                trace.append((codes[:, t], old, keep, reset, new, back[..., 2 * h :]))
            out[:, t] = old = now
        return out

    def positions(self, states: np.ndarray) -> np.ndarray:
        """Label probabilities of every position: (length, batch, labels)."""
        h = states.shape[-1]
        logits = states[0] @ self.out[:h] + states[1, ::-1] @ self.out[h:] + self.out_bias
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        trace: list = []
        states = self.states(windows, trace)
        p = self.positions(states)
        n, b, _ = p.shape
        h = states.shape[-1]
        loss = -float(np.log(np.maximum(p[:, np.arange(b), target], 1e-9)).mean())
        err = p
        err[:, np.arange(b), target] -= 1
        err /= n * b
        flat = err.reshape(n * b, -1)
        g_out = np.concatenate([states[0].reshape(n * b, h).T @ flat, states[1, ::-1].reshape(n * b, h).T @ flat])
        into = np.stack([err @ self.out[:h].T, (err @ self.out[h:].T)[::-1]])
        g_table, g_recur, g_bias = np.zeros_like(self.table), np.zeros_like(self.recur), np.zeros_like(self.bias)
        later = np.zeros((2, b, h), np.float32)
        given = np.empty((n, 2, b, 3 * h), np.float32)
        for t in range(n - 1, -1, -1):
            _, old, keep, reset, new, back = trace[t]
            d = into[:, t] + later
            d_new = d * (1 - keep) * (1 - np.abs(new)) ** 2
            d_keep = d * (old - new) * 0.5 * (1 - np.abs(2 * keep - 1)) ** 2
            d_reset = d_new * back * 0.5 * (1 - np.abs(2 * reset - 1)) ** 2
            d_back = np.concatenate([d_keep, d_reset, d_new * reset], axis=-1)
            given[t] = np.concatenate([d_keep, d_reset, d_new], axis=-1)
            g_recur += np.matmul(old.transpose(0, 2, 1), d_back)
            g_bias += d_back.sum(axis=1, keepdims=True)
            later = d * keep + np.matmul(d_back, self.recur.transpose(0, 2, 1))
        codes = np.stack([c for c, *_ in trace])
        for d in (0, 1):
            np.add.at(g_table[d], codes[:, d].ravel(), given[:, d].reshape(n * b, -1))
        return loss, [g_table, g_recur, g_bias, g_out.astype(np.float32), flat.sum(axis=0)]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean of its positions' probabilities; an empty text gets an even share of each."""
        cut, owner, sizes = [], [], []
        for k, t in enumerate(texts):
            n = -(-len(t) // WINDOW)
            cut.append(t.ljust(n * WINDOW, b"\0"))
            owner += [k] * n
            sizes += [WINDOW] * (n - 1) + [len(t) - (n - 1) * WINDOW] * (n > 0)
        windows = np.frombuffer(b"".join(cut), dtype=np.uint8).reshape(-1, WINDOW)
        total = np.zeros((len(texts), len(self.labels)))
        for at in range(0, len(windows), BLOCK):
            p = self.positions(self.states(windows[at : at + BLOCK]))
            size = np.array(sizes[at : at + BLOCK])
            if (size < WINDOW).any():
                p *= (np.arange(WINDOW)[:, None] < size)[..., None]
            np.add.at(total, owner[at : at + BLOCK], p.sum(axis=0))
        lengths = np.array([len(t) for t in texts])[:, None]
        return np.where(lengths > 0, total / np.maximum(lengths, 1), 1 / len(self.labels))


def adam(weights: list[np.ndarray], rate: float):
    """Returns a function that applies gradients in place; the rate is given with each step."""
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0

    def apply(gradients: list[np.ndarray], share: float = 1.0) -> None:
        nonlocal step
        step += 1
        for w, g, m, v in zip(weights, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (rate * share * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    return apply


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], steps: int = STEPS, seed: int = 0) -> Network:
    """Fits a network to labelled windows; batches hold each label equally often, the rate falls to nothing."""
    net = Network.fresh(labels, seed=seed)
    r = np.random.default_rng(seed)
    own = [np.flatnonzero(target == k) for k in range(len(labels))]
    apply = adam(net.weights(), RATE)
    each = max(1, BATCH // len(labels))
    for step in range(steps):
        rows = np.concatenate([r.choice(o, each) for o in own])
        apply(net.gradients(windows[rows], target[rows])[1], 1 - step / steps)
    return net


def spaced_windows(text: bytes, most: int, size: int) -> list[bytes]:
    """At most ``most`` windows of ``size`` bytes, evenly spaced over the whole text; the last padded."""
    n = max(1, -(-len(text) // size))
    picks = range(n) if n <= most else [i * (n - 1) // (most - 1) for i in range(most)]
    return [text[i * size : (i + 1) * size].ljust(size, b"\0") for i in picks]


def sample_windows(rows: DataFrame, most: int, size: int, texts: int) -> tuple[np.ndarray, list, list[int]]:
    """Spaced windows of at most ``texts`` rows (label, text), collected; returns windows, each one's label, and its row.

    Windows are cut where the texts are; only these are gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            cut = [spaced_windows(t.as_py() or b"", most, size) for t in binary_text(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([b"".join(c) for c in cut], pa.binary())], names=["label", "cut"])

    with setting(rows.sparkSession, FEW):
        found = rows.mapInArrow(run, fields(("label", T.StringType()), ("cut", T.BinaryType()))).limit(texts).collect()
    found.sort(key=lambda x: (x["label"], bytes(x["cut"])))
    sizes = [len(x["cut"]) // size for x in found]
    windows = np.frombuffer(b"".join(bytes(x["cut"]) for x in found), dtype=np.uint8).reshape(-1, size)
    return windows, [x["label"] for x, n in zip(found, sizes) for _ in range(n)], [i for i, n in enumerate(sizes) for _ in range(n)]


def share_of(id_col: Column) -> Column:
    """A row's place in a fixed pseudo-random order of ids, from 0 to SHARES."""
    return F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(SHARES))


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> Network | None:
    """Trains on a sample bounded by DOCS_PER_LANGUAGE and WINDOWS_PER_DOC; None if no row has a label."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).where("label is not null and text is not null")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(SHARES, -(-SHARES * DOCS_PER_LANGUAGE // n))))])
    sample = rows.where(share_of(F.col("i")) < F.element_at(share, F.col("label")))
    windows, label, _ = sample_windows(sample.select("label", "text"), WINDOWS_PER_DOC, WINDOW, 2 * DOCS_PER_LANGUAGE * len(counts))
    labels = sorted(set(label))
    return train(windows, np.array([labels.index(x) for x in label]), labels)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: the label with the largest pooled probability over the whole text.

    A text that is null or has no letter gets ``und`` and score 0, as does every text if there is no network. Ties go
    to the label that sorts first. Repeated rows give a row each; other columns are not read. Texts are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                texts = b.column(1).to_pylist()
                real = [k for k, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
                label, score = ["und"] * len(texts), [0.0] * len(texts)
                if real:
                    for k, p in zip(real, net.pooled([texts[k].encode() for k in real])):
                        label[k], score[k] = net.labels[int(p.argmax())], float(p.max())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, fields(("id", T.LongType()), ("lang_pred", T.StringType()), ("score", T.DoubleType())))
