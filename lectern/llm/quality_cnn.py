"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import binary_text, fields, let_go, slices
from lectern.llm.language_id import SHARES, adam, sample_windows, share_of

#: A chunk has CELLS cells of CELL positions; the next one starts STRIDE cells later and shares the rest.
CELL, CELLS, STRIDE = 64, 8, 6
CHUNK = CELL * CELLS
#: Bytes that a filter sees (an even number), and filters.
WIDTH, FILTERS = 6, 24
#: Training sample: about so many documents of each label, so many evenly spaced chunks of each at the most.
DOCS_PER_LABEL, CHUNKS_PER_DOC = 1500, 8
STEPS, BATCH, RATE = 1000, 64, 0.02
#: Bytes convolved together.
BLOCK = 1 << 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Filters as a table (WIDTH, 256, FILTERS) of each byte's share at each place, their bias, and two linear layers.

    ``head`` weighs a chunk's pooled filters and ends in a bias; ``joint`` weighs the mean, smallest and largest chunk
    score of a text and ends in a bias.
    """

    table: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    joint: np.ndarray
    pairs: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.append(r.normal(0, 0.3, FILTERS), 0).astype(np.float32), np.array([1, 0, 0, 0], np.float32))

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Each filter's response at each position at which it has all its bytes, before the bias.

        Neighbouring bytes are looked up together: half as many additions as bytes.
        """
        if self.pairs is None:
            self.pairs = (self.table[0::2, :, None] + self.table[1::2, None]).reshape(WIDTH // 2, 65536, FILTERS)
        code = data[:-1].astype(np.intp) << 8 | data[1:]
        n = len(data) - WIDTH + 1
        out = np.take(self.pairs[0], code[:n], axis=0)
        for j in range(1, WIDTH // 2):
            out += np.take(self.pairs[j], code[2 * j : 2 * j + n], axis=0)
        return out

    def cells(self, data: bytes) -> np.ndarray:
        """The largest response of each filter within each cell of a text; zero bytes fill the last cell up."""
        n = max(1, -(-len(data) // CELL))
        padded = np.frombuffer(data.ljust(n * CELL, b"\0") + b"\0" * (WIDTH - 1), dtype=np.uint8)
        parts = [self.responses(padded[at : min(at + BLOCK, n * CELL) + WIDTH - 1]).reshape(-1, CELL, FILTERS).max(axis=1) for at in range(0, n * CELL, BLOCK)]
        return np.concatenate(parts)

    def chunk_scores(self, cells: np.ndarray) -> np.ndarray:
        """A score for each chunk of a text: rectified maxima over its cells, weighed."""
        starts = np.arange(0, max(1, len(cells) - (CELLS - STRIDE)), STRIDE)
        ends = np.minimum(starts + CELLS, len(cells))
        bounds = np.stack([starts, ends], axis=1).ravel()
        grown = np.concatenate([cells, cells[-1:]])
        pooled = np.maximum.reduceat(grown, bounds, axis=0)[::2]
        return np.maximum(pooled + self.bias, 0) @ self.head[:-1] + self.head[-1]

    def combine(self, scores: np.ndarray) -> np.ndarray:
        return np.array([scores.mean(), scores.min(), scores.max(), 1.0])

    def probability(self, text: bytes) -> float:
        return float(sigmoid(self.combine(self.chunk_scores(self.cells(text))) @ self.joint))

    def gradients(self, chunks: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of single chunks and its gradients; a filter learns where its response was largest."""
        b = len(chunks)
        codes = np.lib.stride_tricks.sliding_window_view(np.pad(chunks, ((0, 0), (0, WIDTH - 1))), CHUNK, axis=1).astype(np.intp)
        all_responses = sum(self.table[j][codes[:, j]] for j in range(WIDTH))
        best = all_responses.argmax(axis=1)
        pooled = np.take_along_axis(all_responses, best[:, None], axis=1)[:, 0] + self.bias
        active = np.maximum(pooled, 0)
        p = sigmoid(active @ self.head[:-1] + self.head[-1])
        err = ((p - target) / b).astype(np.float32)
        g_head = np.append(active.T @ err, err.sum())
        back = err[:, None] * self.head[:-1] * (pooled > 0)
        g_table = np.zeros_like(self.table)
        rows = np.arange(b)[:, None]
        for j in range(WIDTH):
            np.add.at(g_table[j], (codes[rows, j, best], np.arange(FILTERS)[None, :]), back)
        loss = -float(np.log(np.where(target > 0, p, 1 - p).clip(1e-9)).mean())
        return loss, [g_table, back.sum(axis=0), g_head]


def train(chunks: np.ndarray, target: np.ndarray, owner: np.ndarray, steps: int = STEPS, seed: int = 0) -> Network:
    """Fits filters and head to chunks, then the joint layer to the chunk scores of each owner (a document)."""
    net = Network.fresh(seed)
    r = np.random.default_rng(seed)
    own = [np.flatnonzero(target == k) for k in (0, 1)]
    if not all(map(len, own)):  # one label only: the bias alone carries it
        net.joint = np.array([0, 0, 0, 2.0 if len(own[1]) else -2.0], np.float32)
        return net
    apply = adam([net.table, net.bias, net.head], RATE)
    for step in range(steps):
        rows = np.concatenate([r.choice(o, BATCH // 2) for o in own])
        apply(net.gradients(chunks[rows], target[rows].astype(np.float32))[1], 1 - step / steps)
    net.pairs = None
    scores = np.concatenate([net.chunk_scores(net.cells(c.tobytes())) for c in chunks])
    scores = scores.reshape(len(chunks), -1).mean(axis=1)
    bounds = np.flatnonzero(np.diff(owner, prepend=-1))
    x = np.stack([np.add.reduceat(scores, bounds) / np.diff([*bounds, len(owner)]), np.minimum.reduceat(scores, bounds), np.maximum.reduceat(scores, bounds), np.ones(len(bounds))], axis=1)
    y = target[bounds]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = net.joint.astype(np.float64)
    for _ in range(50):  # Newton's steps on the weighted logistic loss, with a little decay
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + 1e-4 * w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(4), grad).clip(-1, 1)
    net.joint = w.astype(np.float32)
    net.pairs = None
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str) -> Network | None:
    """Trains on a sample bounded by DOCS_PER_LABEL and CHUNKS_PER_DOC; None if there is no labelled text."""
    known = labels.select(F.col(label_id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return None
    cut = [min(SHARES, -(-SHARES * DOCS_PER_LABEL // counts[y])) if y in counts else 0 for y in (0, 1)]
    sample = known.where(share_of(F.col("i")) < F.when(F.col("y") == 0, cut[0]).otherwise(cut[1])).limit(4 * DOCS_PER_LABEL)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # the sample's size is bounded above: a fixed bound for a broadcast
    rows = texts.join(F.broadcast(sample), "i").select(F.col("y").cast("string").alias("label"), "text")
    chunks, label, owner = sample_windows(rows, CHUNKS_PER_DOC, CHUNK, 4 * DOCS_PER_LABEL)
    return train(chunks, np.array(label).astype(int), np.array(owner)) if label else None


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the probability of label 1, from the whole text.

    A null text is scored as an empty one; without a network every score is 0.5. Repeated rows give a row each; other
    columns are not read. Texts are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            p = [0.5 if net is None else net.probability(t.as_py() or b"") for t in binary_text(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, fields(("id", T.LongType()), ("score", T.DoubleType())))


def keep_good(docs: DataFrame, net: Network | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``; nothing is shuffled.

    A null text is scored as an empty one; repeated rows stay or go together; without a network all rows stay.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in slices(batches):
            yield b.filter(pa.array([net is None or net.probability(t.as_py() or b"") >= threshold for t in binary_text(b, at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
