"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over the UTF-8 bytes of the whole document. Their responses are
max-pooled over overlapping chunks; the chunk values are combined over the document
by their mean, maximum and minimum, and one logistic unit makes a probability of them.
The convolution is computed once: chunks are pairs of neighbouring segments, so the
overlap costs nothing. Memory is bounded by the batch and a block of windows, for a
document of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import fresh, labelled_sample, python_tasks, remainder_is, spread_bytes, utf8

WIDTH, STEP, SEGMENT = 6, 2, 128  # bytes of a window, between windows; windows in a segment (half a chunk)
DEPTH, FILTERS = 6, 24
BLOCK = 256  # segments convolved at a time

#: Labelled documents of each class, and bytes of each, that the network is fitted on at most.
FIT_ROWS, FIT_BYTES = 1500, 65_536
THRESHOLD = 0.7


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    def scores(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        layout = _Layout(raw, ends)
        pooled, _ = layout.pool(self.weights)
        z = layout.combine(pooled)[0] @ self.weights["head"] + self.weights["bias"]
        return 1.0 / (1.0 + np.exp(-np.clip(z.astype(float), -40, 40)))


class _Layout:
    """Documents laid end to end, each filled up with zero bytes to whole segments."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        span = SEGMENT * STEP
        sizes = np.diff(ends)
        self.segments = np.maximum((sizes + WIDTH + span - 1) // span, 1)
        self.first = np.concatenate([[0], np.cumsum(self.segments)])
        self.data = np.zeros(int(self.first[-1]) * span + WIDTH, np.uint8)
        self.windows = (sizes + STEP - 1) // STEP  # windows that begin inside the document
        for i, start in enumerate(self.first[:-1].tolist()):
            self.data[start * span:start * span + sizes[i]] = raw[ends[i]:ends[i + 1]]
        self.document = np.repeat(np.arange(len(sizes)), self.segments)

    def _inside(self, lo: int, hi: int) -> np.ndarray:
        """Which windows of the segments begin inside their document."""
        doc = self.document[lo:hi]
        local = (np.arange(lo, hi) - self.first[doc]) * SEGMENT
        return (local[:, None] + np.arange(SEGMENT)) < self.windows[doc][:, None]

    def pool(self, w: dict, keep: bool = False):
        """The largest response of each filter in each segment, and where it is (if to be kept)."""
        n = int(self.first[-1])
        pooled = np.zeros((n, FILTERS), np.float32)
        where = np.zeros((n, FILTERS), np.int32) if keep else None
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            part = self.data[lo * SEGMENT * STEP:hi * SEGMENT * STEP + WIDTH]
            x = w["bytes"][part]
            count = (hi - lo) * SEGMENT
            windows = as_strided(x, (count, WIDTH * DEPTH), (STEP * x.strides[0], x.strides[1]))
            response = np.maximum(windows @ w["filters"] + w["offsets"], 0)
            response = response.reshape(hi - lo, SEGMENT, FILTERS) * self._inside(lo, hi)[:, :, None]
            pooled[lo:hi] = response.max(axis=1)
            if keep:
                where[lo:hi] = response.argmax(axis=1)
        return pooled, where

    def combine(self, pooled: np.ndarray):
        """Per document the mean, maximum and minimum over its chunks, and what the gradient needs."""
        docs = len(self.segments)
        follows = np.zeros(len(pooled), bool)
        follows[:-1] = self.document[1:] == self.document[:-1]
        after = np.where(follows[:, None], np.roll(pooled, -1, axis=0), 0)
        second = after > pooled
        chunk = np.where(second, after, pooled)
        # The last segment of a document starts no chunk unless it is the only one.
        starts = follows | (self.segments[self.document] == 1)
        chunk = chunk * starts[:, None]
        count = np.maximum(self.segments - 1, 1)
        if not docs:
            return np.zeros((0, 3 * FILTERS), np.float32), None
        mean = np.add.reduceat(chunk, self.first[:-1], axis=0) / count[:, None]
        top = np.maximum.reduceat(chunk, self.first[:-1], axis=0)
        low = np.minimum.reduceat(np.where(starts[:, None], chunk, np.inf), self.first[:-1], axis=0)
        return np.concatenate([mean, top, low], axis=1).astype(np.float32), (second, chunk, starts, count, top, low)


def _gradients(layout: _Layout, w: dict, truth: np.ndarray) -> tuple[dict, float]:
    pooled, where = layout.pool(w, keep=True)
    joined, (second, chunk, starts, count, top, low) = layout.combine(pooled)
    z = np.clip(joined @ w["head"] + w["bias"], -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = float(-(truth * np.log(p + 1e-9) + (1 - truth) * np.log(1 - p + 1e-9)).mean())
    dz = ((p - truth) / len(truth)).astype(np.float32)
    out = {"head": joined.T @ dz + 1e-4 * w["head"], "bias": dz.sum(keepdims=True)}
    d_joined = dz[:, None] * w["head"]
    doc = layout.document
    d_chunk = (d_joined[:, :FILTERS] / count[:, None])[doc] * starts[:, None]
    for extreme, d_extreme in ((top, d_joined[:, FILTERS:2 * FILTERS]), (low, d_joined[:, 2 * FILTERS:])):
        there = (chunk == extreme[doc]) & (chunk > 0)
        ties = np.maximum(np.add.reduceat(there, layout.first[:-1], axis=0, dtype=np.float32), 1)
        d_chunk = d_chunk + there * (d_extreme / ties)[doc]
    d_pooled = np.where(second, 0, d_chunk)
    d_pooled[1:] += np.where(second, d_chunk, 0)[:-1]
    d_pooled = (d_pooled * (pooled > 0)).astype(np.float32)
    # Only the window with the largest response of a filter passes a gradient on.
    begin = (np.arange(len(pooled))[:, None] * SEGMENT + where) * STEP
    bytes_ = layout.data[begin[:, :, None] + np.arange(WIDTH)]
    seen = w["bytes"][bytes_].reshape(len(pooled), FILTERS, WIDTH * DEPTH)
    out["filters"] = np.einsum("sf,sfk->kf", d_pooled, seen)
    out["offsets"] = d_pooled.sum(axis=0)
    d_seen = (d_pooled[:, :, None] * w["filters"].T[None]).reshape(-1, DEPTH)
    flat = bytes_.reshape(-1)
    out["bytes"] = np.stack([np.bincount(flat, d_seen[:, k], 256) for k in range(DEPTH)], axis=1).astype(np.float32)
    return out, loss


def train(texts: list[bytes], truth: np.ndarray, epochs: int = 12, batch: int = 48, seed: int = 7,
          least_steps: int = 40) -> dict:
    """Weights fitted by Adam on balanced batches."""
    rng = np.random.default_rng(seed)
    w = {
        "bytes": rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        "offsets": np.zeros(FILTERS, np.float32),
        "head": np.zeros(3 * FILTERS, np.float32),
        "bias": np.zeros(1, np.float32),
    }
    if len(set(truth.tolist())) < 2:  # nothing tells the classes apart
        w["bias"] += -40 if 0 in truth else 40
        return w
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    good, bad = np.flatnonzero(truth == 1), np.flatnonzero(truth == 0)
    steps = max(least_steps, (len(good) + len(bad)) // batch)
    t = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for _ in range(steps):
            pick = np.concatenate([rng.choice(good, batch // 2), rng.choice(bad, batch // 2)])
            part = [texts[i] for i in pick]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
            layout = _Layout(np.frombuffer(b"".join(part), np.uint8), ends)
            grads, _ = _gradients(layout, w, truth[pick].astype(np.float32))
            t += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w[k] = (w[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Network:
    """Fit on a bounded sample: about ``fit_rows`` labelled documents of each class, ``fit_bytes`` of each at most.

    Of a longer document stretches from all over it are taken, so no class drops out by its length.
    Rows whose crc32 of the key leaves 2 when divided by 4 are never learned from,
    and only the text is an input. Both classes weigh the same in the fit, so a score
    of a half means neither is likelier by the text. Without labels of both classes
    every score is that of the class known, and 1 if there are no labels at all.
    """
    allowed = ~remainder_is(F.col("doc_id"), 4, 2)
    sample = labelled_sample(docs, labels, "quality", fit_rows, allowed)
    rows = sample.where(F.col("text").isNotNull()).select(
        "doc_id", "quality", spread_bytes(F.col("text"), fit_bytes).alias("raw")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    truth = np.array([int(r["quality"] == 1) for r in rows], int)
    return Network(train([bytes(r["raw"]) for r in rows], truth))


def score_column(network: Network, text: str = "text") -> Column:
    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(network.scores(*utf8(texts)))

    return score(text)


def classify(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` in [0, 1] and ``predicted``; a null text is scored as an empty one.

    Repeated rows are scored each, an empty table gives none, and columns of ``docs`` that
    bear the name of a result are replaced by it.
    """
    python_tasks(docs.sparkSession)
    scored = docs.withColumn("score", score_column(network))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted good, with the columns they had."""
    python_tasks(docs.sparkSession)
    [score] = fresh(docs, "score")
    return docs.withColumn(score, score_column(network)).where(F.col(score) >= threshold).drop(score)
