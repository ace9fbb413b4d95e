"""Language identification: a byte convolutional network in numpy.

A text is laid out in windows of a fixed number of bytes that cover all of it.
Filters of several widths run over the bytes of each window, their largest responses
feed a softmax over the learned languages, and the windows of a text vote with their
probabilities, each by the bytes it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import labelled_sample, python_tasks, remainder_is, utf8

WINDOW, STEP, DEPTH = 192, 2, 6
WIDTHS, PER_WIDTH = (2, 3, 4, 5), 10
FILTERS, WIDEST = len(WIDTHS) * PER_WIDTH, max(WIDTHS)
BATCH = 1024  # windows convolved at a time
SHARES = 4_000_000  # probabilities held at a time
PLACES = WINDOW // STEP

#: Labelled documents of each language, and bytes of each, that the network is fitted on at most; parts a long one is taken in.
FIT_ROWS, FIT_BYTES, PARTS = 600, 65_536, 16
UNKNOWN = "und"


def windows(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all texts (zeros fill the last one of each), the text of each window, and its bytes."""
    sizes = np.diff(ends)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    data = np.zeros((int(first[-1]), WINDOW), np.uint8)
    flat = data.reshape(-1)
    for i in np.flatnonzero(sizes).tolist():
        at = int(first[i]) * WINDOW
        flat[at:at + sizes[i]] = raw[ends[i]:ends[i + 1]]
    local = np.arange(len(text)) - first[text]
    return data, text, np.minimum(sizes[text] - local * WINDOW, WINDOW)


def _mask() -> np.ndarray:
    """A narrow filter sees the first bytes of its place only."""
    sees = np.zeros((WIDEST, DEPTH, FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        sees[:width, :, k * PER_WIDTH:(k + 1) * PER_WIDTH] = 1
    return sees.reshape(WIDEST * DEPTH, FILTERS)


def _pool(w: dict, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest response of each filter in each window, where it is, and the padded bytes."""
    padded = np.zeros((len(data), WINDOW + WIDEST), np.uint8)
    padded[:, :WINDOW] = data
    x = w["bytes"][padded]
    places = as_strided(x, (len(data), PLACES, WIDEST * DEPTH), (x.strides[0], STEP * x.strides[1], x.strides[2]))
    response = (places.reshape(-1, WIDEST * DEPTH) @ w["filters"]).reshape(len(data), PLACES, FILTERS)
    where = response.argmax(axis=1)
    top = np.take_along_axis(response, where[:, None, :], axis=1)[:, 0] + w["offsets"]
    return np.maximum(top, 0), where, padded


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    languages: list[str]

    def predict(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of the likeliest language and its probability (evenly shared for an empty text)."""
        n, classes = len(ends) - 1, len(self.languages)
        at_once = max(1, SHARES // classes)
        if n > at_once:  # with very many languages some texts at a time
            parts = [self.predict(raw, ends[lo:lo + at_once + 1]) for lo in range(0, n, at_once)]
            return tuple(np.concatenate(part) for part in zip(*parts))
        votes, weight = np.zeros((n, classes)), np.zeros(n)
        data, text, held = windows(raw, ends)
        batch = min(BATCH, at_once)
        for lo in range(0, len(data), batch):
            part = slice(lo, lo + batch)
            pooled, _, _ = _pool(self.weights, data[part])
            share = _softmax(pooled @ self.weights["head"] + self.weights["bias"]) * held[part, None]
            np.add.at(votes, text[part], share)
            np.add.at(weight, text[part], held[part])
        shares = np.where(weight[:, None] > 0, votes / np.maximum(weight, 1)[:, None], 1 / classes)
        best = shares.argmax(axis=1)
        return best, np.clip(shares[np.arange(n), best], 0, 1)


def train(texts: list[bytes], truth: np.ndarray, classes: int, epochs: int = 4, batch: int = 256, seed: int = 11) -> dict:
    """Weights fitted by Adam on windows, drawn evenly from the languages.

    Windows hold a quarter of the length at least, or where a language has none, half of its longest.
    """
    rng = np.random.default_rng(seed)
    sees = _mask()
    w = {
        "bytes": rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        "filters": (rng.normal(0, (WIDEST * DEPTH) ** -0.5, sees.shape) * sees).astype(np.float32),
        "offsets": np.zeros(FILTERS, np.float32),
        "head": np.zeros((FILTERS, classes), np.float32),
        "bias": np.zeros(classes, np.float32),
    }
    ends = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    data, text, held = windows(np.frombuffer(b"".join(texts), np.uint8), ends)
    longest = np.zeros(classes, np.int64)
    np.maximum.at(longest, truth[text], held)
    least = np.where(longest < WINDOW // 4, (longest + 1) // 2, WINDOW // 4)
    usable = np.flatnonzero(held >= least[truth[text]])
    usable = usable[np.argsort(truth[text[usable]], kind="stable")]
    cuts = np.searchsorted(truth[text[usable]], np.arange(classes + 1))
    by_class = [(c, usable[cuts[c]:cuts[c + 1]]) for c in range(classes) if cuts[c] < cuts[c + 1]]
    if len(by_class) < 2:
        return w
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    each = max(1, batch // len(by_class))
    steps = max(20, len(usable) // batch, 8 * len(by_class) // batch)
    t = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for _ in range(steps):
            chosen = by_class if len(by_class) <= batch else [
                by_class[i] for i in rng.choice(len(by_class), batch, replace=False)]
            pick = np.concatenate([rng.choice(rows, each) for _, rows in chosen])
            label = np.repeat([c for c, _ in chosen], each)
            pooled, where, padded = _pool(w, data[pick])
            p = _softmax(pooled @ w["head"] + w["bias"])
            p[np.arange(len(pick)), label] -= 1
            dz = (p / len(pick)).astype(np.float32)
            grads = {"head": pooled.T @ dz + 1e-4 * w["head"], "bias": dz.sum(axis=0)}
            d = ((dz @ w["head"].T) * (pooled > 0)).astype(np.float32)
            at = (where * STEP)[:, :, None] + np.arange(WIDEST)
            seen = padded[np.arange(len(pick))[:, None, None], at]
            grads["filters"] = np.einsum("sf,sfk->kf", d, w["bytes"][seen].reshape(len(pick), FILTERS, -1)) * sees
            grads["offsets"] = d.sum(axis=0)
            back = (d[:, :, None] * w["filters"].T[None]).reshape(-1, DEPTH)
            flat = seen.reshape(-1)
            grads["bytes"] = np.stack([np.bincount(flat, back[:, k], 256) for k in range(DEPTH)], axis=1)
            t += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w[k] = (w[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Network:
    """Fit on about ``fit_rows`` documents of each language, longer ones by windows from all over them, ``fit_bytes`` at most.

    Only ``text`` and ``lang`` are used, and no row whose crc32 of the key leaves 1
    when divided by 3. Without any such row the network knows no language.
    """
    allowed = ~remainder_is(F.col("doc_id"), 3, 1)
    sample = labelled_sample(docs, docs.select("doc_id", "lang"), "lang", fit_rows, allowed)
    raw, size = F.col("text").cast("binary"), F.octet_length("text")
    part = max(1, fit_bytes // PARTS // WINDOW) * WINDOW
    starts = [F.floor(size * i / PARTS / WINDOW).cast("int") * WINDOW + 1 for i in range(PARTS)]
    spread = F.concat(*[F.substring(raw, start, F.lit(part)) for start in starts])
    taken = F.when(size <= fit_bytes, raw).otherwise(spread).alias("raw")
    rows = sample.where(size > 0).select("doc_id", "lang", taken).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    truth = np.array([number[r["lang"]] for r in rows], int)
    return Network(train([bytes(r["raw"]) for r in rows], truth, len(languages)), languages)


def predict_column(network: Network, text: str = "text") -> Column:
    """``struct<lang_pred, score>`` of a text."""
    @arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        best, share = network.predict(*utf8(texts))
        names = pa.array(network.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(share)], ["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: ``und`` and 0 where the text is null or has no letter.

    Repeated rows are judged each, an empty table gives none, and columns of ``docs`` that
    bear the name of a result are replaced by it.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not network.languages:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    python_tasks(docs.sparkSession)
    found = predict_column(network)
    return docs.withColumns({"lang_pred": F.when(lettered, found["lang_pred"]).otherwise(UNKNOWN),
                             "score": F.when(lettered, found["score"]).otherwise(0.0)})
