"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters 12 bytes wide run over the whole text every 3 bytes. The text is covered by overlapping chunks of 192
bytes; a chunk holds each filter's mean and largest activation, the document the largest of those over its chunks (max pooling), and a
small layer combines them into one probability. All layers are trained together on a bounded sample of labelled training rows, weighted
to the label shares of all of them.

Defined cases: null or empty text is one chunk of padding and gets that chunk's score; a text is read whole whatever its length; scores
depend on the row's text alone; repeated rows score alike; without both labels in the training fold every score is the share of label 1
(0.5 without any label); an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import blocks, held_out, labelled_sample, sample_texts, string_buffers

#: Labelled training documents that the network is fitted on, at most, and bytes that one may have to be sampled (each is read whole).
SAMPLE, SAMPLE_BYTES = 2000, 1 << 16
STEP, SPAN = 3, 4  # bytes a step; steps a filter covers
QUARTER, CHUNK, HOP = 16, 4, 3  # steps a quarter; quarters a chunk; quarters from chunk to chunk
DIM, FILTERS, HIDDEN = 6, 24, 12
BLOCK = 1 << 18

#: A small sample is gone through until so many steps are made.
STEPS = 400


def _padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with zero bytes behind each, up to whole chunks; quarter offsets of the texts."""
    size = np.diff(offsets)
    unit = STEP * QUARTER
    quarters = np.maximum(-(-(size + STEP * (SPAN - 1)) // unit), CHUNK)
    quarters = CHUNK + -(-(quarters - CHUNK) // HOP) * HOP
    first = np.concatenate([[0], np.cumsum(quarters)])
    out = np.zeros(first[-1] * unit, np.uint8)
    out[np.arange(len(raw)) + np.repeat(first[:-1] * unit - offsets[:-1], size)] = raw
    return out, first


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": draw(256, DIM, scale=0.5),
            "conv": draw(STEP * DIM, SPAN * FILTERS, scale=(STEP * DIM * SPAN) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "mix": draw(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5),
            "mix_bias": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, scale=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }

    def forward(self, raw: np.ndarray, offsets: np.ndarray, keep: bool = False):
        """Probability of label 1 for each text; with ``keep`` also what the gradient needs."""
        p = self.p
        data, first = _padded(raw, offsets)
        x = p["embed"][data].reshape(-1, STEP * DIM)
        g = x @ p["conv"]
        n = len(x)
        act = np.zeros((n, FILTERS), np.float32)
        for k in range(SPAN):
            act[: n - k] += g[k:, k * FILTERS : (k + 1) * FILTERS]
        act += p["bias"]
        np.maximum(act, 0, out=act)
        for k in range(1, SPAN):
            act[first[1:] * QUARTER - k] = 0  # such windows would reach into the next text
        quarter = act.reshape(-1, QUARTER, FILTERS)
        total, top = quarter.sum(1), quarter.max(1)
        start = np.concatenate([np.arange(a, b - CHUNK + 1, HOP) for a, b in zip(first[:-1], first[1:])])
        chunks = (np.diff(first) - CHUNK) // HOP + 1
        at = np.concatenate([[0], np.cumsum(chunks)[:-1]])
        mean = sum(total[start + k] for k in range(CHUNK)) / (CHUNK * QUARTER)
        high = np.maximum.reduce([top[start + k] for k in range(CHUNK)])
        both = np.concatenate([mean * 4, high], 1)
        pooled = np.maximum.reduceat(both, at, axis=0)
        hidden = np.maximum(pooled @ p["mix"] + p["mix_bias"], 0)
        z = hidden @ p["out"] + p["out_bias"]
        y = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return (y, (data, first, x, act, top, start, at, both, pooled, hidden)) if keep else y.astype(np.float64)

    def gradient(self, raw: np.ndarray, offsets: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        y, (data, first, x, act, top, start, at, both, pooled, hidden) = self.forward(raw, offsets, keep=True)
        dz = ((y - goal) * weight / len(y)).astype(np.float32)
        out = {"out": hidden.T @ dz, "out_bias": dz.sum(keepdims=True)}
        dh = np.outer(dz, p["out"]) * (hidden > 0)
        out |= {"mix": pooled.T @ dh, "mix_bias": dh.sum(0)}
        dp = dh @ p["mix"].T
        doc = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(both))))
        hit = both == pooled[doc]  # the chunk that a pooled value came from; among equals the first
        pick = np.where(hit, np.arange(len(both))[:, None], len(both))
        chunk = np.minimum.reduceat(pick, at, axis=0)
        da = np.zeros_like(act)
        dq = np.zeros((len(top), FILTERS), np.float32)
        f = np.arange(FILTERS)
        quarter = start[chunk]
        for k in range(CHUNK):
            np.add.at(dq, (quarter[:, :FILTERS] + k, f[None]), dp[:, :FILTERS] * (4 / (CHUNK * QUARTER)))
        da += np.repeat(dq, QUARTER, axis=0)
        q = quarter[:, FILTERS:]
        best = np.stack([top[q + k, f[None]] for k in range(CHUNK)]).argmax(0) + q
        inner = act.reshape(-1, QUARTER, FILTERS)[best, :, f[None]].argmax(-1)
        np.add.at(da, (best * QUARTER + inner, f[None]), dp[:, FILTERS:])
        da *= act > 0
        out["bias"] = da.sum(0)
        n = len(x)
        dg = np.zeros((n, SPAN * FILTERS), np.float32)
        for k in range(SPAN):
            dg[k:, k * FILTERS : (k + 1) * FILTERS] = da[: n - k]
        out["conv"] = x.T @ dg
        dx = (dg @ p["conv"].T).reshape(-1, DIM)
        out["embed"] = np.stack([np.bincount(data, dx[:, k], 256) for k in range(DIM)], 1).astype(np.float32)
        return out


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 4e-3, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam over shuffled batches with a falling rate."""
    net, rng = Network(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    epochs = max(epochs, -(-STEPS // -(-len(texts) // batch)))
    steps, t = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            part = [texts[i] for i in rows]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            grad = net.gradient(np.frombuffer(b"".join(part), np.uint8), offsets, y[rows], weight[rows])
            t += 1
            lr = rate * (1 - t / (steps + 1)) / (1 - 0.9**t)
            for k, g in grad.items():
                g = g + decay * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                net.p[k] -= (lr * m[k] / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def train_network(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Network | float:
    """A network, or the share of label 1 if the training fold doesn't hold both labels."""
    fold = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    share = {r.quality: r.n for r in fold.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rows = sorted(sample_texts(labelled_sample(documents, labels, "quality", sample), SAMPLE_BYTES).collect())
    y = np.array([r.y for r in rows], float)
    if len(set(y)) < 2:
        return share.get(1, 0) / sum(share.values()) if share else 0.5
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum())
    return fit([r.text.encode() for r in rows], y, weight / weight.mean(), **options)


def score_quality(documents: DataFrame, model: Network | float, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for a, b in blocks(offsets, BLOCK):
                score = np.full(b - a, float(model)) if isinstance(model, float) else model.forward(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(score)], ["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rate, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
