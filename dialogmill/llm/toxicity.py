"""Toxicity: bags of subwords, averaged and put through a linear softmax, trained together in numpy.

A subword is a run of 3 to 8 bytes inside a word or with one space at its edge (A-Z folded, punctuation read as space); it is hashed to one
of 65,536 vectors, so a misspelling shares most of its vectors with the word. A text is covered by overlapping segments of 384 bytes;
each segment's average goes through the softmax, and the document combines its largest and its mean segment (one average over a long text
would drown a few words). Vectors, softmax and combination are trained together on a bounded sample of labelled training rows. For scoring, a vector's product with the softmax is one
number a subword.

Defined cases: null or empty text has one empty segment; a text is read whole whatever its length; a score depends on the row's text
alone; repeated rows score alike; without both labels in the training fold every score is the share of label 1 (0 without any label); an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import blocks, held_out, labelled_sample, sample_texts, string_buffers

#: Labelled training documents that the model is fitted on, at most, and bytes that one may have to be sampled (each is read whole).
SAMPLE, SAMPLE_BYTES = 3000, 1 << 16
BUCKETS, DIM = 1 << 16, 8
SHORTEST, LONGEST = 3, 8
HALF = 192  # a segment is two halves; each half but the last begins one
SCALE = 60.0
#: A missed toxic text costs so many times a clean one that is flagged.
MISS = 2.0
FEW = 100  # subwords that a segment's average is taken over at least
BLOCK = 1 << 18
#: A small sample is gone through until so many steps are made.
STEPS = 300
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32
_MUL = np.uint32(2654435761)


def subwords(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the positions where a subword begins, and its bucket. A text's edges count as spaces."""
    n, many = len(raw), len(offsets) - 1
    data = np.full(n + 2 * many + LONGEST, 32, np.uint8)  # a space before and behind each text
    data[np.arange(n) + np.repeat(2 * np.arange(many) + 1, np.diff(offsets))] = _FOLD[raw]
    space = data == 32
    size = n + 2 * many
    h = data[:size].astype(np.uint32)
    inner = np.ones(size, bool)  # bytes 1 .. k-2 of the subword hold no space
    for k in range(2, LONGEST + 1):
        h = h * np.uint32(0x01000193) ^ data[k - 1 : size + k - 1]
        if k >= 3:
            inner &= ~space[k - 2 : size + k - 2]
        if k >= SHORTEST:
            at = np.flatnonzero(inner)
            mixed = h[at] * _MUL
            yield at, ((mixed ^ (mixed >> np.uint32(15))) * _MUL) >> np.uint32(16)


class Bags:
    """Halves of a block's texts: ``of`` gives the half of each position, ``first`` n_texts+1 half offsets."""

    def __init__(self, offsets: np.ndarray):
        size = np.diff(offsets) + 2
        halves = np.maximum(1, -(-size // HALF))
        self.first = np.concatenate([[0], np.cumsum(halves)])
        start = offsets[:-1] + 2 * np.arange(len(size))
        self.of = np.repeat(self.first[:-1], size) + (np.arange(int(size.sum())) - np.repeat(start, size)) // HALF
        last = np.zeros(self.first[-1], bool)
        last[self.first[1:] - 1] = True
        alone = np.repeat(halves == 1, halves)
        self.left = np.flatnonzero(~last | alone)  # segments: (left, left + 1), or the only half
        self.right = np.where(alone[self.left], -1, self.left + 1)
        segments = np.maximum(1, halves - 1)
        self.at = np.concatenate([[0], np.cumsum(segments)[:-1]])
        self.segments = segments

    def pair(self, per_half: np.ndarray) -> np.ndarray:
        return per_half[self.left] + np.where(self.right >= 0, per_half[self.right], 0)


class Model:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"vectors": rng.standard_normal((BUCKETS, DIM)) * 0.01, "softmax": rng.standard_normal((DIM, 2)) * 0.5, "combine": np.array([0.6, 0.6, -2.0])}

    def weights(self) -> np.ndarray:
        """Per bucket: logit of label 1 less that of label 0."""
        return self.p["vectors"] @ (self.p["softmax"][:, 1] - self.p["softmax"][:, 0])

    def forward(self, raw: np.ndarray, offsets: np.ndarray, weight: np.ndarray, keep: bool = False):
        bags = Bags(offsets)
        halves = int(bags.first[-1])
        total, count, used = np.zeros(halves), np.zeros(halves), []
        for at, bucket in subwords(raw, offsets):
            half = bags.of[at]
            total += np.bincount(half, weight[bucket], halves)
            count += np.bincount(half, minlength=halves)
            if keep:
                used.append((half, bucket))
        segment_n = np.maximum(bags.pair(count), FEW)  # a segment of a few subwords is no strong witness
        segment = SCALE * bags.pair(total) / segment_n
        top = np.maximum.reduceat(segment, bags.at)
        mean = np.add.reduceat(segment, bags.at) / bags.segments
        a, b, c = self.p["combine"]
        z = a * top + b * mean + c
        y = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return (y, bags, used, segment, segment_n, top, mean) if keep else y

    def gradient(self, raw: np.ndarray, offsets: np.ndarray, goal: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        y, bags, used, segment, segment_n, top, mean = self.forward(raw, offsets, self.weights(), keep=True)
        dz = (y - goal) * importance / len(y)
        a, b, _ = self.p["combine"]
        doc = np.repeat(np.arange(len(bags.segments)), bags.segments)
        ds = (b * dz / bags.segments)[doc]
        pick = np.minimum.reduceat(np.where(segment == top[doc], np.arange(len(segment)), len(segment)), bags.at)
        ds[pick] += a * dz
        per = SCALE * ds / segment_n
        dh = np.zeros(int(bags.first[-1]))
        np.add.at(dh, bags.left, per)
        two = bags.right >= 0
        np.add.at(dh, bags.right[two], per[two])
        dw = np.zeros(BUCKETS)
        for half, bucket in used:
            dw += np.bincount(bucket, dh[half], BUCKETS)
        u = self.p["softmax"][:, 1] - self.p["softmax"][:, 0]
        du = self.p["vectors"].T @ dw
        return {"vectors": np.outer(dw, u), "softmax": np.stack([-du, du], 1), "combine": np.array([dz @ top, dz @ mean, dz.sum()])}


def fit(texts: list[bytes], y: np.ndarray, importance: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam with a falling rate; rows of buckets that a batch doesn't hold stay where they are but for their momentum."""
    model, rng = Model(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    epochs = max(epochs, -(-STEPS // -(-len(texts) // batch)))
    steps, t = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            part = [texts[r] for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            t += 1
            lr = rate * (1 - t / (steps + 1))
            for k, g in model.gradient(np.frombuffer(b"".join(part), np.uint8), offsets, y[rows], importance[rows]).items():
                g = g + decay * model.p[k]
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                model.p[k] -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)
    return model


def calibrated(texts: list[bytes], y: np.ndarray, importance: np.ndarray, seed: int = 5, **options) -> Model:
    """A model fitted on all rows, its logit stretched and shifted by what one fitted on three quarters needs on the fourth: the penalty
    on the vectors leaves unseen texts of a small sample closer to 0 than the training rows. The stretch is kept between 1 and 4."""
    part = np.random.default_rng(seed).random(len(texts)) < 0.75
    if len(set(y[part])) == 2 and len(set(y[~part])) == 2:
        trial = fit([t for t, x in zip(texts, part) if x], y[part], importance[part], seed=seed, **options)
        rest = [t for t, x in zip(texts, part) if not x]
        score = [trial.forward(np.frombuffer(t, np.uint8), np.array([0, len(t)]), w)[0] for w in [trial.weights()] for t in rest]
        z = np.log(np.clip(score, 1e-9, 1 - 1e-9) / (1 - np.clip(score, 1e-9, 1 - 1e-9)))
        stretch, shift, goal, weight = 1.0, 0.0, y[~part], importance[~part] / importance[~part].sum()
        for _ in range(2000):  # two numbers, so plain descent does; the pull towards no change counts as a few rows
            e = (1 / (1 + np.exp(-np.clip(stretch * z + shift, -30, 30))) - goal) * weight
            stretch = float(np.clip(stretch - 0.05 * (e @ z + (stretch - 1) / len(z)), 1, 4))
            shift -= 0.5 * (float(e.sum()) + shift / len(z))
    else:
        stretch, shift = 1.0, 0.0
    model = fit(texts, y, importance, seed=seed, **options)
    model.p["combine"] = model.p["combine"] * stretch + np.array([0, 0, shift])
    return model


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """The share of (toxic, clean) pairs in which the toxic one scores higher; ties count half."""
    value, place, many = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(many) - (many - 1) / 2)[place]
    good = y == 1
    return float((rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()))


def compare_settings(texts: list[bytes], y: np.ndarray, importance: np.ndarray, settings: list[dict], folds: int = 3, seed: int = 5) -> list[tuple[float, float, float]]:
    """For choosing settings without any held-out row: AUC, recall and false alarms at 0.5 of each, by cross-validation within the training rows."""
    fold, out = np.random.default_rng(seed).integers(0, folds, len(texts)), []
    for options in settings:
        score = np.zeros(len(texts))
        for k in range(folds):
            part = fold != k
            model = calibrated([t for t, x in zip(texts, part) if x], y[part], importance[part], **options)
            weight = model.weights()
            for i in np.flatnonzero(~part):
                score[i] = model.forward(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]), weight)[0]
        out.append((auc(score, y), float((score[y == 1] >= 0.5).mean()), float((score[y == 0] >= 0.5).mean())))
    return out


def train_model(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model | float:
    fold = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    share = {r.toxic: r.n for r in fold.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = sorted(sample_texts(labelled_sample(documents, labels, "toxic", sample), SAMPLE_BYTES).collect())
    y = np.array([r.y for r in rows], float)
    if len(set(y)) < 2:
        return share.get(1, 0) / sum(share.values()) if share else 0.0
    importance = np.where(y == 1, MISS * share[1] / y.sum(), share[0] / (1 - y).sum())
    return calibrated([r.text.encode() for r in rows], y, importance / importance.mean(), **options)


def score_toxicity(documents: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    combine = None if isinstance(model, float) else model.p["combine"]
    weight = None if isinstance(model, float) else model.weights()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model.__new__(Model)
        scorer.p = {"combine": combine}
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for a, b in blocks(offsets, BLOCK):
                score = np.full(b - a, float(model)) if weight is None else scorer.forward(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], weight)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(score)], ["doc_id", "score"])

    if weight is not None:
        model = None  # its vectors stay on the driver
    else:
        model = float(model)
    scored = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rate, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
