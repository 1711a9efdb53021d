"""Quality rules: document statistics, fixed base rules, and gradient-boosted trees over the statistics.

The trees are grown in numpy on a bounded, hash-ordered sample of labelled training rows (``SAMPLE``) and flattened into node arrays,
so that a block of documents is scored by ``depth`` array look-ups a tree. Where a label has more rows than the sample takes, its rows weigh
as many as they stand for, so that probabilities, and with them the verdict, don't depend on the size of the input. Constrained features move the score one way only.

Defined cases: null or empty text has no words, so it fails the base rule; a text is read whole whatever its length; repeated rows
score alike; without any labelled row of both kinds the verdict is the base rule's alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import blocks, labelled_sample, sample_weights, string_buffers, tidy
from .textscan import WHITE, Words, windows

#: Labelled training rows that the trees are grown on, at most.
SAMPLE = 6000
#: A document stays if its estimated probability of good quality is at least this.
KEEP_FROM = 0.3
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*BASE, "base_failed", "score", "kept"]
FEATURES = [
    "log_words", "chars_per_word", "symbols_per_char", "dup_lines_share", "repeat_share", "distinct_share", "upper_share", "digit_share",
    "bang_per_word", "pipe_per_word", "stop_per_word", "comma_per_word", "lines_per_word", "same_as_previous", "non_ascii_share",
]
#: -1: more of it never raises the score; +1: never lowers it.
MONOTONE = {"symbols_per_char": -1, "dup_lines_share": -1, "repeat_share": -1, "same_as_previous": -1, "bang_per_word": -1, "pipe_per_word": -1, "distinct_share": 1}


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_HEAD = ~((np.arange(256) & 0xC0) == 0x80)  # a code point's first byte


def statistics(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 5) counts in the order of BASE and (n, len(FEATURES)) features of a block of texts."""
    n = len(offsets) - 1
    words = Words(raw, offsets)
    hashed = words.hashes()
    n_words = np.diff(words.first)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[offsets])

    word_chars = count(_HEAD[raw] & ~WHITE[raw])
    n_symbols = count(_SYMBOL[raw])
    win, at = windows(words, hashed, 3)
    first = np.searchsorted(at, words.first)
    dup_lines, repeats, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    same = np.zeros(n, np.int64)
    newline = np.flatnonzero(raw == 10)
    nl_first = np.searchsorted(newline, offsets)
    # hashes of lines: a line's words and the white space between them, as bytes
    for d in range(n):
        a, b = words.first[d], words.first[d + 1]
        if b == a:
            continue
        h = hashed[a:b]
        distinct[d] = len(np.unique(h))
        same[d] = np.count_nonzero(h[1:] == h[:-1])
        if b - a >= 3:
            w = win[first[d] : first[d + 1]]
            _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
            hit = counts[inverse] > 1
            if hit.any():
                cover = np.zeros(b - a, bool)
                for i in range(3):
                    cover[i : i + len(hit)] |= hit
                repeats[d] = np.count_nonzero(cover)
        if nl_first[d + 1] > nl_first[d]:
            lines = raw[offsets[d] : offsets[d + 1]].tobytes().split(b"\n")
            full = [x for x in lines if x.strip(b" \t\n\r\x0b\x0c")]
            dup_lines[d] = len(full) - len(set(full))
    base = np.stack([n_words, word_chars, n_symbols, dup_lines, repeats], 1)
    w1, c1 = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    lines = np.diff(nl_first) + 1
    feats = np.stack([
        np.log1p(n_words), word_chars / w1, n_symbols / c1, dup_lines / lines, repeats / w1, distinct / w1, count(_UPPER[raw]) / c1, count(_DIGIT[raw]) / c1,
        count(raw == 33) / w1, count(raw == 124) / w1, count(raw == 46) / w1, count(raw == 44) / w1, lines / w1, same / w1, count(_HEAD[raw] & (raw >= 128)) / c1,
    ], 1)
    return base, feats


@dataclass
class Forest:
    """Trees as node arrays (trees, nodes): ``feature`` is -1 at leaves; children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                fa = f[at]
                at = np.where(fa < 0, at, 2 * at + 1 + (x[rows, fa] > t[at]))
            out += v[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, bins: int = 48, least: float = 4.0, monotone: dict[int, int] | None = None, weight: np.ndarray | None = None) -> Forest:
    """Second-order boosting of the logistic loss on binned features. A split that breaks a monotonic constraint is not made, and
    the mid value of a constrained split bounds all leaves below it. ``weight``: of the rows, brought to a mean of 1."""
    monotone = monotone or {}
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
    width = bins + 1
    weight = np.ones(n) if weight is None else weight / weight.mean()
    mean = float((y * weight).mean())
    start = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    score = np.full(n, start)
    size = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        for level in range(depth + 1):
            base, many = 2**level - 1, 2**level
            live = node >= base
            local = node[live] - base
            sums = [np.bincount(local, w[live], many) for w in (g, h)]
            leaf = np.clip(-sums[0] / (sums[1] + ridge), low[base : base + many], high[base : base + many])
            value[t, base : base + many] = leaf * rate
            if level == depth:
                break
            best = np.full(many, 1e-6)
            pick: list[tuple[int, int, float, float] | None] = [None] * many
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key = local * width + code[live, j]
                gl, hl = (np.bincount(key, w[live], many * width).reshape(many, width).cumsum(1)[:, : len(cuts[j])] for w in (g, h))
                gr, hr = sums[0][:, None] - gl, sums[1][:, None] - hl
                vl, vr = -gl / (hl + ridge), -gr / (hr + ridge)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (sums[0] ** 2 / (sums[1] + ridge))[:, None]
                gain[(hl < least * 0.25) | (hr < least * 0.25)] = 0
                if sign := monotone.get(j):
                    gain[(vr - vl) * sign < 0] = 0
                at = gain.argmax(1)
                for k in range(many):
                    if gain[k, at[k]] > best[k]:
                        best[k], pick[k] = gain[k, at[k]], (j, int(at[k]), vl[k, at[k]], vr[k, at[k]])
            for k, chosen in enumerate(pick):
                i = base + k
                if chosen is None:
                    continue
                j, cut, vl, vr = chosen
                feature[t, i], threshold[t, i] = j, cuts[j][cut]
                left, right = 2 * i + 1, 2 * i + 2
                low[[left, right]], high[[left, right]] = low[i], high[i]
                if sign := monotone.get(j):
                    mid = float(np.clip((vl + vr) / 2, low[i], high[i]))
                    high[left if sign > 0 else right] = low[right if sign > 0 else left] = mid
                here = node == i
                node[here] = np.where(code[here, j] > cut, right, left)
        score += value[t, node]
    return Forest(feature, threshold, value, start, depth)


def train_forest(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Forest | None:
    """Statistics of the sampled rows are computed by tasks; only those numbers (at most ``sample`` rows) reach the driver."""
    names = ", ".join(f"{f} double" for f in FEATURES)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for a, b in blocks(offsets):
                _, x = statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = batch.column("doc_id").slice(a, b - a).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, batch.column("y").slice(a, b - a).cast(pa.int64()), *(pa.array(c) for c in x.T)], ["doc_id", "y", *FEATURES])

    got = labelled_sample(documents, labels, "quality", sample).mapInArrow(tidy(featurise), f"doc_id long, y long, {names}")
    # of rows of one id the least counts, so at most ``sample`` rows are collected
    got = got.groupBy("doc_id").agg(F.min(F.struct("y", *FEATURES)).alias("row")).select("doc_id", "row.*").toPandas().sort_values("doc_id")
    if got.y.nunique() < 2:
        return None
    weight = got.y.map(sample_weights(labels, "quality", sample)).to_numpy(float)
    return grow(got[FEATURES].to_numpy(), got.y.to_numpy(float), weight=weight, monotone={FEATURES.index(k): v for k, v in MONOTONE.items()}, **options)


def apply_rules(documents: DataFrame, forest: Forest | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """All columns of ``documents`` (those that clash with a result column are replaced), the base counts, base_failed, score, kept."""
    added = ADDED
    own = documents.drop(*added)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), *(f"{c} long" for c in BASE), "base_failed boolean, score double, kept boolean"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for a, b in blocks(offsets):
                base, x = statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
                score = forest.probability(x) if forest else np.where(failed, 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, *(pa.array(c) for c in base.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_from))],
                    [*batch.schema.names, *added],
                )

    return own.mapInArrow(tidy(rate), schema)
