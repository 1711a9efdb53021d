"""The toxicity model against a plain forward pass and numeric gradients; clashing columns."""

import math

import numpy as np

from dialogmill.llm import quality_cnn, toxicity
from test_llm import DOC, ODD

TEXTS = [b"", b"a", b"you are ab!so!lute ID10T", b"word " * 30, bytes(range(32, 127)) * 9, "été über ".encode() * 60, b"x" * 1000, b"   " * 200]


def plain(model, text):
    """The score of one text, subword by subword."""
    data = bytes([32]) + bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in text) + bytes([32])
    weight, halves = model.weights(), max(1, -(-len(data) // toxicity.HALF))
    total, count = [0.0] * halves, [0] * halves
    for p in range(len(data)):
        for k in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
            part = data[p : p + k]
            if len(part) < k or 32 in part[1:-1]:
                continue
            h = part[0]
            for b in part[1:]:
                h = h * 0x01000193 % 2**32 ^ b
            mixed = h * 2654435761 % 2**32
            total[p // toxicity.HALF] += weight[((mixed ^ mixed >> 15) * 2654435761 % 2**32) >> 16]
            count[p // toxicity.HALF] += 1
    pairs = [(0,)] if halves == 1 else [(i, i + 1) for i in range(halves - 1)]
    segments = [toxicity.SCALE * sum(total[i] for i in s) / max(toxicity.FEW, sum(count[i] for i in s)) for s in pairs]
    a, b, c = model.p["combine"]
    return 1 / (1 + math.exp(-(a * max(segments) + b * sum(segments) / len(segments) + c)))


def block(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def model_of(seed):
    model = toxicity.Model(seed)
    model.p["vectors"] = np.random.default_rng(seed).standard_normal(model.p["vectors"].shape)
    return model


def test_forward():
    for seed in (1, 2):
        model = model_of(seed)
        got = model.forward(*block(TEXTS), model.weights())
        assert np.allclose(got, [plain(model, t) for t in TEXTS], atol=1e-12)


def test_gradient():
    model = model_of(3)
    raw, offsets = block([TEXTS[2], TEXTS[3], b"quite another text, of some words " * 20])
    goal, importance = np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0, 0.5])

    def loss():
        y = model.forward(raw, offsets, model.weights())
        return float((importance * -np.where(goal == 1, np.log(y), np.log(1 - y))).sum() / len(goal))

    grad = model.gradient(raw, offsets, goal, importance)
    for name in ("vectors", "softmax", "combine"):
        flat, own = model.p[name].reshape(-1), grad[name].reshape(-1)
        for i in np.argsort(-np.abs(own))[:5]:
            old, e = flat[i], 1e-6
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - own[i]) < 1e-5 + 1e-4 * abs(own[i])


def test_clashing_columns(spark):
    """Columns named like results, or like what the scans use inside, change nothing."""
    docs = spark.createDataFrame(ODD, DOC)
    clash = docs.selectExpr("*", "1 as score", "true as held_out", "2 as predicted", "3 as y", "4 as quality", "5 as toxic")
    model = model_of(4)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(toxicity.score_toxicity(clash.select("doc_id", "text", "score", "y"), model)) == rows(toxicity.score_toxicity(docs, model))
    net = quality_cnn.train_network(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert rows(quality_cnn.score_quality(clash, net)) == rows(quality_cnn.score_quality(docs, net))
