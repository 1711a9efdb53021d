"""Personal data: base patterns, and a skip-chain conditional random field over the words of each document.

The field's nodes are the words that hold a digit, an @ or a bracketed "at", and the ``CONTEXT`` words on both sides of each; words farther
away are observed as "none" and bound the chain. Neighbouring nodes share chain potentials. A word and the last one before it with the same
digits or folded text share skip potentials, and so, with weights of their own, do words that agree in their first eight characters or
their first half, in their last seven digits, or in an address's first parts: an occurrence that no pattern finds takes the label its repetitions have. All weights are fitted together by
pseudo-likelihood; loopy sum-product messages then run over all nodes of a block at once.

There are no labels for what patterns miss, so the fit makes them: on a bounded sample of documents the base patterns' finds are the labels,
and in copies of these documents finds are split, spelled out or cut short, and ordinary numbers are added. A value that is cut short is labelled only if the whole one stands
in the same document. Keys and tokens that an assignment names are a fifth kind, "secret", which only the field reports, in columns of its own.

Defined cases: null or empty text has no spans; texts are read whole, and each pattern runs in time linear in the text; base spans are
never dropped or moved; repeated rows are treated alike; without a sample to learn from only base spans are returned; a column ``n_chars``
of another type than numbers or strings is left as it is; further columns are carried along.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import blocks, order_hash, string_buffers

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # of them are the base patterns'
#: Documents that the field is fitted on, at most, and characters of their nodes' words; documents that have more are not sampled.
SAMPLE, SAMPLE_CHARS = 1500, 4096
#: Nodes that the fit holds as Python objects at a time, about.
FIT_NODES = 4096
#: Belief from which a word outside the base spans is reported.
CONFIDENT = 0.8
#: Words on each side of a marked one that are nodes, and rounds of messages.
CONTEXT, ROUNDS = 2, 8
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\t-\r]+")
_MARKED = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)
_SPELT_AT = re.compile(rb"[(\[{][aA][tT][)\]}]")
_SECRET = re.compile(r"\b(?:token|secret|password|passwd|api_?key|access_?key|auth)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{16,})", re.I)
_MARK = np.zeros(256, bool)
_MARK[[64, *range(48, 58)]] = True

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2 and (d := 2 * d) > 9:
            d -= 9
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base patterns' finds, leftmost and non-overlapping per kind, by kind and start. An address is found from its @: what stands
    left of it decides where it begins, and no other @ can be inside."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_EDGES = (1, 3, 4, 5, 8, 13, 16, 20)
_WIDTH = 36
_STRIP = ".,;:!?\"'<>{}|*#$%&"
_NAMES = frozenset("token secret password passwd apikey api_key accesskey access_key auth key".split())


def _features(token: str, core: str, before: str, second: str) -> list[float]:
    """Indicators of a word's shape and of the two words before it."""
    x = [0.0] * _WIDTH
    x[0] = 1
    d = _digits(core)
    n, letters = len(d), sum(c.isalpha() for c in core)
    low = core.lower()
    x[28] = before.endswith(("=", ":"))
    x[29] = (before if before.strip("=:") else second).lower().strip("\"'=:") in _NAMES
    x[30] = low in ("(at)", "[at]")
    x[31] = low in ("(dot)", "[dot]", "dot")
    if not n and "@" not in core:
        x[32] = 1
        x[33] = "(at)" in low or "[at]" in low
        x[34] = "." in core.strip(".")
        return x
    x[1 + sum(n >= e for e in _EDGES)] = 1
    x[10] = "@" in core
    x[11] = bool(re.search(r"@[A-Za-z0-9-]+\.", core))
    parts = core.split(".")
    x[12] = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    x[13] = len(parts) == 4 and not x[12]
    x[14] = core.startswith("+")
    x[15] = "(" in token or ")" in token
    x[16] = "-" in core
    x[17] = 16 <= n <= 19 and luhn(d)
    x[18] = 16 <= n <= 19 and not x[17]
    x[19] = letters > 0
    x[20] = letters > n
    x[21] = any(c in core for c in ":/=&?#_")
    x[22] = n == len(core)
    x[23] = 0 < len(parts) - 1 < 3 and n > 0
    x[24] = "," in core
    x[25] = len(core) > 30
    x[26] = len(core) >= 16 and letters > 0 and core.isalnum()
    x[27] = len(core) >= 24 and letters > 0 and bool(re.fullmatch(r"[0-9a-fA-F]+", core))
    x[33] = "(at)" in low or "[at]" in low
    x[35] = "[.]" in core
    return x


class Graph:
    """Nodes and edges of a block of documents. ``kind`` of an edge: 0 chain, 1 the same, 2 alike. ``bound``: whether a node's left and right
    neighbour is a word that isn't one."""

    def __init__(self):
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.x: list[list[float]] = []
        self.bound: list[tuple[bool, bool]] = []
        self.edge: list[tuple[int, int, int]] = []

    def add(self, row: int, text: str) -> None:
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        live: set[int] = set()
        for i, (a, b) in enumerate(words):
            if _MARKED.search(text, a, b):
                live.update(range(max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)))
        last: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for k in sorted(live):
            a, b = words[k]
            token = text[a:b]
            core = token.strip(_STRIP)
            at = a + max(0, token.find(core))
            i = len(self.doc)
            before, second = (text[slice(*words[k - j])] if k >= j else "" for j in (1, 2))
            self.doc.append(row)
            self.span.append((at, at + len(core)))
            self.x.append(_features(token, core, before, second))
            self.bound.append((k > 0 and k - 1 not in live, k + 1 < len(words) and k + 1 not in live))
            if k - 1 in live:
                self.edge.append((i - 1, i, 0))
            if not _MARKED.search(core):
                continue
            d, low = _digits(core), core.casefold()
            same = [d if len(d) >= 7 else low] if len(low) >= 3 else []
            alike = [d[-7:]] if 7 <= len(d) <= 15 else []
            if "@" in low:
                alike.append(low.split(".")[0])
            elif low.count(".") in (2, 3):
                alike.append(".".join(low.split(".")[:3]))
            elif len(low) >= 8:
                alike += [f"<{low[:n]}" for n in {8, len(low) // 2, len(low)} if n >= 8]
            met: set[int] = set()
            for kind, keys in ((1, same), (2, alike)):
                for key in keys:
                    if (j := last[kind - 1].get(key)) is not None and j not in met:
                        met.add(j)
                        self.edge.append((j, i, kind))
                    last[kind - 1][key] = i


@dataclass
class Field:
    """``node``: (features, labels) weights; ``edge``: (3, labels, labels) log potentials by kind, those of skips symmetric. Label 0 is none,
    k + 1 is KINDS[k]."""

    node: np.ndarray
    edge: np.ndarray

    def unary(self, graph: Graph) -> np.ndarray:
        bound = np.asarray(graph.bound, float).reshape(-1, 2)
        return np.asarray(graph.x).reshape(-1, len(self.node)) @ self.node + bound[:, :1] * self.edge[0, 0] + bound[:, 1:] * self.edge[0, :, 0]

    def beliefs(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product: each round renews all messages from the last round's, half damped."""
        unary = self.unary(graph)
        if graph.edge:
            e = np.array(graph.edge)
            src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            pot = np.concatenate([self.edge[e[:, 2]], self.edge[e[:, 2]].transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
            labels = unary.shape[1]
            message = np.zeros((len(src), labels))
            for _ in range(rounds):
                total = unary + np.stack([np.bincount(dst, message[:, k], len(unary)) for k in range(labels)], 1)
                out = (total[src] - message[back])[:, :, None] + pot
                top = out.max(1)
                out = np.log(np.exp(out - top[:, None]).sum(1)) + top
                message = 0.5 * message + 0.5 * (out - out.max(1, keepdims=True))
            unary = unary + np.stack([np.bincount(dst, message[:, k], len(unary)) for k in range(labels)], 1)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def labelled_spans(text: str) -> list[Span]:
    """What the fit takes as given: base finds, and the values of assignments to names of secrets."""
    return base_spans(text) + [(BASE, m.start(1), m.end(1)) for m in _SECRET.finditer(text)]


def _spelt(kind: int, value: str, rng: random.Random) -> tuple[str, str]:
    """A find in another spelling, and cut short."""
    d = _digits(value)
    if kind == 0:
        local, domain = value.rsplit("@", 1)
        at = rng.choice(["(at)", "[at]"])
        return rng.choice([f"{local} {at} {domain.replace('.', rng.choice([' (dot) ', ' dot ', ' [dot] ']))}", f"{local} {at} {domain}", f"{local}{at}{domain}"]), f"{local}@{domain.split('.')[0]}"
    if kind == 1:
        return value.replace(".", rng.choice(["[.]", " . ", "[.]"])), value.rsplit(".", 1)[0]
    if kind == 2:
        fours = [d[i : i + 4] for i in range(0, len(d), 4)]
        return rng.choice([".", "/", "_"]).join(fours), d[:8]
    if kind == 3:
        area, rest = d[-10:-7], d[-7:]
        return rng.choice([f"({area}) {rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}"]), f"{rest[:3]}-{rest[3:]}"
    return value, value[: len(value) // 2]


def altered(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """``text`` with each of its finds respelt, cut short, or whole with another spelling or a part of it at the end; and the labels."""
    out, labels, tail, at = "", [], [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        out += text[at:a]
        value, at = text[a:b], b
        other, short = _spelt(kind, value, rng)
        way = rng.randrange(4)
        put = (other, short, value, value)[way]
        if way != 1:
            labels.append((kind, len(out), len(out) + len(put)))
        out += put
        if way > 1:
            tail.append((kind, other if way == 2 else short))
    out += text[at:]
    for kind, value in tail:
        out += " so it "
        labels.append((kind, len(out), len(out) + len(value)))
        out += value + " was"
    # ordinary numbers, which the sample may lack
    year, few, many, share = rng.randint(1800, 2100), rng.randint(1, 99), rng.randint(100, 99_999), rng.randint(1, 999) / 10
    return f"{out} so In {year} there were {few} of {many} and {share} of {many:,} ({year}) so", labels


def fit(texts: list[str], steps: int = 300, rate: float = 0.2, decay: float = 2e-6, seed: int = 9) -> Field | None:
    """Node, chain and skip weights together: gradient steps on the pseudo-likelihood, each node's label given those of its neighbours.
    It runs in the driver, so nodes are kept as numbers of few bytes, and as Python's objects only ``FIT_NODES`` at a time."""
    labels, rng = len(KINDS) + 1, random.Random(seed)
    parts: list[tuple[np.ndarray, ...]] = []
    graph, y = Graph(), []

    def flush() -> None:
        nonlocal graph, y
        if y:
            parts.append((np.array(graph.x, np.uint8), np.array(y, np.uint8), np.array(graph.bound, bool), np.array(graph.edge, np.int32).reshape(-1, 3)))
        graph, y = Graph(), []

    def learn(text: str, spans: list[Span]) -> None:
        a = len(graph.doc)
        graph.add(a, text)
        for s, t in graph.span[a:]:
            y.append(next((k + 1 for k, b, e in spans if s < e and t > b), 0))
        if len(y) >= FIT_NODES:
            flush()

    for text in texts:
        spans = labelled_spans(text)
        learn(text, spans)
        for _ in range(5 if spans else 0):
            learn(*altered(text, spans, rng))
    flush()
    if not any(part[1].any() for part in parts):
        return None
    nodes, at = sum(len(part[1]) for part in parts), 0
    x, goal = np.zeros((nodes, _WIDTH + 4 * labels), np.float32), np.zeros((nodes, labels), np.float32)
    for features, label, bound, edges in parts:
        own = x[at : at + len(label)]
        own[:, :_WIDTH] = features
        goal[at : at + len(label)] = mine = np.eye(labels, dtype=np.float32)[label]
        # what the neighbours' labels add is linear in the potentials, so they are inputs: label counts before, behind, of the same, of those alike
        around = [own[:, _WIDTH + k * labels : _WIDTH + (k + 1) * labels] for k in range(4)]
        around[0][:, 0], around[1][:, 0] = bound[:, 0], bound[:, 1]
        for kind in range(3):
            e = edges[edges[:, 2] == kind]
            np.add.at(around[0 if kind == 0 else kind + 1], e[:, 1], mine[e[:, 0]])
            np.add.at(around[1 if kind == 0 else kind + 1], e[:, 0], mine[e[:, 1]])
        at += len(label)
    del parts
    param = [np.zeros((_WIDTH, labels)), np.zeros((3, labels, labels))]
    mean, square = [np.zeros_like(p) for p in param], [np.zeros_like(p) for p in param]
    for t in range(1, steps + 1):
        node, edge = param
        z = x @ np.concatenate([node, edge[0], edge[0].T, edge[1], edge[2]]).astype(np.float32)
        p = np.exp(z - z.max(1, keepdims=True))
        g = (x.T @ (p / p.sum(1, keepdims=True) - goal)).astype(float) / len(x)
        before, behind, same, alike = g[_WIDTH:].reshape(4, labels, labels)
        grad = [g[:_WIDTH] + decay * node, np.stack([before + behind.T, same + same.T, alike + alike.T]) + decay * edge]
        for i, g in enumerate(grad):
            mean[i] += 0.1 * (g - mean[i])
            square[i] += 0.01 * (g * g - square[i])
            param[i] = param[i] - rate * (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.99**t)) + 1e-8)
    return Field(*param)


def _nodes_alone(text: str) -> str:
    """``text`` without the words that are far from any node (a mark stands for a run of them), so that a sampled text is short."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    near: set[int] = set()
    for i, (a, b) in enumerate(words):
        if _MARKED.search(text, a, b):
            near.update(range(max(0, i - CONTEXT - 2), min(len(words), i + CONTEXT + 3)))
    out, last = [], -1
    for i in sorted(near):
        out.append(text[words[i - 1][1] : words[i][1]] if i - 1 == last and i else ("\n…\n" if i else "") + text[slice(*words[i])])
        last = i
    return "".join(out)


def train_field(documents: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Fits on at most ``sample`` documents that hold a digit or an @, taken in hash order, as their nodes' words: at most ``SAMPLE_CHARS``
    characters of each reach the driver."""
    spark = documents.sparkSession
    some = documents.filter(F.col("text").rlike("[0-9@]")).select(F.col("doc_id").cast("long").alias("doc_id"), order_hash(F.col("doc_id"), F.length("text"), seed=5).alias("h")).filter("doc_id is not null")
    ids = spark.createDataFrame([(r.doc_id,) for r in some.orderBy("h", "doc_id").limit(sample).collect()], "doc_id long").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [_nodes_alone(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(short, pa.string())], ["doc_id", "text"])

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id").mapInArrow(cut, "doc_id long, text string")
    texts = texts.filter(F.length("text") <= SAMPLE_CHARS).orderBy("doc_id", "text").limit(sample).collect()
    return fit([r.text for r in texts if r.text])


def find_block(raw: np.ndarray, offsets: np.ndarray, field: Field | None, confident: float = CONFIDENT) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text of a block. Texts without a digit, an @ or a spelt "at" are not even decoded: nothing can match."""
    marks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_MARK[raw], out=marks[1:])
    some = np.diff(marks[offsets]) > 0
    spelt = [m.start() for m in _SPELT_AT.finditer(memoryview(raw))]
    some[np.searchsorted(offsets, spelt, side="right") - 1] = True
    found: list[tuple[list[Span], list[Span]]] = [([], [])] * (len(offsets) - 1)
    graph = Graph()
    for d in np.flatnonzero(some):
        text = raw[offsets[d] : offsets[d + 1]].tobytes().decode()
        spans = base_spans(text)
        found[d] = (spans, list(spans))
        if field is not None:
            graph.add(int(d), text)
    if field is not None and graph.doc:
        belief = field.beliefs(graph)
        label = belief.argmax(1)
        chain = {b: a for a, b, kind in graph.edge if kind == 0}
        fresh: dict[int, Span] = {}  # by its last node: words of one kind that stand side by side are one span
        for i in np.flatnonzero((label > 0) & (belief.max(1) >= confident)):
            (a, b), kind, base = graph.span[i], int(label[i]) - 1, found[graph.doc[i]][0]
            if a == b or any(a < e and b > s for _, s, e in base):
                continue
            before = fresh.pop(chain[i], None) if chain.get(i) in fresh and fresh[chain[i]][0] == kind else None
            fresh[int(i)] = (kind, before[1] if before else a, b)
        for i, span in fresh.items():
            found[graph.doc[i]][1].append(span)
    return found


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in brackets; overlapping spans merge under the first one's kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_personal_data(documents: DataFrame, field: Field | None, redacted: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (of these four kinds), n_secret, secret_spans; with ``redacted`` instead all
    columns of ``documents``, each text with its spans replaced (and ``n_chars`` renewed if there)."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_secret", "secret_spans"]
    nothing = hashlib.sha256(b"").hexdigest()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            for a, b in blocks(offsets):
                counts, digests, spans, secrets = [], [], [], []
                for base, every in find_block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], field):
                    counts.append([sum(s[0] == k for s in base) for k in range(BASE)] if base else [0] * BASE)
                    digests.append(hashlib.sha256(spell(base).encode()).hexdigest() if base else nothing)
                    spans.append(spell([s for s in every if s[0] < BASE]))
                    secrets.append([s for s in every if s[0] >= BASE])
                more = [pa.array([len(x) for x in secrets], pa.int64()), pa.array([spell(x) for x in secrets], pa.string())]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(digests), pa.array(spans), *more], names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            at, chars = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            for a, b in blocks(offsets):
                part = batch.slice(a, b - a)
                found = find_block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], field)
                texts = part.column(at).to_pylist()
                texts = [redact(t, every) if every else t for t, (_, every) in zip(texts, found)]
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                kind = part.schema.field(chars).type if chars >= 0 else pa.null()
                if pa.types.is_integer(kind) or pa.types.is_string(kind):
                    size = str if pa.types.is_string(kind) else int
                    sizes = [size(len(t)) if every else n for t, n, (_, every) in zip(texts, part.column(chars).to_pylist(), found)]
                    columns[chars] = pa.array(sizes, kind)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    if redacted:
        return documents.mapInArrow(clean, documents.schema)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, secret_spans string")
