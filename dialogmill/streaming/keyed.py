"""Stateful operators whose result depends on the order of events, not of arrival (Z4, Z6).

Both keep, per conversation, what all rows up to the watermark have made of it (settled for good, as no earlier row can come) and the rows
after it, in event-time order. A batch's rows go among those, rows that the watermark has passed are folded into the settled part, and
the result is the settled part with the waiting rows folded over it. So whatever order rows arrive in, within the lateness that the watermark
allows the result is that of a fold in event order; the state is bounded by the settled part and the rows of one lateness; and a batch's work
depends on its own keys alone. Rows older than the watermark are dropped by Spark.

The state lives in RocksDB: ``with keyed_state(spark)`` around the start of the query.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for queries started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _InEventOrder(StatefulProcessor):
    """The waiting rows, as a list state of tuples that begin with (event time in microseconds, place)."""

    waiting_schema: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def close(self) -> None:
        pass

    def due(self, batches: Iterator[pd.DataFrame], timer) -> tuple[list[tuple], list[tuple], list[tuple]]:
        """Rows that waited before, rows now settled, and rows that wait from now on; each in event order. A timer is set for the end of the wait."""
        old = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        new = [tuple(None if x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else x for x in r) for b in batches for r in b[self.columns].itertuples(index=False, name=None)]
        rows = sorted(old + [self.of(r) for r in new], key=lambda r: r[:2])
        passed = timer.getCurrentWatermarkInMs() * 1000
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        if rest:
            if new or ready:
                self.waiting.put(rest)
            self.handle.registerTimer(rest[-1][0] // 1000 + 1)
        elif old:
            self.waiting.clear()
        return old, ready, rest

    def of(self, row: tuple) -> tuple:
        return row


# ---- Z4: the queue of down-voted answers ----


class _Queue:
    """Running nets by turn, the first down-vote by prompt and the last recovery of a conversation."""

    def __init__(self, nets: dict[int, int], rows: dict[str, tuple[int, int, str]], recovered: int):
        self.nets, self.rows, self.recovered = nets, rows, recovered

    def fold(self, votes: list[tuple]) -> _Queue:
        out = _Queue(dict(self.nets), dict(self.rows), self.recovered)
        for _, vote_id, turn, vote, prompt, response in votes:
            out.nets[turn] = out.nets.get(turn, 0) + vote
            if vote == -1:
                out.rows.setdefault(prompt, (vote_id, turn, response))
            elif out.nets[turn] > 0:
                out.recovered = max(out.recovered, vote_id)
        return out

    def shown(self) -> dict[str, tuple]:
        return {p: (turn, response, vote_id, self.recovered > vote_id) for p, (vote_id, turn, response) in self.rows.items()}


class _QueueProcessor(_InEventOrder):
    waiting_schema = "ts long, vote_id long, turn long, vote int, prompt string, response string"
    columns = ["micros", "vote_id", "turn", "vote", "prompt", "response"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.nets = handle.getMapState("nets", "turn long", "net long")
        self.rows = handle.getMapState("rows", "prompt string", "vote_id long, turn long, response string")
        self.recovered = handle.getValueState("recovered", "vote_id long")

    def of(self, row: tuple) -> tuple:
        return (int(row[0]), int(row[1]), int(row[2]), int(row[3]), row[4] or "", row[5])

    def _changes(self, key: tuple, batches: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        old, ready, rest = self.due(batches, timer)
        nets = {k[0]: v[0] for k, v in self.nets.iterator()} if self.nets.exists() else {}
        rows = {k[0]: tuple(v) for k, v in self.rows.iterator()} if self.rows.exists() else {}
        settled = _Queue(nets, rows, self.recovered.get()[0] if self.recovered.exists() else -1)
        before = settled.fold(old).shown()
        after = settled.fold(ready)
        if ready:
            for turn, net in after.nets.items():
                if nets.get(turn) != net:
                    self.nets.updateValue((turn,), (net,))
            for prompt, row in after.rows.items():
                if prompt not in rows:
                    self.rows.updateValue((prompt,), row)
            if after.recovered != settled.recovered:
                self.recovered.update((after.recovered,))
        changed = [(key[0], p, *r) for p, r in after.fold(rest).shown().items() if before.get(p) != r]
        if changed:
            yield pd.DataFrame(changed, columns=["conv_id", "prompt", "turn", "response", "vote_id", "resolved"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._changes(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._changes(key, iter(()), timerValues)


def downvoted(votes: DataFrame, late: str = "1 day") -> DataFrame:
    """Changed rows of the queue (conv_id, prompt, turn, response, vote_id, resolved) as votes (vote_id, conv_id, turn, vote, ts, prompt, response) come;
    the latest row of a (conv_id, prompt) counts. Votes count in order of (ts, vote_id). A null prompt is an empty one; a null
    conversation is one of its own; votes without a time, an id, a turn or a value of 1 or -1 don't count."""
    rows = votes.filter("ts is not null and vote_id is not null and turn is not null and vote in (1, -1)").withWatermark("ts", late).selectExpr("conv_id", "ts", "unix_micros(ts) as micros", "vote_id", "cast(turn as long) as turn", "cast(vote as int) as vote", "prompt", "response")
    return rows.groupBy("conv_id").transformWithStateInPandas(_QueueProcessor(), "conv_id long, prompt string, turn long, response string, vote_id long, resolved boolean", "update", "eventTime")


# ---- Z6: session memory ----


class _Memory:
    """Messages so far, those of the window (turn, role, line), the rolling summary and the facts by name."""

    def __init__(self, total: int, window: list[tuple], summary: str, facts: dict[str, list[str]]):
        self.total, self.window, self.summary, self.facts = total, window, summary, facts

    def fold(self, rows: list[tuple], window: int, after: int, long: int, keep: int, values: int) -> _Memory:
        out = _Memory(self.total, list(self.window), self.summary, {k: list(v) for k, v in self.facts.items()})
        for _, turn, role, line, facts in rows:
            out.total += 1
            out.window.append((turn, role, line))
            for name, value in facts:
                held = out.facts.setdefault(name, [])
                if value not in held:
                    out.facts[name] = [*held, value][-values:]
            if len(out.window) > max(after, window):
                n = len(out.window) - window
                new = " | ".join(line or "" for _, role, line in out.window[:n] if role in ("user", "assistant"))
                joined = out.summary + "\n" + new
                out.summary = new if not out.summary else "…" + joined[-keep:] if len(out.summary) > long and len(joined) > keep else joined
                out.window = out.window[n:]
        return out


class _MemoryProcessor(_InEventOrder):
    waiting_schema = "ts long, turn long, role string, line string, facts array<string>"
    columns = ["micros", "turn", "role", "line", "facts"]

    def __init__(self, idle_ms: int | None, **sizes: int):
        self.idle_ms, self.sizes = idle_ms, sizes

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.total = handle.getValueState("total", "n long, last long")
        self.window = handle.getListState("window", "turn long, role string, line string")
        self.summary = handle.getValueState("summary", "text string")
        self.facts = handle.getMapState("facts", "name string", "vals array<string>")

    def of(self, row: tuple) -> tuple:
        return (int(row[0]), int(row[1]), row[2], row[3], [] if row[4] is None else list(row[4]))

    def _read(self) -> tuple[_Memory, int]:
        total, last = self.total.get() if self.total.exists() else (0, -1)
        window = [tuple(r) for r in self.window.get()] if self.window.exists() else []
        facts = {k[0]: list(v[0]) for k, v in self.facts.iterator()} if self.facts.exists() else {}
        return _Memory(total, window, self.summary.get()[0] if self.summary.exists() else "", facts), last

    def _step(self, key: tuple, batches: Iterator[pd.DataFrame], timer, input_: bool) -> Iterator[pd.DataFrame]:
        _, ready, rest = self.due(batches, timer)
        settled, last = self._read()
        pairs = lambda rows: [(*r[:4], [f.split("\t", 1) for f in r[4]]) for r in rows]
        now = settled.fold(pairs(ready), **self.sizes)
        if ready:
            last = ready[-1][0] // 1000
            self.total.update((now.total, last))
            self.window.put(now.window)
            self.summary.update((now.summary,))
            for name, vals in now.facts.items():
                if settled.facts.get(name) != vals:
                    self.facts.updateValue((name,), (vals,))
        if self.idle_ms is not None and not rest:
            if last + self.idle_ms < timer.getCurrentWatermarkInMs():  # idle for longer: forgotten
                for state in (self.total, self.window, self.summary, self.facts):
                    state.clear()
                return
            self.handle.registerTimer(last + self.idle_ms + 1)
        if input_:
            shown = now.fold(pairs(rest), **self.sizes)
            yield pd.DataFrame({
                "conv_id": [key[0]], "total_turns": [shown.total], "window_turns": [[t for t, _, _ in shown.window]], "rolling_summary": [shown.summary],
                "facts": [[f"{k}: {', '.join(v)}" for k, v in sorted(shown.facts.items())]],
            })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step(key, rows, timerValues, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, iter(()), timerValues, False)


def session_memory(messages: DataFrame, window: int = 8, after: int = 12, long: int = 1500, keep: int = 1800, values: int = 5, late: str = "10 minutes", idle_seconds: int | None = None) -> DataFrame:
    """Per conversation, whenever messages come: total_turns, window_turns, rolling_summary and facts ("name: value, value"), as the batch
    operators give them for the messages so far in order of (ts, turn). ``messages`` (conv_id, turn, role, line, facts, ts) come from
    ``with_lines_and_facts``; those without a time or a turn don't count. A conversation whose last message is more than ``idle_seconds`` behind the watermark is forgotten."""
    rows = messages.filter("ts is not null and turn is not null").withWatermark("ts", late).selectExpr("conv_id", "ts", "unix_micros(ts) as micros", "cast(turn as long) as turn", "role", "line", "facts")
    sizes = dict(window=window, after=after, long=long, keep=keep, values=values)
    out = "conv_id long, total_turns long, window_turns array<long>, rolling_summary string, facts array<string>"
    return rows.groupBy("conv_id").transformWithStateInPandas(_MemoryProcessor(idle_seconds * 1000 if idle_seconds is not None else None, **sizes), out, "update", "eventTime")
