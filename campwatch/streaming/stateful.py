"""Keyed streams in event-time order, with timers: bursts, recording sessions, session flags.

Every row waits in state until the watermark has passed it, so the rows of a key
are taken in order whatever batch they came in, and what is given out equals the
result over a table, but for rows that come later than the watermark allows
(Spark drops them). Timers close what no later row can change, and end the state
of idle keys. The session needs the RocksDB state store (``use_state``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from campwatch.functions import taxonomy as T
from campwatch.functions import text as X
from campwatch.operators import cascade
from campwatch.operators.conversation import BURST_MS, SHORT_WORDS

SESSION_MS = 300_000
#: After this time without a region a session's clock is forgotten.
IDLE_MS = 3_600_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Choose the state store that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Takes a key's rows in the order of ``at`` (milliseconds), then of their other columns.

    ``step`` takes one row (a tuple in the order of ``columns``, ``at`` first) and
    returns what to remember. ``close`` is told the watermark, returns what to
    remember (None ends the key's memory) and when it wants to be asked again.
    """

    columns: tuple[str, ...]
    waiting_schema: str
    memory_schema: str
    out: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.memory = handle.getValueState("memory", self.memory_schema)

    def step(self, key, row: tuple, memory: tuple | None, out: list[tuple]) -> tuple | None:
        raise NotImplementedError

    def settle(self, key, memory: tuple | None, now: int, out: list[tuple]) -> tuple[tuple | None, int | None]:
        return memory, None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            own = [tuple(None if x is None else x for x in r) for r in frame[list(self.columns)].astype(object).itertuples(index=False, name=None)]
            own = [(int(r[0]), *(list(x) if hasattr(x, "tolist") else x for x in r[1:])) for r in own]
            if own:
                self.waiting.appendList(own)
                first = min(own)[0] if first is None else min(first, min(own)[0])
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()) if self.waiting.exists() else [], key=self.rank)
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        had = self.memory.get() if self.memory.exists() else None
        memory, out = None if had is None else tuple(had), []
        for row in due:
            memory = self.step(key, row, memory, out)
        memory, again = self.settle(key, memory, now, out)
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if memory is not None:
            self.memory.update(memory)
        elif had is not None:
            self.memory.clear()
        wanted = [t for t in (again, later[0][0] if later else None) if t is not None]
        if wanted:
            self.handle.registerTimer(max(min(wanted), now + 1))
        if out:
            yield pd.DataFrame(out, columns=list(self.out))

    @staticmethod
    def rank(row: tuple) -> tuple:
        return tuple((x is None, x) if not isinstance(x, list) else () for x in row)

    def close(self) -> None:
        pass


class Bursts(InOrder):
    """Turns of a conversation: a turn ends when a message cannot continue it, or when time has run out for one."""

    columns = ("at", "sender", "text")
    waiting_schema = "at long, sender string, text string"
    memory_schema = "sender string, text string, start_ms long, end_ms long, n long, words long"
    out = ("conv", "sender", "text", "start_ms", "end_ms", "n_messages")

    def step(self, key, row, memory, out):
        at, sender, text = row
        text = text or ""
        if memory and sender == memory[0] and at - memory[3] <= BURST_MS and memory[5] <= SHORT_WORDS:
            return (sender, f"{memory[1]} {text}".strip(), memory[2], at, memory[4] + 1, len(text.split()))
        if memory:
            out.append((key[0], *memory[:5]))
        return (sender, text, at, at, 1, len(text.split()))

    def settle(self, key, memory, now, out):
        if memory is None:
            return None, None
        if memory[5] > SHORT_WORDS or now > memory[3] + BURST_MS:
            out.append((key[0], *memory[:5]))
            return None, None
        return memory, memory[3] + BURST_MS + 1


class Recordings(InOrder):
    """Parts of a recording session: text since the last snapshot, given out every five minutes or on low memory."""

    columns = ("at", "seq", "text", "low")
    waiting_schema = "at long, seq long, text string, low boolean"
    memory_schema = "first long, last long, part long, texts array<string>, low boolean"
    out = ("session", "part", "payload", "early_termination")

    def step(self, key, row, memory, out):
        at, _, text, low = row
        first, last, part, texts, early = memory or (at, at, 0, [], False)
        texts = list(texts or [])
        if texts and (early or (at - first) // SESSION_MS > (last - first) // SESSION_MS):
            self._give(key, part, texts, early, out)
            part, texts, early = part + 1, [], False
        return (first, at, part, [*texts, text or ""], bool(early or low))

    @staticmethod
    def _give(key, part, texts, early, out):
        out.append((key[0], part, "\n---\n".join(texts), early))

    def settle(self, key, memory, now, out):
        if memory is None:
            return None, None
        first, last, part, texts, early = memory
        border = first + ((last - first) // SESSION_MS + 1) * SESSION_MS
        if texts and (early or now >= border - 1):
            self._give(key, part, list(texts), early, out)
            memory = (first, last, part + 1, [], False)
        if not memory[3]:
            return (None, None) if now >= last + IDLE_MS else (memory, last + IDLE_MS)
        return memory, border


class Flagged(InOrder):
    """What earlier turns of a conversation flagged. Flags never expire.

    ``calm`` and ``urgent`` are a turn's tactics without and with urgency flagged
    before it, all that earlier turns can change about which tactics there are.
    """

    columns = ("at", "turn", "text", "calm", "urgent")
    waiting_schema = "at long, turn long, text string, calm array<string>, urgent array<string>"
    memory_schema = "pressed boolean, flags array<string>"
    out = ("conv", "turn", "at", "text", "prior")

    def step(self, key, row, memory, out):
        at, turn, text, calm, urgent = row
        pressed, flags = memory or (False, [])
        out.append((key[0], turn, at, text, sorted(flags)))
        found = urgent if pressed else calm
        return (bool(pressed or T.URGENCY in (calm or [])), sorted({*flags, *(found or [])}))


def _run(rows: DataFrame, processor: InOrder, key: str, kind: str, schema: str, ts: str, delay: str) -> DataFrame:
    use_state(rows.sparkSession)
    timed = rows.withWatermark(ts, delay).groupBy(key)
    return timed.transformWithStateInPandas(processor, f"{key} {kind}, {schema}", "append", "eventTime")


def _at(ts: str):
    return F.unix_millis(F.col(ts)).alias("at")


def bursts(messages: DataFrame, conv: str, sender: str, ts: str, text: str, delay: str = "10 seconds") -> DataFrame:
    """``conv, sender, text, start_ms, end_ms, n_messages`` of each turn, once nothing can continue it."""
    rows = messages.select(F.col(conv).alias("conv"), F.col(ts).alias("ts"), _at(ts), F.col(sender).alias("sender"), X.normalize(F.col(text)).alias("text"))
    schema = "sender string, text string, start_ms long, end_ms long, n_messages long"
    return _run(rows, Bursts(), "conv", dict(rows.dtypes)["conv"], schema, "ts", delay)


def recordings(regions: DataFrame, session: str, ts: str, seq: str, text: str, low: str, delay: str = "10 seconds") -> DataFrame:
    """``session, part, payload, early_termination`` of each part, when its time is up or memory was low."""
    rows = regions.select(
        F.col(session).alias("session"), F.col(ts).alias("ts"), _at(ts), F.col(seq).cast("long").alias("seq"),
        F.col(text).alias("text"), F.coalesce(F.col(low), F.lit(False)).alias("low"),
    )
    return _run(rows, Recordings(), "session", dict(rows.dtypes)["session"], "part long, payload string, early_termination boolean", "ts", delay)


def session_flags(turns: DataFrame, conv: str, turn: str, ts: str, text: str, delay: str = "10 seconds") -> DataFrame:
    """Candidates of each turn with what earlier turns flagged, as ``cascade.session`` gives them for a table.

    ``conv, turn, at, text, prior, candidates`` and the scan's own columns.
    """
    named = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(ts).alias("ts"), F.col(text).alias("text"))
    scanned = cascade.scan(named)

    def tactics(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.transform("candidates", lambda c: c["tactic"]))

    calm = tactics(cascade.refine(scanned), "calm")
    both = tactics(cascade.refine(calm, F.array(F.lit(T.URGENCY))), "urgent")
    rows = both.select("conv", "ts", _at("ts"), "turn", "text", "calm", "urgent")
    schema = "turn long, at long, text string, prior array<string>"
    told = _run(rows, Flagged(), "conv", dict(rows.dtypes)["conv"], schema, "ts", delay)
    return cascade.refine(cascade.scan(told), F.col("prior"))
