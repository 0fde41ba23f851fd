"""Sequential state machines over keyed, ordered rows.

A machine is a step function ``(state, row) -> (state, outputs)`` and a first
state. The same machine runs over batch tables (rows sorted inside hash
partitions of the key and streamed through, so a key's history never has to fit
in memory) and over streams (``applyInPandasWithState``, one state per key that
never expires).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Machine:
    """``inputs`` are the columns a step reads, ``outputs`` and ``state`` are DDL."""

    inputs: tuple[str, ...]
    outputs: str
    state: str
    first: tuple
    step: Callable[[tuple, tuple], tuple[tuple, tuple]]

    def names(self) -> list[str]:
        return [c.split()[0] for c in self.outputs.split(",")]


def run_batch(df: DataFrame, machine: Machine, key: str, order: list[str]) -> DataFrame:
    """``df``'s key and order columns with the machine's outputs, row by row in order."""
    kept = [key, *[c for c in order if c != key]]
    extra = [c for c in machine.inputs if c not in kept]
    rows = df.select(*kept, *extra).repartition(key).sortWithinPartitions(*kept)
    places = [(kept + extra).index(c) for c in machine.inputs]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", " + machine.outputs

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, started = machine.first, None, False
        for batch in batches:
            keys = batch.column(0).to_pylist()
            values = zip(*[batch.column(p).to_pylist() for p in places], strict=True)
            out = []
            for own, row in zip(keys, values, strict=True):
                if not started or own != current:
                    state, current, started = machine.first, own, True
                state, result = machine.step(state, row)
                out.append(result)
            columns = zip(*out, strict=True) if out else [[]] * len(machine.names())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), *(pa.array(c) for c in columns)],
                kept + machine.names(),
            )

    return rows.mapInArrow(fold, schema)


def run_stream(stream: DataFrame, machine: Machine, key: str, order: str) -> DataFrame:
    """The machine over a stream: rows of a micro-batch are taken in order, state is kept."""
    types = dict(stream.dtypes)
    schema = f"`{key}` {types[key]}, `{order}` {types[order]}, " + machine.outputs

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else machine.first
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for values in rows[list(machine.inputs)].itertuples(index=False, name=None):
            now, result = machine.step(tuple(now), values)
            out.append(result)
        state.update(tuple(now))
        done = pd.DataFrame(out, columns=machine.names())
        done.insert(0, order, rows[order].to_numpy())
        done.insert(0, key, k[0])
        yield done

    return stream.groupBy(key).applyInPandasWithState(
        fold, schema, machine.state, "append", GroupStateTimeout.NoTimeout
    )


def _ewma(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    n, mean, var, fast = state
    (x,) = row
    n += 1
    if n == 1:
        return (n, x, var, x), (False,)
    fast = 0.3 * x + (1 - 0.3) * fast
    changed = n > 25 and abs(fast - mean) > 2.5 * max(var, 1e-6) ** 0.5
    if not changed:
        delta = x - mean
        mean, var = mean + 0.02 * delta, (1 - 0.02) * var + 0.02 * delta**2
    return (n, mean, var, fast), (changed,)


#: Change points of a signal: a fast average leaves the slow one's spread after a warm-up.
EWMA = Machine(
    ("value",), "changepoint boolean", "n long, mean double, var double, fast double",
    (0, 0.0, 1e-6, 0.0), _ewma,
)


def _bucket(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    tokens, last, started = state
    (now,) = row
    if started:
        tokens = min(5.0, tokens + (now - last) * (1 / 60))
    allowed = tokens >= 1.0
    return (tokens - 1.0 if allowed else tokens, now, True), (allowed,)


#: Rate limit by key: five messages, one more a minute; refused calls refill too.
TOKEN_BUCKET = Machine(
    ("ts",), "allowed boolean", "tokens double, last double, started boolean", (5.0, 0.0, False), _bucket
)


def _debounce(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    last, started = state
    (now,) = row
    accepted = not started or now - last >= 250
    return ((now, True) if accepted else state), (accepted,)


#: Accept an event 250 ms or more after the last accepted one.
DEBOUNCE = Machine(("ts_ms",), "accepted boolean", "last long, started boolean", (0, False), _debounce)

LEVELS = ("nominal", "elevated", "severe", "critical_compound")
ENTER = (None, 0.70, 0.85, 0.95)
MARGIN = 0.05


def _thermal(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    (at,) = state
    heat, fallback = row
    if heat >= ENTER[3] or (fallback and heat >= ENTER[2]):
        target = 3
    else:
        target = sum(heat >= e for e in ENTER[1:3])
    if target > at:
        at = target
    elif target < at and not (fallback and at == 3) and heat <= ENTER[at] - MARGIN:
        at -= 1
    return (at,), (LEVELS[at],)


#: Thermal level: up at once, down one rung at a time and only past a margin.
THERMAL = Machine(("heat", "fallback"), "level string", "at long", (0,), _thermal)


def policies(spark) -> DataFrame:
    """What each thermal level allows. No detection threshold depends on it."""
    notice = (
        "Running in reduced-confidence mode because this phone is overheating -- "
        "verify anything important independently."
    )
    rows = [
        ("nominal", 2, "4bit", 1.0, None), ("elevated", 2, "4bit", 1.5, None),
        ("severe", 2, "2bit", 2.0, None), ("critical_compound", 0, "unavailable", float("inf"), notice),
    ]
    return spark.createDataFrame(
        rows, "level string, max_tier int, tier2_variant string, bar_multiplier double, notice string"
    )


def wake_reasons(payment_app, flagged_call, motion):
    """Ordered reasons to wake, from the last known value of each input."""
    return F.array_compact(
        F.array(
            F.when(payment_app, "payment_app_foreground"),
            F.when(flagged_call, "flagged_incoming_call"),
            F.when(motion, "motion_anomaly_changepoint"),
        )
    )
