"""Streams with timers against the same work on tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from campwatch.functions import taxonomy as T
from campwatch.operators import cascade, conversation
from campwatch.streaming import live, stateful

BASE = 1_700_000_000_000


@pytest.fixture
def feed(spark, tmp_path):
    """Write batches as files, run a stream over them one by one; its rows and its last state count."""

    def run(batches, schema, of, name):
        import os

        folder, progress = tmp_path / name, []
        os.makedirs(folder)
        names = [f.split()[0] for f in schema.split(", ")]
        for i, rows in enumerate(batches):
            part = folder / f"{i:03d}.json"
            part.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
            os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
        stateful.use_state(spark)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        out = of(source.withColumn("ts", F.timestamp_millis("ms")))
        query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
        query.processAllAvailable()
        progress = query.recentProgress
        query.stop()
        return spark.table(name).collect(), progress[-1]["stateOperators"][0]["numRowsTotal"]

    return run


def _dealt(rng, rows, batches, spread_ms):
    """Rows in batches, each late or early by up to ``spread_ms``; a last row far ahead moves the watermark."""
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(spread_ms))
    size = -(-len(order) // batches)
    return [order[i : i + size] for i in range(0, len(order), size)]


def test_the_last_burst_leaves_by_timer_and_idle_state_goes(spark, feed):
    rng = random.Random(5)
    rows, schema = [], "conv long, ms long, sender string, text string"
    for conv in (1, 2, 3):
        at = BASE
        for _ in range(40):
            at += rng.choice([700, 1500, 3900, 4001, 9000])
            rows.append((conv, at, rng.choice(["a", "b"]), rng.choice(["hi", "send it", "one two three four", "one two three four five"])))
    ahead = [(99, max(r[1] for r in rows) + 600_000, "a", "end")]
    got, state = feed([*_dealt(rng, rows, 6, 5000), ahead, []], schema, lambda s: stateful.bursts(s, "conv", "sender", "ts", "text"), "bursts_timed")
    table = spark.createDataFrame(rows, schema)
    want = conversation.reassemble(table, "conv", "sender", "ms", "text", ["ms"])
    key = lambda r: (r["conv"], r["sender"], r["text"], r["start_ms"], r["end_ms"], r["n_messages"])
    assert sorted(map(key, got)) == sorted(map(key, want.collect()))
    # All that is left is the row that moved the watermark.
    alone, _ = feed([ahead], schema, lambda s: stateful.bursts(s, "conv", "sender", "ts", "text"), "bursts_alone")
    assert alone == [] and 0 < state <= 4


def test_recordings_close_on_time_and_on_low_memory(spark, feed):
    rng = random.Random(6)
    rows, schema = [], "session long, ms long, seq long, text string, low boolean"
    for session in (1, 2):
        at = BASE
        for i in range(30):
            at += rng.choice([5_000, 60_000, 130_000])
            rows.append((session, at, i, f"r{i}", rng.random() < 0.15))
    ahead = [(99, max(r[1] for r in rows) + 2 * stateful.IDLE_MS, 0, "end", False)]
    got, state = feed([*_dealt(rng, rows, 5, 8000), ahead, []], schema, lambda s: stateful.recordings(s, "session", "ts", "seq", "text", "low"), "recordings_timed")
    want = live.recording_sessions(spark.createDataFrame(rows, schema), "session", "ms", "text", "low").collect()
    key = lambda r: (r["session"], r["part"], r["payload"], r["early_termination"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and state <= 4


def test_session_flags_of_a_stream_are_those_of_the_table(spark, feed):
    rng = random.Random(7)
    lines = ["act now, this is urgent", "please wire the money today", "do not tell anyone", "hello there", "pay with gift cards or be arrested",
             "your account is suspended", "stay calm, take your time", "act immediately or you lose everything"]
    rows, schema = [], "conv long, ms long, turn long, text string"
    for conv in (1, 2, 3):
        for turn in range(12):
            rows.append((conv, BASE + turn * 4000, turn, rng.choice(lines)))
    ahead = [(99, BASE + 10_000_000, 0, "hello")]
    got, _ = feed([*_dealt(rng, rows, 5, 9000), ahead, []], schema, lambda s: stateful.session_flags(s, "conv", "turn", "ts", "text"), "flags_timed")
    table = spark.createDataFrame(rows, schema)
    want = cascade.session(cascade.scan(table), "conv", "turn").collect()
    key = lambda r: (r["conv"], r["turn"], list(r["prior"]), [(c["tactic"], round(c["base"], 9)) for c in r["candidates"]])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert any(T.URGENCY in r["prior"] for r in got)
