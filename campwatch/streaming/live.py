"""Structured Streaming forms: flags of a transcript stream, the incident view, conversation rings (``stateful`` has the timed ones)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from campwatch.operators import cascade, grounding, incidents
from campwatch.operators.conversation import RING
from campwatch.streaming import view

SESSION_MS = 300_000


def analyze(transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """Flags of every message of a stream or table; a message needs nothing but itself."""
    return grounding.flags(cascade.candidate_rows(cascade.scan(transcripts), keys), keys)


def record_incidents(transcripts: DataFrame, incident: str, ts: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the incident view in ``folder`` up to date with a stream: each micro-batch adds its own changes."""

    def write(batch: DataFrame, number: int) -> None:
        view.apply(incidents.detections(batch, incident, ts), folder, number)

    return transcripts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def incident_view(spark, folder: str, k: int = incidents.K_FLOOR) -> DataFrame:
    """Links that at least ``k`` distinct incidents report, as of the batches so far."""
    return incidents.exposable(view.links(spark, folder), k)


def ring_stream(turns: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Per micro-batch and conversation: turns seen so far, and the newest RING of them."""
    kind = dict(turns.dtypes)
    schema = f"`{conv}` {kind[conv]}, turn_count long, window array<string>"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values(turn)
        kept = [*kept, *rows[text].tolist()][-RING:]
        n += len(rows)
        state.update((n, kept))
        yield pd.DataFrame({conv: [key[0]], "turn_count": [n], "window": [kept]})

    return turns.groupBy(conv).applyInPandasWithState(
        fold, schema, "n long, kept array<string>", "update", GroupStateTimeout.NoTimeout
    )


def recording_sessions(regions: DataFrame, session: str, ts_ms: str, text: str, low_memory: str) -> DataFrame:
    """Text gathered since a session's last snapshot, given out at five minutes or on low memory.

    ``session, part, payload, early_termination`` of a table: the clock of a
    session runs from its first region, and a low-memory region closes its part
    early. What no event closes is given out as the last part.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(session).orderBy(ts_ms, "seq")
    first = F.min(ts_ms).over(Window.partitionBy(session))
    timed = regions.withColumn("__tick", F.floor((F.col(ts_ms) - first) / SESSION_MS))
    closed = F.coalesce(F.lag(low_memory).over(w), F.lit(False)) | (F.col("__tick") > F.coalesce(F.lag("__tick").over(w), F.col("__tick")))
    parts = timed.withColumn("part", F.sum(F.when(closed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(ts_ms, "seq", F.col(text).alias("t"))
    return parts.groupBy(session, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda p: p["t"]), "\n---\n").alias("payload"),
        F.bool_or(low_memory).alias("early_termination"),
    )
