"""Reading scores out of language-model replies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from campwatch.functions import taxonomy as T

ROW = "struct<tactic_id:string,confidence:string,rationale:string>"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _last_before(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the last mark at or before each position; -1 if there is none."""
    return np.searchsorted(marks, at, "right") - 1


def balanced(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first bracketed value of each text begins and ends (-1: it has none, or stays open).

    The first ``[`` or ``{`` opens it, and brackets of its own kind outside
    strings count. A quote opens a string; inside one, a quote after an odd number
    of backslashes is part of it. So such a quote always leaves the text inside a
    string and any other one turns the state over: the state at a place is that
    after the last such quote (or the opening), turned over as often as there were
    other quotes since. Depths are running sums.
    """
    texts = len(offs) - 1
    marks = np.flatnonzero((raw == 91) | (raw == 123))
    first = np.searchsorted(marks, offs[:-1])
    begin = np.where(first < len(marks), marks[np.minimum(first, max(len(marks) - 1, 0))] if len(marks) else -1, -1)
    begin = np.where((begin >= 0) & (begin < offs[1:]), begin, -1)
    own = np.flatnonzero(begin >= 0)
    end = np.full(texts, -1, np.int64)
    if not len(own):
        return begin, end
    starts, stops = begin[own], offs[1:][own]

    def inside(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that lie in a value's text, and the number of that value."""
        of = _last_before(starts, places)
        fine = (of >= 0) & (places < stops[of])
        return places[fine], of[fine]

    quotes, of = inside(np.flatnonzero(raw == 34))
    plain = np.flatnonzero(raw != 92)
    run = quotes - 1 - plain[np.maximum(_last_before(plain, quotes - 1), 0)]
    escaped = run % 2 == 1
    turns = np.concatenate([[0], np.cumsum(~escaped)])
    # Setters: the opening of each value (outside), and escaped quotes (inside).
    setters = np.concatenate([starts, quotes[escaped]])
    values = np.concatenate([np.zeros(len(starts), np.int64), np.ones(int(escaped.sum()), np.int64)])
    order = np.argsort(setters)
    setters, values = setters[order], values[order]
    before = turns[np.searchsorted(quotes, setters, "right")]
    sign = np.where(raw[starts] == 91, 91, 123)
    places, of = inside(np.flatnonzero((raw == 91) | (raw == 93) | (raw == 123) | (raw == 125)))
    last = _last_before(setters, places)
    text = (values[last] + turns[np.searchsorted(quotes, places, "right")] - before[last]) % 2 == 0
    counts = text & ((raw[places] == sign[of]) | (raw[places] == sign[of] + 2))
    places, of = places[counts], of[counts]
    depth = np.cumsum(np.where(raw[places] == sign[of], 1, -1))
    # A value's own depth: less what the values before it left open.
    head = np.searchsorted(places, starts)
    base = np.concatenate([[0], depth])[head]
    closed = np.flatnonzero(depth == base[of])
    done, at = np.unique(of[closed], return_index=True)
    end[own[done]] = places[closed[at]] + 1
    return begin, end


#: Bytes of replies looked through at once; a longer reply is looked through alone.
SLICE = 1 << 22


@F.arrow_udf(StringType())
def extract_json(reply: pa.Array) -> pa.Array:
    """The first balanced JSON array or object in a reply; null if there is none."""
    reply = reply.fill_null("").cast(pa.large_string())
    _, offsets, data = reply.buffers()
    offs = np.frombuffer(offsets, np.int64)[reply.offset : reply.offset + len(reply) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    parts, at = [], 0
    while at < len(reply):
        to = min(len(reply), max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE, "right")) - 1))
        own, base = raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        begin, end = balanced(own, base)
        sizes = np.where(end >= 0, end - begin, 0)
        new = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(begin - new[:-1], sizes) + np.arange(new[-1])
        text = pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(new.astype(np.int64)), pa.py_buffer(own[take].tobytes()))
        parts.append(pc.if_else(pa.array(end >= 0), text, pa.scalar(None, pa.large_string())).cast(pa.string()))
        at = to
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())



def refinements(reply_json: Column) -> Column:
    """The stricter reader: a list or ``{results: [...]}`` only, rationales cut at 200 characters.

    Null if nothing usable is left.
    """
    single = F.startswith(reply_json, F.lit("{")) & F.from_json(reply_json, "struct<results:string>")["results"].isNull()
    rows = F.transform(
        assessments(F.when(~single, reply_json)),
        lambda r: r.withField("rationale", F.substring(r["rationale"], 1, 200)),
    )
    return F.when(F.size(rows) > 0, rows)


def joint_confidence(scam_logits: Column, tactic_logits: Column, order: tuple[str, ...]) -> Column:
    """Array of ``tactic, confidence``: probability of a scam times that of the tactic.

    Without tactic logits every tactic gets the probability of a scam.
    """
    scam = softmax(scam_logits)[1]
    own = softmax(tactic_logits)
    rows = [
        F.struct(F.lit(t).alias("tactic"), F.when(tactic_logits.isNull(), scam).otherwise(scam * F.try_element_at(own, F.lit(i + 1))).alias("confidence"))
        for i, t in enumerate(order)
        if t != "none"
    ]
    return F.filter(F.array(*rows), lambda r: r["confidence"].isNotNull())


def assessments(reply_json: Column) -> Column:
    """Array of ``tactic, confidence, rationale`` from a list, ``{results: [...]}`` or one object.

    Unknown tactics and non-numbers are dropped, confidences clamped to [0, 1];
    of several rows for one tactic the last counts.
    """
    listed = F.when(F.startswith(reply_json, F.lit("[")), F.from_json(reply_json, f"array<{ROW}>"))
    wrapped = F.from_json(reply_json, f"struct<results:array<{ROW}>>")["results"]
    single = F.from_json(reply_json, ROW)
    rows = F.coalesce(listed, wrapped, F.when(single["tactic_id"].isNotNull(), F.array(single)), F.array().cast(f"array<{ROW}>"))
    known = F.filter(rows, lambda r: r["tactic_id"].isin(*T.TACTICS) & r["confidence"].rlike(NUMBER))
    cleaned = F.transform(
        known,
        lambda r: F.struct(
            r["tactic_id"].alias("tactic"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["confidence"].cast("double"))).alias("confidence"),
            F.nullif(F.trim(r["rationale"]), F.lit("")).alias("rationale"),
        ),
    )
    return F.filter(
        cleaned,
        lambda r, i: ~F.exists(
            F.slice(cleaned, i + 2, F.greatest(F.lit(1), F.size(cleaned))), lambda later: later["tactic"] == r["tactic"]
        ),
    )


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)
