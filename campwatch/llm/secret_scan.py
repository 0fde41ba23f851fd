"""Secrets in texts, by one deterministic automaton for all rules.

The rules' patterns, read backwards, are compiled together by subset
construction and minimisation into one array of transitions. One pass over the
bytes of a text, from its end, marks every byte at which a match of some rule
begins; from the leftmost mark after the last match, the rule's own automaton
finds the longest end. So no mark is followed in vain, and the work is linear in
the text for any input. Patterns are ASCII, so bytes of UTF-8 never match by
halves; spans are given in code points.

A match is dropped if the part after ``head`` has fewer than ``least`` code
points; it still uses up its text, as matches are found before they are judged.

Defined cases: null and empty texts have no spans; spans of different rules may
overlap; rows repeated with one id are separate rows and a null id stays; a text
of any length is scanned whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.llm import _kernels as K
from campwatch.llm import automaton as A
from campwatch.llm._common import table


class Rule(NamedTuple):
    """A match is ``head`` followed by ``tail``, which has ``least`` code points or more."""

    kind: str
    head: str
    tail: str
    least: int


# The rules that every scan holds, in order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", r"AKIA[A-Z0-9]+", 20),
    # Runs of 24 and more are the runs of [0-9a-f]+ that are long enough, and mark fewer bytes.
    Rule("hex", "", r"[0-9a-f]{24,}", 24),
)
# Public formats of credentials.
MORE = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", r"[0-9A-Za-z_-]+", 35),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("userinfo", r"://[A-Za-z0-9._~%-]+:", r"[A-Za-z0-9._~%!-]+@", 4),
)
SPANS = "row_id long, spans array<struct<kind:string,start:long,end:long>>"


class Scanner:
    """Spans of ``rules`` in texts that lie one after another in a buffer."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.starts = A.starts_of(tuple(r.head + r.tail for r in rules))
        self.whole = [A.anchored(r.head + r.tail) for r in rules]
        self.heads = [A.anchored(r.head) if r.head else None for r in rules]

    def spans(self, raw: np.ndarray, offs: np.ndarray) -> list[list[tuple[str, int, int]]]:
        """Per text: kind, start and end in code points, by start, then by rule."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offs) - 1)]
        at, marks = A.scan_backwards(self.starts, raw, offs)
        if not len(at):
            return out
        data = raw.tobytes()
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        found = []
        for number, rule in enumerate(self.rules):
            begins = at[(marks >> number) & 1 == 1]
            i = 0
            while i < len(begins):
                begin = int(begins[i])
                text = int(np.searchsorted(offs, begin, "right")) - 1
                stop = int(offs[text + 1])
                end = A.longest(self.whole[number], data, begin, stop)
                head = self.heads[number]
                tail = A.longest(head, data, begin, end) if head else begin
                if end - tail >= rule.least:
                    found.append((text, begin, number, end))
                i = max(i + 1, int(np.searchsorted(begins, end)))
        for text, begin, number, end in sorted(found):
            base = int(chars[offs[text]])
            out[text].append((self.rules[number].kind, int(chars[begin]) - base, int(chars[end]) - base))
        return out


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            raw, offs = K.buffers(batch.column(1))
            for a, b in K.slices(offs):
                found = scanner.spans(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                rows = [[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, kind)], ["row_id", "spans"])

    return run


def scan(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, spans`` of every row; spans are sorted by start, then by rule.

    The automata are compiled here, once, and sent along; no row is shuffled.
    """
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_scan(Scanner(tuple(rules))), SPANS)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(list(kinds)))

    base = of(*(r.kind for r in BASE))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return scan(table(spark, sf_dir, "documents")).select(
        F.col("row_id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def _op11_sql() -> str:
    """Matches with the gaps before them: their running lengths are the positions."""
    parts = []
    for number, rule in enumerate(BASE + MORE):
        tail = "[0-9a-f]+" if rule.kind == "hex" else rule.tail
        pattern = f"(?s)(.*?)({rule.head}({tail}))".replace("'", "''")
        parts.append(f"""SELECT r, {number} AS rule, '{rule.kind}' AS kind,
    list_transform(regexp_extract_all(body, '{pattern}', 1), lambda x: length(x)) AS gap,
    list_transform(regexp_extract_all(body, '{pattern}', 2), lambda x: length(x)) AS size,
    list_transform(regexp_extract_all(body, '{pattern}', 3), lambda x: length(x) >= {rule.least}) AS good FROM d""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
found AS ({" UNION ALL ".join(parts)}),
one AS (SELECT r, rule, kind, unnest(gap) AS gap, unnest(size) AS size, unnest(good) AS good, generate_subscripts(gap, 1) AS i
        FROM found),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, rule ORDER BY i) AS stop FROM one),
told AS (SELECT r, rule, kind, (stop - size)::BIGINT AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span
         FROM placed WHERE good),
per AS (SELECT r, {counts}, string_agg(span, ',' ORDER BY start, rule) AS spans,
               string_agg(span, ',' ORDER BY start, rule) FILTER (rule < {len(BASE)}) AS base
        FROM told GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)"""


OP11_SQL = _op11_sql()
