"""WARC archives with revisit records, and a merged capture index.

Captures with the same payload (``least`` bytes or more) are stored once: the
one with the largest id is the response, the others are revisit records that
refer to it. Every task writes gzipped archives of bounded size into the shared
folder, each under its final name only once it is complete.

Reading goes through the archives again, each opened by its name in a task, and
writes sorted runs of up to RUN_ROWS index entries. An external merge orders
them: a bounded sample of keys splits the order (URL key, timestamp, id, archive,
offset) into ranges of about RANGE_ROWS entries, which no two entries tie in, so
a URL with very many captures is spread over tasks; each run is cut at the
splitters, its sorted segments go to the task of their range, and a loser tree
merges them there. More than FAN_IN runs are first merged FAN_IN at a time, round
by round, each group in wider ranges of as many entries, so no tree has more
leaves and no segment gets tiny. The result, partition after partition, is the
globally ordered capture history.

Pages without a capture time get one from their id, which lies between EPOCH and
SPAN seconds after it whatever the id.

Defined cases: null html is an empty payload, null url an empty one, a null id
or time counts as 0 for the time; a null id is never referred to, and captures
of one payload that all have null ids are all responses; rows repeated with the
referred id are all responses; ids of any size and sign are kept as they are; an
empty table gives an empty result; other columns are ignored, whatever their
names. One page must fit a record in memory.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campwatch.llm._common import PLACE, forget, fresh_path, marks, place_columns, placed, saved, table

LEAST = 1000
ROLL = 8 << 20
LEVEL = 4
#: Capture time of a page without one: this, plus its id in seconds modulo SPAN.
EPOCH, SPAN = 1_704_067_200, 1_000_000_000
#: Entries in one range of the merge, about, and sampled keys per range.
RANGE_ROWS, KEYS_PER_RANGE = 50_000, 20
#: Most keys that reach the driver; beyond it ranges get longer.
MOST_KEYS = 200_000
#: Entries a task sorts at once into a run, runs that one merge takes, and archives a task reads.
RUN_ROWS, FAN_IN, ARCHIVES = 200_000, 256, 8
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = (
    "url_key string, captured long, page_id long, archive string, offset long, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long"
)
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
KINDS = [pa.string() if "string" in c else pa.int64() for c in ENTRY.split(", ")]
RUN = ENTRY + ", run long"


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, no scheme or ``www``, lower case."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    tail = f":{port}" if port not in (None, 80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(labels)) + tail + ")" + (parts.path or "/") + query


def assign(pages: DataFrame, least: int = LEAST, time_col: str | None = None) -> DataFrame:
    """Each page with its payload, digest and the id it revisits (null: a response).

    ``time_col`` holds capture times in epoch seconds, if there are any. Owners
    of payloads are found on digests alone; what comes back to the pages, by
    their place in the table, is one row per revisit.
    """
    rows, place = placed(pages)
    when = F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(SPAN))
    if time_col is not None:
        when = F.pmod(F.coalesce(F.col(time_col).cast("long"), F.lit(0)), F.lit(4 * EPOCH))
    rows = rows.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        when.cast("long").alias("captured"),
        *place_columns(place),
    ).withColumns(
        {"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")}
    )
    slim = saved(rows.where(F.col("size") >= least).select("digest", "size", "page_id", *PLACE), "page-digests")
    owners = (
        slim.groupBy("digest", "size")
        .agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"))
        .where("copies > 1 AND owner IS NOT NULL")
        .drop("copies")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("owner"))
    refers = marks(slim.join(owners, ["digest", "size"]).where(other), "owner")
    forget(slim)
    return rows.withColumn("refers_to", refers(PLACE)).drop(*PLACE)


def _record(page_id, url: str, html: str, digest: str, size: int, captured: int, refers_to) -> bytes:
    name = "null" if page_id is None else str(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += f"Content-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        kind, extra = "response", ""
        block += html.encode()
    else:
        kind = "revisit"
        extra = f"WARC-Profile: {IDENTICAL}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}>\r\n"
        f"WARC-Date: {datetime.fromtimestamp(captured, UTC):%Y-%m-%dT%H:%M:%SZ}\r\n"
        f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%~')}\r\n"
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}\r\n"
        f"{extra}Content-Type: application/http; msgtype=response\r\n"
        f"Content-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def _writer(folder: str):
    """Write batches as archives; yields the name and size of each finished one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        held: list[bytes] = []
        records = size = 0

        def flush():
            name = f"{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{path}/.{name}", compression=None) as out:
                for x in held:
                    out.write(x)
            store.move(f"{path}/.{name}", f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records])], ["archive", "records"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                held.append(packer.compress(_record(*row)) + packer.flush())
                records, size = records + 1, size + len(held[-1])
                if size >= ROLL:
                    yield flush()
                    held, records, size = [], 0, 0
        if held:
            yield flush()

    return run


def write_archives(assigned: DataFrame, folder: str) -> DataFrame:
    """Write all records under ``folder``; returns the archives of committed tasks.

    A task that is run again leaves archives that no committed row names; only
    named archives are read.
    """
    spark = assigned.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(conf).mkdirs(target)
    cols = assigned.select("page_id", "url", "html", "digest", "size", "captured", "refers_to")
    return saved(cols.mapInArrow(_writer(folder), "archive string, records long"), "archives")


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of an archive."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, out, pos = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if pos >= len(view):
                raise ValueError("archive is cut short")
            part = view[pos : pos + 65_536]
            out.append(unpack.decompress(part))
            pos += len(part)
        yield at, b"".join(out)
        at = pos - len(unpack.unused_data)


def parse(record: bytes) -> tuple:
    """Entry fields of one record, the payload's digest and size taken from what is stored."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    page = re.fullmatch(r"<urn:page:(.*)>", fields["WARC-Record-ID"])[1]
    when = datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    refers = None
    if kind == "revisit":
        refers = int(re.fullmatch(r"<urn:page:(.*)>", fields["WARC-Refers-To"])[1])
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    else:
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != named:
            raise ValueError(f"payload of page {page} does not match its digest")
    return (
        url_key(fields.get("WARC-Target-URI", "")), int(when.timestamp()),
        None if page == "null" else int(page), kind, size, named, refers,
    )


def _order(entry: tuple) -> tuple:
    """Sort key of an entry; archive and offset make it unique."""
    return entry[0], entry[1], entry[2] is None, entry[2] or 0, entry[3], entry[4]


def _read(folder: str):
    """Sorted runs of the entries of a task's archives, numbered by task and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}") as source:
                    content = source.read_buffer()
                for offset, record in members(content):
                    key, when, page, *rest = parse(record)
                    held.append((key, when, page, name, offset, *rest))
                    if len(held) >= RUN_ROWS:
                        yield from _run_batches(sorted(held, key=_order), number)
                        held, number = [], number + 1
        yield from _run_batches(sorted(held, key=_order), number)

    return run


def _run_batches(rows: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
    for o in range(0, len(rows), 10_000):
        part = _batch(rows[o : o + 10_000])
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([number] * part.num_rows, pa.int64())], [*NAMES, "run"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES
    )


def splitters(runs: DataFrame, entries: int, range_rows: int = RANGE_ROWS) -> list[tuple]:
    """Keys that cut the order into ranges of about ``range_rows`` entries each."""
    ranges = min(-(-entries // range_rows), MOST_KEYS // KEYS_PER_RANGE)
    if ranges < 2:
        return []
    share = min(1.0, ranges * KEYS_PER_RANGE / entries)
    drawn = F.pmod(F.xxhash64(F.lit(8), "archive", "offset"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    found = runs.where(drawn).select(*NAMES[:5]).toArrow().to_pylist()
    keys = sorted(_order(tuple(r.values())) for r in found)
    return [keys[i * len(keys) // ranges] for i in range(1, ranges)] if len(keys) >= ranges else keys


def _segments(shared):
    """Cut runs at the splitters: a segment is what one run has in one range, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            runs, ranges, parts = [], [], []
            for *row, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = bisect.bisect_right(cuts, _order(row))
                # A batch may hold the end of one run and the beginning of the next.
                if not parts or at != ranges[-1] or number != runs[-1]:
                    runs.append(number)
                    ranges.append(at)
                    parts.append([])
                parts[-1].append(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs, pa.int64()), pa.array(ranges, pa.int32()), pa.array([_pack(p) for p in parts], pa.binary())],
                ["run", "range", "segment"],
            )

    return run


def _pack(rows: list[tuple]) -> bytes:
    batch, sink = _batch(rows), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(segment: pa.Scalar) -> Iterator[tuple]:
    """Entries of a segment, made into rows a few at a time."""
    with pa.ipc.open_stream(segment.as_buffer()) as stream:
        for batch in stream:
            for o in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(o, 256).columns), strict=True)


class LoserTree:
    """Merge sorted runs; a node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [self._next(r) for r in self.runs]
        k = max(len(runs), 1)
        self.losers = [-1] * k
        self.top = -1
        for leaf in range(len(runs)):
            self._seat(leaf)

    def _next(self, run):
        entry = next(run, None)
        return None if entry is None else (_order(entry), entry)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x[0], a) < (y[0], b)

    def _seat(self, player: int) -> None:
        """Bring a leaf in while the tree fills: it waits at the first empty node."""
        node = (player + len(self.losers)) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = player
                return
            if self._before(self.losers[node], player):
                self.losers[node], player = player, self.losers[node]
            node //= 2
        self.top = player

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.top] is not None:
            player = self.top
            yield self.heads[player][1]
            self.heads[player] = self._next(self.runs[player])
            node = (player + len(self.losers)) // 2
            while node > 0:
                if self._before(self.losers[node], player):
                    self.losers[node], player = player, self.losers[node]
                node //= 2
            self.top = player


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the segments of one range; they stay packed until the tree reaches them."""
    segments = [x for batch in batches for x in batch.column(1)]
    out = []
    for row in LoserTree([_unpack(x) for x in segments]):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _merge_group(key: tuple, cell: pa.Table) -> Iterator[pa.RecordBatch]:
    """What a group of runs has in one range, as a piece of the group's own run."""
    out = []
    for row in LoserTree([_unpack(x) for x in cell.column("segment")]):
        out.append(row)
        if len(out) == 10_000:
            yield from _run_batches(out, key[0].as_py())
            out = []
    yield from _run_batches(out, key[0].as_py())


def merge_round(runs: DataFrame, cuts: list[tuple], fan_in: int, dense: DataFrame | None = None) -> DataFrame:
    """Every ``fan_in`` runs become one; ``dense`` numbers them from 0 if their own numbers have gaps."""
    cut = runs.mapInArrow(_segments(runs.sparkSession.sparkContext.broadcast(cuts)), "run long, range int, segment binary")
    if dense is not None:
        cut = cut.join(dense, "run").select(F.col("dense").alias("run"), "range", "segment")
    group = F.floor(F.col("run") / fan_in).cast("long").alias("run")

    def merged(key: tuple, cell: pa.Table) -> pa.Table:
        return pa.Table.from_batches([*_merge_group(key, cell)])

    return cut.select(group, "range", "segment").groupBy("run", "range").applyInArrow(merged, RUN)


def capture_history(archives: DataFrame, folder: str, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Entries of all records in the named archives, globally ordered by URL key and time."""
    spark = archives.sparkSession
    told = archives.agg(F.sum("records").alias("n"), F.count("*").alias("archives")).first()
    entries, tasks = told["n"] or 0, max(1, min(told["archives"], max(spark.sparkContext.defaultParallelism, -(-told["archives"] // ARCHIVES))))
    names = archives.select("archive").distinct().repartition(tasks, "archive")
    runs = saved(names.mapInArrow(_read(folder), RUN), "capture-runs")
    cuts = splitters(runs, entries, range_rows)
    # One row a run, so RUN_ROWS times fewer than entries.
    numbers = runs.select("run").distinct().withColumn("dense", F.row_number().over(Window.orderBy("run")) - 1)
    many = numbers.count()
    dense = None
    if many > fan_in:
        # Segments, which are small rows, are what meets the dense numbers.
        dense = saved(numbers, "run-numbers")
    while many > fan_in:
        groups = -(-many // fan_in)
        ranges = max(1, -(-entries // (groups * range_rows)))
        merged = saved(merge_round(runs, cuts[:: max(1, len(cuts) // ranges)], fan_in, dense), "capture-runs")
        forget(runs)
        runs, many, dense = merged, groups, None
    cut = runs.mapInArrow(_segments(spark.sparkContext.broadcast(cuts)), "run long, range int, segment binary")
    return cut.select("range", "segment").repartitionById(len(cuts) + 1, "range").mapInArrow(_merge, ENTRY)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    archives = write_archives(assign(table(spark, sf_dir, "pages")), folder)
    if archives.isEmpty():
        return spark.createDataFrame([], ENTRY).select(*_RESULT)
    return capture_history(archives, folder).select(*_RESULT)


_RESULT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
     o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM o
"""
