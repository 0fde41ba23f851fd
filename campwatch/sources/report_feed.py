"""Report feeds as a data source: ``spark.read.format("report_feed")`` and ``readStream``.

A folder (or file) of lines ``kind,value,category,epoch,token``. Files are read in
ranges of bytes, and a line belongs to the range in which it begins, so one large
file is many tasks. Rows say where their line begins. Malformed lines are
dropped and counted: with option ``counts`` set to ``true`` each range also gives
one row without fields whose ``malformed`` is the number of lines it dropped.

A stream's offset is, per file, how many bytes have been read, always up to the
end of a line; lines that are added later are the next batch. Options: ``path``,
``counts``, ``range_bytes``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from campwatch.sources.feeds import KINDS, NUMBER

SCHEMA = (
    "pattern_kind string, pattern_value string, category string, reported_epoch double, "
    "device_attestation_token string, file string, line_start long, malformed long"
)
RANGE_BYTES = 8 << 20
_NUMBER = re.compile(NUMBER)


@dataclass
class Range(InputPartition):
    """Lines that begin in bytes [start, stop) of a file; none goes beyond ``end``."""

    file: str
    start: int
    stop: int
    end: int


def parse(line: str) -> tuple | None:
    """The fields of a line, None if it is malformed."""
    parts = [p.strip(" ") for p in line.split(",")]
    if len(parts) != 5 or parts[0] not in KINDS or not _NUMBER.search(parts[3]):
        return None
    return (*parts[:3], float(parts[3]), parts[4])


def _store(path: str):
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _sizes(path: str) -> dict[str, int]:
    """Files of a feed and their sizes; hidden files are not part of it."""
    from pyarrow import fs

    store, base = _store(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no feed: {path} does not exist")
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[:1] not in "._"}


def _ranges(file: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(file, at, min(at + size, end), end) for at in range(start, end, size)]


def _lines(stream, own: Range) -> Iterator[tuple[int, str]]:
    """Lines that begin in a range, with where they begin."""
    at = own.start
    stream.seek(max(at - 1, 0))
    rest, place = b"", max(at - 1, 0)
    # A range that begins within a line leaves it to the range before.
    skipping = at > 0
    while True:
        chunk = stream.read(min(1 << 20, own.end - place - len(rest)))
        rest, ended = rest + chunk, not chunk
        lines = rest.split(b"\n")
        rest = lines.pop()
        if ended and rest:
            lines, rest = [*lines, rest], b""
        for line in lines:
            if skipping:
                skipping = False
            elif place >= own.stop:
                return
            else:
                yield place, line.decode("utf-8", "replace").rstrip("\r")
            place += len(line) + 1
        if ended or (place >= own.stop and not skipping):
            return


class _Reading:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("a report feed needs a path")
        self.path = options["path"]
        self.counts = str(options.get("counts", "false")).lower() == "true"
        self.size = int(options.get("range_bytes", RANGE_BYTES))

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _store(self.path)
        bad = 0
        with store.open_input_file(partition.file) as stream:
            for at, line in _lines(stream, partition):
                line = line.strip(" ")
                if not line or line.startswith("#"):
                    continue
                fields = parse(line)
                if fields is None:
                    bad += 1
                else:
                    yield (*fields, partition.file, at, 0)
        if self.counts:
            yield (None, None, None, None, None, partition.file, partition.start, bad)


class FeedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, size in _sizes(self.path).items() for r in _ranges(file, 0, size, self.size)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return super().read(partition) if partition.file else iter(())


class FeedStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        store, _ = _store(self.path)
        return {"files": json.dumps({f: n for f, size in _sizes(self.path).items() if (n := self._whole(store, f, size))})}

    @staticmethod
    def _whole(store, file: str, size: int) -> int:
        """Bytes of a file up to the end of its last whole line."""
        with store.open_input_file(file) as stream:
            at = size
            while at > 0:
                low = max(0, at - (1 << 16))
                stream.seek(low)
                cut = stream.read(at - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                at = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        had, now = json.loads(start["files"]), json.loads(end["files"])
        return [r for file, size in now.items() for r in _ranges(file, had.get(file, 0), size, self.size)]

    def commit(self, end: dict) -> None:
        pass


class ReportFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(ReportFeed)
