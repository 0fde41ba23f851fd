"""Audio columns: resampling, log-mel features and energy segments.

A text's bytes, padded to whole blocks, are the samples of an 8-bit PCM WAV
file. The stored file is read back, resampled by a polyphase filter, cut into
overlapping frames and passed through a mel filterbank; a two-threshold
(hysteresis) switch on frame energy gives the time spans of active segments.
Features are pooled to one fixed shape per row and stored in Arrow files as a
column of fixed-shape tensors next to the spans; ``read_features`` reads them.

A recording is worked through in blocks of frames whose borders do not depend
on anything but its length: besides its bytes, one number per frame is held.
All values depend on the row's bytes alone.

Defined cases: null text is empty; an empty text is one block of padding;
repeated rows are described each, and equal texts give equal rows; an empty
table gives an empty result; other columns are ignored, whatever their names.
One recording must fit a WAV file (4 GB) and a task's memory.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.llm._common import fresh_path, saved, table

PAD, BLOCK = 32, 192
RATE, UP, DOWN = 24_000, 2, 3
FRAME, HOP, MELS, BINS = 256, 128, 24, 8
TAPS = 16
FRAMES_AT_ONCE = 1 << 13
#: Rows of one file of features, and bytes of the recordings they describe.
ROWS_PER_FILE, BYTES_PER_FILE = 20_000, 64 << 20
TENSOR = pa.fixed_shape_tensor(pa.float32(), (BINS, MELS))
STORED = pa.schema(
    [("row_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
     ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
     ("tensor", TENSOR), ("span_start", pa.list_(pa.float64())), ("span_end", pa.list_(pa.float64()))]
)
COLUMNS = (
    "row_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, tensor array<float>, "
    "span_start array<double>, span_end array<double>"
)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    head = struct.pack(
        "<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16,
        1, 1, rate, rate, 1, 8, b"data", len(payload),
    )
    return head + payload + b"\0" * (len(payload) % 2)


def from_wav(stored: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at < len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return stored[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def pad(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


@lru_cache
def _filters() -> np.ndarray:
    """Polyphase components of a windowed-sinc low-pass: taps x phases."""
    out = np.zeros((TAPS + 1, UP))
    for phase in range(UP):
        shift = phase * DOWN / UP
        t = np.arange(TAPS + 1) - TAPS / 2 - (shift - int(shift))
        h = np.sinc(t * UP / DOWN) * (0.54 + 0.46 * np.cos(np.pi * np.clip(t / (TAPS / 2 + 1), -1, 1)))
        out[:, phase] = h / h.sum()
    return out.astype(np.float32)


def resample(samples: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """By UP/DOWN: each output is a short dot product with its phase's filter.

    Outputs of the groups ``first`` to ``last`` of DOWN samples (default: all);
    the recording is continued by its first and last sample.
    """
    last = len(samples) // DOWN if last is None else last
    near = np.arange(first * DOWN - TAPS // 2, last * DOWN + TAPS // 2 + DOWN)
    x = samples[np.clip(near, 0, len(samples) - 1)]
    if x.dtype == np.uint8:
        x = (x.astype(np.float32) - 128) / 128
    windows, h = np.lib.stride_tricks.sliding_window_view(x, TAPS + 1), _filters()
    out = np.empty((last - first, UP), np.float32)
    for phase in range(UP):
        out[:, phase] = windows[phase * DOWN // UP :: DOWN][: last - first] @ h[:, phase]
    return out.ravel()


@lru_cache
def _bank(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and triangular mel filters (bins x mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1) / (rate / 2) * (FRAME // 2)
    k = np.arange(FRAME // 2 + 1)[:, None]
    rise = (k - edges[:-2]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)
    fall = (edges[2:] - k) / np.maximum(edges[2:] - edges[1:-1], 1e-9)
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int) -> Iterator[np.ndarray]:
    """Log energies (dB) of overlapped frames of the resampled, differenced signal, block by block."""
    window, bank = _bank(rate)
    total = len(samples) // DOWN * UP
    frames = max((total - FRAME) // HOP + 1, 1)
    for o in range(0, frames, FRAMES_AT_ONCE):
        many = min(FRAMES_AT_ONCE, frames - o)
        begin, end = o * HOP, min((o + many - 1) * HOP + FRAME, total)
        # One output more to the left, for the difference; the first sample's is 0.
        first = max(begin - 1, 0) // UP
        y = resample(samples, first, -(-end // UP))
        y = np.diff(y, prepend=y[:1])[begin - first * UP : end - first * UP]
        if len(y) < FRAME:
            y = np.pad(y, (0, FRAME - len(y)))
        part = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:many] * window)
        power = part.real**2 + part.imag**2
        yield (10 * np.log10(power @ bank + 1e-6)).astype(np.float32)


def segments(energy: np.ndarray) -> np.ndarray:
    """Frame spans [start, end): on above the upper threshold, off below the lower."""
    mean, spread = float(energy.mean()), float(energy.std())
    mark = np.where(energy > mean + 0.5 * spread, 1, np.where(energy < mean - 0.25 * spread, -1, 0))
    at = np.where(mark != 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(at)
    on = np.concatenate(([0], (last >= 0) & (mark[last] == 1), [0])).astype(np.int8)
    step = np.diff(on)
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)


class Pool:
    """Means over BINS equal spans of time, of frames that come block by block."""

    def __init__(self, frames: int):
        self.cut = np.arange(BINS) * frames // BINS
        self.upto = np.maximum((np.arange(BINS) + 1) * frames // BINS, self.cut + 1)
        self.sums, self.at = np.zeros((BINS, MELS)), 0

    def add(self, mel: np.ndarray) -> None:
        for i in range(BINS):
            a, b = max(self.cut[i] - self.at, 0), min(self.upto[i] - self.at, len(mel))
            if a < b:
                self.sums[i] += mel[a:b].sum(0, dtype=np.float64)
        self.at += len(mel)

    def means(self) -> np.ndarray:
        return (self.sums / (self.upto - self.cut)[:, None]).astype(np.float32)


def features(payload: bytes, rate: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pooled log-mel tensor (BINS x MELS), time spans in seconds, number of frames."""
    samples, to = np.frombuffer(payload, np.uint8), rate * UP // DOWN
    frames = max((len(samples) // DOWN * UP - FRAME) // HOP + 1, 1)
    pooled, energy = Pool(frames), []
    for mel in log_mel(samples, to):
        pooled.add(mel)
        energy.append(mel.mean(1))
    return pooled.means(), segments(np.concatenate(energy)) * (HOP / to), frames


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, size, n, media = 0, 0, [], []
        for i in range(batch.num_rows):
            raw = (batch.column(1)[i].as_py() or "").encode()
            n.append(len(raw))
            media.append(to_wav(pad(raw)))
            size += len(media[-1])
            if size > 8 << 20 or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(media, pa.binary())],
                    ["row_id", "n_bytes", "media"],
                )
                at, size, n, media = i + 1, 0, [], []


def describe(row_id, n_bytes: int, media: bytes) -> tuple:
    """One row of STORED, from a stored recording."""
    payload, rate = from_wav(media)
    tensor, spans, frames = features(payload, rate)
    active = float((spans[:, 1] - spans[:, 0]).sum())
    feature = f"{frames} frames; {len(spans)} segments, {active:.3f} s; mel " + " ".join(
        f"{v:.1f}" for v in tensor.mean(0)
    )
    return (
        row_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
        len(media), hashlib.sha256(media).hexdigest(), feature, tensor.ravel(), spans[:, 0], spans[:, 1],
    )


def as_tensors(rows: list[np.ndarray]) -> pa.ExtensionArray:
    """A fixed-shape Arrow tensor array (BINS x MELS)."""
    flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32), pa.float32())
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, BINS * MELS))


def stored_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(STORED)
    arrays = [
        as_tensors(list(c)) if f.name == "tensor" else pa.array(c, f.type)
        for c, f in zip(columns, STORED, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=STORED)


def _writer(folder: str):
    """Describe stored recordings into Arrow files; yields the name of each finished one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        rows, held = [], 0

        def flush():
            name = f"{uuid.uuid4().hex}.arrow"
            batch = stored_batch(rows)
            with store.open_output_stream(f"{path}/.{name}") as sink, pa.ipc.new_file(
                sink, STORED, options=pa.ipc.IpcWriteOptions(compression="zstd")
            ) as out:
                out.write_batch(batch)
            store.move(f"{path}/.{name}", f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

        for batch in batches:
            for i, n, media in zip(*batch.columns, strict=True):
                rows.append(describe(i.as_py(), n.as_py(), media.as_py()))
                # Spans are lists of the recording's length, about a value for so many bytes.
                held += media.as_buffer().size if media.is_valid else 0
                if len(rows) == ROWS_PER_FILE or held >= BYTES_PER_FILE:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return run


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}") as source:
                    held = pa.ipc.open_file(source)
                    if held.schema.field("tensor").type != TENSOR:
                        raise ValueError(f"{name} holds no {BINS} x {MELS} tensors")
                    for i in range(held.num_record_batches):
                        own = held.get_batch(i)
                        tensor = own.column("tensor").storage
                        arrays = [
                            tensor.cast(pa.list_(pa.float32())) if f.name == "tensor" else own.column(f.name)
                            for f in STORED
                        ]
                        yield pa.RecordBatch.from_arrays(arrays, STORED.names)

    return run


def write_features(stored: DataFrame, folder: str) -> DataFrame:
    """Describe recordings (``row_id, n_bytes, media``) into files under ``folder``.

    Returns the files of committed tasks; a task that is run again leaves files
    that no committed row names, and only named files are read.
    """
    spark = stored.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(conf).mkdirs(target)
    return saved(stored.select("row_id", "n_bytes", "media").mapInArrow(_writer(folder), "file string"), "features")


def read_features(files: DataFrame, folder: str) -> DataFrame:
    """The stored rows; ``tensor`` holds BINS x MELS floats (row-major)."""
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(_reader(folder), COLUMNS)


def audio_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a WAV column, read it back, store its features and read these.

    ``span_start`` and ``span_end`` are the seconds of active segments.
    """
    stored = saved(
        df.select(F.col(id_col).cast("long").alias("row_id"), text_col).mapInArrow(
            _store, "row_id long, n_bytes long, media binary"
        ),
        "media",
    )
    folder = fresh_path(df.sparkSession, "tensors")
    return read_features(write_features(stored, folder), folder)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_columns(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")
