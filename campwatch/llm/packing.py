"""Packing by concatenate and cut.

All documents, each closed by an end token, are one long row of ids, and
sequence ``s`` is its window ``[s * length, (s + 1) * length)``. The first pass
encodes every document once into a written table and leaves, per partition,
the number of tokens; prefix sums of these totals give each partition its
global offset. The second pass cuts every document at window boundaries; a
document across a boundary leaves one record per window. Only the last sequence
can be short, so padding is less than one sequence in all.

Defined cases: null text is empty; an empty document is its end token alone;
repeated rows and null ids are packed like any other row; an empty table gives
no pieces; other columns are ignored. Special strings inside a text become
their special ids, as is the tokenizer's default. One number per partition
reaches the driver.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.llm import _kernels as K
from campwatch.llm._common import saved, table
from campwatch.llm.token_counts import Memo

LENGTH, END = 2048, 1
#: Spaces next to other white space, where a word is not encoded by itself.
_TIGHT = re.compile(r"\s\s|^\s|\s$")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


#: How byte-level BPE splits a text before merging (a fixed public value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Ids of a byte-level BPE tokenizer file, remembered by word.

    Its pre-tokenizer never joins the character before a single inner space
    with that space, so words are encoded on their own. Merges run in a second
    library on the same vocabulary, whose calls cost less for single words; it
    is used only where ids are merge ranks, and a probe must agree.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as file:
            spec = json.load(file)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level tokenizers without a normalizer are supported")
        self.library = Tokenizer.from_file(path)
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t["content"] for t in spec["added_tokens"]]
        encode = self._ranked(spec) or self._whole
        self.memo = Memo(lambda word: np.array(encode(word), self.width).tobytes())
        self.inner = Memo(lambda word: np.array(encode(" " + word), self.width).tobytes())

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _ranked(self, spec: dict):
        try:
            import tiktoken
        except ModuleNotFoundError:
            return None
        byte = _byte_of_char()
        ranks = {
            bytes(byte[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(made):
            return None
        fast = tiktoken.Encoding(
            "own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        probe = "It's  1st\n\t\u00e9\u65e5\U0001f600 don't, words 12345!\u3000 x\x00 "
        return fast if fast(probe) == self._whole(probe) else None

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self._whole(text), self.width)
        words = _BETWEEN.split(text) if _TIGHT.search(text) else text.split(" ")
        found = chain([self.memo[words[0]]], map(self.inner.__getitem__, words[1:]))
        return np.frombuffer(b"".join(found), self.width)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def _encode_all(path: str, end: int):
    names = ["part", "row_id", "place", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, place = encoder(path), TaskContext.get().partitionId(), 0
        close = np.array([end], own.width).tobytes()
        for batch in batches:
            rows, at, size = ([], [], []), 0, 0
            for i in range(batch.num_rows):
                ids = own.ids(batch.column(1)[i].as_py() or "").tobytes() + close
                n = len(ids) // int(own.width[2])
                for into, value in zip(rows, (place, n, ids), strict=True):
                    into.append(value)
                place, size = place + n, size + len(ids)
                if size > 4 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(rows[0]), pa.int32()), batch.column(0).slice(at, len(rows[0])),
                         pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                         pa.array(rows[2], pa.binary())], names,
                    )
                    at, rows, size = i + 1, ([], [], []), 0

    return run


def _cut_all(bases, total: int, length: int, width: str):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"]
    short = total % length
    padding = 0 if short & (short - 1) == 0 else length - short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = bases.value
        for batch in batches:
            place = base[batch.column(0).to_numpy()] + batch.column(2).to_numpy()
            n = batch.column(3).to_numpy()
            first, last = place // length, (place + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            step = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + step
            begin = np.maximum(sequence * length, place[row])
            stop = np.minimum((sequence + 1) * length, place[row] + n[row])
            texts = [np.frombuffer(x.as_buffer(), width).astype("<u4") for x in batch.column(4)]
            crc = [
                zlib.crc32(texts[r][a:b])
                for r, a, b in zip(row, begin - place[row], stop - place[row], strict=True)
            ]
            final = (sequence + 1) * length > total
            columns = [
                batch.column(1).take(pa.array(row)), begin - place[row], stop - begin, crc, n[row],
                sequence, begin - sequence * length, np.where(final, padding, 0),
            ]
            yield pa.RecordBatch.from_arrays(
                [columns[0], *(pa.array(c, pa.int64()) for c in columns[1:])], names
            )

    return run


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end: int = END,
) -> DataFrame:
    """One row per piece of a document: where it comes from and where it goes.

    ``padding`` is what the piece's sequence is padded by: the last sequence is
    filled up to ``length`` unless it already ends at a power of two.
    """
    spark = df.sparkSession
    width = ByteEncoder(tokenizer).width
    encoded = saved(
        df.select(F.col(id_col).cast("long").alias("row_id"), text_col).mapInArrow(
            K.tidy(_encode_all(tokenizer, end)), "part int, row_id long, place long, n long, ids binary"
        ),
        "tokens",
    )
    totals = dict(encoded.groupBy("part").agg(F.max(F.col("place") + F.col("n"))).collect())
    sums = np.zeros(max(totals, default=0) + 2, np.int64)
    for part, n in totals.items():
        sums[part + 1] = n
    bases = np.cumsum(sums)
    cut = _cut_all(spark.sparkContext.broadcast(bases), int(bases[-1]), length, width)
    return encoded.mapInArrow(
        cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, padding long",
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
