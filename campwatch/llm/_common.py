"""Plumbing shared by the corpus operators: inputs, written tables, whitespace."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; a temporary one only where none is named (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name a folder that all executors share in spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="campwatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/campwatch/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and values that
    depend on the physical layout (partition ids, row positions) are frozen.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``saved`` table that nothing lazy reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/campwatch/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


#: Where a row lies: two hashes of its file's path (96 bits together) and its number in the file.
PLACE = ["__file", "__check", "__row"]


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def placed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with each row's place in its files, a key that no re-read changes, and the names of its columns.

    A table read straight from Parquet has places already. Anything else is
    written once first, since its row order is not frozen otherwise.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "_metadata" in df.columns:
        df = saved(df, "placed")
    meta, names = df.metadataColumn("_metadata"), free_names(df, PLACE)
    path = meta["file_path"]
    return df.select(
        "*", F.xxhash64(path).alias(names[0]), F.hash(F.lit(5), path).alias(names[1]), meta["row_index"].alias(names[2])
    ), names


def place_columns(place: list[str] | None) -> list[Column]:
    """The place columns of a table under the names that operators use, if it has them."""
    return [column(c).alias(name) for c, name in zip(place or [], PLACE, strict=bool(place))]


#: Rows of a file that one file of marks covers; a task holds a few of them, 12 bytes a marked row.
MARK_ROWS = 1 << 18


def _mark_name(path: str, file: int, check: int, block: int) -> str:
    return f"{path}/{file & (1 << 64) - 1:016x}{check & (1 << 32) - 1:08x}-{block}"


def _write_marks(folder: str, span: int) -> Callable:
    """Write rows sorted by place as one file of marks per block of a table's file; yields their sizes.

    A file is written under a name of its own and renamed, so an attempt that
    dies leaves nothing half done and one that runs again changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            rest = pa.array(whole.column(2).to_numpy() % span, pa.int32())
            out = pa.table([rest, whole.column(3)], names=["row", "value"])
            name, own = _mark_name(path, *key), f"{path}/_{uuid.uuid4().hex}"
            with store.open_output_stream(own) as sink, pa.ipc.new_file(sink, out.schema) as writer:
                writer.write_table(out)
            try:
                store.move(own, name)
            except OSError:
                # Some stores refuse to replace a file: an earlier attempt has written the same marks.
                if store.get_file_info(name).type == fs.FileType.NotFound:
                    raise
                store.delete_file(own)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(out)], pa.int64())], ["marked"])

        for batch in batches:
            file, check, row = (batch.column(i).to_numpy() for i in range(3))
            for start, end, at in _stretches(file, check, row // span):
                if held and at != key:
                    yield flush()
                key = at
                held.append(batch.slice(start, end - start))
        if held:
            yield flush()

    return run


def _stretches(file: np.ndarray, check: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int, tuple]]:
    """Where neighbouring rows lie in one block of one file: from, to, and which block."""
    if not len(file):
        return
    new = (file[1:] != file[:-1]) | (check[1:] != check[:-1]) | (block[1:] != block[:-1])
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(file)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield start, end, (int(file[start]), int(check[start]), int(block[start]))


def marks(marked: DataFrame, value: str | None = None, span: int = MARK_ROWS) -> Callable[[list[str]], Column]:
    """Marks on rows of a ``placed`` table, written once and looked up while the table is scanned.

    ``marked`` has the columns of ``PLACE``, each place once, and a long ``value``
    (without one, a mark is 0). Returns a function from the names of a table's
    place columns to the mark of its row, null where it has none.

    Marks are shuffled by file and block and lie in the shared folder, a file
    for a block. The lookup is given places alone and opens the files of the
    blocks it scans, so the rows themselves, whole texts included, are neither
    joined nor shuffled, however many marks there are.
    """
    spark = marked.sparkSession
    folder = fresh_path(spark, "marks")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    mark = F.lit(0) if value is None else F.col(value)
    block = F.floor(F.col(PLACE[2]) / span)
    dealt = marked.select(*PLACE, mark.cast("long").alias("value")).repartition(*PLACE[:2], block)
    written = dealt.sortWithinPartitions(*PLACE).mapInArrow(_write_marks(folder, span), "marked long")
    written.agg(F.sum("marked")).first()

    def look(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)

        @lru_cache(maxsize=4)
        def load(file: int, check: int, block: int) -> tuple[np.ndarray, np.ndarray]:
            name = _mark_name(path, file, check, block)
            if store.get_file_info(name).type == fs.FileType.NotFound:
                return np.zeros(0, np.int32), np.zeros(0, np.int64)
            with store.open_input_file(name) as source:
                found = pa.ipc.open_file(source).read_all()
            return found.column(0).to_numpy(), found.column(1).to_numpy()

        for batch in batches:
            file, check, row = (c.to_numpy(zero_copy_only=False) for c in batch)
            out, hit = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
            for start, end, key in _stretches(file, check, row // span):
                rows, values = load(*key)
                if len(rows):
                    own = row[start:end] % span
                    at = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
                    hit[start:end] = rows[at] == own
                    out[start:end] = values[at]
            yield pa.array(out, mask=~hit)

    lookup = F.arrow_udf(look, "long")
    return lambda place: lookup(*map(column, place))


def without(rows: DataFrame, place: list[str], gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a ``placed`` table whose place is not in ``gone``, by marks: texts stay where they are."""
    return rows.where(marks(gone)(place).isNull()).select(*map(column, columns))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
