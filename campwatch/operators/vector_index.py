"""A stored nearest-neighbour index: cells, compact codes, and exact distances for the few that are left.

``build`` lays vectors out by the cell of their nearest centroid. Centroids are
fitted on a bounded sample; every vector is indexed. A vector's code is its
residual to the centroid in four bits a component, an eighth of its size; codes
lie in blocks of one cell each, and a large cell is many blocks in many tasks.

``search`` looks a query up in its nearest cells, ranks what lies there by the
codes, and compares the query with ``keep`` full vectors only. The share of cells
looked into falls with their number (``probes``), and ``keep`` does not grow, so
the share of vectors compared falls with size.

Tables in the folder: ``meta`` (one row), ``cells`` (centroids), ``codes`` (cell,
ids, codes; a block a row) and ``vectors`` (cell, vid, vec; sorted by both).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors on which centroids are fitted, at most; their number bounds what the driver holds.
SAMPLE = 1 << 17
MOST_CELLS = 8192
ROUNDS = 6
#: Codes of a block, and queries that meet it at once.
CODES, QUERIES = 4096, 512
#: Half a range of codes, in standard deviations of the residuals.
SPREAD = 2.5
#: Full vectors that a query is compared with, for each neighbour asked for.
KEEP = 8


@dataclass(frozen=True)
class Index:
    folder: str
    metric: str
    step: float
    centroids: np.ndarray
    size: int


def cells_for(size: int) -> int:
    return max(1, min(MOST_CELLS, round(2 * math.sqrt(size))))


def probes_for(cells: int) -> int:
    """Cells that a query looks into: two thirds of ninety, and a falling share of more."""
    return max(1, min(cells, math.ceil(0.65 * cells * (90 / max(cells, 90)) ** 0.34)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _nearest(points: np.ndarray, centroids: np.ndarray, many: int = 1) -> np.ndarray:
    far = (centroids * centroids).sum(1)[None, :] - 2 * (points @ centroids.T)
    if many == 1:
        return far.argmin(1)[:, None]
    return np.argpartition(far, min(many, far.shape[1]) - 1, axis=1)[:, :many]


def _lloyd(sample: np.ndarray, cells: int) -> np.ndarray:
    centroids = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([_nearest(sample[o : o + 4096], centroids)[:, 0] for o in range(0, len(sample), 4096)])
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        centroids[own[order][first]] = np.add.reduceat(sample[order], first) / np.diff(first, append=len(own))[:, None]
    return centroids


def _clean(vectors: DataFrame, metric: str) -> DataFrame:
    vec = F.col("vec").cast("array<double>")
    fine = vectors.select(F.col("vid").cast("long").alias("vid"), vec.alias("vec")).where("vec IS NOT NULL AND vid IS NOT NULL")
    if metric != "cosine":
        return fine
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return fine.withColumn("norm", norm).where("norm > 0").select("vid", F.transform("vec", lambda x: x / F.col("norm")).alias("vec"))


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o in range(0, batch.num_rows, 4096):
                part = batch.slice(o, 4096)
                cell = _nearest(_matrix(part.column(1)), centroids)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0), part.column(1)], ["cell", "vid", "vec"])

    return run


def _encode(step: float, centroids: np.ndarray):
    """Blocks of codes from rows sorted by cell."""

    def block(cell: int, ids: list, vecs: list) -> pa.RecordBatch:
        rest = (np.concatenate(vecs) - centroids[cell]) / step
        nibble = (np.clip(np.floor(rest), -8, 7) + 8).astype(np.uint8)
        if nibble.shape[1] % 2:
            nibble = np.pad(nibble, ((0, 0), (0, 1)))
        code = nibble[:, ::2] | (nibble[:, 1::2] << 4)
        return pa.RecordBatch.from_arrays(
            [pa.array([cell], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([code.tobytes()], pa.binary())],
            ["cell", "ids", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs, n = -1, [], [], 0
        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                for o in range(a, b, CODES):
                    part = batch.slice(o, min(CODES, b - o))
                    if n and (int(cell[o]) != now or n + part.num_rows > CODES):
                        yield block(now, ids, vecs)
                        ids, vecs, n = [], [], 0
                    now = int(cell[o])
                    ids.append(part.column(1).to_numpy())
                    vecs.append(_matrix(part.column(2)))
                    n += part.num_rows
        if n:
            yield block(now, ids, vecs)

    return run


def _lay_out(spark: SparkSession, vectors: DataFrame, index: Index) -> None:
    """Append vectors to an index. Cells are cut by id, too, so none is a task of its own."""
    rows = _clean(vectors, index.metric).mapInArrow(_assign(index.centroids), "cell int, vid long, vec array<double>")
    rows.repartitionByRange("cell", "vid").sortWithinPartitions("cell", "vid").write.mode("append").parquet(f"{index.folder}/vectors.new")
    laid = spark.read.parquet(f"{index.folder}/vectors.new").sortWithinPartitions("cell", "vid")
    codes = laid.mapInArrow(_encode(index.step, index.centroids), "cell int, ids binary, codes binary")
    codes.write.mode("append").parquet(f"{index.folder}/codes")
    laid.write.mode("append").parquet(f"{index.folder}/vectors")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index.folder}/vectors.new")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def build(vectors: DataFrame, folder: str, metric: str = "l2", cells: int | None = None) -> Index:
    """Index ``vectors`` (vid, vec) in ``folder``. Null vectors, and zero ones under ``cosine``, are not indexed."""
    spark = vectors.sparkSession
    fine = _clean(vectors, metric)
    size = fine.count()
    share = min(1.0, 2 * SAMPLE / max(size, 1))
    few = fine.where(F.pmod(F.xxhash64(F.lit(11), "vid"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64(F.lit(12), "vid"), "vid").limit(SAMPLE)
    table = few.select("vid", "vec").toArrow().combine_chunks()
    sample = _matrix(table.column("vec").combine_chunks()) if table.num_rows else np.zeros((0, 1), np.float32)
    centroids = _lloyd(sample, min(cells or cells_for(size), len(sample))) if len(sample) else sample
    some = sample[:8192]
    step = float(max((some - centroids[_nearest(some, centroids)[:, 0]]).std() * SPREAD / 8, 1e-12)) if len(sample) else 1.0
    spark.createDataFrame([(metric, step)], "metric string, step double").coalesce(1).write.parquet(f"{folder}/meta")
    numbered = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(numbered, "cell int, vec array<float>").coalesce(1).write.parquet(f"{folder}/cells")
    index = Index(folder, metric, step, centroids, size)
    _lay_out(spark, vectors, index)
    return index


def load(spark: SparkSession, folder: str) -> Index:
    meta = spark.read.parquet(f"{folder}/meta").first()
    rows = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
    centroids = np.array([r["vec"] for r in rows], np.float32)
    return Index(folder, meta["metric"], meta["step"], centroids, spark.read.parquet(f"{folder}/vectors").count())


def add(vectors: DataFrame, index: Index) -> Index:
    """Index further vectors in the cells that there are."""
    _lay_out(vectors.sparkSession, vectors, index)
    return load(vectors.sparkSession, index.folder)


def _probe(centroids: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o in range(0, batch.num_rows, 1024):
                part = batch.slice(o, 1024)
                near = _nearest(_matrix(part.column(1)), centroids, probes)
                row = np.repeat(np.arange(len(near)), near.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.reshape(-1).astype(np.int32)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))],
                    ["cell", "qid", "qvec"],
                )

    return run


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(cell)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
            for o in range(a, b, QUERIES):
                part = batch.slice(o, min(QUERIES, b - o))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(0, 1), pa.array([part.column(1).to_numpy().tobytes()], pa.binary()),
                     pa.array([_matrix(part.column(2)).tobytes()], pa.binary())],
                    ["cell", "qids", "qvecs"],
                )


def _rank(index: Index, keep: int):
    """Of every block of codes, the ``keep`` nearest of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = batch.column(0)[r].as_py()
                qid, ids = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in (1, 3))
                q = np.frombuffer(batch.column(2)[r].as_buffer(), np.float32).reshape(len(qid), -1)
                code = np.frombuffer(batch.column(4)[r].as_buffer(), np.uint8).reshape(len(ids), -1)
                both = np.stack([code & 15, code >> 4], 2).reshape(len(ids), -1)[:, : q.shape[1]]
                about = index.centroids[cell] + (both.astype(np.float32) - 7.5) * np.float32(index.step)
                far = (about * about).sum(1)[None, :] - 2 * (q @ about.T) + (q * q).sum(1)[:, None]
                best = np.argpartition(far, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.broadcast_to(np.arange(len(ids)), far.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qid, best.shape[1])), pa.array(np.full(best.size, cell, np.int32)),
                     pa.array(ids[best.reshape(-1)]), pa.array(np.take_along_axis(far, best, 1).reshape(-1).astype(float))],
                    ["qid", "cell", "vid", "about"],
                )

    return run


def candidates(queries: DataFrame, index: Index, k: int, probes: int | None = None, keep: int = KEEP) -> DataFrame:
    """``qid, cell, vid, about``: the vectors with which each query is compared, ``keep * k`` at most."""
    spark = queries.sparkSession
    probes = min(probes or probes_for(len(index.centroids)), len(index.centroids))
    q = _clean(queries.select(F.col("qid").alias("vid"), F.col("qvec").alias("vec")), index.metric)
    spread = q.mapInArrow(_probe(index.centroids, probes), "cell int, qid long, qvec array<double>")
    packed = spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(_pack_queries, "cell int, qids binary, qvecs binary")
    codes = spark.read.parquet(f"{index.folder}/codes")
    met = packed.join(codes, "cell").select("cell", "qids", "qvecs", "ids", "codes")
    found = met.mapInArrow(_rank(index, keep * k), "qid long, cell int, vid long, about double")
    best = Window.partitionBy("qid").orderBy("about", "vid")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep * k).drop("r")


def _pack_rows(rows: int):
    """Blocks of up to ``rows`` ids and vectors, as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o in range(0, batch.num_rows, rows):
                part = batch.slice(o, rows)
                full = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([full.tobytes()], pa.binary())], ["ids", "vecs"]
                )

    return run


def _compare_all(k: int, metric: str):
    """Of every pair of blocks, the ``k`` nearest of each query by full vectors, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qid, ids = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in (0, 2))
                q, v = (np.frombuffer(batch.column(c)[r].as_buffer(), float).reshape(len(i), -1) for c, i in ((1, qid), (3, ids)))
                far = 1 - q @ v.T if metric == "cosine" else np.stack([np.sqrt(((v - x) ** 2).sum(1)) for x in q])
                best = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qid, best.shape[1])), pa.array(ids[best.reshape(-1)]), pa.array(np.take_along_axis(far, best, 1).reshape(-1))],
                    ["qid", "vid", "distance"],
                )

    return run


def search_all(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """The ``k`` nearest of each query among all that is indexed, every vector compared: ``search`` without its bounds.

    Codes are not looked at, as no number of vectors kept by them is sure to hold
    the neighbours. The work is queries times vectors, in blocks of both.
    """
    if not len(index.centroids):
        return queries.sparkSession.createDataFrame([], "qid long, vid long, distance double, rank int")
    q = _clean(queries.select(F.col("qid").alias("vid"), F.col("qvec").alias("vec")), index.metric)
    one = q.mapInArrow(_pack_rows(QUERIES), "ids binary, vecs binary").select(F.col("ids").alias("q"), F.col("vecs").alias("qv"))
    stored = queries.sparkSession.read.parquet(f"{index.folder}/vectors").select("vid", "vec")
    two = stored.mapInArrow(_pack_rows(CODES), "ids binary, vecs binary")
    found = one.crossJoin(two).mapInArrow(_compare_all(k, index.metric), "qid long, vid long, distance double")
    best = Window.partitionBy("qid").orderBy("distance", "vid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None, keep: int = KEEP) -> DataFrame:
    """The ``k`` nearest of each query (qid, qvec), by exact distance: ``qid, vid, distance, rank``."""
    if not len(index.centroids):
        return queries.sparkSession.createDataFrame([], "qid long, vid long, distance double, rank int")
    found = candidates(queries, index, k, probes, keep)
    q = _clean(queries.select(F.col("qid").alias("vid"), F.col("qvec").alias("vec")), index.metric).toDF("qid", "qvec")
    full = queries.sparkSession.read.parquet(f"{index.folder}/vectors")
    both = found.join(full, ["cell", "vid"]).join(q, "qid")
    if index.metric == "cosine":
        dot = F.aggregate(F.zip_with("qvec", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        distance = 1 - dot
    else:
        gap = F.zip_with("qvec", "vec", lambda a, b: (a - b) * (a - b))
        distance = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))
    best = Window.partitionBy("qid").orderBy("distance", "vid")
    near = both.select("qid", "vid", distance.alias("distance"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def shares(index: Index, queries: DataFrame, k: int, probes: int | None = None, keep: int = KEEP) -> DataFrame:
    """One row: shares of all pairs whose codes are ranked, and whose full vectors are compared."""
    spark = queries.sparkSession
    probes = min(probes or probes_for(len(index.centroids)), len(index.centroids))
    q = _clean(queries.select(F.col("qid").alias("vid"), F.col("qvec").alias("vec")), index.metric)
    sizes = spark.read.parquet(f"{index.folder}/vectors").groupBy("cell").agg(F.count("*").alias("n"))
    looked = q.mapInArrow(_probe(index.centroids, probes), "cell int, qid long, qvec array<double>").join(sizes, "cell")
    pairs = F.lit(float(max(index.size, 1))) * q.count()
    compared = candidates(queries, index, k, probes, keep).agg(F.count("*").alias("c"))
    return looked.agg(F.sum("n").alias("r")).crossJoin(compared).select((F.col("r") / pairs).alias("ranked_share"), (F.col("c") / pairs).alias("compared_share"))
