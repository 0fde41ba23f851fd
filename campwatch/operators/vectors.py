"""Nearest neighbours: exact by blocks, or by a stored index of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campwatch.operators import vector_index

#: Queries and vectors that are compared at once; memory depends on these, not on table sizes.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192


def l2(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, d: s + d))


def normalized(v: Column) -> Column:
    """Unit vector; null for the zero vector."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def _packed(rows: int):
    """Blocks of up to ``rows`` ids and vectors, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, n = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vecs).tobytes()], pa.binary())],
                ["ids", "vecs"],
            )

        for batch in batches:
            for o in range(0, batch.num_rows, rows):
                part = batch.slice(o, rows)
                if n + part.num_rows > rows and n:
                    yield flush()
                    ids, vecs, n = [], [], 0
                ids.append(part.column(0).to_numpy())
                vecs.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float))
                n += part.num_rows
        if n:
            yield flush()

    return run


def _block_top(k: int, metric: str, exclude_self: bool):
    """Of every pair of blocks, the best ``k`` vectors of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qid, pid = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in (0, 2))
                q, v = (np.frombuffer(batch.column(c)[row].as_buffer(), float).reshape(len(i), -1) for c, i in ((1, qid), (3, pid)))
                if metric == "cosine":
                    q, v = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (q, v))
                ids, dist = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
                for o in range(0, len(v), 2048):
                    part, own = v[o : o + 2048], pid[o : o + 2048]
                    d = 1 - q @ part.T if metric == "cosine" else np.stack([np.sqrt(((part - x) ** 2).sum(1)) for x in q])
                    if exclude_self:
                        d = np.where(qid[:, None] == own[None, :], np.inf, d)
                    ids = np.concatenate([ids, np.broadcast_to(own, d.shape)], 1)
                    dist = np.concatenate([dist, d], 1)
                    order = np.lexsort((ids, dist), axis=1)[:, :k]
                    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
                real = np.isfinite(dist)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[np.nonzero(real)[0]]), pa.array(ids[real]), pa.array(dist[real])],
                    ["qid", "vid", "distance"],
                )

    return run


def exact_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False
) -> DataFrame:
    """The ``k`` nearest vectors of each query, ties by id: ``qid, vid, distance, rank``.

    ``queries`` (qid, qvec) is a stated set. Both sides are packed into blocks,
    every block of queries meets every block of vectors, and what is shuffled
    after that is k rows per query and block. Nothing passes the driver. Under
    ``cosine`` the zero vector has no direction: as a query it finds nothing,
    and as a vector it is never found.
    """
    q = queries.select(F.col("qid").cast("long"), "qvec")
    v = vectors.select(F.col("vid").cast("long"), "vec")
    if metric == "cosine":
        q, v = q.where(_length("qvec") > 0), v.where(_length("vec") > 0)
    packed = "ids binary, vecs binary"
    one = q.mapInArrow(_packed(QUERY_BLOCK), packed).select(F.col("ids").alias("q"), F.col("vecs").alias("qv"))
    two = v.mapInArrow(_packed(VECTOR_BLOCK), packed)
    found = one.crossJoin(two).mapInArrow(
        _block_top(k, metric, exclude_self), "qid long, vid long, distance double"
    )
    best = Window.partitionBy("qid").orderBy("distance", "vid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _length(column: str) -> Column:
    return F.aggregate(F.col(column), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def checked(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vid, vec) for a cosine index: an id listed twice or a zero vector is an error."""
    twice = vectors.groupBy("vid").agg(F.count("*").alias("n")).where("n > 1").select("vid").head(1)
    if twice:
        raise ValueError(f"id {twice[0][0]} is listed twice")
    empty = vectors.where(_length("vec") == 0).select("vid").head(1)
    if empty:
        raise ValueError(f"vector {empty[0][0]} has no direction")
    return vectors


def search(queries: DataFrame, vectors: DataFrame, k: int, backend: str = "exact", metric: str = "l2", folder: str | None = None) -> DataFrame:
    """Nearest vectors by a named backend: ``exact``, or ``cells`` (approximate; builds an index in ``folder``).

    An unknown backend falls back to ``exact``, whose work is queries times vectors.
    """
    if backend == "cells" and folder:
        return vector_index.search(queries, vector_index.build(vectors, folder, metric), k)
    return exact_top_k(queries, vectors, k, metric)


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Share of true neighbours found, over all queries."""
    hit = truth.select("qid", "vid").join(found.select("qid", "vid", F.lit(1).alias("hit")), ["qid", "vid"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
