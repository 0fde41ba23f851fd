"""Centroid clustering by Lloyd's method over distinct vectors.

Vectors are quantised to integers, and equal ones become one row with its
multiplicity; partial counts are made before the shuffle, so a vector that a
third of all rows repeat is a few rows there. Every round goes over the distinct
vectors only: a task assigns its rows to the nearest centroid and adds up whole
numbers weighted by multiplicity; one row per task and centroid is shuffled, and
``k`` rows reach the driver. All sums and distances are exact integers, so the
result depends on neither the layout nor the order of rows. At last the
assignments are joined back to the rows by their vector. The few vectors that
hold more than one row in ``HOT_SHARE`` each (so fewer than that many) are
broadcast; the shuffle of the rest has no hot key.

Defined cases: a vector that is null, has another number of components, or any
null or non-finite component is left out; a component beyond ``LIMIT`` in size
counts as ``LIMIT`` (distances would leave 64 bits otherwise), and inertia stops
at the largest long. The first centroids are the rows with the smallest hash of
their id, rows without an id last, equal hashes by vector; fewer rows than ``k``
give fewer centroids, and equal ones may occur (the smaller number wins, the
other stays empty and keeps its place). Rows repeated with one id are separate
rows. An empty table gives an empty result. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.llm._common import forget, saved, table

#: Largest component after quantising; 64 squared differences then fit 62 bits.
LIMIT = 1 << 27
#: Components below this are multiplied as doubles, which hold all such sums exactly.
EXACT = 1 << 21
#: A vector that holds more than this share of the rows, one in so many, is joined by broadcast.
HOT_SHARE = 1000
MOST = (1 << 63) - 1
#: Rows of a batch that are compared with all centroids at once.
ROWS = 4096


def _kept(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    vector = F.col(vector_col)
    double = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), double.alias("vector"), (F.size(vector) == dim).alias("long_enough"), fine.alias("fine"))
    return rows.where("long_enough AND fine").select("vec_id", "vector")


def _pack(scale: int):
    """Rows with their quantised vector as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            whole = np.clip(np.floor(np.clip(flat, -float(LIMIT), float(LIMIT)) * scale), -LIMIT, LIMIT).astype("<i4")
            packed = pa.array([x.tobytes() for x in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["vec_id", "vector"])

    return run


def quantised(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """``vec_id, vector`` of the rows that are kept; the vector is ``dim`` packed integers."""
    return _kept(df, id_col, vector_col, dim).mapInArrow(_pack(scale), "vec_id long, vector binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller of equal ones, and the squared distance to it."""
    kind = np.int64 if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) >= EXACT else np.float64
    p, c = points.astype(kind), centroids.astype(kind)
    far = (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]
    best = far.argmin(1)
    return best, far[np.arange(len(best)), best].astype(np.int64)


def _sums(centroids: np.ndarray):
    """Per task, centroid and component: number of vectors, and the sum in two halves of 32 bits."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, np.zeros((k, dim), object)
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for o in range(0, batch.num_rows, ROWS):
                points, w = _matrix(batch.column(0).slice(o, ROWS), dim), weights[o : o + ROWS]
                best, _ = nearest(points, centroids)
                for part, lift in ((w & 0xFFFFF, 0), (w >> 20, 20)):
                    if part.any():
                        moved = np.zeros((k, dim), np.int64)
                        np.add.at(moved, best, points * part[:, None])
                        total += moved.astype(object) << lift
                for c in np.unique(best):
                    count[c] += int(w[best == c].sum())
        own = [(c, j, count[c], int(total[c][j])) for c in range(k) if count[c] for j in range(dim)]
        c, j, n, x = zip(*own, strict=True) if own else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(n, pa.int64()),
             pa.array([y >> 32 for y in x], pa.int64()), pa.array([y & 0xFFFFFFFF for y in x], pa.int64())],
            ["cluster", "j", "n", "high", "low"],
        )

    return run


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floor of the weighted mean; an empty one stays."""
    parts = distinct.select("vector", "weight").mapInArrow(_sums(centroids), "cluster int, j int, n long, high long, low long")
    out = centroids.copy()
    for row in parts.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[row["cluster"], row["j"]] = ((row["high"] << 32) + row["low"]) // row["n"]
    return out


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o in range(0, batch.num_rows, ROWS):
                part = batch.slice(o, ROWS)
                best, far = nearest(_matrix(part.column(0), centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(best.astype(np.int32)), pa.array(far)],
                    ["vector", "weight", "cluster", "distance"],
                )

    return run


def first_centroids(rows: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The ``k`` rows with the smallest hash of their id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(order.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.array([np.frombuffer(bytes(r[0]), "<i4") for r in found], np.int64).reshape(-1, dim)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _capped(total: Column) -> Column:
    return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def cluster(
    df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Cluster of every kept row and the final centroids.

    Rows: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256,
    weight`` (rows that share the vector). Centroids: ``k`` x ``dim`` integers.
    """
    spark = df.sparkSession
    rows = saved(quantised(df, id_col, vector_col, dim, scale), "quantised")
    distinct = saved(rows.groupBy("vector").agg(F.count("*").alias("weight")), "distinct")
    centroids = first_centroids(rows, k, seed, dim)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, weight long"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    for _ in range(rounds):
        before, centroids = centroids, _moved(distinct, centroids)
        if (before == centroids).all():
            break
    found = saved(distinct.mapInArrow(_assign(centroids), "vector binary, weight long, cluster int, distance long"), "assigned")
    forget(distinct)
    exact = F.col("distance").cast("decimal(38,0)") * F.col("weight")
    per = found.groupBy("cluster").agg(F.sum("weight").alias("n"), F.sum(exact.cast("decimal(38,0)")).alias("far")).collect()
    every, whole = sum(r["n"] for r in per), min(int(sum(r["far"] for r in per)), MOST)
    facts = spark.createDataFrame(
        [(r["cluster"], min(int(r["far"]), MOST), whole, digest(centroids[r["cluster"]])) for r in per],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    found = found.join(F.broadcast(facts), "cluster")
    hot = F.col("weight") * HOT_SHARE > every
    often = F.broadcast(found.where(hot))
    first = rows.join(often, "vector").unionByName(rows.join(often.select("vector"), "vector", "left_anti").join(found.where(~hot), "vector"))
    return first.select([f.split()[0] for f in schema.split(", ")]), centroids


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Lloyd's rounds over all rows as common table expressions; every value is a whole number below 2 ** 53."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dim})""",
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1)::INT AS c, v
  FROM kept ORDER BY c LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS near FROM (
    SELECT r, c, list_inner_product(kept.v, kept.v) - 2 * list_inner_product(kept.v, c{i}.v)
                 + list_inner_product(c{i}.v, c{i}.v) AS d
    FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m, v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(x ORDER BY j) AS m FROM (
      SELECT near.c AS c, j, floor(sum(kept.v[j]) / count(*)) AS x
      FROM a{i} JOIN kept USING (r), range(1, {dim + 1}) AS g(j) GROUP BY ALL) GROUP BY c) USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, near.c AS cluster, near.d::BIGINT AS distance,
       sum(near.d) OVER (PARTITION BY near.c)::BIGINT AS cluster_inertia, sum(near.d) OVER ()::BIGINT AS inertia,
       sha256(list_aggregate(list_transform(c{rounds}.v, lambda x: x::BIGINT::VARCHAR), 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = near.c"""


OP12_SQL = _op12_sql()
