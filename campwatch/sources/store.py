"""Tables that are replaced as a whole: staged overwrite with a row check, and a key-value table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REKEY_DAYS = 180


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def overwrite_checked(df: DataFrame, path: str, rows: int | None = None) -> int:
    """Write ``df`` beside ``path``, check its row count, then put it in place of ``path``.

    ``rows`` is the expected count (default: that of the table it replaces, if
    there is one). On a mismatch the staged files go and the old table stays.
    """
    spark = df.sparkSession
    target, store = _files(spark, path)
    if rows is None and store.exists(target):
        rows = spark.read.parquet(path).count()
    staged_path = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:8]}"
    staged, _ = _files(spark, staged_path)
    df.write.parquet(staged_path)
    found = spark.read.schema(df.schema).parquet(staged_path).count()
    if rows is not None and found != rows:
        store.delete(staged, True)
        raise ValueError(f"{found} rows were written, {rows} expected")
    old, _ = _files(spark, f"{staged_path}.old")
    if store.exists(target):
        store.rename(target, old)
    store.rename(staged, target)
    store.delete(old, True)
    return found


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str = "k", order: str = "ts") -> None:
    """Keep the newest row of each key, of the stored table and ``changes`` together."""
    target, store = _files(spark, path)
    every = spark.read.parquet(path).unionByName(changes) if store.exists(target) else changes
    overwrite_checked(latest(every, key, order), path, latest(every, key, order).count())


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; of equally new ones the greatest."""
    rest = [F.desc(c) for c in rows.columns if c not in (key, order)]
    newest = Window.partitionBy(key).orderBy(F.desc(order), *rest)
    return rows.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")


def rekey_due(age_days: Column) -> Column:
    return age_days >= REKEY_DAYS


def required(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; a missing one is an error, never an empty result."""
    target, store = _files(spark, path)
    if not store.exists(target):
        raise FileNotFoundError(f"nothing to scan: {path} does not exist")
    return spark.read.parquet(path)
