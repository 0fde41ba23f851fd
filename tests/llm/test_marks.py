"""Marks on rows, looked up by place while a table is scanned."""

import random

import pytest
from pyspark.sql import functions as F

_common = pytest.importorskip("campwatch.llm._common")

from campwatch.llm import exact_dedup, near_join, warc  # noqa: E402

PLACE = _common.PLACE


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("marks") / "rows.parquet")
    spark.range(500).withColumn("text", F.concat(F.lit("text "), F.col("id") % 400)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("span", [1, 7, 1 << 18])
def test_marks_reach_their_rows_whatever_the_span(spark, stored, span):
    rows, place = _common.placed(stored)
    chosen = random.Random(2).sample(range(500), 200)
    marked = rows.where(F.col("id").isin(chosen)).select(*PLACE, (F.col("id") * 10 - 7).alias("value"))
    found = rows.select("id", _common.marks(marked, "value", span)(place).alias("mark")).collect()
    assert {r["id"]: r["mark"] for r in found} == {i: i * 10 - 7 if i in chosen else None for i in range(500)}


def test_no_marks_and_all_marks(stored):
    rows, place = _common.placed(stored)
    assert _common.without(rows, place, rows.where("false").select(*PLACE), ["id"]).count() == 500
    assert _common.without(rows, place, rows.select(*PLACE), ["id"]).count() == 0


def test_written_again_marks_are_the_same(spark, stored, monkeypatch):
    rows, place = _common.placed(stored)
    monkeypatch.setattr(_common, "fresh_path", lambda spark, name, at=_common.fresh_path(spark, "again"): at)
    for _ in range(2):
        left = _common.without(rows, place, rows.where("id % 3 = 0").select(*PLACE), ["id"])
        assert sorted(r["id"] for r in left.collect()) == [i for i in range(500) if i % 3]


def test_texts_are_neither_joined_nor_shuffled(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = stored.withColumnRenamed("id", "doc_id").repartition(2)
        pages = stored.select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat("text", 200).alias("html"))
        kept, near = exact_dedup.keep_one(docs), near_join.keep_one(docs)
        assigned = warc.assign(pages)
        for df in (kept, near, assigned):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan and "ArrowEvalPython" in plan
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(400))
        assert near.count() == 400
        found = {r["page_id"]: r["refers_to"] for r in assigned.collect()}
        assert found == {i: i + 400 if i < 100 else None for i in range(500)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
