"""Toxicity categories by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the text's
features and the probabilities of the categories before it. In training these
are out-of-fold probabilities (each fold scored by a model fitted on the other
folds), so a later model learns how far the earlier ones can be trusted.

Features are the distinct words of the whole text and their 4-, 5- and 6-byte
beginnings, lower-cased, as 64-bit hashes; the model keeps those most
associated with a category in a bounded sample of labelled rows
(``SAMPLE`` rows, the smallest by a hash of the id). Every document is scored,
over its whole text.

Defined cases: null text is empty and gets the probabilities of a text without
features; labelled rows with a null label or no document are not used for
training; an id labelled more than once has a mark if any of its labels gives
it, and of several texts with one id the smallest trains; without labelled rows,
or with one class only, a category gets its base rate; repeated rows are scored
each; a text of any length is worked through as one; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.llm import _kernels as K
from campwatch.llm._common import forget, saved, table
from campwatch.llm.linear import Rows, fit, sigmoid

#: Most labelled rows used for training, and most features kept per category.
SAMPLE, KEPT = 6000, 1500
FOLDS, LEAST_DOCS = 3, 5
PREFIXES = (4, 5, 6)
CUT = 0.5


def _features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of every word, in ``1 + len(PREFIXES)`` rows, and word bounds."""
    words = K.Words(raw, offs)
    kinds = [words.hashes()] + [words.prefixes(n) ^ np.uint64(n << 50) for n in PREFIXES]
    return np.stack(kinds), words.bounds


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = K.buffers(batch.column(1))
        for a, b in K.slices(offs):
            kinds, bounds = _features(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            found = [np.unique(kinds[:, i:j]).view(np.int64) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(found, pa.list_(pa.int64()))],
                ["row_id", "features"],
            )


@dataclass
class Chain:
    """A fitted chain: sorted feature hashes, and per category its weights."""

    names: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray
    links: list[np.ndarray]
    base: list[float]

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Per row and category, from the summed weights of the row's features."""
        out = np.zeros((len(sums), len(self.names)))
        for c in range(len(self.names)):
            out[:, c] = sigmoid(sums[:, c] + out[:, :c] @ self.links[c] + self.base[c])
        return out


def fit_chain(labelled: DataFrame, names: Sequence[str]) -> Chain:
    """Fit on ``labelled``: ``row_id, text`` and one 0/1 column per category.

    It has one row an id and at most SAMPLE rows, whose kept features reach the driver.
    """
    marks = labelled.select("row_id", *names)
    rows = saved(
        labelled.select("row_id", "text").mapInArrow(_extract, "row_id long, features array<long>")
        .join(marks, "row_id"),
        "labelled",
    )
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    n = totals["n"] or 0
    counted = (
        rows.select(F.explode("features").alias("feature"), *names)
        .groupBy("feature")
        .agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in names])
        .where(F.col("df") >= LEAST_DOCS)
    )
    chosen = None
    for c in names:
        share = (totals[c] or 0) / max(n, 1)
        spread = F.sqrt(F.col("df") * F.lit(max(share * (1 - share), 1e-9)))
        z = F.abs((F.col(c) - F.col("df") * F.lit(share)) / spread)
        top = counted.select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(KEPT)
        chosen = top.select("feature") if chosen is None else chosen.union(top.select("feature"))
    kept = np.array(sorted({r[0] for r in chosen.collect()}), np.int64)
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(kept)

    def narrow(batches):
        for batch in batches:
            at = batch.schema.get_field_index("features")
            own = [np.flatnonzero(np.isin(shared.value, f)).astype(np.int32) for f in batch.column(at).to_numpy(zero_copy_only=False)]
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(own, pa.list_(pa.int32()))],
                [f for f in batch.schema.names if f != "features"] + ["cols"],
            )

    schema = "row_id long, " + ", ".join(f"{c} int" for c in names) + ", cols array<int>"
    data = rows.select("row_id", *[F.col(c).cast("int") for c in names], "features")
    got = data.mapInArrow(narrow, schema).orderBy("row_id").toArrow()
    forget(rows)
    x = Rows([np.array(c, np.int64) for c in got.column("cols").to_pylist()], len(kept))
    fold = np.arange(got.num_rows) % FOLDS
    weights, links, base = np.zeros((len(kept), len(names))), [], []
    for c, name in enumerate(names):
        y = np.array(got.column(name).to_pylist(), float)
        w, v, b = fit(x, y)
        weights[:, c] = w
        links.append(v)
        base.append(b)
        out = np.zeros(len(y))
        for f in range(FOLDS):
            fw, fv, fb = fit(x.take(fold != f), y[fold != f])
            out[fold == f] = sigmoid(x.take(fold == f).score(fw, fv, fb))
        x = x.with_dense(out)
    order = np.argsort(kept.view(np.uint64))
    return Chain(tuple(names), kept.view(np.uint64)[order], weights[order], links, base)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        known = chain.features
        maybe = np.zeros(1 << 20, bool)
        maybe[(known >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(chain.names)))
            raw, offs = K.buffers(batch.column(1))
            for a, b in K.slices(offs):
                kinds, bounds = _features(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if not len(known) or not kinds.size:
                    continue
                hit = np.flatnonzero(maybe[(kinds >> np.uint64(44)).astype(np.int64)].any(0))
                own = kinds[:, hit]
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                kind, col = np.nonzero(known[at] == own)
                row = np.searchsorted(bounds, hit[col], "right") - 1
                pair = np.unique(row * len(known) + at[kind, col])
                np.add.at(sums, a + pair // len(known), chain.weights[pair % len(known)])
            p = chain.probabilities(sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1]))],
                ["row_id", *chain.names],
            )

    return run


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id`` and one probability per category for every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(chain)
    return df.select(F.col(id_col).cast("long").alias("row_id"), text_col).mapInArrow(
        _score(shared), "row_id long, " + ", ".join(f"{c} double" for c in chain.names)
    )


def sample_labelled(docs: DataFrame, labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """At most SAMPLE labelled documents, one row an id, with their category columns.

    An id with several labels has a mark if any of them gives it; of several
    texts with one id the smallest is taken.
    """
    full = labels.select("doc_id", *[m.cast("int").alias(c) for c, m in marks.items()]).dropna()
    full = full.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in marks])
    few = full.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(SAMPLE)
    # At most SAMPLE rows of a few numbers: a proven bound.
    found = docs.select(F.col("doc_id").alias("row_id"), "text").join(
        F.broadcast(few.withColumnRenamed("doc_id", "row_id")), "row_id"
    )
    text = F.min(F.coalesce("text", F.lit(""))).alias("text")
    return found.groupBy("row_id").agg(text, *[F.max(c).alias(c) for c in marks])


def label_marks() -> dict[str, Column]:
    """Chain order: low quality, then toxic, then both at once."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low, "toxic": toxic, "severe": low & toxic}


def toxic_probabilities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    marks = label_marks()
    return score(docs, fit_chain(sample_labelled(docs, labels, marks), tuple(marks)))


def drop_toxic(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rows whose toxic probability reaches CUT, columns unchanged.

    ``labelled_docs`` are the documents that ``labels`` is about.
    """
    marks = label_marks()
    chain = fit_chain(sample_labelled(labelled_docs, labels, marks), tuple(marks))
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    inner = _score(shared)
    at = docs.columns.index("text")
    toxic = list(marks).index("toxic") + 1

    def run(batches):
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["i", "t"])
            for found in inner(iter([pair])):
                yield batch.filter(pa.array(found.column(toxic).to_numpy() < CUT))

    return docs.mapInArrow(K.tidy(run), docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxic_probabilities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("row_id").alias("doc_id"),
        (F.col("toxic") >= CUT).alias("is_toxic"),
        F.col("toxic").alias("p_toxic"),
        F.col("low_quality").alias("p_low_quality"),
        F.col("severe").alias("p_severe"),
    )
