"""Jaccard join on word shingles, with count vectors in R-trees.

A text's set of distinct ``k``-word shingles is hashed into ``GROUPS`` groups;
its group counts are a point. For two sets the summed coordinate minima of
their points bound the overlap from above, so a box of points (a node of the
tree) whose bound misses the overlap that the threshold needs is cut off with
everything under it. Pairs that survive are verified on the full sets (of 64-bit
shingle hashes). All candidate pairs come from these trees.

The tree is distributed at its top: under any common order of shingles, two
sets that reach the threshold share one of the first ``n - ceil(t n) + 1``
shingles, so each such shingle is a bucket with a tree inside. The order puts
shingles that many texts share last; it only affects speed. A task builds the
trees of thousands of buckets at once, as one forest.

Two searches go through the trees. The first finds for every member its best
partner by the bound among the members before it, at most one pair a member;
what it links becomes one component. The second finds all pairs that are still
in different components. So no group is expanded into all its pairs, and no link
between different components is lost. Buckets of more than BLOCK_ROWS members
are cut into blocks: in the first search a block meets itself and a few leaders
of its bucket, in the second all other blocks whose boxes (a level of the tree
above the blocks) pass the bound and which are not of the same component. Only
the boxes are paired; members go to the pairs of blocks that are left.

Two members that share much meet in many buckets. Each member carries the
OWNERS fullest of its buckets; a pair that has some of them in common belongs to
the one of the lowest number, where it is sure to meet, and no other bucket
gives it. A pair without one is given by every bucket it meets in.

Pairs are verified in two steps. A vector with about a group a shingle bounds the
overlap closely for sets of any size, and is a tenth of a set; only the sets of
pairs that pass are shipped to each other.

Equal sets are one node, found by a 128-bit set hash, so exact copies never
meet in a bucket.

Defined cases: null text and texts without words have an empty set and link
with nothing; a null id never becomes a component id unless no other exists in
the component; rows repeated with one id are separate rows; a text of any length
is one set; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.llm import _kernels as K
from campwatch.llm._common import PLACE, forget, place_columns, placed, saved, table, without
from campwatch.llm.graph import components

#: A power of two. More groups bound the overlap more sharply.
GROUPS = 256
#: Shingles kept to order the rest: those found most often. A bound on what is broadcast.
COMMON = 1 << 18
#: Documents that must share a shingle for it to be ordered last.
COMMON_FROM = 16
BLOCK_ROWS = 256
LEAF = 8
#: Members whose trees are built together, about.
FOREST_ROWS = 2048
#: Buckets that a member carries to tell which of them gives a pair.
OWNERS = 16
#: Each salt puts the members of a large bucket in another order, whose first is a leader.
LEADER_SALTS = (1, 2, 3, 4)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each row of a batch (column 1: text)."""
    raw, offs = K.buffers(batch.column(1))
    for a, b in K.slices(offs):
        part = K.shingle_sets(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
        yield from enumerate(part, a)


def node_of(shingles: np.ndarray) -> bytes:
    """128-bit hash of a set of shingles."""
    with np.errstate(over="ignore"):
        one = np.add.reduce(K.mix64(shingles ^ np.uint64(0xA0761D6478BD642F)))
        two = np.add.reduce(K.mix64(shingles * np.uint64(0xE7037ED1A0B428DB)))
    return np.array([one, two], ">u8").tobytes()


def count_vector(shingles: np.ndarray) -> bytes:
    """Shingles per group; the last representable count stands for any number above it."""
    groups = (shingles >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(groups, minlength=GROUPS)
    return np.minimum(counts, 255).astype("u1").tobytes()


def fine_vector(shingles: np.ndarray) -> bytes:
    """Shingles per group, with as many groups as the largest power of two that is no more than the shingles."""
    bits = max(len(shingles).bit_length() - 1, 1)
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype("u1").tobytes()


def fine_bound(x: np.ndarray, y: np.ndarray) -> int | None:
    """The most that two sets of these fine vectors can share; None if a group is too full to tell."""
    if x.max() == 255 or y.max() == 255:
        return None
    x, y = (v.reshape(min(len(x), len(y)), -1).sum(1, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum())


def _points(vectors: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "u1").reshape(-1, GROUPS)


def _bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of points, row by row; 255 stands for any number above 254."""
    least = np.minimum(a, b)
    total = least.sum(1, dtype=np.int64)
    full = least == 255
    return total + (full.sum(1, dtype=np.int64) << 22) if full.any() else total


def _count_common(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            found, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 3
            return pa.RecordBatch.from_arrays(
                [pa.array(found[often].view(np.int64)), pa.array(times[often])], ["sig", "times"]
            )

        for batch in batches:
            for _, own in _sets(batch, k):
                held.append(own)
                n += len(own)
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def _describe(k: int, num: int, den: int, common):
    names = ["row_id", *PLACE, "n", "node", "cv", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = common.value
        for batch in batches:
            size, node, cv, sigs = [], [], [], []
            for _, own in _sets(batch, k):
                n = len(own)
                size.append(n)
                node.append(node_of(own) if n else None)
                cv.append(count_vector(own))
                first = n - (num * n + den - 1) // den + 1 if n else 0
                if n and len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    late = np.where(often[at] == own, rank[at], 0)
                    if late.any():
                        own = own[np.lexsort((own, late))]
                sigs.append(own[:first].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns)), pa.array(size, pa.int64()),
                 pa.array(node, pa.binary()), pa.array(cv, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                [n for n in names if n not in PLACE or batch.num_columns > 2],
            )

    return run


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fine, full = [], [], []

            def flush():
                return pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(fine, pa.binary()), pa.array(full, pa.binary())], ["node", "fine", "full"]
                )

            for _, own in _sets(batch, k):
                node.append(node_of(own))
                fine.append(fine_vector(own))
                full.append(own.tobytes())
                if sum(map(len, full[-64:])) > 16 << 20:
                    yield flush()
                    node, fine, full = [], [], []
            if node:
                yield flush()

    return run


def _may_link(num: int, den: int):
    """Pairs whose fine vectors leave room for the overlap that the threshold needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "u1") for c in (2, 3))
                most = fine_bound(x, y)
                sizes = int(x.sum(dtype=np.int64)) + int(y.sum(dtype=np.int64))
                keep[i] = most is None or most * (num + den) >= num * sizes
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _overlap(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"]
            )

    return run


class Forest:
    """Packed R-trees over count vectors, one per group of points, searched together.

    A box bounds overlaps from above, so only its upper corner matters; the
    smallest set in a box gives the least overlap that any pair would need. A
    level holds the boxes of all trees, tree by tree.
    """

    def __init__(self, group: np.ndarray, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        halves = points[:, : points.shape[1] // 2].sum(1, dtype=np.int64)
        self.order = np.lexsort((halves, sizes, group))
        group, top = group[self.order], points[self.order]
        least = most = sizes[self.order]
        #: Per level: corners, least and most sizes, and where each box's children begin and end.
        self.levels = [(top, least, most, None)]
        while len(group):
            first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
            if len(first) == len(group) and len(self.levels) > 1:
                break
            place = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
            cut = np.flatnonzero(place % leaf == 0)
            span = np.stack([cut, np.append(cut[1:], len(group))])
            top, group = np.maximum.reduceat(top, cut), group[cut]
            least, most = np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((top, least, most, span))

    def pairs(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of points of one group whose bound reaches the threshold, and their bounds.

        Points are numbered as given; the second of a pair comes later in the tree.
        """
        i = j = np.arange(len(self.levels[-1][0]))
        bound = np.zeros(len(i), np.int64)
        for h in range(len(self.levels) - 1, -1, -1):
            top, least, most, _ = self.levels[h]
            if h + 1 < len(self.levels):
                i, j = self._open(i, j, self.levels[h + 1][3])
            if not h:
                i, j = i[i < j], j[i < j]
            bound, good = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
            for o in range(0, len(i), 1 << 14):
                p, q = i[o : o + (1 << 14)], j[o : o + (1 << 14)]
                own = _bounds(top[p], top[q])
                need = own * (num + den) >= num * (least[p] + least[q])
                near = (den * most[p] >= num * least[q]) & (den * most[q] >= num * least[p])
                bound[o : o + (1 << 14)], good[o : o + (1 << 14)] = own, need & near
            i, j, bound = i[good], j[good], bound[good]
        return self.order[i], self.order[j], bound

    @staticmethod
    def _open(i: np.ndarray, j: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of both boxes of every pair, each unordered pair once."""
        many_i, many_j = span[1][i] - span[0][i], span[1][j] - span[0][j]
        total = many_i * many_j
        row = np.repeat(np.arange(len(i)), total)
        step = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
        p = span[0][i][row] + step // many_j[row]
        q = span[0][j][row] + step % many_j[row]
        once = p <= q
        return p[once], q[once]


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, joined and cut between two of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < FOREST_ROWS:
            continue
        whole = pa.Table.from_batches(held)
        cell = whole.column(0).to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of longs as rows of equal length, and which entries are real."""
    found = column.combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    many = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    real = np.arange(int(many.max(initial=0))) < many[:, None]
    out = np.zeros(real.shape, np.int64)
    out[real] = found.flatten().to_numpy(zero_copy_only=False)
    return out, real


def _given_here(sig: np.ndarray, owners: np.ndarray, real: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pair belongs to the bucket it was met in, or to none."""
    out = np.ones(len(i), bool)
    for o in range(0, len(i), 1 << 13):
        p, q = i[o : o + (1 << 13)], j[o : o + (1 << 13)]
        same = (owners[p][:, :, None] == owners[q][:, None, :]) & real[p][:, :, None] & real[q][:, None, :]
        common = same.any(2)
        least = np.where(common, owners[p], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        out[o : o + (1 << 13)] = ~common.any(1) | (least == sig[p])
    return out


def _search(num: int, den: int, nearest: bool):
    """Pairs of each cell by its tree: ``cell, side, nid, root, n, cv, sig, owners``.

    Of a cell of two blocks (sides 0 and 1) only pairs across are wanted. With
    ``nearest`` every member has one pair at most, else all pairs of different
    roots; of these, the pairs that do not belong to another bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_cells(batches):
            whole = whole.combine_chunks()
            cell, side, nid, root, n = (whole.column(c).to_numpy() for c in ("cell", "side", "nid", "root", "n"))
            forest = Forest(cell, _points(whole.column("cv")), n)
            i, j, bound = forest.pairs(num, den)
            apart = ((side[i] != side[j]) | (side[i] == 2)) & (root[i] != root[j]) & (nid[i] != nid[j])
            i, j, bound = i[apart], j[apart], bound[apart]
            if nearest:
                best = np.lexsort((nid[i], -bound, j))
                best = best[np.flatnonzero(np.diff(j[best], prepend=-1))]
                i, j = i[best], j[best]
            here = _given_here(whole.column("sig").to_numpy(), *_lists(whole.column("owners")), i, j)
            i, j = i[here], j[here]
            a, b = np.minimum(nid[i], nid[j]), np.maximum(nid[i], nid[j])
            found = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _met(cells: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Pairs as the cells give them."""
    dealt = cells.select("cell", "side", "nid", "root", "n", "cv", "sig", "owners").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(K.tidy(_search(num, den, nearest)), "a long, b long")


def _searched(cells: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    return _met(cells, num, den, nearest).distinct()


def _with_owners(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``nid, n, cv, owners``: points with the fullest of their buckets among ``members`` (``sig, members, nid``)."""
    # What is collected is shipped; shingles are hashes, so their own order does among buckets of one size.
    full = F.array_sort(F.collect_list(F.struct((-F.col("members")).cast("int").alias("most"), "sig")))
    owners = members.groupBy("nid").agg(F.slice(full, 1, OWNERS)["sig"].alias("owners"))
    return nodes.select("nid", "n", "cv").join(owners, "nid", "left")


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper corner, least and most size of each block, from rows sorted by block."""
    for whole in _whole_cells(batches):
        whole = whole.combine_chunks()
        key, n = whole.column(0).to_numpy(), whole.column("n").to_numpy()
        first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1))
        top = np.maximum.reduceat(_points(whole.column("cv")), first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[first]), pa.array([t.tobytes() for t in top], pa.binary()),
             pa.array(np.minimum.reduceat(n, first)), pa.array(np.maximum.reduceat(n, first))],
            ["block", "top", "least", "most"],
        )


def _box_pairs(num: int, den: int):
    """Pairs of blocks whose boxes reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            la, ma, lb, mb = (batch.column(i).to_numpy() for i in range(4, 8))
            near = (den * ma >= num * lb) & (den * mb >= num * la)
            good = near & (_bounds(_points(batch.column(2)), _points(batch.column(3))) * (num + den) >= num * (la + lb))
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _verify(df, pairs, nodes, id_col, text_col, k, num, den, name):
    """The pairs of a written table that reach the threshold, on full sets of shingles."""
    ends = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct()
    wanted = saved(nodes.select("nid", "node", "row_id").join(ends, "nid"), f"{name}-nodes")
    ids = wanted.select(F.col("row_id").alias("__id")).distinct()
    texts = df.select(F.col(id_col).cast("long").alias("__own"), F.col(text_col).alias("__text"))
    texts = texts.join(ids, F.col("__own").eqNullSafe(F.col("__id")), "left_semi")
    full = texts.mapInArrow(K.tidy(_shingles(k)), "node binary, fine binary, full binary")
    # Rows that share an id may share a text. One shuffle, by set, drops the copies and numbers the sets.
    full = full.groupBy("node").agg(F.any_value("fine").alias("fine"), F.any_value("full").alias("full"))
    full = saved(full.join(wanted.select("node", "nid").hint("merge"), "node").select("nid", "fine", "full"), f"{name}-sets")
    close = saved(_both(pairs, full, "fine").mapInArrow(K.tidy(_may_link(num, den)), "a long, b long"), f"{name}-close")
    ends = close.select(F.col("a").alias("nid")).union(close.select("b")).distinct()
    both = _both(close, full.join(ends, "nid", "left_semi"), "full")
    links = saved(
        both.mapInArrow(K.tidy(_overlap(num, den)), "a long, b long"),
        f"{name}-links",
    )
    for done in (wanted, full, close):
        forget(done)
    return links


def _both(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    """``a, b`` with a column of the sets of both."""
    one = sets.select(F.col("nid").alias("a"), F.col(what).alias("fa"))
    two = sets.select(F.col("nid").alias("b"), F.col(what).alias("fb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "fa", "fb")


def _first_cells(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cells of the first search: blocks of each bucket, with its leaders in every block.

    Only buckets of one block are sure to let two of their members meet, so only they own pairs.
    """
    blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    spread = members.withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("nid", "sig"), F.col("blocks")).cast("int")
    firsts = [F.min(F.struct(F.xxhash64(F.lit(s), "nid"), "nid"))["nid"] for s in LEADER_SALTS]
    leaders = (
        spread.where("blocks > 1").groupBy("sig", "blocks").agg(F.array_distinct(F.array(*firsts)).alias("lead"))
        .select("sig", "blocks", F.explode("lead").alias("nid"))
        .select("sig", "nid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    )
    rows = spread.select("sig", "nid", own.alias("block"))
    rows = rows.union(leaders.join(rows, ["sig", "nid", "block"], "left_anti"))
    return rows.join(_with_owners(nodes, members.where(F.col("members") <= BLOCK_ROWS)), "nid").select(
        F.xxhash64("sig", "block").alias("cell"), F.lit(2).alias("side"), "nid", F.col("nid").alias("root"), "n", "cv", "sig", "owners"
    )


def _second_cells(open_rows: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Cells of the second search: small buckets, and pairs of blocks of large ones.

    ``open_rows`` (``sig, members, nid, n, root``) is a written table.
    """
    points = _with_owners(nodes, open_rows.select("sig", "members", "nid")).select("nid", "cv", "owners")
    small = open_rows.where(F.col("members") <= BLOCK_ROWS).join(points, "nid").select(
        F.col("sig").alias("cell"), F.lit(2).alias("side"), "nid", "root", "n", "cv", "sig", "owners"
    )
    large = open_rows.where(F.col("members") > BLOCK_ROWS)
    # A component with many members in the bucket has blocks of its own, which need not meet.
    many = large.groupBy("sig", "root").agg(F.count("*").alias("c")).where(F.col("c") >= BLOCK_ROWS // 2)
    kind = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.001 * math.log(den / num))).cast("int")
    homed = large.join(many, ["sig", "root"], "left").select(
        "sig", "nid", "n", "root", F.when(F.col("c").isNotNull(), F.col("root")).otherwise(-1).alias("home"),
        kind.alias("kind"),
    )
    counts = homed.groupBy("sig", "home", "kind").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    sub = F.pmod(F.xxhash64("nid"), F.col("blocks"))
    rows = homed.join(counts, ["sig", "home", "kind"]).select(
        F.xxhash64("sig", "home", "kind", sub).alias("block"), "sig", "home", "nid", "root", "n"
    )
    rows = saved(rows.join(points, "nid"), "block-rows")
    facts = rows.groupBy("block").agg(F.any_value("sig").alias("sig"), F.any_value("home").alias("home"))
    dealt = rows.select("block", "n", "cv").repartition("block").sortWithinPartitions("block")
    boxes = dealt.mapInArrow(K.tidy(_boxes), "block long, top binary, least long, most long").join(facts, "block")
    boxes = saved(boxes, "boxes")
    one = boxes.select([F.col(c).alias(f"{c}1") for c in boxes.columns])
    two = boxes.select([F.col(c).alias(f"{c}2") for c in boxes.columns])
    alike = (F.col("home1") == F.col("home2")) & (F.col("home1") >= 0)
    # Boxes, one per BLOCK_ROWS members, meet in an equi-join on the bucket, sizes first.
    met = one.join(two, F.col("sig1") == F.col("sig2")).where(
        (F.col("block1") <= F.col("block2")) & ~alike & _near("most1", "least2", num, den, half=True)
        & _near("most2", "least1", num, den, half=True)
    )
    met = met.select("block1", "block2", "top1", "top2", "least1", "most1", "least2", "most2")
    pairs = saved(met.mapInArrow(K.tidy(_box_pairs(num, den)), "block1 long, block2 long"), "block-pairs")
    cell, same = F.xxhash64("block1", "block2").alias("cell"), F.col("block1") == F.col("block2")
    sides = pairs.select(cell, F.when(same, 2).otherwise(0).alias("side"), F.col("block1").alias("block")).union(
        pairs.where(~same).select(cell, F.lit(1).alias("side"), F.col("block2").alias("block"))
    )
    return small.union(rows.join(sides, "block").select("cell", "side", "nid", "root", "n", "cv", "sig", "owners"))


def jaccard_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    num: int = 80,
    den: int = 100,
    place: list[str] | None = None,
) -> DataFrame:
    """Shingle count and component of every row; sets link at Jaccard >= num / den.

    Returns ``row_id, n_shingles, component_id``, one row per input row, and
    where the row lies if ``place`` names the columns of a ``placed`` table.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"), *place_columns(place))
    place = PLACE if place else []
    often = (
        texts.select("row_id", "text").mapInArrow(K.tidy(_count_common(k)), "sig long, times long")
        .groupBy("sig").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON_FROM)
        .orderBy(F.desc("times"), "sig").limit(COMMON).toArrow()
    )
    sig = often.column("sig").to_numpy().astype(np.int64).view(np.uint64)
    rank = np.floor(np.log2(np.maximum(often.column("times").to_numpy(), 1))).astype(np.int64)
    by_sig = np.argsort(sig)
    common = spark.sparkContext.broadcast((sig[by_sig], rank[by_sig]))
    at = "".join(f"{c} {t}, " for c, t in texts.select(*place).dtypes) if place else ""
    rows = saved(
        texts.mapInArrow(
            K.tidy(_describe(k, num, den, common)),
            f"row_id long, {at}n long, node binary, cv binary, sigs array<long>",
        ),
        "sets",
    )
    nodes = saved(
        rows.where("n > 0").groupBy("node").agg(
            F.min("row_id").alias("row_id"), F.any_value("n").alias("n"),
            F.any_value("cv").alias("cv"), F.any_value("sigs").alias("sigs"),
        ).withColumn("nid", F.monotonically_increasing_id()),
        "nodes",
    )
    entries = nodes.select(F.explode("sigs").alias("sig"), "nid")
    buckets = saved(
        entries.groupBy("sig").agg(F.count("*").alias("members")).where("members > 1"), "buckets"
    )
    every = saved(entries.join(buckets, "sig"), "every-member")
    # Buckets with the same members would give the same pairs: one of them stays.
    # Their 128-bit set hashes tell them apart.
    alike = every.groupBy("sig", "members").agg(
        F.bit_xor(F.xxhash64("nid")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "nid")).alias("h2")
    )
    kept = alike.groupBy("members", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig")
    members = saved(every.join(saved(kept, "kept-buckets"), "sig", "left_semi"), "members")
    forget(every)
    first = saved(_searched(_first_cells(members, nodes), num, den, nearest=True), "first")
    links = _verify(df, first, nodes, id_col, text_col, k, num, den, "first")
    found = saved(components(links), "first-components")
    rooted = members.join(nodes.select("nid", "n"), "nid").join(found.withColumnRenamed("node", "nid"), "nid", "left")
    rooted = rooted.select("sig", "members", "nid", "n", F.coalesce("root", "nid").alias("root"))
    split = saved(
        rooted.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
        .where("r1 != r2").select("sig"),
        "split",
    )
    open_rows = saved(rooted.join(split, "sig"), "open")
    further = _searched(_second_cells(open_rows, nodes, num, den), num, den, nearest=False)
    more = saved(further.join(first, ["a", "b"], "left_anti"), "more")
    links = links.union(_verify(df, more, nodes, id_col, text_col, k, num, den, "more"))
    final = saved(components(links), "components")
    labels = final.join(nodes.select(F.col("nid").alias("node"), "row_id"), "node")
    smallest = labels.groupBy("root").agg(F.min("row_id").alias("component_id"))
    named = saved(
        nodes.select("node", "nid", "row_id")
        .join(final.select(F.col("node").alias("nid"), "root"), "nid", "left")
        .join(smallest, "root", "left")
        .select("node", "nid", F.coalesce("root", "nid").alias("root"),
                F.when(F.col("root").isNull(), F.col("row_id")).otherwise(F.col("component_id")).alias("component_id")),
        "named",
    )
    for done in (buckets, members, first, split, open_rows, more, nodes):
        forget(done)
    # Rows of empty sets are components of their own, without a root.
    slim = rows.select("row_id", "n", "node", *place)
    cols = ["row_id", F.col("n").alias("n_shingles"), "component_id", "root", *place]
    alone = slim.where("n = 0").select(
        "row_id", "n", F.col("row_id").alias("component_id"), F.lit(None).cast("long").alias("root"), *place
    )
    out = slim.where("n > 0").join(named, "node").select(cols).union(alone)
    return out if place else out.drop("root")


def _near(one: str, two: str, num: int, den: int, half: bool = False):
    """Whether the first size is not too small for the second one, and unless ``half`` the reverse."""
    near = F.col(one) * den >= F.col(two) * num
    return near if half else near & (F.col(two) * den >= F.col(one) * num)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one row of each component, that of the smallest id; columns unchanged.

    Rows go by their place in the table: of rows that share the smallest id the
    first stays, and a component without any id keeps its first row. Rows with
    empty sets stay, each one.
    """
    rows, place = placed(df)
    found = saved(jaccard_components(rows, id_col, text_col, place=place, **options), "found").where("root IS NOT NULL")
    rank = F.struct(F.col("row_id").isNull(), "row_id", *PLACE)
    best = found.groupBy("root").agg(F.min(rank).alias("best"))
    same = [F.col(c) == F.col(f"best.{c}") for c in PLACE]
    gone = found.join(best, "root").where(~(same[0] & same[1] & same[2])).select(*PLACE)
    return without(rows, place, gone, df.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return found.withColumnRenamed("row_id", "doc_id")
