"""Graph analytics on an edge table ``a, b``, as iterated joins.

Every loop writes its state to the checkpoint folder every round or every few
rounds, so lineage stays short and a lost executor costs no more. Only counts
and norms, and a found path, reach the driver.
"""

from __future__ import annotations

import math
import tempfile
import time

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_SEED = 42
#: Edges of one task where their wedges meet; an incident graph opens some forty an edge.
EDGES = 50_000
#: Links that a betweenness task looks at together, and that it should look at in all.
VISITED, VISITS = 2_000_000, 100_000_000_000
#: Most tasks of a betweenness from all sources; each gets the whole graph.
TASKS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is named (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name a folder that all executors share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="campwatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def use_checkpoints(spark: SparkSession) -> None:
    """Name the checkpoint folder, if the session has none yet."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def settle(df: DataFrame) -> DataFrame:
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each undirected edge, without loops or repeats: ``src, dst``."""
    return (
        edges.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .union(edges.where("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .distinct()
    )


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "node")


def clustering(edges: DataFrame) -> DataFrame:
    """``node, degree, triangles, clustering``.

    Edges point from the end of lower degree to the higher one, so hubs open
    few wedges. Wedges are dealt to tasks by the number of edges: a task sorts
    what it gets, and an exchange of Spark's own would join many into one.
    """
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(edges.count() / EDGES))
    deg = degrees(edges)
    sym = symmetric(edges)
    ranked = sym.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(
        deg.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst"
    )
    up = ranked.where("struct(ds, src) < struct(dd, dst)").select("src", "dst")
    wedges = up.alias("x").join(up.alias("y"), F.col("x.src") == F.col("y.src")).where("x.dst < y.dst")
    wedges = wedges.select(F.col("x.src").alias("n1"), F.col("x.dst").alias("src"), F.col("y.dst").alias("dst"))
    # Rows of sym are distinct, so this is a semi join; Spark would push that below the exchange.
    closed = wedges.repartition(tasks, "src", "dst").join(sym.repartition(tasks, "src", "dst").hint("merge"), ["src", "dst"])
    per_node = (
        closed.select(F.explode(F.array("n1", "src", "dst")).alias("node")).groupBy("node")
        .agg(F.count("*").alias("triangles"))
    )
    out = deg.join(per_node, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    possible = F.col("degree") * (F.col("degree") - 1)
    return out.withColumn("clustering", F.when(possible > 0, 2.0 * F.col("triangles") / possible).otherwise(0.0))


def hops(edges: DataFrame, start: str | int, depth: int) -> DataFrame:
    """``node, hops`` for nodes within ``depth`` hops of ``start``; empty if it has no edge."""
    sym = settle(symmetric(edges))
    seen = sym.where(F.col("src") == start).select(F.col("src").alias("node")).distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(sym, frontier["node"] == sym["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = settle(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def find_path(edges: DataFrame, start, goal, max_depth: int = 6) -> tuple[list | None, str]:
    """A shortest path between two nodes by search from both ends, or None and the reason.

    Each side goes ``max(1, max_depth // 2)`` steps. A node keeps the smallest
    node it was reached from, so the path is one of the shortest and reruns
    agree; the path's own nodes are all that reaches the driver.
    """
    sym = settle(symmetric(edges))
    for end in (start, goal):
        if sym.where(F.col("src") == end).isEmpty():
            return None, f"node {end} is not in the exposed view"
    if start == goal:
        return [start], "same node"
    reach = max(1, max_depth // 2)
    none = F.lit(None).cast(sym.schema["src"].dataType).alias("via")
    seen = [sym.where(F.col("src") == n).select(F.col("src").alias("node"), none).distinct() for n in (start, goal)]
    fronts, steps = list(seen), [0, 0]
    while min(steps) < reach:
        side = 0 if steps[0] <= steps[1] else 1
        step = fronts[side].select("node").join(sym, F.col("node") == F.col("src"))
        step = step.groupBy("dst").agg(F.min("src").alias("via")).withColumnRenamed("dst", "node")
        fronts[side] = settle(step.join(seen[side].select("node"), "node", "left_anti").select("node", "via"))
        steps[side] += 1
        seen[side] = settle(seen[side].union(fronts[side]))
        met = seen[0].join(seen[1].select("node"), "node", "left_semi").agg(F.min("node")).first()[0]
        if met is not None:
            left, right = (_walk_back(seen[i], met) for i in (0, 1))
            return [*reversed(left), *right[1:]], "found"
        if fronts[side].isEmpty():
            break
    return None, f"no path within {max_depth} hops"


def _walk_back(seen: DataFrame, node) -> list:
    path = [node]
    while True:
        node = seen.where(F.col("node") == node).select("via").first()[0]
        if node is None:
            return path
        path.append(node)


def path_hops(edges: DataFrame, start, goal, max_depth: int = 6) -> tuple[int | None, str]:
    """Hops between two nodes by search from both ends, or None and the reason."""
    path, reason = find_path(edges, start, goal, max_depth)
    return (None if path is None else len(path) - 1), reason


def _sent(adjacent: DataFrame, state: DataFrame, column) -> DataFrame:
    """``state`` with ``got``, the sum of ``column`` over a node's neighbours: one round.

    Shuffled joins only, and one round a plan: what is broadcast, and plans of
    many rounds, pile up in the driver.
    """
    out = state.select(F.col("node").alias("src"), column.alias("sent"))
    got = adjacent.join(out.hint("merge"), "src").groupBy("dst").agg(F.sum("sent").alias("got"))
    return settle(state.join(got.withColumnRenamed("dst", "node").hint("merge"), "node", "left").withColumn("got", F.coalesce("got", F.lit(0.0))))


def personalized_pagerank(
    edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-8
) -> DataFrame:
    """``node, score``, until a step of the walk moves all scores together by less than ``tolerance``.

    The scores solve a linear system, symmetric when lengths are weighted by
    1 / degree; conjugate gradients take a dozen rounds where steps of the walk
    take more than a hundred. ``move`` is what a step adds to the scores.
    Seeds outside the graph are dropped; not settling in ``rounds`` rounds is an error.
    """
    adjacent = settle(symmetric(edges))
    deg = adjacent.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "node")
    deg = settle(deg.join(seeds.select("node").distinct().withColumn("seed", F.lit(1.0)).hint("merge"), "node", "left"))
    n = deg.agg(F.count("seed")).first()[0]
    if not n:
        return deg.select("node", F.lit(0.0).alias("score")).where("false")
    home = F.coalesce("seed", F.lit(0.0)) * ((1 - alpha) / n)
    state = deg.select("node", "degree", F.lit(0.0).alias("score"), home.alias("move"), home.alias("way"))
    for _ in range(rounds):
        state = _sent(adjacent, state, F.col("way") / F.col("degree"))
        turn = F.col("way") - alpha * F.col("got")

        def product(x, y):
            return F.sum(x * y / F.col("degree"))

        moved, rest, curve, mixed, turned = state.agg(
            F.sum(F.abs("move")), product(F.col("move"), F.col("move")), product(F.col("way"), turn), product(F.col("move"), turn), product(turn, turn)
        ).first()
        if moved < tolerance:
            return state.select("node", F.greatest(F.col("score") + F.col("move"), F.lit(0.0)).alias("score"))
        far = rest / curve
        left = max(rest - 2 * far * mixed + far * far * turned, 0.0)
        move = F.col("move") - far * turn
        state = state.select("node", "degree", (F.col("score") + far * F.col("way")).alias("score"), move.alias("move"), (move + left / rest * F.col("way")).alias("way"))
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def eigenvector(edges: DataFrame, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """``node, score``, unit length: the eigenvector of the largest eigenvalue; not settling is an error.

    Every round takes the best vector (Rayleigh-Ritz) of the scores ``x``, what
    is wrong with them ``w``, and the last change ``p``. Powers of the matrix
    settle slowly where hubs make the graph nearly bipartite: its smallest
    eigenvalue is then about as large as the largest, and more so the larger
    the graph. Settled is when ``w`` is shorter than ``tolerance`` eigenvalues.
    """
    adjacent = settle(symmetric(edges))
    nodes = adjacent.select(F.col("src").alias("node")).distinct()
    n = adjacent.agg(F.count_distinct("src")).first()[0]
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    first = _sent(adjacent, nodes.withColumn("x", F.lit(1.0 / math.sqrt(n))), F.col("x")).withColumnRenamed("got", "ax")
    value = first.agg(F.sum(F.col("x") * F.col("ax"))).first()[0]
    zero = F.lit(0.0)
    state = first.select("node", "x", "ax", (F.col("ax") - value * F.col("x")).alias("w"), zero.alias("p"), zero.alias("ap"))
    basis, images = ("x", "w", "p"), ("ax", "got", "ap")
    for _ in range(rounds):
        state = _sent(adjacent, state, F.col("w"))
        sums = state.agg(*[F.sum(F.col(u) * F.col(v)) for other in (basis, images) for u in basis for v in other]).first()
        gram, image = (np.array(sums[k : k + 9]).reshape(3, 3) for k in (0, 9))
        if math.sqrt(gram[1, 1]) < tolerance * value * math.sqrt(gram[0, 0]):
            return state.select("node", (F.col("x") / math.sqrt(gram[0, 0])).alias("score"))
        value, part = _best(gram, image)

        def mixed(columns, parts):
            return sum((float(c) * F.col(name) for c, name in zip(parts, columns)), zero)

        x, ax = mixed(basis, part), mixed(images, part)
        state = state.select(
            "node", x.alias("x"), ax.alias("ax"), (ax - value * x).alias("w"), mixed(basis[1:], part[1:]).alias("p"), mixed(images[1:], part[1:]).alias("ap")
        )
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def _best(gram: np.ndarray, image: np.ndarray) -> tuple[float, np.ndarray]:
    """The largest eigenvalue within a basis, and the parts of its unit vector; directions that depend on others are left out."""
    lengths = np.sqrt(np.diag(gram))
    scale = np.where(lengths > 0, 1.0 / np.where(lengths > 0, lengths, 1.0), 0.0)
    own, turned = np.linalg.eigh(gram * np.outer(scale, scale))
    kept = own > 1e-12 * own[-1]
    frame = turned[:, kept] / np.sqrt(own[kept])
    values, vectors = np.linalg.eigh(frame.T @ ((image + image.T) / 2 * np.outer(scale, scale)) @ frame)
    part = frame @ vectors[:, -1] * scale
    return float(values[-1]), part if part[0] >= 0 else -part


def sample_sources(n: int) -> int:
    """How many sources a sampled betweenness uses for a graph of ``n`` nodes."""
    return max(16, min(n, 10_000 // max(1, n // 100)))


def betweenness(edges: DataFrame, sources: int | None = None) -> DataFrame:
    """Normalised shortest-path betweenness from all, or from sampled, sources.

    From sampled sources breadth-first counts of shortest paths go forward level
    by level for all sources at once, keyed by (source, node); dependencies come
    back the same way, and sums are scaled by nodes over sources. From all
    sources that would be a row a pair of nodes: see ``_from_all``.
    """
    sym = settle(symmetric(edges))
    nodes = settle(sym.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    if n < 3:
        return nodes.withColumn("betweenness", F.lit(0.0))
    if sources is None or sources >= n:
        return _from_all(sym, nodes, n)
    chosen = nodes.orderBy(F.xxhash64(F.lit(SAMPLE_SEED), "node"), "node").limit(sources)
    m = sources
    level = settle(chosen.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("s", "node")
    while True:
        step = level.join(sym, level["node"] == sym["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = settle(step.join(seen, ["s", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = settle(seen.union(level.select("s", "node")))
    total, below = None, None
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth]
        if below is None:
            own = here.withColumn("dep", F.lit(0.0))
        else:
            own = here.join(below, ["s", "node"], "left").select("s", "node", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep"))
        own = settle(own)
        part = own.select("node", "dep")
        total = part if total is None else total.union(part)
        up = levels[depth - 1].withColumnRenamed("node", "src").withColumnRenamed("paths", "p")
        share = own.join(sym, own["node"] == sym["dst"]).select("s", "src", (((1 + F.col("dep")) / F.col("paths"))).alias("w"))
        below = share.join(up, ["s", "src"]).groupBy("s", F.col("src").alias("node")).agg(F.sum(F.col("p") * F.col("w")).alias("dep"))
    scale = n / m / ((n - 1) * (n - 2))
    summed = total.groupBy("node").agg(F.sum("dep").alias("dep"))
    return nodes.join(summed, "node", "left").select("node", (F.coalesce("dep", F.lit(0.0)) * scale).alias("betweenness"))


def _from_all(sym: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Betweenness from every source, one after the other in tasks that each hold the links as packed numbers.

    Nodes with the same neighbours (told by 128 bits of hash) are one source of
    that weight: they swap places without changing the graph. A task takes four
    bytes a link and direction and some seventy a node, whatever the number of
    sources; time is sources times links.
    """
    context = sym.sparkSession.sparkContext
    ids = settle(nodes.withColumn("at", F.monotonically_increasing_id()))
    # Numbers without gaps: a partition's first one, and the place within it.
    sizes = dict(ids.groupBy(F.shiftright("at", 33).cast("int")).count().collect())
    starts = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes) + 1)])]).tolist()
    first = F.array(*map(F.lit, starts))[F.shiftright("at", 33).cast("int")]
    ids = ids.select("node", (first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("id"))
    numbered = sym.join(ids.select(F.col("node").alias("src"), F.col("id").alias("s")).hint("merge"), "src").join(
        ids.select(F.col("node").alias("dst"), F.col("id").alias("d")).hint("merge"), "dst"
    )
    links = settle(numbered.select("s", "d"))
    count = links.count()
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "d")).alias(f"m{i}") for i in (1, 2)]
    alike = settle(links.groupBy("s").agg(F.count("*").alias("m0"), *marks))
    kinds = alike.groupBy("m0", "m1", "m2").agg(F.min("s").alias("first"))
    sources = kinds.count()
    links = links.join(alike.join(kinds.hint("merge"), ["m0", "m1", "m2"]).select("s", "first").hint("merge"), "s").select("s", "first", "d")
    tasks = max(context.defaultParallelism, min(TASKS, math.ceil(sources * count / VISITS)))
    runs = links.repartitionByRange(max(1, math.ceil(count / VISITED)), "s").sortWithinPartitions("s").mapInArrow(_runs, "run long, own binary, size binary, first binary, other binary")
    # A key for every partition of an exchange by hash, so that tasks do not meet in one.
    keys = sym.sparkSession.range(64 * tasks).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(tasks)).alias("slot")).agg(F.min("key"))
    keys = [r[1] for r in keys.collect()]
    dealt = settle(runs).select(F.posexplode(F.array(*map(F.lit, keys))).alias("task", "key"), "run", "own", "size", "first", "other").repartition(tasks, "key")
    sums = dealt.drop("key").mapInArrow(_dependencies(n, len(keys)), "id int, dep double").groupBy("id").agg(F.sum("dep").alias("dep"))
    scale = 1.0 / ((n - 1) * (n - 2))
    return ids.join(sums.hint("merge"), "id", "left").select("node", (F.coalesce("dep", F.lit(0.0)) * scale).alias("betweenness"))


def _runs(batches):
    """Sorted links as runs: nodes, how many links each has, the first node like each, and the other ends; ``run`` orders the runs."""
    part = TaskContext.get().partitionId()
    for i, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        own, at, size = np.unique(batch.column(0).to_numpy(), return_index=True, return_counts=True)
        first, other = (batch.column(c).to_numpy() for c in (1, 2))
        row = [(part << 33) + i, *(x.astype(np.int32).tobytes() for x in (own, size, first[at], other))]
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], ["run", "own", "size", "first", "other"])


def _dependencies(n: int, tasks: int):
    """Of a task with the runs of all links: the dependencies on each node, of every ``tasks``-th source."""

    def of(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["task"], []).append((row["run"], *(np.frombuffer(row[c], np.int32) for c in ("own", "size", "first", "other"))))
        for task, runs in held.items():
            runs.sort(key=lambda r: r[0])
            size, like = np.zeros(n + 1, np.int64), np.zeros(n, np.int32)
            for _, own, sizes, firsts, _ in runs:
                size[own + 1] += sizes
                like[own] = firsts
            other = np.concatenate([r[4] for r in runs])
            runs.clear()
            out = _brandes(np.cumsum(size), other, like, np.unique(like)[task::tasks])
            for i in range(0, n, 10_000):
                part = out[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part)], ["id", "dep"])

    return of


def _brandes(first: np.ndarray, other: np.ndarray, like: np.ndarray, sources) -> np.ndarray:
    """Sums over ``sources``, and all nodes ``like`` them, of the dependencies on each node.

    Node ``i`` is linked to ``other[first[i] : first[i + 1]]``.
    """
    n = len(first) - 1
    total, depth, paths, dep = np.zeros(n), np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)

    def met(front: np.ndarray, level: int, x: np.ndarray):
        """Neighbours of ``front`` at depth ``level``, and the sums of ``x`` over their neighbours in it."""
        sizes = first[front + 1] - first[front]
        ends = np.cumsum(sizes)
        cuts = [0, *np.flatnonzero(np.diff(ends // VISITED)) + 1, len(front)]
        nodes, sums = [], []
        for i, j in zip(cuts, cuts[1:]):
            size = sizes[i:j]
            begins = np.cumsum(size) - size
            at = other[np.repeat(first[front[i:j]] - begins, size) + np.arange(begins[-1] + size[-1])]
            kept = depth[at] == level
            at, values = at[kept], np.repeat(x[i:j], size)[kept]
            if 16 * len(at) > n:
                got = np.bincount(at, values, n)
                nodes.append(np.flatnonzero(got))
                sums.append(got[nodes[-1]])
            else:
                own, place = np.unique(at, return_inverse=True)
                nodes.append(own)
                sums.append(np.bincount(place, values, len(own)))
        return zip(nodes, sums)

    for source in sources:
        depth[source], paths[source] = 0, 1.0
        levels = [np.array([source])]
        while len(levels[-1]):
            found = []
            for nodes, sums in met(levels[-1], -1, paths[levels[-1]]):
                paths[nodes] += sums
                found.append(nodes)
            levels.append(found[0] if len(found) == 1 else np.unique(np.concatenate(found)))
            depth[levels[-1]] = len(levels) - 1
        levels.pop()
        for level in range(len(levels) - 1, 0, -1):
            front = levels[level]
            for nodes, sums in met(front, level - 1, (1.0 + dep[front]) / paths[front]):
                dep[nodes] += paths[nodes] * sums
        dep[source] = 0.0
        twins = np.flatnonzero(like == source)
        twins = twins[twins != source]
        for front in levels:
            total[front] += (1 + len(twins)) * dep[front]
        if len(twins):
            # Those alike depend on each other, and none on itself.
            total[source] += len(twins) * dep[twins[0]]
            total[twins] -= dep[twins]
        for front in levels:
            depth[front], paths[front], dep[front] = -1, 0.0, 0.0
    return total


def chokepoints(
    edges: DataFrame, k: int, exact_up_to: int | None = None, budget_s: float | None = None, clock=time.monotonic
) -> DataFrame:
    """Top nodes by betweenness, always labelled by method: exact, or sampled for more than ``exact_up_to`` nodes, if given.

    Over ``budget_s`` seconds (none by default) the result is the eigenvector
    ranking, labelled as the fallback; if that fails too, no row but the label.
    """
    start, n = clock(), degrees(edges).count()
    exact = exact_up_to is None or n <= exact_up_to
    label = "betweenness_exact" if exact else "betweenness_sampled"
    late = budget_s is not None and clock() - start > budget_s
    found = betweenness(edges, None if exact else sample_sources(n)) if n and not late else degrees(edges).select("node", F.lit(0.0).alias("betweenness"))
    ranked = found.orderBy(F.desc("betweenness"), "node").limit(k).select("node", F.col("betweenness").alias("score"))
    ranked = ranked if late else settle(ranked)
    if n and budget_s is not None and clock() - start > budget_s:
        try:
            ranked, label = settle(top(eigenvector(edges), "score", k)), "eigenvector_fallback"
        except RuntimeError:
            ranked, label = ranked.where("false"), "budget_exhausted"
    return ranked.withColumn("method", F.lit(label))


def walk_embeddings(edges: DataFrame, dim: int = 16, walks: int = 8, steps: int = 4, seed: int = 1) -> DataFrame:
    """``node, embedding``: own features averaged with those of sampled neighbours.

    Neighbours are numbered, and a walk picks a number by hash, so no row holds
    a node's whole adjacency.
    """
    feats = node_features(edges, dim, seed)
    by_dst = Window.partitionBy("src").orderBy("dst")
    adjacency = symmetric(edges).withColumn("i", F.row_number().over(by_dst) - 1)
    adjacency = settle(adjacency.join(degrees(edges).withColumnRenamed("node", "src"), "src"))
    sizes = settle(degrees(edges))
    at = feats.select(F.col("node").alias("start"), F.col("node").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"))
    visited = None
    for step in range(steps):
        pick = F.pmod(F.xxhash64(F.lit(seed), "start", "walk", F.lit(step)), F.col("degree"))
        drawn = at.join(sizes, at["at"] == sizes["node"]).select("start", "walk", "at", pick.cast("int").alias("i"))
        here = adjacency.select(F.col("src").alias("at"), "i", F.col("dst").alias("next"))
        at = settle(drawn.join(here, ["at", "i"]).select("start", "walk", F.col("next").alias("at")))
        visited = at.select("start", "at") if visited is None else visited.union(at.select("start", "at"))
    mean = (
        visited.join(feats, visited["at"] == feats["node"]).select("start", F.posexplode("f").alias("i", "x"))
        .groupBy("start", "i").agg(F.avg("x").alias("x"))
        .groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    )
    joined = feats.join(mean, feats["node"] == mean["start"], "left")
    other = F.coalesce("m", F.transform("f", lambda x: F.lit(0.0)))
    return joined.select("node", F.zip_with("f", other, lambda a, b: (a + b) / 2).alias("embedding"))


def node_features(edges: DataFrame, dim: int = 16, seed: int = 1) -> DataFrame:
    """``node, f``: degree, clustering and hash-seeded normals."""

    def normal(i: int):
        u = [(F.pmod(F.xxhash64(F.lit(seed * 1000 + 2 * i + j), "node"), F.lit(1 << 30)) + 0.5) / float(1 << 30) for j in (0, 1)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])

    rest = [normal(i) for i in range(dim - 2)]
    return settle(clustering(edges).select("node", F.array(F.col("degree").cast("double"), "clustering", *rest).alias("f")))


def sage_weights(dim_in: int, hidden: int, dim_out: int, seed: int = 3) -> list[tuple]:
    """Two layers of weights (neighbours, self, bias), drawn once from a seed."""
    rng = np.random.default_rng(seed)

    def layer(a: int, b: int):
        return rng.normal(0, a**-0.5, (b, a)), rng.normal(0, a**-0.5, (b, a)), rng.normal(0, 0.1, b)

    return [layer(dim_in, hidden), layer(hidden, dim_out)]


def sage_embeddings(edges: DataFrame, dim: int = 32, weights: list[tuple] | None = None, dim_in: int = 16) -> DataFrame:
    """``node, embedding`` by two layers of neighbour means.

    A layer is ``W_n mean(neighbours) + W_s own + b``, the first one cut off at
    0. ``weights`` are a few small matrices, drawn from a seed unless given.
    """
    weights = weights or sage_weights(dim_in, max(dim, 16), dim)
    state, sym = node_features(edges, dim_in), settle(symmetric(edges))
    for depth, (near, own, bias) in enumerate(weights):
        mean = (
            sym.join(state, sym["dst"] == state["node"]).select("src", F.posexplode("f").alias("i", "x"))
            .groupBy("src", "i").agg(F.avg("x").alias("x"))
            .groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
        )
        both = state.join(mean, state["node"] == mean["src"], "left").select(
            "node", "f", F.coalesce("m", F.transform("f", lambda x: F.lit(0.0))).alias("m")
        )
        first = depth + 1 < len(weights)

        def layer(batches, near=near, own=own, bias=bias, first=first):
            for batch in batches:
                f, m = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (1, 2))
                out = m @ near.T + f @ own.T + bias if batch.num_rows else np.zeros((0, len(bias)))
                out = np.maximum(out, 0) if first else out
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], ["node", "f"])

        kind = both.schema["node"].dataType.simpleString()
        state = settle(both.mapInArrow(layer, f"node {kind}, f array<double>"))
    return state.withColumnRenamed("f", "embedding")


def closest(embeddings: DataFrame, node, k: int) -> DataFrame:
    """The nodes nearest to one node, without itself; an unknown node is an error."""
    from campwatch.operators.vectors import l2

    own = embeddings.where(F.col("node") == node)
    if own.isEmpty():
        raise KeyError(node)
    one = own.select(F.col("embedding").alias("e")).limit(1)
    found = embeddings.where(F.col("node") != node).crossJoin(F.broadcast(one))
    return found.select("node", l2(F.col("embedding"), F.col("e")).alias("distance")).orderBy("distance", "node").limit(k)


def top(df: DataFrame, score: str, k: int, by: str | None = None) -> DataFrame:
    """Top ``k`` rows by score, ties by node; per group if ``by`` is given."""
    if by is None:
        return df.orderBy(F.desc(score), "node").limit(k)
    w = Window.partitionBy(by).orderBy(F.desc(score), "node")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
