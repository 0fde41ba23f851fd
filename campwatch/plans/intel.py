"""Queries over indicators, the incident graph, vectors, and their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.functions import evidence, model_output
from campwatch.functions import text as X
from campwatch.operators import federated, graph, incidents, vector_index, vectors
from campwatch.sources import feeds, report_feed
from campwatch.streaming import view

NOW = "1998-12-01"
K = 3


def _docs(spark, sf_dir) -> DataFrame:
    """Documents; every fiftieth names a wallet, which the synthetic texts never do."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    wallet = F.concat(F.lit(" 0x"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 40))
    return docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", wallet)).otherwise(F.col("text")))


#: Order lines of one task; a line makes about eleven pairs of nodes.
LINES = 100_000


def _pieces(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the reports and for their pairs; the count reads footers only."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return max(spark.sparkContext.defaultParallelism, math.ceil(lines / LINES))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as incidents: suppliers are phone nodes, brands payee nodes, customers wallet nodes."""
    lines, orders, parts = feeds.read_tables(spark, sf_dir, "lineitem", "orders", "part")
    # Well compressed files look small enough to be broadcast, and would grow in every task.
    rows = lines.select("l_orderkey", "l_suppkey", "l_partkey").join(
        parts.select("p_partkey", "p_brand").hint("merge"), F.col("l_partkey") == F.col("p_partkey")
    )
    # By order in pieces of bounded size; what is grouped by incident stays in them.
    rows = rows.select("l_orderkey", "l_suppkey", "p_brand").repartition(_pieces(spark, sf_dir), "l_orderkey").join(
        orders.select("o_orderkey", "o_orderdate", "o_custkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    key = F.array(
        F.concat(F.lit("phone_number:"), F.col("l_suppkey").cast("string")),
        F.concat(F.lit("payee_account:"), F.col("p_brand")),
        F.concat(F.lit("crypto_wallet:"), F.col("o_custkey").cast("string")),
    )
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    return rows.select(F.col("l_orderkey").alias("incident"), ts.alias("ts"), F.explode(key).alias("node"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.edges(reports(spark, sf_dir), _pieces(spark, sf_dir))


def script_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.script_hash(F.col("text")).alias("script"))


def script_reuse(spark, sf_dir):
    return script_hash(spark, sf_dir).groupBy("script").agg(F.countDistinct("doc_id").alias("n")).where("n > 1")


def extract_indicators(spark, sf_dir):
    """Phones and wallets of documents and of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = _docs(spark, sf_dir).select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text")
    return incidents.indicators(docs.union(pages), ["origin", "id"]).where("kind <> 'script_hash'")


def indicator_counts(spark, sf_dir):
    return incidents.indicators(_docs(spark, sf_dir), ["doc_id"]).groupBy("kind").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values")
    )


def _feed_lines(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    kind = F.element_at(F.array(*map(F.lit, (*feeds.KINDS, "unknown"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    line = F.concat_ws(
        ",", kind, F.col("o_custkey").cast("string"), F.lit(" scam "),
        F.when(F.col("o_orderkey") % 7 == 0, "5d").otherwise(F.col("o_orderkey").cast("string")),
        F.when(F.col("o_orderkey") % 11 == 0, "a,b").otherwise("tok"),
    )
    return orders.select("o_orderkey", line.alias("value"))


def feed_parse(spark, sf_dir):
    return feeds.parse_lines(_feed_lines(spark, sf_dir))


def incident_pairs(spark, sf_dir):
    return _links(spark, sf_dir).agg(
        F.count("*").alias("links"), F.sum("corroboration").alias("observations")
    )


def corroboration_counts(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("corroboration").agg(F.count("*").alias("links"))


def k_anonymous_edges(spark, sf_dir):
    return incidents.exposable(_links(spark, sf_dir)).select("a", "b", "corroboration", "last_active")


def incremental_links(spark, sf_dir):
    """The stored view after four batches, one of them applied twice and two of them summed up."""
    rows = reports(spark, sf_dir).groupBy("incident", "node").agg(F.max("ts").alias("ts"))
    folder = f"{graph.shared_folder(spark)}/view-{uuid.uuid4().hex[:12]}"
    # Batches arrive as files; all reports are joined once, not once a batch.
    arrived = rows.withColumn("part", F.pmod(F.xxhash64("incident", "node"), F.lit(4)).cast("int"))
    arrived.write.options(**view.COMPACT).partitionBy("part").parquet(f"{folder}/arrived")
    arrived = spark.read.schema(arrived.schema).parquet(f"{folder}/arrived")
    for number in (0, 1, 1, 2, 3):
        view.apply(arrived.where(F.col("part") == number).drop("part"), folder, number)
        if number == 2:
            view.compact(spark, folder, 1)
    return incidents.exposable(view.links(spark, folder))


def k_anonymous_nodes(spark, sf_dir):
    found = _links(spark, sf_dir)
    return incidents.nodes(reports(spark, sf_dir)).join(
        incidents.endpoints(incidents.exposable(found)), "node", "left_semi"
    )


def _now():
    return F.unix_timestamp(F.lit(NOW + " 00:00:00").cast("timestamp")).cast("double")


def live_risk_nodes(spark, sf_dir):
    found = incidents.nodes(reports(spark, sf_dir))
    kind = F.substring_index("node", ":", 1)
    age = incidents.age_days(_now(), F.col("last_seen"))
    return found.select("node", incidents.live_risk(kind, age).alias("active"))


def isolated_prune(spark, sf_dir):
    links = incidents.exposable(_links(spark, sf_dir))
    return incidents.prunable(incidents.nodes(reports(spark, sf_dir)), links, _now()).select("node", "last_seen")


def tier_demote(spark, sf_dir):
    links = incidents.exposable(_links(spark, sf_dir))
    return incidents.demotable(incidents.nodes(reports(spark, sf_dir)), links, _now(), 150.0).select("node")


def sms_blocklist(spark, sf_dir):
    links = incidents.exposable(_links(spark, sf_dir))
    return feeds.blocklist(incidents.endpoints(links)).withColumn("number", F.col("number").cast("long"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the incident graph that may be shown."""
    return incidents.exposable(_links(spark, sf_dir)).select("a", "b").checkpoint()


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph.use_checkpoints(spark)
    return graph_edges(spark, sf_dir)


def _first(edges: DataFrame) -> str:
    return edges.agg(F.min("a")).first()[0]


def degree_clustering(spark, sf_dir):
    return graph.clustering(_ready(spark, sf_dir)).select(
        "node", "degree", "triangles", F.round("clustering", 6).alias("clustering")
    )


def bfs_hops(spark, sf_dir):
    edges = _ready(spark, sf_dir)
    return graph.hops(edges, _first(edges), 6).select("node", F.col("hops").cast("long").alias("hops"))


def graph_paths(spark, sf_dir):
    """Shortest paths from the first node to the last of every kind, checked link by link."""
    edges = _ready(spark, sf_dir)
    goals = [r[0] for r in graph.degrees(edges).groupBy(F.substring_index("node", ":", 1).alias("kind")).agg(F.max("node")).select("max(node)").collect()]
    start, rows = _first(edges), []
    for goal in goals:
        path, _ = graph.find_path(edges, start, goal)
        rows += [(goal, i, *sorted(p)) for i, p in enumerate(zip(path, path[1:]))] or [(goal, -1, None, None)]
    steps = spark.createDataFrame(rows, "goal string, step long, a string, b string")
    linked = steps.join(edges.withColumn("real", F.lit(1)), ["a", "b"], "left")
    return linked.groupBy("goal").agg((F.max("step") + 1).alias("hops"), (F.count("real") == F.max("step") + 1).alias("whole"))


def pagerank_personalized(spark, sf_dir):
    edges = _ready(spark, sf_dir)
    seeds = spark.createDataFrame([(_first(edges),), ("nobody",)], "node string")
    return graph.personalized_pagerank(edges, seeds).select("node", F.round("score", 5).alias("score"))


def suspicion_topk(spark, sf_dir):
    return graph.top(pagerank_personalized(spark, sf_dir), "score", 10)


def betweenness_topk(spark, sf_dir):
    return graph.chokepoints(_ready(spark, sf_dir), 5)


def betweenness_sampled(spark, sf_dir):
    return graph.chokepoints(_ready(spark, sf_dir), 5, exact_up_to=0)


def chokepoint_fallback(spark, sf_dir):
    """No time at all: the labelled eigenvector ranking."""
    return graph.chokepoints(_ready(spark, sf_dir), 5, exact_up_to=0, budget_s=-1.0)


def eigenvector_topk(spark, sf_dir):
    return graph.top(graph.eigenvector(_ready(spark, sf_dir)), "score", 5)


def walk_embeddings(spark, sf_dir):
    return graph.walk_embeddings(_ready(spark, sf_dir))


def sage_embeddings(spark, sf_dir):
    return graph.sage_embeddings(_ready(spark, sf_dir))


def closest_cluster(spark, sf_dir):
    edges = _ready(spark, sf_dir)
    return graph.closest(graph.walk_embeddings(edges), _first(edges), 5)


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"))
    return base.where("vid % 100 = 0").select(F.col("vid").alias("qid"), F.col("vec").alias("qvec")), base


def _rounded(df):
    return df.select("qid", "vid", F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


def ann_exact_l2(spark, sf_dir):
    return _rounded(vectors.exact_top_k(*_vectors(spark, sf_dir), 5))


def ann_exact_cosine(spark, sf_dir):
    return _rounded(vectors.exact_top_k(*_vectors(spark, sf_dir), 5, "cosine"))


def nearest_excl_self(spark, sf_dir):
    return _rounded(vectors.exact_top_k(*_vectors(spark, sf_dir), 5, exclude_self=True))


def _index(spark, sf_dir, metric):
    q, v = _vectors(spark, sf_dir)
    folder = f"{graph.shared_folder(spark)}/index-{uuid.uuid4().hex[:12]}"
    return q, v, vector_index.build(vectors.checked(v) if metric == "cosine" else v, folder, metric)


def ann_lsh_recall(spark, sf_dir):
    """Whether the index finds nine of ten true neighbours by cosine, comparing few full vectors."""
    q, v, index = _index(spark, sf_dir, "cosine")
    found = vectors.recall(vectors.exact_top_k(q, v, 5, "cosine"), vector_index.search(q, index, 5))
    few = vector_index.shares(index, q, 5)
    return found.crossJoin(few).select(((F.col("recall") >= 0.9) & (F.col("compared_share") < 0.1)).alias("reached"))


def ann_index_recall(spark, sf_dir):
    """Recall of the index by distance, and the shares of pairs that it ranks by codes and compares in full."""
    q, v, index = _index(spark, sf_dir, "l2")
    found = vectors.recall(vectors.exact_top_k(q, v, 5), vector_index.search(q, index, 5))
    return found.crossJoin(vector_index.shares(index, q, 5)).select("recall", "ranked_share", "compared_share")


def ann_index_all(spark, sf_dir):
    """With all cells and every vector kept, the index must give the exact neighbours."""
    q, v, index = _index(spark, sf_dir, "l2")
    return _rounded(vector_index.search_all(q, index, 5))


def clip_l2(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.round(federated.l2_norm(federated.clip(F.col("v"), 0.5)), 6).alias("norm"))


def trimmed_mean(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("v"))
    return federated.trimmed_mean(v, "v").select(F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"), "kept")


def mask_cancellation(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    masked = federated.mask(v, "vec_id", "v").select(F.posexplode("v").alias("pos", "x"))
    return masked.groupBy("pos").agg(F.round(F.sum("x"), 3).alias("total")).select(F.col("pos").cast("long").alias("pos"), "total")


def mask_hides(spark, sf_dir):
    """Clients whose sent update is far from their own in some coordinate."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sent = federated.mask(v.withColumn("own", F.col("v")), "vec_id", "v")
    far = F.array_max(F.zip_with("v", "own", lambda a, b: F.abs(a - b)))
    return sent.agg(F.count("*").alias("clients"), F.count_if(far > 100).alias("hidden"))


def _contributions(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.withColumn("attested", F.col("vec_id") % 3 != 0)


def secure_rounds(spark, sf_dir):
    """A round of all attested clients, and one too small to be opened."""
    every = _contributions(spark, sf_dir)
    few = every.where("vec_id < 60")
    out = federated.secure_round(every, "v", "attested").withColumn("round", F.lit("all")).union(
        federated.secure_round(few, "v", "attested").withColumn("round", F.lit("few"))
    )
    return out.select("round", "success", "cohort_size", F.round(F.col("aggregate")[0], 6).alias("first"), F.size("aggregate").cast("long").alias("size"))


def _rounds(spark, sf_dir):
    """Months as training rounds: the share of all orders is the sampling rate."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    months = orders.groupBy(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM").alias("round")).agg(F.count("*").alias("n"))
    whole = F.broadcast(orders.agg(F.count("*").alias("total")))
    return months.crossJoin(whole).select("round", "n", F.lit(4.0).alias("noise_multiplier"), (F.col("n") / F.col("total")).alias("sampling_rate"))


def cited_links(spark, sf_dir):
    """Exposed links as cited evidence, rendered."""
    links = incidents.exposable(_links(spark, sf_dir))
    cites = links.select(F.array(evidence.cite_link(F.col("a"), F.col("b"), F.col("corroboration"))).alias("cites"))
    return cites.select(F.inline("cites"), evidence.render(F.col("cites")).alias("lines"))


def feed_source(spark, sf_dir):
    """The lines of ``feed_parse`` written as a feed and read by the data source, with what it dropped."""
    folder = f"{graph.shared_folder(spark)}/feed-{uuid.uuid4().hex[:12]}"
    _feed_lines(spark, sf_dir).select("value").write.text(folder)
    report_feed.register(spark)
    rows = spark.read.format("report_feed").option("counts", "true").load(folder)
    return rows.groupBy(F.coalesce("pattern_kind", F.lit("dropped")).alias("pattern_kind")).agg(
        F.sum(F.when(F.col("pattern_kind").isNotNull(), 1).otherwise(F.col("malformed"))).alias("lines"), F.sum("reported_epoch").alias("epochs")
    )


def epsilon_of_successes(spark, sf_dir):
    """Privacy spent over months as rounds; a month of an odd number of orders is deferred."""
    rounds = _rounds(spark, sf_dir).withColumn("success", F.col("n") % 2 == 0).drop("n")
    return federated.epsilon_of_successes(rounds).select("round", "success", F.round("epsilon", 6).alias("epsilon"))


def noise_spread(spark, sf_dir):
    """Mean and spread of the added noise agree with the mechanism's."""
    v = _contributions(spark, sf_dir).withColumn("own", F.col("v"))
    noisy = federated.add_noise(v, "vec_id", "v", 2.0, 1.5, 100, 5)
    added = noisy.select(F.explode(F.zip_with("v", "own", lambda a, b: a - b)).alias("x"))
    return added.select(F.abs(F.avg("x")).alias("m"), F.stddev("x").alias("s")).select(
        (F.col("m") < 0.02).alias("centred"), (F.abs(F.col("s") - 0.3) < 0.02).alias("spread")
    )


def softmax_scores(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = model_output.softmax(F.slice("v", 1, 4))
    return v.select("vec_id", *[F.round(p[i], 6).alias(f"p{i}") for i in range(4)])


def rdp_epsilon(spark, sf_dir):
    return federated.epsilon(_rounds(spark, sf_dir).drop("n")).select("round", F.round("epsilon", 6).alias("epsilon"))


def canary_cohort(spark, sf_dir):
    devices = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return federated.canary_cohort(devices, "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment")


QUERIES = {
    f.__name__: f
    for f in (
        script_hash, script_reuse, extract_indicators, indicator_counts, feed_parse, feed_source, cited_links, incident_pairs,
        corroboration_counts, k_anonymous_edges, incremental_links, k_anonymous_nodes, live_risk_nodes, isolated_prune,
        tier_demote, sms_blocklist, degree_clustering, bfs_hops, pagerank_personalized,
        suspicion_topk, graph_paths, betweenness_topk, betweenness_sampled, chokepoint_fallback,
        eigenvector_topk, walk_embeddings, sage_embeddings, closest_cluster, ann_exact_l2, ann_exact_cosine,
        nearest_excl_self, ann_lsh_recall, ann_index_recall, ann_index_all, clip_l2, trimmed_mean, mask_cancellation, mask_hides, secure_rounds, epsilon_of_successes,
        noise_spread, softmax_scores, rdp_epsilon, canary_cohort,
    )
}

_REPORTS = """reports AS (SELECT DISTINCT l_orderkey AS incident, epoch(CAST(o_orderdate AS TIMESTAMP)) AS ts, node FROM
  (SELECT l_orderkey, 'phone_number:' || l_suppkey AS node FROM lineitem UNION ALL
   SELECT l_orderkey, 'payee_account:' || p_brand FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL
   SELECT o_orderkey, 'crypto_wallet:' || o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) JOIN orders ON l_orderkey = o_orderkey),
nodes AS (SELECT node, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT incident) AS incidents FROM reports GROUP BY 1),
edges AS (SELECT x.node AS a, y.node AS b, count(*) AS corroboration, max(x.ts) AS last_active
  FROM reports x JOIN reports y ON x.incident = y.incident AND x.node < y.node GROUP BY 1, 2),
exposed AS (SELECT * FROM edges WHERE corroboration >= 5),
ends AS (SELECT a AS node FROM exposed UNION SELECT b FROM exposed),
aged AS (SELECT *, (epoch(TIMESTAMP '1998-12-01') - last_seen) / 86400.0 AS age FROM nodes),
cold AS (SELECT node FROM aged WHERE age >= 150 AND node NOT IN (
  SELECT a FROM exposed JOIN aged ON b = node WHERE age < 150 UNION SELECT b FROM exposed JOIN aged ON a = node WHERE age < 150))"""
_ROUNDS = """rounds AS (SELECT strftime(o_orderdate::DATE, '%Y-%m') AS r, count(*) AS n, count(*) / sum(count(*)) OVER () AS rate FROM orders GROUP BY 1),
alphas AS (SELECT i / 2.0::DOUBLE AS a FROM range(3, 64) u(i))"""
_PHONE = r"list_distinct(list_filter(list_transform(regexp_extract_all(text, '\+?\d(?:[\d\-\s().]{6,})\d'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: length(d) >= 8))"
_WALLET = r"list_distinct(regexp_extract_all(text, '\b(?:bc1[a-z0-9]{20,}|0x[a-fA-F0-9]{40}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b'))"
_SCRIPT = r"substr(sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))), 1, 32)"
_IND = f"""docs AS (SELECT 'document' AS origin, doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN text || ' 0x' || substr(sha256(doc_id::VARCHAR), 1, 40) ELSE text END AS text FROM documents),
src AS (SELECT * FROM docs UNION ALL SELECT 'page', page_id, html FROM pages),
ind AS (SELECT origin, id, 'phone_number' AS kind, unnest({_PHONE}) AS value FROM src UNION ALL
  SELECT origin, id, 'crypto_wallet', unnest({_WALLET}) FROM src UNION ALL SELECT origin, id, 'script_hash', {_SCRIPT} FROM src)"""
_GRAPH = f"""{_REPORTS}, s AS (SELECT a AS src, b AS dst FROM exposed UNION SELECT b, a FROM exposed), zero AS (SELECT min(a) AS z FROM exposed)"""
_HOPS = f"""{_GRAPH}, h AS (SELECT z AS node, 0::BIGINT AS hops FROM zero UNION SELECT dst, hops + 1 FROM h JOIN s ON src = node WHERE hops < 6), near AS (SELECT node, min(hops) AS hops FROM h GROUP BY 1)"""
_RANK = f"""{_GRAPH}, g AS (SELECT src, count(*) AS d FROM s GROUP BY 1), p AS (SELECT src AS node, CASE WHEN src = z THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM g, zero),
  r AS (SELECT 0 AS i, node, t AS score FROM p UNION ALL
    SELECT i + 1, p.node, 0.15::DOUBLE * any_value(p.t) + 0.85::DOUBLE * sum(r.score / g.d) FROM p JOIN s ON s.dst = p.node JOIN r ON r.node = s.src JOIN g ON g.src = s.src WHERE i < 130 GROUP BY i, p.node),
  rank AS (SELECT node, round(score, 5) AS score FROM r WHERE i = 130)"""


def _knn(distance: str, extra: str = "") -> str:
    return f"""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[64] AS qv FROM embeddings WHERE vec_id % 100 = 0),
      d AS (SELECT qid, vec_id AS vid, {distance} AS distance FROM q, embeddings {extra}),
      r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vid) AS rank FROM d)
      SELECT qid, vid, round(distance, 4) AS distance, rank FROM r WHERE rank <= 5"""


ORACLES = {
    "script_hash": f"WITH {_IND} SELECT id AS doc_id, {_SCRIPT} AS script FROM docs",
    "script_reuse": f"WITH {_IND} SELECT {_SCRIPT} AS script, count(DISTINCT id) AS n FROM docs GROUP BY 1 HAVING count(DISTINCT id) > 1",
    "extract_indicators": f"WITH {_IND} SELECT * FROM ind WHERE kind <> 'script_hash'",
    "indicator_counts": f"WITH {_IND} SELECT kind, count(*) AS n, count(DISTINCT value) AS distinct_values FROM ind WHERE origin = 'document' GROUP BY 1",
    "feed_parse": """WITH l AS (SELECT o_orderkey, (['payee_account', 'phone_number', 'script_hash', 'crypto_wallet', 'unknown'])[o_orderkey % 5 + 1] AS pattern_kind,
      CAST(o_custkey AS VARCHAR) AS pattern_value FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)
      SELECT o_orderkey, pattern_kind, pattern_value, 'scam' AS category, CAST(o_orderkey AS DOUBLE) AS reported_epoch, 'tok' AS device_attestation_token
      FROM l WHERE pattern_kind <> 'unknown'""",
    "incident_pairs": f"WITH {_REPORTS} SELECT count(*) AS links, CAST(sum(corroboration) AS BIGINT) AS observations FROM edges",
    "corroboration_counts": f"WITH {_REPORTS} SELECT corroboration, count(*) AS links FROM edges GROUP BY 1",
    "incremental_links": f"WITH {_REPORTS} SELECT a, b, corroboration, last_active FROM exposed",
    "k_anonymous_edges": f"WITH {_REPORTS} SELECT a, b, corroboration, last_active FROM exposed",
    "k_anonymous_nodes": f"WITH {_REPORTS} SELECT * FROM nodes WHERE node IN (SELECT node FROM ends)",
    "live_risk_nodes": f"WITH {_REPORTS} SELECT node, CASE WHEN node LIKE 'phone_number:%' THEN age <= 270 ELSE true END AS active FROM aged",
    "isolated_prune": f"WITH {_REPORTS} SELECT node, last_seen FROM aged WHERE age >= 90 AND node NOT IN (SELECT node FROM ends)",
    "tier_demote": f"WITH {_REPORTS} SELECT node FROM cold",
    "sms_blocklist": f"WITH {_REPORTS} SELECT DISTINCT CAST(substr(node, 14) AS BIGINT) AS number FROM ends WHERE node LIKE 'phone_number:%'",
    "degree_clustering": f"""WITH {_GRAPH}, g AS (SELECT src AS node, count(*) AS degree FROM s GROUP BY 1),
      t AS (SELECT x.src AS node, count(*) AS t FROM s x JOIN s y ON x.src = y.src AND x.dst < y.dst JOIN s z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1)
      SELECT node, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS clustering FROM g LEFT JOIN t USING (node)""",
    "bfs_hops": f"WITH RECURSIVE {_HOPS} SELECT * FROM near",
    "graph_paths": f"""WITH RECURSIVE {_HOPS}, goals AS (SELECT max(src) AS goal FROM s GROUP BY split_part(src, ':', 1))
      SELECT goal, hops, true AS whole FROM goals JOIN near ON node = goal""",
    "pagerank_personalized": f"WITH RECURSIVE {_RANK} SELECT * FROM rank",
    "suspicion_topk": f"WITH RECURSIVE {_RANK} SELECT * FROM rank ORDER BY score DESC, node LIMIT 10",
    "ann_lsh_recall": "SELECT true AS reached",
    "mask_hides": "SELECT count(*) AS clients, count(*) AS hidden FROM embeddings",
    "secure_rounds": """WITH v AS (SELECT 'all' AS round, embedding[1]::DOUBLE AS x FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT 'few', embedding[1]::DOUBLE FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id < 60),
      r AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY x) AS r, count(*) OVER (PARTITION BY round) AS n FROM v)
      SELECT round, n >= 50 AS success, n AS cohort_size, CASE WHEN n >= 50 THEN round(avg(x) FILTER (r > floor(n * 0.1) AND r <= n - floor(n * 0.1)), 6) END AS first, CASE WHEN n >= 50 THEN 64 END AS size FROM r GROUP BY round, n""",
    "epsilon_of_successes": f"""WITH {_ROUNDS}, s AS (SELECT r, n % 2 = 0 AS success, sum(CASE WHEN n % 2 = 0 THEN rate ELSE 0 END) OVER (ORDER BY r) AS spent FROM rounds)
      SELECT r AS round, success, round(min(a / 32.0::DOUBLE * spent + ln(100000) / (a - 1)), 6) AS epsilon FROM s, alphas GROUP BY r, success""",
    "cited_links": f"""WITH {_REPORTS} SELECT 'graph_link' AS kind, a || ' <-> ' || b AS value, 'corroborating_reports=' || corroboration AS locator,
      '- Matches a pattern reported by other users: ' || a || ' <-> ' || b AS lines FROM exposed""",
    "feed_source": """WITH l AS (SELECT (['payee_account', 'phone_number', 'script_hash', 'crypto_wallet', 'unknown'])[o_orderkey % 5 + 1] AS kind, o_orderkey AS k,
      o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 4 AS good FROM orders)
      SELECT CASE WHEN good THEN kind ELSE 'dropped' END AS pattern_kind, count(*) AS lines, sum(CASE WHEN good THEN k::DOUBLE END) AS epochs FROM l GROUP BY 1""",
    "noise_spread": "SELECT true AS centred, true AS spread",
    "softmax_scores": """WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(x::DOUBLE)) AS e FROM embeddings)
      SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[3] / list_sum(e), 6) AS p2, round(e[4] / list_sum(e), 6) AS p3 FROM e""",
    "ann_index_all": _knn("list_distance(embedding::DOUBLE[], qv::DOUBLE[])"),
    "ann_exact_l2": _knn("list_distance(embedding::DOUBLE[], qv::DOUBLE[])"),
    "ann_exact_cosine": _knn("1 - list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[])"),
    "nearest_excl_self": _knn("list_distance(embedding::DOUBLE[], qv::DOUBLE[])", "WHERE vec_id <> qid"),
    "clip_l2": "SELECT vec_id, round(least(0.5, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS norm FROM embeddings",
    "trimmed_mean": """WITH f AS (SELECT unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
      r AS (SELECT pos, x, row_number() OVER (PARTITION BY pos ORDER BY x) AS r, count(*) OVER (PARTITION BY pos) AS n FROM f)
      SELECT pos, round(avg(x), 6) AS mean, count(*) AS kept FROM r WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1) GROUP BY 1""",
    "mask_cancellation": """WITH f AS (SELECT unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
      SELECT pos, round(sum(x), 3) AS total FROM f GROUP BY 1""",
    "rdp_epsilon": f"""WITH {_ROUNDS}, s AS (SELECT r, sum(rate) OVER (ORDER BY r) AS spent FROM rounds)
      SELECT r AS round, round(min(a / 32.0::DOUBLE * spent + ln(100000) / (a - 1)), 6) AS epsilon FROM s, alphas GROUP BY r""",
    "canary_cohort": """WITH d AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= 3 AS picked FROM customer),
      n AS (SELECT greatest(count(*) FILTER (picked), CAST(floor(count(*) * 0.01::DOUBLE) AS BIGINT)) AS n FROM d),
      o AS (SELECT *, row_number() OVER (ORDER BY picked DESC, c_custkey) AS r FROM d) SELECT c_custkey, c_mktsegment FROM o, n WHERE r <= n""",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
