"""Queries over payments, devices, screens, and ordered event streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campwatch.functions import evidence, text
from campwatch.operators import conversation, device, evaluation, federated, ocr, transaction
from campwatch.sources import feeds, store
from campwatch.streaming import folds, live

# Permissions that synthetic apps draw from.
PERMISSIONS = (*device.TRIAD, "CAMERA", "INTERNET")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "event_type", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def messages(spark, sf_dir):
    """Events as short chat messages of their user's channel, one every few seconds."""
    rows = events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    body = F.when(F.col("event_id") % 3 == 0, "one two three four five").otherwise(F.concat(F.lit("m  "), F.col("k").cast("string")))
    sender = F.when(F.col("event_id") % 4 == 0, "victim").otherwise("caller")
    ms = n.cast("long") * 3000 + (F.col("event_id") % 5) * 700
    return rows.select("event_id", "user_id", sender.alias("sender"), body.alias("text"), ms.alias("ms"), n.cast("long").alias("n"))


def burst_reassembly(spark, sf_dir):
    out = conversation.reassemble(messages(spark, sf_dir), "user_id", "sender", "ms", "text", ["n"])
    return out.select("user_id", F.col("turn").cast("long").alias("turn"), "sender", "text", "start_ms", "end_ms", "n_messages")


def entity_salience(spark, sf_dir):
    last = events(spark, sf_dir).groupBy("user_id").agg((F.max("us") / 1e6).alias("last"), F.count("*").alias("n"))
    # One row: the newest event of all.
    newest = last.agg(F.max("last").alias("newest"))
    aged = last.crossJoin(F.broadcast(newest)).withColumn("age", F.col("newest") - F.col("last"))
    return aged.select("user_id", F.round(conversation.salience(F.col("n").cast("double"), F.col("age")), 4).alias("salience"))


def _payments(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("s", F.col("us") / 1e6)
    rows = transaction.last_flag(rows, "user_id", "s", F.col("event_type") == "error", ["event_id"])
    paid = rows.where("event_type = 'purchase'").withColumn("amount", F.col("value") * 6)
    return transaction.novelty(paid, "user_id", "k", "amount", "s", ["event_id"])


def payee_novelty(spark, sf_dir):
    return _payments(spark, sf_dir).select("event_id", "is_novel", "is_high_value", "recent_flag", "compound_risk")


def transaction_warning(spark, sf_dir):
    return transaction.warnings(_payments(spark, sf_dir), "amount").select("event_id", "headline", "explanation", F.array_join("actions", "|").alias("actions"))


def transaction_fpr(spark, sf_dir):
    return _payments(spark, sf_dir).agg(F.round(F.coalesce(F.avg(F.col("compound_risk").cast("int")), F.lit(0.0)), 6).alias("fpr"))


def _apps(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    has = [F.when(F.col("p_partkey") % m != 0, p) for p, m in zip(PERMISSIONS, (2, 3, 5, 7, 11), strict=True)]
    store = F.element_at(F.array(*map(F.lit, (*device.STORES, "com.evil.store"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return parts.select(
        "p_partkey", F.array_compact(F.array(*has)).alias("granted_permissions"),
        F.when(F.col("p_partkey") % 9 != 0, store).alias("installer"),
        F.concat(F.lit("sig_"), F.col("p_partkey").cast("string")).alias("signature"),
    )


def permission_triad(spark, sf_dir):
    return device.triad_findings(_apps(spark, sf_dir)).select("p_partkey", F.array_join("matched", ",").alias("matched"))


def sideload(spark, sf_dir):
    return _apps(spark, sf_dir).select("p_partkey", device.is_sideloaded(F.col("installer")).alias("sideloaded"))


def signature_bloom(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    known = apps.where("p_partkey % 25 = 0").select(F.col("signature").alias("sig"))
    return device.check_signatures(apps, "signature", known, "sig").select("p_partkey", "bloom_hit", "match")


def _boxes(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    seed = F.col("l_partkey") * 13 + F.col("l_suppkey") * 7 + F.col("l_linenumber") * 29
    return lines.select(
        F.col("l_orderkey").alias("screen_id"), F.col("l_linenumber").cast("int").alias("seq"),
        F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
        ((seed % 100) / 100.0).alias("confidence"), (seed % 89).cast("double").alias("x_pct"),
        ((seed * 3) % 97).cast("double").alias("y_pct"), (seed % 11).cast("double").alias("w_pct"),
        (seed % 5).cast("double").alias("h_pct"),
    )


def ocr_regions(spark, sf_dir):
    return ocr.regions(_boxes(spark, sf_dir)).groupBy("region").agg(F.count("*").alias("n"))


def ocr_serialize(spark, sf_dir):
    return ocr.serialize(_boxes(spark, sf_dir))


def ocr_wire_roundtrip(spark, sf_dir):
    back = _boxes(spark, sf_dir).select("screen_id", "seq", ocr.from_wire(ocr.to_wire(_boxes(spark, sf_dir))).alias("b"))
    return back.select("screen_id", "seq", "b.x_pct", "b.confidence", "b.text")


def ocr_heal(spark, sf_dir):
    return ocr.heal(_boxes(spark, sf_dir)).groupBy("screen_id").agg(F.count("*").alias("boxes"))


def release_gates(spark, sf_dir):
    per = events(spark, sf_dir).groupBy("user_id").agg(
        F.collect_list(F.col("value") * 10).alias("ms"), F.count("*").alias("n"), F.countDistinct("event_type").alias("hours")
    )
    found = evaluation.release_gates(per, "user_id", F.col("n") / 3.0, F.col("hours").cast("double"), F.col("ms"))
    return found.select("user_id", "gate", F.round("value", 6).alias("value"))


def ewma_changepoints(spark, sf_dir):
    return folds.run_batch(events(spark, sf_dir), folds.EWMA, "user_id", ["us", "event_id"]).groupBy("user_id").agg(
        F.count_if("changepoint").alias("changepoints"), F.count("*").alias("n")
    )


def token_bucket(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("ts", (F.col("n") * 17 + F.col("event_id") % 7) / 1.0)
    return folds.run_batch(rows, folds.TOKEN_BUCKET, "user_id", ["n"]).groupBy("user_id").agg(
        F.count_if("allowed").alias("allowed"), F.count("*").alias("n")
    )


def debounce(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("ts_ms", F.col("n") * 100 + F.col("event_id") % 60)
    return folds.run_batch(rows, folds.DEBOUNCE, "user_id", ["n"]).groupBy("user_id").agg(
        F.count_if("accepted").alias("accepted"), F.count("*").alias("n")
    )


def thermal_states(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("heat", (F.col("event_id") * 37 % 101) / 100.0).withColumn("fallback", F.col("event_id") % 6 == 0)
    levels = folds.run_batch(rows, folds.THERMAL, "user_id", ["us", "event_id"])
    return levels.join(F.broadcast(folds.policies(spark)), "level").groupBy("level", "max_tier", "tier2_variant").agg(F.count("*").alias("n"))


def wake_reasons(spark, sf_dir):
    """Last known inputs per user: a purchase opens a payment app, an error flags a call."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events(spark, sf_dir)

    def sticky(kind: str):
        return F.coalesce(F.last(F.when(F.col("event_type") == kind, F.col("event_id") % 2 == 0), ignorenulls=True).over(w), F.lit(False))

    moved = folds.run_batch(rows, folds.EWMA, "user_id", ["us", "event_id"]).select("event_id", "changepoint")
    levels = rows.select("event_id", sticky("purchase").alias("pays"), sticky("error").alias("call"))
    reasons = folds.wake_reasons(F.col("pays"), F.col("call"), F.col("changepoint"))
    out = levels.join(moved, "event_id").withColumn("reasons", reasons)
    return out.select("event_id", F.array_join("reasons", ",").alias("reasons"), text.prewarm(F.col("reasons")).alias("prewarm"))


def sync_abort(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("chunk", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")).cast("long") - 1)
    return federated.sync_abort(rows, "user_id", "chunk", F.col("event_id") % 13 != 0, F.col("event_id") % 17 != 0)


def circuit_breaker(spark, sf_dir):
    found = federated.circuit_breaker(events(spark, sf_dir), "user_id", F.col("event_type") == "error", ["us", "event_id"])
    return found.groupBy("user_id").agg(F.max("crash_count").alias("crashes"), F.bool_or("tripped").alias("tripped"))


def warning_registry(spark, sf_dir):
    """Unresolved warnings: the last action of each warning counts."""
    rows = events(spark, sf_dir).withColumn("warning", F.concat_ws(":", "user_id", "k"))
    last = rows.groupBy("user_id", "warning").agg(F.max_by("event_type", F.struct("us", "event_id")).alias("action"))
    return last.groupBy("user_id").agg(F.count_if(F.col("action") != "purchase").alias("unresolved"))


def retry_delay(spark, sf_dir):
    """A user's errors as failed attempts."""
    failed = events(spark, sf_dir).where("event_type = 'error'")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1
    return failed.select("event_id", nth.cast("long").alias("attempt")).withColumn("delay", federated.retry_delay(F.col("attempt")))


def canary_decision(spark, sf_dir):
    """Market segments as slices: what a baseline and a canary would each recall."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    hit = F.avg((F.col("c_custkey") % 10 < 8).cast("double")).alias("baseline_recall")
    lost = F.when(F.col("c_mktsegment") < "C", 7).otherwise(10)
    canary = F.avg(((F.col("c_custkey") % 10 < 8) & (F.col("c_custkey") % lost != 0)).cast("double")).alias("canary_recall")
    slices = customers.groupBy(F.col("c_mktsegment").alias("slice_name")).agg(hit, canary)
    return federated.canary_decision(slices, 0.02, 0.05).select("decision", F.array_join("reasons", "; ").alias("reasons"))


def feed_blob(spark, sf_dir):
    """Feeds of many lines in one text each, with comments and blank lines."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    line = F.concat_ws(
        ",", F.lit(" phone_number"), F.col("o_orderkey").cast("string"), F.lit("scam"),
        F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise("1.5"), F.lit("tok"),
    )
    lines = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l"))))
    raw = F.concat(F.lit("\n# feed\n\n"), F.array_join(F.transform(lines, lambda x: x["l"]), "\r\n"), F.lit("\n#,a,b,1,c\n"))
    blobs = orders.groupBy("o_custkey").agg(raw.alias("raw"))
    return feeds.parse_lines(feeds.split_blob(blobs)).groupBy("pattern_kind").agg(
        F.count("*").alias("n"), F.countDistinct("pattern_value").alias("distinct_values")
    )


def screen_text(spark, sf_dir):
    """Events as screen nodes: whitelisted apps, then the debounce, then what can be acted on."""
    rows = messages(spark, sf_dir).withColumn("ts_ms", F.col("n") * 100 + F.col("event_id") % 60)
    rows = rows.withColumn("package", F.when(F.col("event_id") % 4 == 0, "com.other").otherwise("com.pay"))
    shown = rows.where(F.col("package").isin("com.pay"))
    accepted = folds.run_batch(shown, folds.DEBOUNCE, "user_id", ["n"]).where("accepted").select("user_id", "n")
    nodes = shown.join(accepted, ["user_id", "n"]).select(
        "user_id", "package", (F.col("event_id") % 2 == 0).alias("clickable"), (F.col("event_id") % 5 == 0).alias("editable"),
        F.lit(False).alias("checkable"), F.when(F.col("event_id") % 7 != 0, F.col("text")).alias("text"),
    )
    return feeds.actionable_text(nodes, ("com.pay",)).groupBy("user_id").agg(F.count("*").alias("n"))


def ocr_from_unit(spark, sf_dir):
    """Observations with the origin at the bottom left, in wire form and back."""
    unit = _boxes(spark, sf_dir).select(
        "screen_id", "seq", "text", "confidence", (F.col("x_pct") / 128).alias("x"), (F.col("y_pct") / 128).alias("y"),
        (F.col("w_pct") / 64).alias("w"), (F.col("h_pct") / 64).alias("h"),
    )
    back = ocr.from_wire(ocr.to_wire(ocr.from_unit(unit)))
    return ocr.from_unit(unit).select("screen_id", "seq", back.alias("b")).select("screen_id", "seq", "b.x_pct", "b.y_pct", "b.w_pct", "b.h_pct")


def ocr_by_corner(spark, sf_dir):
    return ocr.serialize_by_corner(_boxes(spark, sf_dir))


def ocr_mean_confidence(spark, sf_dir):
    """Screens whose every box was rejected have a mean of 0."""
    boxes = _boxes(spark, sf_dir)
    found = ocr.mean_confidence(boxes.select("screen_id").distinct(), boxes.where("confidence > 0.5"))
    return found.select("screen_id", F.round("mean_confidence", 6).alias("mean_confidence"))


def shared_signals(spark, sf_dir):
    """Orders as shares: every third is a text, every seventh picture has no boxes left."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("text "), F.col("o_custkey").cast("string")))
    shares = orders.select(F.col("o_orderkey").alias("screen_id"), (F.col("o_custkey") * 1000).alias("created_at_ms"), text.alias("text"))
    found = ocr.shared_signals(shares, _boxes(spark, sf_dir).where("screen_id % 7 <> 0"))
    return found.withColumn("ocr_mean_confidence", F.round("ocr_mean_confidence", 6))


def citations_of_kinds(spark, sf_dir):
    """Permissions of apps and regions of screens as cited evidence, rendered."""
    apps = device.triad_findings(_apps(spark, sf_dir))
    package = F.concat(F.lit("app."), F.col("p_partkey").cast("string"))
    permissions = apps.select(F.transform("matched", lambda p: evidence.cite_permission(p, package)).alias("cites"))
    boxes = ocr.regions(_boxes(spark, sf_dir)).where("confidence >= 0.9")
    seen = boxes.select(F.array(evidence.cite_region(F.col("text"), F.col("region"))).alias("cites"))
    return permissions.union(seen).select(F.inline("cites"), evidence.render(F.col("cites")).alias("lines"))


def elapsed_since_prev(spark, sf_dir):
    out = conversation.elapsed(events(spark, sf_dir), "user_id", "us", ["us", "event_id"])
    return out.select("event_id", "elapsed_since_prev")


def latency_summary(spark, sf_dir):
    per = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("value") * 10)).alias("ms"))
    out = evaluation.latency_summary(per, "user_id", F.col("ms"))
    return out.select("user_id", F.col("measured").cast("long"), F.col("over").cast("long"), F.round("total", 4).alias("total"), F.round("slowest", 6).alias("slowest"))


def stage_totals(spark, sf_dir):
    """A user's events as the stages of one analysis."""
    timings = events(spark, sf_dir).select("user_id", F.concat("event_type", F.lit("/"), F.col("event_id").cast("string")).alias("stage"), "value")
    out = evaluation.stage_totals(timings, "user_id", "stage", "value")
    return out.select("user_id", F.round("total_ms", 4).alias("total_ms"), "slowest_stage", "exceeds", "notice")


def recording_sessions(spark, sf_dir):
    """A user's messages as screen regions; purchases stand for low memory."""
    rows = messages(spark, sf_dir).select(
        "user_id", (F.col("n") * 40_000).alias("at"), F.col("n").alias("seq"), "text", (F.col("event_id") % 6 == 0).alias("low")
    )
    out = live.recording_sessions(rows, "user_id", "at", "text", "low")
    return out.select("user_id", F.col("part").cast("long").alias("part"), "payload", "early_termination")


def key_values(spark, sf_dir):
    """The newest value of every key, as an upserted table holds it."""
    rows = events(spark, sf_dir).select(F.col("k").cast("string").alias("k"), F.col("event_id").cast("string").alias("v"), "us")
    return store.latest(rows, "k", "us").select("k", "v")


def rekey_due(spark, sf_dir):
    ages = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.datediff(F.lit("1998-12-01"), F.col("o_orderdate")) % 400).cast("double").alias("age"))
    return ages.select("o_orderkey", store.rekey_due(F.col("age")).alias("due"))


def payment_links(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    scheme = F.when(F.col("o_orderkey") % 5 == 0, "https").otherwise("upi")
    amount = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_custkey").cast("string"))
    url = F.concat(scheme, F.lit("://pay?pa=u"), F.col("o_custkey").cast("string"), F.lit("%40bank&am="), amount, F.lit("&pn=A"))
    return orders.select("o_orderkey", feeds.parse_payment_link(url).alias("p")).where("p IS NOT NULL").select("o_orderkey", "p.payee", "p.amount")


QUERIES = {
    f.__name__: f
    for f in (
        burst_reassembly, entity_salience, payee_novelty, transaction_warning, transaction_fpr,
        permission_triad, sideload, signature_bloom, ocr_regions, ocr_serialize, ocr_wire_roundtrip,
        ocr_heal, release_gates, ewma_changepoints, token_bucket, debounce, thermal_states, wake_reasons,
        sync_abort, circuit_breaker, warning_registry, retry_delay, canary_decision, payment_links,
        feed_blob, screen_text, ocr_from_unit, ocr_by_corner, ocr_mean_confidence, elapsed_since_prev,
        latency_summary, stage_totals, shared_signals, citations_of_kinds, recording_sessions, key_values, rekey_due,
    )
}

_EV = """ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
_PAY = f"""{_EV}, f AS (SELECT *, us / 1e6 AS s, last_value(CASE WHEN event_type = 'error' THEN us / 1e6 END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS lf FROM ev),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY us, event_id) = 1 AS is_novel, value * 6 >= 500 AS is_high_value,
  coalesce(s - lf <= 7200, false) AS recent_flag FROM f WHERE event_type = 'purchase'),
pay AS (SELECT *, is_novel::INT + is_high_value::INT + recent_flag::INT >= 2 AS compound_risk FROM p)"""
_APPS = """apps AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN (['com.android.vending', 'com.sec.android.app.samsungapps', 'com.amazon.venezia', 'com.evil.store'])[p_partkey % 4 + 1] END AS installer FROM part)"""
_BOX = """b0 AS (SELECT l_orderkey AS screen_id, l_linenumber AS seq, 'w' || l_partkey AS text, l_partkey * 13 + l_suppkey * 7 + l_linenumber * 29 AS seed FROM lineitem),
boxes AS (SELECT screen_id, seq, text, (seed % 100) / 100.0::DOUBLE AS confidence, (seed % 89)::DOUBLE AS x, ((seed * 3) % 97)::DOUBLE AS y, (seed % 11)::DOUBLE AS w, (seed % 5)::DOUBLE AS h FROM b0),
reg AS (SELECT *, least(2, floor((y + h / 2) / (100.0::DOUBLE / 3)))::INT AS r, least(2, floor((x + w / 2) / (100.0::DOUBLE / 3)))::INT AS c FROM boxes),
named AS (SELECT *, (['top', 'middle', 'bottom'])[r + 1] || '-' || (['left', 'center', 'right'])[c + 1] AS region FROM reg)"""
_MSG = f"""{_EV}, m AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN 'victim' ELSE 'caller' END AS sender,
  CASE WHEN event_id % 3 = 0 THEN 'one two three four five' ELSE 'm ' || k END AS text, event_id % 3 = 0 AS long,
  row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev), msg AS (SELECT *, n * 3000 + (event_id % 5) * 700 AS ms FROM m)"""

_FOLD = f"""{_EV}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev),
  w AS (SELECT user_id, n, event_id, 1 AS c, value AS mean, 1e-6::DOUBLE AS var, value AS fast, false AS cp FROM e WHERE n = 1 UNION ALL
    SELECT user_id, n, event_id, c + 1, CASE WHEN hit THEN mean ELSE mean + 0.02::DOUBLE * (value - mean) END,
      CASE WHEN hit THEN var ELSE 0.98::DOUBLE * var + 0.02::DOUBLE * (value - mean) * (value - mean) END, fast2, hit
    FROM (SELECT e.user_id, e.n, e.event_id, w.c, w.mean, w.var, e.value, 0.3::DOUBLE * e.value + 0.7::DOUBLE * w.fast AS fast2,
      w.c + 1 > 25 AND abs(0.3::DOUBLE * e.value + 0.7::DOUBLE * w.fast - w.mean) > 2.5::DOUBLE * sqrt(greatest(w.var, 1e-6::DOUBLE)) AS hit
      FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))"""
_HEAT = f"""{_EV}, e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n, (event_id * 37 % 101) / 100.0::DOUBLE AS heat, event_id % 6 = 0 AS fb FROM ev),
  t AS (SELECT *, CASE WHEN heat >= 0.95::DOUBLE OR (fb AND heat >= 0.85::DOUBLE) THEN 3 WHEN heat >= 0.85::DOUBLE THEN 2 WHEN heat >= 0.70::DOUBLE THEN 1 ELSE 0 END AS target FROM e),
  l AS (SELECT user_id, n, target AS lev FROM t WHERE n = 1 UNION ALL
    SELECT t.user_id, t.n, CASE WHEN target > lev THEN target WHEN target < lev AND NOT (fb AND lev = 3) AND heat <= ([0.70::DOUBLE, 0.85::DOUBLE, 0.95::DOUBLE])[lev] - 0.05::DOUBLE THEN lev - 1 ELSE lev END
    FROM l JOIN t ON t.user_id = l.user_id AND t.n = l.n + 1)"""
ORACLES = {
    "ewma_changepoints": f"WITH RECURSIVE {_FOLD} SELECT user_id, count(*) FILTER (cp) AS changepoints, count(*) AS n FROM w GROUP BY 1",
    "thermal_states": f"""WITH RECURSIVE {_HEAT}, p(lev, level, max_tier, tier2_variant) AS (VALUES (0, 'nominal', 2, '4bit'), (1, 'elevated', 2, '4bit'), (2, 'severe', 2, '2bit'), (3, 'critical_compound', 0, 'unavailable'))
      SELECT level, max_tier, tier2_variant, count(*) AS n FROM l JOIN p USING (lev) GROUP BY 1, 2, 3""",
    "token_bucket": f"""WITH RECURSIVE {_MSG}, t AS (SELECT user_id, n, (n * 17 + event_id % 7)::DOUBLE AS ts FROM msg),
      f AS (SELECT user_id, n, ts, 4.0::DOUBLE AS tokens, 1 AS ok FROM t WHERE n = 1 UNION ALL
        SELECT user_id, n, ts, CASE WHEN now >= 1 THEN now - 1 ELSE now END, CASE WHEN now >= 1 THEN 1 ELSE 0 END FROM
          (SELECT t.user_id, t.n, t.ts, least(5.0::DOUBLE, f.tokens + (t.ts - f.ts) * (1 / 60.0::DOUBLE)) AS now FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1))
      SELECT user_id, CAST(sum(ok) AS BIGINT) AS allowed, count(*) AS n FROM f GROUP BY 1""",
    "signature_bloom": f"""WITH s AS (SELECT p_partkey, 'sig_' || p_partkey AS sig FROM part),
      b AS (SELECT p_partkey, sig, list_transform(range(0, 5), lambda i: ('0x' || substr(sha256(i || ':' || sig), 13, 4))::INT % 8192) AS bits FROM s),
      k AS (SELECT list_distinct(flatten(list(bits))) AS bloom FROM b WHERE p_partkey % 25 = 0)
      SELECT p_partkey, list_has_all(bloom, bits) AS bloom_hit, CASE WHEN p_partkey % 25 = 0 THEN 'confirmed' WHEN list_has_all(bloom, bits) THEN 'unconfirmed' END AS match FROM b, k""",
    "ocr_heal": f"""WITH RECURSIVE {_BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY y, x, seq, text) AS n FROM boxes),
      f AS (SELECT screen_id, n, y, x + w AS e, 1 AS box FROM o WHERE n = 1 UNION ALL
        SELECT o.screen_id, o.n, CASE WHEN abs(o.y - f.y) < 1.5 AND o.x - f.e < 0.8 THEN f.y ELSE o.y END, o.x + o.w, CASE WHEN abs(o.y - f.y) < 1.5 AND o.x - f.e < 0.8 THEN 0 ELSE 1 END
        FROM f JOIN o ON o.screen_id = f.screen_id AND o.n = f.n + 1) SELECT screen_id, CAST(sum(box) AS BIGINT) AS boxes FROM f GROUP BY 1""",
    "canary_decision": """WITH s AS (SELECT c_mktsegment AS s, avg((c_custkey % 10 < 8)::INT) AS b, avg((c_custkey % 10 < 8 AND c_custkey % CASE WHEN c_mktsegment < 'C' THEN 7 ELSE 10 END <> 0)::INT) AS c FROM customer GROUP BY 1),
      r AS (SELECT 'false_positive_rate regressed 1.5000' || coalesce('; ' || string_agg('recall of ' || s, '; ' ORDER BY s), '') AS reasons FROM s WHERE b > 0 AND (b - c) / b > 0.05)
      SELECT 'rollback' AS decision, reasons FROM r""",
    "feed_blob": "SELECT 'phone_number' AS pattern_kind, count(*) AS n, count(DISTINCT o_orderkey) AS distinct_values FROM orders WHERE o_orderkey % 7 <> 0",
    "screen_text": f"""WITH RECURSIVE {_MSG}, t AS (SELECT event_id, user_id, n * 100 + event_id % 60 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY n) AS n FROM msg WHERE event_id % 4 <> 0),
      f AS (SELECT user_id, n, event_id, ms AS last, 1 AS acc FROM t WHERE n = 1 UNION ALL
        SELECT t.user_id, t.n, t.event_id, CASE WHEN t.ms - f.last >= 250 THEN t.ms ELSE f.last END, CASE WHEN t.ms - f.last >= 250 THEN 1 ELSE 0 END FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1)
      SELECT user_id, count(*) AS n FROM f WHERE acc = 1 AND (event_id % 2 = 0 OR event_id % 5 = 0) AND event_id % 7 <> 0 GROUP BY 1""",
    "ocr_from_unit": f"""WITH {_BOX} SELECT screen_id, seq, x / 128 * 100 AS x_pct, (1 - y / 128 - h / 64) * 100 AS y_pct, w / 64 * 100 AS w_pct, h / 64 * 100 AS h_pct FROM boxes""",
    "ocr_by_corner": f"""WITH {_BOX} SELECT screen_id, string_agg('[' || CASE WHEN y < 33 THEN 'top' WHEN y < 66 THEN 'center' ELSE 'bottom' END || '-' || CASE WHEN x < 33 THEN 'left' WHEN x < 66 THEN 'center' ELSE 'right' END || ']'
      || CASE WHEN confidence < 0.5::DOUBLE THEN ' [UNCERTAIN-OCR]' ELSE '' END || ' ' || text, chr(10) ORDER BY y, x, seq, text) AS prompt FROM boxes GROUP BY 1""",
    "ocr_mean_confidence": f"WITH {_BOX} SELECT screen_id, round(coalesce(avg(confidence) FILTER (confidence > 0.5::DOUBLE), 0.0), 6) AS mean_confidence FROM boxes GROUP BY 1",
    "elapsed_since_prev": f"WITH {_EV} SELECT event_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS elapsed_since_prev FROM ev",
    "latency_summary": f"""WITH {_EV} SELECT user_id, count(*) AS measured, count(*) FILTER (value * 10 > 800) AS over, round(sum(value * 10), 4) AS total, round(max(value * 10), 6) AS slowest FROM ev GROUP BY 1""",
    "stage_totals": f"""WITH {_EV}, t AS (SELECT user_id, sum(value) AS total, arg_max(event_type || '/' || event_id, (value, event_type || '/' || event_id)) AS slowest_stage FROM ev GROUP BY 1)
      SELECT user_id, round(total, 4) AS total_ms, slowest_stage, total > 800 AS exceeds, CASE WHEN total > 800 THEN '{evaluation.DEGRADED}' END AS notice FROM t""",
    "recording_sessions": f"""WITH {_MSG}, r AS (SELECT user_id, n, text, event_id % 6 = 0 AS low, (n - 1) * 40000 // 300000 AS tick FROM msg),
      c AS (SELECT *, CASE WHEN coalesce(lag(low) OVER w, false) OR tick > coalesce(lag(tick) OVER w, tick) THEN 1 ELSE 0 END AS closed FROM r WINDOW w AS (PARTITION BY user_id ORDER BY n)),
      p AS (SELECT *, sum(closed) OVER (PARTITION BY user_id ORDER BY n) AS part FROM c)
      SELECT user_id, CAST(part AS BIGINT) AS part, string_agg(CASE WHEN long_text THEN text ELSE replace(text, 'm ', 'm  ') END, chr(10) || '---' || chr(10) ORDER BY n) AS payload, bool_or(low) AS early_termination
      FROM (SELECT *, text = 'one two three four five' AS long_text FROM p) GROUP BY 1, 2""",
    "key_values": f"WITH {_EV} SELECT CAST(k AS VARCHAR) AS k, arg_max(CAST(event_id AS VARCHAR), (us, CAST(event_id AS VARCHAR))) AS v FROM ev GROUP BY 1",
    "rekey_due": "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') % 400 >= 180 AS due FROM orders",
    "burst_reassembly": f"""WITH {_MSG}, j AS (SELECT *, CASE WHEN lag(sender) OVER w = sender AND ms - lag(ms) OVER w <= 4000 AND NOT lag(long) OVER w THEN 0 ELSE 1 END AS new FROM msg WINDOW w AS (PARTITION BY user_id ORDER BY n)),
      t AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY n) AS turn FROM j)
      SELECT user_id, CAST(turn AS BIGINT) AS turn, first(sender ORDER BY n) AS sender, string_agg(text, ' ' ORDER BY n) AS text, first(ms ORDER BY n) AS start_ms, last(ms ORDER BY n) AS end_ms, count(*) AS n_messages FROM t GROUP BY 1, 2""",
    "entity_salience": f"""WITH {_EV}, l AS (SELECT user_id, max(us) / 1e6 AS last, count(*) AS n FROM ev GROUP BY 1)
      SELECT user_id, round(n * pow(0.5::DOUBLE, greatest(0.0, (SELECT max(last) FROM l) - last) / 259200.0::DOUBLE), 4) AS salience FROM l""",
    "payee_novelty": f"WITH {_PAY} SELECT event_id, is_novel, is_high_value, recent_flag, compound_risk FROM pay",
    "transaction_warning": f"""WITH {_PAY} SELECT event_id, 'This payment matches a pattern seen in scam cases -- take a moment before continuing.' AS headline,
      'Compound risk: ' || array_to_string(list_filter([CASE WHEN is_novel THEN 'this is a new payee' END, CASE WHEN is_high_value THEN 'the amount ($' || format('{{:,.2f}}', value * 6) || ') is above the $500 threshold' END,
      CASE WHEN recent_flag THEN 'a manipulation pattern was flagged in a recent conversation' END], lambda x: x IS NOT NULL), '; ') || '.' AS explanation, 'verify_first|continue_anyway' AS actions FROM pay WHERE compound_risk""",
    "transaction_fpr": f"WITH {_PAY} SELECT round(coalesce(avg(compound_risk::INT), 0.0), 6) AS fpr FROM pay",
    "permission_triad": "SELECT p_partkey, 'ACCESSIBILITY_SERVICE,BIND_DEVICE_ADMIN,SYSTEM_ALERT_WINDOW' AS matched FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0",
    "sideload": f"WITH {_APPS} SELECT p_partkey, installer IS NULL OR installer = 'com.evil.store' AS sideloaded FROM apps",
    "ocr_regions": f"WITH {_BOX} SELECT region, count(*) AS n FROM named GROUP BY 1",
    "ocr_serialize": f"""WITH {_BOX}, l AS (SELECT screen_id, r, c, '[' || region || '] ' || string_agg(text || CASE WHEN confidence < 0.55::DOUBLE THEN ' [low-confidence]' ELSE '' END, ' | ' ORDER BY y, x, seq, text) AS line FROM named GROUP BY screen_id, r, c, region)
      SELECT screen_id, string_agg(line, chr(10) ORDER BY r, c) AS prompt FROM l GROUP BY 1""",
    "ocr_wire_roundtrip": f"WITH {_BOX} SELECT screen_id, seq, x AS x_pct, confidence, text FROM boxes",
    "release_gates": f"""WITH {_EV}, u AS (SELECT user_id, count(*) / 3.0 / count(DISTINCT event_type) AS rate, count(*) FILTER (value * 10 > 800) AS over FROM ev GROUP BY 1)
      SELECT user_id, 'battery_drain' AS gate, round(rate, 6) AS value FROM u WHERE rate > 5 UNION ALL SELECT user_id, 'latency', over::DOUBLE FROM u WHERE over > 0""",
    "debounce": f"""WITH RECURSIVE {_MSG}, t AS (SELECT user_id, n, n * 100 + event_id % 60 AS ms FROM msg),
      f AS (SELECT user_id, n, ms AS last, 1 AS acc FROM t WHERE n = 1 UNION ALL
        SELECT t.user_id, t.n, CASE WHEN t.ms - f.last >= 250 THEN t.ms ELSE f.last END, CASE WHEN t.ms - f.last >= 250 THEN 1 ELSE 0 END FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1)
      SELECT user_id, CAST(sum(acc) AS BIGINT) AS accepted, count(*) AS n FROM f GROUP BY 1""",
    "wake_reasons": f"""WITH RECURSIVE {_FOLD}, s AS (SELECT event_id,
      coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id % 2 = 0 END IGNORE NULLS) OVER o, false) AS p,
      coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id % 2 = 0 END IGNORE NULLS) OVER o, false) AS c
      FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
      SELECT event_id, array_to_string(list_filter([CASE WHEN p THEN 'payment_app_foreground' END, CASE WHEN s.c THEN 'flagged_incoming_call' END, CASE WHEN cp THEN 'motion_anomaly_changepoint' END],
        lambda x: x IS NOT NULL), ',') AS reasons, p OR s.c AS prewarm FROM s JOIN w USING (event_id)""",
    "sync_abort": f"""WITH {_EV}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS chunk,
      CASE WHEN event_id % 13 = 0 THEN 'unplugged_mid_transfer' WHEN event_id % 17 = 0 THEN 'metered_mid_transfer' END AS r FROM ev)
      SELECT user_id, count(*) AS polls, arg_min(r, chunk) FILTER (r IS NOT NULL) AS reason, min(chunk) FILTER (r IS NOT NULL) AS failed_chunk FROM q GROUP BY 1""",
    "circuit_breaker": f"WITH {_EV} SELECT user_id, count(*) FILTER (event_type = 'error') AS crashes, count(*) FILTER (event_type = 'error') >= 3 AS tripped FROM ev GROUP BY 1",
    "warning_registry": f"""WITH {_EV}, l AS (SELECT user_id, k, arg_max(event_type, (us, event_id)) AS a FROM ev GROUP BY 1, 2)
      SELECT user_id, count(*) FILTER (a <> 'purchase') AS unresolved FROM l GROUP BY 1""",
    "retry_delay": f"""WITH {_EV}, a AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS attempt FROM ev WHERE event_type = 'error')
      SELECT event_id, attempt, least(3600.0::DOUBLE, 30 * pow(2.0::DOUBLE, attempt)) AS delay FROM a""",
    "shared_signals": f"""WITH {_BOX}, b AS (SELECT screen_id, avg(confidence) AS mean, string_agg('[' || CASE WHEN y < 33 THEN 'top' WHEN y < 66 THEN 'center' ELSE 'bottom' END || '-' || CASE WHEN x < 33 THEN 'left' WHEN x < 66 THEN 'center' ELSE 'right' END || ']'
        || CASE WHEN confidence < 0.5::DOUBLE THEN ' [UNCERTAIN-OCR]' ELSE '' END || ' ' || text, chr(10) ORDER BY y, x, seq, text) AS prompt FROM boxes WHERE screen_id % 7 <> 0 GROUP BY 1)
      SELECT o_orderkey AS screen_id, 1 AS key_version, o_custkey * 1000 AS created_at_ms, CASE WHEN o_orderkey % 3 = 0 THEN 'shared_text' ELSE 'shared_image_ocr' END AS source_kind,
        CASE WHEN o_orderkey % 3 = 0 THEN 'text ' || o_custkey ELSE coalesce(prompt, '') END AS structured_prompt, CASE WHEN o_orderkey % 3 <> 0 THEN round(coalesce(mean, 0.0::DOUBLE), 6) END AS ocr_mean_confidence
      FROM orders LEFT JOIN b ON screen_id = o_orderkey""",
    "citations_of_kinds": f"""WITH {_BOX}, p AS (SELECT p_partkey, unnest(['ACCESSIBILITY_SERVICE', 'BIND_DEVICE_ADMIN', 'SYSTEM_ALERT_WINDOW']) AS name FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0)
      SELECT 'permission_name' AS kind, name AS value, 'package=app.' || p_partkey AS locator,
        '- App permission: ACCESSIBILITY_SERVICE' || chr(10) || '- App permission: BIND_DEVICE_ADMIN' || chr(10) || '- App permission: SYSTEM_ALERT_WINDOW' AS lines FROM p
      UNION ALL SELECT 'ocr_region', text, 'region=' || region, '- On screen (' || region || '): "' || text || '"' FROM named WHERE confidence >= 0.9::DOUBLE""",
    "payment_links": """SELECT o_orderkey, 'u' || o_custkey || '@bank' AS payee, o_custkey::DOUBLE AS amount FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0""",
}
