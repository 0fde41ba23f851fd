"""Federated statistics: clipping, noise, masks, trimmed means, privacy cost, canaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_FLOOR, TRIM = 50, 0.1
CANARY_SHARE, PER_STRATUM = 0.01, 3
REGRESSION = 0.05
DELTA = 1e-5
#: Accuracy of the sketches that bracket a rank, and the share by which a bracket is wider than their error.
ACCURACY, SLACK = 2000, 0.001
#: Ranges among which the end of a cohort is looked for.
RANGES = 64


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def clip(v: Column, limit: float) -> Column:
    """Scale a vector down to at most ``limit`` in length."""
    norm = l2_norm(v)
    return F.when(norm > limit, F.transform(v, lambda x: x * (F.lit(limit) / norm))).otherwise(v)


def _normal(*parts: Column) -> Column:
    """Standard normal from a hash of its arguments."""
    u = [(F.pmod(F.xxhash64(F.lit(i), *parts), F.lit(1 << 40)) + 0.5) / float(1 << 40) for i in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def add_noise(updates: DataFrame, key: str, column: str, multiplier: float, limit: float, clients: int, seed: int) -> DataFrame:
    """Gaussian noise of the mechanism's spread on every coordinate, by a seeded hash."""
    spread = multiplier * limit / math.sqrt(max(1, clients))
    noisy = F.transform(F.col(column), lambda x, i: x + spread * _normal(F.lit(seed), F.col(key), i))
    return updates.withColumn(column, noisy)


def mask(updates: DataFrame, key: str, column: str, cohort: int = 16, seed: int = 11) -> DataFrame:
    """Add pairwise masks that cancel over all clients and hide each of them.

    Clients are dealt to cohorts of about ``cohort`` by a hash of their key, as
    many cohorts as there are clients for. Every two clients of a cohort share a
    mask, drawn coordinate by coordinate from their pair's seed, which the one
    adds and the other subtracts. A client that would be alone joins another
    cohort; fewer than two clients cannot be masked. Work grows with clients
    times ``cohort``, not with their square.
    """
    clients = updates.select(key).distinct()
    n = clients.count()
    if n < 2:
        raise ValueError("masking needs at least two clients")
    group = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(max(1, n // cohort)))
    dealt = clients.select(key, group.alias("__g"))
    sizes = dealt.groupBy("__g").agg(F.count("*").alias("__n"))
    host = sizes.where("__n > 1").agg(F.min("__g")).first()[0]
    home = F.when(F.col("__n") > 1, F.col("__g")).otherwise(F.lit(host if host is not None else 0))
    peers = (
        dealt.join(sizes, "__g").select(key, home.alias("__g"))
        .groupBy("__g").agg(F.collect_list(key).alias("__peers"))
        .select("__peers", F.explode("__peers").alias(key))
    )

    def shared(peer: Column, place: Column) -> Column:
        drawn = 1000.0 * _normal(F.lit(seed), F.least(F.col(key), peer), F.greatest(F.col(key), peer), place)
        return F.when(peer > F.col(key), drawn).when(peer < F.col(key), -drawn).otherwise(0.0)

    masked = F.transform(
        F.col(column), lambda x, i: x + F.aggregate("__peers", F.lit(0.0), lambda s, p: s + shared(p, i))
    )
    return updates.join(peers, key).withColumn(column, masked).drop("__peers")


def trimmed_mean(updates: DataFrame, column: str, trim: float = TRIM) -> DataFrame:
    """Coordinate means without the ``trim`` share at each end: ``pos, mean, kept``.

    A mergeable sketch per coordinate brackets the two cut values. Then every
    value is counted and summed in its band: below, between and above the
    brackets one row a coordinate, inside them one row a distinct value, so exact
    cuts are found among a few values in a thousand. Both passes aggregate where
    the updates lie; only the bands are shuffled. The brackets travel to the
    updates as one row that is four times as wide as an update. Values that are
    null or not a number are left out.
    """
    ends = [max(0.0, trim - SLACK), min(1.0, trim + SLACK), max(0.0, 1 - trim - SLACK), min(1.0, 1 - trim + SLACK)]
    flat = updates.select(F.posexplode(column).alias("pos", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    brackets = flat.groupBy("pos").agg(F.percentile_approx("x", ends, ACCURACY).alias("cuts"))
    whole = brackets.agg(F.map_from_entries(F.collect_list(F.struct("pos", "cuts"))).alias("cuts"))
    x, cut = F.col("x"), [F.col("c")[i] for i in range(4)]
    band = F.when(x < cut[0], 0).when(x <= cut[1], 1).when(x < cut[2], 2).when(x <= cut[3], 3).otherwise(4)
    met = updates.select(column).crossJoin(F.broadcast(whole)).select(F.posexplode(column).alias("pos", "x"), "cuts")
    met = met.where("x IS NOT NULL AND NOT isnan(x)").select("pos", "x", F.col("cuts")[F.col("pos")].alias("c"))
    bands = met.select("pos", "x", band.alias("band")).withColumn("value", F.when(F.col("band").isin(1, 3), F.col("x")))
    sums = bands.groupBy("pos", "band", "value").agg(F.count("*").alias("c"), F.sum("x").alias("s"))
    upto = Window.partitionBy("pos").orderBy("band", "value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sums.withColumn("to", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("pos")))
    k = F.floor(F.col("n") * F.lit(trim))
    stays = F.greatest(F.lit(0), F.least("to", F.col("n") - k) - F.greatest(F.col("to") - F.col("c"), k))
    parts = ranked.withColumn("kept", stays).where("kept > 0")
    share = F.when(F.col("value").isNull(), F.col("s")).otherwise(F.col("value") * F.col("kept"))
    return parts.groupBy("pos").agg((F.sum(share) / F.sum("kept")).alias("mean"), F.sum("kept").alias("kept"))


def epsilon_of_successes(rounds: DataFrame, order: str = "round", delta: float = DELTA) -> DataFrame:
    """Privacy spent after each round when only successful rounds count: ``order, success, epsilon``."""
    counted = rounds.withColumn("sampling_rate", F.when(F.col("success"), F.col("sampling_rate")).otherwise(0.0))
    return epsilon(counted, order, delta).join(rounds.select(order, "success"), order)


def secure_round(contributions: DataFrame, column: str, attested: str) -> DataFrame:
    """One aggregated update, or a deferral when fewer than K_FLOOR attested clients take part."""
    valid = contributions.where(F.col(attested))
    size = valid.agg(F.count("*").alias("cohort_size"))
    means = trimmed_mean(valid, column).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("aggregate")
    )
    out = size.crossJoin(F.broadcast(means))
    success = F.col("cohort_size") >= K_FLOOR
    return out.select(
        success.alias("success"), "cohort_size", F.when(success, F.col("aggregate")).alias("aggregate"),
        F.when(success, "aggregated").otherwise("deferred: below the anonymity floor").alias("detail"),
    )


def epsilon(rounds: DataFrame, order: str = "round", delta: float = DELTA) -> DataFrame:
    """Running privacy bound after each round: ``round, epsilon``.

    Renyi costs of 61 orders add up over rounds; each order gives a bound and
    the smallest counts.
    """
    orders = F.explode(F.transform(F.sequence(F.lit(3), F.lit(63)), lambda i: i / F.lit(2.0)))
    cost = F.col("alpha") / (2 * F.col("noise_multiplier") * F.col("noise_multiplier")) * F.col("sampling_rate")
    running = Window.partitionBy("alpha").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spent = rounds.withColumn("alpha", orders).withColumn("rdp", F.sum(cost).over(running))
    bound = F.col("rdp") + F.lit(math.log(1 / delta)) / (F.col("alpha") - 1)
    return spent.groupBy(order).agg(F.min(bound).alias("epsilon"))


def canary_cohort(devices: DataFrame, stratum: str, order: str, share: float = CANARY_SHARE) -> DataFrame:
    """The first few devices of every stratum, then others in order up to the share of all.

    ``order`` is a unique number or time. How many others there is room for ends
    in one of the ranges that a sketch cuts; ranges before it go in whole, and
    only that one is sorted. Nothing runs while the plan is built.
    """
    by, at = F.coalesce(F.col(stratum), F.lit("unknown")), F.col(order)
    nth = F.row_number().over(Window.partitionBy("__by").orderBy(order))
    named = devices.withColumn("__by", by)
    picked = named.withColumn("__nth", nth).where(F.col("__nth") <= PER_STRATUM).drop("__nth")
    last = picked.groupBy("__by").agg(F.max(order).alias("__last"))
    rest = named.join(last, "__by").where(at > F.col("__last")).drop("__last")
    sizes = devices.agg(F.count("*").alias("__n")).crossJoin(F.broadcast(picked.agg(F.count("*").alias("__p"))))
    room = (F.greatest(F.col("__p"), F.floor(F.col("__n") * F.lit(share))) - F.col("__p")).alias("__room")
    steps = sorted({min(1.0, 1.25 * share * i / RANGES) for i in range(RANGES + 1)})
    cuts = rest.agg(F.percentile_approx(order, steps, 10_000).alias("__cuts"))
    ranged = rest.crossJoin(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < at))).drop("__cuts")
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    # At most RANGES + 2 rows.
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__c")).withColumn("__to", F.sum("__c").over(upto))
    end = counts.crossJoin(F.broadcast(sizes.select(room))).where("__to >= __room").agg(
        F.min(F.struct("__range", (F.col("__to") - F.col("__c")).alias("before"), "__room")).alias("__end")
    )
    dealt = ranged.crossJoin(F.broadcast(end))
    whole = dealt.where(F.col("__range") < F.col("__end.__range"))
    cut = dealt.where(F.col("__range") == F.col("__end.__range"))
    cut = cut.withColumn("__r", F.row_number().over(Window.partitionBy("__range").orderBy(order)))
    cut = cut.where(F.col("__r") <= F.col("__end.__room") - F.col("__end.before"))
    columns = devices.columns
    return picked.select(columns).union(whole.select(columns)).union(cut.select(columns))


def canary_decision(slices: DataFrame, base_fpr: float, canary_fpr: float) -> DataFrame:
    """``decision, reasons`` from slices (slice_name, baseline_recall, canary_recall)."""
    base = max(base_fpr, 1e-6)
    fp = (canary_fpr - base) / base
    first = [f"false_positive_rate regressed {fp:.4f}"] if fp > REGRESSION else []
    lost = (F.col("baseline_recall") - F.col("canary_recall")) / F.col("baseline_recall")
    bad = slices.where(F.col("baseline_recall") > 0).where(lost > REGRESSION)
    found = bad.agg(F.array_sort(F.collect_list("slice_name")).alias("slices"))
    reasons = F.concat(F.array(*map(F.lit, first)).cast("array<string>"), F.transform("slices", lambda s: F.concat(F.lit("recall of "), s)))
    return found.select(
        F.when(F.size(reasons) > 0, "rollback").otherwise("promote").alias("decision"), reasons.alias("reasons")
    )


def retry_delay(attempt: Column) -> Column:
    """Seconds until the next attempt: doubling from 30, at most an hour."""
    return F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), attempt))


def circuit_breaker(events: DataFrame, key: str, crashed: Column, order: list[str], limit: int = 3) -> DataFrame:
    """Adds ``crash_count`` and ``tripped`` from the running number of crashes."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("crash_count", F.count_if(crashed).over(w))
    return out.withColumn("tripped", F.col("crash_count") >= limit)


def sync_abort(polls: DataFrame, key: str, chunk: str, charging: Column, unmetered: Column) -> DataFrame:
    """Where each transfer stops: the first chunk whose conditions fail, and why."""
    reason = F.when(~charging, "unplugged_mid_transfer").when(~unmetered, "metered_mid_transfer")
    return polls.groupBy(key).agg(
        F.count("*").alias("polls"),
        F.min_by(reason, F.when(reason.isNotNull(), F.col(chunk))).alias("reason"),
        F.min(F.when(reason.isNotNull(), F.col(chunk))).alias("failed_chunk"),
    )
