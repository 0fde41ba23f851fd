"""Device checks: permission triads, sideloaded apps, signature lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Permissions that together mark stalkerware, and known app stores.
TRIAD = ("ACCESSIBILITY_SERVICE", "BIND_DEVICE_ADMIN", "SYSTEM_ALERT_WINDOW")
STORES = ("com.android.vending", "com.sec.android.app.samsungapps", "com.amazon.venezia")
BITS, HASHES = 8192, 5


def triad_findings(apps: DataFrame, permissions: str = "granted_permissions") -> DataFrame:
    """Apps that hold the whole triad, with the matched permissions in order."""
    overlap = F.array_sort(F.array_intersect(permissions, F.array(*map(F.lit, TRIAD))))
    return apps.withColumn("matched", overlap).where(F.size("matched") == len(TRIAD))


def is_sideloaded(installer: Column) -> Column:
    return F.coalesce(~installer.isin(*STORES), F.lit(True))


def bit_index(value: Column, i: int) -> Column:
    """Bit of one hash: the first eight digest bytes, big-endian, modulo the filter size."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{i}:"), value), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % BITS).cast("int")


def bits(value: Column) -> Column:
    return F.array(*[bit_index(value, i) for i in range(HASHES)])


def bloom(signatures: DataFrame, column: str) -> DataFrame:
    """One row ``bloom``: the filter as a bit set of BITS bits, 64 to a number, of all signatures.

    Bits of one number are joined by an aggregate where the signatures lie; at
    most BITS / 64 numbers are shuffled.
    """
    bit = signatures.select(F.explode(bits(F.col(column))).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
    found = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    every = F.sequence(F.lit(0), F.lit(BITS // 64 - 1))
    return found.select(F.transform(every, lambda w: F.coalesce(F.try_element_at("found", w), F.lit(0).cast("long"))).alias("bloom"))


def might_contain(bloom_set: Column, value: Column) -> Column:
    """Whether all bits of a value are set: one look-up a hash, however large the filter is."""
    held = None
    for i in range(HASHES):
        bit = bit_index(value, i)
        word = F.get(bloom_set, F.shiftright(bit, 6))
        one = F.getbit(word, bit.bitwiseAND(F.lit(63))) == 1
        held = one if held is None else held & one
    return held


def check_signatures(apps: DataFrame, column: str, signatures: DataFrame, sig_column: str) -> DataFrame:
    """Adds ``bloom_hit`` and ``match``: null (no hit), ``unconfirmed`` or ``confirmed``.

    The filter is BITS bits whatever the number of signatures, so it is
    broadcast; the exact check is a join on the signature.
    """
    exact = signatures.select(F.col(sig_column).alias("__sig")).distinct()
    out = apps.crossJoin(F.broadcast(bloom(signatures, sig_column)))
    out = out.withColumn("bloom_hit", might_contain(F.col("bloom"), F.col(column)))
    out = out.join(exact, F.col(column) == F.col("__sig"), "left")
    match = F.when(F.col("bloom_hit") & F.col("__sig").isNotNull(), "confirmed").when(F.col("bloom_hit"), "unconfirmed")
    return out.withColumn("match", match).drop("bloom", "__sig")
