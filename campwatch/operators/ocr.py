"""Screen text: regions of a 3 x 3 grid, reading order, wire format, healing of split tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.55
ROWS, COLS = ("top", "middle", "bottom"), ("left", "center", "right")
EMPTY = "[no on-screen text detected]"


def region_index(start: Column, size: Column) -> Column:
    """Third of the screen that a centre lies in; a centre before the screen counts from its end."""
    third = F.least(F.lit(2), F.floor((start + size / F.lit(2.0)) / F.lit(100.0 / 3.0)))
    return F.when(third < 0, third + 3).otherwise(third).cast("int")


def regions(boxes: DataFrame) -> DataFrame:
    """Adds ``row``, ``col`` and ``region`` of each box, by its centre."""
    name = [F.array(*map(F.lit, n)) for n in (ROWS, COLS)]
    out = boxes.withColumn("row", region_index(F.col("y_pct"), F.col("h_pct")))
    out = out.withColumn("col", region_index(F.col("x_pct"), F.col("w_pct")))
    return out.withColumn(
        "region", F.concat_ws("-", name[0][F.col("row")], name[1][F.col("col")])
    )


def serialize(boxes: DataFrame, screen: str = "screen_id") -> DataFrame:
    """One prompt line per screen: regions in reading order, boxes by (y, x) inside each."""
    shown = F.when(F.col("confidence") < LOW_CONFIDENCE, F.concat("text", F.lit(" [low-confidence]")))
    # Equal places and numbers are ordered by the text itself, not by its marks.
    item = F.struct("y_pct", "x_pct", "seq", "text", F.coalesce(shown, F.col("text")).alias("t"))
    by_region = (
        regions(boxes).groupBy(screen, "row", "col", "region")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    line = F.concat(F.lit("["), F.col("region"), F.lit("] "), F.array_join(F.col("items.t"), " | "))
    part = F.struct("row", "col", line.alias("t"))
    return by_region.groupBy(screen).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n").alias("prompt")
    )


CORNER_UNCERTAIN = 0.5


def serialize_by_corner(boxes: DataFrame, screen: str = "screen_id") -> DataFrame:
    """The other convention: one line a box by (y, x), its region by the top left corner."""

    def third(column: str, names: tuple[str, str, str]) -> Column:
        return F.when(F.col(column) < 33, names[0]).when(F.col(column) < 66, names[1]).otherwise(names[2])

    region = F.concat_ws("-", third("y_pct", ("top", "center", "bottom")), third("x_pct", ("left", "center", "right")))
    mark = F.when(F.col("confidence") < CORNER_UNCERTAIN, " [UNCERTAIN-OCR]").otherwise("")
    line = F.concat(F.lit("["), region, F.lit("]"), mark, F.lit(" "), F.col("text"))
    item = F.struct("y_pct", "x_pct", "seq", "text", line.alias("t"))
    return boxes.groupBy(screen).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda p: p["t"]), "\n").alias("prompt")
    )


def mean_confidence(screens: DataFrame, boxes: DataFrame, screen: str = "screen_id") -> DataFrame:
    """Mean confidence of each screen's boxes; 0 for a screen without any."""
    mean = boxes.groupBy(screen).agg(F.avg("confidence").alias("mean"))
    return screens.select(screen).join(mean, screen, "left").select(
        screen, F.coalesce("mean", F.lit(0.0)).alias("mean_confidence")
    )


def shared_signals(shares: DataFrame, boxes: DataFrame, key_version: int = 1, screen: str = "screen_id") -> DataFrame:
    """The envelope in which shared content travels: ``key_version, created_at_ms, source_kind, structured_prompt, ocr_mean_confidence``.

    ``shares`` has a screen, ``created_at_ms`` and ``text``. A shared text is its
    own prompt and has no confidence; anything else is a picture, described by its
    boxes (none: an empty prompt and confidence 0).
    """
    prompts = serialize_by_corner(boxes, screen)
    means = mean_confidence(shares, boxes, screen).dropDuplicates([screen])
    out = shares.join(prompts, screen, "left").join(means, screen, "left")
    plain = F.col("text").isNotNull()
    return out.select(
        screen, F.lit(key_version).alias("key_version"), "created_at_ms",
        F.when(plain, "shared_text").otherwise("shared_image_ocr").alias("source_kind"),
        F.when(plain, F.col("text")).otherwise(F.coalesce("prompt", F.lit(""))).alias("structured_prompt"),
        F.when(~plain, F.col("mean_confidence")).alias("ocr_mean_confidence"),
    )


def from_unit(boxes: DataFrame) -> DataFrame:
    """Boxes from bottom-left unit coordinates to top-left percent."""
    return boxes.select(
        "*",
        (F.col("x") * 100).alias("x_pct"),
        ((1 - F.col("y") - F.col("h")) * 100).alias("y_pct"),
        (F.col("w") * 100).alias("w_pct"),
        (F.col("h") * 100).alias("h_pct"),
    )


def to_wire(boxes: DataFrame) -> Column:
    """``x,y,w,h,confidence|text``"""
    numbers = F.concat_ws(",", *[F.col(c).cast("string") for c in ("x_pct", "y_pct", "w_pct", "h_pct", "confidence")])
    return F.concat(numbers, F.lit("|"), F.col("text"))


def from_wire(line: Column) -> Column:
    numbers = F.split(F.substring_index(line, "|", 1), ",")
    names = ("x_pct", "y_pct", "w_pct", "h_pct", "confidence")
    return F.struct(
        *[F.try_element_at(numbers, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)],
        F.substr(line, F.instr(line, "|") + 1).alias("text"),
    )


def heal(boxes: DataFrame, screen: str = "screen_id") -> DataFrame:
    """Join boxes that one token was split into: same line, almost touching, no space between.

    Each box is compared with the merged box so far, an ordered fold.
    """
    item = F.struct("y_pct", "x_pct", "seq", "text", "confidence", "w_pct", "h_pct")
    ordered = boxes.groupBy(screen).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<y_pct:double,x_pct:double,seq:int,text:string,confidence:double,w_pct:double,h_pct:double>>"
    items = F.col("items").cast(kind)

    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        gap = b["x_pct"] - (last["x_pct"] + last["w_pct"])
        spaced = F.endswith(last["text"], F.lit(" ")) | F.startswith(b["text"], F.lit(" "))
        joins = (F.abs(b["y_pct"] - last["y_pct"]) < 1.5) & (gap < 0.8) & ~spaced
        merged = F.struct(
            last["y_pct"].alias("y_pct"), last["x_pct"].alias("x_pct"), last["seq"].alias("seq"),
            F.concat(last["text"], b["text"]).alias("text"),
            F.least(last["confidence"], b["confidence"]).alias("confidence"),
            (b["x_pct"] + b["w_pct"] - last["x_pct"]).alias("w_pct"),
            F.greatest(last["h_pct"], b["h_pct"]).alias("h_pct"),
        )
        rest = F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(rest, F.array(merged))).otherwise(
            F.concat(done, F.array(b))
        )

    folded = F.aggregate(items, F.array().cast(kind), step)
    return ordered.select(screen, F.inline(folded))
