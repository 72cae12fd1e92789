"""Palette slots, options and checks: small relational operators on palettes, colour lists and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions import pixels as px

C = F.col
# The greatest 32-bit integer, and bytes of an integer pixel, of a float pixel and of a pointer.
INT_MAX, PIXEL_BYTES, FLOAT_PIXEL_BYTES, POINTER_BYTES = 2**31 - 1, 4, 16, 8
#: Fixed value: the colour that a clear palette entry gets.
CLEAR = {"r": 71, "g": 112, "b": 76, "a": 0}


def size_allowed(width: Column, height: Column) -> Column:
    """SRC11: positive sizes whose buffers' lengths fit in an integer."""
    w, h = width.cast("long"), height.cast("long")
    per_row = F.floor(F.lit(INT_MAX // PIXEL_BYTES) / F.greatest(h, F.lit(1)))
    return (w > 0) & (h > 0) & (w <= per_row) & (w <= INT_MAX // 16 // FLOAT_PIXEL_BYTES) & (h <= INT_MAX // POINTER_BYTES)


def from_entries(entries: DataFrame) -> DataFrame:
    """SRC10: a histogram of caller's (r, g, b, a, count) entries; clear colours are one, equal ones add up."""
    clear = C("a") == 0
    return entries.groupBy(*[F.when(clear, 0).otherwise(C(c)).alias(c) for c in "rgba"]).agg(F.sum("count").cast("long").alias("weight"))


def raised_alpha(a: Column, least: int) -> Column:
    """PX14: what is nearly as opaque as `least` of 255 is raised on a line that makes `least` itself opaque."""
    opaque = least / 255
    almost = opaque * 169 / 256
    raised = (F.lit(almost) + (a / 255.0 - almost) * (1 - almost) / (opaque - almost)) * 256
    return F.when(a >= int(almost * 255), F.when(raised >= 255, 255).otherwise(F.floor(raised))).otherwise(a).cast("int")


def kept_aspect(side: Column, ratio: float) -> Column:
    """PX22: the other side for a side and the ratio of the two, rounded, one at least."""
    return F.greatest(F.lit(1), F.floor(side / F.lit(ratio) + 0.5)).cast("int")


def mse_to_quality(mse: Column) -> Column:
    """PX15, AGG11: the best quality whose error is not exceeded, 0 if none."""
    good = F.filter(F.sequence(F.lit(1), F.lit(100)), lambda q: mse <= px.quality_to_mse(q) + 0.000001)
    return F.coalesce(F.array_max(good), F.lit(0)).cast("int")


def standard_mse(mse: Column) -> Column:
    """AGG11: an internal error on the usual scale."""
    return mse * 65536.0 / 6.0


def boxes_good_enough(boxes: DataFrame, target: float) -> DataFrame:
    """AGG6: per image, whether the boxes' total error is at most the target times their weight. boxes: image_id, error, weight."""
    return boxes.groupBy("image_id").agg((F.sum("error") <= target * F.sum("weight")).alias("enough"))


def locked_colours(tray: DataFrame) -> DataFrame:
    """FLT7."""
    return tray.where("locked")


def rounded_palette(palette: DataFrame, bits: int) -> DataFrame:
    """QNT7: bytes posterized; clear entries that are not fixed become the clear colour. palette: r, g, b, a as bytes, fixed."""
    clear = (px.posterize(C("a"), bits) == 0) & ~C("fixed")
    return palette.withColumns({c: F.when(clear, CLEAR[c]).otherwise(px.posterize(C(c), bits)) for c in "rgba"})


def dropped(tray: DataFrame, source: DataFrame, slots: list[int] | None = None) -> DataFrame:
    """QNT15: slots (all, if none are given) take the source palette's colours. tray, source: image_id, idx, r, g, b."""
    s = source.select("image_id", "idx", *[C(c).alias(f"new_{c}") for c in "rgb"])
    hit = C("new_r").isNotNull() & (C("idx").isin(slots) if slots is not None else F.lit(True))
    return tray.join(s, ["image_id", "idx"], "left").select("image_id", "idx", *[F.when(hit, C(f"new_{c}")).otherwise(C(c)).alias(c) for c in "rgb"])


def by_vantage_distance(palette: DataFrame) -> DataFrame:
    """SRT5: places by distance from the most popular entry (ties: smaller idx). palette: image_id, idx, r, g, b, weight."""
    first = palette.groupBy("image_id").agg(F.max_by(F.struct("r", "g", "b"), F.struct("weight", -C("idx"))).alias("v"))
    d = sum(((C(c) - C(f"v.{c}")) * (C(c) - C(f"v.{c}")) for c in "rgb"), F.lit(0))
    return palette.join(first, "image_id").withColumn("d", d).select("image_id", "idx", "d", (F.row_number().over(Window.partitionBy("image_id").orderBy("d", "idx")) - 1).alias("place"))


def refill(tray: DataFrame, palette: DataFrame, locked: int) -> DataFrame:
    """QNT14: unlocked tray slots take palette entries in order, locked ones its tail from 16 - locked.

    tray: image_id, slot, locked; palette: image_id, idx, r, g, b.
    """
    place = F.row_number().over(Window.partitionBy("image_id", "locked").orderBy("slot")) - 1
    asked = tray.withColumn("idx", F.when(F.col("locked"), place + (16 - locked)).otherwise(place))
    return asked.join(palette, ["image_id", "idx"], "left").select("image_id", "slot", "r", "g", "b")
