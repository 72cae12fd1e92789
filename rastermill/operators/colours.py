"""Histograms, colour statistics and nearest-colour look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions import pixels as px

C = F.col
#: Largest palette that the quantizer makes (LIM1); palettes are literals, so their size is bounded.
MOST_COLOURS = 256


def distinct_colours(pixels: DataFrame) -> DataFrame:
    """AGG1: exact count over all four channels."""
    return pixels.groupBy("image_id").agg(F.countDistinct(px.pack(C("r"), C("g"), C("b"), C("a"))).alias("colours"))


def histogram(pixels: DataFrame, bits: int = 0, per_image: bool = True) -> DataFrame:
    """HIST1 (HIST4 without images): posterized colours, transparent ones as one key, with weights.

    A pixel weighs 255, or its `importance` column if there is one; transparent ones weigh 2000.
    """
    clear = C("a") == 0
    keys = [F.when(clear, 0).otherwise(px.posterize(C(c), bits)).alias(c) for c in "rgba"]
    own = C("importance") if "importance" in pixels.columns else F.lit(255)
    rows = pixels.select(*(["image_id"] if per_image else []), *keys, F.when(clear, 2000).otherwise(own).alias("w"))
    return rows.groupBy(*(["image_id"] if per_image else []), *"rgba").agg(F.sum("w").cast("long").alias("weight"))


def normalised(hist: DataFrame, sizes: DataFrame) -> DataFrame:
    """HIST2: weight / 128, at most a tenth of the image's pixels (sizes: image_id, n), and the image's total weight."""
    w = F.least(C("weight") / 128.0, C("n") * 0.1)
    totals = hist.join(sizes, "image_id").withColumn("perceptual", w)
    per = totals.groupBy("image_id").agg(F.sum("perceptual").alias("total"))
    return totals.join(per, "image_id").select("image_id", *"rgba", "perceptual", "total")


def fitting_bits(pixels: DataFrame, most: int) -> DataFrame:
    """HIST3: fewest ignored bits (0 to 4) with at most `most` colours (4 if none), all counted in one pass."""
    counts = [F.countDistinct(F.when(C("a") == 0, 0).otherwise(px.pack(*(px.posterize(C(c), b) for c in "rgba")))).alias(f"n{b}") for b in range(5)]
    found = pixels.groupBy("image_id").agg(*counts)
    bits = F.lit(4)
    for b in reversed(range(5)):
        bits = F.when(C(f"n{b}") <= most, b).otherwise(bits)
    return found.select("image_id", bits.alias("bits"), *[C(f"n{b}") for b in range(5)])


def posterized_by(c: Column, bits: Column) -> Column:
    """PX8 by a column of bits, 0 to 4."""
    out = c
    for b in range(1, 5):
        out = F.when(bits == b, px.posterize(c, b)).otherwise(out)
    return out


def shared_histogram(pixels: DataFrame, most: int, least_bits: int = 0) -> DataFrame:
    """HIST4: one histogram for each set of images: set_id, bits, r, g, b, a, weight. pixels: set_id, place, x, y, r, g, b, a.

    A set's images are added by place. Its first one settles how many bits are ignored, so that it has at most `most` colours; those after it are
    posterized alike and add colours without limit. Only the first images are counted at several bits.
    """
    first = pixels.groupBy("set_id").agg(F.min("place").alias("place"))
    counted = fitting_bits(pixels.join(first, ["set_id", "place"]).withColumn("image_id", C("set_id")), most)
    bits = counted.select(C("image_id").alias("set_id"), F.greatest(C("bits"), F.lit(least_bits)).alias("bits"))
    own = C("importance") if "importance" in pixels.columns else F.lit(255)
    clear = C("a") == 0
    rows = pixels.join(bits, "set_id").select("set_id", "bits", *[F.when(clear, 0).otherwise(posterized_by(C(c), C("bits"))).alias(c) for c in "rgba"], F.when(clear, 2000).otherwise(own).alias("w"))
    return rows.groupBy("set_id", "bits", *"rgba").agg(F.sum("w").cast("long").alias("weight"))


def top_colours(hist: DataFrame, n: int) -> DataFrame:
    """LIM1: the n heaviest colours per image, ties to the smaller colour; idx from 0. A popularity palette, not median cut."""
    w = Window.partitionBy("image_id").orderBy(F.desc("weight"), *"rgba")
    return hist.withColumn("idx", F.row_number().over(w) - 1).where(C("idx") < min(n, MOST_COLOURS))


FLOATS = ("fa", "fr", "fg", "fb")


def with_floats(rows: DataFrame) -> DataFrame:
    """Adds the premultiplied gamma floats fa, fr, fg, fb (PX11); rows without a column `a` are opaque."""
    a = C("a") if "a" in rows.columns else F.lit(255)
    return rows.withColumns(dict(zip(FLOATS, px.floats(C("r"), C("g"), C("b"), a), strict=True)))


def mean_colour(hist: DataFrame) -> DataFrame:
    """AGG2: weighted mean of each channel, of premultiplied gamma floats."""
    return with_floats(hist).groupBy("image_id").agg(*[(F.sum(C(f"f{c}") * C("weight")) / F.sum("weight")).alias(f"mean_{c}") for c in "rgba"])


def variance(hist: DataFrame) -> DataFrame:
    """AGG3: weighted variance about the mean (AGG2); differences under 1/256 (alpha: 2/256) count a quarter; channels weighted."""
    # Sixteenths of the channels.
    share = {"r": 7 / 16, "g": 9 / 16, "b": 5 / 16, "a": 4 / 16}
    rows = with_floats(hist).join(mean_colour(hist), "image_id")
    out = []
    for c, s in share.items():
        d = C(f"f{c}") - C(f"mean_{c}")
        small = 2 / 256 if c == "a" else 1 / 256
        damped = F.when(d * d < small * small, d * d * 0.25).otherwise(d * d)
        out.append((F.sum(damped * C("weight")) * s).alias(f"var_{c}"))
    return rows.groupBy("image_id").agg(*out)


def errors_from_mean(hist: DataFrame) -> DataFrame:
    """AGG4 and AGG5: greatest and total weighted error (PX13) of one box that holds the whole image, about its mean (AGG2)."""
    d = px.distance([C(f) for f in FLOATS], [C(f"mean_{c}") for c in "argb"])
    rows = with_floats(hist).join(mean_colour(hist), "image_id").withColumn("d", d)
    return rows.groupBy("image_id").agg(F.max("d").alias("max_error"), F.sum(C("d") * C("weight")).alias("total_error"))


def nearest(palette: list[tuple[int, int, int]]) -> Column:
    """NN1: index of the nearest palette colour by RGB, lowest on ties; the palette is a literal of at most 256 entries."""
    if not 0 < len(palette) <= MOST_COLOURS:
        raise ValueError("a palette has 1 to 256 colours")
    entries = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(i).alias("i")) for i, (r, g, b) in enumerate(palette)])
    scored = F.transform(entries, lambda e: F.struct(((C("r") - e["r"]) * (C("r") - e["r"]) + (C("g") - e["g"]) * (C("g") - e["g"]) + (C("b") - e["b"]) * (C("b") - e["b"])).alias("d"), e["i"].alias("i")))
    return F.array_min(scored)


def matched_colours(colours: DataFrame, palettes: DataFrame) -> DataFrame:
    """NN2 for distinct colours (image_id, r, g, b, a): with the index of the nearest entry (PX13, compared in units of 10^-12, lowest index on ties)
    in their image's palette, its distance d, and the colour's floats (PX11).

    palettes: image_id, idx from 0 to 255, and the floats or r, g, b and, if there, a. Pairs of a colour and an entry are reduced as they arise to one long
    that holds distance and index, so that no more than the colours are shuffled.
    """
    own = palettes if set(FLOATS) <= set(palettes.columns) else with_floats(palettes)
    entries = own.select("image_id", "idx", *[C(f).alias(f"e_{f}") for f in FLOATS])
    code = px.ranked_distance([C(f) for f in FLOATS], [C(f"e_{f}") for f in FLOATS]) * MOST_COLOURS + C("idx")
    best = with_floats(colours.select("image_id", *"rgba")).join(entries, "image_id").groupBy("image_id", *"rgba").agg(F.min(code).alias("code"))
    found = best.select("image_id", *"rgba", (C("code") % MOST_COLOURS).cast("int").alias("idx"), (F.shiftright("code", 8) / F.lit(1e12)).alias("d"))
    return with_floats(found)


def matched(rows: DataFrame, palettes: DataFrame) -> DataFrame:
    """NN2: rows with idx, d and floats of matched_colours. Each distinct colour of an image is looked up once, then joined back; null channels find nothing."""
    return rows.join(matched_colours(rows.select("image_id", *"rgba").distinct(), palettes), ["image_id", *"rgba"])


def remapped(pixels: DataFrame, palettes: DataFrame) -> DataFrame:
    """NN2 for each pixel: its colour, idx and distance d."""
    return matched(pixels.select("image_id", "x", "y", *"rgba"), palettes).select("image_id", "x", "y", *"rgba", "idx", "d")


def remap_error(mapped: DataFrame) -> DataFrame:
    """AGG9."""
    return mapped.groupBy("image_id").agg(F.avg("d").alias("mean_sq_error"))


def isolation(palettes: DataFrame) -> DataFrame:
    """NN3: distance (PX13) of each palette entry to its nearest other one."""
    p = with_floats(palettes).select("image_id", "idx", *FLOATS)
    q = p.select("image_id", *[C(c).alias(f"q_{c}") for c in ("idx", *FLOATS)])
    d = px.distance([C(f) for f in FLOATS], [C(f"q_{f}") for f in FLOATS])
    return p.join(q, "image_id").where("idx <> q_idx").groupBy("image_id", "idx").agg(F.min(d).alias("nearest"))


def with_background(mapped: DataFrame, background: DataFrame, clear: int) -> DataFrame:
    """NN4: the transparent index where the background pixel is at least as close (PX13) as the palette colour."""
    bg = with_floats(background).select("image_id", "x", "y", *[C(f).alias(f"b_{f}") for f in FLOATS])
    d = px.ranked_distance([C(f) for f in FLOATS], [C(f"b_{f}") for f in FLOATS]) / F.lit(1e12)
    return with_floats(mapped).join(bg, ["image_id", "x", "y"]).select("image_id", "x", "y", F.when(d <= C("d"), clear).otherwise(C("idx")).alias("idx"))


def kmeans_step(hist: DataFrame, palettes: DataFrame) -> DataFrame:
    """AGG7 and AGG8: entries move to the weighted mean of the colours nearest to them (NN2), all in floats (PX11).

    Entries without colours stay, as do those of a true `fixed`, if palettes have that column. error is the weighted sum of distances.
    """
    found = hist.join(matched_colours(hist, palettes), ["image_id", *"rgba"])
    sums = found.groupBy("image_id", "idx").agg(F.sum("weight").alias("w"), *[F.sum(C(f) * C("weight")).alias(f"s_{f}") for f in FLOATS], F.sum(C("d") * C("weight")).alias("e"))
    moves = (C("w") > 0) & ~F.coalesce("fixed", F.lit(False)) if "fixed" in palettes.columns else C("w") > 0
    own = with_floats(palettes).join(sums, ["image_id", "idx"], "left")
    return own.select("image_id", "idx", *[F.when(moves, C(f"s_{f}") / C("w")).otherwise(C(f)).alias(f) for f in FLOATS], F.coalesce("w", F.lit(0)).alias("popularity"), F.coalesce("e", F.lit(0.0)).alias("error"))


def palette_order(palettes: DataFrame) -> DataFrame:
    """SRT1: transparent ones first, then by falling weight, ties by colour; new places from 0."""
    w = Window.partitionBy("image_id").orderBy((C("a") == 255).cast("int"), F.desc("weight"), *"rgba")
    return palettes.withColumn("place", F.row_number().over(w) - 1)


def weighted_median(hist: DataFrame, channel: str) -> DataFrame:
    """SRT2: the least value at which half of the weight is reached."""
    per = hist.groupBy("image_id", C(channel).alias("v")).agg(F.sum("weight").alias("w"))
    w = Window.partitionBy("image_id")
    run = per.withColumn("cum", F.sum("w").over(w.orderBy("v"))).withColumn("total", F.sum("w").over(w))
    return run.where("2 * cum >= total").groupBy("image_id").agg(F.min("v").alias("median"))


def widest_channel(hist: DataFrame) -> DataFrame:
    """SRT3: channels by falling variance, as names."""
    rows = variance(hist)
    ordered = F.array_sort(F.array(*[F.struct((-F.round(C(f"var_{c}"), 6)).alias("v"), F.lit(c).alias("c")) for c in "abgr"]))
    return rows.select("image_id", F.array_join(F.transform(ordered, lambda s: s["c"]), "").alias("channels"))


def best_box(boxes: DataFrame, limit: float) -> DataFrame:
    """SRT4: the box to split next: the greatest weight x largest variance of a channel, times its worst error over the limit if it exceeds it; lowest box on ties.

    boxes: image_id, box, colours, weight, var_a, var_r, var_g, var_b, worst. Boxes of one colour are no candidates.
    """
    worth = C("weight") * F.greatest(*[C(f"var_{c}") for c in "argb"]) * F.greatest(F.lit(1.0), C("worst") / F.lit(limit))
    rows = boxes.where("colours > 1").withColumn("s", worth).where("s > 0")
    return rows.groupBy("image_id").agg((-F.max(F.struct("s", (-C("box")).alias("b")))["b"]).alias("box"))


def without_zero_weights(hist: DataFrame) -> DataFrame:
    """FLT6."""
    return hist.where("weight > 0")


def float_colour(r: int, g: int, b: int) -> tuple[float, float, float, float]:
    """PX11 of an opaque literal colour: alpha, red, green, blue."""
    return 1.0, *((v / 255.0) ** (px.INTERNAL_GAMMA / px.DISPLAY_GAMMA) for v in (r, g, b))


def without_fixed(hist: DataFrame, fixed: list[tuple[int, int, int]], target_mse: float = 0.0) -> DataFrame:
    """FLT5 and SET2: colours closer (PX13) to a fixed colour than half of target_mse, or 2/65536 if that is more, go.

    The fixed palette is a bounded literal; total weights are not lessened.
    """
    if not 0 < len(fixed) <= MOST_COLOURS:
        raise ValueError("a palette has 1 to 256 colours")
    entries = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(FLOATS, float_colour(*c), strict=True)]) for c in fixed])
    d = F.array_min(F.transform(entries, lambda e: px.distance([C(f) for f in FLOATS], [e[f] for f in FLOATS])))
    return with_floats(hist).where(d >= max(target_mse / 2, 2 / 65536)).drop(*FLOATS)


def with_fixed(palettes: DataFrame, fixed: list[tuple[int, int, int]], size: int) -> DataFrame:
    """SET1: the first size - n generated colours, then the n fixed ones."""
    own = palettes.where(C("idx") < size - len(fixed)).select("image_id", "idx", *"rgb")
    rows = F.explode(F.array(*[F.struct(F.lit(size - len(fixed) + i).alias("idx"), *[F.lit(v).alias(c) for c, v in zip("rgb", f, strict=True)]) for i, f in enumerate(fixed)]))
    return own.unionByName(palettes.select("image_id").distinct().select("image_id", rows.alias("f")).select("image_id", "f.*"))
