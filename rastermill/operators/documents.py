"""Staged image documents (QNT1, QNT11, QNT13, QNT16): a source, what was made of it, a tray of sixteen colours, and options by image.

Every stage's result is a table in the shared folder: the rounded palette is made once, when first asked for (QNT13), a result can become the
next source (QNT16), and a lost executor costs no earlier stage.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions import pixels as px
from rastermill.operators import colours, dither, palettes, search, stencils
from rastermill.sources.scratch import written

C = F.col
#: Slots of a tray, and sets of options that one table may hold.
SLOTS, MOST_OPTIONS = 16, 256


def flattened(pixels: DataFrame) -> DataFrame:
    """PX5: opaque pixels over black."""
    return pixels.withColumns({c: px.flatten(C(c), C("a")) for c in "rgb"} | {"a": F.lit(255)})


def perceptual_histogram(pixels: DataFrame, options: search.Options) -> DataFrame:
    """HIST1 to HIST3: each image's colours, weighed by its noise map if there is one; as many bits are ignored as its number of colours asks for."""
    sizes = pixels.groupBy("image_id").agg(F.count("*").alias("n"), F.max("x").alias("mx"), F.max("y").alias("my"))
    rows = pixels
    if options.uses_contrast:
        mapped = pixels.join(sizes.where((C("mx") >= 3) & (C("my") >= 3) & (3 * C("n") <= dither.MOST_MAPPED)).select("image_id"), "image_id", "left_semi")
        noise = stencils.contrast_maps(mapped).select("image_id", "x", "y", "noise")
        rows = pixels.join(noise, ["image_id", "x", "y"], "left").withColumn("importance", F.coalesce("noise", F.lit(255))).drop("noise")
    shared = colours.shared_histogram(rows.withColumns({"set_id": C("image_id"), "place": F.lit(0)}), options.most_entries, options.posterize)
    return colours.normalised(shared.withColumnRenamed("set_id", "image_id"), sizes.select("image_id", "n"))


@dataclasses.dataclass
class Quantized:
    """image_id, x, y, idx; and image_id, idx, r, g, b, a, fixed with the floats."""

    indexed: DataFrame
    palette: DataFrame

    def shown(self) -> DataFrame:
        """The pixels in the palette's colours."""
        return self.indexed.join(self.palette.select("image_id", "idx", *"rgba"), ["image_id", "idx"]).select("image_id", "x", "y", *"rgba")


def quantized(pixels: DataFrame, options: search.Options, fixed: DataFrame | None = None) -> Quantized:
    """QNT1 without the tray: histogram, search, remap. fixed: image_id, place, r, g, b."""
    flat = flattened(pixels)
    found = written(search.palettes(perceptual_histogram(flat, options), options, fixed if fixed is not None else ()), "found")
    if options.dither:
        indexed, palette = dither.dithered_remap(flat, found, options.dither, options.posterize)
    else:
        indexed, palette, _ = dither.plain_remap(flat, found, options.posterize)
    return Quantized(written(indexed.select("image_id", "x", "y", "idx"), "indexed"), written(palette, "palette"))


def grey_tray(pixels: DataFrame) -> DataFrame:
    """The tray of a new document: image_id, slot, r, g, b, locked."""
    slots = pixels.select("image_id").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return slots.select("image_id", "slot", *[(C("slot") * (255 // (SLOTS - 1))).alias(c) for c in "rgb"], F.lit(False).alias("locked"))


class Document:
    """Images in stages. source: image_id, x, y, r, g, b, a; tray: as grey_tray makes it (a locked slot's colour is kept in every palette)."""

    def __init__(self, source: DataFrame, tray: DataFrame | None = None) -> None:
        self.source = written(source.select("image_id", "x", "y", *"rgba"), "source")
        self.tray = written(tray if tray is not None else grey_tray(self.source), "tray")
        self.target: Quantized | None = None

    def colours(self) -> DataFrame:
        """AGG1 of the source."""
        return colours.distinct_colours(self.source)

    def quantize(self, options: DataFrame) -> Quantized:
        """QNT1: makes the target and refills the tray (QNT14). options: image_id, speed, posterize (bits), dither (0 to 100).

        Images are taken by set of options, of which there are MOST_OPTIONS at most; images without a row stay out of the target.
        """
        asked = options.select("image_id", "speed", "posterize", "dither")
        sets = asked.select("speed", "posterize", "dither").distinct().limit(MOST_OPTIONS + 1).collect()
        if len(sets) > MOST_OPTIONS:
            raise ValueError(f"more than {MOST_OPTIONS} sets of options")
        place = F.row_number().over(Window.partitionBy("image_id").orderBy("slot")) - 1
        locked = self.tray.where("locked").withColumn("place", place).select("image_id", "place", *"rgb")
        parts = []
        for s in sets:
            mine = asked.where((C("speed") == s["speed"]) & (C("posterize") == s["posterize"]) & (C("dither") == s["dither"])).select("image_id")
            o = search.Options(speed=s["speed"], posterize=s["posterize"], dither=s["dither"] / 100)
            parts.append(quantized(self.source.join(mine, "image_id", "left_semi"), o, locked.join(mine, "image_id", "left_semi")))
        if not parts:
            raise ValueError("no options")
        both = [parts[0].indexed, parts[0].palette]
        for p in parts[1:]:
            both = [both[0].unionByName(p.indexed), both[1].unionByName(p.palette)]
        self.target = Quantized(*both)
        self._refill()
        return self.target

    def _refill(self) -> None:
        """Free slots take the palette's first colours, locked ones the places at the end where a full palette has the fixed ones; others keep theirs."""
        count = F.sum(C("locked").cast("int")).over(Window.partitionBy("image_id"))
        counted = self.tray.withColumn("held", count)
        order = F.row_number().over(Window.partitionBy("image_id", "locked").orderBy("slot")) - 1
        asked = counted.withColumn("idx", F.when(C("locked"), order + SLOTS - C("held")).otherwise(order).cast("int"))
        new = self.target.palette.select("image_id", "idx", *[C(c).alias(f"new_{c}") for c in "rgb"])
        rows = asked.join(new, ["image_id", "idx"], "left").select("image_id", "slot", *[F.coalesce(f"new_{c}", c).alias(c) for c in "rgb"], "locked")
        self.tray = written(rows, "tray")

    def drop_palette(self, source: DataFrame, slots: list[int] | None = None) -> None:
        """QNT15: colours dropped on the tray. source: image_id, idx, r, g, b."""
        new = palettes.dropped(self.tray.withColumnRenamed("slot", "idx").select("image_id", "idx", *"rgb"), source, slots)
        self.tray = written(new.withColumnRenamed("idx", "slot").join(self.tray.select("image_id", "slot", "locked"), ["image_id", "slot"]), "tray")

    def keep(self) -> DataFrame:
        """QNT16: the target, as it is shown, becomes the source; its colours are counted anew."""
        if self.target is None:
            raise ValueError("nothing to keep")
        self.source, self.target = written(self.target.shown(), "source"), None
        return self.colours()
