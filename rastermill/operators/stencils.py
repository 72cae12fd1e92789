"""Neighbourhood operators by tiles with halos, and resampling. One large image spreads over many tasks."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.functions import pixels as px
from rastermill.operators import tiles

C = F.col


def dilate(plane: DataFrame, v: str = "v", tile: int = tiles.TILE) -> DataFrame:
    """WIN2: image_id, x, y and v, the greatest of a pixel and its four neighbours, edges repeated."""
    return tiles.by_tiles(plane, [v], lambda p: {v: tiles.dilated(p[v])}, {v: "int"}, 1, tile)


def erode(plane: DataFrame, v: str = "v", tile: int = tiles.TILE) -> DataFrame:
    """WIN3: the least."""
    return tiles.by_tiles(plane, [v], lambda p: {v: tiles.eroded(p[v])}, {v: "int"}, 1, tile)


def box_blur(plane: DataFrame, s: int, v: str = "v", tile: int = tiles.TILE) -> DataFrame:
    """WIN4: 2s samples from -(s-1) to s, edges repeated, whole division, rows then columns; images too small stay.

    A tile sees 2s + 1 pixels of each image that has them, so that the images' sizes need not be known.
    """
    return tiles.by_tiles(plane, [v], lambda p: {v: tiles.blurred(p[v], s)}, {v: "int"}, 2 * s + 1, max(tile, 2 * s + 1))


#: How far WIN1 and WIN5 reach; the latter adds up its steps, and shows a tile enough for its blur.
_CONTRAST_REACH, _SMOOTH_REACH = 1, 12


def _contrast(p: tiles.Planes) -> tiles.Planes:
    # to six digits, which takes away the noise of floats, then truncated
    whole = lambda v: np.round(v, 6).astype(np.int64)
    curve = (np.arange(256) / 255.0) ** (px.INTERNAL_GAMMA / px.DISPLAY_GAMMA)
    alpha = p["a"] / 255.0
    across, down = zip(*(tiles.bends(v) for v in (*(curve[p[c]] * p["a"] / 255.0 for c in "rgb"), alpha)), strict=True)
    hor, ver = np.maximum.reduce(across), np.maximum.reduce(down)
    strongest, weakest = np.maximum(hor, ver), np.minimum(hor, ver)
    calm = 1 - np.maximum(strongest - np.abs(hor - ver) / 2, weakest)
    return {"edge": np.clip(255 - whole(256 * strongest), 0, 255), "noise": np.clip(85 + whole(171 * calm**4), 0, 255)}


def _smooth(p: tiles.Planes) -> tiles.Planes:
    noise = tiles.dilated(tiles.blurred(tiles.dilated(tiles.dilated(p["noise"])), 3))
    for _ in range(3):
        noise = tiles.eroded(noise)
    return {"noise": noise, "edge": np.minimum(noise, tiles.dilated(tiles.eroded(p["edge"])))}


def contrast(pixels: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """WIN1: edge and noise maps from second differences across and down of premultiplied channels, greatest over the four."""
    return tiles.by_tiles(pixels, list("rgba"), _contrast, {"edge": "int", "noise": "int"}, _CONTRAST_REACH, tile)


def smooth_maps(maps: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """WIN5: noise: dilate twice, blur, dilate, erode three times; edges: erode, dilate, and no more than noise. One shuffle for all steps."""
    return tiles.by_tiles(maps, ["edge", "noise"], _smooth, {"noise": "int", "edge": "int"}, _SMOOTH_REACH, tile)


def contrast_maps(pixels: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """WIN1 and WIN5 in one shuffle."""
    return tiles.by_tiles(pixels, list("rgba"), lambda p: _smooth(_contrast(p)), {"noise": "int", "edge": "int"}, _CONTRAST_REACH + _SMOOTH_REACH, tile)


def _grid(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """One row per image and target pixel, with the image's own size."""
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return sizes.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))


def crop(pixels: DataFrame, width: int, height: int, anchor: tuple[int, int] = (0, 0)) -> DataFrame:
    """GEO1: repositions to width x height; anchor -1, 0, 1 per axis; offsets truncate toward zero; bare places are 0."""
    grid = _grid(pixels, width, height)
    shift = {a: F.expr({-1: "0", 0: f"({n} - {s}) div 2", 1: f"{n} - {s}"}[k]) for a, n, s, k in (("x", width, "w", anchor[0]), ("y", height, "h", anchor[1]))}
    at = grid.select("image_id", "x", "y", (C("x") - shift["x"]).alias("sx"), (C("y") - shift["y"]).alias("sy"))
    source = pixels.select("image_id", C("x").cast("long").alias("sx"), C("y").cast("long").alias("sy"), *"rgba")
    return at.join(source, ["image_id", "sx", "sy"], "left").select("image_id", "x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgba"])


def point_resize(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """GEO2, with our own rounding: floor(x * w / width). Each pixel goes to the target places that take it, so that pixels meet their image's size only."""
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).cast("long").alias("w"), (F.max("y") + 1).cast("long").alias("h"))
    rows = pixels.join(sizes, "image_id")
    for a, n, wanted in (("x", "w", width), ("y", "h", height)):
        first = lambda at, n=n, wanted=wanted: f"(({at}) * {wanted} + {n} - 1) div {n}"
        rows = rows.withColumns({f"from_{a}": F.expr(first(f"CAST({a} AS LONG)")), f"to_{a}": F.expr(f"{first(f'CAST({a} AS LONG) + 1')} - 1")})
    rows = rows.where("from_x <= to_x AND from_y <= to_y")
    rows = rows.withColumn("x", F.explode(F.sequence(C("from_x").cast("int"), C("to_x").cast("int")))).withColumn("y", F.explode(F.sequence(C("from_y").cast("int"), C("to_y").cast("int"))))
    return rows.select("image_id", "x", "y", *"rgba")


def _samples(size: int, wanted: int) -> list[list[tuple[int, float]]]:
    """Source places and weights of each target place: the mean of bilinear samples (WIN7, WIN8).

    One sample when enlarging, else int(2 * ratio) + 1 spread about the place; places truncate toward zero, weights may leave 0..1
    at the near edge; the far edge repeats.
    """
    ratio = size / wanted
    steps = 1 if ratio < 1 else int(2 * ratio) + 1
    out = []
    for i in range(wanted):
        row: dict[int, float] = {}
        for k in range(steps):
            at = i * ratio + ((k / (steps - 1) - 0.5) * ratio if steps > 1 else 0.0)
            base = int(at)
            t = at - base
            for p, w in ((base, 1 - t), (base + 1, t)):
                p = max(0, min(p, size - 1))
                row[p] = row.get(p, 0.0) + w / steps
        out.append(sorted((p, w) for p, w in row.items() if w))
    return out


def placing(size: int, wanted: int) -> tuple[float, float]:
    """Step and offset of target places in the source: (S-1)/(D-1) when enlarging, S/D with centred offset when reducing."""
    return ((size - 1) / (wanted - 1), 0.0) if wanted > size else (size / wanted, (size / wanted - 1) / 2)


def _lanczos(size: int, wanted: int, lobes: float = 3.0) -> list[list[tuple[int, float]]]:
    """GEO4's weights: step (S-1)/(D-1) when enlarging, S/D with centred offset when reducing; edges repeat; sums are 1."""
    k, offset = placing(size, wanted)
    wide = max(k, 1.0)
    reach = int(np.ceil(lobes * wide))
    out = []
    for i in range(wanted):
        centre = offset + i * k
        first = int(np.floor(centre))
        places = np.arange(first - reach + 1, first + reach + 1)
        d = (places - centre) / wide
        w = np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0.0)
        w = w / w.sum()
        row: dict[int, float] = {}
        for p, x in zip(np.clip(places, 0, size - 1).tolist(), w.tolist(), strict=True):
            row[p] = row.get(p, 0.0) + x
        out.append(sorted((p, x) for p, x in row.items() if abs(x) > 1e-12))
    return out


@lru_cache(maxsize=64)
def weights(method: str, size: int, wanted: int) -> tuple[tuple[int, int, float], ...]:
    """(target, source, weight) of one axis; small, made on the driver, kept by sizes."""
    rows = {"bilinear": _samples, "lanczos": _lanczos}[method](size, wanted)
    return tuple((i, p, w) for i, row in enumerate(rows) for p, w in row)


#: Pixels of a task in a resize, so that its sums need no more memory when the table grows.
TASK_PIXELS = 250_000


def _axis(spark: SparkSession, sizes: list[int], wanted: int, ways: list[Callable], a: str) -> DataFrame:
    """The weights of all ways side by side; 0 where only others have one."""
    rows = []
    for s in sizes:
        every: dict[tuple[int, int], list[float]] = {}
        for k, weights_of in enumerate(ways):
            for to, at, weight in weights_of(s, wanted):
                every.setdefault((to, at), [0.0] * len(ways))[k] = weight
        rows += [(s, to, at, *found) for (to, at), found in every.items()]
    columns = ", ".join(f"weight_{a}{k} double" for k in range(len(ways)))
    return F.broadcast(spark.createDataFrame(rows, f"size_{a} int, to_{a} int, {a} int, {columns}"))  # bounded: sizes x wanted x taps x ways


def resize(pixels: DataFrame, width: int, height: int, method: str = "lanczos", most_sizes: int = 256, weights_of: Callable | None = None, rounded: bool = True) -> DataFrame:
    """GEO3 (bilinear) and GEO4 (lanczos): two sparse matrix products, across then down, as joins with weights and sums.

    weights_of: (size, wanted) -> (target, source, weight) of other methods. Unrounded values are not held in a byte either.
    """
    weights_of = weights_of or (lambda size, wanted: weights(method, size, wanted))
    return resizes(pixels, width, height, {method: weights_of}, most_sizes, rounded, 0.0 if method == "bilinear" else 0.5).drop("way")


def resizes(pixels: DataFrame, width: int, height: int, ways: dict[str, Callable], most_sizes: int = 256, rounded: bool = True, half: float = 0.5) -> DataFrame:
    """resize by several weights_of at once, by name: the columns of resize, and `way`, a name. Pixels are dealt out once for each axis, for all ways."""
    spark = pixels.sparkSession
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("size_x"), (F.max("y") + 1).alias("size_y"))
    found = {a: [r[0] for r in sizes.select(f"size_{a}").distinct().limit(most_sizes + 1).collect()] for a in "xy"}
    if max(map(len, found.values())) > most_sizes:
        raise ValueError(f"more than {most_sizes} image sizes; resize them in groups")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pixels.count() // TASK_PIXELS)
    all_ways = range(len(ways))
    rows = pixels.join(sizes, "image_id").select("image_id", "x", "y", "size_x", "size_y", *"rgba").repartition(tasks, "image_id", "y")
    across = rows.join(_axis(spark, found["x"], width, list(ways.values()), "x"), ["size_x", "x"])
    across = across.groupBy("image_id", "size_y", "y", "to_x").agg(*[F.sum(C(c) * C(f"weight_x{k}")).alias(f"{c}{k}") for k in all_ways for c in "rgba"])
    down = across.repartition(tasks, "image_id", "to_x").join(_axis(spark, found["y"], height, list(ways.values()), "y"), ["size_y", "y"])
    down = down.groupBy("image_id", "to_x", "to_y").agg(*[F.sum(C(f"{c}{k}") * C(f"weight_y{k}")).alias(f"{c}{k}") for k in all_ways for c in "rgba"])
    held = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.round(v, 6) + half))).cast("int") if rounded else v
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("way"), *[held(C(f"{c}{k}")).alias(c) for c in "rgba"]) for k, name in enumerate(ways)]))
    return down.select("image_id", C("to_x").alias("x"), C("to_y").alias("y"), each.alias("v")).select("image_id", "x", "y", *[C(f"v.{c}").alias(c) for c in "rgba"], "v.way")


def lookup(pixels: DataFrame, places: DataFrame) -> DataFrame:
    """PX3: pixels at places (image_id, px, py), clamped to the image."""
    sizes = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    at = places.join(sizes, "image_id").withColumns({"x": F.least(F.greatest("px", F.lit(0)), C("mx")), "y": F.least(F.greatest("py", F.lit(0)), C("my"))})
    return at.join(pixels, ["image_id", "x", "y"]).select("image_id", "px", "py", *"rgba")
