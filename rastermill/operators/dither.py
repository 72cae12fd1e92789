"""Remapping to a found palette: rounding (QNT7), the plain remap (QNT8), the dither map (WIN6) and map-weighted error diffusion (QNT9, WIN9);
rounding of resampled values with error diffusion (WIN10).

All but the diffusion are joins, windows and sums. Serpentine diffusion is sequential within an image, since a row begins beside the last pixel
of the row before. So images of one size are diffused side by side (one numpy step for a pixel of each), and tall ones by bands of rows: a superstep
takes each image's next band together with the error row that the last one left, which is written to the shared folder. A task so
holds bands, never a whole tall image. Diffusion in raster order runs by diagonal wavefronts within a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions import pixels as px
from rastermill.operators import colours, palettes, stencils
from rastermill.operators.search import differences
from rastermill.sources.scratch import spread, written

C = F.col
#: Rows of a band, and pixels that are diffused side by side at most.
BAND_ROWS, BATCH_PIXELS = 1024, 1 << 21
#: Fixed value: three times the pixels of the largest image that gets contrast maps.
MOST_MAPPED = 1 << 26
# Shares of the error that go ahead, down and ahead, down, and down and back.
AHEAD, DOWN_AHEAD, DOWN, DOWN_BACK = 7 / 16, 1 / 16, 5 / 16, 3 / 16


def rounded(palette: DataFrame, bits: int, gamma: float = px.DISPLAY_GAMMA) -> DataFrame:
    """QNT7: bytes r, g, b, a, posterized, and the floats replaced by those of the bytes, which later steps use.

    palette: image_id, idx, fa, fr, fg, fb, fixed. A clear entry that is not fixed shows the clear colour; its floats are of what it was.
    """
    alpha = F.when(C("fa") < 1 / 256, 0).otherwise(F.least(F.lit(255), F.floor(C("fa") * 256)).cast("int"))
    bytes_ = palette.withColumns({c: px.posterize(px.to_rgb(C(f"f{c}"), C("fa"), gamma), bits) for c in "rgb"} | {"a": px.posterize(alpha, bits)})
    back = bytes_.withColumns({"fa": C("a") / 255.0} | {f"f{c}": px.premultiplied(C(c), C("a"), gamma) for c in "rgb"})
    clear = (C("a") == 0) & ~C("fixed")
    return back.withColumns({c: F.when(clear, palettes.CLEAR[c]).otherwise(C(c)) for c in "rgb"})


def moved(mapped: DataFrame, palette: DataFrame) -> DataFrame:
    """AGG7 over pixels: entries that are not fixed go to the mean of the pixels that map to them. mapped: image_id, idx, fa, fr, fg, fb."""
    sums = mapped.groupBy("image_id", "idx").agg(F.count("*").alias("pixels"), *[F.avg(f).alias(f"m_{f}") for f in colours.FLOATS])
    both = palette.join(sums, ["image_id", "idx"], "left")
    goes = C("pixels").isNotNull() & ~C("fixed")
    new = {f: F.when(goes, C(f"m_{f}")).otherwise(C(f)) for f in colours.FLOATS} | {"popularity": F.when(goes, C("pixels").cast("double")).otherwise(C("popularity"))}
    return both.withColumns(new).select(*palette.columns)


def plain_remap(pixels: DataFrame, palette: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """QNT8: the indices (image_id, x, y, idx, d) by the rounded palette, that palette, and where the remap moves it to afterwards."""
    entries = rounded(palette, bits)
    mapped = colours.matched(pixels.select("image_id", "x", "y", *"rgba"), entries)
    return mapped.select("image_id", "x", "y", "idx", "d"), entries, moved(mapped, entries)


def dither_map(indexed: DataFrame, edges: DataFrame) -> DataFrame:
    """WIN6: damps the edge map e where runs of one index are long: (e + 128) * 255/383 * (1 - 20 / (20 + n)), n 10 per pixel of
    the run and 15 per equal neighbour above and below.

    A run ends at a change of index or at the last column, and its factor holds up to and with the pixel where it ends; the next run begins one
    place later, with the index of that pixel. An image one pixel wide keeps its edges.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    before, whole, run = row.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("image_id", "y"), Window.partitionBy("image_id", "y", "run")
    rows = indexed.join(edges.select("image_id", "x", "y", "edge"), ["image_id", "x", "y"]).withColumns({"above": F.lag("idx").over(column), "below": F.lead("idx").over(column)})
    rows = rows.withColumns({"left": F.lag("idx").over(row), "last_x": F.max("x").over(whole)})
    ends = ((C("left") != C("idx")) | (C("x") == C("last_x"))) & (C("x") > 0)
    rows = rows.withColumn("run", F.coalesce(F.sum(F.coalesce(ends, F.lit(False)).cast("int")).over(before), F.lit(0)))
    rows = rows.withColumns({"colour": F.first(F.coalesce("left", "idx")).over(run.orderBy("x")), "end": F.max("x").over(run)})
    equal = F.lit(10) + sum(F.when(C(n) == C("colour"), 15).otherwise(0) for n in ("above", "below"))
    rows = rows.withColumn("n", F.sum(F.when(C("x") < C("end"), equal).otherwise(0)).over(run))
    damped = F.floor((C("edge") + 128) * F.lit(255 / 383) * (1 - F.lit(20.0) / (C("n") + 20))).cast("int")
    return rows.select("image_id", "x", "y", F.when(C("last_x") == 0, C("edge")).otherwise(damped).alias("dither"))


# --- the diffusion


class Diffusion:
    """Error diffusion over bands of equally large images, side by side."""

    def __init__(self, palette: np.ndarray, most_error: np.ndarray) -> None:
        """palette: images x entries x (a, r, g, b), unused entries infinite; most_error: per image, what is damped beyond."""
        self.palette, self.most, self.lines = palette, most_error, np.arange(len(palette))

    def wanted(self, pixel: np.ndarray, error: np.ndarray) -> np.ndarray:
        """A pixel with the error that came to it: held in -0.1 to 1.1 as a whole, damped if the error is great, left out if it can't be seen."""
        room = np.where(pixel + error > 1.1, 1.1 - pixel, np.where(pixel + error < -0.1, -0.1 - pixel, error))[:, 1:]
        ratio = np.minimum(1.0, np.divide(room, error[:, 1:], out=np.ones_like(room), where=error[:, 1:] != 0).min(axis=1))
        size = (error * error).sum(axis=1)
        ratio = np.where(size > self.most, ratio * 0.8, ratio)
        out = pixel + error * ratio[:, None]
        out[:, 0] = np.clip(pixel[:, 0] + error[:, 0], 0, 1)
        return np.where(((size < 2 / 65536) & (size <= self.most))[:, None], pixel, out)

    def band(self, f: np.ndarray, level: np.ndarray, carried: np.ndarray, first_row: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices (images x rows x columns) and the error row that goes on; level: images x rows x columns; carried: images x (columns + 2) x 4."""
        _, h, w, _ = f.shape
        out = np.empty(f.shape[:3], np.int16)
        here = carried.copy()
        for y in range(h):
            below = np.zeros_like(here)
            step = -1 if (first_row + y) % 2 else 1
            for x in range(w)[::step]:
                at = x + 1
                want = self.wanted(f[:, y, x], here[:, at] * level[:, y, x, None])
                i = differences(want[:, None], self.palette).argmin(axis=1)
                out[:, y, x] = i
                miss = want - self.palette[self.lines, i]
                miss *= np.where((miss * miss).sum(axis=1) > self.most, 0.75, 1.0)[:, None]
                here[:, at + step] += miss * AHEAD
                below[:, at + step] += miss * DOWN_AHEAD
                below[:, at] += miss * DOWN
                below[:, at - step] += miss * DOWN_BACK
            here = below
        return out, here


_BANDS = "image_id long, band int, width int, height int, f binary, level binary"


def _pack(rows: pa.Table) -> pa.Table:
    """A band of an image as one row."""
    x, y = (rows.column(c).to_numpy().astype(np.int64) for c in "xy")
    y, w = y - y.min(), int(x.max()) + 1
    h = int(y.max()) + 1
    f, level = np.zeros((h, w, 4)), np.zeros((h, w))
    f[y, x] = np.stack([rows.column(c).to_numpy() for c in colours.FLOATS], axis=1)
    level[y, x] = rows.column("level").to_numpy()
    cols = {"image_id": rows.column("image_id").slice(0, 1), "band": rows.column("band").slice(0, 1), "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32())}
    return pa.table(cols | {"f": pa.array([f.tobytes()], pa.binary()), "level": pa.array([level.tobytes()], pa.binary())})


_DONE = "image_id long, first_row int, width int, idx binary, carried binary"


def _diffuse(band_rows: int):
    schema = pa.schema([("image_id", pa.int64()), ("first_row", pa.int32()), ("width", pa.int32()), ("idx", pa.binary()), ("carried", pa.binary())])

    def some(rows: list[dict]) -> pa.RecordBatch:
        w, h, n = rows[0]["width"], rows[0]["height"], max(len(r["palette"]) for r in rows)
        numbers = lambda c, *shape: np.stack([np.frombuffer(r[c], np.float64).reshape(shape) for r in rows])
        palette = np.full((len(rows), n, 4), np.inf)
        palette[:, :, 0] = 0  # its differences to unused entries are infinite, not undefined
        for own, r in zip(palette, rows, strict=True):
            own[: len(r["palette"])] = [[e[c] for c in colours.FLOATS] for e in r["palette"]]
        carried = np.stack([np.frombuffer(r["carried"], np.float64).reshape(w + 2, 4) if r["carried"] is not None else np.zeros((w + 2, 4)) for r in rows])
        first = rows[0]["band"] * band_rows
        out, rest = Diffusion(palette, np.array([r["most_error"] for r in rows])).band(numbers("f", h, w, 4), numbers("level", h, w), carried, first)
        cols = [[r["image_id"] for r in rows], [first] * len(rows), [w] * len(rows), [x.tobytes() for x in out], [x.tobytes() for x in rest]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[dict]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                mine = held.setdefault(key := (r["width"], r["height"]), [])
                mine.append(r)
                if sum(w * h * len(rows) for (w, h), rows in held.items()) > BATCH_PIXELS:
                    yield some(held.pop(key))
        for rows in held.values():
            yield some(rows)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            idx, w = np.frombuffer(r["idx"], np.int16).astype(np.int32), r["width"]
            n = np.arange(len(idx), dtype=np.int32)
            cols = [np.full(len(idx), r["image_id"]), n % w, n // w + np.int32(r["first_row"]), idx]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["image_id", "x", "y", "idx"])


def diffused(pixels: DataFrame, palette: DataFrame, errors: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """WIN9: image_id, x, y, idx. pixels: image_id, x, y, fa, fr, fg, fb, level (what share of the error is taken); errors: image_id, most_error."""
    banded = pixels.withColumn("band", F.floor(C("y") / band_rows).cast("int"))
    bands = banded.groupBy("image_id", "band").applyInArrow(_pack, _BANDS)
    entries = palette.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", *colours.FLOATS))).alias("palette"))
    bands = bands.join(entries, "image_id").join(errors, "image_id")
    return _by_bands(pixels, bands, band_rows, _diffuse(band_rows), _DONE).mapInArrow(_unpack, "image_id long, x int, y int, idx int")


def _by_bands(pixels: DataFrame, bands: DataFrame, band_rows: int, run, schema: str) -> DataFrame:
    """All bands' results, one superstep for the n-th band of every image, which gets `carried` from the one above."""
    bands = spread(bands, "image_id")
    last = pixels.agg(F.max("y")).first()[0]
    count = 1 if last is None else last // band_rows + 1
    if count == 1:
        return bands.withColumn("carried", F.lit(None).cast("binary")).mapInArrow(run, schema)
    bands, done = written(bands, "bands"), []
    for n in range(count):
        mine = bands.where(C("band") == n)
        mine = mine.join(done[-1].select("image_id", "carried"), "image_id", "left") if done else mine.withColumn("carried", F.lit(None).cast("binary"))
        done.append(written(mine.mapInArrow(run, schema), "diffused"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every


# Shares of a rounding's error that go right, down and left, down, down and right.
RIGHT, DOWN_LEFT, BELOW, DOWN_RIGHT = 0.364842, 0.207305, 0.364842, 0.063011


def wavefront(values: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounds rows x columns x channels half away from zero, the error of each value carried on, all values of a diagonal x + 2 y at once.

    Returns bytes and what the row below gets. Unlike the values, the errors are not clamped.
    """
    h, w, n = values.shape
    room = np.zeros((h + 1, w + 2, n))  # a column on each side takes what leaves the image
    room[:h, 1:-1] = values
    room[0, 1:-1] += carried
    out = np.zeros(values.shape, np.int16)
    for t in range(w + 2 * (h - 1)):
        y = np.arange(max(0, (t - w + 2) // 2), min(h - 1, t // 2) + 1)
        x = t - 2 * y + 1
        v = room[y, x]
        whole = np.where(v < 0, -np.floor(0.5 - v), np.floor(v + 0.5))
        out[y, x - 1] = np.clip(whole, 0, 255)
        miss = v - whole
        room[y, x + 1] += miss * RIGHT
        room[y + 1, x - 1] += miss * DOWN_LEFT
        room[y + 1, x] += miss * BELOW
        room[y + 1, x + 1] += miss * DOWN_RIGHT
    return out, room[h, 1:-1]


_ROUNDED = "image_id long, first_row int, width int, values binary, carried binary"


def _pack_values(rows: pa.Table) -> pa.Table:
    x, y = (rows.column(c).to_numpy().astype(np.int64) for c in "xy")
    y, w = y - y.min(), int(x.max()) + 1
    v = np.zeros((int(y.max()) + 1, w, 4))
    v[y, x] = np.stack([rows.column(c).to_numpy() for c in "rgba"], axis=1)
    return pa.table({"image_id": rows.column("image_id").slice(0, 1), "band": rows.column("band").slice(0, 1), "width": pa.array([w], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})


def _round(band_rows: int):
    schema = pa.schema([("image_id", pa.int64()), ("first_row", pa.int32()), ("width", pa.int32()), ("values", pa.binary()), ("carried", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                carried = np.frombuffer(r["carried"], np.float64).reshape(r["width"], 4) if r["carried"] is not None else 0.0
                out, rest = wavefront(np.frombuffer(r["v"], np.float64).reshape(-1, r["width"], 4), carried)
                row = {"image_id": r["image_id"], "first_row": r["band"] * band_rows, "width": r["width"], "values": out.tobytes(), "carried": rest.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def _unpack_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            v, w = np.frombuffer(r["values"], np.int16).reshape(-1, 4).astype(np.int32), r["width"]
            n = np.arange(len(v), dtype=np.int32)
            cols = [np.full(len(v), r["image_id"]), n % w, n // w + np.int32(r["first_row"]), *v.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["image_id", "x", "y", *"rgba"])


def rounded_with_diffusion(values: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """WIN10: image_id, x, y, r, g, b, a as bytes of values that are floats."""
    banded = values.withColumn("band", F.floor(C("y") / band_rows).cast("int"))
    bands = banded.groupBy("image_id", "band").applyInArrow(_pack_values, "image_id long, band int, width int, v binary")
    return _by_bands(values, bands, band_rows, _round(band_rows), _ROUNDED).mapInArrow(_unpack_values, "image_id long, x int, y int, r int, g int, b int, a int")


def dithered_remap(pixels: DataFrame, palette: DataFrame, level: float, bits: int, band_rows: int = BAND_ROWS) -> tuple[DataFrame, DataFrame]:
    """QNT9: the indices (image_id, x, y, idx) and the rounded palette.

    A plain remap by the palette as found moves it and shows where runs are long; the palette is rounded then, and errors are diffused by the share
    1 - (1 - level)^2 of 15/16, times the dither map. Images below 4 x 4 or too large for contrast maps have no map and keep the palette as found.
    pixels: image_id, x, y, r, g, b, a.
    """
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    mapped_sizes = sizes.select("image_id", ((C("w") >= 4) & (C("h") >= 4) & (3 * C("w").cast("long") * C("h") <= MOST_MAPPED)).alias("has_map"))
    rows = pixels.select("image_id", "x", "y", *"rgba").join(mapped_sizes, "image_id")
    with_map = rows.where("has_map").drop("has_map")
    mapped = written(colours.matched(with_map, palette).select("image_id", "x", "y", "idx", "d", *colours.FLOATS), "mapped")
    entries = written(rounded(moved(mapped, palette), bits), "rounded")
    maps = dither_map(mapped.select("image_id", "x", "y", "idx"), stencils.contrast_maps(with_map))
    errors = palette.select("image_id").distinct().join(mapped.groupBy("image_id").agg(F.avg("d").alias("e")), "image_id", "left")
    errors = errors.select("image_id", F.greatest(F.coalesce(C("e") * 2.4, F.lit(0.0)), F.lit(16 / 256)).alias("most_error"))
    base = (1 - (1 - level) ** 2) * 15 / 16
    flat = colours.with_floats(rows.where("NOT has_map").drop("has_map")).select("image_id", "x", "y", *colours.FLOATS, F.lit(base).alias("level"))
    weighted = mapped.join(maps, ["image_id", "x", "y"]).select("image_id", "x", "y", *colours.FLOATS, (C("dither") * F.lit(base / 255)).alias("level"))
    return diffused(weighted.unionByName(flat), entries, errors, band_rows), entries
