"""Work on neighbourhoods by tiles with halos: one shuffle for a whole chain of steps, and a large image spreads over many tasks.

A pixel goes to its own tile and to those whose halo it is in. Within a tile a chain of steps is plain array work; what it gets wrong beside a cut
stays in the halo, which is at least as wide as the chain reaches, and only the tile's core is returned. A task holds one tile at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Pixels across and down of a tile's core.
TILE = 256
Planes = dict[str, np.ndarray]


def by_tiles(pixels: DataFrame, columns: list[str], step: Callable[[Planes], Planes], out: dict[str, str], halo: int, tile: int = TILE) -> DataFrame:
    """image_id, x, y and the columns of `out` (name: SQL type) that `step` makes of the planes of `columns`.

    Planes are arrays by row and column, whose borders are the image's, or lie at least `halo` beyond the tile's core. An image is a whole
    rectangle: gaps and repeated pixels raise. Null values count as 0.
    """
    if tile < halo:
        raise ValueError("a tile is at least as wide as its halo")

    def tiles_of(a: str) -> Column:
        first = F.greatest(F.floor((C(a) - halo) / tile), F.lit(0))
        return F.explode(F.sequence(first.cast("int"), F.floor((C(a) + halo) / tile).cast("int")))

    kind = pixels.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, x int, y int, " + ", ".join(f"{n} {t}" for n, t in out.items())
    types = {"int": np.int32, "long": np.int64, "double": np.float64}

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tx, ty = key[1].as_py() * tile, key[2].as_py() * tile
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        x0, y0 = x.min(), y.min()
        shape = int(y.max() - y0 + 1), int(x.max() - x0 + 1)
        if shape[0] * shape[1] != len(x):
            raise ValueError(f"image {key[0].as_py()} has gaps or repeated pixels")
        planes = {}
        for c in columns:
            planes[c] = np.zeros(shape, np.float64 if pa.types.is_floating(rows.schema.field(c).type) else np.int64)
            planes[c][y - y0, x - x0] = rows.column(c).fill_null(0).to_numpy()
        made = step(planes)
        core = slice(max(ty - y0, 0), max(ty + tile - y0, 0)), slice(max(tx - x0, 0), max(tx + tile - x0, 0))
        down, across = (np.arange(n)[s] for n, s in zip(shape, core, strict=True))
        found = {"x": np.tile(across + x0, len(down)).astype(np.int32), "y": np.repeat(down + y0, len(across)).astype(np.int32)}
        found |= {n: made[n][core].ravel().astype(types[t]) for n, t in out.items()}
        ids = pa.array([key[0].as_py()], rows.schema.field("image_id").type)
        return pa.table({"image_id": pa.chunked_array([ids]).take(pa.array(np.zeros(len(found["x"]), np.int64))), **{n: pa.array(v) for n, v in found.items()}})

    tiled = pixels.select("image_id", C("x").cast("int").alias("x"), C("y").cast("int").alias("y"), *columns).withColumn("tile_x", tiles_of("x")).withColumn("tile_y", tiles_of("y"))
    return tiled.groupBy("image_id", "tile_x", "tile_y").applyInArrow(run, schema)


# --- steps of one plane, edges repeated


def _neighbours(v: np.ndarray) -> list[np.ndarray]:
    wide = np.pad(v, 1, mode="edge")
    return [v, wide[1:-1, :-2], wide[1:-1, 2:], wide[:-2, 1:-1], wide[2:, 1:-1]]


def dilated(v: np.ndarray) -> np.ndarray:
    """WIN2: the greatest of a pixel and its four neighbours."""
    return np.maximum.reduce(_neighbours(v))


def eroded(v: np.ndarray) -> np.ndarray:
    """WIN3: the least of them."""
    return np.minimum.reduce(_neighbours(v))


def blurred(v: np.ndarray, s: int) -> np.ndarray:
    """WIN4: 2s samples from -(s-1) to s, whole division, across then down; planes under 2s + 1 in a direction stay."""
    if min(v.shape) < 2 * s + 1:
        return v
    for axis in (1, 0):
        sums = np.cumsum(np.pad(v, [(s, s) if a == axis else (0, 0) for a in (0, 1)], mode="edge"), axis=axis)
        n = v.shape[axis]
        upper, lower = (np.take(sums, np.arange(n) + k, axis=axis) for k in (2 * s, 0))
        v = (upper - lower) // (2 * s)
    return v


def bends(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the second differences across and down."""
    _, left, right, above, below = _neighbours(v)
    return np.abs(left + right - 2 * v), np.abs(above + below - 2 * v)
