"""Tiles with halos give what whole images give, and look-ups by distinct colour what every pixel's own look-up gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.operators import colours, search, stencils

WIDE, HIGH = 75, 52


def _image(spark, n: int = 1):
    cells = spark.range(n * WIDE * HIGH).selectExpr(f"id div {WIDE * HIGH} AS image_id", f"CAST(id % {WIDE} AS INT) AS x", f"CAST(id % {WIDE * HIGH} div {WIDE} AS INT) AS y", "id")
    return cells.selectExpr("image_id", "x", "y", *[f"CAST(pmod(xxhash64(id div 7, {i}), 256) AS INT) AS {c}" for i, c in enumerate("rgba")]).repartition(5)


def _values(df) -> dict:
    return {(r["image_id"], r["x"], r["y"]): tuple(v for k, v in sorted(r.asDict().items()) if k not in ("image_id", "x", "y")) for r in df.collect()}


@pytest.mark.parametrize("tile", [13, 32])
def test_tiles_agree_with_whole_images(spark, tile):
    p = _image(spark, 2)
    plane = p.withColumnRenamed("g", "v")
    for op in (stencils.dilate, stencils.erode, lambda q, **k: stencils.box_blur(q, 3, **k)):
        assert _values(op(plane, tile=tile)) == _values(op(plane))
    both = _values(stencils.contrast_maps(p, tile=tile))
    assert both == _values(stencils.smooth_maps(stencils.contrast(p, tile=tile), tile=tile)) == _values(stencils.contrast_maps(p)) and len(both) == 2 * WIDE * HIGH


def test_box_blur_against_plain_sums(spark):
    got, s = _values(stencils.box_blur(_image(spark).withColumnRenamed("g", "v"), 3, tile=16)), 3
    plain = np.zeros((HIGH, WIDE), np.int64)
    for r in _image(spark).collect():
        plain[r["y"], r["x"]] = r["g"]
    for axis, n in ((1, WIDE), (0, HIGH)):
        plain = sum(np.take(plain, np.clip(np.arange(n) + k, 0, n - 1), axis=axis) for k in range(-(s - 1), s + 1)) // (2 * s)
    assert got == {(0, x, y): (int(plain[y, x]),) for y in range(HIGH) for x in range(WIDE)}


def test_tiles_of_small_and_odd_images(spark):
    """An image under 2s + 1 pixels in a direction stays as it is; nulls count as 0; gaps and repeated pixels raise; no image gives no row."""
    small = spark.createDataFrame([(1, x, y, 9 * x + y if x else None) for x in range(6) for y in range(20)], "image_id long, x int, y int, v int")
    assert _values(stencils.box_blur(small, 3)) == {(1, x, y): (9 * x + y if x else 0,) for x in range(6) for y in range(20)}
    assert stencils.dilate(small.limit(0)).count() == 0
    for odd in (small.where("x <> 3"), small.union(small.where("x = 3"))):
        with pytest.raises(Exception, match="gaps or repeated pixels"):
            stencils.dilate(odd).collect()


def test_one_image_spreads_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        p = _image(spark)
        found = stencils.contrast_maps(p, tile=16)
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the whole chain
        top = colours.top_colours(colours.histogram(p), 16)
        spread = colours.matched_colours(p.select("image_id", *"rgba").distinct(), top)
        assert spread.count() == p.select(*"rgba").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_look_ups_by_colour_against_every_pair(spark):
    """Repeated colours, ties to the lowest index, null channels find nothing, other columns and repeated rows are kept."""
    p = _image(spark, 2).where("y < 6")
    odd = p.limit(3).withColumn("r", F.lit(None).cast("int"))
    palette = [(i, j, 40 * (j % 6), 20 * j, 200 - 9 * j) for i in (0, 1) for j in range(12)] + [(i, 12, 0, 0, 200) for i in (0, 1)]  # 12 repeats 0
    palettes = spark.createDataFrame(palette, "image_id long, idx int, r int, g int, b int")
    rows = p.union(p).withColumn("weight", F.lit(2)).unionByName(odd.withColumn("weight", F.lit(3)))
    got = colours.matched(rows, palettes).collect()
    assert len(got) == 2 * p.count() and {r["weight"] for r in got} == {2}
    own = np.array([[r[f] for f in colours.FLOATS] for r in got])
    for image in (0, 1):
        entries = np.array([colours.float_colour(*e[2:]) for e in palette if e[0] == image])
        mine = np.array([r["image_id"] == image for r in got])
        d = np.floor(search.differences(own[mine][:, None], entries[None]) * 1e12 + 0.5)
        assert (d.argmin(axis=1) == np.array([r["idx"] for r in got])[mine]).all()
        assert np.allclose(d.min(axis=1) / 1e12, np.array([r["d"] for r in got])[mine], atol=2e-12)
