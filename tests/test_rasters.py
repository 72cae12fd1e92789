"""Hand-computed vectors, properties and SQL checks for the raster operators."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill import queries
from rastermill.functions import pixels as px
from rastermill.operators import colours, dither, lists, palettes, stencils
from rastermill.sources import codecs, files, images


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    def one(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 4) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def values(spark, columns, row):
    return spark.createDataFrame([row], [f"c{i}" for i in range(len(row))]).select(*columns).first()


def test_posterize_vectors(spark):
    for bits, want in ((4, (0x00, 0x33, 0x88, 0xFF)), (3, (0x00, 0x31, 0x84, 0xFF)), (0, (0x00, 0x37, 0x80, 0xFF))):
        assert tuple(values(spark, [px.posterize(F.col(f"c{i}"), bits) for i in range(4)], (0x00, 0x37, 0x80, 0xFF))) == want


def test_flatten_and_word_vectors(spark):
    for rgba, want in (((255, 255, 255, 254), (253, 253, 253)), ((200, 100, 50, 128), (100, 50, 25)), ((9, 9, 9, 0), (0, 0, 0))):
        assert tuple(values(spark, [px.flatten(F.col(f"c{i}"), F.col("c3")) for i in range(3)], rgba)) == want
    assert values(spark, [px.palette_word(F.col("c0"), F.col("c1"), F.col("c2"))], (0xAB, 0xCD, 0xEF))[0] == 0x0ACE


def test_tie_takes_the_lowest_index(spark):
    row = spark.createDataFrame([(0, 0, 0)], ["r", "g", "b"]).select(colours.nearest([(5, 5, 5), (5, 5, 5), (9, 9, 9)])["i"]).first()
    assert row[0] == 0


def test_gamma_round_trip(spark):
    rows = spark.range(256).select(F.col("id"), px.to_rgb(F.round(px.linear(F.col("id")), 12), F.lit(1.0)).alias("v")).collect()
    assert all(r["id"] == r["v"] for r in rows)


@pytest.mark.parametrize("method", ["lanczos", "bilinear"])
def test_resize_keeps_constants(spark, method):
    flat = spark.range(100).select(F.lit(1).alias("image_id"), (F.col("id") % 10).cast("int").alias("x"), F.expr("CAST(id div 10 AS INT)").alias("y"), *[F.lit(77).alias(c) for c in "rgba"])
    for size in ((3, 17), (10, 10), (25, 4)):
        out = stencils.resize(flat, *size, method).collect()
        assert len(out) == size[0] * size[1] and all(r["r"] == r["a"] == 77 for r in out)


def test_lanczos_of_equal_size_is_the_identity():
    assert all(t == s and abs(w - 1) < 1e-9 for t, s, w in stencils.weights("lanczos", 9, 9))


def test_bilinear_of_equal_size_blurs():
    assert len({s for t, s, _ in stencils.weights("bilinear", 9, 9) if t == 4}) == 3


def test_remap_stays_in_the_palette(spark, sf):
    p, found = queries._searched(spark, sf)
    out, shown = dither.dithered_remap(p, found, 0.75, 4)
    known = {(r["image_id"], r["idx"]) for r in shown.collect()}
    rows = out.collect()
    assert len(rows) == p.count() and {(r["image_id"], r["idx"]) for r in rows} <= known


def test_refill(spark):
    tray = spark.createDataFrame([(1, i, i in (2, 5)) for i in range(16)], "image_id long, slot int, locked boolean")
    palette = spark.createDataFrame([(1, i, i, i, i) for i in range(16)], "image_id long, idx int, r int, g int, b int")
    got = [r["r"] for r in palettes.refill(tray, palette, 2).orderBy("slot").collect()]
    assert got == [0, 1, 14, 2, 3, 15, *range(4, 14)]


def test_c1_layout_and_round_trip():
    r = np.random.default_rng(2)
    idx, palette = r.integers(0, 16, (200, 320)), [(17 * i, 255 - 17 * i, 0) for i in range(16)]
    idx[0, :2] = 3, 12
    content = files.encode_c1(idx, np.array(palette))
    assert len(content) == 32768 and content[0] == 0x3C and content[32000:32256] == bytes(256) and content[32288:] == bytes(480)
    back, colours_ = files.decode_c1(content)
    assert (back == idx).all() and colours_ == palette
    small = files.encode_c1(np.array([[1, 2]]), np.array(palette))
    assert small[:2] == b"\x12\x22"


def test_png_and_rejected_files(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 256, (5, 4, 4)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(codecs.encode_png(image))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    pixels, rejected = images.read_images(spark, str(tmp_path))
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in pixels.collect()}
    assert got == {(x, y): tuple(image[y, x].tolist()) for y in range(5) for x in range(4)}
    assert [r["path"].rsplit("/", 1)[1] for r in rejected.collect()] == ["bad.png"]


def test_palette_files(spark, tmp_path):
    (tmp_path / "full.PAL").write_bytes(bytes(range(48)))
    (tmp_path / "short.pal").write_bytes(bytes([9, 8, 7, 6]))
    (tmp_path / "other.txt").write_bytes(bytes(48))
    rows = files.read_palettes(spark, str(tmp_path)).collect()
    by = {(r["name"], r["idx"]): (r["r"], r["g"], r["b"], r["a"]) for r in rows}
    assert len(by) == 32 and by["full.PAL", 5] == (15, 16, 17, 255)
    assert by["short.pal", 0] == (9, 8, 7, 255) and by["short.pal", 1] == (6, 0, 0, 255) and by["short.pal", 9] == (0, 0, 0, 255)


def test_entry_works_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "tests"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q; e.oracle_sql()"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_dither_map_writes_where_a_run_ends(spark):
    """By hand: the first run ends at column 2, n = 20; the rest of the row has n = 0."""
    rows = [(1, x, 0, i) for x, i in enumerate((0, 0, 1, 1))]
    indexed = spark.createDataFrame(rows, "image_id long, x int, y int, idx int")
    found = dither.dither_map(indexed, indexed.selectExpr("image_id", "x", "y", "0 AS edge")).orderBy("x").collect()
    assert [r["dither"] for r in found] == [42, 42, 42, 0]


def test_places_of_a_whole_order(spark):
    rows = [(i * 37 % 101, i % 7, f"n{i}") for i in range(101)]
    df = spark.createDataFrame(rows, "a int, b int, name string").repartition(5)
    got = {r["name"]: r["place"] for r in lists.placed(df, ["b", "a"]).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[0]))] and sorted(got.values()) == list(range(101))
    assert lists.placed(df.limit(0), ["a"]).count() == 0


def test_a_large_image_spreads_over_tasks(spark):
    """Tiles of one image are groups of their own."""
    plane = spark.range(64 * 64).selectExpr("1L AS image_id", "CAST(id % 64 AS INT) AS x", "CAST(id div 64 AS INT) AS y", "CAST(id * 37 % 256 AS INT) AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for op in (lambda p: stencils.dilate(p, tile=16), lambda p: stencils.box_blur(p, 3, tile=16)):
            assert op(plane).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_point_resize_meets_sizes_only(spark):
    """Pixels are joined with their image's size, never with target places."""
    sizes = {1: (5, 3), 2: (1, 4), 3: (16, 16)}
    df = spark.createDataFrame([(i, x, y, x, y, i, 255) for i, (w, h) in sizes.items() for x in range(w) for y in range(h)], "image_id long, x int, y int, r int, g int, b int, a int")
    for width, height in ((11, 20), (2, 2), (16, 1)):
        small = stencils.point_resize(df, width, height)
        assert sorted(small.collect()) == [(i, x, y, x * w // width, y * h // height, i, 255) for i, (w, h) in sizes.items() for x in range(width) for y in range(height)]
        joins = [line for line in small._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert [line.count(" = ") for line in joins] == [1]  # image_id alone
