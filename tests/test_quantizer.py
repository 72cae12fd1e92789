import random

import numpy as np
import plain_quantizer as plain
import pytest
from pyspark.sql import functions as F

from rastermill.operators import colours, dither, documents, search

HIST = "image_id long, r int, g int, b int, a int, perceptual double"
PIXELS = "image_id long, x int, y int, r int, g int, b int, a int"
PALETTE = "image_id long, idx int, fa double, fr double, fg double, fb double, popularity double, fixed boolean"


def histogram(image, n, seed, alphas=(255,)):
    r = random.Random(seed)
    seen = {(r.randrange(0, 256, 5), r.randrange(0, 256, 7), r.randrange(256), r.choice(alphas)) for _ in range(n)}
    return [(image, *c, r.choice([0.5, 1.99, 4.0, 12.25])) for c in sorted(seen)]


def items(rows):
    """As the search takes them: by rising packed bytes."""
    rows = sorted(rows, key=lambda r: (r[4], r[3], r[2], r[1]))
    return [{"f": plain.floats(*r[1:5]), "p": r[5], "w": r[5]} for r in rows]


def close(found, expected):
    return np.allclose(np.array(found, float), np.array(expected, float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("posterize,fixed,alphas", [(4, (), (255,)), (0, (), (255, 128, 0)), (4, ((0, 0, 0), (255, 255, 255)), (255,))])
def test_search_is_the_plain_one(spark, posterize, fixed, alphas):
    rows = {i: histogram(i, 20 + 25 * i, i, alphas) for i in range(4)}
    o = search.Options(speed=1, colours=12, posterize=posterize)
    df = spark.createDataFrame([r for own in rows.values() for r in own], HIST)
    found = {}
    for r in search.palettes(df, o, fixed, trials_a_step=5).orderBy("idx").collect():
        found.setdefault(r["image_id"], []).append(r)
    own = [plain.floats(*c) for c in fixed]
    for image, mine in rows.items():
        target = (2**posterize / 1024) ** 2
        hist = [h for h in items(mine) if all(plain.difference(h["f"], f) >= max(o.target_mse / 2, 2 / 65536) for f in own)]
        palette, errors = plain.search(hist, 12, own, target, search.lessened(o.trials, len(hist)), o.iterations, o.least_gain)
        got = found[image]
        ordered = sorted(palette, key=lambda e: (e["fixed"], e["f"][0] >= 255 / 256 or e["fixed"]))
        assert close([[r[c] for c in colours.FLOATS] for r in got], [e["f"] for e in ordered])
        assert [r["fixed"] for r in got] == [e["fixed"] for e in ordered]
        assert close([got[0]["cut_error"]], [errors[0]])
        assert got[0]["search_error"] <= got[0]["cut_error"] and close([got[0]["search_error"]], [min(errors)])


@pytest.mark.parametrize("limit,target", [(45 / 65536, 0.0), (1e20, 0.01), (1e-4, 0.001)])
def test_cut_is_the_plain_one(spark, limit, target):
    rows = histogram(1, 150, 9, (255, 255, 40)) + histogram(2, 1, 3)
    found = {}
    for r in search.cut_boxes(spark.createDataFrame(rows, HIST), 10, target, limit).orderBy("box").collect():
        found.setdefault(r["image_id"], []).append(r)
    for image in (1, 2):
        boxes = plain.cut(items([r for r in rows if r[0] == image]), 10, target, limit)
        assert [r["colours"] for r in found[image]] == [len(b["of"]) for b in boxes]
        assert close([[r[c] for c in colours.FLOATS] for r in found[image]], [b["mean"] for b in boxes])


def test_images_are_cut_side_by_side(monkeypatch):
    """As each alone, and in no more numpy steps than one image takes."""
    r, calls, boxes = np.random.default_rng(5), [], search._boxes
    monkeypatch.setattr(search, "_boxes", lambda *a: calls.append(1) or boxes(*a))
    n = r.integers(1, 90, 64)
    f, p = r.random((4, n.sum())).round(2), r.random(n.sum()) + 0.1
    size, target, limit = r.integers(1, 13, 64), r.choice([0, 0.01], 64), np.full(64, 1e-3)
    every = search.median_cuts(search.Colours(f, p, n), p, size, target, limit)
    assert len(calls) <= 12
    for i, (own, weight) in enumerate(zip(np.split(f, np.cumsum(n)[:-1], axis=1), np.split(p, np.cumsum(n)[:-1]), strict=True)):
        alone = search.median_cuts(search.Colours(own, weight, n[i : i + 1]), weight, size[i : i + 1], target[i : i + 1], limit[i : i + 1])
        k = alone.number[0]
        assert every.number[i] == k and alone.colours[0, :k].tolist() == every.colours[i, :k].tolist() and close(alone.mean[0, :k], every.mean[i, :k])


def test_few_colours_are_the_palette(spark):
    df = spark.createDataFrame(histogram(1, 5, 1), HIST)
    got = search.palettes(df).orderBy("idx").collect()
    assert len(got) == df.count() and {r["error"] for r in got} == {0.0}
    assert [r["popularity"] for r in got] == sorted((r["perceptual"] for r in df.collect()), reverse=True)


def test_options():
    assert [(o.trials, o.iterations) for o in map(search.Options, (1, 4, 10))] == [(47, 31), (20, 12), (0, 0)]
    assert search.Options(1).least_gain == 2.0**-22 and search.Options(1).most_entries == 2490368
    for bad in ({"speed": 0}, {"quality": (50, 40)}, {"colours": 1}, {"posterize": 5}, {"dither": 1.5}, {"gamma": 1.0}):
        with pytest.raises(ValueError):
            search.Options(**bad)
    assert search.lessened(47, 5000) == 47 and search.lessened(47, 5001) == 36 and search.lessened(47, 200000) == 16


def test_quality_and_speed(spark):
    df = spark.createDataFrame(histogram(1, 120, 4) + histogram(2, 120, 5), HIST)
    sizes = {q: search.palettes(df, search.Options(colours=100, posterize=0, quality=q)).groupBy("image_id").count().orderBy("image_id").collect() for q in ((0, 5), (0, 95))}
    assert all(a["count"] < b["count"] <= 100 for a, b in zip(sizes[0, 5], sizes[0, 95], strict=True))
    assert search.palettes(df, search.Options(colours=2, posterize=0, quality=(99, 99))).count() == 0  # not reached
    assert search.palettes(df, search.Options(speed=10)).groupBy("image_id").count().count() == 2  # one cut only
    assert search.palettes(df.limit(0)).count() == 0


def test_order_of_a_palette():
    p = search.Palette(np.array([[1, 0, 0, 0], [0.5, 0, 0, 0], [1, 1, 0, 0], [0.001, 0, 0, 0], [1, 0, 0, 1]], float), np.array([1.0, 2, 5, 9, 3]), 1)
    assert search.ordered(p, False).tolist() == [3, 1, 2, 0, 4]
    assert search.ordered(p, True).tolist() == [2, 4, 1, 0, 3]
    many = search.Palette(np.ones((20, 4)), np.arange(20, 0, -1.0))
    assert search.ordered(many, False)[:10].tolist() == [0, 7, 8, 9, 4, 5, 6, 1, 2, 3]


def picture(spark, images, seed=0, alphas=(255,)):
    """images: id -> (width, height); smooth fields with noise, so that runs and errors both occur."""
    r, rows = random.Random(seed), []
    for i, (w, h) in images.items():
        for y in range(h):
            for x in range(w):
                rows.append((i, x, y, min(255, 12 * x + r.randrange(9)), min(255, 10 * y + r.randrange(9)), r.choice([40, 42, 200]), r.choice(alphas)))
    return rows, spark.createDataFrame(rows, PIXELS)


def entries(image, n, seed, a=255):
    r = random.Random(seed)
    return [(image, k, *plain.floats(r.randrange(256), r.randrange(256), r.randrange(256), a), 1.0, k == 0) for k in range(n)]


@pytest.mark.parametrize("band_rows", [3, 1024])
def test_diffusion_is_the_plain_one(spark, band_rows):
    images = {1: (9, 7), 2: (9, 7), 3: (5, 11), 4: (1, 4), 5: (6, 1)}
    rows, df = picture(spark, images, 3, (255, 255, 90))
    palette = [e for i in images for e in entries(i, 2 + i, i)]
    r = random.Random(8)
    share = {(i, x, y): r.random() for i, x, y, *_ in rows}
    levels = spark.createDataFrame([(*k, v) for k, v in share.items()], "image_id long, x int, y int, level double")
    floats = colours.with_floats(df).select("image_id", "x", "y", *colours.FLOATS).join(levels, ["image_id", "x", "y"])
    most = spark.createDataFrame([(i, 1 / 16 + i / 100) for i in images], "image_id long, most_error double")
    found = {(r["image_id"], r["x"], r["y"]): r["idx"] for r in dither.diffused(floats, spark.createDataFrame(palette, PALETTE), most, band_rows).collect()}
    assert len(found) == len(rows)
    for i, (w, h) in images.items():
        at = {(x, y): plain.floats(*c) for j, x, y, *c in rows if j == i}
        out = plain.diffuse([[at[x, y] for x in range(w)] for y in range(h)], [e[2:6] for e in palette if e[0] == i], [[share[i, x, y] for x in range(w)] for y in range(h)], 1 / 16 + i / 100)
        assert all(found[i, x, y] == out[y][x] for x in range(w) for y in range(h))


def test_dither_map_is_the_plain_one(spark):
    r, rows = random.Random(2), []
    for i, (w, h) in enumerate([(1, 3), (2, 2), (7, 5), (12, 1), (9, 6)]):
        rows += [(i, x, y, r.choice([0, 0, 0, 1, 2]), r.randrange(256)) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, idx int, edge int")
    found = {(r["image_id"], r["x"], r["y"]): r["dither"] for r in dither.dither_map(df.drop("edge"), df.drop("idx")).collect()}
    for i in range(5):
        own = {(x, y): (idx, e) for j, x, y, idx, e in rows if j == i}
        w, h = max(x for x, _ in own) + 1, max(y for _, y in own) + 1
        out = plain.dither_map(*([[own[x, y][k] for x in range(w)] for y in range(h)] for k in (0, 1)))
        assert all(found[i, x, y] == out[y][x] for x in range(w) for y in range(h))


def test_dithered_remap_of_images_with_and_without_map(spark):
    images = {1: (12, 10), 2: (3, 9)}  # the second is too small for a map
    rows, df = picture(spark, images, 5)
    palette = [e for i in images for e in entries(i, 6, i + 10)]
    indexed, shown = dither.dithered_remap(df, spark.createDataFrame(palette, PALETTE), 0.8, 4, band_rows=4)
    found = {(r["image_id"], r["x"], r["y"]): r["idx"] for r in indexed.collect()}
    final = {}
    for r in shown.orderBy("idx").collect():
        final.setdefault(r["image_id"], []).append(tuple(r[c] for c in colours.FLOATS))
    base = (1 - (1 - 0.8) ** 2) * 15 / 16
    from rastermill.operators import stencils

    edges = {(r["image_id"], r["x"], r["y"]): r["edge"] for r in stencils.contrast_maps(df.where("image_id = 1")).collect()}
    for i, (w, h) in images.items():
        at = [[plain.floats(*next(c for j, u, v, *c in rows if (j, u, v) == (i, x, y))) for x in range(w)] for y in range(h)]
        plain_palette = [{"f": e[2:6], "fixed": e[7], "n": 0} for e in palette if e[0] == i]
        level, most = [[base] * w for _ in range(h)], 1 / 16
        if i == 1:
            near = [[plain.nearest(f, plain_palette) for f in line] for line in at]
            damped = plain.dither_map([[k for k, _ in line] for line in near], [[edges[1, x, y] for x in range(w)] for y in range(h)])
            level, most = [[base * d / 255 for d in line] for line in damped], max(1 / 16, 2.4 * sum(d for line in near for _, d in line) / w / h)
            plain.step([{"f": f, "p": 1.0, "w": 1.0} for line in at for f in line], plain_palette)
        moved = [e["f"] for e in plain_palette]
        rounding = spark.createDataFrame([(i, k, *f, 1.0, False) for k, f in enumerate(moved)], PALETTE)
        assert close(final[i], [[r[c] for c in colours.FLOATS] for r in dither.rounded(rounding, 4).orderBy("idx").collect()])
        out = plain.diffuse(at, final[i], level, most)
        assert sum(found[i, x, y] != out[y][x] for x in range(w) for y in range(h)) == 0


def test_rounding_folds_back(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 0.0, 1.0, False), (1, 1, 0.0, 0.0, 0.0, 0.0, 1.0, True), (1, 2, *plain.floats(200, 100, 50), 1.0, False), (1, 3, *plain.floats(255, 255, 255), 1.0, False)]
    got = dither.rounded(spark.createDataFrame(rows, PALETTE), 4).orderBy("idx").collect()
    assert [tuple(r[c] for c in "rgba") for r in got] == [(71, 112, 76, 0), (0, 0, 0, 0), (204, 102, 51, 255), (255, 255, 255, 255)]
    assert close([[r[c] for c in colours.FLOATS] for r in got], [(0, 0, 0, 0), (0, 0, 0, 0), plain.floats(204, 102, 51), plain.floats(255, 255, 255)])


def test_plain_remap_moves_the_palette_afterwards(spark):
    rows, df = picture(spark, {1: (8, 8)}, 4)
    palette = spark.createDataFrame(entries(1, 5, 2), PALETTE)
    indexed, shown, after = dither.plain_remap(df, palette, 4)
    used = {r["idx"]: r["n"] for r in indexed.groupBy("idx").agg(F.count("*").alias("n")).collect()}
    before = {r["idx"]: r for r in shown.collect()}
    for r in after.collect():
        if r["fixed"] or r["idx"] not in used:
            assert close([r[c] for c in colours.FLOATS], [before[r["idx"]][c] for c in colours.FLOATS])
        else:
            assert r["popularity"] == used[r["idx"]]


def plainly_rounded(rows):
    """Row by row: rows of [channels]."""
    h, w = len(rows), len(rows[0])
    rows, out = [[list(v) for v in r] for r in rows], [[None] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            out[y][x] = []
            for c in range(4):
                v = rows[y][x][c]
                whole = -int(0.5 - v) if v < 0 else int(v + 0.5)
                out[y][x].append(min(255, max(0, whole)))
                for dx, dy, share in ((1, 0, 0.364842), (-1, 1, 0.207305), (0, 1, 0.364842), (1, 1, 0.063011)):
                    if 0 <= x + dx < w and y + dy < h:
                        rows[y + dy][x + dx][c] += (v - whole) * share
    return out


@pytest.mark.parametrize("band_rows", [4, 1024])
def test_rounding_with_diffusion_is_the_plain_one(spark, band_rows):
    r, images, rows = random.Random(6), {1: (7, 9), 2: (1, 5), 3: (12, 1), 4: (2, 13)}, []
    for i, (w, h) in images.items():
        rows += [(i, x, y, *[r.uniform(-6, 262) for _ in range(4)]) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, r double, g double, b double, a double")
    found = {tuple(r)[:3]: list(r)[3:] for r in dither.rounded_with_diffusion(df, band_rows).collect()}
    for i, (w, h) in images.items():
        own = {(x, y): v for j, x, y, *v in rows if j == i}
        out = plainly_rounded([[own[x, y] for x in range(w)] for y in range(h)])
        assert all(found[i, x, y] == out[y][x] for x in range(w) for y in range(h))


def test_document_from_raster_to_tray(spark):
    rows, df = picture(spark, {1: (14, 12), 2: (10, 9), 3: (3, 3)}, 7, (255, 128))
    tray = documents.grey_tray(df).withColumn("locked", F.col("slot").isin(2, 9) & (F.col("image_id") == 1))
    doc = documents.Document(df, tray)
    before = {r["image_id"]: r["colours"] for r in doc.colours().collect()}
    options = spark.createDataFrame([(1, 1, 4, 80), (2, 3, 0, 0)], "image_id long, speed int, posterize int, dither int")
    target = doc.quantize(options)
    assert {r["image_id"] for r in target.indexed.select("image_id").distinct().collect()} == {1, 2}  # the third has no options
    palette = {(r["image_id"], r["idx"]): r for r in target.palette.collect()}
    assert sum(r["fixed"] for r in palette.values()) == 2 and all(i == 1 for (i, _), r in palette.items() if r["fixed"])
    slots = {(r["image_id"], r["slot"]): (r["r"], r["g"], r["b"]) for r in doc.tray.collect()}
    assert slots[1, 2] == (34, 34, 34) and slots[1, 9] == (153, 153, 153)  # locked ones stay
    free = [k for k in range(16) if k not in (2, 9)]
    assert [slots[1, k] for k in free] == [tuple(palette[1, i][c] for c in "rgb") for i in range(14)]
    assert slots[3, 5] == (85, 85, 85)
    one = documents.quantized(df.where("image_id = 2"), search.Options(speed=3, posterize=0, dither=0.0))
    assert sorted(tuple(r) for r in one.indexed.collect()) == sorted(tuple(r) for r in target.indexed.where("image_id = 2").collect())
    after = {r["image_id"]: r["colours"] for r in doc.keep().collect()}
    assert set(after) == {1, 2} and all(after[i] <= min(16, before[i]) for i in after)
    again = doc.quantize(options.withColumn("posterize", F.lit(0)).withColumn("dither", F.lit(0)))  # few colours: the palette holds them all
    kept = {tuple(r) for r in doc.source.where("image_id = 2").select("r", "g", "b").distinct().collect()}
    assert kept == {tuple(r) for r in again.shown().where("image_id = 2").select("r", "g", "b").distinct().collect()}
    doc.drop_palette(spark.createDataFrame([(1, 4, 1, 2, 3), (1, 5, 7, 8, 9)], "image_id long, idx int, r int, g int, b int"), [4])
    dropped = {r["slot"]: (r["r"], r["g"], r["b"]) for r in doc.tray.where("image_id = 1").collect()}
    assert dropped[4] == (1, 2, 3) and dropped[5] != (7, 8, 9) and len(dropped) == 16


def test_fixed_colours_by_image(spark):
    df = spark.createDataFrame(histogram(1, 60, 1) + histogram(2, 60, 2), HIST)
    fixed = spark.createDataFrame([(2, 1, 9, 9, 9), (2, 0, 255, 0, 0)], "image_id long, place int, r int, g int, b int")
    got = search.palettes(df, search.Options(colours=8), fixed).orderBy("image_id", "idx").collect()
    assert [r["fixed"] for r in got] == [False] * 8 + [False] * 6 + [True] * 2
    assert close([got[-2][c] for c in colours.FLOATS], plain.floats(255, 0, 0)) and close([got[-1][c] for c in colours.FLOATS], plain.floats(9, 9, 9))
