"""The registered queries for the operators of SURVEY section 2, and their SQL; README names the operators that have none."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.functions import pixels as px
from rastermill.operators import colours, dither, documents, lists, palettes, resample, search, stencils
from rastermill.sources import files, images
from rastermill.sources.rasters import EVENTS_SQL, events_raster
from rastermill.sources.scratch import written

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Sixteen fixed colours for queries that need a palette.
GREYS = [(17 * i, 17 * i, 17 * i) for i in range(16)]
MIXED = [((i * 53) % 256, (i * 101) % 256, (i * 197) % 256) for i in range(16)]


def query(sql: str | None = None):
    """Registers a query by its function's name; sql may begin after the raster px."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {EVENTS_SQL}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
        return f

    return add


def scalar(sql: str):
    """C("a") query that maps every pixel: the function gets no raster but returns columns."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return events_raster(spark, sf_dir).select("image_id", "x", "y", *[c.alias(n) for n, c in f().items()])

        run.__name__ = f.__name__
        return query(f"SELECT image_id, x, y, {sql} FROM px")(run)

    return add


PACK = "(r::BIGINT + g * 256 + b * 65536 + a::BIGINT * 16777216)"


def _posterized(bits: int, c: str) -> str:
    return f"(({c} & {255 - (2**bits - 1)}) | ({c} >> {8 - bits}))" if bits else c


def _flat(c: str) -> str:
    return f"(CASE WHEN a <> 255 THEN ({c} * a) >> 8 ELSE {c} END)"


@scalar(f"{PACK} AS packed")
def px2_pack():
    return {"packed": px.pack(C("r"), C("g"), C("b"), C("a"))}


@query(f"SELECT image_id, x, y, r, g, b, a FROM px")
def px2_unpack(spark, sf_dir):
    p = events_raster(spark, sf_dir).select("image_id", "x", "y", px.pack(C("r"), C("g"), C("b"), C("a")).alias("p"))
    return p.select("image_id", "x", "y", *[px.unpack(C("p"), i).alias(c) for i, c in enumerate("rgba")])


@scalar("r, g, b, 255 AS a")
def px1_opaque():
    return {"r": C("r"), "g": C("g"), "b": C("b"), "a": F.lit(255)}


@query("+q AS (SELECT DISTINCT image_id, (image_id * 7 % 40 - 12)::INT AS px, (image_id * 11 % 40 - 12)::INT AS py FROM px) SELECT q.image_id, q.px, q.py, r, g, b, a FROM q JOIN px ON px.image_id = q.image_id AND x = least(greatest(q.px, 0), 15) AND y = least(greatest(q.py, 0), 15)")
def px3_point_lookup(spark, sf_dir):
    p = events_raster(spark, sf_dir)
    places = p.select("image_id").distinct().select("image_id", (C("image_id") * 7 % 40 - 12).cast("int").alias("px"), (C("image_id") * 11 % 40 - 12).cast("int").alias("py"))
    return stencils.lookup(p, places)


@query("SELECT image_id, round(r / 255.0, 6)::DOUBLE AS r, round(g / 255.0, 6)::DOUBLE AS g, round(b / 255.0, 6)::DOUBLE AS b FROM px WHERE x = 5 AND y = 3")
def px4_eyedropper(spark, sf_dir):
    return events_raster(spark, sf_dir).where("x = floor(5.7D) AND y = floor(3.2D)").select("image_id", *[F.round(C(c) / 255.0, 6).cast("double").alias(c) for c in "rgb"])


@scalar(f"{_flat('r')} AS r, {_flat('g')} AS g, {_flat('b')} AS b, 255 AS a")
def px5_flatten_alpha():
    return {c: px.flatten(C(c), C("a")) for c in "rgb"} | {"a": F.lit(255)}


@scalar("(trunc(r / 300.0 * 255)::INT & 255) AS v")
def px6_to_byte_truncated():
    return {"v": px.to_byte_truncated(C("r") / 300.0)}


@scalar("round(r / 255.0, 6)::DOUBLE AS r, round(a / 255.0, 6)::DOUBLE AS a")
def px7_to_float():
    return {"r": F.round(C("r") / 255.0, 6).cast("double"), "a": F.round(C("a") / 255.0, 6).cast("double")}


@scalar(", ".join(f"{_posterized(b, 'g')} AS g{b}" for b in (0, 3, 4)))
def px8_posterize():
    return {f"g{b}": px.posterize(C("g"), b) for b in (0, 3, 4)}


@scalar("CASE WHEN a = 0 THEN 0 ELSE " + f"({_posterized(4, 'r')}::BIGINT + {_posterized(4, 'g')} * 256 + {_posterized(4, 'b')} * 65536 + {_posterized(4, 'a')}::BIGINT * 16777216) END AS packed")
def px9_posterize_pixel():
    return {"packed": F.when(C("a") == 0, F.lit(0).cast("long")).otherwise(px.pack(*(px.posterize(C(c), 4) for c in "rgba")))}


GAMMA = px.INTERNAL_GAMMA / px.DISPLAY_GAMMA


@scalar(f"round(pow(r / 255.0, {GAMMA!r}), 5)::DOUBLE AS v")
def px10_gamma():
    return {"v": F.round(px.linear(C("r")), 5)}


@scalar(", ".join(f"round(pow({c} / 255.0, {GAMMA!r}) * a / 255.0, 5)::DOUBLE AS {c}" for c in "rgb"))
def px11_premultiply():
    return {c: F.round(px.premultiplied(C(c), C("a")), 5) for c in "rgb"}


@query("SELECT image_id, x, y, r, g, b FROM px WHERE a = 255")
def px12_unpremultiply(spark, sf_dir):
    p = events_raster(spark, sf_dir).where("a = 255")
    return p.select("image_id", "x", "y", *[px.to_rgb(F.round(px.premultiplied(C(c), C("a")), 12), C("a") / 255.0).cast("int").alias(c) for c in "rgb"])


def _dist_sql() -> str:
    p = lambda c: f"(pow({c} / 255.0, {GAMMA!r}) * a / 255.0)"
    t = "+".join(f"greatest(pow({p(c)} - 0.5, 2), pow({p(c)} - 0.5 + (1 - a / 255.0), 2))" for c in "rgb")
    return f"round({t}, 5)::DOUBLE AS d"


@scalar(_dist_sql())
def px13_colour_distance():
    own = [C("a") / 255.0, *(px.premultiplied(C(c), C("a")) for c in "rgb")]
    return {"d": F.round(px.distance(own, [F.lit(1.0), F.lit(0.5), F.lit(0.5), F.lit(0.5)]), 5)}


@query("WITH q AS (SELECT p_partkey, p_partkey % 101 AS quality FROM part) SELECT p_partkey, quality, CASE WHEN quality = 0 THEN 1e20 WHEN quality = 100 THEN 0 ELSE round(greatest(0, 0.016 / (0.001 + quality) - 0.001) + 2.5 / pow(210.0 + quality, 1.2) * (100.1 - quality) / 100.0, 9) END::DOUBLE AS mse FROM q")
def px15_quality_to_mse(spark, sf_dir):
    quality = C("p_partkey") % 101
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", quality.alias("quality"), F.round(px.quality_to_mse(quality), 9).alias("mse"))


def _curve_sql() -> str:
    x = "((r / 255.0::DOUBLE + 0.055) / 1.055)"
    to = " + ".join(f"{c!r}::DOUBLE * pow({x}, {i})" for i, c in enumerate(px.POWER_24)) + f" + {px.POWER_24_FRACTION[0]!r}::DOUBLE / ({px.POWER_24_FRACTION[1]!r}::DOUBLE + {px.POWER_24_FRACTION[2]!r}::DOUBLE * {x})"
    back = " + ".join(f"{c!r}::DOUBLE * pow(g / 255.0::DOUBLE, {e!r}::DOUBLE)" for e, c in px.ROOT_24.items())
    return f"round(CASE WHEN r / 255.0::DOUBLE <= 0.04045 THEN r / 255.0::DOUBLE / 12.92 ELSE {to} END, 6)::DOUBLE AS linear, round(CASE WHEN g / 255.0::DOUBLE <= 0.0031308 THEN g / 255.0::DOUBLE * 12.92 ELSE 1.055 * ({back}) - 0.055 END, 6)::DOUBLE AS srgb"


@scalar(_curve_sql())
def px16_srgb_to_linear():
    return {"linear": F.round(px.srgb_to_linear(C("r") / F.lit(255.0)), 6), "srgb": F.round(px.linear_to_srgb(C("g") / F.lit(255.0)), 6)}


@scalar("least(greatest(CASE WHEN r * 1.5 - 90 < 0 THEN -floor(-(r * 1.5 - 90) + 0.5) ELSE floor(r * 1.5 - 90 + 0.5) END, -20), 255)::INT AS v")
def px17_round_clamp():
    return {"v": px.round_half_up((C("r") * F.lit(1.5) - 90).cast("double"), -20, 255)}


@scalar("""round(CASE WHEN greatest(r,g,b) = least(r,g,b) THEN 0 WHEN greatest(r,g,b) = r THEN (((g-b)::DOUBLE/(greatest(r,g,b)-least(r,g,b))) / 6 + 1) % 1
 WHEN greatest(r,g,b) = g THEN (2 + (b-r)::DOUBLE/(greatest(r,g,b)-least(r,g,b))) / 6 ELSE (4 + (r-g)::DOUBLE/(greatest(r,g,b)-least(r,g,b))) / 6 END, 6)::DOUBLE AS h,
 round(CASE WHEN greatest(r,g,b) = 0 THEN 0 ELSE (greatest(r,g,b)-least(r,g,b))::DOUBLE / greatest(r,g,b) END, 6)::DOUBLE AS s, round(greatest(r,g,b) / 255.0, 6)::DOUBLE AS v""")
def px18_hsv():
    return {n: F.round(c, 6).cast("double") for n, c in zip("hsv", px.hsv(C("r"), C("g"), C("b")), strict=True)}


@scalar("floor(least(greatest(r / 200.0 - 0.1, 0), 1) * 255 + 0.5)::INT AS v")
def px19_to_byte_rounded():
    return {"v": px.to_byte_rounded((C("r") / 200.0 - 0.1).cast("double"))}


@scalar("round((g - r) * (b / 255.0) + r, 6)::DOUBLE AS v")
def px20_lerp():
    return {"v": F.round(px.lerp(C("r"), C("g"), C("b") / 255.0), 6).cast("double")}


@scalar("(((r >> 4) << 8) | ((g >> 4) << 4) | (b >> 4)) AS word")
def px21_palette_word():
    return {"word": px.palette_word(C("r"), C("g"), C("b"))}


@query("SELECT image_id, count(DISTINCT " + PACK + ") AS colours FROM px GROUP BY image_id")
def agg1_distinct_colours(spark, sf_dir):
    return colours.distinct_colours(events_raster(spark, sf_dir))


def _hist_sql(bits: int, image: bool = True) -> str:
    keys = ", ".join(f"CASE WHEN a = 0 THEN 0 ELSE {_posterized(bits, c)} END AS {c}" for c in "rgba")
    i = "image_id, " if image else ""
    return f"hist AS (SELECT {i}r, g, b, a, sum(w)::BIGINT AS weight FROM (SELECT {i}{keys}, CASE WHEN a = 0 THEN 2000 ELSE 255 END AS w FROM px) GROUP BY {i}r, g, b, a)"


@query(f"+{_hist_sql(4)} SELECT * FROM hist")
def hist1_weighted(spark, sf_dir):
    return colours.histogram(events_raster(spark, sf_dir), 4)


@query(f"+{_hist_sql(3)}, p AS (SELECT image_id, r, g, b, a, least(weight / 128.0, 25.6)::DOUBLE AS perceptual FROM hist) SELECT *, round(sum(perceptual) OVER (PARTITION BY image_id), 6)::DOUBLE AS total FROM p")
def hist2_normalised(spark, sf_dir):
    p = events_raster(spark, sf_dir)
    out = colours.normalised(colours.histogram(p, 3), p.groupBy("image_id").agg(F.count("*").alias("n")))
    return out.withColumn("perceptual", C("perceptual").cast("double")).withColumn("total", F.round("total", 6).cast("double"))


@query("+n AS (SELECT image_id, " + ", ".join(f"count(DISTINCT CASE WHEN a = 0 THEN 0 ELSE {_posterized(b, 'r')}::BIGINT + {_posterized(b, 'g')} * 256 + {_posterized(b, 'b')} * 65536 + {_posterized(b, 'a')}::BIGINT * 16777216 END) AS n{b}" for b in range(5)) + " FROM px GROUP BY image_id) SELECT image_id, CASE WHEN n0 <= 200 THEN 0 WHEN n1 <= 200 THEN 1 WHEN n2 <= 200 THEN 2 WHEN n3 <= 200 THEN 3 ELSE 4 END AS bits, n0, n1, n2, n3, n4 FROM n")
def hist3_fitting_bits(spark, sf_dir):
    return colours.fitting_bits(events_raster(spark, sf_dir), 200)


@query(f"+{_hist_sql(4, False)} SELECT * FROM hist")
def hist4_shared(spark, sf_dir):
    return colours.histogram(events_raster(spark, sf_dir), 4, per_image=False)


def _floats_sql(t: str) -> str:
    """Table f<t>: t with the premultiplied gamma floats of its colours."""
    return f"f{t} AS (SELECT *, a / 255.0 AS fa, " + ", ".join(f"pow({c} / 255.0, {GAMMA!r}) * a / 255.0 AS f{c}" for c in "rgb") + f" FROM {t})"


def _distance_sql(p: str, q: str) -> str:
    """PX13 of two rows with floats, by their column prefixes."""
    def black(c: str) -> str:
        return f"({p}f{c} - {q}f{c})"

    def white(c: str) -> str:
        return f"({black(c)} + ({q}fa - {p}fa))"

    return "(" + " + ".join(f"greatest({black(c)} * {black(c)}, {white(c)} * {white(c)})" for c in "rgb") + ")"


def _ranked_sql(p: str, q: str) -> str:
    return f"floor({_distance_sql(p, q)} * 1e12::DOUBLE + 0.5)::BIGINT"


FHIST = f"{_hist_sql(4)}, {_floats_sql('hist')}"
FMEAN = f"{FHIST}, m AS (SELECT image_id, " + ", ".join(f"sum(f{c} * weight)::DOUBLE / sum(weight) AS mean_f{c}" for c in "rgba") + " FROM fhist GROUP BY image_id)"


@query(f"+{FMEAN} SELECT image_id, " + ", ".join(f"round(mean_f{c}, 5) AS mean_{c}" for c in "rgba") + " FROM m")
def agg2_mean_colour(spark, sf_dir):
    m = colours.mean_colour(colours.histogram(events_raster(spark, sf_dir), 4))
    return m.select("image_id", *[F.round(f"mean_{c}", 5).alias(f"mean_{c}") for c in "rgba"])


def _var_sql(digits: int = 3) -> str:
    out = []
    for c, s in (("r", 7 / 16), ("g", 9 / 16), ("b", 5 / 16), ("a", 4 / 16)):
        d, t = f"pow(f{c} - mean_f{c}, 2)", (2 if c == "a" else 1) / 256
        out.append(f"round(sum(CASE WHEN {d} < {t * t!r} THEN {d} * 0.25 ELSE {d} END * weight) * {s}, {digits}) AS var_{c}")
    return ", ".join(out)


@query(f"+{FMEAN} SELECT image_id, {_var_sql()} FROM fhist JOIN m USING (image_id) GROUP BY image_id")
def agg3_variance(spark, sf_dir):
    v = colours.variance(colours.histogram(events_raster(spark, sf_dir), 4))
    return v.select("image_id", *[F.round(f"var_{c}", 3).alias(f"var_{c}") for c in "rgba"])


@query(f"+{FMEAN} SELECT image_id, round(max({_distance_sql('', 'mean_')}), 5) AS max_error, round(sum({_distance_sql('', 'mean_')} * weight), 2) AS total_error FROM fhist JOIN m USING (image_id) GROUP BY image_id")
def agg4_agg5_box_errors(spark, sf_dir):
    e = colours.errors_from_mean(colours.histogram(events_raster(spark, sf_dir), 4))
    return e.select("image_id", F.round("max_error", 5).alias("max_error"), F.round("total_error", 2).alias("total_error"))


TOP = f"{_hist_sql(4)}, top AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY weight DESC, r, g, b, a) - 1)::INT AS idx FROM hist) WHERE idx < 16)"
NEAR = f"""{_floats_sql("px")}, {_floats_sql("top")}, near AS (SELECT * EXCLUDE (q), (q).i AS idx, (q).d / 1e12::DOUBLE AS d FROM (
  SELECT p.*, (SELECT min({{'d': {_ranked_sql("p.", "t.")}, 'i': t.idx}}) FROM ftop t WHERE t.image_id = p.image_id) AS q FROM fpx p))"""


def _tops(spark, sf_dir):
    p = events_raster(spark, sf_dir)
    return p, colours.top_colours(colours.histogram(p, 4), 16)


@query(f"+{TOP} SELECT image_id, idx, r, g, b, a, weight FROM top")
def lim1_top_colours(spark, sf_dir):
    return _tops(spark, sf_dir)[1].select("image_id", "idx", *"rgba", "weight")


def _nn_sql(palette) -> str:
    rows = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(palette))
    return f"""+pal(i, pr, pg, pb) AS (VALUES {rows}), s AS (SELECT image_id, x, y, i, (r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb) AS d FROM px, pal)
      SELECT image_id, x, y, i AS idx, d FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY d, i) AS k FROM s) WHERE k = 1"""


@query(_nn_sql(MIXED))
def nn1_nearest_palette(spark, sf_dir):
    best = colours.nearest(MIXED)
    return events_raster(spark, sf_dir).withColumn("q", best).select("image_id", "x", "y", C("q.i").alias("idx"), C("q.d").alias("d"))


@query(f"+{TOP}, {NEAR} SELECT image_id, x, y, idx, round(d, 5) AS d FROM near")
def nn2_remap(spark, sf_dir):
    return colours.remapped(*_tops(spark, sf_dir)).select("image_id", "x", "y", "idx", F.round("d", 5).alias("d"))


@query(f"+{TOP}, {NEAR} SELECT image_id, round(avg(d), 6) AS mean_sq_error FROM near GROUP BY image_id")
def agg9_remap_error(spark, sf_dir):
    return colours.remap_error(colours.remapped(*_tops(spark, sf_dir))).withColumn("mean_sq_error", F.round("mean_sq_error", 6))


@query(f"+{TOP}, {NEAR} SELECT image_id, idx, count(*) AS pixels FROM near GROUP BY image_id, idx")
def agg10_popularity(spark, sf_dir):
    return colours.remapped(*_tops(spark, sf_dir)).groupBy("image_id", "idx").agg(F.count("*").alias("pixels"))


@query("SELECT image_id, count(*) FILTER (WHERE x % 3 = 0) AS locked FROM px GROUP BY image_id")
def agg12_count_if(spark, sf_dir):
    return events_raster(spark, sf_dir).groupBy("image_id").agg(F.count_if(C("x") % 3 == 0).alias("locked"))


@query(f"+{TOP}, {_floats_sql('top')} SELECT p.image_id, p.idx, round(min({_distance_sql('p.', 'q.')}), 5) AS nearest FROM ftop p JOIN ftop q ON p.image_id = q.image_id AND p.idx <> q.idx GROUP BY p.image_id, p.idx")
def nn3_isolation(spark, sf_dir):
    return colours.isolation(_tops(spark, sf_dir)[1]).withColumn("nearest", F.round("nearest", 5))


BACK = "bg AS (SELECT image_id, x, y, b AS r, r AS g, g AS b, 255 AS a FROM px)"


@query(f"+{TOP}, {NEAR}, {BACK}, {_floats_sql('bg')} SELECT n.image_id, n.x, n.y, CASE WHEN {_ranked_sql('n.', 'k.')} / 1e12::DOUBLE <= d THEN 99 ELSE idx END AS idx FROM near n JOIN fbg k USING (image_id, x, y)")
def nn4_background(spark, sf_dir):
    p, top = _tops(spark, sf_dir)
    return colours.with_background(colours.remapped(p, top), p.select("image_id", "x", "y", C("b").alias("r"), C("r").alias("g"), C("g").alias("b")), 99)


STEP = f"""{TOP}, {_floats_sql("hist")}, {_floats_sql("top")}, hn AS (SELECT h.*, (SELECT min({{'d': {_ranked_sql("h.", "t.")}, 'i': t.idx}}) FROM ftop t WHERE t.image_id = h.image_id) AS q FROM fhist h),
  ks AS (SELECT image_id, (q).i AS idx, sum(weight)::BIGINT AS w, sum(fa*weight) AS sa, sum(fr*weight) AS sr, sum(fg*weight) AS sg, sum(fb*weight) AS sb, sum((q).d / 1e12::DOUBLE * weight) AS e FROM hn GROUP BY ALL)"""


@query(f"+{STEP} SELECT image_id, t.idx, " + ", ".join(f"round(CASE WHEN w > 0 THEN s{c} / w ELSE t.f{c} END, 5)::DOUBLE AS f{c}" for c in "argb") + ", coalesce(w, 0) AS popularity, round(coalesce(e, 0), 4) AS error FROM ftop t LEFT JOIN ks USING (image_id, idx)")
def agg7_agg8_kmeans_step(spark, sf_dir):
    p, top = _tops(spark, sf_dir)
    out = colours.kmeans_step(colours.histogram(p, 4), top)
    return out.select("image_id", "idx", *[F.round(c, 5).alias(c) for c in colours.FLOATS], "popularity", F.round("error", 4).alias("error"))


@query(f"+{TOP} SELECT image_id, idx, (row_number() OVER (PARTITION BY image_id ORDER BY (a = 255)::INT, weight DESC, r, g, b, a) - 1)::INT AS place FROM top")
def srt1_palette_order(spark, sf_dir):
    return colours.palette_order(_tops(spark, sf_dir)[1]).select("image_id", "idx", "place")


@query(f"+{_hist_sql(3)}, v AS (SELECT image_id, g AS v, sum(weight) AS w FROM hist GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY image_id ORDER BY v) AS cum, sum(w) OVER (PARTITION BY image_id) AS total FROM v) SELECT image_id, min(v) AS median FROM c WHERE 2 * cum >= total GROUP BY image_id")
def srt2_weighted_median(spark, sf_dir):
    return colours.weighted_median(colours.histogram(events_raster(spark, sf_dir), 3), "g")


@query(f"+{FMEAN}, v AS (SELECT image_id, {_var_sql(6)} FROM fhist JOIN m USING (image_id) GROUP BY image_id), c AS (" + " UNION ALL ".join(f"SELECT image_id, var_{c} AS v, '{c}' AS c FROM v" for c in "abgr") + ") SELECT image_id, string_agg(c, '' ORDER BY v DESC, c) AS channels FROM c GROUP BY image_id")
def srt3_channel_order(spark, sf_dir):
    return colours.widest_channel(colours.histogram(events_raster(spark, sf_dir), 4))


BOX_ROWS = ", ".join(f"(count(*) * sum({c} * {c}) - sum({c}) * sum({c}))::DOUBLE AS var_{c}" for c in "argb")


@query(f"+b AS (SELECT image_id, y AS box, count(DISTINCT (r, g, b, a)) AS colours, sum(r)::BIGINT AS weight, {BOX_ROWS}, (max(g) - min(g))::DOUBLE AS worst FROM px WHERE y % 5 > 0 OR x = 3 GROUP BY ALL) SELECT image_id, first(box ORDER BY weight * greatest(var_a, var_r, var_g, var_b) * greatest(1, worst / 200) DESC, box) AS box FROM b WHERE colours > 1 GROUP BY image_id")
def srt4_best_box(spark, sf_dir):
    """Rows of pixels as boxes, some of one colour; errors on both sides of the limit."""
    var = [(F.count("*") * F.sum(C(c) * C(c)) - F.sum(c) * F.sum(c)).cast("double").alias(f"var_{c}") for c in "argb"]
    rows = events_raster(spark, sf_dir).where("y % 5 > 0 OR x = 3")
    boxes = rows.groupBy("image_id", C("y").alias("box")).agg(F.count_distinct(F.struct(*"rgba")).alias("colours"), F.sum("r").alias("weight"), *var, (F.max("g") - F.min("g")).cast("double").alias("worst"))
    return colours.best_box(boxes, 200.0)


@query(f"+c AS (SELECT image_id, r // 64 AS r, g // 64 AS g, b // 64 AS b, 255 AS a, count(*) - 1 AS weight FROM px GROUP BY ALL) SELECT * FROM c WHERE weight > 0")
def flt6_zero_weights(spark, sf_dir):
    counts = events_raster(spark, sf_dir).groupBy("image_id", *[F.expr(f"{c} div 64").cast("int").alias(c) for c in "rgb"]).agg((F.count("*") - 1).alias("weight"))
    return colours.without_zero_weights(counts.withColumn("a", F.lit(255)).select("image_id", *"rgba", "weight"))


@query(f"+{FHIST}, fixed(fa, fr, fg, fb) AS (VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in colours.float_colour(*c)) + ")" for c in GREYS[:4]) + f") SELECT h.* EXCLUDE (fa, fr, fg, fb) FROM fhist h WHERE (SELECT min({_distance_sql('h.', 'k.')}) FROM fixed k) >= 0.01")
def flt5_set2_without_fixed(spark, sf_dir):
    return colours.without_fixed(colours.histogram(events_raster(spark, sf_dir), 4), GREYS[:4], target_mse=0.02)


@query(f"+{TOP} SELECT image_id, idx, r, g, b FROM top WHERE idx < 14 UNION ALL SELECT DISTINCT image_id, 14, 0, 0, 0 FROM top UNION ALL SELECT DISTINCT image_id, 15, 17, 17, 17 FROM top")
def set1_with_fixed(spark, sf_dir):
    return colours.with_fixed(_tops(spark, sf_dir)[1], GREYS[:2], 16)


@query("SELECT image_id, x, y, r, g, b, a FROM px WHERE x BETWEEN 2 AND 9 AND y BETWEEN 1 AND 7 AND a > 0")
def flt6_flt8_clip(spark, sf_dir):
    return events_raster(spark, sf_dir).where("x BETWEEN 2 AND 9 AND y BETWEEN 1 AND 7 AND a > 0")


AROUND = """coalesce(lag({v}) OVER r, {v}), coalesce(lead({v}) OVER r, {v}), coalesce(lag({v}) OVER c, {v}), coalesce(lead({v}) OVER c, {v})"""
FRAMES = "WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)"


def _plane(spark, sf_dir):
    return events_raster(spark, sf_dir).select("image_id", "x", "y", C("g").alias("v"))


@query(f"SELECT image_id, x, y, greatest(g, {AROUND.format(v='g')}) AS v FROM px {FRAMES}")
def win2_dilate(spark, sf_dir):
    return stencils.dilate(_plane(spark, sf_dir))


@query(f"SELECT image_id, x, y, least(g, {AROUND.format(v='g')}) AS v FROM px {FRAMES}")
def win3_erode(spark, sf_dir):
    return stencils.erode(_plane(spark, sf_dir))


def _blur_sql(s: int) -> str:
    o = f"(SELECT unnest(range({-(s - 1)}, {s + 1})) AS o)"
    return f"""+h AS (SELECT p.image_id, p.x, p.y, (sum(q.g) // {2 * s})::INT AS v FROM px p, {o} JOIN px q ON q.image_id = p.image_id AND q.y = p.y AND q.x = least(greatest(p.x + o, 0), 15) GROUP BY ALL)
      SELECT p.image_id, p.x, p.y, (sum(q.v) // {2 * s})::INT AS v FROM h p, {o} JOIN h q ON q.image_id = p.image_id AND q.x = p.x AND q.y = least(greatest(p.y + o, 0), 15) GROUP BY ALL"""


@query(_blur_sql(3))
def win4_box_blur(spark, sf_dir):
    return stencils.box_blur(_plane(spark, sf_dir), 3)


def _contrast_sql() -> str:
    planes = ", ".join(f"pow({c} / 255.0, {GAMMA!r}) * a / 255.0 AS {c}" for c in "rgb")
    bend = lambda c, w: f"abs(coalesce(lag({c}) OVER {w}, {c}) + coalesce(lead({c}) OVER {w}, {c}) - 2 * {c})"
    return f"""+f AS (SELECT image_id, x, y, {planes}, a / 255.0 AS a FROM px),
      e AS (SELECT image_id, x, y, greatest({', '.join(bend(c, 'r') for c in 'rgba').replace('OVER r', 'OVER rr')}) AS hor, greatest({', '.join(bend(c, 'c') for c in 'rgba').replace('OVER c', 'OVER cc')}) AS ver FROM f WINDOW rr AS (PARTITION BY image_id, y ORDER BY x), cc AS (PARTITION BY image_id, x ORDER BY y))
      SELECT image_id, x, y, least(255, greatest(0, 255 - trunc(round(256 * greatest(hor, ver), 6))))::INT AS edge,
        least(255, greatest(0, 85 + trunc(round(171 * pow(1 - greatest(greatest(hor, ver) - abs(hor - ver) / 2, least(hor, ver)), 4), 6))))::INT AS noise FROM e"""


@query(_contrast_sql())
def win1_contrast_maps(spark, sf_dir):
    return stencils.contrast(events_raster(spark, sf_dir))


def _smooth_sql() -> str:
    """WIN5 as steps of windows over the planes of WIN1."""
    steps = [f"w1 AS MATERIALIZED ({_contrast_sql().partition('SELECT image_id, x, y, least')[1]}{_contrast_sql().partition('SELECT image_id, x, y, least')[2]})"]

    def step(name: str, of: str, column: str, kind: str) -> str:
        steps.append(f"{name} AS MATERIALIZED (SELECT image_id, x, y, {kind}({column}, {AROUND.format(v=column)}) AS v FROM {of} {FRAMES})")
        return name

    def blur(name: str, of: str, size: int) -> str:
        o = f"(SELECT unnest(range({1 - size}, {size + 1})) AS o)"
        steps.append(f"{name}_h AS MATERIALIZED (SELECT p.image_id, p.x, p.y, (sum(q.v) // {2 * size})::INT AS v FROM {of} p, {o} JOIN {of} q ON q.image_id = p.image_id AND q.y = p.y AND q.x = least(greatest(p.x + o, 0), 15) GROUP BY ALL)")
        steps.append(f"{name} AS MATERIALIZED (SELECT p.image_id, p.x, p.y, (sum(q.v) // {2 * size})::INT AS v FROM {name}_h p, {o} JOIN {name}_h q ON q.image_id = p.image_id AND q.x = p.x AND q.y = least(greatest(p.y + o, 0), 15) GROUP BY ALL)")
        return name

    at = step("n2", step("n1", "w1", "noise", "greatest"), "v", "greatest")
    at = step("n4", blur("n3", at, 3), "v", "greatest")
    for name in ("n5", "n6", "n7"):
        at = step(name, at, "v", "least")
    step("e2", step("e1", "w1", "edge", "least"), "v", "greatest")
    steps.append("w5 AS MATERIALIZED (SELECT image_id, x, y, n7.v AS noise, least(n7.v, e2.v) AS edge FROM n7 JOIN e2 USING (image_id, x, y))")
    return _contrast_sql().partition("SELECT image_id, x, y, least")[0].rstrip() + ", " + ", ".join(steps)


@query(_smooth_sql() + " SELECT * FROM w5")
def win5_smooth_maps(spark, sf_dir):
    return stencils.contrast_maps(events_raster(spark, sf_dir))


@query("SELECT image_id, least(255, greatest(0, floor((r // 4) * 4 + 0.5)))::INT AS v, x, y FROM px")
def win11_truncate_bits(spark, sf_dir):
    return events_raster(spark, sf_dir).select("image_id", "x", "y", px.round_half_up(F.expr("CAST(r div 4 * 4 AS DOUBLE)"), 0, 255).alias("v"))


def _grid(w: int, h: int) -> str:
    return f"grid AS (SELECT DISTINCT image_id, gx::INT AS gx, gy::INT AS gy FROM px, (SELECT unnest(range(0, {w})) AS gx), (SELECT unnest(range(0, {h})) AS gy))"


@query(f"+{_grid(11, 20)} SELECT grid.image_id, gx AS x, gy AS y, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in "rgba") + " FROM grid LEFT JOIN px ON px.image_id = grid.image_id AND px.x = gx + 2 AND px.y = gy - 2")
def geo1_crop_centre(spark, sf_dir):
    return stencils.crop(events_raster(spark, sf_dir), 11, 20, (0, 0))


@query(f"+{_grid(11, 20)} SELECT grid.image_id, gx AS x, gy AS y, r, g, b, a FROM grid JOIN px ON px.image_id = grid.image_id AND px.x = gx * 16 // 11 AND px.y = gy * 16 // 20")
def geo2_point_resize(spark, sf_dir):
    return stencils.point_resize(events_raster(spark, sf_dir), 11, 20)


def _placing_sql(size: int, wanted: int) -> tuple[str, str]:
    """Step and offset of target places."""
    k = f"({size - 1}::DOUBLE / {wanted - 1}::DOUBLE)" if wanted > size else f"({size}::DOUBLE / {wanted}::DOUBLE)"
    return k, "0::DOUBLE" if wanted > size else f"(({k} - 1) * 0.5::DOUBLE)"


def _bilinear_sql(n: str, size: int, wanted: int) -> str:
    """Weights n(t, s, k): the mean of bilinear samples about each place."""
    ratio = f"({size}::DOUBLE / {wanted}::DOUBLE)"
    steps = 1 if size < wanted else int(2 * size / wanted) + 1
    pos = f"t * {ratio} + (i / {max(1, steps - 1)}::DOUBLE - 0.5::DOUBLE) * {ratio}" if steps > 1 else f"t * {ratio}"
    return f"""{n}_p AS (SELECT t, {pos} AS pos FROM (SELECT unnest(range({wanted})) AS t), (SELECT unnest(range({steps})) AS i)),
  {n} AS MATERIALIZED (SELECT t, least(greatest(trunc(pos)::INT + o, 0), {size - 1}) AS s, sum(CASE WHEN o = 0 THEN 1 - (pos - trunc(pos)) ELSE pos - trunc(pos) END / {steps}::DOUBLE) AS k FROM {n}_p, (VALUES (0), (1)) v(o) GROUP BY ALL)"""


def _lanczos_sql(n: str, size: int, wanted: int) -> str:
    """Weights n(t, s, k): a sinc windowed by its third, of unit sum."""
    k, offset = _placing_sql(size, wanted)
    sinc = lambda x: f"CASE WHEN {x} = 0 THEN 1 ELSE sin(pi() * ({x})) / (pi() * ({x})) END"
    return f"""{n}_p AS (SELECT t, p, (p - ({offset} + t * {k})) / greatest({k}, 1) AS d FROM (SELECT unnest(range({wanted})) AS t), (SELECT unnest(range({-4 * size - 20}, {6 * size + 20})) AS p)),
  {n}_w AS (SELECT t, p, ({sinc("d")}) * ({sinc("(d / 3)")}) AS w FROM {n}_p WHERE abs(d) < 3),
  {n} AS MATERIALIZED (SELECT t, least(greatest(p, 0), {size - 1})::INT AS s, sum(w / whole) AS k FROM {n}_w JOIN (SELECT t, sum(w) AS whole FROM {n}_w GROUP BY t) USING (t) GROUP BY ALL)"""


def _designed_sql(n: str, size: int, wanted: int, preset: str = "default") -> str:
    """Weights n(t, s, k) of the designed filters, from their formulas; for sizes that need no half-band filter."""
    p, phases = resample.PRESETS[preset], resample.PHASES
    k, offset = _placing_sql(size, wanted)
    first, f = wanted >= size, 2 if size < 2 * wanted else 1
    cutoff = "1::DOUBLE" if first else f"(1 / {k})"
    wide = cutoff if f == 2 else f"(2 * {cutoff})"
    window = lambda t, half, alpha: f"cos(pi() / 2 * {t} / {half}) * (1 - pow({t} / {half}, {alpha!r}::DOUBLE))"

    def sinc(name: str, half: str, freq: str, alpha: float, gain: str) -> str:
        return f"""{name}_r AS (SELECT e, CASE WHEN e = 0 THEN {freq} / pi() ELSE sin({freq} * e) / (pi() * e) * {window("abs(e)", half, alpha)} END AS w
    FROM (SELECT unnest(range(1 - ceil({half})::INT, ceil({half})::INT)) AS e)), {name} AS MATERIALIZED (SELECT e, w / (SELECT sum(w) FROM {name}_r) * {gain} AS w FROM {name}_r)"""

    def trim(name: str, of: str, gain: str) -> str:
        kept = f"SELECT e, w FROM {of} WHERE abs(e) <= (SELECT max(abs(e)) FROM {of} WHERE e = 0 OR abs(w) >= 0.00001)"
        return f"{name} AS MATERIALIZED (SELECT e, w / (SELECT sum(w) FROM ({kept})) * {gain} AS w FROM ({kept}))"

    parts = [sinc(f"{n}_l1", f"(0.25::DOUBLE * {p['lp'][1]!r}::DOUBLE / {cutoff} * {f})", f"(pi() * {p['lp'][2]!r}::DOUBLE * {cutoff} / {f})", p["lp"][0], "1"), trim(f"{n}_low", f"{n}_l1", str(f))]
    parts.append(sinc(f"{n}_long", f"(0.5::DOUBLE * {p['int'][2]!r}::DOUBLE / {wide} * {phases})", f"(pi() * {p['int'][1]!r}::DOUBLE * {wide} / {phases})", p["int"][0], str(phases)))
    parts.append(f"{n}_at AS MATERIALIZED (SELECT t, floor(pos)::INT AS whole, trunc((pos - floor(pos)) * {phases})::INT AS phase FROM (SELECT t, {f} * {offset} + {f} * {k} * t AS pos FROM (SELECT unnest(range({wanted})) AS t)))")
    # taps of the interpolator by phase: the long sinc at every {phases}-th place, filtered by the low-pass filter
    parts.append(f"""{n}_ph AS (SELECT DISTINCT phase FROM {n}_at UNION SELECT 0),
  {n}_one AS (SELECT phase, ((e + phase) // {phases}) AS q, w FROM {n}_ph, {n}_long WHERE (e + phase) % {phases} = 0),
  {n}_tap AS MATERIALIZED (SELECT phase, o.q + l.e AS q, sum(o.w * l.w) AS w FROM {n}_one o, {n}_low l GROUP BY ALL)""")
    # correction: lines through the reciprocal response, transformed back
    parts.append(f"""{n}_bin AS (SELECT j, {f} / sqrt(pow(sum(w * cos(q * a)), 2) + pow(sum(w * sin(q * a)), 2)) AS b
    FROM (SELECT j, pi() * {cutoff} / {f} * j / 64::DOUBLE AS a FROM (SELECT unnest(range(65)) AS j)), {n}_tap WHERE phase = 0 GROUP BY j),
  {n}_seg AS (SELECT j / 64::DOUBLE AS x1, (j + 1) / 64::DOUBLE AS x2, b AS y1, lead(b) OVER (ORDER BY j) AS y2 FROM {n}_bin),
  {n}_int AS (SELECT e, sum(CASE WHEN e = 0 THEN (x2 - x1) * (y1 + y2) / 2
      ELSE (y2 * sin(pi() * e * x2) - y1 * sin(pi() * e * x1)) / (pi() * e) + (y2 - y1) / (x2 - x1) * (cos(pi() * e * x2) - cos(pi() * e * x1)) / pow(pi() * e, 2) END) * CASE WHEN e = 0 THEN 1 ELSE {window("abs(e)", f"({p['corr'][1]!r}::DOUBLE / 2)", p["corr"][0])} END AS w
    FROM {n}_seg, (SELECT unnest(range({1 - math.ceil(p["corr"][1] / 2)}, {math.ceil(p["corr"][1] / 2)})) AS e) WHERE y2 IS NOT NULL GROUP BY e),
  {n}_unit AS (SELECT e, w / (SELECT sum(w) FROM {n}_int) AS w FROM {n}_int), {trim(f"{n}_corr", f"{n}_unit", "1")}""")
    place = f"((whole + q) // {f})" if f == 2 else "(whole + q)"
    even = "WHERE (whole + q) % 2 = 0" if f == 2 else ""
    parts.append(f"{n}_row AS MATERIALIZED (SELECT t, {place} AS p, sum(w) AS w FROM {n}_at JOIN {n}_tap USING (phase) {even} GROUP BY ALL)")
    if first:
        end = f"SELECT t, least(greatest(least(greatest(p, -3), {size + 2}) + e, 0), {size - 1})::INT AS s, sum(r.w * c.w) AS k FROM {n}_row r, {n}_corr c GROUP BY ALL"
    else:
        end = f"SELECT o.t, least(greatest(p, 0), {size - 1})::INT AS s, sum(r.w * c.w) AS k FROM (SELECT unnest(range({wanted})) AS t) o, {n}_corr c JOIN {n}_row r ON r.t = least(greatest(o.t + c.e, 0), {wanted - 1}) GROUP BY ALL"
    return ",\n".join([*parts, f"{n} AS MATERIALIZED ({end})"])


def _resize_sql(w: int, h: int, weights_sql, half: str = "0.5", more: str = "") -> str:
    return f"""+{weights_sql("wx", 16, w)}, {weights_sql("wy", 16, h)}, ax AS (SELECT image_id, y, t AS x, {', '.join(f'sum({c} * k) AS {c}' for c in 'rgba')} FROM px JOIN wx ON x = s GROUP BY ALL)
      SELECT image_id, x::INT AS x, t::INT AS y, {', '.join(f'least(255, greatest(0, floor(round(sum({c} * k), 6) + {half})))::INT AS {c}' for c in 'rgba')}{more} FROM ax JOIN wy ON y = s GROUP BY image_id, x, t"""


@query(_resize_sql(7, 24, _bilinear_sql, "0"))
def geo3_bilinear_resize(spark, sf_dir):
    return stencils.resize(events_raster(spark, sf_dir), 7, 24, "bilinear")


@query(_resize_sql(7, 24, _lanczos_sql))
def geo4_lanczos_resize(spark, sf_dir):
    return stencils.resize(events_raster(spark, sf_dir), 7, 24, "lanczos")


@query(_resize_sql(7, 24, _designed_sql))
def geo5_geo6_designed_resize(spark, sf_dir):
    """Across reduced to less than a half, down enlarged: two of the three chains."""
    return resample.designed_resize(events_raster(spark, sf_dir), 7, 24)


def _presets_sql() -> str:
    """All presets, one after the other, reduced to more than a half."""
    parts = []
    for name in resample.PRESETS:
        sql = _resize_sql(11, 13, lambda n, size, wanted, name=name: _designed_sql(f"{n}_{name}", size, wanted, name), more=f", '{name}' AS preset").removeprefix("+")
        parts.append(f"SELECT * FROM (WITH {sql.replace('JOIN wx ', f'JOIN wx_{name} ').replace('JOIN wy ', f'JOIN wy_{name} ')})")
    return f"WITH {EVENTS_SQL} " + " UNION ALL ".join(parts)


@query(_presets_sql())
def geo7_geo8_presets(spark, sf_dir):
    return resample.designed_resizes(events_raster(spark, sf_dir), 11, 13, list(resample.PRESETS))


DISPATCH = {"point": (9, 9), "bilinear": (9, 9), "lanczos": (9, 9), "designed": (9, 9)}


@query(f"+{_bilinear_sql('bl', 16, 9)}, {_lanczos_sql('lz', 16, 9)}, {_designed_sql('av', 16, 9)}, ws AS (SELECT 'bilinear' AS method, 0.0::DOUBLE AS half, * FROM bl UNION ALL SELECT 'lanczos', 0.5, * FROM lz UNION ALL SELECT 'designed', 0.5, * FROM av), "
       f"ax AS (SELECT method, image_id, y, t AS x, {', '.join(f'sum({c} * k) AS {c}' for c in 'rgba')} FROM px JOIN ws ON x = s GROUP BY ALL) "
       f"SELECT method, image_id, x::INT AS x, t::INT AS y, {', '.join(f'least(255, greatest(0, floor(round(sum({c} * k), 6) + half)))::INT AS {c}' for c in 'rgba')} FROM ax JOIN ws USING (method) WHERE y = s GROUP BY method, half, image_id, x, t "
       f"UNION ALL SELECT 'point', image_id, gx, gy, r, g, b, a FROM (SELECT DISTINCT image_id, gx::INT AS gx, gy::INT AS gy FROM px, (SELECT unnest(range(0, 9)) AS gx), (SELECT unnest(range(0, 9)) AS gy)) JOIN px USING (image_id) WHERE px.x = gx * 16 // 9 AND px.y = gy * 16 // 9 "
       f"UNION ALL SELECT 'crop', image_id, x - 7, y, r, g, b, a FROM px WHERE x >= 7 AND y < 9")
def geo11_dispatch(spark, sf_dir):
    """The scale dialog's four methods, and a crop to the upper right."""
    p = events_raster(spark, sf_dir)
    out = resample.repositioned(p, 9, 9, 2).withColumn("method", F.lit("crop"))
    for method, (w, h) in DISPATCH.items():
        out = out.unionByName(resample.resized(p, w, h, method).withColumn("method", F.lit(method)))
    return out


def _shared_sql(images: int, most: int) -> str:
    """Sets of `images`; an image in four is dark and of few colours, so that first images lie on both sides of the cap."""
    dark = {c: f"CASE WHEN image_id % {4 * images} = 0 AND a > 0 THEN {c} // 32 ELSE {c} END" for c in "rgb"}
    counts = ", ".join(f"count(DISTINCT CASE WHEN a = 0 THEN 0 ELSE {_posterized(b, 'r')}::BIGINT + {_posterized(b, 'g')} * 256 + {_posterized(b, 'b')} * 65536 + {_posterized(b, 'a')}::BIGINT * 16777216 END) AS n{b}" for b in range(5))
    ladder = " ".join(f"WHEN n{b} <= {most} THEN {b}" for b in range(5))
    keys = lambda c: "CASE WHEN a = 0 THEN 0 " + " ".join(f"WHEN bits = {b} THEN {_posterized(b, c)}" for b in range(5)) + " END"
    return f"""+d AS (SELECT image_id // {images} AS set_id, image_id % {images} AS place, {", ".join(f"{e} AS {c}" for c, e in dark.items())}, a FROM px),
  f AS (SELECT set_id, {counts} FROM d WHERE place = 0 GROUP BY set_id), b AS (SELECT set_id, CASE {ladder} ELSE 4 END AS bits FROM f),
  k AS (SELECT set_id, bits, {", ".join(f"{keys(c)} AS {c}" for c in "rgba")}, CASE WHEN a = 0 THEN 2000 ELSE 255 END AS w FROM d JOIN b USING (set_id))
  SELECT set_id, bits, r, g, b, a, sum(w)::BIGINT AS weight FROM k GROUP BY ALL"""


@query(_shared_sql(3, 120))
def hist4_capped_by_the_first(spark, sf_dir):
    dark = (C("image_id") % 12 == 0) & (C("a") > 0)
    p = events_raster(spark, sf_dir).withColumns({c: F.when(dark, F.expr(f"{c} div 32").cast("int")).otherwise(C(c)) for c in "rgb"})
    return colours.shared_histogram(p.withColumns({"set_id": F.expr("image_id div 3"), "place": C("image_id") % 3}), 120)


def _searched(spark, sf_dir):
    """Flattened pixels and the palettes that the search finds for them."""
    p = documents.flattened(events_raster(spark, sf_dir))
    return p, written(search.palettes(documents.perceptual_histogram(p, search.Options())), "palettes")


def _palettes(spark, sf_dir):
    p, found = _searched(spark, sf_dir)
    return p, dither.rounded(found, 4)


@query()
def qnt1_qnt11_qnt16_document(spark, sf_dir):
    """From the raster to indices, palette, tray and recount: an image in three without dithering, two slots locked in every second one."""
    p = events_raster(spark, sf_dir)
    images = p.select("image_id").distinct()
    tray = documents.grey_tray(p).withColumn("locked", C("slot").isin(3, 7) & (C("image_id") % 2 == 0))
    doc = documents.Document(p, tray)
    before = doc.colours().withColumnRenamed("colours", "before")
    options = images.select("image_id", F.lit(1).alias("speed"), F.lit(4).alias("posterize"), F.when(C("image_id") % 3 == 0, 0).otherwise(75).alias("dither"))
    target = doc.quantize(options)
    sums = target.indexed.groupBy("image_id").agg(F.sum(C("idx") * (C("x") + 16 * C("y") + 1)).alias("index_sum"))
    entries = target.palette.groupBy("image_id").agg(F.count("*").alias("entries"), F.count_if("fixed").alias("locked"))
    code = F.concat(*[F.lpad(F.hex(C(c)), 2, "0") for c in "rgb"])
    shown = doc.tray.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", code.alias("c")))), lambda s: s["c"]), " ").alias("tray"))
    after = doc.keep().withColumnRenamed("colours", "after")
    return before.join(after, "image_id").join(entries, "image_id").join(sums, "image_id").join(shown, "image_id")


@query()
def qnt2_qnt6_quantize(spark, sf_dir):
    return _palettes(spark, sf_dir)[1].select("image_id", "idx", *"rgb", F.round("popularity", 3).alias("popularity"))


@query()
def qnt4_feedback_search(spark, sf_dir):
    """Errors of the first cut, of the best trial (never greater) and after the last k-means steps."""
    found = _searched(spark, sf_dir)[1]
    return found.groupBy("image_id").agg(F.count("*").alias("colours"), *[F.round(F.first(e), 8).alias(e) for e in ("cut_error", "search_error", "error")])


def _cut_sql(size: int, target: float, limit: float) -> str:
    """A median cut of all images at once, one round of boxes after the other."""
    steps = [f"""{FHIST}, n AS (SELECT image_id, count(*) AS n FROM px GROUP BY image_id),
  b1 AS MATERIALIZED (SELECT h.image_id, r, g, b, a, fa, fr, fg, fb, least(weight / 128.0::DOUBLE, n * 0.1::DOUBLE) AS p, 0 AS box FROM fhist h JOIN n USING (image_id))"""]
    shares, small = {"a": 4 / 16, "r": 7 / 16, "g": 9 / 16, "b": 5 / 16}, {"a": 2 / 256, "r": 1 / 256, "g": 1 / 256, "b": 1 / 256}

    def boxes(i: int) -> str:
        spread = ", ".join(f"{s!r}::DOUBLE * sum(p * CASE WHEN pow(f{c} - m_f{c}, 2) < {small[c] ** 2!r}::DOUBLE THEN pow(f{c} - m_f{c}, 2) / 4 ELSE pow(f{c} - m_f{c}, 2) END) AS v{c}" for c, s in shares.items())
        return f"""m{i} AS MATERIALIZED (SELECT image_id, box, sum(p) AS w, count(*) AS n, {", ".join(f"sum(p * f{c}) / sum(p) AS m_f{c}" for c in shares)} FROM b{i} GROUP BY ALL),
  v{i} AS MATERIALIZED (SELECT image_id, box, w, n, max({_distance_sql("m_", "")}) AS worst, sum(p * {_distance_sql("m_", "")}) AS error, {", ".join(f"any_value(m_f{c}) AS m_f{c}" for c in shares)}, {spread}
    FROM b{i} JOIN m{i} USING (image_id, box) GROUP BY ALL)"""

    for i in range(1, size):
        steps.append(boxes(i))
        now = limit * (1 + 16 * i / size)
        goal = f"HAVING sum(error) > {target!r}::DOUBLE * sum(w)" if i > 1 else ""
        steps.append(f"""s{i} AS MATERIALIZED (SELECT image_id, box, n, list_transform(list_sort([{", ".join(f"{{'v': -v{c}, 'k': {k}}}" for k, c in enumerate(shares, 1))}]), lambda x: x.k) AS ch
    FROM v{i} JOIN (SELECT image_id FROM v{i} GROUP BY image_id {goal}) USING (image_id)
    WHERE n > 1 AND greatest(va, vr, vg, vb) > 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w * greatest(va, vr, vg, vb) * greatest(1, worst / {now!r}::DOUBLE) DESC, box) = 1)""")
        steps.append(f"""k{i} AS (SELECT b.*, s.n, (floor([fa, fr, fg, fb][ch[1]] * 65535)::BIGINT << 16) | floor(([fa, fr, fg, fb][ch[3]] + [fa, fr, fg, fb][ch[2]] / 2 + [fa, fr, fg, fb][ch[4]] / 4) * 65535)::BIGINT AS key
    FROM b{i} b JOIN s{i} s USING (image_id, box)),
  o{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY key DESC, a, b, g, r) AS rn FROM k{i}),
  d{i} AS (SELECT image_id, {", ".join(f"sum(p * f{c}) / sum(p) AS q_f{c}" for c in shares)} FROM o{i} WHERE rn BETWEEN (n - 1) // 2 + 1 AND n // 2 + 1 GROUP BY image_id),
  u{i} AS (SELECT image_id, rn, n, r, g, b, a, box, floor(sqrt({_distance_sql("q_", "")}) * (sqrt(1 + p) - 1) * 1e9::DOUBLE + 0.5)::BIGINT AS x FROM o{i} JOIN d{i} USING (image_id)),
  t{i} AS (SELECT *, sum(x) OVER (PARTITION BY image_id ORDER BY rn) AS run, sum(x) OVER (PARTITION BY image_id) AS total FROM u{i}),
  c{i} AS MATERIALIZED (SELECT *, least(n - 1, (count(*) FILTER (WHERE 2 * run <= total) OVER (PARTITION BY image_id)) + 1) AS cut FROM t{i}),
  b{i + 1} AS MATERIALIZED (SELECT b.* EXCLUDE (box), CASE WHEN c.rn > c.cut THEN {i} ELSE b.box END AS box FROM b{i} b LEFT JOIN c{i} c USING (image_id, box, r, g, b, a))""")
    steps.append(boxes(size))
    return f"+{', '.join(steps)} SELECT image_id, box::INT AS box, n AS colours, round(w, 6) AS popularity, " + ", ".join(f"round(m_f{c}, 6) AS f{c}" for c in shares) + f", round(error, 5) AS error FROM v{size}"


CUT = {"size": 16, "target": 0.04, "limit": 45 / 65536 * 1.2}


@query(_cut_sql(**CUT))
def qnt5_agg10_median_cut(spark, sf_dir):
    p = events_raster(spark, sf_dir)
    hist = colours.normalised(colours.histogram(p, 4), p.groupBy("image_id").agg(F.count("*").alias("n")))
    found = search.cut_boxes(hist, **CUT)
    return found.withColumns({"popularity": F.round("popularity", 6), "error": F.round("error", 5)} | {c: F.round(c, 6) for c in colours.FLOATS})


@query()
def qnt8_plain_remap(spark, sf_dir):
    p, found = _searched(spark, sf_dir)
    return dither.plain_remap(p, found, 4)[0].select("image_id", "x", "y", "idx")


def _rounded_sql() -> str:
    """QNT7 and QNT8: entries of a k-means step, rounded, folded back, and moved by the pixels that map to them."""
    back = lambda c: f"(CASE WHEN fa < 1 / 256.0::DOUBLE THEN 0 ELSE least(255, floor(pow(greatest(f{c} / fa, 0), {px.DISPLAY_GAMMA / px.INTERNAL_GAMMA!r}::DOUBLE) * 256))::INT END)"
    alpha = "(CASE WHEN fa < 1 / 256.0::DOUBLE THEN 0 ELSE least(255, floor(fa * 256))::INT END)"
    means = ", ".join(f"CASE WHEN w > 0 THEN s{c} / w ELSE t.f{c} END::DOUBLE AS f{c}" for c in "argb")
    return f"""+{STEP}, km AS (SELECT image_id, t.idx, {means} FROM ftop t LEFT JOIN ks USING (image_id, idx)),
  kb AS (SELECT image_id, idx, {", ".join(f"{_posterized(4, back(c))} AS {c}" for c in "rgb")}, {_posterized(4, alpha)} AS a FROM km), {_floats_sql("kb")}, {_floats_sql("px")},
  kn AS MATERIALIZED (SELECT p.*, (SELECT min({{'d': {_ranked_sql("p.", "t.")}, 'i': t.idx}}) FROM fkb t WHERE t.image_id = p.image_id) AS q FROM fpx p),
  ku AS (SELECT image_id, (q).i AS idx, count(*) AS pixels, {", ".join(f"avg(f{c}) AS u{c}" for c in "argb")} FROM kn GROUP BY ALL)
  SELECT image_id, idx, {", ".join(f"CASE WHEN a = 0 THEN {palettes.CLEAR[c]} ELSE {c} END AS {c}" for c in "rgba")}, coalesce(pixels, 0) AS pixels, {", ".join(f"round(coalesce(u{c}, f{c}), 5)::DOUBLE AS f{c}" for c in "argb")} FROM fkb LEFT JOIN ku USING (image_id, idx)"""


@query(_rounded_sql())
def qnt7_qnt8_rounded_and_moved(spark, sf_dir):
    p, top = _tops(spark, sf_dir)
    entries = colours.kmeans_step(colours.histogram(p, 4), top).select("image_id", "idx", *colours.FLOATS, F.lit(0.0).alias("popularity"), F.lit(False).alias("fixed"))
    indices, shown, after = dither.plain_remap(p, entries, 4)
    pixels = indices.groupBy("image_id", "idx").agg(F.count("*").alias("pixels"))
    both = shown.select("image_id", "idx", *"rgba").join(pixels, ["image_id", "idx"], "left").join(after.select("image_id", "idx", *colours.FLOATS), ["image_id", "idx"])
    return both.select("image_id", "idx", *"rgba", F.coalesce("pixels", F.lit(0)).alias("pixels"), *[F.round(c, 5).alias(c) for c in colours.FLOATS])


@query()
def win9_qnt9_serpentine_dither(spark, sf_dir):
    return dither.dithered_remap(*_searched(spark, sf_dir), level=0.75, bits=4)[0]


@query()
def win10_raster_dither(spark, sf_dir):
    """Resampled values, rounded with what is lost carried on."""
    return resample.designed_resize(events_raster(spark, sf_dir), 11, 24, dither=True)


def _dither_map_sql() -> str:
    edges = _contrast_sql().removeprefix("+")
    head, mark, tail = edges.partition("SELECT image_id, x, y, least")
    return f"""+{TOP}, {NEAR}, {head.rstrip()}, ed AS ({mark}{tail}),
  j AS MATERIALIZED (SELECT n.image_id, n.x, n.y, idx, edge, lag(idx) OVER c AS above, lead(idx) OVER c AS below, lag(idx) OVER r AS lft FROM near n JOIN ed USING (image_id, x, y)
    WINDOW r AS (PARTITION BY image_id, n.y ORDER BY n.x), c AS (PARTITION BY image_id, n.x ORDER BY n.y)),
  s AS MATERIALIZED (SELECT *, coalesce(sum(CASE WHEN x > 0 AND (x = 15 OR lft <> idx) THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM j),
  g AS (SELECT image_id, y, run, max(x) AS stop, arg_min(coalesce(lft, idx), x) AS colour FROM s GROUP BY ALL),
  w AS (SELECT image_id, y, run, sum(10 + CASE WHEN above = colour THEN 15 ELSE 0 END + CASE WHEN below = colour THEN 15 ELSE 0 END) AS n FROM s JOIN g USING (image_id, y, run) WHERE x < stop GROUP BY ALL)
  SELECT image_id, x, y, floor((edge + 128) * (255 / 383.0::DOUBLE) * (1 - 20.0::DOUBLE / (coalesce(n, 0) + 20)))::INT AS dither FROM s LEFT JOIN w USING (image_id, y, run)"""


@query(_dither_map_sql())
def win6_dither_map(spark, sf_dir):
    p, top = _tops(spark, sf_dir)
    return dither.dither_map(colours.remapped(p, top).select("image_id", "x", "y", "idx"), stencils.contrast(p))


@query(f"+{TOP}, {NEAR}, rw AS (SELECT image_id, y, string_agg(substr('0123456789abcdef', idx + 1, 1), '' ORDER BY x) AS s FROM near GROUP BY image_id, y), "
       "wide AS (SELECT image_id, y, s || repeat(right(s, 1), 304) AS s FROM rw), "
       "body AS (SELECT image_id, string_agg(s, '' ORDER BY y) || repeat(arg_max(s, y), 184) AS s FROM wide GROUP BY image_id), "
       "words AS (SELECT image_id, string_agg(substr('0123456789abcdef', g // 16 + 1, 1) || substr('0123456789abcdef', b // 16 + 1, 1) || '0' || substr('0123456789abcdef', r // 16 + 1, 1), '' ORDER BY idx) AS w FROM top GROUP BY image_id) "
       "SELECT image_id, s || repeat('0', 512) || rpad(w, 64, '0') || repeat('0', 960) AS content FROM body JOIN words USING (image_id)")
def snk1_c1_raster(spark, sf_dir):
    p, top = _tops(spark, sf_dir)
    return files.c1_rasters(colours.remapped(p, top), top).select("image_id", F.lower(F.hex("content")).alias("content"))


@query("SELECT image_id, (['png', 'bmp', 'tga', 'gif'])[image_id % 4 + 1] AS kind, x, y, r, g, b, CASE WHEN image_id % 4 = 3 THEN 255 ELSE a END AS a FROM px")
def src1_src3_snk2_formats(spark, sf_dir):
    """Rasters as files in memory, a format for each image in turn, sniffed and decoded again."""
    p = events_raster(spark, sf_dir)
    parts = []
    for i, kind in enumerate(("png", "bmp", "tga", "gif")):
        mine = p.where(C("image_id") % 4 == i)
        mine = mine.withColumn("a", F.lit(255)) if kind == "gif" else mine
        parts.append(images.encoded(mine, kind).select(F.concat_ws("/", "image_id", F.lit(kind)).alias("path"), "content"))
    found, _ = images.decoded(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    at = F.split("path", "/")
    return found.select(at[0].cast("long").alias("image_id"), at[1].alias("kind"), "x", "y", *"rgba")


@query("WITH d AS (SELECT page_id, html FROM pages) SELECT CAST(page_id AS VARCHAR) AS path, 'no known image format' AS error FROM d")
def src1_rejected(spark, sf_dir):
    """What is no image is a rejected row, and the rest goes on."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(C("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return images.decoded(pages)[1]


@query("SELECT image_id, x, y, r, g, b, a FROM px UNION ALL SELECT image_id + 1000000, x, y, r, g, b, a FROM px")
def src9_buffers(spark, sf_dir):
    """Rasters as buffers, contiguous and by row pointers, and as pixels again."""
    p = events_raster(spark, sf_dir)
    cells = F.transform(F.sort_array(F.collect_list(F.struct("x", *"rgba"))), lambda s: F.concat(*[F.lpad(F.hex(s[c]), 2, "0") for c in "rgba"]))
    rows = p.groupBy("image_id", "y").agg(F.unhex(F.array_join(cells, "")).alias("content"))
    whole = rows.groupBy("image_id").agg(F.lit(16).alias("width"), F.count("*").cast("int").alias("height"), F.sort_array(F.collect_list(F.struct("y", "content"))).alias("rows"))
    whole = whole.withColumn("content", F.unhex(F.array_join(F.transform("rows", lambda s: F.hex(s["content"])), "")))
    return images.pixels_of_buffers(whole).unionByName(images.pixels_of_rows(rows.withColumn("image_id", C("image_id") + 1000000)))


@query(f"+{TOP}, {NEAR} SELECT image_id, 16 AS width, 16 AS height, string_agg(printf('%02x', idx), '' ORDER BY y, x) AS content FROM near GROUP BY image_id")
def snk6_index_buffers(spark, sf_dir):
    p, top = _tops(spark, sf_dir)
    found = images.index_buffers(colours.remapped(p, top).select("image_id", "x", "y", "idx"), 256)
    return found.select("image_id", "width", "height", F.lower(F.hex("content")).alias("content"))


PATHS = "WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages), w AS (SELECT page_id, p, regexp_extract(p, '([^/\\\\]*)$', 1) AS whole FROM u), e AS (SELECT *, regexp_extract(whole, '\\.([^.]*)$', 1) AS ext FROM w)"


def _paths(spark, sf_dir):
    u = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("p"))
    return u.select("page_id", "p", *files.parsed(C("p")))


@query(PATHS + " SELECT page_id, regexp_extract(p, '^(.*)[/\\\\][^/\\\\]*$', 1) AS folder, CASE WHEN ext = '' THEN whole ELSE replace(whole, '.' || ext, '') END AS name, ext FROM e")
def src8_path_parts(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", "folder", "name", "ext")


@query("WITH d AS (SELECT page_id, url FROM pages) SELECT page_id, CASE WHEN length(url) > 4 THEN substr(url, 1, length(url) - 4) ELSE url END AS name FROM d")
def snk3_save_name(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", files.save_name(C("url")).alias("name"))


@query("WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id FROM d WHERE (contains(t, 'the') OR contains(t, 'der')) AND NOT contains(t, 'license')")
def flt1_text_filter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return docs.where(lists.text_filter(C("t"), "the,der,-license")).select("doc_id")


LISTING = """WITH u AS (SELECT regexp_replace(url, '[?#].*$', '') AS p FROM pages), c AS (SELECT list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.') AS p FROM u),
  s AS (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM c WHERE len(p) > 0),
  e AS (SELECT DISTINCT array_to_string(p[1:n - 1], '/') AS folder, p[n] AS name, CASE WHEN n = len(p) THEN 'f' ELSE 'd' END AS type FROM s),
  l AS (SELECT *, CASE WHEN type = 'f' AND contains(name, '.') THEN '.' || string_split(name, '.')[-1] ELSE '' END AS ext, (row_number() OVER (PARTITION BY folder ORDER BY type, name) - 1)::INT AS place FROM e)"""


def _listing(spark, sf_dir):
    return files.listing(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_replace("url", "[?#].*$", "").alias("path")))


@query(LISTING + " SELECT folder, name, type, ext, place FROM l")
def src8_listing(spark, sf_dir):
    return _listing(spark, sf_dir).select("folder", "name", "type", "ext", "place")


@query(LISTING + " SELECT folder, name, (row_number() OVER (PARTITION BY folder ORDER BY lower(name) DESC, name) - 1)::INT AS place FROM l WHERE contains(name, '1')")
def src6_src7_scan(spark, sf_dir):
    """A scan with a filter and an order of its own."""
    return files.scanned(_listing(spark, sf_dir), F.contains("name", F.lit("1")), [F.desc(F.lower("name")), C("name")]).select("folder", "name", "place")


@query("WITH p AS (SELECT page_id, url AS name, CASE page_id % 4 WHEN 0 THEN url || '.PAL' WHEN 1 THEN url || '.pax' WHEN 2 THEN '.pal' ELSE url END AS path FROM pages) SELECT page_id, length(path) > 4 AS loaded, CASE WHEN length(path) > 4 THEN len(list_filter(range(1, 5), lambda i: lower(right(path, 4))[i] <> '.pal'[i])) ELSE 1 END::INT AS failures FROM p")
def src5_palette_choices(spark, sf_dir):
    k = C("page_id") % 4
    path = F.when(k == 0, F.concat("url", F.lit(".PAL"))).when(k == 1, F.concat("url", F.lit(".pax"))).when(k == 2, ".pal").otherwise(C("url"))
    found = files.palette_choices(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", C("url").alias("name"), path.alias("path")))
    return found.select("page_id", "loaded", F.size("log").alias("failures"))


@query(LISTING + " SELECT folder, name, type FROM l WHERE (type <> 'f' OR ext = '.html') AND contains(name, 'e')")
def flt2_file_filter(spark, sf_dir):
    """Files of one extension and any folder, by a part of the name."""
    rows = _listing(spark, sf_dir)
    return rows.where(lists.file_filter(C("type"), C("ext"), C("name"), ".html", "e")).select("folder", "name", "type")


@query("WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) SELECT doc_id, unnest(range(0, len(l)))::INT AS line_no, unnest(l) AS line FROM d")
def snk5_log_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(lists.log_lines(F.coalesce("text", F.lit("")))).alias("line_no", "line"))


@query("WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(range(0, len(l)))::INT AS line_no, unnest(l) AS line FROM d) SELECT * FROM e WHERE line_no BETWEEN 2 AND 4")
def lim2_visible_lines(spark, sf_dir):
    return QUERIES["snk5_log_lines"](spark, sf_dir).where("line_no BETWEEN 2 AND 4")


@query("WITH o AS (SELECT n_regionkey AS list, n_name AS item, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS o FROM nation) SELECT list, item, CASE WHEN o = 3 THEN 0 WHEN o < 3 THEN o + 1 ELSE o END AS ordinal FROM o")
def ord1_move_to_top(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(C("n_regionkey").alias("list"), C("n_name").alias("item"), "n_nationkey")
    return lists.moved(lists.numbered(nation, "list", ["n_nationkey"]), 3, 0).select("list", "item", "ordinal")


@query("WITH o AS (SELECT n_regionkey AS list, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY ALL) SELECT list, (coalesce(list_position(l, 'nation_7'), 0) - 1)::INT AS at FROM o")
def lk1_index_of(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    per = nation.groupBy(C("n_regionkey").alias("list")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("l"))
    return per.select("list", (F.array_position("l", "nation_7") - 1).cast("int").alias("at"))


@query("SELECT image_id, CASE x % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' END AS colour, count(*) AS n FROM px GROUP BY ALL")
def lk2_map_lookup(spark, sf_dir):
    known = F.create_map(*[F.lit(v) for v in (0, "red", 1, "green", 2, "blue")])
    return events_raster(spark, sf_dir).select("image_id", F.try_element_at(known, C("x") % 4).alias("colour")).groupBy("image_id", "colour").agg(F.count("*").alias("n"))


@query("SELECT image_id, x, y, CASE WHEN a >= 128 THEN least(255, floor((al + (a / 255.0::DOUBLE - al) * (1 - al) / (o - al)) * 256)) ELSE a END::INT AS a FROM px, (SELECT 195 / 255.0::DOUBLE AS o, 195 / 255.0::DOUBLE * 169 / 256 AS al)")
def px14_raised_alpha(spark, sf_dir):
    return events_raster(spark, sf_dir).select("image_id", "x", "y", palettes.raised_alpha(C("a"), 195).alias("a"))


@query("WITH w AS (SELECT page_id, length(url) AS w FROM pages) SELECT page_id, w, greatest(1, floor(w / 1.6::DOUBLE + 0.5))::INT AS h, greatest(1, w // 2) AS half, 2 * w AS twice FROM w")
def px22_kept_aspect(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.char_length("url").cast("long").alias("w"))
    return pages.select("page_id", "w", palettes.kept_aspect(C("w"), 1.6).alias("h"), F.greatest(F.lit(1), F.expr("w div 2")).alias("half"), (2 * C("w")).alias("twice"))


@query("WITH s AS (SELECT o_orderkey, o_orderkey % 300000 * 97 - 5 AS w, o_custkey * 30000 AS h FROM orders) SELECT o_orderkey, w > 0 AND h > 0 AND w <= (2147483647 // 4) // greatest(h, 1) AND w <= 2147483647 // 16 // 16 AND h <= 2147483647 // 8 AS allowed FROM s")
def src11_size_allowed(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", palettes.size_allowed(C("o_orderkey") % 300000 * 97 - 5, C("o_custkey") * 30000).alias("allowed"))


@query("+e AS (SELECT r % 8 AS r, g % 8 AS g, b % 8 AS b, CASE WHEN x = 3 THEN 0 ELSE a END AS a, count(*) AS n FROM px GROUP BY ALL) SELECT CASE WHEN a = 0 THEN 0 ELSE r END AS r, CASE WHEN a = 0 THEN 0 ELSE g END AS g, CASE WHEN a = 0 THEN 0 ELSE b END AS b, a, sum(n)::BIGINT AS weight FROM e GROUP BY ALL")
def src10_external_histogram(spark, sf_dir):
    p = events_raster(spark, sf_dir).select(*[(C(c) % 8).alias(c) for c in "rgb"], F.when(C("x") == 3, 0).otherwise(C("a")).alias("a"))
    return palettes.from_entries(p.groupBy(*"rgba").agg(F.count("*").alias("count")))


@query("WITH p AS (SELECT page_id, CASE WHEN page_id % 5 < 3 THEN (['.png', '.GIF', '.gif'])[page_id % 5 + 1] ELSE '' END AS ext FROM pages) SELECT page_id, ext, (CASE ext WHEN '.png' THEN 0 WHEN '.gif' THEN 1 ELSE -1 END)::INT AS at FROM p")
def flt3_known_extension(spark, sf_dir):
    ext = F.coalesce(F.get(F.array(F.lit(".png"), F.lit(".GIF"), F.lit(".gif")), (C("page_id") % 5).cast("int")), F.lit(""))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ext.alias("ext")).withColumn("at", lists.known_extension(C("ext"), ".png\0.gif\0"))


@query(f"+{TOP} SELECT image_id, idx, r, g, b FROM top WHERE idx % 3 = 0")
def flt7_locked_colours(spark, sf_dir):
    return palettes.locked_colours(_tops(spark, sf_dir)[1].withColumn("locked", C("idx") % 3 == 0)).select("image_id", "idx", *"rgb")


@query("WITH p AS (SELECT page_id, 'folder' AS folder, url AS name FROM pages WHERE page_id % 3 = 0) SELECT page_id, folder || '/' || name AS path, row_number() OVER (ORDER BY name, page_id) - 1 AS place FROM p")
def lk3_selected_paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 3 = 0").withColumn("folder", F.lit("folder"))
    return lists.selected_paths(p, "folder", "url", "page_id").select("page_id", "path", "place")


@query(_cut_sql(**CUT).partition(" SELECT image_id, box::INT AS box")[0] + f" SELECT image_id, sum(error) <= 0.036 * sum(w) AS enough FROM v{CUT['size']} GROUP BY image_id")
def agg6_boxes_good_enough(spark, sf_dir):
    """The boxes of a median cut."""
    p = events_raster(spark, sf_dir)
    hist = colours.normalised(colours.histogram(p, 4), p.groupBy("image_id").agg(F.count("*").alias("n")))
    return palettes.boxes_good_enough(search.cut_boxes(hist, **CUT).withColumnRenamed("popularity", "weight"), 0.036)


@query(f"""+{TOP}, {NEAR}, e AS (SELECT image_id, avg(d) / 8 AS mse FROM near GROUP BY image_id),
  q AS (SELECT q, CASE WHEN q = 100 THEN 0 ELSE greatest(0, 0.016 / (0.001 + q) - 0.001) + 2.5 / pow(210.0 + q, 1.2) * (100.1 - q) / 100.0 END::DOUBLE AS most FROM (SELECT unnest(range(1, 101)) AS q))
  SELECT image_id, round(mse * 65536 / 6, 4) AS error, coalesce((SELECT max(q) FROM q WHERE mse <= most + 0.000001), 0)::INT AS quality FROM e""")
def agg11_error_and_quality(spark, sf_dir):
    mse = C("mean_sq_error") / 8  # an eighth, so that qualities differ between images
    found = colours.remap_error(colours.remapped(*_tops(spark, sf_dir)))
    return found.select("image_id", F.round(palettes.standard_mse(mse), 4).alias("error"), palettes.mse_to_quality(mse).alias("quality"))


ROUND = lambda c: f"(CASE WHEN a & 240 = 0 AND idx % 4 <> 0 THEN {palettes.CLEAR[c]} ELSE (({c} & 240) | ({c} >> 4)) END)"


@query(f"+{TOP}, t AS (SELECT image_id, idx, r, g, b, CASE WHEN idx % 2 = 0 THEN 7 ELSE a END AS a FROM top) SELECT image_id, idx, " + ", ".join(f"{ROUND(c)} AS {c}" for c in "rgba") + " FROM t")
def qnt7_rounded_palette(spark, sf_dir):
    top = _tops(spark, sf_dir)[1].withColumns({"a": F.when(C("idx") % 2 == 0, 7).otherwise(C("a")), "fixed": C("idx") % 4 == 0})
    return palettes.rounded_palette(top, 4).select("image_id", "idx", *"rgba")


@query("+h AS (SELECT image_id, " + ", ".join(f"{_posterized(4, c)} AS {c}" for c in "rgba") + ", x * 16 + y AS w FROM px WHERE a > 0) SELECT image_id, r, g, b, a, sum(w)::BIGINT AS weight FROM h GROUP BY ALL UNION ALL SELECT image_id, 0, 0, 0, 0, 2000 * count(*) FROM px WHERE a = 0 GROUP BY ALL")
def qnt12_importance_map(spark, sf_dir):
    return colours.histogram(events_raster(spark, sf_dir).withColumn("importance", C("x") * 16 + C("y")), 4)


@query(f"+{TOP}, s AS (SELECT image_id, idx AS slot, idx % 5 = 0 AS locked, (row_number() OVER (PARTITION BY image_id, idx % 5 = 0 ORDER BY idx) - 1)::INT AS k FROM top) SELECT s.image_id, slot, r, g, b FROM s LEFT JOIN top t ON t.image_id = s.image_id AND t.idx = CASE WHEN locked THEN 12 + k ELSE k END")
def qnt14_refill_tray(spark, sf_dir):
    top = _tops(spark, sf_dir)[1]
    return palettes.refill(top.select("image_id", C("idx").alias("slot"), (C("idx") % 5 == 0).alias("locked")), top.select("image_id", "idx", *"rgb"), 4)


@query(f"+{TOP} SELECT t.image_id, t.idx, " + ", ".join(f"CASE WHEN t.idx IN (2, 5) THEN coalesce(o.{c}, t.{c}) ELSE t.{c} END AS {c}" for c in "rgb") + " FROM top t LEFT JOIN top o ON o.image_id = t.image_id + 1 AND o.idx = t.idx")
def qnt15_dropped_colours(spark, sf_dir):
    top = _tops(spark, sf_dir)[1].select("image_id", "idx", *"rgb")
    return palettes.dropped(top, top.withColumn("image_id", C("image_id") - 1), [2, 5])


@query(f"+{TOP}, v AS (SELECT image_id, r AS vr, g AS vg, b AS vb FROM top WHERE idx = 0), d AS (SELECT image_id, idx, (r-vr)*(r-vr)+(g-vg)*(g-vg)+(b-vb)*(b-vb) AS d FROM top JOIN v USING (image_id)) SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY d, idx) - 1)::INT AS place FROM d")
def srt5_vantage_order(spark, sf_dir):
    return palettes.by_vantage_distance(_tops(spark, sf_dir)[1])


@query("WITH o AS (SELECT n_regionkey AS list, n_name AS item, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS o FROM nation), m AS (SELECT list, 'down' AS move, item, CASE o WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE o END AS ordinal FROM o UNION ALL SELECT list, 'up', item, CASE o WHEN 3 THEN 2 WHEN 2 THEN 3 ELSE o END FROM o UNION ALL SELECT list, 'bottom', item, CASE WHEN o = 1 THEN 4 WHEN o > 1 THEN o - 1 ELSE o END FROM o UNION ALL SELECT list, 'close', item, CASE WHEN o > 2 THEN o - 1 ELSE o END FROM o WHERE o <> 2) SELECT * FROM m")
def ord1_other_moves(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(C("n_regionkey").alias("list"), C("n_name").alias("item"), "n_nationkey")
    items = lists.numbered(nation, "list", ["n_nationkey"])
    moves = {"down": lists.moved(items, 1, 2), "up": lists.moved(items, 3, 2), "bottom": lists.moved(items, 1, 4), "close": lists.closed(items, 2)}
    parts = [df.select("list", F.lit(name).alias("move"), "item", "ordinal") for name, df in moves.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _flagship_sql() -> str:
    flat = "px AS (SELECT image_id, x, y, " + ", ".join(f"{_posterized(4, _flat(c))} AS {c}" for c in "rgb") + ", 255 AS a FROM raw)"
    return f"WITH {EVENTS_SQL.replace('px AS', 'raw AS', 1)}, {flat}, {TOP}, {NEAR}, n AS (SELECT image_id, count(DISTINCT {PACK}) AS colours FROM px GROUP BY ALL) SELECT image_id, colours, round(avg(d), 6) AS mean_sq_error FROM near JOIN n USING (image_id) GROUP BY ALL"


@query(_flagship_sql())
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flatten, posterize, histogram, 16 most frequent colours, remap, error: per image."""
    p = events_raster(spark, sf_dir)
    p = p.select("image_id", "x", "y", *[px.posterize(px.flatten(C(c), C("a")), 4).alias(c) for c in "rgb"], F.lit(255).alias("a"))
    mapped = colours.remapped(p, colours.top_colours(colours.histogram(p), 16))
    return colours.distinct_colours(p).join(colours.remap_error(mapped), "image_id").withColumn("mean_sq_error", F.round("mean_sq_error", 6))
