"""48-byte palettes, C1 rasters, directory listings and paths. Files are read as rows by Spark's binaryFile."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C1_BYTES = 32768


def read_palettes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """SRC4 to SRC6: 16 records of r, g, b per .pal file; short files read as black; alpha is 255; ordered by name when collected so.

    strict keeps files that end in .pal (any case) and have a longer name than that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if strict:
        files = files.where(F.lower("name").endswith(".pal") & (F.length("name") > 4))
    rows = files.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(15))))
    byte = lambda k: F.coalesce(F.conv(F.nullif(F.hex(F.substring("content", 3 * F.col("idx") + (k + 1), F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(0))
    return rows.select("path", "name", "idx", byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"), F.lit(255).alias("a"))


def listing(paths: DataFrame) -> DataFrame:
    """SRC8: folder, name, type (d before f), ext (of files, from the last dot on, with it) and place of what each folder holds. paths: path, of files.

    Folders on the way to a file are entries of those above them; "." and empty names are none. Places are by type, then name. A folder's entries
    are sorted in one task.
    """
    parts = F.filter(F.split("path", "/"), lambda x: (x != "") & (x != "."))
    steps = paths.select(parts.alias("p")).where("size(p) > 0").select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    name, last = F.element_at("p", F.col("n")), F.col("n") == F.size("p")
    entries = steps.select(F.array_join(F.slice("p", F.lit(1), F.col("n") - 1), "/").alias("folder"), name.alias("name"), F.when(last, "f").otherwise("d").alias("type")).distinct()
    ext = F.when((F.col("type") == "f") & F.contains("name", F.lit(".")), F.concat(F.lit("."), F.element_at(F.split("name", "[.]"), -1))).otherwise("")
    return entries.withColumns({"ext": ext, "place": F.row_number().over(Window.partitionBy("folder").orderBy("type", "name")) - 1})


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files below a folder, for `listing`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def scanned(entries: DataFrame, keep: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """SRC6, SRC7: a folder's entries with an optional filter, and places by an optional order (by name in any case, then as it is)."""
    rows = entries.where(keep) if keep is not None else entries
    by = order or [F.lower("name"), F.col("name")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(*by)) - 1)


def palette_choices(selection: DataFrame) -> DataFrame:
    """SRC5: name, path, loaded and log of selected files: each of the last four characters that differs from ".pal" is a line, yet only paths no longer than that stay out."""
    tail = F.lower(F.substring("path", F.char_length("path") - 3, F.lit(4)))
    wrong = F.when(F.char_length("path") > 4, F.size(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: F.substring(tail, i, F.lit(1)) != F.substring(F.lit(".pal"), i, F.lit(1))))).otherwise(1)
    return selection.select("*", (F.char_length("path") > 4).alias("loaded"), F.array_repeat(F.concat(F.lit("FAILED "), F.col("name")), wrong).alias("log"))


def parsed(path: Column) -> list[Column]:
    """Folder, name without any ".ext", and extension of a path."""
    whole = F.regexp_extract(path, r"([^/\\]*)$", 1)
    ext = F.regexp_extract(whole, r"\.([^.]*)$", 1)
    name = F.when(ext == "", whole).otherwise(F.replace(whole, F.concat(F.lit("."), ext), F.lit("")))
    return [F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1).alias("folder"), name.alias("name"), ext.alias("ext")]


def save_name(name: Column) -> Column:
    """SNK3: without its last four characters, if it has more."""
    return F.when(F.length(name) > 4, F.substring(name, F.lit(1), F.length(name) - 4)).otherwise(name)


def encode_c1(idx: np.ndarray, palette: np.ndarray) -> bytes:
    """SNK1: 200 rows of 160 bytes (left pixel in the high nibble), zeros, 16 little-endian 0x0RGB words at 0x7E00, zeros."""
    h, w = idx.shape
    grid = idx[np.minimum(np.arange(200), h - 1)][:, np.minimum(np.arange(320), w - 1)]
    packed = (grid[:, ::2] << 4 | grid[:, 1::2]).astype(np.uint8)
    words = [(int(r) >> 4) << 8 | (int(g) >> 4) << 4 | int(b) >> 4 for r, g, b in palette[:16]]
    return (packed.tobytes().ljust(32256, b"\0") + struct.pack("<16H", *(words + [0] * (16 - len(words))))).ljust(C1_BYTES, b"\0")


def decode_c1(content: bytes) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A C1 raster's indices and palette, for round trips."""
    if len(content) != C1_BYTES:
        raise ValueError("a C1 raster has 32768 bytes")
    packed = np.frombuffer(content[:32000], np.uint8).reshape(200, 160)
    idx = np.stack([packed >> 4, packed & 15], axis=2).reshape(200, 320)
    return idx, [((v >> 8 & 15) * 17, (v >> 4 & 15) * 17, (v & 15) * 17) for v in struct.unpack("<16H", content[32256:32288])]


def c1_rasters(indexed: DataFrame, palettes: DataFrame) -> DataFrame:
    """SNK1 as rows: image_id, content."""

    def run(image: pd.DataFrame, palette: pd.DataFrame) -> pd.DataFrame:
        if not len(image):
            return pd.DataFrame({"image_id": pd.Series(dtype="int64"), "content": pd.Series(dtype=object)})
        idx = np.zeros((int(image["y"].max()) + 1, int(image["x"].max()) + 1), int)
        idx[image["y"], image["x"]] = image["idx"]
        return pd.DataFrame({"image_id": [int(image["image_id"].iloc[0])], "content": [encode_c1(idx, palette.sort_values("idx")[["r", "g", "b"]].to_numpy())]})

    own = palettes.select(F.col("image_id").alias("of_image"), *[F.col(c).alias(c) for c in ("idx", *"rgb")])  # columns of its own, as both may stem from one table
    return indexed.select("image_id", "x", "y", "idx").groupBy("image_id").cogroup(own.groupBy("of_image")).applyInPandas(run, "image_id long, content binary")
