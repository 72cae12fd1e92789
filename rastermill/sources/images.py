"""Images as rows of pixels: files of any known format, buffers in memory, and a data source that reads bands and writes files in two steps.

`read_images` takes files as Spark reads them (binaryFile), so from any store that Spark knows, a file to a row. The data source ("rastermill_image") instead
opens files itself, by Arrow's file systems, which every executor must reach: uncompressed files (BMP, TGA, PNM) are planned as bands of rows, so that one
large image spreads over tasks, and it can write.
"""

from __future__ import annotations

import dataclasses
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rastermill.sources import codecs

PIXELS = "path string, x int, y int, r int, g int, b int, a int, error string"
_SCHEMA = pa.schema([("path", pa.string()), *[(c, pa.int32()) for c in ("x", "y", *"rgba")], ("error", pa.string())])


def available() -> dict[str, bool]:
    """SRC2: the formats that a dialog lists, and whether they can be decoded."""
    return {ext: kind in codecs.DECODERS for ext, kind in codecs.EXTENSIONS.items()}


def _rows(path: str, rgba: np.ndarray, first: int = 0) -> pa.RecordBatch:
    h, w, _ = rgba.shape
    flat = rgba.reshape(-1, 4).astype(np.int32)
    n = np.arange(h * w, dtype=np.int32)
    cols = [pa.array([path] * (h * w), pa.string()), pa.array(n % w), pa.array(n // w + np.int32(first)), *[pa.array(np.ascontiguousarray(flat[:, i])) for i in range(4)], pa.nulls(h * w, pa.string())]
    return pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


def _rejected(path: str, why: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"path": path, "error": why}], schema=_SCHEMA)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels of (path, content), some rows of an image at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            path, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
            try:
                rgba = codecs.decode(content or b"", path or "")
            except codecs.Unreadable as e:
                yield _rejected(path, str(e))
                continue
            step = max(1, (1 << 16) // rgba.shape[1])
            for y in range(0, len(rgba), step):
                yield _rows(path, rgba[y : y + step], y)


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC1: pixels (path, x, y, r, g, b, a) of files (path, content), and those without (path, error)."""
    rows = files.select("path", "content").mapInArrow(_decoded, PIXELS)
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("path", "error")


def read_images(spark: SparkSession, path: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """SRC1 and SRC3: every file below a path that `glob` allows, whatever its name says."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def encoded(pixels: DataFrame, kind: str, key: str = "image_id") -> DataFrame:
    """SNK2: key, content. A group is one image."""
    encode = codecs.ENCODERS[kind]

    def run(rows: pa.Table) -> pa.Table:
        x, y = (rows.column(c).to_numpy().astype(np.int64) for c in "xy")
        rgba = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.uint8)
        rgba[y, x] = np.stack([rows.column(c).to_numpy() for c in "rgba"], axis=1)
        return pa.table({key: rows.column(key).slice(0, 1), "content": pa.array([encode(rgba)], pa.binary())})

    return pixels.select(key, "x", "y", *"rgba").groupBy(key).applyInArrow(run, f"{key} {dict(pixels.dtypes)[key]}, content binary")


# --- buffers in memory


def _byte(content: str, at) -> F.Column:
    return F.conv(F.hex(F.substring(content, at + 1, F.lit(1))), 16, 10).cast("int")


def pixels_of_rows(rows: DataFrame) -> DataFrame:
    """SRC9, row pointers: image_id, y, content (r, g, b, a bytes by pixel). A row that isn't whole pixels raises an error."""
    whole = F.when(F.octet_length("content") % 4 == 0, F.expr("octet_length(content) div 4")).otherwise(F.raise_error(F.lit("a row is not whole pixels")))
    spread = rows.select("image_id", "y", "content", F.explode(F.sequence(F.lit(0), whole - 1)).alias("x")).where("octet_length(content) > 0")
    return spread.select("image_id", F.col("x").cast("int"), F.col("y").cast("int"), *[_byte("content", F.col("x").cast("int") * 4 + i).alias(c) for i, c in enumerate("rgba")])


def pixels_of_buffers(images: DataFrame) -> DataFrame:
    """SRC9, contiguous: image_id, width, height, content. A buffer that is too short raises an error."""
    enough = F.octet_length("content") >= F.col("width").cast("long") * F.col("height") * 4
    rows = images.where(F.when(enough, True).otherwise(F.raise_error(F.lit("a buffer is too short")).cast("boolean")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return pixels_of_rows(rows.select("image_id", "y", F.substring("content", (F.col("y") * F.col("width") * 4 + 1).cast("int"), (F.col("width") * 4).cast("int")).alias("content")))


def pixels_of_callback(images: DataFrame, row: Callable[[int, int, int], bytes]) -> DataFrame:
    """SRC9, callback: row(image_id, y, width) gives a row's bytes; images: image_id, width, height. Rows are made in the tasks, each once."""
    spread = images.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).where("height > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row(r["image_id"], r["y"], r["width"]) for r in batch.to_pylist()]
            if any(len(m) != 4 * w for m, w in zip(made, batch.column("width").to_pylist(), strict=True)):
                raise ValueError("a row has another length than the image")
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("y"), pa.array(made, pa.binary())], names=["image_id", "y", "content"])

    return pixels_of_rows(spread.mapInArrow(run, f"image_id {dict(images.dtypes)['image_id']}, y int, content binary"))


def index_rows(indexed: DataFrame) -> DataFrame:
    """SNK6, row pointers: image_id, y, content, an index a byte. A row with gaps or an index over 255 raises an error."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("x", "idx"))), lambda s: F.lpad(F.hex(s["idx"]), 2, "0"))
    fine = (F.count("*") == F.max("x") + 1) & (F.count_distinct("x") == F.count("*")) & (F.max("idx") <= 255) & (F.min("idx") >= 0)
    rows = indexed.groupBy("image_id", "y").agg(F.unhex(F.array_join(ordered, "")).alias("content"), fine.alias("fine"))
    return rows.select("image_id", "y", F.when(F.col("fine"), F.col("content")).otherwise(F.raise_error(F.lit("a row has gaps or indices beyond a byte")).cast("binary")).alias("content"))


def index_buffers(indexed: DataFrame, size: int | None = None) -> DataFrame:
    """SNK6, contiguous: image_id, width, height, content. Images that need more than `size` bytes raise an error."""
    rows = index_rows(indexed).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "content"))).alias("rows"))
    parts = F.transform("rows", lambda s: F.hex(s["content"]))
    whole = rows.select("image_id", F.octet_length(F.get("rows", F.lit(0))["content"]).alias("width"), F.size("rows").alias("height"), F.unhex(F.array_join(parts, "")).alias("content"))
    fits = F.lit(True) if size is None else F.octet_length("content") <= size
    return whole.withColumn("content", F.when(fits, F.col("content")).otherwise(F.raise_error(F.lit("the buffer is too small")).cast("binary")))


# --- the data source


@dataclasses.dataclass
class Band(InputPartition):
    """Rows of a file, or all of it where `rows` is None; start and stride in bytes."""

    path: str
    name: str
    rows: tuple[int, int] | None = None
    layout: tuple | None = None


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri(f"file:{uri}")


def _layout(head: bytes, size: int, name: str) -> tuple | None:
    """(width, height, first byte, bytes of a row, bytes of a pixel, bottom row first) of a true-colour file whose rows can be read alone."""
    try:
        kind = codecs.sniff(head, name)
    except codecs.Unreadable:
        return None
    if kind == "bmp" and len(head) >= 54:
        start, info, w, h, _, depth, packing = struct.unpack("<IIiiHHI", head[10:34])
        stride = (w * depth + 31) // 32 * 4
        if depth in (24, 32) and packing in (0, 3) and w > 0 and h and size >= start + stride * abs(h):
            return w, abs(h), start, stride, depth // 8, h > 0, depth == 32 and packing == 3 and info >= 56
    if kind == "tga":
        skip, mapped, form, _, _, _, _, _, w, h, depth, flags = struct.unpack("<BBBHHBHHHHBB", head[:18])
        if form == 2 and not mapped and depth in (24, 32) and w and h and not flags & 16 and size >= 18 + skip + w * h * depth // 8:
            return w, h, 18 + skip, w * depth // 8, depth // 8, not flags & 32, depth == 32
    return None


class ImageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.band = options["path"], int(options.get("bandrows", 1024))

    def partitions(self) -> list[Band]:
        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            with system.open_input_file(f.path) as file:
                layout = _layout(file.read(64), f.size, f.path)
            if layout is None:
                out.append(Band(self.path, f.path))
            else:
                out += [Band(self.path, f.path, (y, min(layout[1], y + self.band)), layout) for y in range(0, layout[1], self.band)]
        return out

    def read(self, part: Band) -> Iterator[pa.RecordBatch]:
        system, _ = _open(part.path)
        with system.open_input_file(part.name) as file:
            if part.rows is None:
                try:
                    yield _rows(part.name, codecs.decode(file.read(), part.name))
                except codecs.Unreadable as e:
                    yield _rejected(part.name, str(e))
                return
            w, h, start, stride, unit, bottom_first, alpha = part.layout
            a, b = part.rows
            file.seek(start + stride * (h - b if bottom_first else a))
            rows = np.frombuffer(file.read(stride * (b - a)), np.uint8).reshape(b - a, stride)[:, : w * unit].reshape(b - a, w, unit)
        rows = rows[::-1] if bottom_first else rows
        out = np.full((b - a, w, 4), 255, np.uint8)
        out[:, :, :3] = rows[:, :, 2::-1]
        if alpha:
            out[:, :, 3] = rows[:, :, 3]
        yield _rows(part.name, out, a)


@dataclasses.dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ImageWriter(DataSourceWriter):
    """Images go to a folder below the target first; only the commit, once all tasks are through, moves them to their names."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.uri, self.kind, self.overwrite = options["path"], options.get("kind", "png"), overwrite
        if self.kind not in codecs.ENCODERS:
            raise ValueError(f"no encoder for {self.kind}")
        self.hidden = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        """Rows name, x, y, r, g, b, a; a name's rows follow each other in one task."""
        system, path = _open(self.uri)
        done: list[tuple[str, str]] = []
        seen: set[str] = set()
        name, cells = None, []

        def put() -> None:
            if name is None:
                return
            if name in seen or "/" in name or name.startswith(("_", ".")) or not name:
                raise ValueError(f"rows of {name!r} are apart, or it is no name of a file")
            seen.add(name)
            x, y = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])
            rgba = np.zeros((y.max() + 1, x.max() + 1, 4), np.uint8)
            rgba[y, x] = [c[2:] for c in cells]
            system.create_dir(f"{path}/{self.hidden}", recursive=True)
            held = f"{path}/{self.hidden}/{uuid.uuid4().hex}"  # another for each attempt of a task
            with system.open_output_stream(held) as out:
                out.write(codecs.ENCODERS[self.kind](rgba))
            done.append((held, f"{path}/{name}.{self.kind}"))

        for r in rows:
            if r["name"] != name:
                put()
                name, cells = r["name"], []
            cells.append((r["x"], r["y"], r["r"], r["g"], r["b"], r["a"]))
        put()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = _open(self.uri)
        moves = [m for message in messages if message for m in message.files]
        names = [to for _, to in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("one name was written by several tasks: deal the rows out by name first")
        if not self.overwrite and any(i.type != fs.FileType.NotFound for i in system.get_file_info(names)):
            self.abort(messages)
            raise ValueError("a file of that name is there already")
        for held, to in moves:
            system.move(held, to)
        self.abort(messages)  # what is left below the hidden folder is of attempts that did not count

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, path = _open(self.uri)
        if system.get_file_info(f"{path}/{self.hidden}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.hidden}")


class ImageSource(DataSource):
    """format("rastermill_image"): path, bandrows (reading), kind (writing: png, bmp, tga, gif)."""

    @classmethod
    def name(cls) -> str:
        return "rastermill_image"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> ImageReader:
        return ImageReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(dict(self.options), overwrite)


def write_images(pixels: DataFrame, path: str, kind: str = "png", overwrite: bool = False) -> None:
    """SNK2: pixels (name, x, y, r, g, b, a) as files, an image in one task; a job that fails leaves no file."""
    pixels.sparkSession.dataSource.register(ImageSource)
    rows = pixels.select("name", "x", "y", *"rgba").repartition("name").sortWithinPartitions("name")
    rows.write.format("rastermill_image").option("kind", kind).mode("overwrite" if overwrite else "append").save(path)


def read_bands(spark: SparkSession, path: str, band_rows: int = 1024) -> DataFrame:
    """The data source's rows: PIXELS, rejected files with an error."""
    spark.dataSource.register(ImageSource)
    return spark.read.format("rastermill_image").option("bandrows", band_rows).load(path)
