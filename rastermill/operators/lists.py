"""Text filters, list order and look-ups around images: file lists, logs, palette lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.sources.scratch import written


def text_filter(line: Column, rule: str) -> Column:
    """FLT1: "inc,-exc": any included part (all if none is given) and no excluded one, in any case."""
    parts = [p.strip().lower() for p in rule.split(",") if p.strip()]
    low = F.lower(line)
    out = F.lit(True)
    for p in (p[1:] for p in parts if p.startswith("-") and len(p) > 1):
        out = out & ~low.contains(p)
    included = [p for p in parts if not p.startswith("-")]
    if included:
        some = F.lit(False)
        for p in included:
            some = some | low.contains(p)
        out = out & some
    return out


def file_filter(kind: Column, ext: Column, name: Column, wanted: str, search: str = "") -> Column:
    """FLT2: files by extension (".*": all), anything by a case-sensitive part of the name."""
    right = F.lit(True) if wanted == ".*" else (kind != "f") | (ext == wanted)
    return right & (name.contains(search) if search else F.lit(True))


def log_lines(text: Column) -> Column:
    """SNK5: the lines of a log text, to be exploded with their places."""
    return F.split(text, "\n")


def moved(items: DataFrame, ordinal: int, to: int) -> DataFrame:
    """ORD1: the item at `ordinal` goes to place `to`; those between shift by one."""
    o = F.col("ordinal")
    shifted = F.when(o == ordinal, to)
    if to < ordinal:
        shifted = shifted.when((o >= to) & (o < ordinal), o + 1)
    else:
        shifted = shifted.when((o > ordinal) & (o <= to), o - 1)
    return items.withColumn("ordinal", shifted.otherwise(o))


def closed(items: DataFrame, ordinal: int) -> DataFrame:
    """ORD1: the list without the item at `ordinal`."""
    return items.where(F.col("ordinal") != ordinal).withColumn("ordinal", F.when(F.col("ordinal") > ordinal, F.col("ordinal") - 1).otherwise(F.col("ordinal")))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """An explicit ordinal per group."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def known_extension(ext: Column, allowed: str) -> Column:
    """FLT3: place of an extension in a list separated by NUL, -1 if it is not there."""
    known = F.array(*[F.lit(x) for x in allowed.split("\0") if x])
    return (F.array_position(known, ext) - 1).cast("int")


def placed(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with each row's place (from 0) in the whole order, which no task sorts alone: ranges are sorted, counted, and shifted by what stands before them.

    Rows that are equal in `order` get places in any order. The rows are written once, as another job might cut other ranges.
    """
    rows = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    rows = written(rows.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return rows.join(F.broadcast(starts), "part_").withColumn(name, F.col("start_") + F.col("at_")).drop("part_", "at_", "start_")


def selected_paths(files: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """LK3: full paths of selected files with their places by name (ties: key)."""
    return placed(files.withColumn("path", F.concat_ws("/", folder, name)), [name, key])
