"""What several operators of this subpackage use: scratch tables, word splitting, packed exchanges.

A *packed exchange* sends 64-bit keys between tasks as binary blobs, one row for each (bucket, chunk),
so that a key which a third of all rows share costs one entry per chunk and never a hot partition.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode, tests) a new one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="rastermill-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{where}")
        spark.sparkContext.setCheckpointDir(f"file://{where}")
        where = f"file://{where}"
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A row number for use within one job, written with its rows: another job may deal the scan's rows out anew, see stable_rows."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Bits of a row's place in its file; more where a file has more rows.
PLACE_BITS = 20


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is a scan of files with deterministic filters and projections only, so that a row of a file is one of df."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def stable_rows(df: DataFrame, name: str) -> DataFrame:
    """df with a unique row number (long, not negative) that every job sees alike, however the rows are dealt out to tasks.

    For a scan of Parquet files it is the file (hashed; no two of df's files share a hash, which is checked) and the row's place in
    it. Any other df is written once to the shared folder, together with its numbers, and read from there.
    """
    if _plain_scan(df):
        try:
            at = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        except AnalysisException:  # no Parquet
            at = None
        if at is not None:
            bits, hashed = PLACE_BITS, lambda b: F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(1 << (62 - b)))
            of_file = lambda b: F.pmod(F.xxhash64("file"), F.lit(1 << (62 - b)))
            seen = at.agg(F.max("place").alias("last"), F.count_distinct("file").alias("files"), F.count_distinct(of_file(bits)).alias("hashes")).first()
            if seen["last"] is not None and seen["last"] >> bits:
                bits = seen["last"].bit_length()
                seen = at.agg(F.count_distinct("file").alias("files"), F.count_distinct(of_file(bits)).alias("hashes")).first()
            if seen["files"] == seen["hashes"]:
                return df.withColumn(name, F.shiftleft(hashed(bits), bits) + F.col("_metadata.row_index"))
    return saved(with_row_id(df, name), "rows")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df has it, in any case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def release() -> None:
    """Gives freed memory back to the system, so that an idle Python worker doesn't keep its largest batch's."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes in `column` each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        release()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words between ASCII white space: code of each word, the distinct words, and row offsets into the codes.

    Null and empty texts have no words. `lower` maps A-Z only.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in distinct:
        keep = codes != distinct.index(b"")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, distinct, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads its input (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys) for each bucket that has keys; keys keep their order."""
    if not len(keys):
        return
    bucket = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    for b, places in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
        yield b, places


def isin_sorted(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in `among`, which is sorted."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the links (a, b): each node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_a, kept_b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        kept_a = np.concatenate([kept_a, batch.column(0).to_numpy(zero_copy_only=False)])
        kept_b = np.concatenate([kept_b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(kept_a) > 1 << 20:  # what is held is emitted in bounded pieces
            kept_a, kept_b = forest(kept_a, kept_b)
            if len(kept_a) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(kept_a), pa.array(kept_b)], names=["a", "b"])
                kept_a, kept_b = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(kept_a):
        a, b = forest(kept_a, kept_b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of distributed links: (node, root), root the smallest node; only nodes with links.

    Each round first shortens every partition's links to a star forest, then runs a large-star and a small-star
    step (Kiveris et al. 2014) as aggregates and joins. A node with very many links is aggregated map-side and joined
    by a join that adaptive execution may split: the smallest neighbours are written first, since a side that comes
    straight from an aggregate can't be dealt anew. Links are written to the shared folder each round.
    """
    edges = saved(
        links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").mapInArrow(_forests, "a long, b long").distinct(),
        "links",
    )
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before is not None and now == before:
            break
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u"), "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.mapInArrow(_forests, "a long, b long").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hooked = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = hooked.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = saved(small.where("a <> b").mapInArrow(_forests, "a long, b long").distinct(), "links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())
