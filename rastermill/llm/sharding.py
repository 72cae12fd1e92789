"""Uniform sharding with exact sizes: a communication matrix drawn from the hypergeometric law, permutations before and after the exchange.

Rows lie in blocks (by hash of a stable row number). How many rows each block sends to each slice of each shard is drawn so that the matrix has
the law that a uniform shuffle of all rows would give it: its row sums are the blocks' sizes, its column sums the slices' sizes, which are fixed
beforehand and differ by shard by one row at most. Then each block permutes its rows and deals them out by its row of the matrix, and each slice
permutes what it got and numbers it. Only row numbers are permuted; the rows themselves are moved once, by a join with their places.

The matrix is drawn in three steps, each conditional on the one before, so that no task or driver draws it whole: groups of blocks x shards (at most
GROUPS x shards numbers, on the driver), for each shard groups x its slices, for each group its blocks x all slices. All draws are seeded by what they are for, so that a
task that runs again draws the same.

Defined cases: ids and texts play no part, so null, repeated or equal ones and extra columns are rows like others; with fewer rows than shards some shards are
empty; an empty table gives an empty result. The outcome depends on the seed and on where the rows lie (see stable_rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.shared import free_name, saved, stable_rows

#: Rows of a block on average, and of a slice at most.
ROWS = 1 << 17
#: Groups of blocks at most.
GROUPS = 256
#: Beyond this numpy doesn't draw.
NUMPY_MOST = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` drawn without replacement are good. Large populations: inversion outwards from the mode."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    span = int(12 * math.sqrt(sample * (good / (good + bad)) * (bad / (good + bad)) * (1 - sample / (good + bad))) + 60)  # beyond it lies less than 2^-64
    up = np.arange(mode, min(high, mode + span), dtype=np.float64)
    down = np.arange(mode, max(low, mode - span), -1, dtype=np.float64)
    rise = np.log((good - up) / (up + 1)) + np.log((sample - up) / (bad - sample + up + 1))
    fall = np.log(down / (good - down + 1)) + np.log((bad - sample + down) / (sample - down + 1))
    logs = np.concatenate([np.cumsum(fall)[::-1], [0.0], np.cumsum(rise)])
    run = np.cumsum(np.exp(logs))
    return mode - len(down) + int(np.searchsorted(run, rng.random() * run[-1], side="right"))


def multivariate(rng: np.random.Generator, holds: np.ndarray, sample: int) -> np.ndarray:
    """How `sample` places drawn from slots of sizes `holds` are spread over them."""
    if int(holds.sum()) < NUMPY_MOST:
        return rng.multivariate_hypergeometric(holds, sample, method="marginals")
    out, rest = np.zeros(len(holds), np.int64), int(holds.sum())
    for i, h in enumerate(holds.tolist()):
        rest -= h
        out[i] = hypergeometric(rng, h, rest, sample)
        sample -= int(out[i])
    return out


def communication_matrix(rng: np.random.Generator, sends: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """A random table with the row sums `sends` and the column sums `holds` (of equal totals), as a uniform shuffle would give it."""
    out, left = np.zeros((len(sends), len(holds)), np.int64), holds.astype(np.int64).copy()
    for i, n in enumerate(sends.tolist()):
        out[i] = multivariate(rng, left, n)
        left -= out[i]
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def slice_sizes(size: int, most: int) -> list[int]:
    """A shard's slices, in the order of its slots."""
    return shard_sizes(size, max(1, -(-size // most)))


def _to_slices(seed: int, most: int):
    """For each shard (sends: what each group gives it): per group the numbers that go to its slices."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, sends in zip(frame["shard"].tolist(), frame["sends"], strict=True):
                sends = np.asarray(sends, np.int64)
                drawn = communication_matrix(np.random.default_rng((seed, 1, shard)), sends, np.array(slice_sizes(int(sends.sum()), most)))
                yield pd.DataFrame({"group": range(len(sends)), "shard": shard, "holds": list(drawn)})

    return run


def _to_blocks(seed: int):
    """For each group its blocks' rows of the matrix."""

    def run(blocks: pa.Table, holds: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("block")
        columns = np.concatenate([np.asarray(h, np.int64) for h in holds.sort_by("shard").column("holds").to_pylist()])
        drawn = communication_matrix(np.random.default_rng((seed, 2, blocks.column("group")[0].as_py())), blocks.column("n").to_numpy(), columns)
        return pa.table({"block": blocks.column("block"), "sends": pa.array(list(drawn), pa.list_(pa.int64()))})

    return run


def _deal(seed: int):
    """Permutes a block's rows and deals them out to slices."""

    def run(rows: pa.Table, matrix: pa.Table) -> pa.Table:
        ids = np.sort(rows.column("rid").to_numpy())
        ids = np.random.default_rng((seed, 3, rows.column("block")[0].as_py())).permutation(ids)
        sends = np.asarray(matrix.column("sends")[0].as_py(), np.int64)
        return pa.table({"slice": pa.array(np.repeat(np.arange(len(sends)), sends)), "rid": pa.array(ids)})

    return run


def _number(seed: int, shard_of: np.ndarray, start_of: np.ndarray):
    """Permutes a slice's rows and numbers them."""

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("slice")[0].as_py()
        ids = np.sort(rows.column("rid").to_numpy())
        ids = np.random.default_rng((seed, 4, at)).permutation(ids)
        return pa.table({"rid": pa.array(ids), "shard": pa.array(np.full(len(ids), shard_of[at], np.int32)), "slot": pa.array(start_of[at] + np.arange(len(ids)))})

    return run


def places(rows: DataFrame, rid: str, shards: int, seed: int = 0, block_rows: int = ROWS) -> DataFrame:
    """rid, shard, slot of each row; `rid` is a unique long that every job sees alike."""
    spark = rows.sparkSession
    ids = saved(rows.select(F.col(rid).alias("rid")), "ids")
    total = ids.count()
    blocks = max(1, -(-total // block_rows))
    groups = min(blocks, GROUPS)
    dealt = ids.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    group = F.floor(F.col("block") * groups / F.lit(blocks)).cast("int")
    counts = saved(dealt.groupBy("block").agg(F.count("*").alias("n")).withColumn("group", group), "counts")
    sends = np.zeros(groups, np.int64)
    for r in counts.groupBy("group").agg(F.sum("n").alias("n")).collect():  # GROUPS rows at most
        sends[r["group"]] = r["n"]
    sizes = shard_sizes(total, shards)
    upper = communication_matrix(np.random.default_rng((seed, 0)), sends, np.array(sizes))
    by_shard = spark.createDataFrame([(i, upper[:, i].tolist()) for i in range(shards)], "shard int, sends array<bigint>").repartition(shards, "shard")
    to_slices = by_shard.mapInPandas(_to_slices(seed, block_rows), "group int, shard int, holds array<bigint>")
    matrix = saved(counts.groupBy("group").cogroup(to_slices.groupBy("group")).applyInArrow(_to_blocks(seed), "block long, sends array<bigint>") if total else spark.createDataFrame([], "block long, sends array<bigint>"), "matrix")
    sliced = [slice_sizes(s, block_rows) for s in sizes]
    shard_of = np.repeat(np.arange(shards), [len(s) for s in sliced])
    start_of = np.concatenate([np.cumsum([0, *s[:-1]]) for s in sliced])
    sent = dealt.groupBy("block").cogroup(matrix.groupBy("block")).applyInArrow(_deal(seed), "slice long, rid long")
    return sent.groupBy("slice").applyInArrow(_number(seed, shard_of, start_of), "rid long, shard int, slot long")


def sharded(docs: DataFrame, shards: int = 16, seed: int = 0, block_rows: int = ROWS) -> DataFrame:
    """docs with `shard` (from 0; counts at most one apart) and `slot` (place in the shard, gapless from 0), named otherwise if docs has such columns."""
    row = free_name(docs, "row_id")
    rows = stable_rows(docs, row)
    found = places(rows, row, shards, seed, block_rows).select(F.col("rid").alias(row), F.col("shard").alias(free_name(docs, "shard")), F.col("slot").alias(free_name(docs, "slot")))
    return rows.join(found.hint("merge"), row).drop(row)


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Parquet files below a folder for each shard, rows in the order of their slots within a file; files follow each other by slot."""
    rows.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
