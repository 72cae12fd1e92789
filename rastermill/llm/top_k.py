"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors are quantised to integers. A block of candidates is turned into postings, one list of (row, weight) for each
dimension, once for all queries; a query's non-zero components scatter their weighted postings into dense score arrays. Partition selection
takes each block's best k for each query, and an aggregate merges them. Queries travel to the tasks in sets of bounded
size; every set meets every candidate, block by block.

Defined cases: a vector that is null, or holds a null or a non-finite component, takes no part, nor does a null id; a
missing component counts as zero; candidates with the query's own id are not its results; of rows with one id
the best score counts, once; several query rows with one id count as the one with the smallest vector; ties go to the
smaller id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastermill.llm.shared import saved, scratch

QUERY_SET = 4096
TILE = 512


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """Rows (id, v): floor(scale * component) as integers, without vectors that take no part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros or cut to `width` (a query has no weight beyond it)."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    row, at = np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = at < width
    out[row[keep], at[keep]] = flat[keep]
    return out


def postings(block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term (dimension) the rows that have it, and their weights."""
    return [(rows := np.flatnonzero(column), np.ascontiguousarray(column[rows])) for column in block.T]


def scores(queries: np.ndarray, posted: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Inner products of queries and the posted rows: each term's weighted postings are added to its queries' score arrays."""
    out = np.zeros((rows, len(queries)), queries.dtype)
    for column, (at, weights) in zip(queries.T, posted, strict=True):
        asked = np.flatnonzero(column)
        if not len(asked) or not len(at):
            continue
        if len(asked) == len(queries):
            out[at] += weights[:, None] * column
        else:
            out[np.ix_(at, asked)] += weights[:, None] * column[asked]
    return np.ascontiguousarray(out.T)


def _best(query_ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            block = _matrix(batch.column("v"), queries.shape[1])
            order = np.argsort(ids, kind="stable")
            ids, block = ids[order], block[order]
            heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            out: list[list[np.ndarray]] = [[], [], []]
            bound = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(1, queries.shape[1])
            kind = np.int32 if bound < 2**31 else np.int64
            posted = postings(block.astype(kind))
            for at in range(0, len(queries), TILE):
                found = scores(queries[at : at + TILE].astype(kind), posted, len(block)).astype(np.int64)
                if len(heads) < len(ids):
                    found = np.maximum.reduceat(found, heads, axis=1)
                mine = ids[heads]
                n = len(mine)
                # one number that sorts by score, then by smaller id; own rows come last
                spread = np.ptp(found) + 2
                if float(spread) * n < 2**62:
                    rank = (found - found.min() + 1) * n + (n - 1 - np.arange(n))
                    rank[query_ids[at : at + TILE, None] == mine[None, :]] = -1
                    top = np.argpartition(rank, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), found.shape)
                else:
                    top = np.stack([np.lexsort((mine, -f))[: k + 1] for f in found])
                q, c = np.repeat(query_ids[at : at + TILE], top.shape[1]), mine[top].ravel()
                s = np.take_along_axis(found, top, axis=1).ravel()
                other = q != c
                for col, x in zip(out, (q[other], c[other], s[other]), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "id", "score"])

    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, query_set: int = QUERY_SET) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best candidates of each query.

    Queries are taken in sets of `query_set`; one set at a time is on the driver and in the tasks.
    """
    spark = candidates.sparkSession
    asked = saved(quantised(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    base = quantised(candidates, id_col, vec_col, scale)
    last, parts, path = None, 0, scratch(spark, "top")
    merged = None
    while True:
        rest = asked if last is None else asked.where(F.col("id") > last)
        rows = rest.orderBy("id").limit(query_set).collect()
        if not rows and parts:
            break
        ids = np.array([r["id"] for r in rows], np.int64)
        width = max((len(r["v"]) for r in rows), default=0)
        vectors = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            vectors[i, : len(r["v"])] = r["v"]
        found = base.mapInArrow(_best(ids, vectors, k), "query_id long, id long, score long") if rows else base.select(F.col("id").alias("query_id"), "id", F.lit(0).cast("long").alias("score")).where("false")
        found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        best = best.select("query_id", "rank", "id", "score")
        if len(rows) < query_set and not parts:
            return best
        best.write.parquet(f"{path}/part={parts}")
        merged, parts = best.schema, parts + 1
        if len(rows) < query_set:
            break
        last = int(ids[-1])
    return spark.read.schema(merged).parquet(*[f"{path}/part={i}" for i in range(parts)])
