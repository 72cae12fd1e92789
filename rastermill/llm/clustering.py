"""Centroid clustering: Lloyd's rounds that recompute only what can have changed (Delta Lloyd), in exact integers.

Vectors are quantised to integers and packed into blocks, which are written once, bucketed by block. Each round joins them with the
last round's assignments (owner and distance of each vector; bucketed alike, so that nothing is shuffled) and writes the new ones. A
vector whose owner stayed where it was keeps its distance and is compared with the changed centroids only; one whose owner moved is
compared with all. Each block's vectors that change hands are written as signed integer transfers (count and sum of components by
centroid), whose sums by centroid and component are added to the global sums; these k x (components + 1) numbers and the centroids
are all that the driver holds.

Defined cases: a null vector, one of another length than `width`, or one that holds a null or a non-finite component takes no part;
a null id is no start but is clustered; repeated rows are vectors of their own; ties of distance go to the smaller centroid, ties of
hash to the smaller id, then to the smaller vector; with fewer than k vectors with an id there are fewer centroids; without any, or for an empty table, the
result is empty; other columns are not looked at. A component beyond 2^26 after scaling raises an error, as squared distances could not be longs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.shared import partitions, saved, scratch

#: Vectors of a block at most.
BLOCK = 2048
#: Bound of a component's absolute value.
MOST = 1 << 26


def quantised(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double."""
    out = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(out).max(initial=0) > MOST:
        raise ValueError("a component is beyond 2^26 after scaling")
    return out.astype(np.int64)


def distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors x centroids, exact: by floats where all sums are below 2^53, else by integers."""
    most = int(max(np.abs(block).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * most * most * block.shape[1] < 2**53 else np.int64
    a, b = block.astype(kind), centroids.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def reassigned(block: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; changed: by centroid, whether it moved since `owner` and `distance` (owner -1: none yet) were found."""
    owner, distance = owner.copy(), distance.copy()
    again = (owner < 0) | changed[owner]
    if again.any():
        d = distances(block[again], centroids)
        owner[again] = d.argmin(axis=1)
        distance[again] = d.min(axis=1)
    numbers, rest = np.flatnonzero(changed), np.flatnonzero(~again)
    if len(numbers) and len(rest):
        d = distances(block[rest], centroids[numbers])
        best = d.argmin(axis=1)
        near, who = d[np.arange(len(rest)), best], numbers[best]
        better = (near < distance[rest]) | (near == distance[rest]) & (who < owner[rest])
        owner[rest[better]], distance[rest[better]] = who[better], near[better]
    return owner, distance


def transfers(block: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """What each centroid wins and loses: signed count and sums of components."""
    moved = np.flatnonzero(before != after)
    out = []
    for c in np.union1d(before[moved], after[moved]).tolist():
        if c >= 0:
            won, lost = moved[after[moved] == c], moved[before[moved] == c]
            out.append({"c": c, "n": len(won) - len(lost), "s": (block[won].sum(axis=0) - block[lost].sum(axis=0)).tolist()})
    return out


def _pack(scale: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                v = quantised(flat.reshape(batch.num_rows, width), scale)
                v = v.astype(np.int16 if np.abs(v).max(initial=0) < 1 << 15 else np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes()], pa.binary())], names=["ids", "v"])

    return run


def _unpacked(v: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(v, np.int16 if len(v) == 2 * n * width else np.int32).reshape(n, width).astype(np.int64)


_MOVES = "moves array<struct<c:int,n:bigint,s:array<bigint>>>"


def _assign(centroids: np.ndarray, changed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                block = _unpacked(batch.column("v")[i].as_py(), n, centroids.shape[1])
                old = batch.column("owner")[i].as_py()
                before = np.full(n, -1, np.int64) if old is None else np.frombuffer(old, np.int32).astype(np.int64)
                far = np.zeros(n, np.int64) if old is None else np.frombuffer(batch.column("distance")[i].as_py(), np.int64)
                after, near = reassigned(block, centroids, changed, before, far)
                cols = [batch.column("block").slice(i, 1), pa.array([after.astype(np.int32).tobytes()], pa.binary()), pa.array([near.tobytes()], pa.binary()), pa.array([transfers(block, before, after)], moves)]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "owner", "distance", "moves"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            owner, distance = np.frombuffer(batch.column("owner")[i].as_py(), np.int32), np.frombuffer(batch.column("distance")[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), pa.array(owner), pa.array(distance)], names=["id", "cluster", "distance"])


def _inertia(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            owner, distance = np.frombuffer(batch.column("owner")[i].as_py(), np.int32), np.frombuffer(batch.column("distance")[i].as_py(), np.int64)
            found, at = np.unique(owner, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, at, distance)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], names=["cluster", "inertia"])


class _Bucketed:
    """Tables below the shared folder that are bucketed by block; their names last until `close`, their files longer."""

    def __init__(self, spark) -> None:
        self.spark, self.names, self.buckets = spark, [], partitions(spark)

    def write(self, df: DataFrame, name: str, deal: bool = False) -> DataFrame:
        self.names.append(f"{name}_{uuid.uuid4().hex}")
        df = df.repartition(self.buckets, "block") if deal else df
        df.write.format("parquet").bucketBy(self.buckets, "block").option("path", scratch(self.spark, name)).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def delta_lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid: each vector with its centroid after `rounds` rounds and one more assignment.

    Centroids start as the k vectors of smallest sha256 of salt and id. Rounds end early once no centroid moves, as all later ones
    would change nothing. centroid is an array of longs, the components of the vector's centroid.
    """
    spark, v = vectors.sparkSession, F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = kept.where("id IS NOT NULL").orderBy(hashed, "id", "v").limit(k).collect()
    schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = quantised(np.array([r["v"] for r in first]), scale)
    changed, sums, counts = np.ones(len(first), bool), [[0] * width for _ in first], [0] * len(first)
    tables = _Bucketed(spark)
    try:
        packed = kept.mapInArrow(_pack(scale, width), "ids array<bigint>, v binary").withColumn("block", F.monotonically_increasing_id())
        blocks = tables.write(packed, "blocks", deal=True)
        state = None
        for step in range(rounds + 1):
            if state is None:
                known = blocks.select("block", F.size("ids").alias("n"), "v", F.lit(None).cast("binary").alias("owner"), F.lit(None).cast("binary").alias("distance"))
            else:
                known = blocks.join(state.hint("merge"), "block").select("block", F.size("ids").alias("n"), "v", "owner", "distance")
            state = tables.write(known.mapInArrow(_assign(centroids, changed), f"block long, owner binary, distance binary, {_MOVES}"), "assignments")
            if step == rounds:
                break
            moves = state.select(F.explode("moves").alias("m")).select("m.c", F.posexplode(F.concat(F.array("m.n"), "m.s")).alias("at", "x"))
            for r in moves.groupBy("c", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k x (width + 1) rows
                if r["at"]:
                    sums[r["c"]][r["at"] - 1] += int(r["x"])
                else:
                    counts[r["c"]] += int(r["x"])
            new = np.array([[x // n for x in s] if n else c for s, n, c in zip(sums, counts, centroids.tolist(), strict=True)], np.int64)
            changed, centroids = (new != centroids).any(axis=1), new
            if not changed.any():
                break
        result = saved(blocks.join(state.hint("merge"), "block").select("ids", "owner", "distance").mapInArrow(_rows, "id long, cluster int, distance long"), "clusters")
        parts = state.select("owner", "distance").mapInArrow(_inertia, "cluster int, inertia long").groupBy("cluster").agg(F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia")).collect()  # k rows
    finally:
        tables.close()
    inertia = {r["cluster"]: int(r["inertia"]) for r in parts}
    about = [(c, inertia[c], sum(inertia.values()), centroids[c].tolist()) for c in sorted(inertia)]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")
    return result.join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows
