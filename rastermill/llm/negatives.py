"""Hard-negative mining by block matrix multiplication over a grid (SUMMA): anchors x rows, cut by rows and by dimensions.

Rows are dealt into blocks by hash of their id, sorted by label within a block, and each block is cut into chunks of dimensions. Panels of
anchor blocks are sent along the grid's rows and panels of row blocks along its columns, so that every cell (anchor panel, row panel,
chunk) multiplies what it holds: partial int64 score tiles, shuffled by tile and added over the chunks. A summed tile is reduced at once to
the best few for each anchor. Two sweeps share the work, each pair of rows being multiplied in one of them: pairs of one label give the
positives, then pairs of different labels give, for each positive's window of scores, the best negatives.

On the wire a tile holds only its sweep's pairs, in the smallest integers that hold its values; a task holds one tile and its few
chunks. Blocks are of about ROWS rows whatever the labels are, so that a hot label is spread like any other.

Defined cases: a row with a null id, a null label, a null vector, or a null or non-finite component takes no part; missing components
count as zero; several rows of one id count as the one with the smallest label, then vector; an anchor is not its own positive; ties of score go to the
smaller id; an anchor without other rows of its label, and a positive with an empty window, have no rows; an empty table gives an empty result;
other columns are not looked at. Components are beyond 2^26 after scaling: an error, as sums could leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.llm.shared import saved

#: Rows of a block of anchors, and of a block of rows, on average; blocks of a panel; dimensions of a chunk.
ANCHORS, ROWS, PANEL, CHUNK = 256, 1024, 4, 32
MOST = 1 << 26

_BLOCK = "block int, chunk int, ids binary, labels binary, windows array<array<bigint>>, v binary"


def usable(df: DataFrame, id_col: str, label: Column, vec_col: str, scale: int) -> DataFrame:
    """Rows (id, label, v) of integers, one for each id."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(fine).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")


def _pack(width: int, chunk: int):
    """A block's rows, sorted by label and id, as one row for each chunk of dimensions; the first holds ids and windows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("id", "ascending")]).combine_chunks()
        lists = table.column("v").combine_chunks()
        v = np.zeros((table.num_rows, width), np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(lists)), sizes)
        v[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
        if np.abs(v).max(initial=0) > MOST:
            raise ValueError("a component is beyond 2^26 after scaling")
        ids, labels = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "label"))
        chunks = range(max(1, -(-width // chunk)))
        cols = [
            pa.array([table.column("block")[0].as_py()] * len(chunks), pa.int32()), pa.array(list(chunks), pa.int32()),
            pa.array([ids if c == 0 else None for c in chunks], pa.binary()), pa.array([labels] * len(chunks), pa.binary()),
            pa.array([table.column("windows").to_pylist() if c == 0 else None for c in chunks], pa.list_(pa.list_(pa.int64()))),
            pa.array([narrow(v[:, c * chunk : (c + 1) * chunk]) for c in chunks], pa.binary()),
        ]
        return pa.table(dict(zip(("block", "chunk", "ids", "labels", "windows", "v"), cols, strict=True)))

    return run


def narrow(values: np.ndarray) -> bytes:
    """int64 values in the smallest of 2, 4 or 8 bytes that hold all of them, preceded by that size."""
    most = int(np.abs(values).max(initial=0))
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def widened(content: bytes) -> np.ndarray:
    return np.frombuffer(content, f"<i{content[0]}", offset=1).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 scores of rows of a and rows of b: by floats where all sums are below 2^53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _longs(content: bytes) -> np.ndarray:
    return np.frombuffer(content, np.int64)


def _multiply(same: bool):
    """Partial tiles: for each row the anchor block i's chunk and the row block j's; the tile's pairs of equal (or of different) labels."""
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = _longs(r["a_labels"]), _longs(r["b_labels"])
                wanted = (x[:, None] == y[None, :]) == same
                if not wanted.any():
                    continue
                tile = product(widened(r["a_v"]).reshape(len(x), -1), widened(r["b_v"]).reshape(len(y), -1))
                first = r["chunk"] == 0
                cols = [r["i"], r["j"], r["a_ids"], r["a_labels"] if first else None, r["a_windows"], r["b_ids"], r["b_labels"] if first else None, narrow(tile[wanted])]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names=["i", "j", "a_ids", "a_labels", "a_windows", "b_ids", "b_labels", "scores"])

    return run


_TILES = "i int, j int, a_ids binary, a_labels binary, a_windows array<array<bigint>>, b_ids binary, b_labels binary, scores binary"
_BEST = "anchor long, window long, id long, score long"


def _reduce(same: bool, k: int, low: int, high: int):
    """Adds a tile's chunks; for each anchor (and window) its k best pairs, ties to the smaller id."""

    def run(table: pa.Table) -> pa.Table:
        head, total = None, None
        for batch in table.to_batches():
            for r in batch.to_pylist():
                part = widened(r["scores"])
                total = part if total is None else total + part
                head = r if r["a_ids"] is not None else head
        anchors, ids = _longs(head["a_ids"]), _longs(head["b_ids"])
        wanted = (_longs(head["a_labels"])[:, None] == _longs(head["b_labels"])[None, :]) == same
        ends = np.cumsum(wanted.sum(axis=1))
        out: list[tuple] = []
        for n, anchor in enumerate(anchors.tolist()):
            score, other = total[ends[n - 1] if n else 0 : ends[n]], ids[wanted[n]]
            order = np.lexsort((other, -score))
            score, other = score[order], other[order]
            if same:
                mine = np.flatnonzero(other != anchor)[:k]
                out += [(anchor, None, i, s) for i, s in zip(other[mine].tolist(), score[mine].tolist(), strict=True)]
                continue
            for window in head["a_windows"][n]:
                at = np.searchsorted(-score, -window if high == 100 else -(high * window // 100), side="left")
                for i, s in zip(other[at : at + k].tolist(), score[at : at + k].tolist(), strict=True):
                    if low * window <= 100 * s <= high * window:
                        out.append((anchor, window, i, s))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "window", "id", "score"), cols, strict=True)})

    return run


def _sweep(anchors: DataFrame, blocks: DataFrame, panels: tuple[int, int], same: bool, k: int, low: int, high: int) -> DataFrame:
    """Every anchor block with every row block of the grid; the best pairs of each tile."""
    r, g = panels
    a = anchors.select(F.floor(F.col("block") / PANEL).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g"), "chunk", F.col("block").alias("i"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "windows", "v")])
    b = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"), F.floor(F.col("block") / PANEL).cast("int").alias("g"), "chunk", F.col("block").alias("j"), *[F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "v")])
    partial = a.join(b.hint("merge"), ["r", "g", "chunk"]).drop("r", "g").mapInArrow(_multiply(same), _TILES)
    return partial.groupBy("i", "j").applyInArrow(_reduce(same, k, low, high), _BEST)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, chunk: int = CHUNK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (`is_anchor`, over `id`) and each of its best `positives` rows of the same label, the best `negatives` rows of other labels
    with low % to high % of the positive's score. `high` is at most 100.
    """
    if not 0 < high <= 100:
        raise ValueError("high is 1 to 100")
    rows = saved(usable(vectors, id_col, label, vec_col, scale).withColumn("anchor", is_anchor), "rows")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max(F.size("v")).alias("w")).first()
    n_i, n_j, width = max(1, -(-sizes["a"] // ANCHORS)), max(1, -(-sizes["n"] // ROWS)), sizes["w"] or 1

    def packed(df: DataFrame, n: int, windows: Column) -> DataFrame:
        dealt = df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "label", "v", windows.alias("windows"))
        return dealt.groupBy("block").applyInArrow(_pack(width, chunk), _BLOCK)

    none, grid = F.array().cast("array<bigint>"), (-(-n_i // PANEL), -(-n_j // PANEL))
    blocks, anchors = saved(packed(rows, n_j, none), "blocks"), rows.where("anchor")
    best = _sweep(packed(anchors, n_i, none), blocks, grid, True, positives, low, high)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id")))
    near = saved(ranked.where(F.col("rank") <= positives).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("window")), "positives")
    asked = near.groupBy("anchor").agg(F.sort_array(F.collect_set("window")).alias("windows")).withColumnRenamed("anchor", "id")  # `positives` of them at most
    found = _sweep(packed(anchors.join(asked, "id"), n_i, F.col("windows")), blocks, grid, False, negatives, low, high)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return near.join(top, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score")
    )
