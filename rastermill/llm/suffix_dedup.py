"""Suffix-array de-duplication: removes every byte covered by a string of L bytes that also starts anywhere else.

Texts are UTF-8 bytes; strings never cross texts; overlaps count; all is judged on the input.

1. Winnowing: in each L-byte window the rightmost smallest hash of a k-byte gram is its anchor, so equal windows have
   equal anchors at the same offset. Anchor hashes and hashes of their contexts (all bytes that a window with this anchor
   can reach) are counted over the corpus by a packed exchange (see shared.py).
2. Where a context occurs again, all of it goes. Where an anchor occurs again with another context, the windows round
   it are candidates. A chunk concatenates their text, builds its suffix array by two-stage sorting (only suffixes
   smaller than their successors are compared, the rest are induced by bucket scans), and adjacent common prefixes
   of L bytes or more give classes of equal windows; one 64-bit hash per class is counted over the corpus.
3. Windows found twice mark their bytes; the rest is kept.

A chunk is a run of rows whose texts are of one class of size, so that it holds at most 8 MB, or one longer text.

Hashes have 64 bits; the chance that a window is taken for another is about n^2 / 2^65 for n hashed windows.

Defined cases: a null text is empty; texts under L bytes lose nothing; repeated rows are texts of their own; null ids
are carried; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.shared import U64, by_bucket, by_bytes, isin_sorted, mix, partitions, saved, stable_rows

GRAM = 64
#: A chunk holds at most 2 ** 11 rows and 8 MB of text (or one longer text): see chunk_of.
CHUNK_ROWS_LOG2 = 11
_ROW_BYTES = 4096
#: Windows whose anchors are sought at once.
_PIECE = 1 << 18
#: Places within a block have 32 bits; the same for every block, so that equal windows have equal anchors everywhere.
_PLACE = U64((1 << 32) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), U64(base))
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


class Rolling:
    """Hashes of any substring of a byte array: differences of weighted prefix sums, brought to a common place."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        own = self.sums[1:]
        np.take(_BYTE, data, out=own)
        np.multiply(own, _powers(_BASE, n), out=own)
        np.cumsum(own, out=own)
        self.back = _powers(_INVERSE, n + 1)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U64))

    def grams(self, k: int, first: int, end: int) -> np.ndarray:
        """Of k bytes each, from the places first to end."""
        return mix((self.sums[first + k : end + k] - self.sums[first:end]) * self.back[first:end] + U64(k))


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w consecutive ones."""
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if span < w else v


class Block:
    """Anchors and contexts of the texts of one batch, laid end to end."""

    def __init__(self, texts: pa.Array, length: int):
        blob = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
        raw = blob.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.length = length
        self.rolling = Rolling(self.data)
        sizes = np.diff(self.offsets)
        self.windows = np.maximum(0, sizes - length + 1)
        self.anchor = self._anchors()
        doc = np.searchsorted(self.offsets, self.anchor, side="right") - 1
        reach = length - GRAM
        self.doc = doc
        self.start = np.maximum(self.offsets[doc], self.anchor - reach)
        self.end = np.minimum(self.offsets[doc + 1], self.anchor + length)
        if len(self.anchor):
            self.gram = self.rolling.at(self.anchor, self.anchor + GRAM)
            whole = self.rolling.at(self.start, self.end)
            self.context = mix(whole ^ mix((self.anchor - self.start).astype(U64)))
            self.context[self.context == 0] = U64(1)
        else:
            self.gram = self.context = np.empty(0, U64)

    def _anchors(self) -> np.ndarray:
        if not self.windows.any():
            return np.empty(0, np.int64)
        span = self.length - GRAM + 1  # grams of a window
        keep = np.zeros(len(self.data) + 1, np.int8)
        has = self.windows > 0
        np.add.at(keep, self.offsets[:-1][has], 1)
        np.add.at(keep, self.offsets[:-1][has] + self.windows[has], -1)
        keep = np.cumsum(keep[: len(self.data) - self.length + 1], dtype=np.int8) > 0
        found = []
        for first in range(0, len(keep), _PIECE):  # so that a long text's grams are not all held at once
            end = min(first + _PIECE, len(keep))
            grams = self.rolling.grams(GRAM, first, end + span - 1)
            ranked = (grams & ~_PLACE) | (_PLACE - np.arange(first, end + span - 1, dtype=U64))  # ties: the rightmost
            least = _sliding_least(ranked, span)[keep[first:end]]
            found.append(least[np.r_[True, least[1:] != least[:-1]]] if len(least) else least)
        return np.unique((_PLACE - (np.concatenate(found) & _PLACE)).astype(np.int64))

    def window_starts(self, chosen: np.ndarray) -> np.ndarray:
        """Places of the windows that the chosen anchors' contexts hold."""
        mark = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(mark, self.start[chosen], 1)
        np.add.at(mark, self.end[chosen] - self.length + 1, -1)
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


# --- two-stage suffix sorting


def _index_type(n: int) -> type:
    return np.int32 if n + 8 < 1 << 31 else np.int64


def sorted_by_prefix(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places by the `depth` bytes from each (zeros follow the end); equal ones keep their order.

    Sorts by the first 8 bytes as one number, then, 8 bytes on at a time, only what is still tied, and of that only groups that differ. No
    prefix is copied: a place takes its index, one number and its group.
    """
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(data) + depth,), ">u8", padded, strides=(1,))  # the 8 bytes from each place

    def keys(at: int, of: np.ndarray) -> np.ndarray:
        found = words[of + of.dtype.type(at)].astype(U64)
        return found >> U64(8 * (8 - depth + at)) if depth - at < 8 else found

    if not len(places):
        return places
    key = keys(0, places)
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    live, starts = np.arange(len(places), dtype=places.dtype), np.r_[True, key[1:] != key[:-1]]
    for at in range(8, depth, 8):
        tied = ~(starts & np.r_[starts[1:], True])  # not alone in its group
        live, starts = live[tied], starts[tied]
        if not len(live):
            break
        key = keys(at, places[live])
        changes = np.r_[False, key[1:] != key[:-1]] & ~starts
        group = np.cumsum(starts, dtype=places.dtype) - 1
        differ = np.zeros(int(group[-1]) + 1, bool)
        differ[group[changes]] = True
        mixed = np.flatnonzero(differ[group])
        if len(mixed):
            order = mixed[np.lexsort((key[mixed], group[mixed]))]
            places[live[mixed]], key[mixed] = places[live[order]], key[order]
        starts = starts | np.r_[False, key[1:] != key[:-1]]
    return places


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of data in order, by two-stage sorting.

    A suffix smaller than its successor is of type S, else L (the last one is L, as the empty suffix is smaller). Only
    S suffixes are compared, by their first `depth` bytes (equal ones keep their places' order); L suffixes are induced:
    bucket by bucket, what precedes a suffix already placed follows in the same order.
    """
    n = len(data)
    kind = _index_type(n + depth)
    if n < 2:
        return np.arange(n, dtype=kind)
    run_end = np.flatnonzero(np.r_[data[1:] != data[:-1], True])  # a run's type is its last element's
    rises = np.r_[data[1:], 0][run_end] > data[run_end]
    rises[-1] = False
    small = np.repeat(rises, np.diff(np.r_[-1, run_end]))
    places = sorted_by_prefix(data, np.flatnonzero(small).astype(kind), depth)
    firsts = data[places]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1], kind))
    out = []
    for c in range(256):
        frontier = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, kind)
        waiting[c] = []
        while len(frontier):  # L suffixes of this bucket, and what they induce in it
            out.append(frontier)
            before = _induce(frontier, data, small, waiting, c)
            frontier = before
        mine = places[firsts == c] if len(places) else places
        if len(mine):
            out.append(mine)
            _induce(mine, data, small, waiting, c)
    return np.concatenate(out)


def _induce(found: np.ndarray, data: np.ndarray, small: np.ndarray, waiting: list[list[np.ndarray]], c: int) -> np.ndarray:
    """Gives the L predecessors of the suffixes found to their buckets, in order; returns those of bucket c."""
    before = found[found > 0] - 1
    before = before[~small[before]]
    chars = data[before]
    for d in np.unique(chars[chars != c]).tolist():
        waiting[d].append(before[chars == d])
    return before[chars == c]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to `most` bytes, of each suffix and its neighbour before it (0 for the first)."""
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data) + most, 8), (1, 1))
    found = np.zeros(len(order), np.int32)
    for first in range(1, len(order), _PIECE):  # pairs of neighbours compared at once
        live = np.arange(first, min(first + _PIECE, len(order)))
        for at in range(0, most, 8):
            a, b = order[live - 1] + at, order[live] + at
            differ = words[a] != words[b]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            found[live] += same.astype(np.int32)
            live = live[same == 8]
            if not len(live):
                break
    pair_room = np.minimum(len(data) - order[1:], len(data) - order[:-1])
    found[1:] = np.minimum(np.minimum(found[1:], pair_room), most)
    return found


def equal_windows(block: Block, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of equal windows among `starts`: one place each, and whether a class has several windows."""
    length = block.length
    firsts, many = [], []
    runs = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
    # several runs are sorted together; places in the joined text map back to the block
    texts = [block.data[r[0] : r[-1] + length] for r in runs]
    back = np.concatenate([np.arange(r[0], r[-1] + length) for r in runs])
    valid = np.concatenate([np.r_[np.ones(len(r), bool), np.zeros(length - 1, bool)] for r in runs])
    joined = np.concatenate(texts)
    order = suffix_array(joined, length)
    order = order[valid[order]]
    heads = np.flatnonzero(common_prefixes(joined, order, length) < length)
    firsts = back[order[heads]]
    many = np.diff(np.r_[heads, len(order)]) > 1
    return firsts, many


# --- the exchanges

_KEYS = "bucket int, chunk long, kind int, k binary, x binary"


def _emit(kind: int, chunk: int, keys: np.ndarray, extra: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    rows = [(b, chunk, kind, keys[at].tobytes(), extra[at].tobytes()) for b, at in by_bucket(keys, buckets)]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "chunk", "kind", "k", "x"]) if rows else None


def chunk_of(row: Column, text: Column) -> Column:
    """A row's chunk: rows next to each other whose texts are of one class of size.

    Each doubling of the size over 4 KB halves the rows of a chunk, down to one. The lowest four bits are the class.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0))
    found = F.shiftleft(F.shiftright(row, CHUNK_ROWS_LOG2), 4) + CHUNK_ROWS_LOG2
    for doublings in range(1, CHUNK_ROWS_LOG2 + 1):
        bits = CHUNK_ROWS_LOG2 - doublings
        found = F.when(size > _ROW_BYTES << (doublings - 1), F.shiftleft(F.shiftright(row, bits), 4) + bits).otherwise(found)
    return found


def _send_anchors(length: int, buckets: int):
    """Per chunk its distinct anchors, each with its context (0: several, 1 bit of it: found once), and distinct contexts."""

    def summaries(chunk: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        g, c = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        if not len(g):
            return
        order = np.lexsort((c, g))
        g, c = g[order], c[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        last = np.r_[first[1:], len(g)] - 1
        summary = np.where(c[first] == c[last], c[first] | U64(1), U64(0))
        summary = np.where(first == last, summary & ~U64(1), summary)  # the lowest bit: found several times
        yield from filter(None, [_emit(0, chunk, g[first], summary, buckets)])
        u, n = np.unique(c, return_counts=True)
        yield from filter(None, [_emit(1, chunk, u, (n > 1).astype(np.uint8), buckets)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        span = None  # of row ids, with the chunks that it holds
        for batch in batches:
            spans = batch.column("rid").to_numpy(zero_copy_only=False) >> CHUNK_ROWS_LOG2
            cuts = np.r_[0, np.flatnonzero(np.diff(spans)) + 1, len(spans)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b == a:
                    continue
                if spans[a] != span:
                    for chunk, blocks in held.items():
                        yield from summaries(chunk, blocks)
                    held, span = {}, spans[a]
                rows = batch.slice(a, b - a)
                chunks = rows.column("chunk").to_numpy(zero_copy_only=False)
                for chunk in np.unique(chunks).tolist():
                    for part in by_bytes([rows.filter(pa.array(chunks == chunk))], "text", 2 << 20):
                        block = Block(part.column("text"), length)
                        held.setdefault(chunk, []).append((block.gram, block.context))
        for chunk, blocks in held.items():
            yield from summaries(chunk, blocks)

    return run


_REPLIES = "chunk long, kind int, k binary"
#: Kinds of replies: anchors that occur again with one and the same context; with several; contexts that occur again, in
#: the first chunk that has them, and in the others; windows that occur again.
SAME, SEVERAL, AGAIN_FIRST, AGAIN, WINDOWS = range(5)


def _reply(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table({"chunk": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "k": pa.array(cols[2], pa.binary())})


def _count_anchors(table: pa.Table) -> pa.Table:
    out: list[tuple] = []
    rows = sorted(zip(table.column("kind").to_pylist(), table.column("chunk").to_pylist(), table.column("k").to_pylist(), table.column("x").to_pylist(), strict=True), key=lambda r: r[:2])
    for kind in (0, 1):
        mine = [(c, np.frombuffer(k, U64), x) for t, c, k, x in rows if t == kind]
        if not mine:
            continue
        keys = np.concatenate([k for _, k, _ in mine])
        distinct, back, seen = np.unique(keys, return_inverse=True, return_counts=True)
        first = np.full(len(distinct), len(keys))
        np.minimum.at(first, back, np.arange(len(keys)))
        if kind == 0:
            x = np.concatenate([np.frombuffer(x, U64) for *_, x in mine])
            seen = seen + np.bincount(back, weights=(x & U64(1)) | (x == 0), minlength=len(distinct))
            plain = x | U64(1)
            odd = np.bincount(back, weights=(plain != plain[first][back]) | (x == 0), minlength=len(distinct)) > 0
            code = np.where(seen < 2, -1, np.where(odd, SEVERAL, SAME))[back]
        else:
            x = np.concatenate([np.frombuffer(x, np.uint8) for *_, x in mine])
            seen = seen + np.bincount(back, weights=x, minlength=len(distinct))
            code = np.where(seen[back] < 2, -1, np.where(first[back] == np.arange(len(keys)), AGAIN_FIRST, AGAIN))
        at = 0
        for chunk, k, _ in mine:
            c = code[at : at + len(k)]
            at += len(k)
            out += [(chunk, int(w), k[c == w].tobytes()) for w in np.unique(c[c >= 0])]
    return _reply(out)


def _count_windows(table: pa.Table) -> pa.Table:
    mine = [(c, np.frombuffer(k, U64), np.frombuffer(x, np.uint8)) for c, k, x in zip(table.column("chunk").to_pylist(), table.column("k").to_pylist(), table.column("x").to_pylist(), strict=True)]
    _, back, seen = np.unique(np.concatenate([k for _, k, _ in mine]), return_inverse=True, return_counts=True)
    again = (seen + np.bincount(back, weights=np.concatenate([x for *_, x in mine]), minlength=len(seen)) >= 2)[back]
    out, at = [], 0
    for chunk, k, _ in mine:
        hit = again[at : at + len(k)]
        at += len(k)
        if hit.any():
            out.append((chunk, WINDOWS, k[hit].tobytes()))
    return _reply(out)


def _told(table: pa.Table) -> dict[int, np.ndarray]:
    told: dict[int, list[np.ndarray]] = {k: [] for k in range(5)}
    for kind, k in zip(table.column("kind").to_pylist(), table.column("k").to_pylist(), strict=True):
        told[kind].append(np.frombuffer(k, U64))
    return {k: np.unique(np.concatenate(v)) if v else np.empty(0, U64) for k, v in told.items()}


def _parts(texts: pa.Table) -> Iterator[pa.RecordBatch]:
    """A chunk's rows in the order of the scan."""
    yield from by_bytes(texts.sort_by("rid").combine_chunks().to_batches(), "text", 2 << 20)


def _send_windows(length: int, buckets: int):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        told = _told(replies)
        keys, many = [], []
        first_done = np.empty(0, U64)
        if replies.num_rows and len(told[SEVERAL]):
            for part in _parts(texts):
                block = Block(part.column("text"), length)
                several = isin_sorted(block.gram, told[SEVERAL])
                again = isin_sorted(block.context, told[AGAIN_FIRST]) & ~isin_sorted(block.context, first_done)
                alone = ~isin_sorted(block.context, told[AGAIN_FIRST]) & ~isin_sorted(block.context, told[AGAIN])
                _, once = np.unique(block.context, return_index=True)
                lead = np.zeros(len(block.context), bool)
                lead[once] = True
                first_done = np.union1d(first_done, block.context[several & again])
                chosen = np.flatnonzero(several & (alone | again & lead))
                if len(chosen):
                    starts = block.window_starts(chosen)
                    # windows inside contexts that occur again are known, but others must find them: they stay candidates
                    place, multi = equal_windows(block, starts)
                    keys.append(block.rolling.at(place, place + length))
                    many.append(multi)
        if not keys:
            return pa.table({n: pa.array([], t) for n, t in (("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("k", pa.binary()), ("x", pa.binary()))})
        k, back, seen = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        multi = np.bincount(back, weights=np.concatenate(many)) + seen > 1
        chunk = texts.column("chunk")[0].as_py()
        return pa.Table.from_batches([_emit(2, chunk, k, multi.astype(np.uint8), buckets)])

    return run


_OUT = "rid long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _remove(length: int):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        told = _told(replies) if replies.num_rows else None
        cols: list[list] = [[] for _ in range(7)]
        for part in _parts(texts):
            if told is None:
                block = None
                data = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
                for rid, doc, b in zip(part.column("rid").to_pylist(), part.column("id").to_pylist(), data.to_pylist(), strict=True):
                    _put(cols, rid, doc, np.frombuffer(b, np.uint8), np.zeros(len(b), bool))
                continue
            block = Block(part.column("text"), length)
            mark = np.zeros(len(block.data) + 1, np.int32)
            full = isin_sorted(block.gram, told[SAME]) | isin_sorted(block.context, told[AGAIN_FIRST]) | isin_sorted(block.context, told[AGAIN])
            np.add.at(mark, block.start[full], 1)
            np.add.at(mark, block.end[full], -1)
            rest = np.flatnonzero(~full & isin_sorted(block.gram, told[SEVERAL]))
            if len(rest):
                starts = block.window_starts(rest)
                starts = starts[isin_sorted(block.rolling.at(starts, starts + length), told[WINDOWS])]
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + length, -1)
            gone = np.cumsum(mark[:-1]) > 0
            for rid, doc, a, b in zip(part.column("rid").to_pylist(), part.column("id").to_pylist(), block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
                _put(cols, rid, doc, block.data[a:b], gone[a:b])
        types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64())]
        names = ["rid", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})

    return run


def _put(cols: list[list], rid: int, doc: int | None, data: np.ndarray, gone: np.ndarray) -> None:
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    kept = data[~gone] if len(edges) else data
    for col, x in zip(cols, (rid, doc, len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), edges.tolist()), strict=True):
        col.append(x)


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """What to remove from each row: row_id, id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    spans holds start and end of each removed run of bytes in turn. `length` is over GRAM.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    buckets = partitions(spark)
    base = stable_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "rid")
    chunked = base.withColumn("chunk", chunk_of(F.col("rid"), F.col("text")))
    sent = chunked.select("rid", "chunk", "text").mapInArrow(_send_anchors(length, buckets), _KEYS)
    anchors = saved(sent.groupBy("bucket").applyInArrow(_count_anchors, _REPLIES), "anchors")
    windows = chunked.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_send_windows(length, buckets), _KEYS)
    again = windows.groupBy("bucket").applyInArrow(_count_windows, _REPLIES)
    removed = chunked.groupBy("chunk").cogroup(anchors.union(again).groupBy("chunk")).applyInArrow(_remove(length), _OUT)
    return removed.withColumnRenamed("rid", "row_id")
