"""Best-fit packing of tokenised documents into sequences of bounded length.

A document's ids come from a public tokenizer file, then an end id; documents longer than a sequence are cut into full
pieces and a rest. Packing is a bulk-synchronous best-fit:

1. Pieces of one length are interchangeable, so each task counts its own by length, and ranks within a length come from
   these counts. Runs (length, first rank, number) stand for the pieces, runs (size, first sequence, number) for the gaps;
   how many there are depends on the lengths that occur, not on the documents.
2. Pieces and gaps are range-sorted by size: one group for each of RANGES ranges of sizes.
3. In a superstep, each range sweeps the pieces it has, longest first, over its gaps: each piece takes its successor, the
   smallest gap that holds it. Where more pieces want a gap than it has room for, lower ranks win. Gaps shrink, and go to
   the range of their new size; pieces that found none go on to the next range of larger gaps. In the last range they
   open sequences. The step repeats until all pieces are placed.
4. A range's pieces begin when all longer ones have been through the ranges, as in best-fit decreasing, which the supersteps are
   exactly if there is one range. (Begun a superstep after each other, they took 1 to 3 % more sequences on the tables
   here; so they take the fewest possible.)
5. Each piece finds its run by length and rank.

Texts of Latin letters are split into words here, by the file's own pattern, and words are kept with their ids in a bounded cache;
other chunks between white space, which the tokenizer's splitting never joins, go through the whole tokenizer.

Defined cases: a null or empty text is the end id alone; white space adds no ids; repeated rows are documents of their
own; null ids are carried; pieces of one length are placed by the order of the scan; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastermill.llm.shared import by_bytes, saved, with_row_id
from rastermill.llm.token_counts import byte_letters

CACHE_ENTRIES = 500_000
RANGES = 4
PART = 1 << 18
# The splitting pattern that the word pattern below says again for Latin-1 texts, and the normalisers it allows for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'(?:[stmd]|re|ve|ll)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa00-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
GAP = re.compile("[\t-\r ]+")
_ENCODERS: dict[str, Encoder] = {}


class Cache(dict):
    """Ids by word or chunk as little-endian 32-bit bytes; the less lately used half goes when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(key)
        if ids is None:
            ids = np.array(self.encode(key), "<u4").tobytes()
        self[key] = ids
        return ids


class Encoder:
    """Ids of texts by a `tokenizers` file; one per worker process and file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        specials = [re.escape(t["content"]) for t in steps["added_tokens"]]
        self.special = re.compile("|".join(specials) or "(?!)")
        split = steps["pre_tokenizer"]["pretokenizers"][0]
        names = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        self.plain = names == NORMALIZERS and split["type"] == "Split" and split["invert"] and split["pattern"].get("Regex") == SPLIT
        letter = {b: c for c, b in byte_letters().items()}
        spelt = lambda w: w if w.isascii() and w.isprintable() else "".join(letter[b] for b in w.encode())
        self.words = Cache(lambda w: [t.id for t in self.tokenizer.model.tokenize(spelt(w))])
        self.chunks = Cache(lambda c: self.tokenizer.encode(c, add_special_tokens=False).ids)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self._part(p) for p in parts(text))

    def _part(self, text: str) -> bytes:
        if self.plain and latin(text):
            return b"".join(map(self.words.__getitem__, WORD.findall(text.lower())))
        found = []
        for chunk in GAP.split(text):
            if self.plain and latin(chunk):
                found.extend(map(self.words.__getitem__, WORD.findall(chunk.lower())))
            elif chunk:
                found.append(self.chunks[chunk])
        return b"".join(found)


def latin(text: str) -> bool:
    """Whether all characters are Latin-1, which are as normal as they get."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, cut at white space."""
    at = 0
    while len(text) - at > PART:
        gap = GAP.search(text, at + PART)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


_PIECES = "chunk long, rid long, id long, piece int, start long, length long, ids_crc32 long, rank_here long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _cut(path: str, end_id: int, capacity: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        chunk, encoder = None, Encoder.of(path)
        for batch in by_bytes(batches, "text"):
            cols: list[list] = [[] for _ in names]
            kept = []
            for rid, doc, text in zip(batch.column("rid").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True):
                chunk = rid if chunk is None else chunk
                ids = memoryview(encoder.ids(text.as_py() or "") + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    mine = ids[at : at + 4 * capacity]
                    size = len(mine) // 4
                    for col, x in zip(cols, (chunk, rid, doc, piece, at // 4, size, zlib.crc32(mine), seen[size]), strict=True):
                        col.append(x)
                    seen[size] += 1
                    if keep_ids:
                        kept.append(np.frombuffer(mine, "<u4").astype(np.int32))
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=names)
            yield found.append_column("ids", pa.array(kept, pa.list_(pa.int32()))) if keep_ids else found

    return run


# --- supersteps: runs of pieces, gaps and placements, and how many sequences are open

PIECE, GAPS, PLACED, OPENED = range(4)
#: Runs (kind, size, first, n, sequence, offset) go between supersteps in one row for each range that they come from and go to.
_STATE = "range int, runs array<array<bigint>>"
NOWHERE = -1
Run = tuple[int, int, int, int, int, int]


def upper_bounds(capacity: int, ranges: int) -> list[int]:
    """The greatest size of each range; each is twice as wide as the one below."""
    return sorted({max(1, capacity >> k) for k in range(ranges)})


def begins(k: int) -> int:
    """The superstep in which the k-th range from the top begins: all longer pieces have been through theirs."""
    return k * (k + 1) // 2


def sweep(here: int, runs: list[Run], bounds: list[int], capacity: int, step: int) -> list[tuple[int, Run]]:
    """One range's part of a superstep: the runs that come out of it, each with the range where it belongs next."""
    last = len(bounds) - 1
    out, pieces, opened = [], [], None
    gaps: dict[int, deque[tuple[int, int]]] = {}  # size: runs of sequences (first, end)
    sizes: list[int] = []

    def put(size: int, first: int, end: int) -> None:
        if size:
            if size not in gaps:
                bisect.insort(sizes, size)
            gaps.setdefault(size, deque()).append((first, end))

    for run in sorted(runs, key=lambda r: (-r[1], r[2])):
        kind, size, first, n, _, _ = run
        if kind == GAPS:
            put(size, first, first + n)
        elif kind == OPENED:
            opened = n
        elif begins(last - bisect.bisect_left(bounds, size)) > step:
            out.append((here, run))
        else:
            pieces.append((size, first, n))
    for length, rank, left in pieces:
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                if here < last:
                    out.append((here + 1, (PIECE, length, rank, left, 0, 0)))
                    break
                more = -(-left // (capacity // length))
                put(capacity, opened, opened + more)
                opened += more
                continue
            size = sizes[at]
            first, end = gaps[size].popleft()
            each = min(left, size // length)  # a gap that has taken one is the smallest that holds the next
            taken = min(left // each, end - first)
            out += [(NOWHERE, (PLACED, length, rank + i * taken, taken, first, capacity - size + i * length)) for i in range(each)]
            if first + taken < end:
                gaps[size].appendleft((first + taken, end))
            elif not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            put(size - each * length, first, first + taken)
            rank, left = rank + each * taken, left - each * taken
    out += [(bisect.bisect_left(bounds, size), (GAPS, size, first, end - first, 0, 0)) for size, held in gaps.items() for first, end in held]
    if opened is not None:
        out.append((here, (OPENED, 0, 0, opened, 0, 0)))
    return out


def _step(bounds: list[int], capacity: int, step: int):
    def run(table: pa.Table) -> pa.Table:
        by: dict[int, list[Run]] = defaultdict(list)
        for to, own in sweep(table.column("range")[0].as_py(), [r for rows in table.column("runs").to_pylist() for r in rows], bounds, capacity, step):
            by[to].append(own)
        return pa.table({"range": pa.array(list(by), pa.int32()), "runs": pa.array(list(by.values()), pa.list_(pa.list_(pa.int64())))})

    return run


def supersteps(lengths: DataFrame, capacity: int, ranges: int = RANGES) -> DataFrame:
    """Placements (size, first, n, sequence, offset) of the pieces counted in lengths (length, n): rank first + i of a length
    stands in sequence + i, at the offset."""
    bounds = upper_bounds(capacity, ranges)
    home = sum(((F.col("length") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    run = F.array(*(x.cast("long") for x in (F.lit(PIECE), F.col("length"), F.lit(0), F.col("n"), F.lit(0), F.lit(0))))
    state = lengths.select(home.alias("range"), run.alias("run")).groupBy("range").agg(F.collect_list("run").alias("runs"))
    state = state.union(lengths.sparkSession.createDataFrame([(len(bounds) - 1, [[OPENED, 0, 0, 0, 0, 0]])], _STATE))
    placed = None
    for step in range(begins(len(bounds))):  # those of the last range to begin, and as many as there are ranges
        done = saved(state.groupBy("range").applyInArrow(_step(bounds, capacity, step), _STATE), "superstep")
        found = done.where(F.col("range") == NOWHERE).select(F.explode("runs").alias("run"))
        placed = found if placed is None else placed.union(found)
        state = done.where(F.col("range") != NOWHERE)
    return placed.select(*[F.element_at("run", i).alias(n) for i, n in enumerate(("size", "first", "n", "sequence", "offset"), 2)])


def pack_sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, ranges: int = RANGES) -> DataFrame:
    """One row per piece: row_id, id, piece, start, length, ids_crc32, sequence_id, offset, and ids if wished.

    `tokenizer` is the path of a `tokenizers` file that every executor has; its chunks must not cross ASCII white space.
    """
    base = with_row_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "rid")
    pieces = saved(base.mapInArrow(_cut(tokenizer, end_id, capacity, keep_ids), _PIECES + (", ids array<int>" if keep_ids else "")), "pieces")
    here = saved(pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")), "counts")
    runs = supersteps(here.groupBy("length").agg(F.sum("n").alias("n")), capacity, ranges).toArrow()
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = here.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(before.hint("merge"), ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("rank_here")).drop("base", "rank_here", "chunk")
    return _placed(ranked, runs).withColumnRenamed("rid", "row_id")


def _placed(ranked: DataFrame, runs: pa.Table) -> DataFrame:
    """Each piece's sequence and offset; the runs (their number depends on the lengths, not on the documents) go with the tasks."""
    runs = runs.sort_by([("size", "ascending"), ("first", "ascending")])
    size, first, sequence, offset = (runs.column(c).to_numpy() for c in ("size", "first", "sequence", "offset"))
    keep = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = np.searchsorted(size, np.arange(int(size[-1]) + 2)) if len(size) else None
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(own):
                    a, b = heads[lengths[own[0]]], heads[lengths[own[0]] + 1]
                    at[own] = a + np.searchsorted(first[a:b], ranks[own], side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence[at] + ranks - first[at]), pa.array(offset[at])], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)
