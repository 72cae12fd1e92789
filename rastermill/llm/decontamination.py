"""Benchmark decontamination by latent semantic retrieval.

1. Every whole text is written once as numbers of the benchmark's words. Texts are cut into segments of words; a passage
   is two neighbouring segments. The words' counts over the whole corpus give the weights (tf-idf).
2. A randomised SVD finds the latent space: every segment of the corpus is added, with a random sign, to one of 2 x `rank`
   random sums (a sparse test matrix S, drawn by hashing the segment's place), in the pass that counts the words. The counts
   are whole numbers, so that neither order nor dealing matters; blocks of them are added in a shuffle. The driver, which
   holds matrices of vocabulary x rank only, weighs them to S A, takes its leading right singular vectors and adds the
   directions of the benchmark's own rows, `rank` items to a space, so that every item lies in it.
3. For the search, segments are about half an item long, so that three of them hold any verbatim copy. Each passage's latent
   vector meets the benchmark's. A cosine of `cosine` or more over three segments, and 2 x `segment` words at least, makes a
   candidate with its surroundings. The passage's norm counts all its words, those outside the benchmark as its mean word;
   every word has some weight, however frequent. Three segments are a candidate too, whatever their cosine, if they score as
   much as the lightest `ratio` of the item's words: no less can hold a match, so that this test loses none.
4. A candidate stands if the longest common subsequence of the item's words and the candidate's reaches `sure` of the item,
   or `ratio` of it while `answer` of the item's closing words (its answer) are found in order too. Of items of fewer than
   `segment` words, whose parts are found by chance, all words in order are needed where the cosine is low.

Benchmark items are taken in sets of `item_set`, one set on the driver at a time; `rank` of its items are searched at once.

Defined cases: null or empty texts and items without words match nothing; a document shorter than a passage is one
passage; documents that repeat are matched each; an item with several texts is matched by each of them and
given once for a document, with its best match; null ids of documents are carried, items with a null id are left out; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.shared import U64, by_bytes, mix, saved, scratch, split_words, stable_rows

SEGMENT = 20
RANK = 256
ITEM_SET = 2048
CACHE_ENTRIES = 500_000
#: Numbers that a task gathers at once from the rows of a matrix, and bytes of cosines that it holds for a slice of texts.
GATHERED = 4 << 20
COSINE_BYTES = 32 << 20
_MARKS = regex.compile(r"[^\p{L}\p{N}]+")
#: Of what stands between white space: -1 is a word that no item has, -2 no word at all.
OTHER, NOTHING = -1, -2


def plain(chunk: str) -> str:
    """A word without case and marks."""
    return _MARKS.sub("", chunk.lower())


def coded_words(texts: pa.Array, vocabulary: dict[str, int], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers of all words of the texts (OTHER if not there), and row offsets."""
    codes, distinct, offsets = split_words(pc.fill_null(texts, ""), lower=True)
    if len(known) > CACHE_ENTRIES:
        known.clear()
    per = np.empty(len(distinct), np.int32)
    for i, chunk in enumerate(distinct):
        v = known.get(chunk)
        if v is None:
            word = plain(chunk.decode())
            v = known[chunk] = vocabulary.get(word, OTHER) if word else NOTHING
        per[i] = v
    words = per[codes]
    keep = words != NOTHING
    return words[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _segments(words: np.ndarray, offsets: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the segment of each word, and the text of each segment."""
    sizes = np.diff(offsets)
    per = -(-sizes // segment)
    base = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return base[doc] + (np.arange(len(words)) - offsets[doc]) // segment, np.repeat(np.arange(len(sizes)), per)


def _places(a: list[int]) -> dict[int, int]:
    """Bits of the places of each word."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def _lcs(masks: dict[int, int], size: int, b: list[int]) -> int:
    full = (1 << size) - 1
    v = full
    for y in b:
        m = masks.get(y)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def lcs(a: list[int], b: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel); b may hold OTHER, which matches nothing."""
    return _lcs(_places(a), len(a), b.tolist())


def step_of(n: int) -> int:
    """Words in a segment for items of n words: the least of 1, 2, 3, 4, 6, 8, 12, ... that is half of them."""
    low = 1 << max(0, (n + 1) // 2 - 1).bit_length()
    return low * 3 // 4 if low >= 4 and low * 3 // 4 * 2 >= n else low


@dataclass
class Group:
    """Items that are searched with the same segments; `place` gives the row of a word in `weighted`, -1 if none has it."""

    step: int
    items: np.ndarray
    place: np.ndarray
    weighted: np.ndarray
    cuts: np.ndarray


@dataclass
class Space:
    """What a task needs: weights of words (`outside` for those of no item), latent directions, the items' words and latent unit vectors."""

    idf: np.ndarray
    outside: float
    directions: np.ndarray
    items: list[tuple[int, list[int]]]
    latent: np.ndarray
    segment: int
    cosine: float
    ratio: float
    sure: float
    answer: float


def _code(vocabulary: dict[str, int]):
    """Each text as numbers of its words; 16 bits do for a small vocabulary."""
    kind = "<i2" if len(vocabulary) < 1 << 15 else "<i4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in by_bytes(batches, "text"):
            words, offsets = coded_words(batch.column("text"), vocabulary, known)
            words = words.astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([words[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], names=["id", "words"]).append_column("row", batch.column("row"))

    return run


def _decoded(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch of coded texts, and row offsets."""
    column = batch.column("words")
    kind = "<i2" if size < 1 << 15 else "<i4"
    words = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int32)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    return words, np.r_[0, np.cumsum(sizes)]


def _counts(size: int, segment: int, width: int, seed: int):
    """Of this task's segments, in blocks of words: how often each word occurs, and the signed sums of its counts; block -1 holds the number of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(size, np.int64), 0
        sums = np.zeros(size * width, np.int32)
        for batch in by_bytes(batches, "words", 1 << 20):
            words, offsets = _decoded(batch, size)
            number, text = _segments(words, offsets, segment)
            total += len(text)
            first = np.searchsorted(text, np.arange(batch.num_rows))
            rows = batch.column("row").to_numpy(zero_copy_only=False).astype(U64)
            drawn = mix(mix(rows + U64(seed))[text] + (np.arange(len(text)) - first[text]).astype(U64))
            place, sign = (drawn % U64(width)).astype(np.int64), 1 - 2 * (drawn >> U64(63)).astype(np.int32)
            keep = words >= 0
            words, number = words[keep].astype(np.int64), number[keep]
            seen += np.bincount(words, minlength=size)
            np.add.at(sums, words * width + place[number], sign[number])
        used, table = np.flatnonzero(seen), sums.reshape(size, width)
        yield _counted([-1], [total], [b""], -1)
        for part in np.array_split(used, max(1, len(used) // 256)):
            if len(part):
                yield _counted(part, seen[part], [r.tobytes() for r in table[part]], part // 256)

    return run


def _counted(words, n, rows: list[bytes], block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(block, len(rows)).astype(np.int32)), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], names=["block", "word", "n", "row"])


def _rows_times(number: np.ndarray, words: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the matrix rows of the words, per number that occurs (numbers ascend)."""
    heads = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    bounds, most = np.r_[heads, len(words)], GATHERED // matrix.shape[1]
    sums, at = np.empty((len(heads), matrix.shape[1]), matrix.dtype), 0
    while at < len(heads):  # a bounded part of the words' rows at a time, one number at least
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        np.add.reduceat(matrix[words[bounds[at] : bounds[to]]], heads[at:to] - bounds[at], axis=0, out=sums[at:to])
        at = to
    return number[heads], sums


def _add_rows(table: pa.Table) -> pa.Table:
    words, back = np.unique(table.column("word").to_numpy(), return_inverse=True)
    n, rows = np.zeros(len(words), np.int64), table.column("row").to_pylist()
    np.add.at(n, back, table.column("n").to_numpy())
    total = np.zeros((len(words), len(rows[0]) // 4), np.int64)
    for i, blob in zip(back.tolist(), rows, strict=True):
        total[i] += np.frombuffer(blob, np.int32)
    return pa.table({"word": pa.array(words), "n": pa.array(n), "row": pa.array([r.astype(np.float32).tobytes() for r in total], pa.binary())})


def leading_directions(sketch: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of S A, which is given as its transpose (vocabulary x sums)."""
    values, vectors = np.linalg.eigh(sketch.T @ sketch)
    good = np.flatnonzero(values > 1e-9 * max(values.max(initial=0), 1e-12))[::-1][:rank]
    return sketch @ (vectors[:, good] / np.sqrt(values[good]))


class Searcher:
    """Finds a space's items in coded texts."""

    def __init__(self, space: Space):
        self.space = space
        self.square = np.r_[space.idf**2, space.outside**2]  # the last for words of no item
        self.endings = [words[-max(3, len(words) // 4) :] for _, words in space.items]
        self.masks = [(_places(words), _places(ending)) for (_, words), ending in zip(space.items, self.endings, strict=True)]
        weighted = (space.idf[:, None] * space.directions) @ space.latent.T
        steps = np.array([step_of(len(words)) for _, words in space.items])
        self.groups = []
        for step in np.unique(steps).tolist():
            own = np.flatnonzero(steps == step)
            used = np.unique(np.concatenate([space.items[j][1] for j in own.tolist()]))
            place = np.full(len(space.idf) + 1, -1, np.int32)
            place[used] = np.arange(len(used))
            cuts = [self._least(weighted[space.items[j][1], j]) for j in own.tolist()]
            self.groups.append(Group(step, own, place, weighted[np.ix_(used, own)].astype(np.float32), np.array(cuts, np.float32)))
        #: Words of a slice, so that its cosines with all items of a group are bounded.
        self.most = min(1 << 17, max(1 << 10, min(COSINE_BYTES // 16 * g.step // len(g.items) for g in self.groups)))

    def _least(self, weights: np.ndarray) -> float:
        """The least that a passage scores which holds as much of the item as any match needs, whichever of its words those are."""
        k = int(np.ceil(min(self.space.ratio, self.space.sure) * len(weights) - 1e-9))
        return 0.999 * float(np.sort(weights)[:k].sum())

    def matches(self, words: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, place of the item) -> share, cosine and share of the answer of its best passage."""
        best = {}
        if len(words):
            for group in self.groups:
                self._of_group(group, words, offsets, best)
        return best

    def _of_group(self, group: Group, words: np.ndarray, offsets: np.ndarray, best: dict[tuple[int, int], tuple[float, float, float]]) -> None:
        space, step = self.space, group.step
        number, text = _segments(words, offsets, step)
        row = group.place[words]
        inside = row >= 0
        if not inside.any():
            return
        found, dots = _rows_times(number[inside], row[inside], group.weighted)
        wide = max(3, -(-2 * space.segment // step))  # segments of a passage for the cosine
        both, held = dots.copy(), None
        for k in range(1, wide):
            beside = np.minimum(np.searchsorted(found, found + k), len(found) - 1)
            joins = np.flatnonzero((found[beside] == found + k) & (text[found[beside]] == text[found]))
            both[joins] += dots[beside[joins]]
            if k == 2:
                held = both >= group.cuts
        mass = np.r_[0, np.cumsum(np.bincount(number, weights=self.square[words], minlength=len(text)))]
        last = np.minimum(found + wide, np.searchsorted(text, text[found], side="right"))
        norm = np.sqrt(np.maximum(mass[last] - mass[found], 1e-9)).astype(np.float32)
        at, item = np.nonzero((both >= (space.cosine * norm)[:, None]) | held)
        first = np.searchsorted(text, np.arange(len(offsets)))
        near = (both[at, item] / norm[at]).tolist()
        at, item = found[at], group.items[item]
        for p, j, cosine in zip(at.tolist(), item.tolist(), near, strict=True):
            doc = int(text[p])
            n = len(space.items[j][1])
            start, end = int(offsets[doc]), int(offsets[doc + 1])
            a = start + (p - int(first[doc])) * step
            b = a + 3 * step
            if looked := cosine >= space.cosine:  # near enough to look around the passage too
                a, b = a - n, a + wide * step + n
            region = words[max(a, start) : min(b, end)].tolist()
            masks, ending = self.masks[j]
            share = _lcs(masks, n, region) / n
            if share < (min(space.sure, space.ratio) if looked or n >= space.segment else 1):
                continue
            answered = _lcs(ending, len(self.endings[j]), region) / len(self.endings[j])
            if share >= space.sure or share >= space.ratio and answered >= space.answer:
                found_row = (share, cosine, answered)
                if (doc, j) not in best or found_row > best[doc, j]:
                    best[doc, j] = found_row


def _search(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(space)
        for batch in by_bytes(batches, "words", searcher.most * 2):
            if best := searcher.matches(*_decoded(batch, len(space.idf))):
                ids, places = batch.column("id").to_pylist(), batch.column("row").to_pylist()
                rows = [(ids[d], space.items[j][0], c, s, n, places[d]) for (d, j), (s, c, n) in best.items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "item_id", "cosine", "lcs_share", "answer_share", "row"])

    return run


def _without(space: Space, vocabulary: dict[str, int], text_col: str):
    """The rows whose text holds none of the items; texts are coded again here, so that none is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, known = Searcher(space), {}
        for batch in by_bytes(batches, text_col, searcher.most * 8):
            best = searcher.matches(*coded_words(batch.column(text_col), vocabulary, known))
            clean = np.ones(batch.num_rows, bool)
            clean[[doc for doc, _ in best]] = False
            yield batch.filter(pa.array(clean))

    return run


_FOUND = "id long, item_id long, cosine double, lcs_share double, answer_share double"


def build_spaces(coded: DataFrame, items: list[tuple[int, list[int]]], size: int, rank: int, segment: int, seed: int, **cuts: float) -> Iterator[Space]:
    """The latent spaces of these items, for `rank` items each; coded: words, row (unique numbers, alike in every job)."""
    width = 2 * min(rank, size)
    counted = coded.select("words", "row").mapInArrow(_counts(size, segment, width, seed), "block int, word long, n long, row binary")
    seen, total = np.zeros(size, np.int64), 0
    sketch = np.zeros((size, width))
    for r in counted.groupBy("block").applyInArrow(_add_rows, "word long, n long, row binary").collect():  # a row for each word of the items
        if r["word"] < 0:
            total = r["n"]
        else:
            seen[r["word"]], sketch[r["word"]] = r["n"], np.frombuffer(r["row"], np.float32)
    idf = np.log((1 + total) / (1 + np.minimum(seen, total))) + 0.05
    outside = float(np.sqrt(np.mean(idf**2)))  # as a word of the benchmark, so that it doesn't grow with the corpus
    leading = leading_directions(sketch * idf[:, None], min(rank, size))
    for at in range(0, len(items), rank):
        part = items[at : at + rank]
        own = np.zeros((len(part), size))
        for k, (_, words) in enumerate(part):
            np.add.at(own[k], words, idf[words])
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        directions = np.linalg.qr(np.hstack([own.T, leading]))[0]  # every item lies in their span, whatever the rank
        yield Space(idf, outside, directions, part, own @ directions, segment, **cuts)


def _spaces(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK, segment: int = SEGMENT, cosine: float = 0.3, ratio: float = 0.6, sure: float = 0.75, answer: float = 0.6, item_set: int = ITEM_SET, seed: int = 7) -> Iterator[tuple[DataFrame, Space, dict[str, int]]]:
    """For each set of items, and each `rank` of its items: the coded texts (id, words), the space and the vocabulary."""
    base = stable_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "row")
    wanted = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    rows = wanted.orderBy("item", "text").limit(item_set).collect()
    while rows:
        vocabulary: dict[str, int] = {}
        items = []
        for r in rows:
            if words := [p for w in r["text"].split() if (p := plain(w))]:
                items.append((r["item"], [vocabulary.setdefault(w, len(vocabulary)) for w in words]))
        if items:
            coded = saved(base.mapInArrow(_code(vocabulary), "id long, words binary, row long"), "coded")
            for space in build_spaces(coded, items, len(vocabulary), rank, segment, seed, cosine=cosine, ratio=ratio, sure=sure, answer=answer):
                yield coded, space, vocabulary
        item, text = F.lit(rows[-1]["item"]), F.lit(rows[-1]["text"])
        later = (F.col("item") > item) | (F.col("item") == item) & (F.col("text") > text)
        rows = wanted.where(later).orderBy("item", "text").limit(item_set).collect() if len(rows) == item_set else []


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: id, item_id, cosine, lcs_share, answer_share. Options: see _spaces."""
    spark = docs.sparkSession
    path, parts = scratch(spark, "contaminated"), []
    for coded, space, _ in _spaces(docs, benchmark, id_col, text_col, **options):
        parts.append(f"{path}/part={len(parts)}")
        coded.mapInArrow(_search(space), f"{_FOUND}, row long").write.parquet(parts[-1])
    if not parts:
        return spark.createDataFrame([], _FOUND)
    rows = spark.read.schema(f"{_FOUND}, row long").parquet(*parts)  # an item's texts can match the same row
    best = rows.groupBy("row", "item_id").agg(F.max(F.struct("lcs_share", "cosine", "answer_share", "id")).alias("best"))
    return best.select("best.id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item. text_col must be a string. Options: see _spaces."""
    kept = docs
    for _, space, vocabulary in _spaces(docs, benchmark, id_col, text_col, **options):
        kept = kept.mapInArrow(_without(space, vocabulary, text_col), docs.schema)
    return kept
