"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has ordered grades; P(grade >= k) = logistic(w . x - theta_k) with one weight vector w for all thresholds. x
says which words, and which beginnings of words, a text holds; a feature can only raise severity (w >= 0). An L1 penalty
keeps few weights, so that scoring is a look-up of distinct words. Expected severity is the sum of the P(grade >= k).

The label table says toxic or not, so the upper grade is weakly supervised: 2 is a toxic row that holds more features
strongly associated with toxic rows than the median toxic row, 1 any other toxic row, 0 the rest.
The fit takes a bounded sample of the labelled rows (`max_train`, those with the smallest hashed ids); every row is scored.

Defined cases: a null or empty text has no features (its severity comes from the thresholds alone); rows with a null
label are not learnt from; repeated rows are scored each; without both classes all
severities are near 0; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.shared import by_bytes, release, split_words

MAX_TRAIN = 5000
WORD = regex.compile(r"\p{L}+")
HEADS = range(3, 9)
GRADES = 3
CACHE_ENTRIES = 500_000


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings of 3 to 8 letters (with a dash)."""
    return [word, *(f"{word[:n]}-" for n in HEADS if len(word) >= n)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        words = [sorted({w for w in WORD.findall((t or "").lower())}) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(words, pa.list_(pa.string()))], names=["grade", "words"])


class OrdinalModel:
    """Weights by feature, and increasing thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -50, 50)))

    def score(self, words: set[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in {f for w in words for f in features(w)})


def _able(hurt: np.ndarray, words: pa.ListArray, least_rows: int, least_odds: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the features that take part, their (row, feature) pairs, rows that are hurt by each, and odds.

    Words and beginnings of each length are numbered and counted in turn, so that no more than one sort is held at a time.
    """
    rows = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    names, row, col, inside, odds = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]
    for head in (0, *HEADS):
        own = pc.if_else(pc.greater_equal(pc.utf8_length(distinct), head), pc.utf8_slice_codeunits(distinct, 0, head), None) if head else distinct
        numbered = own.dictionary_encode()
        if not (size := len(numbered.dictionary)):
            continue
        feature = pc.fill_null(numbered.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        r, f = np.divmod(np.unique(rows[feature >= 0] * size + feature[feature >= 0]), size)
        hit = np.bincount(f, weights=hurt[r], minlength=size)
        total = np.bincount(f, minlength=size)
        ratio = (hit + 0.5) / (hurt.sum() + 1) / ((total - hit + 0.5) / ((~hurt).sum() + 1))
        chosen = np.flatnonzero((total >= least_rows) & (ratio >= least_odds))
        place = np.full(size, -1)
        place[chosen] = np.arange(len(names), len(names) + len(chosen))
        keep = place[f] >= 0
        names += [x + "-" * bool(head) for x in numbered.dictionary.take(pa.array(chosen)).to_pylist()]
        for held, new in ((row, r[keep]), (col, place[f[keep]]), (inside, hit[chosen]), (odds, ratio[chosen])):
            held.append(new)
    return names, *(np.concatenate(x) for x in (row, col, inside, odds))


def fit(toxic: np.ndarray, words: pa.ListArray, penalty: float = 0.001, kept: int = 2048, rounds: int = 300, least_rows: int = 5, least_odds: float = 8.0) -> OrdinalModel:
    """Proximal gradient descent with momentum on the negative log-likelihood, toxic and other rows weighing the same in sum, plus penalty * |w|, w >= 0.

    Features take part that are in `least_rows` rows or more and whose odds of being in a toxic row are `least_odds` or
    more; of beginnings in the same rows the shortest, and of these the `kept` most frequent.
    """
    n = len(toxic)
    hurt = toxic > 0
    share = np.where(hurt, 0.5 / max(1, hurt.sum()), 0.5 / max(1, (~hurt).sum()))  # both sides weigh the same
    none = OrdinalModel({}, np.full(GRADES - 1, 20.0))
    if not n or hurt.all() or not hurt.any():
        return none
    names, row, col, inside, odds = _able(hurt, words, least_rows, least_odds)
    able = np.arange(len(names))
    by_col = np.argsort(col, kind="stable")
    cuts = np.searchsorted(col[by_col], np.arange(len(names) + 1))
    support = {j: row[by_col[cuts[j] : cuts[j + 1]]].tobytes() for j in able.tolist()}
    alike: dict[tuple[bytes, str], int] = {}  # of a word's beginnings in the same rows the shortest says most about other words
    for j in sorted(support, key=lambda j: (len(names[j]), names[j])):
        alike.setdefault((support[j], names[j][:3]), j)
    chosen = np.array(sorted(alike.values(), key=lambda j: (-inside[j], names[j]))[:kept], np.int64)
    if not len(chosen):
        return none
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    strong = (inside[chosen] >= 2 * least_rows) & (odds[chosen] >= 2 * least_odds)
    found = np.bincount(row, weights=strong[col], minlength=n)
    grades = np.where(hurt, 1 + (found > max(1, np.median(found[hurt]))), 0)
    base = np.array([np.clip(share @ (grades >= k), 1e-4, 1 - 1e-4) for k in range(1, GRADES)])
    theta = np.log((1 - base) / base)

    def slope(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the weighted loss by score of each row, and by threshold."""
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -50, 50)))
        edges = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        steep = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        mass = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-9)
        by_score = -(steep[at, grades] - steep[at, grades + 1]) / mass * share
        by_theta = np.array([(np.where(grades == k, steep[:, k], 0) - np.where(grades == k - 1, steep[:, k], 0)) @ (share / mass) for k in range(1, GRADES)])
        return by_score, by_theta

    # a step for each weight: for 0/1 features, X'X is at most the diagonal matrix of X'X1
    step = 4 / np.maximum(1e-9, np.bincount(col, weights=(share * np.bincount(row, minlength=n))[row], minlength=len(chosen)))
    w = z = np.zeros(len(chosen))
    momentum = 1.0
    for _ in range(rounds):
        by_score, by_theta = slope(np.bincount(row, weights=z[col], minlength=n))
        moved = z - step * np.bincount(col, weights=by_score[row], minlength=len(chosen))
        new = np.maximum(moved - step * penalty, 0)
        later = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        if (z - new) @ (new - w) > 0:  # restart where momentum goes uphill
            later = 1.0
        z = new + (momentum - 1) / later * (new - w)
        w, momentum = new, later
        theta = np.maximum.accumulate(theta - 2.0 * by_theta)
    return OrdinalModel({names[j]: float(x) for j, x in zip(chosen, w, strict=True) if x}, theta)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int) -> OrdinalModel:
    sample = labels.where(f"toxic is not null and {id_col} is not null").select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("grade"))
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("grade", "text").mapInArrow(_words, "grade int, words array<string>").toArrow()  # the sample's size is bounded
    model = fit(rows.column("grade").to_numpy().astype(np.int64), pa.concat_arrays([pa.array([], pa.list_(pa.string())), *(c.cast(pa.list_(pa.string())) for c in rows.column("words").chunks)]))
    del rows
    release()
    return model


def _score(model: OrdinalModel, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(model.weights)
        number = {f: i for i, f in enumerate(names)}
        weights = np.array([model.weights[f] for f in names])
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in by_bytes(batches, "text"):
            lowered = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
            codes, distinct, offsets = split_words(lowered, lower=False)
            if len(known) > CACHE_ENTRIES:
                known.clear()
            own: list[tuple[int, ...]] = []
            for chunk in distinct:
                f = known.get(chunk)
                if f is None:
                    f = known[chunk] = tuple({number[x] for w in WORD.findall(chunk.decode().lower()) for x in features(w) if x in number})
                own.append(f)
            sizes = np.array([len(f) for f in own], np.int64)
            flat = np.array([x for f in own for x in f], np.int64)
            hit = np.flatnonzero(sizes[codes] > 0) if len(codes) else np.empty(0, np.int64)
            doc = np.searchsorted(offsets, hit, side="right") - 1
            pairs = [np.empty(0, np.int64)]
            starts = np.cumsum(sizes) - sizes
            for d, c in zip(doc.tolist(), codes[hit].tolist(), strict=True):
                pairs.append(d * max(1, len(names)) + flat[starts[c] : starts[c] + sizes[c]])
            pair = np.unique(np.concatenate(pairs))
            score = np.bincount(pair // max(1, len(names)), weights=weights[pair % max(1, len(names))] if len(pair) else None, minlength=batch.num_rows)
            p = model.at_least(score.astype(float))
            severity = p.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(severity), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(severity >= cut)], names=["id", "expected_severity", "grade", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, cut: float = 0.5) -> DataFrame:
    """id, expected_severity, grade, toxic (expected severity of `cut` or more) of every row of docs."""
    model = train(docs, labels, id_col, text_col, max_train)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_score(model, cut), "id long, expected_severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, cut: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose expected severity is below `cut`."""
    score = _score(train(docs, labels, id_col, text_col, max_train), cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col)], names=["id", "text"])
            toxic = pa.concat_arrays([b.column("toxic") for b in score(iter([texts]))])
            yield batch.filter(pc.invert(toxic))

    return docs.mapInArrow(run, docs.schema)
