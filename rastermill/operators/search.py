"""Palette search (QNT2 to QNT6, QNT11): median cuts of a histogram whose weights are fed back, then k-means, for all images at once.

An image's state is one row: its histogram (colours as premultiplied gamma floats, weight and adjusted weight), the best palette so far, its
error, and the budget of trials that is left. A superstep lets each image that has budget do some trials and writes the states to the shared folder; images
whose budget has ended leave the loop. A lost executor so costs one superstep of its images. A row's size is bounded by the histogram's cap
(HIST3), at four bits a channel by 65,536 colours of 48 bytes. Within a task, images are searched side by side, SIDE_BY_SIDE colours at once (one
image at least): each numpy step does the n-th split, or the n-th k-means step, of all of them.

Colours are rows (a, r, g, b) of float64 throughout, in ascending order of their packed bytes, so that equal keys have one order.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.functions import pixels as px
from rastermill.operators import colours
from rastermill.sources.scratch import spread, written

C = F.col
#: No limit on an error.
ANY_ERROR = 1e20
#: Colours of the images that are searched side by side, and distances that are held at once.
SIDE_BY_SIDE, TABLE = 1 << 15, 1 << 16
# Sixteenths of the channels a, r, g, b in a box's variance, and the differences below which they count a quarter.
SHARES = np.array([4, 7, 9, 5]) / 16
SMALL = np.array([2, 1, 1, 1]) / 256


@dataclasses.dataclass(frozen=True)
class Options:
    """QNT11. speed 1 to 10; quality 0 to 100 (least, wanted), None for no limit; colours 2 to 256; posterize 0 to 4 bits; dither 0 to 1."""

    speed: int = 1
    quality: tuple[int, int] | None = None
    colours: int = 16
    posterize: int = 4
    dither: float = 1.0
    gamma: float = px.DISPLAY_GAMMA
    last_index_transparent: bool = False

    def __post_init__(self) -> None:
        low, wanted = self.quality or (0, 100)
        for what, fine in (
            ("speed", 1 <= self.speed <= 10), ("quality", 0 <= low <= wanted <= 100), ("colours", 2 <= self.colours <= 256), ("posterize", 0 <= self.posterize <= 4),
            ("dither", 0 <= self.dither <= 1), ("gamma", 0 < self.gamma < 1),
        ):
            if not fine:
                raise ValueError(f"{what} is out of range")

    @property
    def trials(self) -> int:
        return max(0, 56 - 9 * self.speed)

    @property
    def iterations(self) -> int:
        n = max(0, 8 - self.speed)
        return n + n * n // 2

    @property
    def least_gain(self) -> float:
        return 2.0 ** (self.speed - 23)

    @property
    def most_entries(self) -> int:
        return (1 << 17) + (1 << 18) * (10 - self.speed)

    @property
    def uses_contrast(self) -> bool:
        return self.speed <= 7

    @property
    def target_mse(self) -> float:
        return px.quality_limit(self.quality[1]) if self.quality else 0.0

    @property
    def max_mse(self) -> float:
        return px.quality_limit(self.quality[0]) if self.quality else ANY_ERROR


def lessened(budget: int, size: int) -> int:
    """A number of trials or rounds, three quarters (rounded up) of it for each step of size that the histogram exceeds."""
    for step in (5_000, 25_000, 50_000, 100_000):
        budget = (3 * budget + 3) // 4 if size > step else budget
    return budget


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """PX13 of rows of p and q, broadcast over all but the last axis."""
    black = p[..., 1:] - q[..., 1:]
    white = black + (q[..., :1] - p[..., :1])
    return np.maximum(black * black, white * white).sum(axis=-1)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """PX13 of arrays whose first axis is the channel."""
    more, out = q[0] - p[0], 0.0
    for c in (1, 2, 3):
        black = p[c] - q[c]
        white = black + more
        out = out + np.maximum(black * black, white * white)
    return out


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs of n from first on, one run after the other."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Colours:
    """Colours of images, one image after the other: floats by channel (4 x colours), weights, and how many each image has (one at least)."""

    def __init__(self, f: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        self.f, self.p, self.n = f, p, n
        self.starts = np.cumsum(n) - n
        self.image = np.repeat(np.arange(len(n)), n)
        self.total = np.add.reduceat(p, self.starts) if len(n) else np.zeros(0)

    def places(self, images: np.ndarray) -> np.ndarray:
        return spans(self.starts[images], self.n[images])

    def of(self, images: np.ndarray) -> Colours:
        at = self.places(images)
        return Colours(self.f[:, at], self.p[at], self.n[images])

    def nearest(self, palettes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """NN2: index (lowest on ties) and PX13 of the nearest entry of the image's palette, in slices of bounded size."""
        at, d = np.empty(len(self.p), np.int64), np.empty(len(self.p))
        entries, most = np.ascontiguousarray(palettes.transpose(2, 0, 1)), max(1, TABLE // palettes.shape[1])
        for i in range(0, len(at), most):
            table = _apart(self.f[:, i : i + most, None], entries[:, self.image[i : i + most]])
            at[i : i + len(table)] = found = table.argmin(axis=1)
            d[i : i + len(table)] = table[np.arange(len(table)), found]
        return at, d


def _boxes(f: np.ndarray, p: np.ndarray, w: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of runs of colours: mean (4 x runs), variance (4 x runs), worth of a split as long as no colour is worse than the limit (none for a single colour), worst and total error."""
    run = np.repeat(np.arange(len(n)), n)
    weight = np.add.reduceat(w, starts)
    mean = np.divide(np.add.reduceat(f * w, starts, axis=1), weight, out=np.zeros((4, len(n))), where=weight != 0)
    off = (f - mean[:, run]) ** 2
    variance = np.add.reduceat(w * np.where(off < SMALL[:, None] ** 2, off / 4, off), starts, axis=1) * SHARES[:, None]
    miss = _apart(mean[:, run], f)
    return mean, variance, np.where(n > 1, weight * variance.max(axis=0), 0.0), np.maximum.reduceat(miss, starts), np.add.reduceat(miss * p, starts)


def _cut(f: np.ndarray, w: np.ndarray, variance: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which colours of each run go to the first half: those of the greatest keys (ties to the earlier colour), up to where half of the weight times distance from the median is passed; and how many."""
    run = np.repeat(np.arange(len(n)), n)
    lead = np.argsort(-variance, axis=0, kind="stable")[:, run]
    own = np.take_along_axis(f, lead, axis=0)
    minor = own[2] + own[1] / 2 + own[3] / 4
    key = (own[0] * 65535).astype(np.int64) << 16 | (minor * 65535).astype(np.int64)
    order = np.argsort(run << 34 | (1 << 34) - 1 - key, kind="stable")
    f, w = f[:, order], w[order]
    low, high = starts + (n - 1) // 2, starts + n // 2
    w_low, w_high = w[low], np.where(high > low, w[high], 0.0)
    total = w_low + w_high
    median = np.divide(w_low * f[:, low] + w_high * f[:, high], total, out=np.zeros((4, len(n))), where=total != 0)
    own_weight = split_weight(_apart(median[:, run], f), w)
    sums = np.cumsum(own_weight)
    sums -= (sums[starts] - own_weight[starts])[run]
    passed = np.add.reduceat((sums <= (sums[starts + n - 1] / 2)[run]).astype(np.int64), starts)
    cut = np.minimum(n - 1, passed + 1)
    first = np.empty(len(order), bool)
    first[order] = np.arange(len(order)) - starts[run] < cut[run]
    return first, cut


def split_weight(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a colour counts in a split, in whole units of 10^-9, so that sums don't depend on their order."""
    return np.floor(np.sqrt(d) * (np.sqrt(1 + w) - 1) * 1e9 + 0.5).astype(np.int64)


@dataclasses.dataclass
class Boxes:
    """Images x boxes; number: boxes of an image; of: the box of each colour."""

    number: np.ndarray
    mean: np.ndarray
    colours: np.ndarray
    popularity: np.ndarray
    error: np.ndarray
    of: np.ndarray


def median_cuts(own: Colours, w: np.ndarray, size: np.ndarray, target: np.ndarray, limit: np.ndarray) -> Boxes:
    """QNT5 for all images: splits the best box until there are `size`, none can be split, or the boxes' error is at most the target (a mean, weighted by p).

    A box with a colour that is worse than the limit, which rises with the number of boxes, wins by its excess.
    """
    images, most = len(own.n), max(1, int(size.max(initial=1)))
    shape = (images, most)
    worth, worst, errors, mean, variance = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros((4, *shape)), np.zeros((4, *shape))
    starts, count = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    starts[:, 0], count[:, 0] = own.starts, own.n
    mean[:, :, 0], variance[:, :, 0], worth[:, 0], worst[:, 0], errors[:, 0] = _boxes(own.f, own.p, w, own.starts, own.n)
    order, number, enough = np.arange(len(own.p)), np.ones(images, np.int64), target * own.total
    left = np.flatnonzero(size > 1)
    for n in range(1, most):
        scores = worth[left, :n] * np.maximum(1.0, worst[left, :n] / (limit[left] * (1 + 16 * n / size[left]))[:, None])
        at = scores.argmax(axis=1)
        splits = scores[np.arange(len(left)), at] > 0
        left, at = left[splits], at[splits]
        if not len(left):
            break
        places, had = spans(starts[left, at], count[left, at]), count[left, at]
        members, begin = order[places], np.cumsum(had) - had
        first, cut = _cut(own.f[:, members], w[members], variance[:, left, at], begin, had)
        run = np.repeat(np.arange(len(had)), had)
        ahead = np.cumsum(first) - first
        ahead -= ahead[begin][run]  # members of the first half before this one; both halves keep the order of colours
        to = begin[run] + np.where(first, ahead, cut[run] + np.arange(len(run)) - begin[run] - ahead)
        halves = np.empty_like(members)
        halves[to] = members
        order[places] = halves
        sizes = np.stack([cut, had - cut], axis=1).ravel()
        made = _boxes(own.f[:, halves], own.p[halves], w[halves], np.cumsum(sizes) - sizes, sizes)
        starts[left, n], count[left, n], count[left, at] = starts[left, at] + cut, had - cut, cut
        for i, b in ((0, at), (1, n)):
            mean[:, left, b], variance[:, left, b] = made[0][:, i::2], made[1][:, i::2]
            worth[left, b], worst[left, b], errors[left, b] = (m[i::2] for m in made[2:])
        number[left] = n + 1
        left = left[(errors[left].sum(axis=1) > enough[left]) & (size[left] > n + 1)]
    used = np.arange(most) < number[:, None]
    of = np.empty(len(order), np.int64)
    of[order[spans(starts[used], count[used])]] = np.repeat(np.nonzero(used)[1], count[used])
    popularity = np.bincount(own.image * most + of, weights=own.p, minlength=images * most).reshape(shape)
    return Boxes(number, mean.transpose(1, 2, 0), count, popularity, errors, of)


@dataclasses.dataclass
class Palette:
    colours: np.ndarray
    popularity: np.ndarray
    fixed: int = 0  # the last ones

    def with_fixed(self, own: np.ndarray, most: int) -> Palette:
        free = max(0, min(len(self.colours), most - len(own)))
        own = own[:most]
        return Palette(np.concatenate([self.colours[:free], own]), np.concatenate([self.popularity[:free], np.zeros(len(own))]), len(own))


class Palettes:
    """Palettes side by side: colours (images x entries x 4, unused entries out of reach), popularity, how many entries there are and how many of them, the last ones, are fixed."""

    def __init__(self, images: int, most: int) -> None:
        self.colours, self.popularity = np.full((images, most, 4), np.inf), np.zeros((images, most))
        self.colours[:, :, 0] = 0  # distances to unused entries are infinite, not undefined
        self.n, self.fixed = np.zeros(images, np.int64), np.zeros(images, np.int64)

    def put(self, i: int, palette: Palette) -> None:
        self.n[i], self.fixed[i] = len(palette.colours), palette.fixed
        self.colours[i, : self.n[i]], self.popularity[i, : self.n[i]] = palette.colours, palette.popularity

    def get(self, i: int) -> Palette:
        return Palette(self.colours[i, : self.n[i]], self.popularity[i, : self.n[i]], int(self.fixed[i]))

    def of(self, images: np.ndarray) -> Palettes:
        out = Palettes(0, 0)
        out.colours, out.popularity, out.n, out.fixed = self.colours[images], self.popularity[images], self.n[images], self.fixed[images]
        return out

    def take(self, images: np.ndarray, others: Palettes, chosen: np.ndarray) -> None:
        """The images' palettes become the chosen ones of the others."""
        most = others.colours.shape[1]
        self.colours[images, :, 0], self.colours[images, :, 1:], self.popularity[images] = 0, np.inf, 0
        self.colours[images, :most], self.popularity[images, :most] = others.colours[chosen], others.popularity[chosen]
        self.n[images], self.fixed[images] = others.n[chosen], others.fixed[chosen]

    def moved(self, own: Colours) -> tuple[Palettes, np.ndarray, np.ndarray]:
        """AGG7 and AGG8: the palettes after a k-means step, each colour's distance before it, and by image their weighted mean."""
        images, most = self.popularity.shape
        at, d = own.nearest(self.colours)
        at += own.image * most
        total, *sums = (np.bincount(at, weights=v, minlength=images * most).reshape(images, most) for v in (own.p, *(own.p * own.f)))
        moves = (total > 0) & (np.arange(most) < (self.n - self.fixed)[:, None])
        out = self.of(np.arange(images))
        out.colours = np.where(moves[:, :, None], np.stack(sums, axis=2) / np.where(total > 0, total, 1)[:, :, None], self.colours)
        out.popularity = np.where(moves, total, self.popularity)
        return out, d, np.add.reduceat(d * own.p, own.starts) / own.total


class Search:
    """QNT4: images' states between trials, side by side. own: the fixed colours of each image."""

    def __init__(self, points: Colours, w: np.ndarray, own: list[np.ndarray], target: float, trials: np.ndarray, most: np.ndarray, overshoot: np.ndarray, best: Palettes, error: np.ndarray, cut_error: np.ndarray) -> None:
        self.points, self.w, self.own, self.target, self.trials, self.most, self.overshoot, self.best, self.error = points, w, own, target, trials, most, overshoot, best, error
        self.cut_error = cut_error  # not a number before the first trial

    def cut(self, images: np.ndarray, target: np.ndarray, limit: np.ndarray) -> Palettes:
        """A median cut of each image to what its fixed colours leave, and these."""
        points, held = self.points.of(images), np.array([len(self.own[i]) for i in images.tolist()], np.int64)
        boxes = median_cuts(points, self.w[self.points.places(images)], self.most[images] - held, target, limit)
        out = Palettes(len(images), int((boxes.number + held).max(initial=1)))
        used = np.arange(boxes.mean.shape[1]) < boxes.number[:, None]
        image, box = np.nonzero(used)
        out.colours[image, box], out.popularity[image, box] = boxes.mean[used], boxes.popularity[used]
        for k in np.flatnonzero(held).tolist():
            out.colours[k, boxes.number[k] : boxes.number[k] + held[k]] = self.own[images[k]]
        out.n, out.fixed = boxes.number + held, held
        return out

    def trial(self) -> None:
        """A cut and a k-means step. A better palette (or a good enough one that is smaller) is kept; colours that it misses weigh more next time."""
        images = np.flatnonzero(self.trials > 0)
        if not len(images):
            return
        points, places, before = self.points.of(images), self.points.places(images), self.error[images]
        moved, d, error = self.cut(images, self.target * self.overshoot[images], np.maximum(max(45 / 65536, self.target), before) * 1.2).moved(points)
        new, w = self.best.n[images] == 0, self.w[places]
        self.cut_error[images[new]] = error[new]
        w = np.where((~new | (self.target <= 0))[points.image], (points.p + w) * np.sqrt(1 + d), w)
        better = new | (error < before) | (error <= self.target) & (moved.n < self.most[images])
        self.w[places] = np.where(better[points.image], w, (points.p + w) / 2)
        near = better & (0 < error) & (error < self.target)
        self.overshoot[images[near]] = np.minimum(self.overshoot[images[near]] * 1.25, self.target / error[near])
        kept, lost = images[better], images[~better]
        self.best.take(kept, moved, better)
        self.error[kept], self.most[kept] = error[better], np.minimum(moved.n[better] + 1, self.most[kept])
        self.overshoot[lost] = 1.0
        self.trials[images] -= np.where(better, 1, np.where(error > 4 * before, 9, 6))


def refined(palettes: Palettes, own: Colours, rounds: np.ndarray, least_gain: np.ndarray, max_mse: np.ndarray, error: np.ndarray) -> tuple[Palettes, np.ndarray]:
    """QNT6: k-means steps until the error hardly changes; hopeless palettes get fewer."""
    out, error = palettes.of(np.arange(len(rounds))), error.copy()
    done, before = np.zeros(len(rounds), np.int64), np.full(len(rounds), ANY_ERROR)
    left = np.flatnonzero(rounds > 0)
    while len(left):
        moved, _, now = out.of(left).moved(own.of(left))
        out.take(left, moved, np.arange(len(left)))
        error[left] = now
        ends = (np.abs(before[left] - now) < least_gain[left]) | (now > 3 * max_mse[left])
        done[left] += np.where(now > 1.5 * max_mse[left], 2, 1)
        before[left] = now
        left = left[~ends & (done[left] < rounds[left])]
    return out, error


def ordered(palette: Palette, last_index_transparent: bool) -> np.ndarray:
    """SRT1: places of the entries in the final order: transparent ones first, then by falling popularity; fixed ones stay last."""
    n, free = len(palette.colours), len(palette.colours) - palette.fixed
    by_popularity = lambda places: sorted(places, key=lambda i: -palette.popularity[i])
    if last_index_transparent:
        clear = np.flatnonzero(palette.colours[:, 0] < 1 / 256)
        if len(clear):
            places = list(range(n))
            places[clear[0]], places[-1] = places[-1], places[clear[0]]
            return np.array([*by_popularity(places[:-1]), places[-1]])
    see_through = [i for i in range(free) if palette.colours[i, 0] < 255 / 256]
    out = [*by_popularity(see_through), *by_popularity([i for i in range(free) if i not in set(see_through)]), *range(free, n)]
    if free > 9 and n > 16:
        for a, b in ((7, 1), (8, 2), (9, 3)):
            out[a], out[b] = out[b], out[a]
    return np.array(out)


# --- the states as rows

_STATE = "image_id long, own binary, f binary, p binary, w binary, best binary, popularity binary, error double, cut_error double, overshoot double, most int, trials int"
_RESULT = "image_id long, idx int, fa double, fr double, fg double, fb double, popularity double, fixed boolean, cut_error double, search_error double, error double"


def _numbers(content: bytes | None) -> np.ndarray:
    return np.frombuffer(content or b"", np.float64)


_STATE_TYPES = {
    "image_id": pa.int64(), **dict.fromkeys(("own", "f", "p", "w", "best", "popularity"), pa.binary()), **dict.fromkeys(("error", "cut_error", "overshoot"), pa.float64()), "most": pa.int32(), "trials": pa.int32(),
}


def _table(columns: dict) -> pa.Table:
    return pa.table({n: pa.array(columns[n], t) for n, t in _STATE_TYPES.items()})


class _Task:
    """What the tasks need of the options."""

    def __init__(self, options: Options, target: float) -> None:
        self.options, self.target = options, target

    def start(self, hist: pa.Table, fixed: pa.Table) -> pa.Table:
        """A histogram's colours and the image's fixed ones as one row."""
        if not hist.num_rows:
            return _table({n: [] for n in _STATE_TYPES})
        own = np.stack([fixed.sort_by("place").column(c).to_numpy() for c in colours.FLOATS], axis=1) if fixed.num_rows else np.empty((0, 4))
        hist = hist.sort_by([(c, "ascending") for c in "abgr"])
        f = np.stack([hist.column(c).to_numpy() for c in colours.FLOATS], axis=1)
        p = hist.column("perceptual").to_numpy().astype(np.float64)
        few = len(f) + len(own) <= self.options.colours and self.options.target_mse == 0
        searches = not few and len(own) < self.options.colours and self.options.trials > 0
        row = {
            "image_id": [hist.column("image_id")[0].as_py()], "own": [own.tobytes()], "f": [f.tobytes()], "p": [p.tobytes()], "w": [p.tobytes()], "best": [None], "popularity": [None], "error": [0.0 if few else ANY_ERROR],
            "cut_error": [None], "overshoot": [1.05], "most": [self.options.colours], "trials": [lessened(self.options.trials, len(f)) if searches else 0],
        }
        return _table(row)

    def together(self, batch: pa.RecordBatch) -> Iterator[list[dict]]:
        """The rows of a batch in lots of about SIDE_BY_SIDE colours, one row at least."""
        sizes = np.cumsum(pc.binary_length(batch.column("p")).to_numpy(zero_copy_only=False).astype(np.int64) // 8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SIDE_BY_SIDE, side="right")))
            yield batch.slice(at, to - at).to_pylist()
            at = to

    def state(self, rows: list[dict]) -> Search:
        weights = [_numbers(r["p"]) for r in rows]
        f = np.concatenate([_numbers(r["f"]).reshape(-1, 4) for r in rows])
        points = Colours(np.ascontiguousarray(f.T), np.concatenate(weights), np.array([len(p) for p in weights], np.int64))
        own, best = [_numbers(r["own"]).reshape(-1, 4) for r in rows], Palettes(len(rows), max(self.options.colours, *(len(r["own"] or b"") // 32 for r in rows), 1))
        for i, r in enumerate(rows):
            if r["best"] is not None:
                best.put(i, Palette(_numbers(r["best"]).reshape(-1, 4), _numbers(r["popularity"]), len(own[i])))
        numbers = lambda c, t: np.array([np.nan if r[c] is None else r[c] for r in rows], t)
        return Search(points, np.concatenate([_numbers(r["w"]) for r in rows]), own, self.target, numbers("trials", np.int64), numbers("most", np.int64), numbers("overshoot", float), best, numbers("error", float), numbers("cut_error", float))

    def advance(self, trials: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in self.together(batch):
                    s = self.state(rows)
                    for _ in range(trials):
                        s.trial()
                    for i, (r, w) in enumerate(zip(rows, np.split(s.w, s.points.starts[1:]), strict=True)):
                        r |= {"w": w.tobytes(), "error": s.error[i], "cut_error": None if np.isnan(s.cut_error[i]) else s.cut_error[i], "overshoot": s.overshoot[i], "most": s.most[i], "trials": max(0, s.trials[i])}
                        if s.best.n[i]:
                            best = s.best.get(i)
                            r |= {"best": best.colours.tobytes(), "popularity": best.popularity.tobytes()}
                    yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

        return run

    def finish(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = self.options
        schema = pa.schema([("image_id", pa.int64()), ("idx", pa.int32()), *[(c, pa.float64()) for c in colours.FLOATS], ("popularity", pa.float64()), ("fixed", pa.bool_()), *[(c, pa.float64()) for c in ("cut_error", "search_error", "error")]])
        for batch in batches:
            for rows in self.together(batch):
                cols = [[] for _ in schema.names]
                for r, s, i, palette, error in self.ended(rows):
                    order = ordered(palette, o.last_index_transparent)
                    c, cut_error = palette.colours[order], None if np.isnan(s.cut_error[i]) else float(s.cut_error[i])
                    for col, x in zip(cols, [[r["image_id"]] * len(order), range(len(order)), *c.T.tolist(), palette.popularity[order].tolist(), (order >= len(order) - palette.fixed).tolist(), [cut_error] * len(order), [float(s.error[i]) if s.best.n[i] else None] * len(order), [float(error)] * len(order)], strict=True):
                        col.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, schema.types, strict=True)], schema=schema)

    def ended(self, rows: list[dict]) -> Iterator[tuple[dict, Search, int, Palette, float]]:
        """Of each image that has a palette: its row, the search, its place in it, palette and error."""
        o, s = self.options, self.state(rows)
        held, sizes = np.array([len(own) for own in s.own], np.int64), s.points.n
        few = sizes + held <= o.colours
        given = few & (o.target_mse == 0)  # QNT3
        searched = s.best.n > 0
        start = s.best.of(np.arange(len(rows)))
        plain = np.flatnonzero(~given & ~searched & (held < o.colours))  # no trials: one plain cut
        if len(plain):
            s.most[plain] = o.colours
            start.take(plain, s.cut(plain, np.full(len(plain), s.target), np.full(len(plain), max(45 / 65536, s.target, ANY_ERROR) * 1.2)), np.arange(len(plain)))
        for i in np.flatnonzero(~given & ~searched & (held >= o.colours)).tolist():
            start.put(i, Palette(np.empty((0, 4)), np.empty(0)).with_fixed(s.own[i], o.colours))
        most = o.max_mse * np.where(few, 0.33, 1.0)
        rounds = np.array([lessened(o.iterations or int(not found and m < ANY_ERROR), n) for found, m, n in zip(searched.tolist(), most.tolist(), sizes.tolist(), strict=True)], np.int64)
        palettes, error = refined(start, s.points, np.where(given, 0, rounds), o.least_gain * np.where(sizes > 100_000, 2.0, 1.0), most, s.error)
        points = np.split(s.points.f, s.points.starts[1:], axis=1), np.split(s.points.p, s.points.starts[1:])
        for i, r in enumerate(rows):
            if given[i]:
                yield r, s, i, Palette(points[0][i].T, points[1][i]).with_fixed(s.own[i], o.colours), 0.0
            elif not most[i] < error[i] < ANY_ERROR:  # or else the least quality is not reached
                yield r, s, i, palettes.get(i), error[i]


def palettes(hist: DataFrame, options: Options | None = None, fixed: tuple[tuple[int, int, int], ...] | DataFrame = (), trials_a_step: int = 12) -> DataFrame:
    """A palette for each image: image_id, idx, fa, fr, fg, fb (PX11), popularity, fixed, cut_error and search_error (of the first
    trial and of the best one; null without trials), error (in the end). Errors are the histogram's mean PX13, before a step's move.

    hist: image_id, r, g, b, a, perceptual (HIST2). fixed (QNT10): colours of every image, or a table of them by image (image_id, place, r, g, b; at most
    256 each); colours that they stand for (FLT5) go here. An image without other colours, or one whose least quality (QNT11) is not reached, has no rows.
    """
    o = options or Options()
    if not isinstance(fixed, DataFrame):
        places = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), *[F.lit(v).alias(c) for c, v in zip("rgb", f, strict=True)]) for i, f in enumerate(fixed)])) if fixed else None
        fixed = hist.select("image_id").distinct().select("image_id", places.alias("f")).select("image_id", "f.*") if fixed else None
    rows = colours.with_floats(hist.select("image_id", *"rgba", "perceptual"))
    if fixed is not None:
        fixed = colours.with_floats(fixed.select("image_id", "place", *"rgb")).select("image_id", "place", *colours.FLOATS)
        near = fixed.groupBy("image_id").agg(F.collect_list(F.struct(*colours.FLOATS)).alias("near"))
        d = F.array_min(F.transform("near", lambda e: px.distance([C(f) for f in colours.FLOATS], [e[f] for f in colours.FLOATS])))
        rows = rows.join(near, "image_id", "left").where(C("near").isNull() | (d >= max(o.target_mse / 2, 2 / 65536))).drop("near")
    else:
        fixed = hist.sparkSession.createDataFrame([], "image_id long, place int, fa double, fr double, fg double, fb double")
    task = _Task(o, min(o.max_mse, max(o.target_mse, (2**o.posterize / 1024) ** 2)))
    fixed = fixed.select(C("image_id").alias("of_image"), "place", *[C(f).alias(f) for f in colours.FLOATS])  # columns of their own, as both sides may stem from one table
    start = rows.groupBy("image_id").cogroup(fixed.groupBy("of_image")).applyInArrow(lambda hist, own: task.start(hist, own), _STATE)
    state, done = written(spread(start, "image_id"), "search"), []
    while True:
        done.append(state.where("trials = 0"))
        left = state.where("trials > 0")
        if left.isEmpty():
            break
        state = written(left.mapInArrow(task.advance(trials_a_step), _STATE), "search")
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    return ended.mapInArrow(task.finish, _RESULT)


def cut_boxes(hist: DataFrame, size: int = 16, target: float = 0.0, limit: float = ANY_ERROR) -> DataFrame:
    """QNT5 with AGG10: a single cut's boxes by image: box, colours, popularity (sum of weights), fa, fr, fg, fb, error (total)."""

    def run(hist: pa.Table) -> pa.Table:
        image = hist.column("image_id")[0].as_py()
        hist = hist.sort_by([(c, "ascending") for c in "abgr"])
        f = np.stack([hist.column(c).to_numpy() for c in colours.FLOATS], axis=1)
        p = hist.column("perceptual").to_numpy().astype(np.float64)
        boxes = median_cuts(Colours(np.ascontiguousarray(f.T), p, np.array([len(p)])), p, np.array([size]), np.array([target]), np.array([limit]))
        n = int(boxes.number[0])
        cols = {"image_id": [image] * n, "box": pa.array(range(n), pa.int32()), "colours": boxes.colours[0, :n], "popularity": boxes.popularity[0, :n]}
        return pa.table(cols | {c: boxes.mean[0, :n, i] for i, c in enumerate(colours.FLOATS)} | {"error": boxes.error[0, :n]})

    schema = "image_id long, box int, colours long, popularity double, fa double, fr double, fg double, fb double, error double"
    return colours.with_floats(hist.select("image_id", *"rgba", "perceptual")).groupBy("image_id").applyInArrow(run, schema)
