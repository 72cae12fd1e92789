"""Resampling with designed filters (GEO5 to GEO9) and the choice of a resize method (GEO11).

Everything before the final rounding is linear and separable, so a chain of correction, up- or down-sampling and fractional-delay interpolation is
one sparse matrix (target, source, weight) for each axis, made on the driver from a few filters (its size is wanted pixels x taps) and applied
like any other by stencils.resize: joins with weights and sums, across then down.

Filters are windowed sincs. Chains: enlarging corrects the source, doubles it with zeros between and interpolates; reducing below a half doubles it,
interpolates with a lower cutoff and corrects the result; further reducing interpolates the source itself, after half-band filters that keep every 16th place while
it is over 32 times too large. The interpolator's fractional delays are rounded down to one of PHASES, and the low-pass filter is folded into it. (The
original picks one of four plans by their cost, which differ in where the low-pass filter runs and how phases are rounded; this is always the one that folds it.)
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from rastermill.operators import stencils
from rastermill.operators.dither import rounded_with_diffusion

# The presets (GEO8): alpha and length of the correction filter; alpha, cutoff and length of the interpolator; alpha, length and cutoff of the low-pass filter.
PRESETS = {
    "default": {"corr": (1.0, 6.30770), "int": (2.27825, 0.75493, 18.0), "lp": (3.40127, 7.78, 0.78797)},
    "ulr": {"corr": (1.0, 5.83280), "int": (2.11453, 0.73986, 18.0), "lp": (1.73455, 6.40, 0.61314)},
    "lr": {"corr": (1.0, 5.87671), "int": (2.25322, 0.74090, 18.0), "lp": (1.79306, 7.00, 0.68881)},
    "low": {"corr": (1.0, 6.09757), "int": (2.36704, 0.74674, 18.0), "lp": (2.19427, 7.66, 0.75380)},
    "high": {"corr": (1.0, 6.80909), "int": (2.44917, 0.75856, 18.0), "lp": (4.39527, 8.18, 0.79172)},
    "ultra": {"corr": (1.0, 7.48060), "int": (1.93750, 0.75462, 18.0), "lp": (5.55209, 8.34, 0.78002)},
}
# Alpha, cutoff and length of the half-band filter, its decimation, phases for 8 bits, bins of the correction, least tap, pixels added at corrected edges.
HALF_BAND, DECIMATION, PHASES, BINS, LEAST_TAP, EDGE = (1.75395, 0.40356, 22.0), 16, math.ceil(0.33287686 * math.exp(0.11334583 * 6.02 * 11)), 65, 0.00001, 3


def peaked_cosine(t: np.ndarray, half: float, alpha: float) -> np.ndarray:
    """Window: a cosine quarter, less by the alpha-th power of the distance from the centre."""
    return np.cos(np.pi / 2 * t / half) * (1 - (t / half) ** alpha)


def low_pass(half: float, cutoff: float, alpha: float, gain: float) -> np.ndarray:
    """An odd, symmetric windowed sinc with the cutoff in radians and the given gain at rest."""
    t = np.arange(1, math.ceil(half))
    side = np.sin(cutoff * t) / (np.pi * t) * peaked_cosine(t, half, alpha)
    taps = np.concatenate([side[::-1], [cutoff / np.pi], side])
    return taps * (gain / taps.sum())


def trimmed(taps: np.ndarray, gain: float) -> np.ndarray:
    """Without what is negligible at both ends."""
    heavy = np.flatnonzero(np.abs(taps[: len(taps) // 2]) >= LEAST_TAP)
    cut = int(heavy[0]) if len(heavy) else len(taps) // 2
    taps = taps[cut : len(taps) - cut]
    return taps * (gain / taps.sum())


def response(taps: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Magnitude of the frequency response."""
    return np.abs(np.exp(-1j * np.outer(angles, np.arange(len(taps)))) @ taps)


def equaliser(bins: np.ndarray, length: float, alpha: float) -> np.ndarray:
    """Taps whose response runs in straight lines through `bins`, evenly spaced from 0 to half the rate: the lines' inverse transform, windowed."""
    x = np.linspace(0, 1, len(bins))
    slope = np.diff(bins) / np.diff(x)
    base = bins[:-1] - slope * x[:-1]
    n = np.arange(1, math.ceil(length / 2))
    w = np.pi * n[:, None]
    rising = lambda t: (slope * t + base) * np.sin(w * t) / w + slope * np.cos(w * t) / w**2
    side = (rising(x[1:]) - rising(x[:-1])).sum(axis=1) * peaked_cosine(n, length / 2, alpha)
    return np.concatenate([side[::-1], [np.sum(np.diff(x) * (bins[1:] + bins[:-1]) / 2)], side])


class Chain:
    """The plan of one axis: which filters, in which order."""

    def __init__(self, size: int, wanted: int, preset: str = "default") -> None:
        p = PRESETS[preset]
        self.size, self.wanted = size, wanted
        self.step, self.offset = stencils.placing(size, wanted)
        self.first = self.step <= 1  # the correction comes first
        self.doubles = math.floor(self.step) < 2
        factor, cutoff = 2 if self.doubles else 1, 1.0 if self.first else 1 / self.step
        band = cutoff
        self.halvings: list[np.ndarray] = []
        while not self.doubles and math.floor(0.5 / cutoff) > DECIMATION:
            alpha, cut, length = HALF_BAND
            self.halvings.append(trimmed(low_pass(0.25 * length * DECIMATION, np.pi * cut * 2 / DECIMATION, alpha, 1.0), 1.0))
            cutoff *= DECIMATION
        alpha, length, cut = p["lp"]
        self.gain = float(factor)
        self.low = trimmed(low_pass(0.25 * length / cutoff * factor, np.pi * cut * cutoff / factor, alpha, 1.0), self.gain)
        alpha, cut, length = p["int"]
        wide = cutoff if self.doubles else 2 * cutoff
        self.long = low_pass(0.5 * length / wide * PHASES, np.pi * cut * wide / PHASES, alpha, PHASES)
        self.correction = self._correction(band, *p["corr"])

    def fractional(self, phase: int) -> tuple[int, np.ndarray]:
        """The interpolator for a delay of phase / PHASES with the low-pass filter: place of the first tap from the whole position, and taps."""
        centre = len(self.long) // 2
        reach = centre // PHASES + 1
        at = (np.arange(2 * reach) - reach + 1) * PHASES - phase + centre
        own = np.where((at >= 0) & (at < len(self.long)), self.long[np.clip(at, 0, len(self.long) - 1)], 0.0)
        return 1 - reach - len(self.low) // 2, np.convolve(own, self.low)

    def _correction(self, band: float, alpha: float, length: float) -> np.ndarray:
        """Evens out what the other filters do to frequencies up to the result's band."""
        bins, rate = np.ones(BINS), 2.0 if self.doubles else 1.0
        share = np.linspace(0, 1, BINS) * np.pi * band
        for taps in self.halvings:
            bins /= response(taps, share / rate)
            rate /= DECIMATION
        bins /= response(self.fractional(0)[1], share / rate) / self.gain
        return trimmed(equaliser(bins, length, alpha) / equaliser(bins, length, alpha).sum(), 1.0)

    def rows(self) -> list[dict[int, float]]:
        """For each wanted pixel its source pixels and their weights: the chain, followed backwards. Edges repeat at every stage."""
        step, offset = (self.step * 2, self.offset * 2) if self.doubles else (self.step, self.offset)
        lengths = [self.size]
        for _ in self.halvings:
            step, offset = step / DECIMATION, offset / DECIMATION
            lengths.append(-(-lengths[-1] // DECIMATION))
        known: dict[int, tuple[int, np.ndarray]] = {}
        plain = []
        for i in range(self.wanted):
            at = offset + step * i
            whole = math.floor(at)
            phase = int((at - whole) * PHASES)
            if phase not in known:
                known[phase] = self.fractional(phase)
            first, taps = known[phase]
            row = {whole + first + j: w for j, w in enumerate(taps.tolist()) if w}
            if self.doubles:
                row = {p // 2: w for p, w in row.items() if p % 2 == 0}
            plain.append(row)
        if not self.first:  # the correction is of the result
            half = len(self.correction) // 2
            plain = [merged((p, w * c) for t, c in enumerate(self.correction.tolist()) for p, w in plain[min(max(i + t - half, 0), self.wanted - 1)].items()) for i in range(self.wanted)]
        for taps, n in zip(self.halvings[::-1], lengths[1:][::-1], strict=True):
            plain = [convolved(clamped(row, -EDGE, n + EDGE - 1), taps, DECIMATION) for row in plain]
        if self.first:
            plain = [convolved(clamped(row, -EDGE, self.size + EDGE - 1), self.correction, 1) for row in plain]
        return [clamped(row, 0, self.size - 1) for row in plain]


def merged(pairs) -> dict[int, float]:
    out: dict[int, float] = {}
    for p, w in pairs:
        out[p] = out.get(p, 0.0) + w
    return out


def clamped(row: dict[int, float], low: int, high: int) -> dict[int, float]:
    return merged((min(max(p, low), high), w) for p, w in row.items())


def convolved(row: dict[int, float], taps: np.ndarray, step: int) -> dict[int, float]:
    """The places and weights before a symmetric filter that keeps every step-th place."""
    half = len(taps) // 2
    return merged((p * step + t - half, w * c) for p, w in row.items() for t, c in enumerate(taps.tolist()))


@lru_cache(maxsize=64)
def weights(preset: str, size: int, wanted: int) -> tuple[tuple[int, int, float], ...]:
    """(target, source, weight) of one axis."""
    return tuple((i, p, w) for i, row in enumerate(Chain(size, wanted, preset).rows()) for p, w in sorted(row.items()) if abs(w) > 1e-12)


def designed_resize(pixels: DataFrame, width: int, height: int, preset: str = "default", dither: bool = False) -> DataFrame:
    """GEO5: values are rounded half up and held in a byte at the end only; `dither` carries what rounding loses on (WIN10)."""
    values = stencils.resize(pixels, width, height, weights_of=lambda size, wanted: weights(preset, size, wanted), rounded=not dither)
    return rounded_with_diffusion(values) if dither else values


def designed_resizes(pixels: DataFrame, width: int, height: int, presets: list[str]) -> DataFrame:
    """GEO5 by several presets (GEO8) in one pass: the columns of designed_resize, and preset."""
    ways = {name: lambda size, wanted, name=name: weights(name, size, wanted) for name in presets}
    return stencils.resizes(pixels, width, height, ways).withColumnRenamed("way", "preset")


def resized(pixels: DataFrame, width: int, height: int, method: str, dither: bool = False) -> DataFrame:
    """GEO11: the scale dialog's choice: point, bilinear, lanczos or designed, the last with or without dithering."""
    if width < 1 or height < 1:
        raise ValueError("sizes are positive")
    if method == "point":
        return stencils.point_resize(pixels, width, height)
    if method == "designed":
        return designed_resize(pixels, width, height, dither=dither)
    return stencils.resize(pixels, width, height, method)


def repositioned(pixels: DataFrame, width: int, height: int, button: int = 4) -> DataFrame:
    """GEO11: the crop dialog's choice: one of nine anchors, row by row from the upper left one."""
    if width < 1 or height < 1 or not 0 <= button <= 8:
        raise ValueError("sizes are positive, anchors 0 to 8")
    return stencils.crop(pixels, width, height, (button % 3 - 1, button // 3 - 1))
