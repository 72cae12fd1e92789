"""Per-pixel scalar functions: SQL expressions over channel columns; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Internal gamma and its default display gamma; weights of the channels in variance.
INTERNAL_GAMMA = 0.5499
DISPLAY_GAMMA = 0.45455


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    """PX2: R in the low byte; a long, as a >= 128 would make an int negative."""
    return r.cast("long") + g * F.lit(256) + b * F.lit(65536) + a.cast("long") * F.lit(16777216)


def unpack(packed: Column, channel: int) -> Column:
    return F.shiftright(packed, 8 * channel).bitwiseAND(F.lit(255)).cast("int")


def flatten(c: Column, a: Column) -> Column:
    """PX5: channel over black by (c * a) >> 8, opaque pixels as they are."""
    return F.when(a != 255, F.shiftright(c * a, 8)).otherwise(c)


def to_byte_truncated(v: Column) -> Column:
    """PX6."""
    return (v * 255).cast("int").bitwiseAND(255)


def to_byte_rounded(v: Column) -> Column:
    """PX19: saturates, then rounds."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def posterize(c: Column, bits: int) -> Column:
    """PX8: the low bits go, the high ones fill them."""
    if not bits:
        return c
    return c.bitwiseAND(F.lit(255 - (2**bits - 1))).bitwiseOR(F.shiftright(c, 8 - bits))


def linear(c: Column, gamma: float = DISPLAY_GAMMA) -> Column:
    """PX10: a byte in the internal gamma, looked up among the 256 there are; null for what is no byte."""
    curve = ", ".join(f"{(v / 255.0) ** (INTERNAL_GAMMA / gamma)!r}D" for v in range(256))
    return F.get(F.expr(f"array({curve})"), c.cast("int"))


def premultiplied(c: Column, a: Column, gamma: float = DISPLAY_GAMMA) -> Column:
    """PX11."""
    return linear(c, gamma) * a / F.lit(255.0)


def floats(r: Column, g: Column, b: Column, a: Column) -> list[Column]:
    """PX11 for a whole pixel: alpha, red, green and blue, as PX13 takes them."""
    return [a / F.lit(255.0), *(premultiplied(c, a) for c in (r, g, b))]


def to_rgb(c: Column, a: Column, gamma: float = DISPLAY_GAMMA) -> Column:
    """PX12: from premultiplied float (c, a in 0..1) to a byte; almost transparent pixels are 0."""
    return F.when(a < 1 / 256, 0).otherwise(F.least(F.lit(255), F.floor(F.pow(F.greatest(c / a, F.lit(0.0)), F.lit(gamma / INTERNAL_GAMMA)) * 256)).cast("int"))


def distance(p: list[Column], q: list[Column]) -> Column:
    """PX13 for (a, r, g, b) floats: per channel the greater of the differences on black and on white, squared."""
    alpha = q[0] - p[0]
    total = F.lit(0.0)
    for x, y in zip(p[1:], q[1:], strict=True):
        black = x - y
        white = black + alpha
        total = total + F.greatest(black * black, white * white)
    return total


def ranked_distance(p: list[Column], q: list[Column]) -> Column:
    """PX13 in units of 10^-12, so that sums in another order and other libraries' powers give the same ties."""
    return F.floor(distance(p, q) * F.lit(1e12) + F.lit(0.5)).cast("long")


def quality_to_mse(quality: Column) -> Column:
    """PX15: the error that a quality of 0 to 100 allows."""
    q = quality.cast("double")
    extra = F.greatest(F.lit(0.0), 0.016 / (0.001 + q) - 0.001)
    scaled = extra + 2.5 / F.pow(210.0 + q, F.lit(1.2)) * (100.1 - q) / 100.0
    return F.when(q == 0, 1e20).when(q == 100, 0.0).otherwise(scaled)


def quality_limit(quality: int) -> float:
    """PX15 of a number."""
    if quality in (0, 100):
        return 0.0 if quality else 1e20
    return max(0.0, 0.016 / (0.001 + quality) - 0.001) + 2.5 / (210.0 + quality) ** 1.2 * (100.1 - quality) / 100.0


# The approximations' coefficients. Power 2.4: of 1, x, x^2, x^3, x^4, and of c / (d + e x). Power 1/2.4: of 1, x, x^(1/2), x^(1/4), x^(3/8), x^(3/4).
POWER_24 = (0.0985766365536824, -0.231757513261358, 0.839474952656502, 0.363287814061725, -0.0395365717969074)
POWER_24_FRACTION = (-0.0125559718896615, 0.12758338921578, 0.290283465468235)
ROOT_24 = {0: 0.000213364515060263, 1: 0.0149409239419218, 0.5: 0.433973412731747, 0.25: -0.0380957908841466, 0.375: 0.659628181609715, 0.75: -0.0706476137208521}


def srgb_to_linear(v: Column) -> Column:
    """PX16: the transfer curve with its power approximated, for 0 to 1."""
    x = (v + 0.055) / 1.055
    top, base, slope = POWER_24_FRACTION
    power = F.lit(top) / (F.lit(base) + F.lit(slope) * x)
    for c in reversed(range(len(POWER_24))):
        power = power + F.lit(POWER_24[c]) * (F.pow(x, F.lit(float(c))) if c else F.lit(1.0))
    return F.when(v <= 0.04045, v / 12.92).otherwise(power)


def linear_to_srgb(v: Column) -> Column:
    """PX16, the other way."""
    root = sum((F.lit(c) * F.pow(v, F.lit(float(e))) for e, c in ROOT_24.items()), F.lit(0.0))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * root - 0.055)


def round_half_up(v: Column, low: float, high: float) -> Column:
    """PX17: half away from zero, clamped."""
    r = F.when(v < 0, -F.floor(-v + 0.5)).otherwise(F.floor(v + 0.5))
    return F.least(F.greatest(r, F.lit(low)), F.lit(high)).cast("int")


def lerp(a: Column, b: Column, t: Column) -> Column:
    """PX20."""
    return (b - a) * t + a


def palette_word(r: Column, g: Column, b: Column) -> Column:
    """PX21: 0x0RGB from the top four bits of each channel."""
    return F.shiftleft(F.shiftright(r, 4), 8).bitwiseOR(F.shiftleft(F.shiftright(g, 4), 4)).bitwiseOR(F.shiftright(b, 4))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """PX18: hue, saturation and value in 0..1 of bytes."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    hue = F.when(d == 0, 0.0).when(top == r, (g - b) / d).when(top == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d) / 6.0
    return F.when(hue < 0, hue + 1).otherwise(hue), F.when(top == 0, 0.0).otherwise(d / top), top / F.lit(255.0)
