"""Colour arithmetic as column expressions; all stays within whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer division, truncating towards zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint") if isinstance(b, int) else b)


# ---- depth

def to5(c: Column) -> Column:
    """8 to 5 bits."""
    return div(c * 62 + 255, 510)


def from5(c: Column) -> Column:
    """5 to 8 bits."""
    return div(c * 510 + 31, 62)


def to6(c: Column) -> Column:
    return div(c * 126 + 255, 510)


def from6(c: Column) -> Column:
    return div(c * 510 + 63, 126)


def pack15(r: Column, g: Column, b: Column) -> Column:
    """Channels of 8 bits to a 15-bit colour, red lowest."""
    return to5(r) + to5(g) * 32 + to5(b) * 1024


def channels15(color: Column) -> tuple[Column, Column, Column]:
    """8-bit channels of a 15-bit colour."""
    return tuple(from5(div(color, 1 << shift) % 32) for shift in (0, 5, 10))


def round15(c: Column) -> Column:
    return from5(to5(c))


def round18(c: Column) -> Column:
    return from6(to6(c))


def pack32(r: Column, g: Column, b: Column, a: Column) -> Column:
    """32-bit colour, red lowest, as a non-negative long."""
    return r + g * 256 + b * 65536 + a * 16777216


def swap_red_blue(color: Column) -> Column:
    """32-bit colour with red and blue exchanged."""
    return color.bitwiseAND(F.lit(0xFF00FF00)) + div(color, 65536) % 256 + (color % 256) * 65536


# ---- other spaces

#: Rows of y, i and q over red, green and blue; fixed values.
YIQ = ((0.5146329, 1.2303905, 0.2588982), (-0.5885085, -0.3060195, 0.8945280), (0.7227111, -1.3898515, 0.6671403))


def yiq(r: Column, g: Column, b: Column, a: Column) -> tuple[Column, Column, Column, Column]:
    """y, i and q, scaled by opacity, and opacity from 0 to 1."""
    alpha = a / 255.0
    return (*((r * k[0] + g * k[1] + b * k[2]) * alpha for k in YIQ), alpha)


def _inverse() -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(YIQ)).tolist()


def from_yiq(y: Column, i: Column, q: Column, a: Column) -> tuple[Column, Column, Column, Column]:
    """8-bit channels: opacity taken out again, rounded half up, held within 0 and 255."""
    def channel(k):
        v = F.when(a > 0, (y * k[0] + i * k[1] + q * k[2]) / a).otherwise(0.0)
        return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("bigint")

    return (*map(channel, _inverse()), F.floor(a * 255 + 0.5).cast("bigint"))


def weights(balance: int = 20, color_balance: int = 20) -> tuple[int, int, int]:
    """Weights of y, i and q."""
    return 40 - balance, color_balance, 40 - color_balance


def distance(p: tuple[Column, ...], q: tuple[Column, ...], w: tuple[int, int, int] = (20, 20, 20)) -> Column:
    """Weighted squared distance of two opaque (y, i, q)."""
    return sum(((a - b) * (a - b) * (k * k) for a, b, k in zip(p[:3], q[:3], w, strict=True)), F.lit(0.0))


def uniform_background() -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """Means of y, i and q and of their squares, over colours of which each channel is anything from 0 to 255."""
    means = tuple(127.5 * sum(row) for row in YIQ)
    return means, tuple(m * m + 255.0 * 255.0 / 12.0 * sum(k * k for k in row) for m, row in zip(means, YIQ, strict=True))


def alpha_distance(p: tuple[Column, ...], q: tuple[Column, ...], w: tuple[int, int, int] = (20, 20, 20), background=None) -> Column:
    """Weighted squared distance of two (y, i, q, a), as seen on the average over a distribution of backgrounds.

    ``background`` has the means of y, i and q and of their squares; by default every colour is equally likely.
    """
    means, squares = background or uniform_background()
    da = p[3] - q[3]
    mixed = sum(((a - b) * (2.0 * m * k * k) for a, b, m, k in zip(p[:3], q[:3], means, w, strict=True)), F.lit(0.0))
    return distance(p, q, w) + da * da * sum(s * k * k for s, k in zip(squares, w, strict=True)) - da * mixed


#: Rows of y, u and v over red, green and blue, and their weights in the squared distance; fixed values.
YUV = ((0.2990, 0.5870, 0.1140), (-0.1684, -0.3316, 0.5000), (0.5000, -0.4187, -0.0813))
YUV_WEIGHTS = (4.0, 1.0, 1.0)
#: Shares of red, green and blue in luminance, and the exponent of linear light; fixed values.
LUMINANCE, GAMMA = (0.2126, 0.7152, 0.0722), 2.2


def yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The metric space of the nearest-neighbour sort."""
    return tuple(r * k[0] + g * k[1] + b * k[2] for k in YUV)


def gray(r: Column, g: Column, b: Column) -> Column:
    """The gray level of 5 bits that has the luminance of a colour with channels of 5 bits."""
    y = sum((F.pow(c / 31.0, F.lit(GAMMA)) * k for c, k in zip((r, g, b), LUMINANCE, strict=True)), F.lit(0.0))
    return F.floor(F.pow(y, F.lit(1 / GAMMA)) * 31.0 + 0.5).cast("bigint")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Integer hue (0 to 359), saturation and value (0 to 100); red before green before blue at ties."""
    top, bottom = F.greatest(r, g, b), F.least(r, g, b)
    span = top - bottom
    safe = F.when(span == 0, 1).otherwise(span)
    h = F.when(span == 0, F.lit(0).cast("bigint")).when(top == r, div((g - b) * 60, safe)).when(top == g, div((b - r) * 60, safe) + 120).otherwise(div((r - g) * 60, safe) + 240)
    s = F.when(top == 0, F.lit(0).cast("bigint")).otherwise(div(span * 100, F.when(top == 0, 1).otherwise(top)))
    return F.when(h < 0, h + 360).otherwise(h), s, div(top * 100, 255)


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """8-bit channels, by integers that truncate."""
    h = h % 360
    chroma = div(s * v * 255, 10000)
    x = div(chroma * (F.lit(60) - F.abs(h % 120 - 60)), 60)
    zero = F.lit(0).cast("bigint")
    low = div(v * 255, 100) - chroma

    def pick(*six):
        c = F.when(h <= 60, six[0])
        for limit, value in zip((120, 180, 240, 300), six[1:5], strict=True):
            c = c.when(h <= limit, value)
        return c.otherwise(six[5]) + low

    return pick(chroma, x, zero, zero, x, chroma), pick(x, chroma, chroma, x, zero, zero), pick(zero, zero, x, chroma, chroma, x)


def opaque(a: Column) -> Column:
    return a >= 128


def over(front: tuple[Column, ...], back: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    """(r, g, b, a) of one pixel over another, both with opacity; integers that truncate.

    An opaque front pixel and, where the front is clear, the back one come out as they are.
    """
    af, ab = front[3], back[3]
    wf, wb = af * 255, (F.lit(255) - af) * ab
    total = F.greatest(wf + wb, F.lit(1))
    mixed = [div(f * wf + b * wb, total) for f, b in zip(front[:3], back[:3], strict=True)] + [div(wf + wb, 255)]
    return tuple(F.when(af == 255, f).when(af == 0, b).otherwise(m) for f, b, m in zip(front, back, mixed, strict=True))


def interpolated15(a: Column, b: Column, part: Column, whole: int) -> Column:
    """A 15-bit colour ``part`` of ``whole`` steps from ``a`` to ``b``, channel by channel, rounded half up."""
    out = F.lit(0).cast("bigint")
    for shift in (0, 5, 10):
        x, y = (F.shiftright(c, shift).bitwiseAND(31) for c in (a, b))
        out = out + div(x * (F.lit(whole) - part) * 2 + y * part * 2 + whole, whole * 2) * (1 << shift)
    return out
