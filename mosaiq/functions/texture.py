"""Texel formats as column expressions: what colour and opacity a packed texel stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import channels15, div, round18
from .packed import bits


def level5(a: Column) -> Column:
    """Opacity of 5 bits as 8."""
    return div(a * 510 + 31, 62)


def a3i5(texel: Column) -> tuple[Column, Column]:
    """(index, opacity): 5 bits of index, 3 of opacity, which are widened by repeating their highest."""
    a = bits(texel, 5, 3)
    return bits(texel, 0, 5), level5(a * 4 + F.shiftright(a, 1))


def a5i3(texel: Column) -> tuple[Column, Column]:
    return bits(texel, 0, 3), level5(bits(texel, 3, 5))


def indexed(byte: Column, place: Column, width: int) -> Column:
    """Index of ``width`` bits at a place within a byte, the lowest bits first."""
    return div(byte, F.pow(F.lit(2), place % (8 // width) * width).cast("bigint")) % (1 << width)


def indexed_opacity(index: Column, first_clear: Column) -> Column:
    """255 but for index 0 of a texture whose first colour is clear."""
    return F.when((index == 0) & first_clear, 0).otherwise(255).cast("bigint")


def direct(color: Column) -> tuple[Column, Column, Column, Column]:
    """(r, g, b, a) of 15 bits of colour and one of opacity."""
    return (*channels15(color), bits(color, 15, 1) * 255)


def block(value: Column, colors: list[tuple[Column, Column, Column]], mixed: Column, whole: Column) -> tuple[Column, Column, Column, Column]:
    """(r, g, b, a) of a 4 x 4 block's 2-bit value.

    The first two colours are the block's own. Mixed blocks have between them one at half way, or
    if whole two at three and five eighths, rounded to 6 bits a channel; others have two more
    colours of their own. The last value is clear unless the block is whole.
    """
    def blend(k: int, part: int) -> Column:
        return round18(div(colors[0][k] * (8 - part) + colors[1][k] * part + 4, 8))

    zero = F.lit(0).cast("bigint")
    out = []
    for k in range(3):
        third = F.when(mixed & whole, blend(k, 3)).when(mixed, blend(k, 4)).otherwise(colors[2][k])
        fourth = F.when(~whole, zero).when(mixed, blend(k, 5)).otherwise(colors[3][k])
        out.append(F.when(value == 0, colors[0][k]).when(value == 1, colors[1][k]).when(value == 2, third).otherwise(fourth))
    return (*out, F.when((value == 3) & ~whole, 0).otherwise(255).cast("bigint"))
