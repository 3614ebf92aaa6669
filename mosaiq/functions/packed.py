"""Packed bit fields as column expressions, and small integer functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import div


def bits(c: Column, low: int, count: int) -> Column:
    """``count`` bits of a non-negative integer from bit ``low``."""
    return F.shiftright(c, low).bitwiseAND((1 << count) - 1)


def screen_char(raw: Column) -> Column:
    return bits(raw, 0, 10)


def screen_flip(raw: Column) -> Column:
    return bits(raw, 10, 2)


def screen_palette(raw: Column) -> Column:
    return bits(raw, 12, 4)


def screen_pack(char: Column, flip: Column, palette: Column) -> Column:
    return char + flip * 1024 + palette * 4096


#: Object sizes by shape (square, wide, tall, the hardware's fourth) and size; fixed values.
WIDTHS = ((8, 16, 32, 64), (16, 32, 32, 64), (8, 8, 16, 32), (8, 8, 8, 8))
HEIGHTS = ((8, 16, 32, 64), (8, 8, 16, 32), (16, 32, 32, 64), (8, 8, 8, 8))


def _by(table, shape: Column, size: Column) -> Column:
    flat = F.array(*(F.lit(v).cast("bigint") for row in table for v in row))
    return F.element_at(flat, (shape * 4 + size + 1).cast("int"))


def oam(attr0: Column, attr1: Column, attr2: Column) -> dict[str, Column]:
    """Fields of an object record."""
    shape, size, affine = bits(attr0, 14, 2), bits(attr1, 14, 2), bits(attr0, 8, 1)
    zero = F.lit(0).cast("bigint")
    either = lambda yes, no: F.when(affine == 1, yes).otherwise(no)
    return {
        "x": bits(attr1, 0, 9), "y": bits(attr0, 0, 8), "width": _by(WIDTHS, shape, size), "height": _by(HEIGHTS, shape, size),
        "char": bits(attr2, 0, 10), "priority": bits(attr2, 10, 2), "palette": bits(attr2, 12, 4), "mode": bits(attr0, 10, 2), "mosaic": bits(attr0, 12, 1),
        "affine": affine, "flip_x": either(zero, bits(attr1, 12, 1)), "flip_y": either(zero, bits(attr1, 13, 1)), "double": either(bits(attr0, 9, 1), zero),
        "disable": either(zero, bits(attr0, 9, 1)), "matrix": either(bits(attr1, 9, 5), zero), "bits": F.when(bits(attr0, 13, 1) == 1, 8).otherwise(4).cast("bigint"),
    }


def signed(c: Column, width: int) -> Column:
    """Two's complement of ``width`` bits."""
    return F.when(c >= 1 << (width - 1), c - (1 << width)).otherwise(c)


#: Bits a texel by texture format; fixed values.
TEXEL_BITS = (0, 8, 2, 4, 8, 2, 8, 16)
BLOCK_FORMAT = 5


def texel_size(fmt: Column, width: Column, height: Column) -> Column:
    """Bytes of texels; block-compressed textures are padded to whole blocks."""
    pad = lambda c: F.when(fmt == BLOCK_FORMAT, div(c + 3, 4) * 4).otherwise(c)
    bpp = F.element_at(F.array(*(F.lit(b).cast("bigint") for b in TEXEL_BITS)), (fmt + 1).cast("int"))
    return div(pad(width) * pad(height) * bpp, 8)


def index_size(fmt: Column, width: Column, height: Column) -> Column:
    """Bytes of palette indices, which only block-compressed textures have."""
    return F.when(fmt == BLOCK_FORMAT, div(texel_size(fmt, width, height), 2)).otherwise(F.lit(0).cast("bigint"))


def layout_coordinate(raw: Column) -> tuple[Column, Column]:
    """Position (12 bits, signed) and origin (the bits above) of a layout's coordinate."""
    return signed(bits(raw, 0, 12), 12), bits(raw, 12, 2)


def layout_word(pos: Column, origin: Column, align: Column) -> Column:
    """The 16 bits of a layout's coordinate: position, origin and alignment."""
    return F.pmod(pos, F.lit(4096)) + origin * 4096 + align * 16384


def layout_alignment(raw: Column) -> Column:
    return bits(raw, 14, 2)


def anchored(pos: Column, size: Column, anchor: Column) -> Column:
    """Left or top edge: anchor 0 at the edge, 1 at the centre, 2 at the far edge."""
    return pos - F.when(anchor == 1, div(size + 1, 2)).when(anchor == 2, size).otherwise(0)


def permille_changed(before: Column, after: Column) -> Column:
    """How much smaller, or how much larger, in thousandths, rounded; 0 for nothing."""
    of = div(after * 2000 + before, F.greatest(before, F.lit(1)) * 2)
    return F.when(before == 0, 0).when(after <= before, F.lit(1000) - of).otherwise(of - 1000).cast("bigint")


def rescale_depth(p: Column, old: int, new: int) -> Column:
    """A glyph's level from 0..old to 0..new, rounded."""
    return div(p * (new * 2) + old, old * 2)


def round_half_away(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5)).cast("bigint")


def hash3(a: Column, b: Column, c: Column) -> Column:
    """A 9-bit bucket of three bytes for match search: the first, and how the others differ from it."""
    d, e = a.bitwiseXOR(b), a.bitwiseXOR(c)
    return a.bitwiseXOR(d * 2).bitwiseXOR(e * 4).bitwiseXOR(F.shiftright(e, 7)).bitwiseAND(511)


def reverse_bits(c: Column, width: int) -> Column:
    return sum((bits(c, i, 1) * (1 << (width - 1 - i)) for i in range(width)), F.lit(0).cast("bigint"))


#: Bits of a texture's parameter word by field: first bit and count; sizes are powers of two from 8; fixed values.
TEXTURE_FIELDS = {"offset": (0, 16), "repeat_s": (16, 1), "repeat_t": (17, 1), "flip_s": (18, 1), "flip_t": (19, 1), "width": (20, 3), "height": (23, 3), "fmt": (26, 3), "color0": (29, 1), "transform": (30, 2)}


def texture_fields(raw: Column) -> dict[str, Column]:
    """Fields of a texture's parameter word, width and height in pixels."""
    out = {name: bits(raw, low, count) for name, (low, count) in TEXTURE_FIELDS.items()}
    for side in ("width", "height"):
        out[side] = F.expr("8L") * F.pow(F.lit(2), out[side]).cast("bigint")
    return out


def texture_word(fields: dict[str, Column]) -> Column:
    """The parameter word of ``texture_fields``."""
    total = F.lit(0).cast("bigint")
    for name, (low, _) in TEXTURE_FIELDS.items():
        value = ilog2(fields[name]) - 3 if name in ("width", "height") else fields[name]
        total = total + value * (1 << low)
    return total


def swap16(c: Column) -> Column:
    return bits(c, 8, 8) + bits(c, 0, 8) * 256


def ilog2(c: Column) -> Column:
    """Floor of the binary logarithm of a positive integer."""
    return F.length(F.bin(c)).cast("bigint") - 1
