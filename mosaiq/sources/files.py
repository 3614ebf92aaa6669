"""Packed object files: block containers, and the readers, writers and checks of their formats.

A format belongs to a kind of object. Every kind has one relational form, a row for each colour,
pixel, cell reference, sprite record, animation frame or node, whatever format it was read from; and
every format writes a file from such rows. A file is one value and is taken apart within one task.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import LZX, PACK, UNPACK, coded, detect, pack_lzx, unpack_lzx
from ..functions.text import name_hash
from .objects import WEIGHTS, guess_kind

# Columns of each kind's rows, in order.
COLUMNS = {
    "palette": ("idx", "color"),
    "character": ("tile_no", "pos", "idx"),
    "screen": ("width", "height", "cell", "raw"),
    "cell": ("cell", "cell_attr", "n", "attr0", "attr1", "attr2"),
    "animation": ("seq", "start", "type", "mode", "frame_no", "duration", "index", "rot_z", "sx", "sy", "px", "py"),
    "multicell": ("mc", "node", "seq", "x", "y", "attr"),
    "texture": ("part", "place", "value"),
    "layout": ("n", "x", "y", "origin_x", "origin_y", "align_x", "align_y", "value", "height"),
}

Rows = list[tuple]


def _u16(data: bytes, at: int = 0, count: int | None = None) -> list[int]:
    """Little-endian 16-bit numbers; ValueError if there are fewer than ``count``."""
    n = (len(data) - at) // 2 if count is None else count
    if n < 0 or at + 2 * n > len(data):
        raise ValueError("too short")
    return np.frombuffer(data, "<u2", n, at).tolist()


def _field(data: bytes, form: str, at: int) -> int:
    """One number of a struct form; ValueError beyond the end."""
    if at < 0 or at + struct.calcsize(form) > len(data):
        raise ValueError("too short")
    return struct.unpack_from(form, data, at)[0]


def _pack16(values: Iterable[int]) -> bytes:
    return np.array([int(v) & 0xFFFF for v in values], "<u2").tobytes()


# ---- containers

def pack_blocks(signature: str, blocks: list[tuple[str, bytes]], reversed_: bool = True, old: bool = False) -> bytes:
    """A file of blocks: 16 bytes of header, then each block's signature and size and its data, padded to 4.

    Signatures are stored backwards or as they read. Old files leave the blocks' own headers out of all sizes.
    """
    name = (lambda s: s.encode("latin-1")[::-1]) if reversed_ else (lambda s: s.encode("latin-1"))
    body = b""
    for s, data in blocks:
        data += bytes(-len(data) % 4)
        body += name(s) + struct.pack("<I", len(data) + (0 if old else 8)) + data
    size = 16 + len(body) - (8 * len(blocks) if old else 0)
    return name(signature) + struct.pack("<HHIHH", 0xFEFF, 0x0100, size, 16, len(blocks)) + body


def _printable(data: bytes, at: int) -> bool:
    return len(data) >= at + 4 and all(0x20 <= c < 0x80 for c in data[at : at + 4])


def block_list(data: bytes) -> list[tuple[str, bytes]]:
    """(signature as stored, data) of a file of blocks, of either form; ValueError if it isn't one."""
    if len(data) < 16 or not _printable(data, 0):
        raise ValueError("another kind")
    mark, _, size, start, count = struct.unpack_from("<HHIHH", data, 4)
    if not 16 <= start <= len(data) or mark not in (0xFFFE, 0xFEFF, 0) or not count:
        raise ValueError("another kind")
    old = size + 8 * count == len(data)
    if not old and len(data) not in (size, (size + 3) // 4 * 4):
        raise ValueError("another size")
    out, at = [], start
    for _ in range(count):
        if not _printable(data, at):
            raise ValueError("no signature")
        n = _field(data, "<I", at + 4) - (0 if old else 8)
        if n < 0 or at + 8 + n > len(data):
            raise ValueError("too long")
        out.append((data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


def _blocks(data: bytes, signatures: tuple[str, ...], reversed_: bool) -> dict[str, bytes]:
    """The blocks of a file with one of the signatures, by name, the first of each; ValueError if it isn't such a file."""
    turn = (lambda s: s[::-1]) if reversed_ else (lambda s: s)
    if turn(data[:4].decode("latin-1")) not in signatures:
        raise ValueError("another kind")
    out: dict[str, bytes] = {}
    for s, body in block_list(data):
        out.setdefault(turn(s), body)
    return out


def pack_offset_blocks(signature: str, blocks: list[tuple[str, bytes]]) -> bytes:
    """A file of blocks whose places stand in a table after the header."""
    data = [s.encode("latin-1") + struct.pack("<I", len(d) + 8 + -len(d) % 4) + d + bytes(-len(d) % 4) for s, d in blocks]
    start = 16 + 4 * len(blocks)
    places = np.cumsum([start, *map(len, data)])[:-1].tolist()
    size = start + sum(map(len, data))
    return signature.encode("latin-1") + struct.pack("<HHIHH", 0xFEFF, 0x0100, size, 16, len(blocks)) + struct.pack(f"<{len(blocks)}I", *places) + b"".join(data)


def offset_block_list(data: bytes) -> list[tuple[str, bytes]]:
    """(signature, data) of a file whose header has a table of its blocks' places; ValueError if it isn't one."""
    if len(data) < 16 or not _printable(data, 0):
        raise ValueError("another kind")
    mark, _, size, start, count = struct.unpack_from("<HHIHH", data, 4)
    if size != len(data) or start < 16 or mark not in (0xFFFE, 0xFEFF, 0) or not count:
        raise ValueError("another kind")
    out = []
    for k in range(count):
        at = _field(data, "<I", start + 4 * k)
        n = _field(data, "<I", at + 4)
        if not _printable(data, at) or n < 8 or at + n > len(data):
            raise ValueError("no block there")
        out.append((data[at : at + 4].decode("latin-1"), data[at + 8 : at + n]))
    return out


def pack_footer(blocks: list[tuple[str, bytes]]) -> bytes:
    return b"".join(s.encode("latin-1") + struct.pack("<I", len(d)) + d for s, d in [*blocks, ("END ", b"")])


def footer(data: bytes, needed: tuple[str, ...]) -> tuple[int, dict[str, bytes]]:
    """(where it begins, its blocks) of the first run of blocks in ``data`` that ends in an END block and has all that are needed.

    Blocks are followed back from the names of those needed, so that few places are tried.
    """
    names = {n.encode("latin-1") for n in needed}
    starts = sorted({at for n in names for at in _places(data, n)})
    for start in starts:
        at, own = start, {}
        while at + 8 <= len(data) and _printable(data, at):
            n = _field(data, "<I", at + 4)
            if at + 8 + n > len(data):
                break
            name = data[at : at + 4].decode("latin-1")
            own.setdefault(name, data[at + 8 : at + 8 + n])
            at += 8 + n
            if name == "END ":
                if set(needed) <= own.keys():
                    return start, own
                break
    raise ValueError("no footer")


def _places(data: bytes, name: bytes):
    at = data.find(name)
    while at >= 0:
        yield at
        at = data.find(name, at + 1)


def resource_blocks(data: bytes) -> dict[str, bytes]:
    """Blocks of a resource file by signature: each reaches to the next one's place; ValueError if it isn't one."""
    if data[:4] != b"RSRC":
        raise ValueError("another kind")
    count = _field(data, "<I", 4)
    if not count or (len(data) - 8) // 4 < count:
        raise ValueError("too short")
    places = [_field(data, "<I", 8 + 4 * k) for k in range(count)]
    if any(p % 4 or p < 8 or not _printable(data, p) for p in places):
        raise ValueError("no block there")
    stops = {p: min([q for q in places if q > p], default=len(data)) for p in places}
    out: dict[str, bytes] = {}
    for p in places:
        out.setdefault(data[p : p + 4].decode("latin-1"), data[p + 4 : stops[p]])
    return out


def pack_resource(blocks: list[tuple[str, bytes]]) -> bytes:
    at, places, body = 8 + 4 * len(blocks), [], b""
    for s, d in blocks:
        places.append(at + len(body))
        body += s.encode("latin-1") + d + bytes(-len(d) % 4)
    return b"RSRC" + struct.pack(f"<I{len(blocks)}I", len(blocks), *places) + body


# ---- pixels

def _tiles(data: bytes, bits: int, count: int, width: int = 0) -> Rows:
    """Rows of 8 x 8 tiles: each after another, or, with a width in tiles, as one bitmap of that width."""
    need = count * bits * 8
    if bits not in (4, 8) or len(data) < need:
        raise ValueError("too short")
    px = np.frombuffer(data, np.uint8, need)
    if bits == 4:
        px = np.stack((px & 15, px >> 4), axis=1).ravel()
    if width:
        px = px.reshape(count // width, 8, width, 8).transpose(0, 2, 1, 3)
    flat = px.reshape(-1, 64)
    return [(t, p, v) for t, row in enumerate(flat.tolist()) for p, v in enumerate(row)]


def _pixels(rows: Rows, bits: int) -> tuple[int, bytes]:
    """(tiles, bytes) of tiles one after another; pixels that no row gives are 0."""
    count = max((t for t, _, _ in rows), default=-1) + 1
    px = np.zeros((count, 64), np.uint8)
    for t, p, v in rows:
        px[t, p] = v
    if bits == 4:
        px = px[:, ::2] & 15 | px[:, 1::2] << 4
    return count, px.tobytes()


def _depth(rows: Rows) -> int:
    return 8 if any(v > 15 for *_, v in rows) else 4


def panels(width: int, height: int) -> list[int]:
    """Where each stored cell of a screen lies: panels of 32 x 32 one after another, rows within them."""
    grid = np.arange(width * height).reshape(height, width)
    return np.concatenate([grid[y : y + 32, x : x + 32].ravel() for y in range(0, height, 32) for x in range(0, width, 32)] or [np.zeros(0, np.int64)]).tolist()


def _screen(values: list[int], width: int, height: int, in_panels: bool) -> Rows:
    if len(values) < width * height:
        raise ValueError("too short")
    places = panels(width, height) if in_panels else range(width * height)
    return sorted((width, height, p, v) for p, v in zip(places, values, strict=False))


def _stored(rows: Rows, in_panels: bool) -> tuple[int, int, list[int]]:
    """(width, height, values in stored order); cells that no row gives are 0."""
    width, height = (rows[0][0], rows[0][1]) if rows else (0, 0)
    of = {c: v for _, _, c, v in rows}
    places = panels(width, height) if in_panels else range(width * height)
    return width, height, [of.get(p, 0) for p in places]


# ---- palettes

def _read_nclr(data: bytes) -> Rows:
    own = _blocks(data, ("NCLR", "NCPR"), True)
    pltt = own["PLTT"]
    bits = 1 << (_field(pltt, "<I", 0) - 1 & 31)
    extended, size, at = (_field(pltt, "<I", k) for k in (4, 8, 12))
    if bits not in (4, 8):
        raise ValueError("no such depth")
    if "PCMP" not in own:
        return list(enumerate(_u16(pltt, at, size // 2)))
    pcmp = own["PCMP"]
    numbers = _u16(pcmp, _field(pcmp, "<I", 4), _field(pcmp, "<H", 0))
    whole = 16 << bits if bits == 4 or extended else 256
    colors, part = [0] * whole, 1 << bits
    for k, number in enumerate(numbers):
        if (number + 1) * part > whole:
            raise ValueError("beyond the palette")
        colors[number * part : (number + 1) * part] = _u16(pltt, at + 2 * k * part, part)
    return list(enumerate(colors))


def _colors(rows: Rows) -> list[int]:
    of = dict(rows)
    return [of.get(i, 0) for i in range(max(of, default=-1) + 1)]


def _write_nclr(rows: Rows) -> bytes:
    colors = _colors(rows)
    return pack_blocks("NCLR", [("PLTT", struct.pack("<IIII", 3, len(colors) > 256, 2 * len(colors), 16) + _pack16(colors))])


def write_compressed_nclr(rows: Rows) -> bytes:
    """A palette file that leaves palettes of 16 without any colour out and numbers the others."""
    colors = _colors(rows)
    used = [k for k in range(-(-len(colors) // 16)) if any(colors[16 * k : 16 * k + 16])]
    kept = [c for k in used for c in (colors[16 * k : 16 * k + 16] + [0] * 16)[:16]]
    return pack_blocks("NCLR", [("PLTT", struct.pack("<IIII", 3, 0, 2 * len(colors), 16) + _pack16(kept)), ("PCMP", struct.pack("<HHI", len(used), 0xBEEF, 8) + _pack16(used))])


def _read_ncl(data: bytes) -> Rows:
    palt = _blocks(data, ("NCCL",), False)["PALT"]
    return list(enumerate(_u16(palt, 8, _field(palt, "<I", 0) * _field(palt, "<I", 4))))


def _write_ncl(rows: Rows) -> bytes:
    colors = _colors(rows)
    colors += [0] * (-len(colors) % 16)
    return pack_blocks("NCCL", [("PALT", struct.pack("<II", 16, len(colors) // 16) + _pack16(colors))], False)


def _studio(signature: str):
    def read(data: bytes) -> Rows:
        palt = _blocks(data, (signature,), False)["PALT"]
        return list(enumerate(_u16(palt, 4, _field(palt, "<I", 0))))

    def write(rows: Rows) -> bytes:
        colors = _colors(rows)
        return pack_blocks(signature, [("PALT", struct.pack("<I", len(colors)) + _pack16(colors))], False)

    return read, write


def _read_tose_palette(data: bytes) -> Rows:
    if data[:4] != b"NCL\0" or _field(data, "<I", 4) != (len(data) - 8) // 2:
        raise ValueError("another kind")
    return list(enumerate(_u16(data, 8)))


def _read_hudson_palette(data: bytes) -> Rows:
    size, count = _field(data, "<H", 0), _field(data, "<H", 2)
    if data[0] == 0x10 or not count or size % 2 or size + 4 != len(data) or 2 * count + 4 != len(data) or not _whole_palettes(count):
        raise ValueError("another kind")
    colors = _u16(data, 4)
    if any(c & 0x8000 for c in colors):
        raise ValueError("no colours")
    return list(enumerate(colors))


def _whole_palettes(count: int) -> bool:
    return count % 16 == 0 and (count <= 256 or count % 256 == 0)


def _read_raw_palette(data: bytes) -> Rows:
    if not 16 <= len(data) <= 8192 or len(data) % 2 or not _whole_palettes(len(data) // 2):
        raise ValueError("another size")
    return list(enumerate(_u16(data)))


def _read_ntfp(data: bytes) -> Rows:
    if len(data) % 2:
        raise ValueError("another size")
    return list(enumerate(_u16(data)))


def _read_resource_palette(data: bytes) -> Rows:
    pltt = resource_blocks(data)["PLTT"]
    return list(enumerate(_u16(pltt, 4, _field(pltt, "<I", 0) // 2)))


# ---- characters

def _read_ncgr(data: bytes) -> Rows:
    char = _blocks(data, ("NCGR",), True)["CHAR"]
    height, width = _field(char, "<H", 0), _field(char, "<H", 2)
    bits, _, order, size, at = (_field(char, "<I", k) for k in (4, 8, 12, 16, 20))
    bits = 1 << (bits - 1 & 31)
    if bits not in (4, 8):
        raise ValueError("no such depth")
    count = size // (bits * 8)
    return _tiles(char[at:], bits, count, width if order == 1 and width and width * height == count else 0)


def _write_ncgr(rows: Rows) -> bytes:
    bits = _depth(rows)
    count, px = _pixels(rows, bits)
    return pack_blocks("NCGR", [("CHAR", struct.pack("<HHIIIII", 0xFFFF, 0xFFFF, bits.bit_length(), 0x10, 0, len(px), 24) + px)])


def _read_ncg(data: bytes) -> Rows:
    char = _blocks(data, ("NCCG",), False)["CHAR"]
    width, height, kind = (_field(char, "<I", k) for k in (0, 4, 8))
    return _tiles(char[12:], 8 if kind else 4, width * height)


def _write_ncg(rows: Rows) -> bytes:
    bits = _depth(rows)
    count, px = _pixels(rows, bits)
    return pack_blocks("NCCG", [("CHAR", struct.pack("<III", count, 1, bits == 8) + px)], False)


def _read_tose_character(data: bytes) -> Rows:
    count = _field(data, "<H", 4)
    if data[:4] != b"NCG\0" or len(data) - 8 not in (32 * count, 64 * count):
        raise ValueError("another kind")
    return _tiles(data[8:], 8 if _field(data, "<H", 6) & 1 else 4, count)


def _write_tose_character(rows: Rows) -> bytes:
    bits = _depth(rows)
    count, px = _pixels(rows, bits)
    return b"NCG\0" + struct.pack("<HH", count, 3 if bits == 8 else 0) + px


def _hudson_length(data: bytes) -> int:
    if len(data) < 8 or data[0] & 0xF0 or data[3]:
        raise ValueError("another kind")
    return _field(data, "<H", 1)


def _read_hudson_character(data: bytes) -> Rows:
    n = _hudson_length(data)
    if len(data) in (32 * n + 4, 64 * n + 4) or data[4] > 1 or n + 4 != len(data):
        raise ValueError("another kind")
    return _tiles(data[8:], 8 if data[4] else 4, _field(data, "<H", 5))


def _write_hudson_character(rows: Rows) -> bytes:
    bits = _depth(rows)
    count, px = _pixels(rows, bits)
    if len(px) + 4 > 0xFFFF:
        raise ValueError("too long for the format")
    return b"\0" + struct.pack("<HBBHB", len(px) + 4, 0, bits == 8, count, 0) + px


def _read_hudson2_character(data: bytes) -> Rows:
    n = _hudson_length(data)
    if len(data) not in (32 * n + 4, 64 * n + 4):
        raise ValueError("another kind")
    return _tiles(data[4:], 8 if data[0] else 4, n)


def _write_hudson2_character(rows: Rows) -> bytes:
    bits = _depth(rows)
    count, px = _pixels(rows, bits)
    return bytes((bits == 8,)) + struct.pack("<HB", count, 0) + px


def _read_slices(data: bytes) -> Rows:
    """Graphics in packed slices one after another, with up to 7 zeros between."""
    out, at = b"", 0
    while at < len(data):
        if data[at] != LZX:
            raise ValueError("another kind")
        stop = _end_of_lzx(data, at)
        out += unpack_lzx(data[at:stop])
        at = stop
        while at < len(data) and not data[at]:
            at += 1
        if at - stop >= 8:
            raise ValueError("a gap")
    if not data:
        raise ValueError("too short")
    return _tiles(out, 4, len(out) // 32)


def _end_of_lzx(data: bytes, start: int) -> int:
    """Where a payload that begins at ``start`` ends, by its tokens alone."""
    need, at, done = _field(data, "<I", start) >> 8, start + 4, 0
    while done < need:
        flags, at = _field(data, "<B", at), at + 1
        for bit in range(7, -1, -1):
            if done >= need:
                break
            if not flags >> bit & 1:
                done, at = done + 1, at + 1
                continue
            size, base, mask = {0: (3, 0x11, 0xFF), 1: (4, 0x111, 0xFFFF)}.get(_field(data, "<B", at) >> 4, (2, 1, 0xF))
            done += (int.from_bytes(data[at : at + size], "big") >> 12 & mask) + base
            at += size
    if at > len(data):
        raise ValueError("too short")
    return at


def _write_slices(rows: Rows) -> bytes:
    packed = pack_lzx(_pixels(rows, 4)[1])
    return packed + bytes(-len(packed) % 4)


#: Blocks of the footers that character and screen files have.
_CHARACTER_FOOTER = ("LINK", "CMNT", "MODE", "SIZE", "VER ")
_SCREEN_FOOTER = ("CLRF", "LINK", "CMNT", "CLRC", "MODE", "VER ")


def _footed_character(version: bytes, wide_modes: tuple[int, ...], modes: tuple[int, int]):
    """Graphics with an attribute a tile and a footer that has size and depth."""

    def read(data: bytes) -> Rows:
        _, own = footer(data, _CHARACTER_FOOTER)
        if not own["VER "].startswith(version) or len(own["VER "]) < 8:
            raise ValueError("another version")
        width, height = _field(own["SIZE"], "<H", 0), _field(own["SIZE"], "<H", 2)
        return _tiles(data, 8 if _field(own["MODE"], "<I", 0) in wide_modes else 4, width * height)

    def write(rows: Rows) -> bytes:
        bits = _depth(rows)
        count, px = _pixels(rows, bits)
        return px + bytes(count) + pack_footer([("LINK", b"\0\0"), ("CMNT", b"\0\0"), ("MODE", struct.pack("<I", modes[bits == 8])), ("SIZE", struct.pack("<HH", count, 1)), ("VER ", version + b"01")])

    return read, write


def _read_resource_character(data: bytes) -> Rows:
    char = resource_blocks(data)["CHAR"]
    width, height, flags = (_field(char, "<H", k) for k in (4, 6, 8))
    return _tiles(char[12:], 8 if flags & 2 else 4, width * height, width if flags & 4 else 0)


def _write_resource_character(rows: Rows) -> bytes:
    bits = _depth(rows)
    count, px = _pixels(rows, bits)
    return pack_resource([("CHAR", struct.pack("<IHHHH", len(px), count, 1, 1 | (2 if bits == 8 else 0) | 64, 0) + px)])


def _read_raw_character(data: bytes) -> Rows:
    if len(data) % 32:
        raise ValueError("another size")
    return _tiles(data, 4, len(data) // 32)


# ---- screens

# Width and height in cells of raw screens by their cells.
RAW_SCREENS = {256: (16, 16), 768: (32, 24), 1024: (32, 32), 2048: (32, 64), 4096: (64, 64), 8192: (128, 64), 16384: (128, 128)}
TEXT, AFFINE, EXTENDED = 0, 1, 2


def _read_nscr(data: bytes) -> Rows:
    scrn = _blocks(data, ("NSCR",), True)["SCRN"]
    width, height, _, form = (_field(scrn, "<H", k) for k in (0, 2, 4, 6))
    size = _field(scrn, "<I", 8)
    body = scrn[12 : 12 + size]
    return _screen(list(body) if form == AFFINE else _u16(body), width // 8, height // 8, form == TEXT)


def _write_nscr(rows: Rows) -> bytes:
    width, height, values = _stored(rows, True)
    return pack_blocks("NSCR", [("SCRN", struct.pack("<HHHHI", 8 * width, 8 * height, 0, TEXT, 2 * len(values)) + _pack16(values))])


def _read_nsc(data: bytes) -> Rows:
    scrn = _blocks(data, ("NCSC",), False)["SCRN"]
    width, height, affine, colors = (_field(scrn, "<I", k) for k in (0, 4, 8, 12))
    body = scrn[16:]
    return _screen(list(body) if affine and colors != 2 else _u16(body), width, height, False)


def _write_nsc(rows: Rows) -> bytes:
    width, height, values = _stored(rows, False)
    return pack_blocks("NCSC", [("SCRN", struct.pack("<IIII", width, height, 0, 0) + _pack16(values))], False)


def _read_tose_screen(data: bytes) -> Rows:
    count, form, colors, width, height = _field(data, "<H", 4), *(_field(data, "<B", k) for k in (6, 7, 8, 9))
    if data[:4] != b"NSC\0" or len(data) - 12 != 2 * count or width * height != count or form > 4 or colors > 2:
        raise ValueError("another kind")
    return _screen(list(data[12:]) if form == AFFINE else _u16(data, 12), width, height, False)


def _write_tose_screen(rows: Rows) -> bytes:
    width, height, values = _stored(rows, False)
    return b"NSC\0" + struct.pack("<HBBBBH", len(values), 0, 0, width, height, 0) + _pack16(values)


def _read_hudson_screen(data: bytes) -> Rows:
    width, height = _field(data, "<B", 6), _field(data, "<B", 7)
    if data[0] == 0x10 or _field(data, "<H", 1) + 4 != len(data) or not width * height or 2 * width * height + 8 != len(data):
        raise ValueError("another kind")
    return _screen(_u16(data, 8), width, height, True)


def _write_hudson_screen(rows: Rows) -> bytes:
    width, height, values = _stored(rows, True)
    return struct.pack("<BHBHBB", 0, 2 * len(values) + 4, 0, 2 * len(values), width, height) + _pack16(values)


def _read_hudson2_screen(data: bytes) -> Rows:
    width, height = _field(data, "<B", 2), _field(data, "<B", 3)
    if data[0] == 0x10 or _field(data, "<H", 0) + 4 != len(data) or 2 * width * height + 4 != len(data):
        raise ValueError("another kind")
    return _screen(_u16(data, 4), width, height, True)


def _write_hudson2_screen(rows: Rows) -> bytes:
    width, height, values = _stored(rows, True)
    return struct.pack("<HBB", 2 * len(values), width, height) + _pack16(values)


def _footed_screen(version: bytes, sized: bool):
    """Cells in panels with a footer; one of the two has the size in a block of its own, the other in the mode's."""

    def read(data: bytes) -> Rows:
        _, own = footer(data, (*_SCREEN_FOOTER, "SIZE") if sized else _SCREEN_FOOTER)
        if not own["VER "].startswith(version) or len(own["VER "]) < 8:
            raise ValueError("another version")
        width, height = (_field(own["SIZE"], "<H", 0), _field(own["SIZE"], "<H", 2)) if sized else (_field(own["MODE"], "<B", 0), _field(own["MODE"], "<B", 1))
        affine = _field(own["MODE"], "<B", 0 if sized else 2)
        return _screen(list(data[: width * height]) if affine else _u16(data, 0, width * height), width, height, not affine)

    def write(rows: Rows) -> bytes:
        width, height, values = _stored(rows, True)
        mode = b"\0\0" if sized else struct.pack("<BBBB", width, height, 0, 2)
        size = [("SIZE", struct.pack("<HH", width, height))] if sized else []
        return _pack16(values) + pack_footer([("CLRF", bytes((2 * len(values) + 15) // 16)), ("LINK", b""), ("CMNT", b"\0\0"), ("CLRC", b"\0\0"), ("MODE", mode), *size, ("VER ", version + b"01")])

    return read, write


def _read_raw_screen(data: bytes) -> Rows:
    if len(data) % 2 or len(data) // 2 not in RAW_SCREENS:
        raise ValueError("another size")
    return _screen(_u16(data), *RAW_SCREENS[len(data) // 2], True)


# ---- textures

# What the places of a texture's part 0 hold; parts 1, 2 and 3 are texels, block indices and colours.
TEXTURE_PLACES = ("fmt", "width", "height", "color0", "wrap")
BLOCK_TEXTURE, DIRECT_TEXTURE = 5, 7


def _texture(fmt: int, width: int, height: int, color0: int, wrap: int, texels: bytes, indices: list[int], colors: list[int]) -> Rows:
    if not 1 <= fmt <= DIRECT_TEXTURE:
        raise ValueError("no such format")
    own = [(0, k, v) for k, v in enumerate((fmt, width, height, color0, wrap))] + [(1, k, v) for k, v in enumerate(texels)]
    return own + [(2, k, v) for k, v in enumerate(indices if fmt == BLOCK_TEXTURE else [])] + [(3, k, v) for k, v in enumerate(colors if fmt != DIRECT_TEXTURE else [])]


def _texture_parts(rows: Rows) -> tuple[list[int], bytes, list[int], list[int]]:
    parts = [[v for _, v in sorted((k, v) for p, k, v in rows if p == part)] for part in range(4)]
    return parts[0], bytes(parts[1]), parts[2], parts[3]


def _slice(data: bytes, at: int, size: int) -> bytes:
    if at > len(data) or size > len(data) - at:
        raise ValueError("beyond the end")
    return data[at : at + size]


def _read_spt(data: bytes) -> Rows:
    if data[:4] != b" TPS" or len(data) < 32:
        raise ValueError("another kind")
    word, texels, at_colors, colors, at_indices, indices, whole = struct.unpack_from("<7I", data, 4)
    if texels + colors + indices + 32 != whole:
        raise ValueError("another size")
    return _texture(word & 15, 8 << (word >> 4 & 15), 8 << (word >> 8 & 15), word >> 16 & 1, word >> 12 & 15, _slice(data, 32, texels), _u16(_slice(data, at_indices, indices)), _u16(_slice(data, at_colors, colors)))


def _write_spt(rows: Rows) -> bytes:
    (fmt, width, height, color0, wrap), texels, indices, colors = _texture_parts(rows)
    word = fmt | (width.bit_length() - 4) << 4 | (height.bit_length() - 4) << 8 | wrap << 12 | color0 << 16
    c, i = _pack16(colors), _pack16(indices)
    at = 32 + len(texels)
    return b" TPS" + struct.pack("<7I", word, len(texels), at, len(c), at + len(c), len(i), at + len(c) + len(i)) + texels + c + i


def _read_tex(data: bytes) -> Rows:
    if data[:4] != b"tex\0" or len(data) < 40:
        raise ValueError("another kind")
    fmt, width, height = struct.unpack_from("<HHH", data, 6)
    at_colors, colors, _, at_texels, texels, at_indices, indices = struct.unpack_from("<7I", data, 12)
    if not 1 <= fmt <= DIRECT_TEXTURE or max(8 << width, 8 << height) > 1024 or colors % 2:
        raise ValueError("another kind")
    if fmt == BLOCK_TEXTURE and (not at_indices or not indices or indices != texels // 2):
        raise ValueError("no indices")
    return _texture(fmt, 8 << width, 8 << height, 0, 0, _slice(data, at_texels, texels), _u16(_slice(data, at_indices, indices)) if fmt == BLOCK_TEXTURE else [], _u16(_slice(data, at_colors, colors)) if fmt != DIRECT_TEXTURE else [])


def _write_tex(rows: Rows) -> bytes:
    (fmt, width, height, _, _), texels, indices, colors = _texture_parts(rows)
    c, i = _pack16(colors), _pack16(indices)
    at = 40 + len(texels)
    return b"tex\0\0\0" + struct.pack("<HHH7I", fmt, width.bit_length() - 4, height.bit_length() - 4, at, len(c), 0, 40, len(texels), at + len(c) if i else 0, len(i)) + texels + c + i


# ---- layouts

def _layout(signature: bytes, form: str):
    """Elements at packed positions: a cell's number, or a region's width and height."""
    size = 4 + struct.calcsize(form)

    def split(raw: int) -> tuple[int, int, int]:
        origin, align = raw >> 12 & 3, raw >> 14
        if origin == 3 or align == 3:
            raise ValueError("no such origin")
        return (raw & 0xFFF) - (raw << 1 & 0x1000), origin, align

    def read(data: bytes) -> Rows:
        if data[:4] != signature:
            raise ValueError("another kind")
        count = _field(data, "<H", 6)
        if (len(data) - 8) // size < count:
            raise ValueError("too short")
        out = []
        for k in range(count):
            (x, ox, ax), (y, oy, ay) = (split(_field(data, "<H", 8 + size * k + at)) for at in (0, 2))
            own = struct.unpack_from(form, data, 12 + size * k)
            out.append((k, x, y, ox, oy, ax, ay, *(own if len(own) == 2 else (own[0], 0))))
        return out

    def write(rows: Rows) -> bytes:
        word = lambda v, origin, align: v & 0xFFF | origin << 12 | align << 14
        body = b"".join(struct.pack("<HH", word(x, ox, ax), word(y, oy, ay)) + struct.pack(form, *(v, w)[: len(form) - 1]) for _, x, y, ox, oy, ax, ay, v, w in sorted(rows))
        return signature + struct.pack("<HH", 0, len(rows)) + body

    return read, write


# ---- cells, animations, multi-cells

def _read_ncer(data: bytes) -> Rows:
    bank = _blocks(data, ("NCER",), True)["CEBK"]
    count, boxes, at = _field(bank, "<H", 0), _field(bank, "<H", 2), _field(bank, "<I", 4)
    size = 16 if boxes == 1 else 8
    objects, out = at + count * size, []
    for k in range(count):
        n, attr, where = _field(bank, "<H", at + size * k), _field(bank, "<H", at + size * k + 2), _field(bank, "<I", at + size * k + 4)
        values = _u16(bank, objects + where, 3 * n)
        out += [(k, attr, i, *values[3 * i : 3 * i + 3]) for i in range(n)] or [(k, attr, 0, 0x200, 0, 0)]  # an empty cell: one that isn't drawn
    return out


def _write_ncer(rows: Rows) -> bytes:
    count = max((r[0] for r in rows), default=-1) + 1
    heads, objects = b"", b""
    for k in range(count):
        own = sorted(r for r in rows if r[0] == k)
        heads += struct.pack("<HHI", len(own), own[0][1] if own else 0, len(objects))
        objects += b"".join(_pack16(r[3:6]) for r in own)
    return pack_blocks("NCER", [("CEBK", struct.pack("<HHIIIII", count, 0, 24, 0, 0, 0, 0) + heads + objects)])


#: Values of a frame that its type doesn't store: no turn, a scale of one, no offset.
PLAIN = (0, 4096, 4096, 0, 0)
# Struct forms of a frame's data by type: index; index, turn, scale and offset; index and offset.
FRAME_FORMS = ("<H", "<HHiihh", "<HHhh")


def _frame(form: int, values: tuple) -> tuple:
    """(index, rot_z, sx, sy, px, py) from what a frame of a type stores."""
    if form == 1:
        return values
    return (values[0], *PLAIN[:3], *values[2:]) if form == 2 else (values[0], *PLAIN)


def _read_nanr(data: bytes) -> Rows:
    bank = _blocks(data, ("NANR",), True)["ABNK"]
    count = _field(bank, "<H", 0)
    sequences, frames, values = (_field(bank, "<I", k) for k in (4, 8, 12))
    out = []
    for s in range(count):
        if sequences + 16 * s + 16 > len(bank):
            raise ValueError("too short")
        n, start, kind, mode, first = struct.unpack_from("<HHIII", bank, sequences + 16 * s)
        form = kind & 0xFFFF
        if form >= len(FRAME_FORMS):
            raise ValueError("no such frame type")
        for i in range(n):
            at = frames + first + 8 * i
            where, duration = values + _field(bank, "<I", at), _field(bank, "<H", at + 4)
            if where + struct.calcsize(FRAME_FORMS[form]) > len(bank):
                raise ValueError("too short")
            out.append((s, start, kind >> 16, mode, i, duration, *_frame(form, struct.unpack_from(FRAME_FORMS[form], bank, where))))
    return out


def _write_nanr(rows: Rows) -> bytes:
    """Each sequence in its narrowest frame type; equal frame data is stored once."""
    count = max((r[0] for r in rows), default=-1) + 1
    heads, frames, values, place = b"", b"", b"", {}
    for s in range(count):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[4])
        turned, moved = any(r[7:10] != PLAIN[:3] for r in own), any(r[10:12] != (0, 0) for r in own)
        form = 1 if turned else 2 if moved else 0
        _, start, kind, mode = own[0][:4] if own else (s, 0, 1, 1)
        heads += struct.pack("<HHIII", len(own), start, kind << 16 | form, mode, len(frames))
        for r in own:
            index = r[6]
            stored = struct.pack(FRAME_FORMS[form], *((index, *r[7:12]) if form == 1 else (index, 0xBEEF, *r[10:12]) if form == 2 else (index,)))
            stored += bytes(-len(stored) % 4)
            if stored not in place:
                place[stored] = len(values)
                values += stored
            frames += struct.pack("<IHH", place[stored], r[5], 0xBEEF)
    head = struct.pack("<HHIIIII", count, len(frames) // 8, 24, 24 + len(heads), 24 + len(heads) + len(frames), 0, 0)
    return pack_blocks("NANR", [("ABNK", head + heads + frames + values)])


def _read_nmcr(data: bytes) -> Rows:
    bank = _blocks(data, ("NMCR",), True)["MCBK"]
    count, cells, nodes = _field(bank, "<H", 0), _field(bank, "<I", 4), _field(bank, "<I", 8)
    out = []
    for k in range(count):
        n, where = _field(bank, "<H", cells + 8 * k), _field(bank, "<I", cells + 8 * k + 4)
        for i in range(n):
            at = nodes + where + 8 * i
            out.append((k, i, _field(bank, "<H", at), _field(bank, "<h", at + 2), _field(bank, "<h", at + 4), _field(bank, "<H", at + 6)))
    return out


def _write_nmcr(rows: Rows) -> bytes:
    count = max((r[0] for r in rows), default=-1) + 1
    cells, nodes = b"", b""
    for k in range(count):
        own = sorted(r for r in rows if r[0] == k)
        cells += struct.pack("<HHI", len(own), len({r[2] for r in own}), len(nodes))
        nodes += b"".join(struct.pack("<HhhH", *r[2:6]) for r in own)
    return pack_blocks("NMCR", [("MCBK", struct.pack("<HHIIII", count, 0, 20, 20 + len(cells), 0, 0) + cells + nodes)])


def _read_segments(data: bytes) -> Rows:
    """One sequence that shows each of its pairs of place and size for a tick; pairs that tile the graphics from 0."""
    if len(data) < 8 or len(data) % 8:
        raise ValueError("another size")
    pairs = np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)
    if (pairs % 4).any() or not pairs[:, 1].all():
        raise ValueError("another kind")
    own = np.unique(pairs, axis=0)
    if (own[:, 0] != np.concatenate(([0], own[:-1].sum(axis=1)))).any():
        raise ValueError("gaps, overlaps, or two sizes at one place")
    return [(0, 0, 1, 1, i, 1, i, *PLAIN) for i in range(len(pairs))]


# ---- registry

@dataclass(frozen=True)
class Format:
    """A format of a kind: what its check looks at, and how rows are read and written."""

    kind: str
    name: str
    checks: tuple[str, ...]
    read: Callable[[bytes], Rows]
    write: Callable[[Rows], bytes] | None = None

    @property
    def confidence(self) -> int:
        own = sum(w for name, (_, w) in WEIGHTS.items() if name in self.checks and name not in ("host", "over_host"))
        return own + (475 if {"host", "over_host"} & set(self.checks) else 0)

    def valid(self, data: bytes) -> bool:
        """Whether ``data`` reads as this format: a file that a reader refuses isn't one."""
        try:
            self.read(data)
        except (ValueError, KeyError, IndexError, struct.error):
            return False
        return True


class Registry:
    """Formats in the order in which they were registered. A kind's name for one is free for one only."""

    def __init__(self, formats: Iterable[Format] = ()):
        self.formats: list[Format] = []
        for f in formats:
            self.register(f)

    def register(self, f: Format) -> Format:
        if f.kind not in COLUMNS:
            raise ValueError(f"no such kind: {f.kind}")
        if any((x.kind, x.name) == (f.kind, f.name) for x in self.formats):
            raise ValueError(f"{f.kind} {f.name} is registered")
        self.formats.append(f)
        return f

    def named(self, kind: str, name: str) -> Format:
        return next(f for f in self.formats if (f.kind, f.name) == (kind, name))

    def identify(self, data: bytes, kind: str | None = None) -> list[Format]:
        """Formats as which ``data`` reads, the most confident first, then as registered."""
        own = [f for f in self.formats if kind in (None, f.kind) and f.valid(data)]
        return sorted(own, key=lambda f: -f.confidence)


_BLOCKS = ("header", "signature", "chunked", "validated")
FORMATS = Registry(
    [
        Format("palette", "NCLR", (*_BLOCKS, "offsets"), _read_nclr, _write_nclr),
        Format("palette", "NCL", _BLOCKS, _read_ncl, _write_ncl),
        Format("palette", "5PL", _BLOCKS, *_studio("NTPL")),
        Format("palette", "5PC", _BLOCKS, *_studio("NTPC")),
        Format("palette", "Tose", ("header", "signature"), _read_tose_palette, lambda rows: b"NCL\0" + struct.pack("<I", len(_colors(rows))) + _pack16(_colors(rows))),
        Format("palette", "Hudson", ("header",), _read_hudson_palette, lambda rows: struct.pack("<HH", 2 * len(_colors(rows)), len(_colors(rows))) + _pack16(_colors(rows))),
        Format("palette", "Setosa", ("header", "signature", "chunked"), _read_resource_palette, lambda rows: pack_resource([("PLTT", struct.pack("<I", 2 * len(_colors(rows))) + _pack16(_colors(rows)))])),
        Format("palette", "Binary", (), _read_raw_palette, lambda rows: _pack16(_colors(rows))),
        Format("palette", "NTFP", (), _read_ntfp, lambda rows: _pack16(_colors(rows))),
        Format("character", "NCGR", (*_BLOCKS, "offsets"), _read_ncgr, _write_ncgr),
        Format("character", "NCG", _BLOCKS, _read_ncg, _write_ncg),
        Format("character", "ICG", ("footer", "signature", "chunked", "validated"), *_footed_character(b"IS-ICG", (6, 8), (7, 6))),
        Format("character", "ACG", ("footer", "signature", "chunked", "validated"), *_footed_character(b"IS-ACG", (2, 3), (1, 3))),
        Format("character", "Tose", ("header", "signature", "validated"), _read_tose_character, _write_tose_character),
        Format("character", "Hudson", ("header",), _read_hudson_character, _write_hudson_character),
        Format("character", "Hudson 2", ("header",), _read_hudson2_character, _write_hudson2_character),
        Format("character", "Slices", ("compression",), _read_slices, _write_slices),
        Format("character", "Setosa", _BLOCKS, _read_resource_character, _write_resource_character),
        Format("character", "Binary", (), _read_raw_character, lambda rows: _pixels(rows, 4)[1]),
        Format("screen", "NSCR", _BLOCKS, _read_nscr, _write_nscr),
        Format("screen", "NSC", _BLOCKS, _read_nsc, _write_nsc),
        Format("screen", "ISC", ("footer", "signature", "chunked", "validated"), *_footed_screen(b"IS-ISC", True)),
        Format("screen", "ASC", ("footer", "signature", "chunked", "validated"), *_footed_screen(b"IS-ASC", False)),
        Format("screen", "Tose", ("header", "signature"), _read_tose_screen, _write_tose_screen),
        Format("screen", "Hudson", ("header",), _read_hudson_screen, _write_hudson_screen),
        Format("screen", "Hudson 2", ("header",), _read_hudson2_screen, _write_hudson2_screen),
        Format("screen", "Binary", ("size",), _read_raw_screen, lambda rows: _pack16(_stored(rows, True)[2])),
        Format("cell", "NCER", (*_BLOCKS, "offsets"), _read_ncer, _write_ncer),
        Format("animation", "NANR", (*_BLOCKS, "offsets"), _read_nanr, _write_nanr),
        Format("animation", "Segments", ("offsets", "validated"), _read_segments),
        Format("multicell", "NMCR", (*_BLOCKS, "offsets"), _read_nmcr, _write_nmcr),
        Format("texture", "SPT", ("header", "signature", "validated"), _read_spt, _write_spt),
        Format("texture", "To Love Ru", ("header", "signature", "validated", "offsets"), _read_tex, _write_tex),
        Format("layout", "BNCL", ("header", "signature", "validated"), *_layout(b"JNCL", "<I")),
        Format("layout", "BNBL", ("header", "signature", "validated"), *_layout(b"JNBL", "<BB")),
    ]
)

# Endings of the names of raw files, by the format that they speak of, in the order in which they are tried.
ENDINGS = (
    ("palette", "Binary", ("ncl.bin", "icl.bin", "plt.bin", "pal.bin", ".pltt", ".nbfp", ".icl", ".acl", ".plb", ".pal")),
    ("palette", "NTFP", (".ntfp",)),
    ("screen", "Binary", ("nsc.bin", "isc.bin", "scr.bin", ".nbfs", ".isc", ".map", ".map.bin")),
    ("character", "Binary", ("ncg.bin", "icg.bin", "chr.bin", ".char", ".nbfc", ".icg", ".imb", ".img", ".img.bin")),
)


def identified(data: bytes, path: str = "", kind: str | None = None, registry: Registry = FORMATS) -> tuple[str, str, str]:
    """(codec, kind, format) of a file; kind ``invalid`` if nothing fits, format empty where only the kind is guessed.

    A codec is undone first. Where no kind is asked for, a raw file's ending speaks for a format that
    it reads as. Then come the formats' own checks (of formats that check nothing, every size that
    fits would do: they stand back); then the guess by content; then raw palette, screen, character, colours.
    """
    codec = detect(data)
    plain = UNPACK[codec](data)
    if kind is None:
        for k, name, endings in ENDINGS:
            if path.lower().endswith(endings) and registry.named(k, name).valid(plain):
                return codec, k, name
    for f in registry.identify(plain, kind):
        if f.confidence:
            return codec, f.kind, f.name
    guess = guess_kind(plain)
    if guess != "invalid" and kind in (None, guess):
        return codec, guess, "Binary" if registry.named(guess, "Binary").valid(plain) else ""
    for k, name in (("palette", "Binary"), ("screen", "Binary"), ("character", "Binary"), ("palette", "NTFP")):
        if kind in (None, k) and registry.named(k, name).valid(plain):
            return codec, k, name
    return codec, "invalid", ""


# ---- DataFrames

def identify(files: DataFrame, registry: Registry = FORMATS) -> DataFrame:
    """(path, codec, kind, format) of every file (path, bytes); null bytes are invalid."""

    def one(batches):
        for b in batches:
            found = [identified(x, p or "", registry=registry) if x is not None else ("none", "invalid", "") for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], pa.string()) for i in range(3))], ["path", "codec", "kind", "format"])

    return files.select("path", "bytes").mapInArrow(one, "path string, codec string, kind string, format string")


def formats_of(files: DataFrame, registry: Registry = FORMATS) -> DataFrame:
    """(path, place, kind, format, confidence): every format as which a file reads, the most confident first."""

    def one(batches):
        for b in batches:
            rows = [(p, k, f.kind, f.name, f.confidence) for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x is not None for k, f in enumerate(registry.identify(x), 1)]
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "place", "kind", "format", "confidence"])

    return files.select("path", "bytes").mapInArrow(one, "path string, place long, kind string, format string, confidence long")


def read(files: DataFrame, kind: str, registry: Registry = FORMATS) -> DataFrame:
    """(path, *COLUMNS[kind]): rows of every file of a kind, whatever its format and codec; others give none."""
    names = COLUMNS[kind]

    def one(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                codec, found, name = identified(data, path or "", kind, registry)
                if found != kind or not name:
                    continue
                rows = registry.named(kind, name).read(UNPACK[codec](data))
                columns = zip(*rows, strict=True) if rows else ((),) * len(names)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["path", *names])

    return files.select("path", "bytes").mapInArrow(one, f"path string, {', '.join(f'`{n}` long' for n in names)}")


def write(rows: DataFrame, kind: str, name: str, registry: Registry = FORMATS) -> DataFrame:
    """(path, bytes): a file of a format for each path's rows; a file is one group, as it is one value."""
    import pandas as pd

    names, f = list(COLUMNS[kind]), registry.named(kind, name)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(pdf[names].itertuples(index=False, name=None))
        return pd.DataFrame({"path": pdf["path"].iloc[:1], "bytes": [f.write(own)]})

    return rows.select("path", *names).groupBy("path").applyInPandas(one, "path string, bytes binary")


def packed(files: DataFrame, codec: str) -> DataFrame:
    """(path, bytes): files in a codec; those that it can't hold come back as they are."""
    return coded(files, "bytes", PACK[codec], name="bytes_", keep=("path", "bytes")).select("path", F.coalesce("bytes_", "bytes").alias("bytes"))


def rewritten(files: DataFrame, change, registry: Registry = FORMATS) -> DataFrame:
    """(path, bytes): files read, their rows changed by ``change(kind, rows)``, and written in the format and codec that they had.

    What is in no format that can be written comes back as it is.
    """

    def one(batches):
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codec, kind, name = identified(data, path or "", registry=registry) if data is not None else ("none", "invalid", "")
                f = registry.named(kind, name) if name else None
                out.append(PACK[codec](f.write(change(kind, f.read(UNPACK[codec](data))))) if f and f.write else data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "bytes"])

    return files.select("path", "bytes").mapInArrow(one, "path string, bytes binary")


def save(files: DataFrame, folder: str) -> DataFrame:
    """Write each file (path, bytes) under ``folder``, in any store that Arrow knows; returns (path, size) as written.

    A file is written beside its place and then moved there, so a task that is run again leaves the
    same files. Null bytes write nothing.
    """

    def one(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            done = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                place = f"{root}/{path.lstrip('/')}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                beside = f"{place}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(beside) as out:
                    out.write(data)
                store.move(beside, place)
                done.append((path, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "size"])

    return files.select("path", "bytes").mapInArrow(one, "path string, size long")


class Stream:
    """Bytes built up by writing at a place: writing beyond the end fills with zeros, within it replaces."""

    def __init__(self, data: bytes = b""):
        self.data, self.at = bytearray(data), 0

    def write(self, data: bytes) -> int:
        """Bytes put at the place, which moves behind them; the place they begin at."""
        start = self.at
        self.data += bytes(max(0, start - len(self.data)))
        self.data[start : start + len(data)] = data
        self.at = start + len(data)
        return start

    def insert(self, data: bytes) -> None:
        self.data[self.at : self.at] = data
        self.at += len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        """From the begin (0), the place (1) or the end (2); never before the begin."""
        self.at = max(0, offset + (0, self.at, len(self.data))[whence])
        return self.at

    def align(self, to: int) -> None:
        """Zeros up to the next multiple, at the end."""
        self.at = len(self.data)
        self.write(bytes(-len(self.data) % to))

    def take(self, size: int) -> bytes:
        out = bytes(self.data[self.at : self.at + size])
        self.at += len(out)
        return out


# ---- names in trees

NAME_BYTES = 16


def _bit(name: bytes, bit: int) -> int:
    return name[bit // 8] >> bit % 8 & 1


def name_tree(names: list[bytes]) -> tuple | int:
    """A tree over names of up to 16 bytes: (bit, without, with) by the highest bit in which they differ, or a name's number.

    Bits count from the first byte's lowest. Equal names raise.
    """
    whole = [n[:NAME_BYTES].ljust(NAME_BYTES, b"\0") for n in names]

    def grow(own: list[int]):
        if len(own) == 1:
            return own[0]
        differ = [b for b in range(8 * NAME_BYTES - 1, -1, -1) if len({_bit(whole[i], b) for i in own}) == 2]
        if not differ:
            raise ValueError("a name stands twice")
        return (differ[0], *(grow([i for i in own if _bit(whole[i], differ[0]) == side]) for side in (0, 1)))

    return grow(list(range(len(names)))) if names else -1


def find_name(tree: tuple | int, names: list[bytes], name: bytes) -> int:
    """The number of a name by the bits that the tree asks for, and one comparison at its leaf; -1 if it isn't there."""
    own = name[:NAME_BYTES].ljust(NAME_BYTES, b"\0")
    while isinstance(tree, tuple):
        tree = tree[1 + _bit(own, tree[0])]
    return tree if tree >= 0 and names[tree][:NAME_BYTES].ljust(NAME_BYTES, b"\0") == own else -1


def pack_directory(entries: list[tuple[str, bytes]]) -> bytes:
    """A directory of named objects: (name's place, length and hash, object's place) in order of the hash, the names, the objects."""
    own = sorted(entries, key=lambda e: (name_hash(e[0].encode()), e[0]))
    start = 4 + 12 * len(own)
    names = b"".join(n.encode() for n, _ in own)
    names += bytes(-(start + len(names)) % 4)
    heads, objects, at = b"", b"", start
    for n, d in own:
        heads += struct.pack("<IHHI", at, len(n.encode()), name_hash(n.encode()), start + len(names) + len(objects))
        objects += d + bytes(-len(d) % 4)
        at += len(n.encode())
    return struct.pack("<HH", len(own), 1) + heads + names + objects


def directory(data: bytes) -> list[tuple[str, int, int]]:
    """(name, hash, object's place) of a directory, as stored."""
    out = []
    for k in range(_field(data, "<H", 0)):
        at, size, hashed, place = (_field(data, f, 4 + 12 * k + o) for f, o in (("<I", 0), ("<H", 4), ("<H", 6), ("<I", 8)))
        if at + size > len(data) or place > len(data):
            raise ValueError("beyond the end")
        out.append((data[at : at + size].decode(), hashed, place))
    return out
