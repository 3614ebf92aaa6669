"""Byte codecs: run-length, dictionary, prefix-code and difference forms, each with its test of well-formedness.

All are inherently sequential within one payload and work on ``bytes``; payloads are independent
and run as Arrow batches through ``coded``. Every payload begins with a 4-byte header: the kind in
the lowest byte, the plain size above it.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The kinds' header bytes.
LZ, LZX, HUFFMAN4, HUFFMAN8, RUNS, DIFF8, DIFF16 = 0x10, 0x11, 0x24, 0x28, 0x30, 0x80, 0x81
MAGIC = b"LZ77"


def header(kind: int, size: int) -> bytes:
    return (kind | size << 8).to_bytes(4, "little")


def size_of(data: bytes, kind: int) -> int:
    """Plain size of a payload; ValueError if it isn't of this kind."""
    if len(data) < 4 or data[0] != kind:
        raise ValueError("another kind")
    return int.from_bytes(data[1:4], "little")


# ---- differences

def diff8(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    return header(DIFF8, len(data)) + np.diff(a, prepend=np.uint8(0)).astype(np.uint8).tobytes()


def undiff8(data: bytes) -> bytes:
    n = size_of(data, DIFF8)
    if len(data) - 4 < n:
        raise ValueError("too short")
    return np.cumsum(np.frombuffer(data, np.uint8, n, 4), dtype=np.uint8).tobytes()


def diff16(data: bytes) -> bytes:
    a = np.frombuffer(data + b"\0" * (len(data) % 2), "<u2")
    return header(DIFF16, len(data)) + np.diff(a, prepend=np.uint16(0)).astype("<u2").tobytes()


def undiff16(data: bytes) -> bytes:
    n = size_of(data, DIFF16)
    if len(data) - 4 < n + n % 2:
        raise ValueError("too short")
    return np.cumsum(np.frombuffer(data, "<u2", (n + 1) // 2, 4), dtype=np.uint16).astype("<u2").tobytes()[:n]


# ---- runs

def pack_runs(data: bytes) -> bytes:
    """Runs of 3 to 130 in two bytes, up to 128 others after their count; a shortest such form.

    Only a run of 3 or more can pay, and of a longer run every length in between may be the best
    place to stop; so costs are settled from the end, one place at a time.
    """
    n = len(data)
    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(np.concatenate((a[1:] != a[:-1], [True]))) if n else np.zeros(0, np.int64)
    run = (ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1).tolist()
    # cost[i]: bytes from i on when a new token begins there; lit[i]: places a literal token from i covers.
    cost, step = [0] * (n + 1), [0] * (n + 1)
    window: list[tuple[int, int]] = []  # heap of (cost[j] + j, j): literal tokens end at j
    heapq.heappush(window, (n, n))
    for i in range(n - 1, -1, -1):
        while window[0][1] > i + 128:
            heapq.heappop(window)
        best, at = window[0][0] - i + 1, window[0][1] - i
        r = min(run[i], 130)
        for length in {3, r} if r >= 3 else ():
            if 2 + cost[i + length] < best:
                best, at = 2 + cost[i + length], -length
        cost[i], step[i] = best, at
        heapq.heappush(window, (best + i, i))
    out, i = bytearray(header(RUNS, n)), 0
    while i < n:
        if step[i] < 0:
            out += bytes((0x80 | (-step[i] - 3), data[i]))
            i -= step[i]
        else:
            out += bytes((step[i] - 1,)) + data[i : i + step[i]]
            i += step[i]
    return bytes(out)


def unpack_runs(data: bytes) -> bytes:
    n, at, out = size_of(data, RUNS), 4, bytearray()
    while len(out) < n:
        if at >= len(data):
            raise ValueError("too short")
        flag, at = data[at], at + 1
        if flag & 0x80:
            if at >= len(data):
                raise ValueError("too short")
            out += data[at : at + 1] * ((flag & 0x7F) + 3)
            at += 1
        else:
            if at + flag + 1 > len(data):
                raise ValueError("too short")
            out += data[at : at + flag + 1]
            at += flag + 1
    if len(out) != n:
        raise ValueError("too long")
    return bytes(out)


# ---- dictionary

#: Earlier places of the same three bytes that a match search tries, the latest first.
CHAIN = 24


def earlier(data: bytes) -> np.ndarray:
    """For each place the latest earlier one where the same three bytes stand, -1 if none: sorted, not searched for."""
    n = len(data)
    out = np.full(n, -1, np.int64)
    if n > 3:
        a = np.frombuffer(data, np.uint8).astype(np.int64)
        key = a[:-2] << 16 | a[1:-1] << 8 | a[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        out[order[1:][same]] = order[:-1][same]
    return out


def _words(data: bytes, count: int) -> np.ndarray:
    """The 8 bytes from each place on as one little-endian number, ``count`` places beyond the end as zeros."""
    padded = np.zeros(len(data) + count + 8, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + count].copy().view("<u8").ravel()


def matches(data: bytes, longest: int, nearest: int, reach: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of the best earlier match of up to ``longest`` bytes at each place; length 2 for none.

    All places try their candidates together, one step of their chains at a time; the nearest of
    equally long ones wins.
    """
    n = len(data)
    best, distance = np.full(n, 2, np.int64), np.zeros(n, np.int64)
    before = earlier(data)
    at = np.flatnonzero(before >= 0)
    words, j = _words(data, longest + 8), before[at]
    for _ in range(CHAIN):
        own = at - j <= reach
        at, j = at[own], j[own]
        if not len(at):
            break
        length, going = np.zeros(len(at), np.int64), np.arange(len(at))
        for step in range(0, longest, 8):
            x = words[at[going] + step] ^ words[j[going] + step]
            equal = np.where(x == 0, 8, np.log2((x & (~x + np.uint64(1))).astype(np.float64), where=x != 0, out=np.zeros(len(x))).astype(np.int64) >> 3)
            length[going] += equal
            going = going[equal == 8]
            if not len(going):
                break
        length = np.minimum(np.minimum(length, longest), n - at)
        better = (length > best[at]) & (at - j >= nearest)
        best[at[better]], distance[at[better]] = length[better], (at - j)[better]
        j = before[j]
        own = (j >= 0) & (best[at] < np.minimum(longest, n - at))
        at, j = at[own], j[own]
    return best, distance


def pack_lz(data: bytes, nearest: int = 2) -> bytes:
    """Flag bytes, highest bit first; a match is 4 bits of length less 3 and 12 of distance less 1. Fewest bits, settled from the end."""
    n = len(data)
    found, distance = (x.tolist() for x in matches(data, 18, nearest))
    cost, step = [0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        best = 9 + cost[i + 1]
        if (most := found[i]) > 2:
            reached = cost[i + 3 : i + most + 1]
            if 17 + (least := min(reached)) < best:
                best, step[i] = 17 + least, 3 + reached.index(least)
        cost[i] = best
    out, i = bytearray(header(LZ, n)), 0
    while i < n:
        at, flags = len(out), 0
        out.append(0)
        for bit in range(7, -1, -1):
            if i >= n:
                break
            if step[i] == 1:
                out.append(data[i])
            else:
                flags |= 1 << bit
                token = (step[i] - 3) << 12 | (distance[i] - 1)
                out += bytes((token >> 8, token & 0xFF))
            i += step[i]
        out[at] = flags
    return bytes(out)


def _copy(out: bytearray, distance: int, length: int) -> None:
    if distance > len(out):
        raise ValueError("before the start")
    if distance >= length:
        out += out[len(out) - distance : len(out) - distance + length]
    else:
        piece = bytes(out[-distance:])
        out += (piece * (length // distance + 1))[:length]


def unpack_lz(data: bytes) -> bytes:
    n, at, out = size_of(data, LZ), 4, bytearray()
    while len(out) < n:
        if at >= len(data):
            raise ValueError("too short")
        flags, at = data[at], at + 1
        if not flags and n - len(out) >= 8 <= len(data) - at:  # eight bytes as they are
            out += data[at : at + 8]
            at += 8
            continue
        for bit in range(7, -1, -1):
            if len(out) >= n:
                break
            if flags >> bit & 1:
                if at + 2 > len(data):
                    raise ValueError("too short")
                token, at = int.from_bytes(data[at : at + 2], "big"), at + 2
                _copy(out, (token & 0xFFF) + 1, (token >> 12) + 3)
            else:
                if at >= len(data):
                    raise ValueError("too short")
                out.append(data[at])
                at += 1
    if len(out) != n or len(data) - at > 7:
        raise ValueError("not whole")
    return bytes(out)


def pack_lzx(data: bytes) -> bytes:
    """As ``pack_lz`` with three sizes of length: 1 to 16 in 4 bits, then 8 and 16 more bits above 0x11 and 0x111."""
    n, before, longest = len(data), earlier(data).tolist(), 0x110 + 0x1000
    out, i = bytearray(header(LZX, n)), 0
    while i < n:
        at, flags = len(out), 0
        out.append(0)
        for bit in range(7, -1, -1):
            if i >= n:
                break
            length, distance = _longest(data, i, before, min(longest, n - i))
            if length < 3:
                out.append(data[i])
                i += 1
                continue
            flags |= 1 << bit
            if length <= 0x10:
                out += ((length - 1) << 12 | (distance - 1)).to_bytes(2, "big")
            elif length <= 0x110:
                out += ((length - 0x11) << 12 | (distance - 1)).to_bytes(3, "big")
            else:
                out += (1 << 28 | (length - 0x111) << 12 | (distance - 1)).to_bytes(4, "big")
            i += length
        out[at] = flags
    return bytes(out)


def _longest(data: bytes, i: int, before: list[int], most: int, reach: int = 4096) -> tuple[int, int]:
    """(length, distance) of the longest match at one place, along the chain of earlier places; length 2 for none."""
    best, distance, j = 2, 0, before[i]
    for _ in range(CHAIN):
        if j < 0 or i - j > reach or best >= most:
            break
        if data[j + best] == data[i + best]:
            k = 3
            while k + 16 <= most and data[j + k : j + k + 16] == data[i + k : i + k + 16]:
                k += 16
            while k < most and data[j + k] == data[i + k]:
                k += 1
            if k > best:
                best, distance = k, i - j
        j = before[j]
    return best, distance


def unpack_lzx(data: bytes) -> bytes:
    n, at, out = size_of(data, LZX), 4, bytearray()
    while len(out) < n:
        if at >= len(data):
            raise ValueError("too short")
        flags, at = data[at], at + 1
        for bit in range(7, -1, -1):
            if len(out) >= n:
                break
            if not flags >> bit & 1:
                if at >= len(data):
                    raise ValueError("too short")
                out.append(data[at])
                at += 1
                continue
            high = data[at] >> 4 if at < len(data) else 0
            size, base, mask = {0: (3, 0x11, 0xFF), 1: (4, 0x111, 0xFFFF)}.get(high, (2, 1, 0xF))
            if at + size > len(data):
                raise ValueError("too short")
            token, at = int.from_bytes(data[at : at + size], "big"), at + size
            _copy(out, (token & 0xFFF) + 1, (token >> 12 & mask) + base)
    if len(out) != n:
        raise ValueError("too long")
    return bytes(out)


# ---- prefix codes

def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Bits of each symbol: the two rarest trees are joined until one is left; of equal ones the later symbol first."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, -s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    length = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
    return length


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, bits) of each symbol: codes count up by length, then symbol."""
    code = before = 0
    out = {}
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - before
        out[s] = (code, n)
        code, before = code + 1, n
    return out


def _tree(counts: dict[int, int]):
    """A binary tree of the symbols by weight: a symbol, or a pair of trees; the two lightest are joined, the later symbol first at ties."""
    heap = [(n, -s, s) for s, n in counts.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), (a[2], b[2])))
    return heap[0][2]


#: How many pairs ahead of its own a node's children may lie: 6 bits of a node's byte.
AHEAD = 64


def _laid_out(tree: tuple) -> list[tuple]:
    """Pairs of children in an order in which every pair lies at most AHEAD after that of its node, the root first.

    Of the pairs that wait, the one of the fewest nodes goes next, as it makes the fewest new ones;
    unless some would come too late: then the one that has waited longest.
    """
    size: dict[int, int] = {}

    def count(node) -> int:
        size[id(node)] = 1 + sum(count(x) for x in node if isinstance(x, tuple))
        return size[id(node)]

    count(tree)
    out, waiting = [], [(0, tree)]  # (place by which it must lie, node)
    while waiting:
        waiting.sort(key=lambda x: x[0])
        at = len(out)
        urgent = any(place - at <= k for k, (place, _) in enumerate(waiting))
        k = 0 if urgent else min(range(len(waiting)), key=lambda i: size[id(waiting[i][1])])
        _, node = waiting.pop(k)
        out.append(node)
        waiting += [(at + AHEAD, x) for x in node if isinstance(x, tuple)]
    return out


def pack_huffman(data: bytes, bits: int = 8) -> bytes:
    """Symbols of 8 or 4 bits (low half first): the header, a table of the tree's nodes, and the bits.

    The table begins with half its length less one; a node's byte tells how far ahead its children's
    pair lies, and by its two highest bits whether the left or the right one is a symbol. Bits fill
    words of 32 from the highest, which are stored from the lowest byte.
    """
    symbols = data if bits == 8 else bytes(x for b in data for x in (b & 15, b >> 4))
    counts = Counter(symbols)
    for s in (0, 1):  # a tree has two leaves at least
        if len(counts) < 2:
            counts.setdefault(s, 0)
    tree = _tree(counts)
    pairs = _laid_out(tree)
    place = {id(node): k for k, node in enumerate(pairs)}
    nodes, codes = bytearray((0, 0)), {}

    def byte(node: tuple, parent: int) -> int:
        return place[id(node)] - parent - 1 | sum(0x80 >> side for side, x in enumerate(node) if not isinstance(x, tuple))

    todo = [(tree, "")]
    while todo:
        node, code = todo.pop()
        for side, x in enumerate(node):
            if isinstance(x, tuple):
                todo.append((x, f"{code}{side}"))
            else:
                codes[x] = f"{code}{side}"
    nodes[1] = byte(tree, -1)
    for k, pair in enumerate(pairs):
        nodes += bytes(byte(x, k) if isinstance(x, tuple) else x for x in pair)
    nodes += bytes(-len(nodes) % 4)
    nodes[0] = len(nodes) // 2 - 1
    text = "".join(map(codes.__getitem__, symbols))
    text += "0" * (-len(text) % 32)
    packed = np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).view(">u4").astype("<u4").tobytes() if text else b""
    return header(0x20 | bits, len(data)) + bytes(nodes) + packed


def unpack_huffman(data: bytes) -> bytes:
    bits = data[0] & 15 if data else 0
    if bits not in (4, 8):
        raise ValueError("another kind")
    n = size_of(data, 0x20 | bits)
    if len(data) < 6:
        raise ValueError("too short")
    table = data[4 : 4 + (data[4] + 1) * 2]
    stream = data[4 + len(table) :]
    if len(table) < (data[4] + 1) * 2:
        raise ValueError("too short")
    flags = np.unpackbits(np.frombuffer(stream[: len(stream) // 4 * 4], "<u4").astype(">u4").view(np.uint8)).tolist()
    need, out, at = n * (8 // bits), bytearray(), 1
    for bit in flags:
        if len(out) == need:
            break
        node = table[at]
        at = at - at % 2 + ((node & 0x3F) + 1) * 2 + bit
        if at >= len(table):
            raise ValueError("beyond the table")
        if node & 0x80 >> bit:
            out.append(table[at])
            at = 1
    if len(out) != need:
        raise ValueError("too short")
    return bytes(out) if bits == 8 else bytes(out[i] & 15 | (out[i + 1] & 15) << 4 for i in range(0, len(out), 2))


# ---- containers

SEGMENT = 4096
# The segmented form's mark (in either byte order), and kinds of the form that chooses.
SEGMENTED = (b"PMOC", b"COMP")
STORED, CHOSE_LZ, CHOSE_RUNS = 0, 1, 3


def pack_segments(data: bytes) -> bytes:
    """Segments of 4 KiB, each by ``pack_lzx`` or, with its length negative, as it is if that is no longer."""
    parts = []
    for at in range(0, len(data), SEGMENT):
        plain = data[at : at + SEGMENT]
        packed = pack_lzx(plain)
        parts.append((len(packed), packed) if len(packed) < len(plain) else (-len(plain), plain))
    head = [len(data), len(parts), max((abs(n) for n, _ in parts), default=0), *(n & 0xFFFFFFFF for n, _ in parts)]
    return SEGMENTED[0] + b"".join(n.to_bytes(4, "little") for n in head) + b"".join(p for _, p in parts)


def unpack_segments(data: bytes) -> bytes:
    if data[:4] not in SEGMENTED or len(data) < 20:
        raise ValueError("another kind")
    total, count = (int.from_bytes(data[k : k + 4], "little") for k in (4, 8))
    at, out = 16 + 4 * count, bytearray()
    if not count or at > len(data):
        raise ValueError("too short")
    for k in range(count):
        n = int.from_bytes(data[16 + 4 * k : 20 + 4 * k], "little", signed=True)
        piece = data[at : at + abs(n)]
        if len(piece) < abs(n):
            raise ValueError("too short")
        out += unpack_lzx(piece) if n >= 0 else piece
        at += abs(n)
    if len(out) != total:
        raise ValueError("another size")
    return bytes(out)


def pack_choice(data: bytes) -> bytes:
    """The smallest of the data as it is, its dictionary form and its runs, after the size and which it was."""
    forms = [(STORED, data), (CHOSE_LZ, pack_lz(data)[4:]), (CHOSE_RUNS, pack_runs(data)[4:])]
    kind, body = min(forms, key=lambda f: len(f[1]))
    return (len(data) << 2 | kind).to_bytes(4, "little") + body


def unpack_choice(data: bytes) -> bytes:
    if len(data) < 4:
        raise ValueError("too short")
    head = int.from_bytes(data[:4], "little")
    n, kind, body = head >> 2, head & 3, data[4:]
    if kind == STORED:
        if not n <= len(body) <= (n + 3) // 4 * 4:
            raise ValueError("another size")
        return body[:n]
    if kind == CHOSE_LZ and n < 1 << 24:
        return unpack_lz(header(LZ, n) + body)
    if kind == CHOSE_RUNS and n < 1 << 24:
        return unpack_runs(header(RUNS, n) + body)
    raise ValueError("another kind")


# ---- all of them

PACK = {"lz": pack_lz, "lz_magic": lambda d: MAGIC + pack_lz(d), "lzx": pack_lzx, "runs": pack_runs, "huffman4": lambda d: pack_huffman(d, 4), "huffman8": pack_huffman, "diff8": diff8, "diff16": diff16, "segments": pack_segments, "choice": pack_choice, "none": lambda d: d}


def _magic(data: bytes) -> bytes:
    if data[:4] != MAGIC:
        raise ValueError("another kind")
    return unpack_lz(data[4:])


def _huffman(bits: int):
    def one(data: bytes) -> bytes:
        if not data or data[0] != 0x20 | bits:
            raise ValueError("another kind")
        return unpack_huffman(data)

    return one


#: In the order in which kinds are tried; the first that decodes wins.
UNPACK = {"lz_magic": _magic, "lz": unpack_lz, "lzx": unpack_lzx, "segments": unpack_segments, "runs": unpack_runs, "huffman4": _huffman(4), "huffman8": _huffman(8), "diff8": undiff8, "diff16": undiff16, "choice": unpack_choice, "none": lambda d: d}


def detect(data: bytes) -> str:
    """The first kind as which a payload decodes."""
    for kind, fn in UNPACK.items():
        try:
            fn(data)
        except ValueError:
            continue
        return kind
    return "none"


def smallest(data: bytes, kinds: tuple[str, ...] = ("lz", "runs", "huffman4", "huffman8", "none")) -> tuple[str, bytes]:
    """The kind that makes a payload smallest, the first at ties."""
    return min(((k, PACK[k](data)) for k in kinds), key=lambda x: len(x[1]))


def _crc_table() -> list[int]:
    out = np.arange(256, dtype=np.int64)
    for _ in range(8):
        out = out >> 1 ^ np.where(out & 1, 0xA001, 0)
    return out.tolist()


_CRC = _crc_table()


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    """Reflected CRC of polynomial 0xA001, a byte a step."""
    crc, table = start, _CRC
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    return crc


def longest_run(data: bytes) -> int | None:
    """Length of the longest run of one byte but 0; none if there is no such byte."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True]))) if len(a) else np.zeros(1, np.int64)
    size = np.diff(edges)[a[edges[:-1]] != 0] if len(a) else edges[:0]
    return int(size.max()) if len(size) else None


def coded(rows: DataFrame, column: str, fn, out: str = "binary", name: str = "coded", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, coded): ``fn`` over a binary column, by Arrow batches; a payload that fails gives null."""
    arrow = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[out]

    def safe(x):
        try:
            return None if x is None else fn(x)
        except ValueError:
            return None

    def one(batches):
        for b in batches:
            values = [safe(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(values, arrow)], [*b.schema.names[1:], name])

    src = rows.select(column, *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[1:]), f"{name} {out}"])
    return src.mapInArrow(one, schema)


def byte_counts(rows: DataFrame, column: str) -> DataFrame:
    """(b, n): occurrences of each byte in a binary column: counted by batch, then added up."""

    def one(batches):
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(x for x in b.column(0).to_pylist() if x), np.uint8), minlength=256)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["b", "n"])

    return rows.select(column).mapInArrow(one, "b long, n long").groupBy("b").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")


def weighed(data: bytes, period: int = 251) -> int:
    """Sum of bytes, each times its place within a period counted from 1: a digest that SQL can repeat."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    return int((a * (np.arange(len(a)) % period + 1)).sum())
