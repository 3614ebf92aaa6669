"""Scans and sinks of packed binary objects: whole files, the register of formats, guesses by content, message and raw files.

Files come through Spark's ``binaryFile`` source, so any store that Spark reads will do.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import UNPACK, detect
from ..functions.text import ENCODINGS, units

# ---- identification

# Weights of what an identification checks, by flag bit.
WEIGHTS = {"header": (1, 100), "footer": (2, 50), "signature": (4, 400), "chunked": (8, 100), "checksum": (16, 200), "compression": (32, 50), "validated": (64, 0), "size": (128, 25), "offsets": (256, 0), "host": (512, 475), "over_host": (1024, 475)}

# Registered formats, as kind, name and what their checks look at.
_G = ("header", "signature", "chunked", "validated")
_GO = ("header", "signature", "chunked", "offsets", "validated")
_HS, _HSV, _HSVO = ("header", "signature"), ("header", "signature", "validated"), ("header", "signature", "validated", "offsets")
_FOOT = ("footer", "signature", "chunked", "validated")
FORMATS = (
    ("palette", "NCLR", _GO), ("palette", "NCL", _G), ("palette", "5PL", _G), ("palette", "5PC", _G), ("palette", "Tose", _HS),
    ("palette", "Bomberman", _HSV), ("palette", "Hudson", ("header",)), ("palette", "Setosa", ("header", "signature", "chunked")), ("palette", "Binary", ()), ("palette", "NTFP", ()),
    ("character", "NCGR", _GO), ("character", "NCG", _G), ("character", "ICG", _FOOT), ("character", "ACG", _FOOT), ("character", "Tose", _HSV),
    ("character", "Bomberman", ("header", "signature", "compression")), ("character", "Hudson", ("header",)), ("character", "Hudson 2", ("header",)), ("character", "Ghost Trick", ("compression",)), ("character", "Setosa", _G), ("character", "Binary", ()),
    ("screen", "NSCR", _G), ("screen", "NSC", _G), ("screen", "ISC", _FOOT), ("screen", "ASC", _FOOT), ("screen", "Tose", _HS),
    ("screen", "Bomberman", _HSV), ("screen", "Hudson", ("header",)), ("screen", "Hudson 2", ("header",)), ("screen", "Binary", ("size",)),
    ("cell", "NCER", _GO), ("cell", "Setosa", _GO), ("cell", "Hudson", ("header", "offsets")), ("cell", "Bomberman", _HSV), ("cell", "Ghost Trick", ("header", "offsets")),
    ("animation", "NANR", _GO), ("animation", "Ghost Trick", ("offsets", "validated")), ("multicell", "NMCR", _GO),
    ("font", "NFTR 0.1", _GO), ("font", "NFTR 1.0", _GO), ("font", "NFTR 1.1", _GO), ("font", "NFTR 1.2", _GO), ("font", "BNFR 2.0", _GO),
    ("font", "BNFR 1.2", _HSVO), ("font", "BNFR 1.1", _HSVO), ("font", "GameFreak 1.1", _GO), ("font", "Starfy", ("header", "validated", "offsets")), ("codemap", "BNCMP 1.1", _HSVO), ("codemap", "BNCMP 1.2", _HSVO),
    ("message", "BMG", _GO), ("layout", "BNLL", _HSV), ("layout", "BNCL", _HSV), ("layout", "BNBL", _HSV),
    ("texture", "NNS TGA", ("header", "validated", "chunked", "offsets", "over_host")), ("texture", "NNS PIC", ("header", "validated", "chunked", "offsets", "over_host")), ("texture", "5TX", _G), ("texture", "SPT", _HSV),
    ("texture", "TDS", _HSVO), ("texture", "NTGA", _HSVO), ("texture", "To Love Ru", _HSVO), ("texture", "GRF", _G),
    ("archive", "NSBTX", _GO), ("archive", "BMD", ("header", "validated", "offsets")), ("archive", "STTEX", _HS),
    ("combination", "5BG", _G), ("combination", "5BG OBJ", _G), ("combination", "BNCD", _HSVO), ("combination", "Banner", ("header", "validated", "checksum")), ("combination", "AOB", _G),
    ("combination", "GRF", _G), ("combination", "MBB", ("header", "validated", "offsets")), ("combination", "Time Ace", ("header", "validated", "offsets")), ("combination", "Data File", ()), ("scene", "SCN", _HSV),
)


def confidence(flags: Column) -> Column:
    """Sum of the weights of the flags set; the two of host codecs count once."""
    plain = [F.when(flags.bitwiseAND(bit) != 0, w).otherwise(0) for name, (bit, w) in WEIGHTS.items() if name not in ("host", "over_host")]
    host = F.when(flags.bitwiseAND(512 | 1024) != 0, 475).otherwise(0)
    return sum(plain, host).cast("bigint")


def registry(spark: SparkSession) -> DataFrame:
    """(id, type, name, flags): the formats, about seventy rows whatever the input."""
    rows = [(k, kind, name, sum(WEIGHTS[x][0] for x in checks)) for k, (kind, name, checks) in enumerate(FORMATS)]
    return spark.createDataFrame(rows, "id long, type string, name string, flags long")


def identify(files: DataFrame, formats: DataFrame, predicate: Column) -> DataFrame:
    """(path, type, name, confidence, place): formats whose predicate holds, the most confident first."""
    from pyspark.sql import Window

    # The registry has a fixed number of rows: it is carried to the files, which stay where they are.
    found = files.join(F.broadcast(formats), predicate).withColumn("confidence", confidence(F.col("flags")))
    order = Window.partitionBy("path").orderBy(F.desc("confidence"), "id")
    return found.withColumn("place", F.row_number().over(order).cast("bigint"))


def guess_kind(data: bytes) -> str:
    """palette, character or screen by content, or invalid if the size fits none.

    A kind whose size fits has one vote; a palette's colours have no bit 15. Where several kinds
    have one, a screen wins and loses votes by how many references are turned, how many follow a
    lower one, and how much of their range they use, and characters by the longest run of a byte. Ties
    go to the palette, then the screen.
    """
    import numpy as np

    n = len(data)
    numbers = np.frombuffer(data[: n // 2 * 2], "<u2").astype(np.int64)
    votes = {"palette": int(n % 2 == 0 and n <= 32768 and not (numbers & 0x8000).any()), "screen": int(n in _SCREEN_SIZES), "character": int(n > 0 and n % 32 == 0)}
    standing = lambda: [k for k, v in votes.items() if v]
    if len(standing()) < 2:
        return (standing() or ["invalid"])[0]
    for rule in (_turned, _rising, _spread):
        if votes["screen"]:
            votes["screen"] = max(0, votes["screen"] + rule(numbers))
        if len(standing()) == 1:
            return standing()[0]
    if votes["character"]:
        longest = _longest_pixels(np.frombuffer(data, np.uint8))
        votes["character"] = max(0, votes["character"] - (longest < 16)) + (longest >= 24)
    top = max(votes.values())
    return next(k for k, v in votes.items() if v == top) if top else "character"


def _turned(numbers) -> int:
    """Few references of a screen are turned."""
    turned = int((numbers >> 10 & 3 > 0).sum())
    return int(4 * turned <= len(numbers)) - int(2 * turned > len(numbers))


def _rising(numbers) -> int:
    """Most references of a screen are no lower than the one before."""
    c = numbers & 0x3FF
    rising = 1 + int((c[1:] >= c[:-1]).sum())
    return int(4 * rising >= 3 * len(c)) - int(2 * rising < len(c))


def _spread(numbers) -> int:
    """A screen uses most characters between its lowest and its highest."""
    import numpy as np

    c = np.unique(numbers & 0x3FF)
    span = int(c[-1] - c[0] + 1)
    return int(4 * len(c) >= 3 * span) - int(4 * len(c) < span)


def _longest_pixels(a) -> int:
    """The longest run of one byte but 0."""
    import numpy as np

    edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    size = np.diff(edges)[a[edges[:-1]] != 0]
    return int(size.max()) if len(size) else 0


# Bytes of the screen sizes that the hardware has.
_SCREEN_SIZES = frozenset((512, 1536, 2048, 4096, 8192, 16384, 32768))


# ---- whole files

def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("bytes"))


def slices(files: DataFrame, specs: DataFrame) -> DataFrame:
    """(path, part, bytes): slices (path, part, offset, size) of other files."""
    return files.join(specs, "path").select("path", "part", F.expr("substring(bytes, CAST(offset + 1 AS INT), CAST(size AS INT))").alias("bytes"))


def unpacked(files: DataFrame) -> DataFrame:
    """(path, codec, bytes): payloads with their codec found and undone."""

    def one(batches):
        for b in batches:
            kinds = [None if x is None else detect(x) for x in b.column(1).to_pylist()]
            plain = [None if k is None else UNPACK[k](x) for k, x in zip(kinds, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), pa.array(plain, pa.binary())], ["path", "codec", "bytes"])

    return files.select("path", "bytes").mapInArrow(one, "path string, codec string, bytes binary")


# ---- message containers

#: Bytes of a message file's header, and the multiple to which it and every block are padded.
MESSAGE_HEADER, ALIGN = 32, 32


def _signed(data: bytes, signature: bytes) -> bool | None:
    """Whether a signature stands in ``data`` as it reads (False) or backwards (True); None if neither."""
    return False if data == signature else True if data == signature[::-1] else None


def message_blocks(data: bytes) -> tuple[str, dict[str, bytes], list[tuple[str, int, int]]]:
    """(byte order, blocks by name, (name, offset of the data, its size) in order) of a message container; ValueError if it isn't one."""
    if len(data) < MESSAGE_HEADER or (turned := _signed(data[:4], b"MESG")) is None or _signed(data[4:8], b"bmg1") is not turned:
        raise ValueError("another kind")
    for order in "<>":
        size, count = struct.unpack_from(f"{order}II", data, 8)
        own, at = [], MESSAGE_HEADER
        if not MESSAGE_HEADER <= size <= len(data):
            continue
        for _ in range(count):
            if at + 8 > size or not 8 <= (n := struct.unpack_from(f"{order}I", data, at + 4)[0]) <= size - at:
                break
            name = data[at : at + 4][:: -1 if turned else 1].decode("latin-1")
            own.append((name, at + 8, n - 8))
            at += n
        else:
            blocks: dict[str, bytes] = {}
            for name, start, n in own:
                blocks.setdefault(name, data[start : start + n])
            return order, blocks, own
    raise ValueError("no whole blocks")


def chunk_list(data: bytes) -> list[tuple[str, int, int]]:
    """(signature, offset of the data, size of the data) of a message container's blocks; ValueError if it isn't one."""
    return message_blocks(data)[2]


def chunks(files: DataFrame) -> DataFrame:
    """(path, k, signature, offset, size): a row for each chunk of every file that is a list of chunks."""

    def one(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, k, *c) for k, c in enumerate(chunk_list(data or b""))]
                except ValueError:
                    continue
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "k", "signature", "offset", "size"])

    return files.select("path", "bytes").mapInArrow(one, "path string, k long, signature string, offset long, size long")


# ---- formats

def _u16(binary: Column) -> Column:
    """Little-endian 16-bit numbers of a binary column."""
    quads = F.regexp_extract_all(F.hex(binary), F.lit("...."), F.lit(0))
    return F.transform(quads, lambda q: F.conv(F.concat(F.substring(q, 3, 2), F.substring(q, 1, 2)), 16, 10).cast("bigint"))


def read_palettes(files: DataFrame) -> DataFrame:
    """(path, idx, color) of raw palettes."""
    return files.select("path", F.posexplode(_u16(F.col("bytes"))).alias("idx", "color")).select("path", F.col("idx").cast("bigint").alias("idx"), "color")


def read_screens(files: DataFrame) -> DataFrame:
    """(path, cell, raw) of raw screens."""
    return files.select("path", F.posexplode(_u16(F.col("bytes"))).alias("cell", "raw")).select("path", F.col("cell").cast("bigint").alias("cell"), "raw")


def read_characters(files: DataFrame, bits: int = 4) -> DataFrame:
    """(path, tile_no, pos, idx) of raw character graphics of 4 or 8 bits a pixel, low half first."""
    pairs = F.regexp_extract_all(F.hex("bytes"), F.lit(".." if bits == 8 else "(.)(.)"), F.lit(0))
    if bits == 4:
        pairs = F.flatten(F.transform(pairs, lambda h: F.array(F.substring(h, 2, 1), F.substring(h, 1, 1))))
    px = files.select("path", F.posexplode(F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("bigint"))).alias("i", "idx"))
    return px.select("path", F.expr("CAST(i div 64 AS BIGINT)").alias("tile_no"), F.expr("CAST(i % 64 AS BIGINT)").alias("pos"), "idx")


def write_u16(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, bytes): numbers in order as little-endian bytes. A palette or screen is one row by its format's bound."""
    h = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: F.concat(F.lpad(F.hex(x[value] % 256), 2, "0"), F.lpad(F.hex(F.shiftright(x[value], 8) % 256), 2, "0")))
    return rows.groupBy(key).agg(F.unhex(F.array_join(h, "")).alias("bytes"))


def pool(strings: list[bytes], step: int = 1) -> tuple[bytes, list[int]]:
    """One run of bytes that holds all strings, and where each lies: longest first, those that it holds already shared."""
    out, at = b"", [0] * len(strings)
    for k in sorted(range(len(strings)), key=lambda k: (-len(strings[k]), k)):
        place = out.find(strings[k])
        while place >= 0 and place % step:
            place = out.find(strings[k], place + 1)
        if place < 0:
            place, out = len(out), out + strings[k]
        at[k] = place
    return out, at


def pack_messages(messages: list[tuple[int, bytes]], encoding: int = 4, order: str = "<", group: int = 0, extra: bytes = b"") -> bytes:
    """A message file of (id, text): an index of offsets into a pool of terminated strings, the pool, and the ids.

    ``extra`` follows every offset of the index. Sizes are padded to 32; signatures read forwards.
    """
    size = 2 if encoding == 2 else 1
    strings, at = pool([m + bytes(size) for _, m in messages], size)
    ordered = all(a[0] < b[0] for a, b in zip(messages, messages[1:], strict=False))
    entry = 4 + len(extra)
    step = -(-entry // 4) * 4
    index = struct.pack(f"{order}HHHBB", len(messages), entry, group, 0, 0) + b"".join((struct.pack(f"{order}I", a) + extra).ljust(step, b"\0") for a in at)
    ids = struct.pack(f"{order}HBBI", len(messages), 0x10 if ordered else 0, 0, 0) + b"".join(struct.pack(f"{order}I", k) for k, _ in messages)
    body = b""
    for name, data in ((b"INF1", index), (b"DAT1", strings), (b"MID1", ids)):
        data += bytes(-(len(data) + 8) % ALIGN)
        body += name + struct.pack(f"{order}I", len(data) + 8) + data
    return b"MESGbmg1" + struct.pack(f"{order}IIB", MESSAGE_HEADER + len(body), 3, encoding) + bytes(MESSAGE_HEADER - 17) + body


def message_list(data: bytes) -> list[tuple[int, bytes]]:
    """(id, text's bytes) of a message file in either byte order; without ids, the places."""
    order, own, _ = message_blocks(data)
    if not {"INF1", "DAT1"} <= own.keys() or data[16] > 4:
        raise ValueError("another kind")
    index, strings, size = own["INF1"], own["DAT1"], 2 if data[16] == 2 else 1
    n, step = struct.unpack_from(f"{order}HH", index)
    step = -(-step // 4) * 4
    at = [struct.unpack_from(f"{order}I", index, 8 + step * k)[0] for k in range(n)]
    ids = struct.unpack_from(f"{order}{n}I", own["MID1"], 8) if "MID1" in own else range(n)
    out = []
    for k, a in zip(ids, at, strict=True):
        if a >= len(strings):
            raise ValueError("beyond the pool")
        text = strings[a : a + units(strings[a:], size)]
        out.append((k, b"".join(text[i : i + 2][::-1] for i in range(0, len(text), 2)) if size == 2 and order == ">" else text))
    return out


def read_messages(files: DataFrame) -> DataFrame:
    """(path, pos, id, text) of message files; others give no rows."""

    def one(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    name = ENCODINGS.get((data or b"").ljust(17, b"\0")[16], "utf-8")
                    rows += [(path, pos, k, m.decode(name, "replace")) for pos, (k, m) in enumerate(message_list(data or b""))]
                except (ValueError, struct.error):
                    continue
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "pos", "id", "text"])

    return files.select("path", "bytes").mapInArrow(one, "path string, pos long, id long, text string")


def write_messages(messages: DataFrame) -> DataFrame:
    """(file_id, bytes): a message file for each file_id's (pos, text); a file is one group, as its pool is one string."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"file_id": pdf["file_id"].iloc[:1], "bytes": [pack_messages([(int(p), (t or "").encode()) for p, t in zip(pdf["pos"], pdf["text"], strict=True)])]})

    return messages.select("file_id", "pos", "text").groupBy("file_id").applyInPandas(one, "file_id long, bytes binary")
