"""Removal of byte strings that occur more than once, by suffix arrays over anchored stretches.

A suffix array of all texts at once has no place to be. Equal strings of LENGTH bytes, though, have
equal minimisers: the least of the hashes of the GRAM-byte strings in them, the leftmost if several
are least. So every text is cut into stretches of neighbouring places whose strings share a
minimiser occurrence, and stretches are dealt out by the minimiser's hash: all occurrences of a
string meet in one task, which sorts the suffixes of its stretches and takes adjacent prefixes.

Before that, texts are reduced to one of each, and stretches that occur once are left where they
are; equal stretches are known to repeat by 128 bits of hashes and one of them stands for all. A
minimiser of more than FREQUENT stretches is frequent, at every size of the input: its strings are
dealt out one by one, by 128 bits of their own hash, so that no key gathers a share of the rows. Which
minimisers are frequent, all tasks know from a filter of FILTER_BITS bits; one that the filter takes
for frequent by mistake goes the same way, with the same result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, shared_dir, table
from .suffixes import repeated_starts, words8

LENGTH = 200
#: Bytes that a minimiser hashes, and minimiser candidates in a string of LENGTH bytes.
GRAM = 32
WINDOW = LENGTH - GRAM + 1
#: Bytes whose places are handled at once; longer texts are cut in overlapping parts.
PART = 4 << 20
#: Bytes of whole groups whose suffixes are sorted at once, about.
BLOCK = 1 << 20
#: A minimiser with more stretches than this is frequent.
FREQUENT = 2048
#: Bits of the filter of frequent minimisers: 2 MB.
FILTER_BITS = 1 << 24
#: Strings of frequent minimisers that a task remembers before it hands them on.
REMEMBER = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Odd factors of a gram's words after the first; a minimiser's hash only says where its strings meet.
_GRAM = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stretches(text: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, places, minimiser's hash) of the stretches of ``text``.

    ``usable`` says at which places a string starts that counts. Fewer than LENGTH bytes have none.
    """
    n = len(text) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    words = words8(text)
    m = len(text) - GRAM + 1
    h = words[:m] * _M1
    for at, k in zip(range(8, GRAM, 8), _GRAM, strict=True):
        h += words[at : at + m] * k
    h = _mix(h)
    least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(m, dtype=np.uint64)  # of equal hashes the leftmost
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[WINDOW - width : WINDOW - width + n])
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (usable[1:n] != usable[: n - 1])))
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    own = usable[start]
    start, count = start[own], count[own]
    return start, count, h[(least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)]


def parts(texts: list[bytes]):
    """Texts joined up to PART bytes, long ones cut: (bytes, usable places, owner of each stretch's place, offsets)."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - LENGTH + 1), PART):
            piece = t[at : at + PART + LENGTH - 1]
            if size + len(piece) > 2 * PART and held:
                yield held
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield held


def stretches_of(texts: list[bytes]):
    """Batches of (owner, first place, places, minimiser's hash, the joined bytes, offset into them)."""
    for held in parts(texts):
        joined = b"".join(p for _, _, p in held)
        sizes = np.array([len(p) for _, _, p in held])
        offset = np.cumsum(sizes) - sizes
        usable = np.ones(len(joined), bool)
        for o, s in zip(offset.tolist(), sizes.tolist(), strict=True):
            usable[o + s - LENGTH + 1 : o + s] = False
        start, count, mini = stretches(np.frombuffer(joined, np.uint8), usable)
        piece = np.searchsorted(offset, start, side="right") - 1
        owner = np.array([i for i, _, _ in held])[piece]
        place = start - offset[piece] + np.array([at for _, at, _ in held])[piece]
        yield owner, place, count, mini, joined, start


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _minis(batches):
    """(mini, n): stretches of each minimiser, added up within a batch."""
    for b in batches:
        found = [m for _, _, _, m, _, _ in stretches_of(b.column(0).to_pylist())]
        if found:
            mini, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(mini), pa.array(n, pa.int64())], ["mini", "n"])


def _bits(minis: np.ndarray) -> np.ndarray:
    """Places in the filter that each minimiser sets, a row each."""
    return np.stack([_mix(minis ^ k) % np.uint64(FILTER_BITS) for k in (*_GRAM, _M1)], axis=1)


def _filter_words(batches):
    """(word, bits) of the filter that a batch of frequent minimisers sets."""
    for b in batches:
        at = np.unique(_bits(b.column(0).to_numpy().view(np.uint64)))
        word, owner = np.unique(at >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits, owner, np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), _signed(bits)], ["word", "bits"])


def frequent_minis(texts: DataFrame) -> np.ndarray:
    """The filter of the frequent minimisers, as FILTER_BITS bits in words of 64: all that reaches the driver."""
    counts = map_arrow(texts.select("text"), _minis, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    words = map_arrow(counts.select("mini"), _filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for word, bits in words.collect():
        out[word] = np.int64(bits).view(np.uint64)
    return out


def is_frequent(minis: np.ndarray, held: np.ndarray) -> np.ndarray:
    at = _bits(minis)
    return ((held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1) if len(minis) else np.zeros(0, bool)


def _rows(frequent):
    """Stretches as (key, content, u1, u2, packed) and, of frequent minimisers, single strings reduced within the partition.

    ``packed`` is the first place times 256 plus the number of places. Rows of kind 1 are marks
    already: strings of which the partition has seen another. What it has seen is handed on whenever
    it is REMEMBER strings: a string may then stand for the partition twice, and is met again by its key.
    """

    def handed_on(seen: dict[int, list]):
        items = list(seen.items())
        seen.clear()
        for at in range(0, len(items), 65536):
            some = items[at : at + 65536]
            high, low = (np.array([k >> shift & 0xFFFFFFFFFFFFFFFF for k, _ in some], np.uint64).view(np.int64) for shift in (64, 0))
            # Kind 2: one string that stands for the partition's; kind 3: its place is marked already.
            yield _batch(np.array([3 if v[1] else 2 for _, v in some]), high, low, *(np.array(c, np.int64) for c in zip(*(v[0] for _, v in some), strict=True)))

    def one(batches):
        seen: dict[int, list] = {}  # string's hash -> [its first row, whether that is marked]
        for b in batches:
            texts = b.column(0).to_pylist()
            ids = [c.to_numpy() for c in b.columns[1:3]]
            for owner, place, count, mini, joined, start in stretches_of(texts):
                hot = is_frequent(mini, frequent.value)
                marks = []
                for k in np.flatnonzero(hot).tolist():
                    s, o, p = int(start[k]), int(owner[k]), int(place[k])
                    for j in range(int(count[k])):
                        x = xxhash.xxh3_128_intdigest(joined[s + j : s + j + LENGTH])
                        row = (int(ids[0][o]), int(ids[1][o]), (p + j) * 256 + 1)
                        if (first := seen.get(x)) is None:
                            seen[x] = [row, False]
                        else:
                            if not first[1]:
                                first[1] = True
                                marks.append(first[0])
                            marks.append(row)
                if marks:
                    yield _batch(1, *(np.array(c, np.int64) for c in zip(*((r[0], 0, *r) for r in _runs(marks)), strict=True)))
                if len(seen) > REMEMBER:
                    yield from handed_on(seen)
                cold = np.flatnonzero(~hot)
                if len(cold):
                    o, s, e = owner[cold], start[cold].tolist(), (start[cold] + count[cold] + LENGTH - 1).tolist()
                    content = np.fromiter((xxhash.xxh3_64_intdigest(joined[x:y]) for x, y in zip(s, e, strict=True)), np.uint64, len(s))
                    yield _batch(0, mini[cold].view(np.int64), content.view(np.int64), ids[0][o], ids[1][o], place[cold] * 256 + count[cold])
        yield from handed_on(seen)

    return one


def _runs(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Rows of single places of one text after another, those of neighbouring places made one."""
    out: list[tuple[int, int, int]] = []
    for u1, u2, packed in sorted(set(rows)):
        if out and out[-1][:2] == (u1, u2) and (last := out[-1][2]) % 256 < 255 and (last >> 8) + last % 256 == packed >> 8:
            out[-1] = (u1, u2, last + 1)
        else:
            out.append((u1, u2, packed))
    return out


_ROW = ["kind", "key", "content", "u1", "u2", "packed"]
_ROW_SCHEMA = "kind int, key long, content long, u1 long, u2 long, packed long"


def _batch(kind, key, content, u1, u2, packed) -> pa.RecordBatch:
    kind = np.full(len(key), kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.asarray(c, np.int64)) for c in (key, content, u1, u2, packed))], _ROW)


def _meet(batches):
    """Over rows sorted by (key, content): what repeats, as marks (kind 1), and what has to be compared (kinds 4 and 5).

    A group is a key's rows. Rows whose content another row of the group has are repeats. If a
    group has several contents, one row of each goes on: kind 5 if it is marked, else 4. Groups of
    one row end here, and frequent strings (kinds 2 and 3) too: key and content are the whole string.
    """
    held = None

    def finish(rows: np.ndarray):
        kind, key, content = rows[0], rows[1], rows[2]
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_content = new_key | np.concatenate(([True], content[1:] != content[:-1]))
        group, run = np.cumsum(new_key) - 1, np.cumsum(new_content) - 1
        again = np.bincount(run)[run] > 1
        several = (np.bincount(group, new_content) > 1)[group]
        string = kind >= 2
        mark = again & (kind != 3)
        out = []
        if mark.any():
            out.append(_batch(1, *rows[1:, mark]))
        go = new_content & several & ~string
        if go.any():
            out.append(_batch(np.where(again[go], 5, 4), *rows[1:, go]))
        return out

    for b in batches:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
        if (ready := rows[0] == 1).any():  # marks of the map side come along, to be written with the others
            yield _batch(1, *rows[1:, ready])
            rows = rows[:, ~ready]
        if held is not None:
            rows = np.concatenate((held, rows), axis=1)
        if not rows.shape[1]:
            continue
        last = np.flatnonzero(rows[1] != rows[1, -1])
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole:
            yield from finish(rows[:, :whole])
        held = rows[:, whole:]
    if held is not None and held.shape[1]:
        yield from finish(held)


def _contents(batches):
    """The bytes of the stretches to compare, from their texts."""
    for b in batches:
        for text, u1, u2, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = [w["packed"] for w in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["key"] for w in wanted], pa.int64()), pa.array([w["kind"] for w in wanted], pa.int32()), pa.array([u1] * len(n), pa.int64()), pa.array([u2] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array([text[p >> 8 : (p >> 8) + p % 256 + LENGTH - 1] for p in n], pa.binary())],
                ["key", "kind", "u1", "u2", "packed", "bytes"],
            )


def _compare(batches):
    """Marks of the stretches of whole groups, by suffix arrays of about BLOCK bytes."""

    def finish(rows):
        out = []
        for (_, kind, u1, u2, packed, _), found in zip(rows, repeated_starts([r[5] for r in rows], LENGTH), strict=True):
            if kind == 4 and found.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], found, [False])).astype(np.int8)))
                out += [(u1, u2, ((packed >> 8) + a) * 256 + z - a) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        if out:
            yield _batch(1, [0] * len(out), [0] * len(out), *zip(*out, strict=True))

    held, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield from finish(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield from finish(held)


def kept(text: bytes, packed: list[int], whole: bool) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal runs removed."""
    spans = [(0, len(text))] if whole and len(text) >= LENGTH else sorted((p >> 8, (p >> 8) + p % 256 + LENGTH - 1) for p in packed)
    runs: list[tuple[int, int]] = []
    for a, b in spans:
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), runs


def _digests(batches):
    for b in batches:
        rows = []
        for text, u1, u2, copies, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            left, runs = kept(text, packed or [], copies > 1)
            rows.append((u1, u2, len(text), sum(z - a for a, z in runs), [{"start": a, "stop": z} for a, z in runs], hashlib.sha256(left).hexdigest()))
        types = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["u1", "u2", "n_bytes", "n_removed", "runs", "kept_sha256"])


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, u1, u2, text): text as bytes (null: empty) with two halves of its SHA-256's first 16 bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    hex_ = F.sha2(text, 256)
    half = lambda at: F.conv(F.substring(hex_, at, 16), 16, -10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), half(1).alias("u1"), half(17).alias("u2"), text.alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, runs, kept_sha256) of every row of ``docs(doc_id, text)``.

    ``runs`` are the maximal byte ranges, end exclusive, covered by strings of LENGTH bytes that
    also start elsewhere, in the same text or another. Null texts are empty; texts of fewer than
    LENGTH bytes lose nothing; a repeated row makes its text occur twice. Overlaps count. Null
    doc_ids each come back; no rows give no rows. Copies of one text meet the others' rows in the
    last join alone, by a few numbers a row; adaptive execution splits them there.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    named = _named(docs)
    name = f"mosaiq_texts_{uuid.uuid4().hex}"
    parts_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = named.groupBy("u1", "u2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # Bucketed, so that the two later joins by text move the small side only.
    distinct.write.format("parquet").option("compression", "zstd").bucketBy(parts_, "u1", "u2").saveAsTable(name)
    try:
        texts = spark.table(name)
        frequent = frequent_minis(texts)
        rows = map_arrow(texts.select("text", "u1", "u2"), _rows(spark.sparkContext.broadcast(frequent)), _ROW_SCHEMA)
        met = cut(map_arrow(rows.repartition(parts_, "key").sortWithinPartitions("key", "content"), _meet, _ROW_SCHEMA))
        wanted = met.where("kind > 1").groupBy("u1", "u2").agg(F.collect_list(F.struct("key", "kind", "packed")).alias("wanted"))
        stretch = map_arrow(texts.join(wanted.hint("shuffle_hash"), ["u1", "u2"]).select("text", "u1", "u2", "wanted"), _contents, "key long, kind int, u1 long, u2 long, packed long, bytes binary")
        compared = map_arrow(stretch.repartition(parts_, "key").sortWithinPartitions("key"), _compare, _ROW_SCHEMA)
        marks = met.where("kind = 1").unionByName(compared).groupBy("u1", "u2").agg(F.collect_list("packed").alias("packed"))
        found = texts.join(marks.hint("shuffle_hash"), ["u1", "u2"], "left").select("text", "u1", "u2", "copies", "packed")
        schema = "u1 long, u2 long, n_bytes long, n_removed long, runs array<struct<start:long,stop:long>>, kept_sha256 string"
        of = cut(map_arrow(found, _digests, schema))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return named.drop("text").join(of, ["u1", "u2"]).drop("u1", "u2")


def op10_exact_substrings(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``documents``, by ``repeats``."""
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), "kept_sha256")
