"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A model file is read without any library: pieces, scores and kinds. Texts are cut where no piece
can reach across (before each run of the space mark), and every distinct unit of a batch is
segmented once. Units of equal length advance together, one character a step: hashes of all
substrings that end there probe the sorted hashes of the pieces, and a running maximum over the
piece lengths stores the backpointers. Characters that no piece covers become their UTF-8 bytes.

The segmentation is the one of greatest score, as a unigram model's. The scores of a BPE file are
negated merge ranks, not log-probabilities, and adding ranks would split common words; they are
read as the log-probabilities of a flattened Zipf law over those ranks. Such ids are a valid
segmentation into the file's pieces and decode to the text, but aren't always those that merging
would choose. Of equal scores the longest last piece wins.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: What an unknown character costs below the least score, as in the public implementation.
UNKNOWN_PENALTY = 10.0
#: Model type of a BPE file, and the offset of the Zipf law by which its ranks are read.
BPE, ZIPF_OFFSET = 2, 1000.0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SIFT = np.uint64(42)
#: Distinct units that a worker remembers.
REMEMBER = 200_000


def _fields(data: bytes):
    """(number, value) of the fields of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``size`` numbers for each, one after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass
class Pieces:
    """The pieces of a model, by id."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]

    @classmethod
    def read(cls, path: str) -> Pieces:
        """Of a ``.model`` file on the driver; workers get the pieces by broadcast."""
        pieces, scores, kinds, bpe = [], [], [], False
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                bpe = dict(_fields(value)).get(3) == BPE
        return cls(pieces, [-math.log(ZIPF_OFFSET - s) for s in scores] if bpe else scores, kinds)


class Viterbi:
    """Encoder and decoder over ``Pieces``."""

    def __init__(self, model: Pieces):
        usable = [i for i, k in enumerate(model.kinds) if k == NORMAL and model.pieces[i]]
        self.byte_ids = np.full(256, -1, np.int32)
        for i, k in enumerate(model.kinds):
            if k == BYTE:
                self.byte_ids[int(model.pieces[i][3:5], 16)] = i
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        hashes = np.array([self._hash(model.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(usable, np.int32)[order]
        self.maybe = np.zeros(1 << 22, bool)  # by a hash's first bits: whether any piece has them
        self.maybe[self.keys >> SIFT] = True
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.scores = np.array([model.scores[i] for i in self.ids], np.float64)
        self.codes = {int(i): np.frombuffer(model.pieces[i].encode("utf-32-le"), np.uint32) for i in usable}
        self.longest = max((len(model.pieces[i]) for i in usable), default=1)
        self.lengths = np.array([len(model.pieces[i]) for i in self.ids], np.int32)
        self.alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *self.codes.values()]))
        self.table = np.zeros((len(usable), self.longest), np.uint32)
        for row, i in enumerate(self.ids.tolist()):
            self.table[row, : self.lengths[row]] = self.codes[i]
        self.least = min((model.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        surface = [b""] * len(model.pieces)
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            surface[i] = bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, 4) else " ⁇ ".encode() if k == UNKNOWN else b""

        self.surface_bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units one after another, and how many each has."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        flat, counts = [], []
        edges = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, edges):
            n = int(sizes[same[0]]) if len(same) else 0
            step = max(1, min(16384, 1_000_000 // max(1, n)))
            for at in range(0, len(same), step):
                ids, own = self._equal([units[i] for i in same[at : at + step]], n)
                flat.append(ids)
                counts.append(own)
        if not flat:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        count = np.empty(len(units), np.int64)
        count[order] = np.concatenate(counts)
        start = np.empty(len(units), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(flat)[spread(start, count)], count

    def _probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are a piece's, and its place in the sorted keys."""
        some = np.flatnonzero(self.maybe[hashes >> SIFT])
        place = np.searchsorted(self.keys, hashes[some])
        place[place == len(self.keys)] = 0
        same = self.keys[place] == hashes[some] if len(some) else np.zeros(0, bool)
        return some[same], place[same]

    def _equal(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``n`` characters each, one after another, and how many each has."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        rows = len(words)
        best = np.zeros((n + 1, rows))
        length, piece = np.zeros((n + 1, rows), np.int32), np.zeros((n + 1, rows), np.int32)
        plain = codes.T.astype(np.uint64) + np.uint64(1)
        live: list[np.ndarray] = []  # hashes of the substrings from each of the last starts
        for j in range(1, n + 1):
            live = [h * MULTIPLIER + plain[j - 1] for h in live[-(self.longest - 1) :]] if self.longest > 1 else []
            live.append(plain[j - 1].copy())
            first = j - len(live)
            top, size, which = np.full(rows, -np.inf), np.ones(rows, np.int32), np.full(rows, -1, np.int32)
            for k, h in enumerate(live):
                start = first + k
                hit, row = self._probe(h)
                if not len(hit):
                    continue
                # The hash says where to look; the characters decide.
                same = (self.lengths[row] == j - start) & (self.table[row, : j - start] == codes[hit, start:j]).all(axis=1)
                hit, row = hit[same], row[same]
                score = best[start, hit] + self.scores[row]
                better = score > top[hit]
                hit, row = hit[better], row[better]
                top[hit], size[hit], which[hit] = score[better], j - start, row
            # Where no piece is this one character, it may stand as unknown.
            bare = np.ones(rows, bool)
            bare[self._probe(live[-1])[0]] = False
            score = best[j - 1] + self.least
            bare &= score > top
            top[bare], size[bare], which[bare] = score[bare], 1, -1
            best[j], length[j], piece[j] = top, size, which
        return self._trace(codes, length, piece, n)

    def _trace(self, codes, length, piece, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the backpointers, all words at once from their ends."""
        rows = codes.shape[0]
        at, count = np.full(rows, n, np.int64), np.zeros(rows, np.int64)
        steps, who = [], np.arange(rows)
        while len(who):
            here = at[who]
            steps.append((who, piece[here, who], codes[who, here - 1]))
            count[who] += 1
            at[who] = here - length[here, who]
            who = who[at[who] > 0]
        last = np.cumsum(count) - 1
        flat = np.empty(count.sum(), np.int64)
        for back, (who, rank, code) in enumerate(steps):
            # A character without a piece is kept as its code point, below 0, until all is in place.
            known = self.ids[rank] if len(self.ids) else np.zeros(len(rank), np.int64)
            flat[last[who] - back] = np.where(rank >= 0, known, -1 - code.astype(np.int64))
        bare = np.flatnonzero(flat < 0)
        if not len(bare):
            return flat.astype(np.int32), count
        found, which = np.unique(flat[bare], return_inverse=True)
        ids = [self._fallback(int(-1 - c)) for c in found]
        size = np.ones(len(flat), np.int64)
        size[bare] = np.array([len(x) for x in ids])[which]
        start = np.cumsum(size) - size
        out = np.repeat(flat, size)
        for k, own in enumerate(ids):
            for j, i in enumerate(own):
                out[start[bare[which == k]] + j] = i
        owner = np.repeat(np.arange(rows), count)
        return out.astype(np.int32), np.bincount(owner, size, rows).astype(np.int64)

    def _fallback(self, code: int) -> list[int]:
        raw = chr(code).encode("utf-8", "surrogatepass")
        ids = self.byte_ids[list(raw)]
        return ids.tolist() if (ids >= 0).all() else [self.unknown]

    def units(self, text: str) -> list[str]:
        """The marked text, cut before every run of space marks; nothing for an empty text."""
        return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str], memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has; ``memory`` keeps units between calls."""
        memory = memory or Memory()
        cut = [self.units(t) for t in texts]
        if len(memory.place) > REMEMBER:
            memory.clear()
        memory.add(self, [u for u in set(chain.from_iterable(cut)) if u not in memory.place])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        place = np.fromiter(map(memory.place.__getitem__, chain.from_iterable(cut)), np.int64, n.sum())
        size = memory.size[place]
        edges = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
        return memory.ids[spread(memory.start[place], size)], np.diff(edges)

    def surfaces(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The bytes of ids, cut into texts of ``count`` ids each, less the space that encoding puts before them."""
        size = self.surface_size[ids]
        raw = self.surface_bytes[spread(self.surface_start[ids], size)].tobytes()
        edges = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and a < z) : z] for a, z in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of one list of ids."""
        return self.surfaces(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


class Memory:
    """Units with their ids: places in one array of all ids."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, viterbi: Viterbi, units: list[str]) -> None:
        if units:
            ids, size = viterbi.segment(units)
            self.place.update(zip(units, range(len(self.size), len(self.size) + len(units)), strict=True))
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
            self.ids, self.size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))


def encode(docs: DataFrame, model: Pieces, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, n_pieces long, ids array<int>, round_trip boolean) of every row of ``docs(text, *keep)``.

    ``round_trip`` is whether the decoded ids are the text again. Null texts have null ids and
    round_trip and no pieces; empty texts have an empty array. Whole texts are encoded, rows are
    never joined or split; repeated rows each come back.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def one(batches):
        viterbi, memory = Viterbi(held.value), Memory()
        for b in batches:
            texts = b.column(0).to_pylist()
            ids, n = viterbi.encode([t or "" for t in texts], memory)
            raw = b.column(0).cast(pa.binary()).to_pylist()
            same = [None if t is None else t == x for t, x in zip(raw, viterbi.surfaces(ids, n), strict=True)]
            nulls = np.array([t is None for t in texts], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids), mask=pa.array(nulls))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), lists, pa.array(same, pa.bool_())], [*b.schema.names[1:], "n_pieces", "ids", "round_trip"])

    rows = docs.select(F.col("text").cast("string").alias("_text"), *(F.col(k) for k in keep))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]), "n_pieces long, ids array<int>, round_trip boolean"])
    return map_arrow(rows, one, schema)


def decode(encoded: DataFrame, model: Pieces, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, text) of every row of ``encoded(ids, *keep)``; null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def one(batches):
        viterbi = Viterbi(held.value)
        for b in batches:
            texts = [None if x is None else viterbi.decode(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], [*b.schema.names[1:], "text"])

    rows = encoded.select("ids", *(F.col(k) for k in keep))
    return map_arrow(rows, one, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]), "text string"]))


#: Where the public vocabulary files lie; a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    """``encode`` of every row of ``documents`` with the pieces of a file: null, empty and repeated rows as stated there."""
    return encode(table(spark, sf_dir, "documents"), Pieces.read(model))
