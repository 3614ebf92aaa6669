"""The exact half of SimHash deduplication: Jaccard similarity of word shingles, over classes and min-hash keys as candidates.

A text's sketch is ``BANDS`` keys, each of ``ROWS`` min-hashes. Two texts of similarity s share a key
with probability ``1 - (1 - s**ROWS)**BANDS``: 0.9997 at 0.8. Texts that share a key meet in one task, as
sets of shingle hashes of 64 bits; there the whole sets are compared, many at once as products of
matrices, and no pair leaves the task. Buckets of more than ``MEET`` texts are dealt out as pairs of blocks.
"""

from __future__ import annotations

import functools
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, shuffled

ROWS, BANDS = 6, 27
#: Shingles whose min-hashes are made at once; bounds a worker's matrix to some 3 MB.
BLOCK = 4096
_A = np.random.default_rng(17).integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(18).integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
#: Texts of a bucket that one block holds; two blocks meet at most. Different hashes that are counted at once.
MEET, COLUMNS = 1024, 4096
#: Bits of the filter of ids whose texts are read again: 1 MB.
FILTER_BITS = 1 << 23
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashed(text: str | None, width: int, digest) -> np.ndarray:
    """Hashes of the text's different shingles, ascending; ``digest`` gives a word's 64-bit hash."""
    words = (text or "").lower().split()
    h = np.fromiter(map(digest, words), np.uint64, len(words)) if words else np.zeros(1, np.uint64)
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = _mixed(s * _MIX + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def sketch(text: str | None, width: int, digest) -> np.ndarray:
    """A text's keys."""
    s = hashed(text, width, digest)
    low = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    halves = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(s), BLOCK):
        low = np.minimum(low, (_A[:, None] * halves[None, at : at + BLOCK] + _B[:, None]).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _MIX + part)
    return keys.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, keys) of ``docs(doc_id, text)``: the text's hash, and its keys."""

    def one(batches):
        digest = functools.lru_cache(200_000)(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))
        for b in batches:
            texts = b.column(1).to_pylist()
            nodes = pa.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts], pa.int64())
            found = [sketch(t, width, digest) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), nodes, pa.array(found, pa.list_(pa.int64()))], ["doc_id", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, one, "doc_id long, node long, keys array<long>")


def similar_to_smaller(sets: list[np.ndarray], least: Fraction) -> list[bool]:
    """For each set of hashes, in order, whether it is similar to one before it that isn't similar to one itself.

    Overlaps are counted by products of 0/1 matrices, COLUMNS different hashes at a time.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    if n < 2:
        return [False] * n
    hashes, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    edges = np.searchsorted(column, np.arange(0, len(hashes) + COLUMNS, COLUMNS))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        own = np.zeros((n, COLUMNS), np.float32)
        own[row[lo:hi], column[lo:hi] - k * COLUMNS] = 1.0
        both += own @ own.T
    both = np.rint(both).astype(np.int64)
    near = both * least.denominator >= least.numerator * (sizes[:, None] + sizes[None, :] - both)
    gone = np.zeros(n, bool)
    for i in range(1, n):
        gone[i] = (near[i, :i] & ~gone[:i]).any()
    return gone.tolist()


def _meet(least: Fraction):
    """Nodes that are similar to a smaller one of their group, from rows (key, low, node, shingles) sorted by these."""

    def one(batches):
        key, nodes, sets = None, [], []

        def finish():
            gone = [n for n, g in zip(nodes, similar_to_smaller(sets, least), strict=True) if g]
            return pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["node"])

        for b in batches:
            for k, node, raw in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if k != key:
                    if len(nodes) > 1:
                        yield finish()
                    key, nodes, sets = k, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(raw, np.uint64))
        if len(nodes) > 1:
            yield finish()

    return one


def copies(docs: DataFrame, width: int, least: Fraction, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, dropped): ``rows(node, low)`` and the nodes that are near copies of a smaller one.

    Nodes are different texts, ordered by their least doc_id, ``low``. Candidates share a min-hash key or
    one of ``classes(doc_id, class)``. Only texts that have a candidate are turned into shingle sets (a
    filter of fixed size leaves most others unmoved), and sent to each of their keys. A bucket of more than MEET texts is dealt into blocks, and every pair of
    blocks is a group of its own, so that a group fits a task however large a bucket is.
    """
    found = cut(sketches(docs, width))
    own = cut(found.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys")))
    classed = classes.select(F.col("doc_id").alias("low"), F.xxhash64(F.lit("class"), "class").alias("key")).distinct()
    rest = own.select("node", "low", F.explode("keys").alias("key")).unionByName(own.select("node", "low").join(shuffled(classed), "low").select("node", "low", "key"))
    # Of keys with the very same texts one is enough: near copies share several.
    held = rest.groupBy("key").agg(F.count("*").alias("all"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("all > 1")
    held = held.groupBy("all", "x", "y").agg(F.min("key").alias("key")).select("key", "all")
    rest = cut(rest.join(shuffled(held), "key"))
    some = found.join(shuffled(rest.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("low"))
    texts = docs.select(F.col("doc_id").cast("long").alias("low"), F.col("text").cast("string").alias("text"))
    some = cut(some)
    passed = docs.sparkSession.sparkContext.broadcast(_id_filter(some.select("low")))
    few = map_arrow(texts, lambda batches: (b.filter(pa.array(_passes(b.column(0), passed.value))) for b in batches), "low long, text string")
    sets = map_arrow(few.join(shuffled(some.select("low").distinct()), "low", "left_semi"), _with_shingles(width), "node long, shingles binary")
    sets = sets.join(shuffled(some.select("node")), "node", "left_semi").dropDuplicates(["node"])
    blocks = F.ceil(F.col("all") / MEET).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    dealt = rest.select("node", "low", "key", block.alias("block"), others)
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    rows = dealt.select(group.alias("key"), "low", "node").join(shuffled(sets), "node").select("key", "low", "node", "shingles")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = map_arrow(rows.repartition(parts, "key").sortWithinPartitions("key", "low", "node"), _meet(least), "node long")
    return own.select("node", "low"), cut(met.distinct())


def _places(ids: np.ndarray) -> np.ndarray:
    """Places in the filter of ids that each sets, a row each."""
    own = ids.astype(np.int64).view(np.uint64)
    return np.stack([_mixed(own + np.uint64(k)) % np.uint64(FILTER_BITS) for k in (1, 2, 3)], axis=1)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits that all ``ids`` (one column) pass, and few others; only its set words reach the driver."""

    def words(batches):
        for b in batches:
            at = np.unique(_places(b.column(0).to_numpy()))
            word, owner = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, owner, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for word, bits in map_arrow(ids, words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        out[word] = np.int64(bits).view(np.uint64)
    return out


def _passes(ids: pa.Array, held: np.ndarray) -> np.ndarray:
    at = _places(ids.fill_null(0).to_numpy(zero_copy_only=False))
    return ((held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _with_shingles(width: int):
    """(node, shingles): a text's hash, and the hashes of its different shingles."""

    def one(batches):
        digest = functools.lru_cache(200_000)(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))
        for b in batches:
            texts = b.column(1).to_pylist()
            nodes = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([hashed(t, width, digest).tobytes() for t in texts], pa.binary())], ["node", "shingles"])

    return one


def deduplicate(docs: DataFrame, width: int, least: Fraction, classes: DataFrame) -> DataFrame:
    """``docs`` without near copies: of texts with that shingle similarity or more, the smallest doc_id stays.

    Of equal texts one row stays, that of the smallest doc_id; different texts that share a doc_id are
    judged each for itself. Every text that goes is similar to one of a smaller doc_id. Rows without
    a doc_id can't be told apart and stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    own, dropped = copies(named, width, least, classes)
    kept = own.join(shuffled(dropped), "node", "left_anti").select(F.col("low").alias("doc_id"), "node")
    at = docs.columns.index("text")

    def tagged(batches):
        for b in batches:
            nodes = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64())], [*b.schema.names, "node"])

    schema = named.withColumn("node", F.lit(0).cast("long")).schema
    out = map_arrow(named, tagged, schema).join(shuffled(kept), ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"])
    return out.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
