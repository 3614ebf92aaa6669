"""SimHash near-duplicates: fingerprints, a pigeonring self-join, components.

The 64 bits lie on a ring of five segments. If two fingerprints differ in at most four bits, some
segment starts a chain whose first ``l`` segments together differ in at most ``l * 4 / 5`` bits for
*every* ``l`` (the cycle lemma), i.e. in 0, 1, 2, 3 and 4 bits. The first two steps of that chain
make the join key: the first segment as it is, the second with at most one bit flipped. Later steps
prune pairs of the join before, at five steps, the whole distance is known.

A bucket of the join that is fuller than DENSE is not paired up; its members are linked through the
points within two bits of them, which gives the same components (``midpoint_links``).
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nearcopies
from .common import components, cut, map_arrow, shuffled, table

WORDS_PER_SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (shift, width) of the ring's segments.
SEGMENTS = ((51, 13), (38, 13), (25, 13), (12, 13), (0, 12))
#: A bucket of more fingerprints than this is linked by shared midpoints instead of by its pairs.
DENSE = 256


def fingerprint(text: bytes | None, words_per_shingle: int = WORDS_PER_SHINGLE) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes; no words (or null) give 0."""
    words = text.lower().split() if text else []
    k = words_per_shingle
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(join(words), SEED)
    h = np.fromiter((digest(join(t), SEED) for t in zip(*(words[i:] for i in range(k)))), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def one(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, words_per_shingle) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, one, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    shift, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)


def _key(fp: Column, i: int, flip: int = 0) -> Column:
    return F.lit(i << 26) + F.shiftleft(_segment(fp, i), 13) + _segment(fp, i + 1).bitwiseXOR(flip)


def _chain(x: Column) -> Column:
    """Whether the fingerprints' difference ``x`` keeps to every budget of the chain from segment ``i``."""
    n = len(SEGMENTS)
    ok = F.lit(False)
    for i in range(n):
        total, here = F.lit(0), F.col("i") == i
        for step in range(n):
            total = total + F.bit_count(_segment(x, i + step))
            here = here & (total <= (step + 1) * MAX_BITS // n)
        ok = ok | here
    return ok


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different fingerprints of ``fps(fp)`` that connect all that differ in up to 4 bits.

    Buckets of up to ``DENSE`` fingerprints give all their pairs that pass. In fuller ones the
    pairs would grow with the square of the bucket; there every fingerprint names the points
    within two bits of it, and each is linked with the least one at every point. Two within four
    bits always share such a point, and two at one point are within four bits: the same
    components, by a count of rows that grows with the bucket, not with its square.
    """
    n = len(SEGMENTS)
    # 69 rows come of each fingerprint: these are dealt out first, whatever few files they were read from.
    fps = fps.repartition(4 * fps.sparkSession.sparkContext.defaultParallelism, "fp")
    fp = F.col("fp")
    exact = [F.struct(F.lit(i).alias("i"), _key(fp, i).alias("key")) for i in range(n)]
    near = [F.struct(F.lit(i).alias("i"), _key(fp, i, flip).alias("key")) for i in range(n) for flip in (0, *(1 << j for j in range(SEGMENTS[(i + 1) % n][1])))]
    own = fps.select("fp", F.inline(F.array(*exact)))
    dense = cut(own.groupBy("i", "key").count().where(F.col("count") > DENSE).select("i", "key"))
    around = fps.select(fp.alias("b"), F.inline(F.array(*near)))
    if dense.isEmpty():
        tight = None
    else:
        # Members: whatever meets a dense bucket exactly or with one bit flipped.
        tight = cut(around.join(shuffled(dense), ["i", "key"], "left_semi").select(F.col("b").alias("fp")).distinct())
        own = own.join(shuffled(dense), ["i", "key"], "left_anti")
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = own.withColumnRenamed("fp", "a").join(shuffled(around), ["i", "key"]).where((F.col("a") < F.col("b")) & _chain(x)).select("a", "b").distinct()
    if tight is not None:
        pairs = pairs.unionByName(midpoint_links(tight))
    return pairs


def midpoint_links(fps: DataFrame) -> DataFrame:
    """The same components as all pairs within four bits, by the points within two bits of each."""
    masks = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
    flips = F.array(*(F.lit(int(np.uint64(m).astype(np.int64))) for m in masks))
    at = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    low = at.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("at", "a")
    return at.join(shuffled(low), "at").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): SimHash classes of ``docs(doc_id, text)``, a row each.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Copies share a
    fingerprint and so never meet as pairs. Repeated rows each come back. A null doc_id comes back
    as null and never names a component unless it has no other member. No rows give no rows.
    """
    fps = cut(fingerprints(docs, words_per_shingle))
    own = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = components(links(own.select("fp")))
    of = cut(own.join(shuffled(labels), own["fp"] == labels["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label")))
    least = of.groupBy("label").agg(F.min("low").alias("component_id"))
    named = cut(of.join(shuffled(least), "label").select("fp", "component_id"))
    out = fps.join(shuffled(named), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words_per_shingle: int, similarity: Fraction) -> DataFrame:
    """``docs`` with one row of each group of texts whose shingle sets reach ``similarity``: that of its smallest doc_id.

    Texts of one SimHash class are candidates, and so are those that share a key of min-hashes
    (``nearcopies``): at a similarity of 0.8 some 10 of 64 bits differ, which no chain of segments
    joins by a key. A candidate goes only if its whole shingle set reaches the similarity. Of equal
    texts one row stays; different texts that share a doc_id are judged each for itself. Rows without
    a doc_id can't be told apart and stay; null and empty texts are one text; no rows give no rows.
    """
    classes = near_duplicates(docs.where("doc_id IS NOT NULL"), words_per_shingle)
    return nearcopies.deduplicate(docs, words_per_shingle, similarity, classes.select("doc_id", F.col("component_id").alias("class")))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of every row of ``documents``: null, empty and repeated rows as stated there."""
    return near_duplicates(table(spark, sf_dir, "documents"))
