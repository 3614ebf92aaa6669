"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A vector's components are its terms. Candidates stay where they lie: each batch of them becomes
postings, a list of (row, weight) for every term. The queries come in blocks of bounded size by
broadcast; a query's non-zero terms are taken one after another, and each scatters its weighted
postings into a dense array of scores. The best of every batch are picked by partition selection
and merged, first within a partition, then by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

K = 10
EVERY = 100
#: Queries in one broadcast block, about; more make more passes over the candidates.
BLOCK = 4096
#: Blocks whose results are one plan; each further group is written to the shared folder first.
PLAN_BLOCKS = 8


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, terms array<long>): components times ``scale``, floored, of vectors that are whole and finite."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).alias("terms"))


def postings(terms: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Term -> (rows that have it, their weights), zero weights left out."""
    sizes = np.array([len(t) for t in terms])
    if not len(sizes):
        return {}
    flat = np.concatenate(terms) if sizes.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(terms)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(flat)
    order = some[np.lexsort((row[some], term[some]))]
    edges = np.flatnonzero(np.diff(term[order])) + 1
    return {int(term[part[0]]): (row[part], flat[part]) for part in np.split(order, edges) if len(part)}


def accumulate(query: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]], scores: np.ndarray) -> np.ndarray:
    """Dense scores of all rows, term at a time, in place."""
    scores[:] = 0
    for t in np.flatnonzero(query).tolist():
        if (own := lists.get(t)) is not None:
            rows, weights = own
            if len(rows) == len(scores):
                scores += query[t] * weights
            else:
                scores[rows] += query[t] * weights
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending), in that order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        ties = np.flatnonzero(scores == least)
        need = k - len(above)
        if len(ties) > need:
            ties = ties[np.argpartition(ids[ties], need - 1)[:need]] if need else ties[:0]
        place = np.concatenate((above, ties))
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))]


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best of all candidates but those of its own id.

    Both are ``(vec_id, terms array<long>)``. Ties go to the smaller vec_id; terms that one side
    lacks count as 0. Repeated candidate rows each compete; a repeated query id is searched once,
    with the least of its vectors. No queries or no candidates give no rows.
    """
    spark = candidates.sparkSession
    queries = cut(queries.groupBy("vec_id").agg(F.min("terms").alias("terms")))
    total = queries.count()
    blocks = max(1, -(-total // BLOCK))
    parts, done = [], []
    for block in range(blocks):
        own = [(r["vec_id"], np.array(r["terms"], np.int64)) for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()]
        held = spark.sparkContext.broadcast(own)

        def one(batches, held=held):
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                offsets = b.column(1).offsets.to_numpy()
                flat = b.column(1).values.to_numpy(zero_copy_only=False)
                lists = postings([flat[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)])
                scores = np.zeros(len(ids), np.int64)
                for q, terms in held.value:
                    accumulate(terms, lists, scores)
                    at = select(scores, ids, k + int((ids == q).sum()))
                    at = at[ids[at] != q][:k]
                    found_ids, found = ids[at], scores[at]
                    if q in best:
                        found_ids, found = np.concatenate((best[q][0], found_ids)), np.concatenate((best[q][1], found))
                        at = select(found, found_ids, k)
                        found_ids, found = found_ids[at], found[at]
                    best[q] = (found_ids, found)
            if best:
                sizes = [len(v[0]) for v in best.values()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), sizes)), pa.array(np.concatenate([v[0] for v in best.values()])), pa.array(np.concatenate([v[1] for v in best.values()]))], ["query_id", "vec_id", "score"])

        parts.append(map_arrow(candidates, one, "query_id long, vec_id long, score long"))
        if len(parts) == PLAN_BLOCKS and block < blocks - 1:
            done.append(cut(_merged(parts, k)))
            parts = []
    merged = _merged(parts, k)
    for d in done:
        merged = merged.unionByName(d)
    return merged


def _merged(parts: list[DataFrame], k: int) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The K best of all ``embeddings`` for every vec_id that EVERY divides.

    Null ids, null vectors and such with a null or non-finite component take no part; empty vectors
    score 0; repeated ids are searched once and compete each; no rows give no rows.
    """
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows.where(F.col("vec_id") % EVERY == 0), rows)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
t AS (SELECT vec_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
