"""Exact top-k inner products by exhaustive term-at-a-time accumulation (operator 5).

Components are turned into integers floor(scale * x). Queries go out in blocks of
bounded size, each block's result written before the next goes out; every task turns its vectors, batch by batch, into postings (one
list of rows and weights per dimension) and, dimension by dimension, scatters
weight times posting into dense score arrays, one per query. A partition
selection keeps each query's k best of the batch, a merge those of the task, and
a last one, over k rows per task and query, those of all.

Nulls, ties and clashes: vectors that are null or hold null or non-finite
components take no part; an empty vector scores 0 against all; a shorter vector
counts as filled up with zeros. Equal scores go to the smaller vec_id. A row is
the query's own if it has its vec_id; repeated rows of a query are one query
(the first vector in order counts), repeated candidate rows are candidates each.
Null vec_ids take no part. Extra columns are ignored; an empty table gives no rows.
Scores are 64-bit: exact for components up to 1e6 in a million dimensions, and not
defined where a product or sum leaves that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialise

#: Queries in one broadcast block (at 64 dimensions 8 MB), and scored at once.
QUERY_BLOCK, QUERY_STEP = 16_384, 128
#: Vectors scored at once.
ROWS_STEP = 4096


def usable(vectors: DataFrame) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of integers, cut or filled to ``width``; a dimension beyond a query's meets weight 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = 0
    for i, n in enumerate(sizes):
        out[i, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Score arrays (queries x rows): for every term, the queries that have it scatter weight x posting."""
    scores = np.zeros((len(queries), len(block)), np.int64)
    for t in range(queries.shape[1]):
        asking = np.flatnonzero(queries[:, t])
        posting = np.flatnonzero(block[:, t])
        if not len(asking) or not len(posting):
            continue
        weights = block[posting, t]
        if len(posting) == len(block):
            for q in asking:
                scores[q] += queries[q, t] * weights
        else:
            for q in asking:
                scores[q, posting] += queries[q, t] * weights
    return scores


def select_best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) without ``own``, ties to smaller ids: a partition finds the k-th score, then only ties are sorted."""
    mine = np.flatnonzero(ids == own)
    if len(mine):
        keep = np.ones(len(ids), bool)
        keep[mine] = False
        ids, scores = ids[keep], scores[keep]
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row whose vec_id is divisible by ``every``."""
    rows = usable(vectors)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    spark = vectors.sparkSession
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def scored(block: list, more: bool) -> DataFrame:
        """The k best of a block of queries; of one that others follow, written, so that its broadcast can go."""
        width = max(len(r[1]) for r in block)
        q_ids = np.array([r[0] for r in block], np.int64)
        q = np.zeros((len(block), width), np.int64)
        for i, r in enumerate(block):
            q[i, : len(r[1])] = np.floor(scale * np.array(r[1], float)).astype(np.int64)
        sent = spark.sparkContext.broadcast((q_ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS_STEP):
                    part = batch.slice(lo, ROWS_STEP)
                    ids = part.column(0).to_numpy()
                    m = _matrix(part.column(1), q.shape[1], scale)
                    for at in range(0, len(q_ids), QUERY_STEP):
                        s = accumulate(q[at : at + QUERY_STEP], m)
                        for j in range(len(s)):
                            i, v = select_best(s[j], ids, q_ids[at + j], k)
                            a, b = best[at + j]
                            i, v = np.concatenate([a, i]), np.concatenate([b, v])
                            order = np.lexsort((i, -v))[:k]
                            best[at + j] = i[order], v[order]
            n = [len(a) for a, _ in best]
            cols = {"query_id": np.repeat(q_ids, n), "vec_id": np.concatenate([a for a, _ in best]), "score": np.concatenate([b for _, b in best])}
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in cols.items()})

        part = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        part = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if more:
            part = materialise(part, "topk")
            sent.destroy()
        return part

    # the driver holds one block of queries at a time; all rows meet each block
    block: list = []
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for r in asked.toLocalIterator():
        if len(block) == QUERY_BLOCK:
            found, block = found.unionByName(scored(block, True)), []
        block.append(r)
    return found.unionByName(scored(block, False)) if block else found
