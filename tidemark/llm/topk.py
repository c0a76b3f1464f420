"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Each vector is a sparse row: components are terms, integer weights their postings. Candidates are dealt into parts of bounded
size and every query is sent to every part, in one shuffle, sorted so that a part's candidates come first. The task turns
them into postings and works its queries off in blocks as they stream by: for each term the queries that have it scatter
their weight times the posting's weights into a dense array of scores (queries x candidates), and partition selection
keeps each query's best k of the part. One window merges the parts' winners. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stored

K, SCALE = 10, 1024
#: Queries of a block and candidates of a part at most on average, which bound a task's dense array (8 bytes a cell).
QUERY_BLOCK, CANDIDATE_BLOCK = 64, 65_536
#: Fewer candidates to a part, so that all tasks have one, but no fewer than this.
LEAST_BLOCK = 4096


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a long; null if the vector or a component is null, NaN or infinite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def dense(rows: pa.ListArray) -> np.ndarray:
    """Vectors as a matrix; shorter ones are filled with 0."""
    size = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def postings(m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term (positions, weights) of the rows where its weight is not 0."""
    return [(np.flatnonzero(c), c[c != 0]) for c in np.ascontiguousarray(m.T)]


def accumulate(queries: list[tuple[np.ndarray, np.ndarray]], n_queries: int, docs: list[tuple[np.ndarray, np.ndarray]], n_docs: int) -> np.ndarray:
    """Scores (queries x documents), term by term: every query that has the term scatters its weighted postings."""
    scores = np.zeros((n_queries, n_docs), np.int64)
    for (q, qw), (d, dw) in zip(queries, docs, strict=False):
        if len(q) == n_queries and len(d) == n_docs:
            scores += qw[:, None] * dw[None, :]
        elif len(q) and len(d):
            for i, w in zip(q.tolist(), qw.tolist(), strict=True):
                scores[i, d] += w * dw
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, scores) of its k best, ties to the smaller id; `own` are the queries' ids, left out."""
    out = []
    for q in range(len(scores)):
        s, may = scores[q], ids != own[q]
        at = np.flatnonzero(may)
        if len(at) > k:
            least = -np.partition(-s[at], k - 1)[k - 1]
            at = at[s[at] >= least]  # all ties at the edge are kept for the exact order below
        at = at[np.lexsort((ids[at], -s[at]))[:k]]
        out.append((ids[at], s[at]))
    return out


def search(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every row for which is_query holds.

    Candidates are all rows but those with the query's own id. Scores are integer inner products of the quantised
    vectors; vectors of other lengths count missing components as 0. Rows with a null id or with a vector that is null or
    holds null or non-finite components take no part. Ties go to the smaller id. Rows equal in id and vector are one; rows
    of one id with unlike vectors are candidates each, and as queries share the k places of their id. An empty table gives
    no rows; an empty vector scores 0.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    small = rows.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("is_query")).filter("vec_id is not null and v is not null")
    small = stored(small.groupBy("vec_id", "v").agg(F.max("is_query").alias("is_query")), "quantised")
    told = small.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("v")).alias("most"), F.min(F.array_min("v")).alias("least")).first()
    if -(1 << 15) <= (told["least"] or 0) and (told["most"] or 0) < 1 << 15:
        small = small.withColumn("v", F.col("v").cast("array<short>"))  # a quarter of the bytes to every part
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, -(-told["n"] // CANDIDATE_BLOCK), min(tasks, -(-told["n"] // LEAST_BLOCK)))
    candidates = small.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("asks"), "vec_id", "v")
    queries = small.filter("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("asks"), "vec_id", "v")
    tasks = min(parts, tasks)
    dealt = candidates.unionAll(queries).repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "asks", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, waiting = None, [], []  # (ids, vectors) of the part's candidates and of queries not worked off yet
        terms, ids = None, None

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal terms, ids
            if waiting and held:
                if terms is None:
                    ids, terms = np.concatenate([i for i, _ in held]), postings(stack([m for _, m in held]))
                own = np.concatenate([i for i, _ in waiting])
                found = select(accumulate(postings(stack([m for _, m in waiting])), len(own), terms, len(ids)), ids, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, [len(i) for i, _ in found])), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])
            waiting.clear()

        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [b.num_rows]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if x == y:
                    continue
                if key[x] // 2 != part:
                    yield from block()
                    part, terms = int(key[x] // 2), None
                    held.clear()
                own = b.column(2)[x:y].to_numpy(), dense(b.column(3)[x:y])
                (waiting if key[x] % 2 else held).append(own)
                if sum(len(i) for i, _ in waiting) >= QUERY_BLOCK:
                    yield from block()
        yield from block()

    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def stack(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices one below the other, filled with 0 to the widest."""
    out, at = np.zeros((sum(map(len, parts)), max(m.shape[1] for m in parts)), np.int64), 0
    for m in parts:
        out[at : at + len(m), : m.shape[1]] = m
        at += len(m)
    return out
