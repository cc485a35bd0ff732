"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates lie in vertical layout, one row for each dimension. A query adds up its partial inner products
one block of dimensions at a time; by Cauchy-Schwarz what the remaining dimensions can add is at most the
product of the two remaining norms, and candidates that can no longer reach the k-th best are compacted away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXACT = float(1 << 52)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and integer components floor(scale * x). Rows with a null id, a null vector, or a null or non-finite component go."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )


class _Best:
    """The k best of each query so far: scores downwards, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, block: int):
        self.ids, self.k, self.block = ids, k, block
        self.exact_max = float(np.abs(vectors).max(initial=0))
        self.q = vectors.astype(np.float64)
        self.qi = vectors
        starts = range(0, vectors.shape[1], block)
        self.rest = np.stack([np.sqrt((self.q[:, s:] ** 2).sum(1)) for s in starts] or [np.zeros(len(ids))])
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        dim = rows.shape[1]
        exact = max(self.exact_max, 1.0) * max(float(np.abs(rows).max(initial=0)), 1.0) * max(dim, 1) < EXACT
        cols = np.ascontiguousarray(rows.T.astype(np.float64))
        starts = list(range(0, dim, self.block))
        rest = [np.sqrt((cols[s:] ** 2).sum(0)) for s in starts]
        for n, own in enumerate(self.ids):
            have_scores, have_ids = self.best[n]
            at_least = have_scores[-1] if len(have_scores) == self.k else None
            alive = np.flatnonzero(ids != own)
            total = np.zeros(len(alive))
            for b, s in enumerate(starts if exact else []):
                if at_least is not None:
                    bound = total + self.rest[b, n] * rest[b][alive]
                    keep = bound + np.abs(bound) * 1e-9 + 1e-6 >= at_least
                    if not keep.all():
                        alive, total = alive[keep], total[keep]
                if not len(alive):
                    break
                part = cols[s : s + self.block]
                total = total + self.q[n, s : s + self.block] @ (part if len(alive) == part.shape[1] else part[:, alive])
            if not len(alive):
                continue
            # components too large for exact sums in floating point take integer arithmetic
            score = total.astype(np.int64) if exact else rows[alive] @ self.qi[n]
            if at_least is not None:
                keep = score >= at_least
                alive, score = alive[keep], score[keep]
            score, found = np.concatenate([have_scores, score]), np.concatenate([have_ids, ids[alive]])
            order = np.lexsort((found, -score))[: self.k]
            self.best[n] = score[order], found[order]


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    lists = batch.column("v")
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield ids[rows], flat[offsets[rows][:, None] + np.arange(dim)]


def exact_topk(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", dims_per_block: int = 16, queries_per_pass: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest integer inner product for each query row.

    Queries travel to the executors in passes of at most queries_per_pass vectors, each against all rows; every
    task keeps its own k best for each query, and only these are shuffled. Ties go to the smaller id.
    Vectors that are null, or hold a null or a non-finite component, and rows with a null id take no part.
    A vector is compared with those of its own length only. Rows that share a query's id are the query's own.
    Repeated rows are separate candidates; a query repeated with the same vector is answered once. Fewer than k
    candidates: all of them. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col, scale)
    asked = quantised(vectors.where(is_query), id_col, vec_col, scale).distinct()
    passes = max(1, -(-asked.count() // queries_per_pass))
    out = None
    for n in range(passes):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == n).orderBy("id", "v").toArrow()
        sent = spark.sparkContext.broadcast([m for b in got.combine_chunks().to_batches() for m in _matrices(b)])

        def search(batches: Iterator[pa.RecordBatch], sent=sent, n=n) -> Iterator[pa.RecordBatch]:
            # the ordinal tells different vectors under one id apart
            best = {m.shape[1]: _Best(ids, m, k, dims_per_block) for ids, m in sent.value}
            for batch in batches:
                for ids, m in _matrices(batch):
                    if m.shape[1] in best:
                        best[m.shape[1]].add(ids, m)
            for dim, b in best.items():
                size = np.array([len(s) for s, _ in b.best], np.int64)
                if size.sum():
                    yield pa.RecordBatch.from_pydict({
                        "query_id": np.repeat(b.ids, size), "query_no": [f"{n}:{dim}:{i}" for i in np.repeat(np.arange(len(size)), size)],
                        "vec_id": np.concatenate([i for _, i in b.best]), "score": np.concatenate([s for s, _ in b.best]),
                    })

        found = rows.mapInArrow(search, "query_id long, query_no string, vec_id long, score long")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
