"""Approximate nearest neighbours by collision counting with virtual rehashing.

Vectors are dealt into blocks. A block keeps, for each of ``projections`` random
directions, its vectors' projections in one sorted array. For a query the arrays
are opened in a window around the query's own projection; the window widens step
by step (virtual rehashing), and each vector counts the windows it is in. Vectors
whose count reaches the collision threshold are candidates; the widening stops
once a block has enough of them, and their true inner products, in double
precision, decide. Inner-product order is turned into distance order by
one more coordinate that gives all vectors the block's largest norm.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors of a block and queries of a block at most, on average.
VECTORS, QUERIES = 16384, 4096


def usable(vec: str) -> F.Column:
    """Whether a vector takes part: not null, not zero, every component a finite number."""
    c = F.col(vec)
    return c.isNotNull() & F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projection arrays of one block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int, seed: int = 11):
        norm2 = np.einsum("ij,ij->i", vectors, vectors)
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(norm2.max() - norm2, 0))[:, None]], axis=1)
        self.axes = np.random.default_rng(seed).normal(size=(lifted.shape[1], projections))
        at = lifted @ self.axes
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(at, self.order.T, axis=0).T.copy()
        self.radius = np.sqrt(norm2.max())
        self.n = len(vectors)

    def candidates(self, queries: np.ndarray, want: int, share: float, opening: float, growth: float) -> Iterator[tuple[int, np.ndarray]]:
        """(query's place, rows that collide in a share of its windows), once there are ``want`` (or all).

        The first windows hold about a share ``opening`` of the block; each
        rehashing multiplies their width by ``growth``.
        """
        sizes = np.linalg.norm(queries, axis=1, keepdims=True)
        point = (queries * (self.radius / sizes)) @ self.axes[:-1]  # queries are lifted by zero
        m, need = point.shape[1], max(1, int(share * point.shape[1]))
        place = np.stack([np.searchsorted(self.sorted[j], point[:, j]) for j in range(m)], axis=1)
        reach = max(1, int(opening * self.n / 2))
        ends = [self.sorted[np.arange(m), np.clip(place + step, 0, self.n - 1)] for step in (-reach, reach)]
        half = (ends[1] - ends[0]).mean(axis=1) / 2 + 1e-12 * self.radius
        low, high = place.copy(), place
        count = np.zeros((len(queries), self.n), dtype=np.int16)
        left = np.arange(len(queries))
        while len(left):
            edge = [np.stack([np.searchsorted(self.sorted[j], point[left, j] + sign * half[left], side) for j in range(m)], axis=1) for sign, side in ((-1, "left"), (1, "right"))]
            new_low, new_high = np.minimum(edge[0], low[left]), np.maximum(edge[1], high[left])
            open_ = []
            for at, q in enumerate(left):
                parts = [o[a:b] for o, a, b in zip(self.order, new_low[at].tolist(), low[q].tolist(), strict=True) if a < b]
                parts += [o[a:b] for o, a, b in zip(self.order, high[q].tolist(), new_high[at].tolist(), strict=True) if a < b]
                if parts:
                    count[q] += np.bincount(np.concatenate(parts), minlength=self.n).astype(np.int16)
                found = np.flatnonzero(count[q] >= need)
                if len(found) >= min(want, self.n):
                    yield q, found
                else:
                    open_.append(q)
            low[left], high[left] = new_low, new_high
            left = np.array(open_, dtype=np.int64)
            half[left] *= growth


def search_block(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, projections: int, share: float, candidate_share: float) -> Iterator[tuple]:
    """(query id, vector id, score) of each query's best ``k`` in the block."""
    index = Index(vectors, projections)
    want = int(5 * k + candidate_share * len(ids))
    for at in range(0, len(qids), 256):
        for q, rows in index.candidates(queries[at : at + 256], want, share, 0.4, 1.15):
            qid = qids[at + q]
            rows = rows[ids[rows] != qid]
            score = np.einsum("ij,j->i", vectors[rows], queries[at + q])
            best = np.lexsort((ids[rows], -score))[:k]
            yield from zip([qid] * len(best), ids[rows[best]], score[best], strict=True)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = 128, share: float = 0.6, candidate_share: float = 0.1) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for rows where ``is_query`` holds, the ``k`` best of all other rows.

    Every row is indexed. Vectors that are null, zero, or hold a null or
    non-finite component take no part, on either side; nor do rows with a null id
    or of another length than most (ties: the longest). Repeated ids count as one
    row each, but a query never finds rows of its own id. Ties go to the
    smaller id. Each pair of a vector block and a query block is one task.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n, nq = (sizes.dim, sizes.n, sizes.nq) if sizes else (0, 0, 0)
    nv, nqb = max(1, ceil(n / VECTORS)), max(1, ceil(nq / QUERIES))
    rows = rows.where(F.size("v") == dim)
    spread = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select(spread(nv).alias("vb"), every(nqb).alias("qb"), "id", "v")
    right = rows.where("q").select(every(nv).alias("vb"), spread(nqb).alias("qb"), "id", "v")

    def run(key, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        found = search_block(data.id.to_numpy(), np.stack(data.v.to_numpy()), asked.id.to_numpy(), np.stack(asked.v.to_numpy()), k, projections, share, candidate_share)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(run, "query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id", "score"))), 1, k)
    top = found.groupBy("query_id").agg(best.alias("best"))
    return top.select("query_id", F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
