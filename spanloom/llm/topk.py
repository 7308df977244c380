"""Exact top-k by inner product: no-random-access aggregation of sorted lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows in a tile of vectors and of queries: what one task holds at a time.
TILE_VECTORS, TILE_QUERIES = 4096, 2048
#: Shares of the lists after which bounds are compared.
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 1)
#: Shares from which a tile is read at once if floors are known that a shallow reading can't reach.
DEEP = 1 / 2
#: With so few candidates left (or twice k), their final scores are resolved.
FEW = 256
#: Queries that are worked on at a time.
TOGETHER = 512


def quantised(vector: Column) -> Column:
    """floor(64 * x) of every component, or NULL if the vector can't take part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * 64)))


class Lists:
    """The sorted lists of a tile of vectors, one for each component, and what has been read of them.

    A list is read from the end where it helps a query's score most: from the top for
    components that the query weighs above zero, from the bottom for others.
    """

    def __init__(self, vectors: np.ndarray, order: np.ndarray):
        self.n, self.dims = vectors.shape
        self.vectors = vectors.astype(np.float32)
        self.sorted = np.take_along_axis(self.vectors, order.T, axis=0)
        self.rank = np.empty((self.n, self.dims), np.int32)
        np.put_along_axis(self.rank, order.T.astype(np.int64), np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        self.most = np.abs(vectors).max(axis=0, initial=0).astype(np.float64)

    def read(self, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """After ``to`` reads of each list, from the top and from the bottom: values seen, places unseen, and the last value of each list."""
        top, bottom = self.rank >= self.n - to, self.rank < to
        seen = np.concatenate([self.vectors * top, self.vectors * bottom], axis=1)
        unseen = np.concatenate([~top, ~bottom], axis=1).astype(np.float32)
        return seen, unseen, np.concatenate([self.sorted[self.n - to], self.sorted[to - 1]])

    def candidates(self, queries: np.ndarray, k: int, floors: np.ndarray) -> list[np.ndarray]:
        """For each query the rows among which its k best surely are, by sequential reads of all lists alike.

        Of every row the part of the score read so far is known; each list's last value read
        bounds what an unread component can add, its end what it must. Reading stops for a query
        when no more than FEW rows (or 2 k) have an upper bound that reaches the k-th largest lower
        bound, or its floor, a score that k rows elsewhere are known to reach. Bounds are products
        of matrices in single precision with a margin, so rounding drops nothing.
        """
        few, ends = max(2 * k, FEW), np.concatenate([self.sorted[0], self.sorted[-1]]) if self.n else np.zeros(0)
        rest: list[np.ndarray] = [np.arange(self.n)] * len(queries)
        if self.n <= few:
            return rest
        weights = queries.astype(np.float32)
        weights = np.concatenate([np.maximum(weights, 0), np.minimum(weights, 0)], axis=1)
        slack = 1e-4 * (np.abs(queries).astype(np.float64) @ self.most) + 1e-3
        open_ = np.arange(len(queries))
        for depth in DEPTHS:
            if depth < DEEP and np.isfinite(floors[open_]).all():
                continue
            to = max(1, int(self.n * depth))
            seen, unseen, last = self.read(to)
            going = []
            for at in range(0, len(open_), TOGETHER):
                own = open_[at : at + TOGETHER]
                known = weights[own] @ seen.T
                lower = known + (weights[own] * ends) @ unseen.T
                upper = known + (weights[own] * last) @ unseen.T
                lowest = np.maximum(floors[own], np.partition(lower, self.n - k, axis=1)[:, self.n - k])
                reach = upper >= (lowest - slack[own])[:, None]
                for i, fits in zip(own.tolist(), reach):
                    rest[i] = np.flatnonzero(fits)
                    if len(rest[i]) > few:
                        going.append(i)
            open_ = np.array(going, np.int64)
            if not len(open_):
                break
        return rest


def aggregate_lists(query: np.ndarray, vectors: np.ndarray, order: np.ndarray, k: int, floor: float = -np.inf) -> np.ndarray:
    """Rows of ``vectors`` among which the k best for one query surely are; ``order[d]`` lists the rows by ascending component d. See :class:`Lists`."""
    return Lists(vectors, order).candidates(np.asarray(query)[None, :], k, np.array([floor]))[0]


def tile_top(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vectors of a tile for each query of a tile, ties to the smaller id."""
    width = max(max(map(len, queries.v)), max(map(len, vectors.v)))

    def matrix(rows: pd.Series) -> np.ndarray:
        out = np.zeros((len(rows), width), dtype=np.int64)
        for i, row in enumerate(rows):
            out[i, : len(row)] = row
        return out

    q, v = matrix(queries.v), matrix(vectors.v)
    ids = vectors.vec_id.to_numpy()
    order = np.argsort(v, axis=0, kind="stable").T.astype(np.int32)
    floors = queries.floor.to_numpy(dtype=float, na_value=-np.inf)
    rests = Lists(v, order).candidates(q, k + 1, np.where(np.isnan(floors), -np.inf, floors))  # one more, for the query's own row
    found = []
    for qid, row, rest in zip(queries.vec_id.to_numpy(), q, rests):
        rest = rest[ids[rest] != qid]
        scores = v[rest] @ row
        best = np.lexsort((ids[rest], -scores))[:k]
        found.append(pd.DataFrame({"query_id": qid, "vec_id": ids[rest][best], "score": scores[best]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def top_k(
    embeddings: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k highest integer inner products of every query row against all other rows.

    Components are quantised to floor(64 * x). Result: query_id, rank (from 1), vec_id,
    score; ties go to the smaller vec_id; fewer than k rows where there are fewer candidates.

    Rows with a NULL id, and vectors that are NULL or hold a NULL or non-finite component,
    take no part. Of rows that share an id the one with the greatest vector counts. Vectors
    of different length are compared as if the shorter ended in zeros. An empty table, or one
    without queries, gives an empty result. Components up to 2**20 keep all sums exact.

    Queries and vectors are dealt into tiles by a hash of their id. A task holds one tile of
    each, at most about TILE_QUERIES and TILE_VECTORS rows whatever the table's size, reads
    its sorted lists and returns k rows for each query. The first tile of vectors is read before
    the others: the k-th score there is a floor below which no other tile's rows count. The
    k best of all follow from a window that limits each group before its shuffle.
    """
    vectors = (
        embeddings.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col)).alias("v"), is_query.alias("q"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .groupBy("vec_id")
        .agg(F.max("v").alias("v"), F.max("q").alias("q"))
    )
    n, n_queries = vectors.agg(F.count("*"), F.count_if("q")).first()
    across, down = -(-n // TILE_VECTORS) or 1, -(-n_queries // TILE_QUERIES) or 1
    tile = F.xxhash64("vec_id")

    mine = lambda n: F.pmod(tile, F.lit(n)).cast("int")
    each = lambda begin, end: F.explode(F.sequence(F.lit(begin), F.lit(end - 1)))

    def joined(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return tile_top(queries, rows, k).astype("int64")

    def tops(queries: DataFrame, begin: int, end: int) -> DataFrame:
        """The best of the tiles of vectors from ``begin`` to ``end``. Tiles are much work for few bytes: their number says into how many tasks they go."""
        tasks = 4 * (end - begin) * down
        # one type on both sides: rows of equal numbers of different types go to different tasks
        left = queries.select(mine(down).alias("qt"), each(begin, end).alias("vt"), "vec_id", "v", "floor").repartition(tasks, "qt", "vt")
        own = vectors.select(mine(across).alias("vt"), "vec_id", "v").where(F.col("vt").between(begin, end - 1))
        right = own.select(each(0, down).alias("qt"), "vt", F.col("vec_id").alias("vec_id"), F.col("v").alias("v")).repartition(tasks, "qt", "vt")
        return left.groupBy("qt", "vt").cogroup(right.groupBy("qt", "vt")).applyInPandas(joined, "query_id long, vec_id long, score long")

    queries = vectors.where("q")
    found = tops(queries.withColumn("floor", F.lit(None).cast("double")), 0, 1)
    if across > 1:
        found = cut(found)
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
        found = found.unionByName(tops(queries.join(floors, "vec_id", "left"), 1, across))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


