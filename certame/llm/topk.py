"""Exact inner-product search by the threshold algorithm over sorted lists of each dimension."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 20
#: Rows of a block of candidates, and of a block of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 16384, 512
#: Entries that a round reads from each list.
DEPTH = 64
#: Partitions that pairs of blocks are dealt to, at most; more pairs share them.
MOST_TASKS = 20_000


def _arithmetic(vectors: np.ndarray, queries: np.ndarray) -> type:
    """The narrowest kind of number that holds every product exactly; for numbers that aren't whole, doubles."""
    if not all(np.array_equal(x, np.rint(x)) for x in (vectors, queries)):
        return np.float64
    largest = [int(np.abs(x).max(initial=0.0)) for x in (vectors, queries)]
    most = largest[0] * max(largest) * vectors.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


class SortedLists:
    """For each dimension the rows of a matrix in descending order of their value there."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray):
        self.ids, self.kind = ids, _arithmetic(vectors, queries)
        self.order = np.argsort(-vectors, axis=0, kind="stable").T.astype(np.int32).copy()
        self.vectors = vectors = self.exact(vectors)
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)

    def exact(self, numbers: np.ndarray) -> np.ndarray:
        if self.kind is object:  # beyond what doubles add up exactly: integers of any size
            return np.array([int(x) for x in numbers.ravel().tolist()] + [None], dtype=object)[:-1].reshape(numbers.shape)
        return numbers.astype(self.kind)

    def search(self, query: np.ndarray, own: int, top: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the `top` best rows but `own`, ties to the smaller id.

        Rounds read the lists from the end that the query's sign favours, deeper by a doubling step each,
        and score every row that they meet. What no list has shown yet scores at most the
        sum of the query's weights times the values read last; the search ends when every row is met, or this bound is below the
        top-th score (equal scores could still win by their id).
        """
        n, use = len(self.ids), np.flatnonzero(query)
        if not len(use):
            rows = np.argsort(self.ids, kind="stable")
            rows = rows[self.ids[rows] != own][:top]
            return rows, np.zeros(len(rows))
        up, down = use[query[use] > 0], use[query[use] < 0]
        seen = np.zeros(n, dtype=bool)
        rows, scores, at, met = np.zeros(0, np.int64), np.zeros(0, object if self.kind is object else np.float64), 0, 0
        query = self.exact(query)
        while at < n and met < n:
            to, before = min(n, at + depth), seen.copy()
            seen[self.order[up, at:to]] = True
            seen[self.order[down, n - to : n - at]] = True
            fresh = np.flatnonzero(seen & ~before)
            met += len(fresh)
            # of most rows the scores come without a copy of their vectors
            found = self.vectors[fresh] @ query if 4 * len(fresh) < n else (self.vectors @ query)[fresh]
            other = self.ids[fresh] != own
            rows, scores = np.append(rows, fresh[other]), np.append(scores, found[other])
            if len(rows) > top:
                kth = np.sort(scores)[-top] if self.kind is object else np.partition(scores, len(scores) - top)[len(scores) - top]
                keep = scores >= kth
                rows, scores = rows[keep], scores[keep]
                if query[up] @ self.values[up, to - 1] + query[down] @ self.values[down, n - to] < kth:
                    break
            at, depth = to, 2 * depth
        best = np.lexsort((self.ids[rows], -scores))[:top]
        return rows[best], scores[best]


def _blocked(vectors: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    blocks = max(1, -(-vectors.count() // rows))
    return vectors.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), blocks


def exact_top(vectors: DataFrame, queries: DataFrame, top: int = TOP, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the `top` rows of vectors (vec_id, v array<double>) of the highest inner product.

    A row is no candidate of the query with its vec_id; ties go to the smaller vec_id, fewer rows come
    back if there are fewer. Of queries that share a vec_id the smallest vector asks. Rows whose id or vector is null, or holds a null or a value that is not finite, take no part, nor do
    vectors of another length than most candidates have (of equally many, the shorter). Rows that share a vec_id are candidates each. Products of
    whole numbers are exact whatever their size; score is a double, and whole the number itself as long, which ends at the ends of that range (null where
    it isn't whole). Ranks follow score, then whole. An empty table gives no rows; other
    columns, whatever their names, are left aside. Blocks of candidates meet blocks of queries; each pair keeps `top` rows a query, and their ranks are
    merged. A task holds one block of candidates with its lists and one block of queries.
    """

    def clean(df: DataFrame) -> DataFrame:
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite).select(F.col("vec_id").cast("long"), "v")

    vectors, queries = clean(vectors), clean(queries)
    common = vectors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    width = common.width if common else 0
    vectors, candidates = _blocked(vectors.where(F.size("v") == width), candidate_block, "cb")
    queries, asked = _blocked(queries.where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v")), query_block, "qb")
    left = vectors.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
    right = queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))

    # a task for each pair of blocks, as long as they are not very many; both sides are dealt alike
    tasks = min(candidates * asked, MOST_TASKS)
    left, right = left.repartition(tasks, "cb", "qb"), right.repartition(tasks, "cb", "qb")

    def run(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(ask):
            own = own.sort_values("vec_id", kind="stable")
            matrix = lambda df: np.stack(df["v"].to_numpy()) if width else np.zeros((len(df), 0))
            asking = matrix(ask)
            lists = SortedLists(matrix(own), own["vec_id"].to_numpy(), asking)
            for q, v in zip(ask["vec_id"].to_numpy(), asking, strict=True):
                rows, scores = lists.search(v, q, top)
                # the double puts scores in order up to what it can tell apart, the long tells whole ones apart beyond 2**53
                whole = [max(-(2**63), min(2**63 - 1, int(s))) for s in scores.tolist()] if lists.kind is object else np.where(scores == np.rint(scores), np.clip(scores, -(2.0**53), 2.0**53), np.nan)
                out.append(pd.DataFrame({"query_id": q, "vec_id": lists.ids[rows], "score": scores.astype(np.float64), "whole": pd.array(whole, dtype="Int64")}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "whole": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "whole": "Int64"})

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(run, "query_id long, vec_id long, score double, whole long")
    # ranks are limited before the rows move, so a query's task gets `top` rows from each task before it
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("whole"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score", "whole")


def scaled(embeddings: DataFrame, factor: float = 64.0) -> DataFrame:
    """vec_id, v: each component x as floor(factor * x), x taken as double; null and non-finite components stay what they are."""

    def whole(x):
        y = x.cast("double") * factor
        # doubles of 2**53 and more are whole, and beyond 2**63 the floor has no long
        return F.when(F.isnan(y) | (F.abs(y) == float("inf")), F.lit(float("nan"))).when(F.abs(y) >= float(2**53), y).otherwise(F.floor(F.when(F.abs(y) < float(2**53), y)).cast("double"))

    return embeddings.select("vec_id", F.transform("embedding", whole).alias("v"))
