"""Approximate nearest neighbours by collision counting.

Every vector is projected on ``PROJECTIONS`` random lines, and each line's projections are kept as one
sorted array. A search starts with a narrow window around the query on every line and widens all
windows together, by a constant factor a round (virtual rehashing: no array is built anew); a vector
that falls into the windows of at least ``COLLISIONS`` lines is verified by its distance. The search
ends when as many verified vectors as asked for lie within the distance that the windows' width
stands for, or when the windows hold everything, which makes the rest of a search exact; there is no
cap on candidates.

Vectors are dealt into shards of bounded size, each with arrays of its own; queries, in blocks of
bounded size, meet every shard, and the shards' nearest are merged. Where vectors are spread evenly
over the directions of a high dimension, the nearest are hardly nearer than the rest, and windows wide
enough for them hold a fixed share of every shard: then the work is that of queries times rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PROJECTIONS, COLLISIONS = 96, 70
WIDTH = 2.4  # of a window, in units of the distance it stands for
GROWTH = 1.15  # of the windows from one round to the next
SLACK = 1.0  # of the distance within which verified vectors end the search
PROBE = 256  # vectors that the first window is judged by
SHARD_ROWS, QUERY_ROWS = 16_384, 16_384
TOGETHER, ROUNDS = 64, 4  # queries and rounds whose window ends are looked up at once
_KIND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    """Neither null nor zero, every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """The sorted projections of a shard."""

    def __init__(self, vectors: np.ndarray, seed: int = 11, ids: np.ndarray | None = None):
        self.vectors = vectors
        # numbers of the ids, where vectors share some
        self.of = None
        if ids is not None and len(own := np.unique(ids)) < len(ids):
            self.of = np.searchsorted(own, ids)
        lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        self.lines = lines
        with np.errstate(all="ignore"):
            projected = vectors @ lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)

    def search(self, queries: np.ndarray, k: int, skip) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of every query positions and distances of what was found, the k nearest (of different ids) among
        it; ``skip(i)`` marks vectors that are no candidates of query i. Window ends are looked up for
        many queries and ROUNDS rounds at once."""
        for a in range(0, len(queries), TOGETHER):
            part = queries[a: a + TOGETHER]
            at = part @ self.lines
            first = np.array([self._first(q, k) for q in part])
            searches = [self._search(q, k, skip(a + i)) for i, q in enumerate(part)]
            out: list = [None] * len(part)
            todo, level = np.arange(len(part)), 0
            for s in searches:
                next(s)
            while len(todo):
                radius = first[todo, None] * GROWTH ** np.arange(level, level + ROUNDS)
                ends = np.empty((2, len(todo), ROUNDS, PROJECTIONS), np.int64)
                for j in range(PROJECTIONS):
                    half = radius * WIDTH / 2
                    ends[0, :, :, j] = np.searchsorted(self.sorted[j], at[todo, j, None] - half, "left")
                    ends[1, :, :, j] = np.searchsorted(self.sorted[j], at[todo, j, None] + half, "right")
                for i, q in enumerate(todo):
                    for r in range(ROUNDS):
                        if out[q] is None:
                            out[q] = searches[q].send((radius[i, r], ends[0, i, r], ends[1, i, r]))
                todo, level = np.array([q for q in todo if out[q] is None], np.int64), level + ROUNDS
            yield from out

    def _search(self, query: np.ndarray, k: int, skip: np.ndarray):
        """One search, fed with the windows (radius, low ends, high ends) of each round; it answers None
        until it ends."""
        n = len(self.vectors)
        count = np.zeros(n, np.int64)
        known = skip.copy()
        lo = hi = None
        found, distance, answer = np.zeros(0, np.int64), np.zeros(0), None
        while True:
            radius, low, high = yield answer
            if lo is None:
                fresh = [self.order[j, low[j]: high[j]] for j in range(PROJECTIONS)]
            else:
                low, high = np.minimum(low, lo), np.maximum(high, hi)
                fresh = [self.order[j, low[j]: lo[j]] for j in range(PROJECTIONS)] + [self.order[j, hi[j]: high[j]] for j in range(PROJECTIONS)]
            lo, hi = low, high
            whole = bool((hi - lo == n).all())
            count += np.bincount(np.concatenate(fresh), minlength=n)
            hits = np.flatnonzero(~known if whole else (count >= COLLISIONS) & ~known)
            known[hits] = True
            found = np.concatenate([found, hits])
            distance = np.concatenate([distance, np.sqrt(((self.vectors[hits] - query) ** 2).sum(1))])
            near = distance
            if self.of is not None:
                own, which = np.unique(self.of[found], return_inverse=True)
                near = np.full(len(own), np.inf)
                np.minimum.at(near, which, distance)
            if whole or (len(near) >= k and np.partition(near, k - 1)[k - 1] <= SLACK * radius):
                answer = found, distance

    def _first(self, query: np.ndarray, k: int) -> float:
        """Where widening begins: half the distance of the k-th nearest of a few spread vectors."""
        few = self.vectors[:: max(1, len(self.vectors) // PROBE)]
        distance = np.sqrt(((few - query) ** 2).sum(1))
        top = float(np.partition(distance, min(k, len(distance)) - 1)[: min(k, len(distance))].max())
        return max(top / 2, 1e-300)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _once(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of different ids and vectors: the same again is one candidate."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    order = np.lexsort([*x.T[::-1], ids])
    new = (ids[order][1:] != ids[order][:-1]) | (x[order][1:] != x[order][:-1]).any(1)
    return order[np.concatenate([[True], new])]


def _searcher(k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _KIND.empty_table()
        ids, x = vectors["id"].to_numpy(), _matrix(vectors["v"])
        once = _once(ids, x)
        ids, x = ids[once], x[once]
        q_ids, q = queries["id"].to_numpy(), _matrix(queries["v"])
        out_q, out_v, out_s = [], [], []
        for i, (at, distance) in zip(q_ids, Index(x, ids=ids).search(q, k, lambda i: ids == q_ids[i]), strict=True):
            best = np.lexsort([ids[at], distance])
            # of each id the nearest vector
            best = best[np.sort(np.unique(ids[at[best]], return_index=True)[1])[:k]]
            out_q += [i] * len(best)
            out_v += ids[at[best]].tolist()
            out_s += distance[best].tolist()
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], schema=_KIND)

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest found of every row of ``queries``: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller id. Candidates are all rows but those of the query's id. Null ids, and vectors that are
    null, zero or hold null or non-finite components, take no part; vectors of another length than the
    query's are no candidates. Rows of one id are one candidate, at its nearest vector, and lie in any
    shards; of a query id with several vectors the first in order of components asks. Fewer candidates
    than k are all returned; empty tables give an empty result.
    """
    def rows(df: DataFrame) -> DataFrame:
        good = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return good.where(F.col("id").isNotNull() & usable(F.col("v")))

    all_, asked = rows(vectors), materialize(rows(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    shards = max(1, -(-all_.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # dealt by row, so that neither a hot id nor a hot vector fills a shard
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    left = all_.withColumn("shard", dealt).withColumn("block", number(blocks)).withColumn("dim", F.size("v"))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", number(shards)).withColumn("dim", F.size("v"))
    by = ["dim", "shard", "block"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_searcher(k), "query_id long, vec_id long, score double")
    # one exchange serves the shards' merge and the ranks
    merged = near.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
