"""Operator 10: approximate nearest neighbours by stable projections.

Every row is projected to ``dims`` directions with normal components (2-stable:
a pair's projected squared distance over its squared distance follows a
chi-square law with ``dims`` degrees of freedom). The projections of each shard of about ``shard_rows``
rows are indexed by a kd-tree with the bounding boxes of its nodes. A query meets rows in the order of their
projected distance, boxes standing for what is in them, and verifies each with the original vectors, until the chi-square test holds: a row
as near as the k-th found one would have been met with probability ``sure`` or more. Rows on the test's bound are
still verified, so that equal vectors are ranked by their ids. A query searches its own shard first; the k-th distance found there
is a bound for all other shards. The best of all shards are then ranked.

The index holds every row that can be a result: of a shard's equal vectors, those of the k + 1 smallest ids (one may be
the query's own); nothing is sampled or capped. The stated queries come
in blocks of ``QUERY_BLOCK``, which bounds what is broadcast. Distances are
computed in double precision from the original components.

Defined results: vectors that are null, empty, all zero or hold a null or
non-finite component, and rows with a null id take no part. Rows are told apart as rows: of several rows of one id each is a
candidate, and each is a query if its id is one, with all other rows as candidates. Queries meet vectors of their own length only. A query without
candidates has no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import cut, work_parts
from threadmill.llm.topk import query_blocks, usable

DIMS, SURE, SHARD_ROWS, LEAF = 24, 0.93, 8192, 64
#: Rows verified between two looks at the test, and leaves opened at once.
STEP, LEAVES = 32, 16
QUERY_BLOCK = 4096


def directions(length: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, dims))


def chi_square(x: float, dims: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half = x / 2
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def chi_square_point(p: float, dims: int) -> float:
    """Where the distribution function reaches p."""
    low, high = 0.0, 1.0
    while chi_square(high, dims) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


class KdTree:
    """Balanced tree over points; node i has the children 2 i + 1 and 2 i + 2 and the rows order[first : last]."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        depth = max(0, math.ceil(math.log2(max(1, n / LEAF))))
        self.leaves = (1 << depth) - 1  # number of the first leaf
        size = (1 << (depth + 1)) - 1
        self.order, self.first, self.last = np.arange(n), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.low, self.high = np.full((size, points.shape[1]), np.inf), np.full((size, points.shape[1]), -np.inf)
        self.last[0] = n
        for i in range(size):
            a, b = self.first[i], self.last[i]
            if a == b:
                continue
            own = points[self.order[a:b]]
            self.low[i], self.high[i] = own.min(axis=0), own.max(axis=0)
            if i < self.leaves:
                mid = (a + b) // 2
                wide = int((self.high[i] - self.low[i]).argmax())
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], mid - a)]
                self.first[2 * i + 1], self.last[2 * i + 1], self.first[2 * i + 2], self.last[2 * i + 2] = a, mid, mid, b

    def nearest_leaves(self, point: np.ndarray, together: int = 1):
        """(squared distance of the box, rows) of the leaves, nearest first, some together."""
        leaves = self.leaves + np.flatnonzero(self.first[self.leaves :] < self.last[self.leaves :])
        gaps = np.maximum(np.maximum(self.low[leaves] - point, point - self.high[leaves]), 0)
        gaps = (gaps * gaps).sum(axis=1)
        order = np.argsort(gaps, kind="stable")
        for at in range(0, len(order), together):
            part = leaves[order[at : at + together]]
            yield float(gaps[order[at]]), np.concatenate([self.order[self.first[i] : self.last[i]] for i in part])


def first_copies(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows whose vector fewer than ``most`` rows with smaller ids share, in the given order."""
    plain = np.ascontiguousarray(vectors + 0.0)  # one sign of zero
    _, same = np.unique(plain.view(np.dtype((np.void, plain.itemsize * plain.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(starts, append=len(ids)))
    return np.sort(order[place < most])


def rounding(query: np.ndarray, wide: np.ndarray) -> float:
    """How far the projections of two equal vectors may lie apart when their sums are taken in different orders."""
    return float(np.linalg.norm(2 * len(query) * np.finfo(np.float64).eps * (np.abs(query) @ np.abs(wide))))


def search(
    ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, tree: KdTree, own: int, query: np.ndarray, image: np.ndarray, k: int, point: float,
    slack: float = 0.0, bound: float = math.inf,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and distances of the k nearest found in one shard, and the number of rows verified. ``own``: place of the
    query's own row, or -1; ``slack``: rounding of the projections; ``bound``: a k-th distance known already."""
    best_id, best, verified = np.zeros(0, np.int64), np.zeros(0), 0
    waiting, gaps = np.zeros(0, np.int64), np.zeros(0)

    def limit() -> float:
        return math.sqrt(point) * (min(bound, best[-1]) if len(best) == k else bound) + slack

    for far, rows in chain(tree.nearest_leaves(image, LEAVES), [(math.inf, waiting)]):
        far = math.sqrt(far)
        ready = np.flatnonzero(gaps <= far)  # nearer than all that lies in the boxes to come
        ready = ready[np.argsort(gaps[ready], kind="stable")]
        for at in range(0, len(ready), STEP):
            part = ready[at : at + STEP]
            part = part[gaps[part] <= limit()]
            if not len(part):
                return best_id, best, verified
            verified += len(part)
            part = waiting[part]
            d = np.sqrt(((vectors[part] - query) ** 2).sum(axis=1))
            best_id, best = np.concatenate([best_id, ids[part]]), np.concatenate([best, d])
            kept = np.lexsort((best_id, best))[:k]
            best_id, best = best_id[kept], best[kept]
        if far > limit():
            break
        left = gaps > far
        rows = rows[rows != own]
        waiting = np.concatenate([waiting[left], rows])
        gaps = np.concatenate([gaps[left], np.sqrt(((projected[rows] - image) ** 2).sum(axis=1))])
    return best_id, best, verified


def index(rows: DataFrame, id_col: str, vector_col: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """length, shard, row, vec_id, v: every usable row in its shard."""
    vector = F.col(vector_col)
    v = F.transform(vector, lambda x: x.cast("double"))
    read = rows.select(F.col(id_col).alias("vec_id"), F.when(usable(vector), v).alias("v"))
    read = read.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0.0))
    read = cut(read.withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-read.count() // shard_rows))
    return read.select(F.size("v").alias("length"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "vec_id", "v")


def _searcher(held, k: int, dims: int, seed: int, point: float, own_shard: bool):
    """The search of one shard for the broadcast queries: those of the shard, or all others with their bounds."""

    def run(key, table):
        length, shard = key[0].as_py(), key[1].as_py()
        queries = [q for q in held.value if len(q[2]) == length and (q[3] == shard) == own_shard]
        found, scores, verified = [], [], []
        if queries:
            wide = directions(length, dims, seed)
            ids, numbers = (table.column(c).to_numpy() for c in ("vec_id", "row"))
            vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, length)
            kept = first_copies(ids, vectors, k + 1)
            ids, numbers, vectors = ids[kept], numbers[kept], vectors[kept]
            projected = vectors @ wide
            tree = KdTree(projected)
            for row, _, query, _, bound in queries:
                own = np.flatnonzero(numbers == row)
                a, b, n = search(ids, vectors, projected, tree, int(own[0]) if len(own) else -1, query, query @ wide, k, point, rounding(query, wide), bound)
                found.append(a)
                scores.append(b)
                verified.append(n)
        sizes = [len(a) for a in found]
        return pa.table({
            "query": pa.array(np.repeat([q[0] for q in queries], sizes).astype(np.int64)), "query_id": pa.array(np.repeat([q[1] for q in queries], sizes).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([np.zeros(0, np.int64), *found])), "score": pa.array(np.concatenate([np.zeros(0), *scores])),
            "verified": pa.array(np.repeat(verified, sizes).astype(np.int64)),
        })

    return run


def nearest(
    rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    dims: int = DIMS, sure: float = SURE, seed: int = 7, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (distance), verified (rows that the
    result's shard verified). ``dims`` is even; ``is_query`` is a condition on column vec_id."""
    if dims % 2:
        raise ValueError("dims must be even")
    indexed = cut(index(rows, id_col, vector_col, shard_rows))
    point = chi_square_point(sure, dims)
    spark, out = rows.sparkSession, None
    schema = "query long, query_id long, vec_id long, score double, verified long"

    def part(queries: list[tuple], own_shard: bool) -> DataFrame:
        held = spark.sparkContext.broadcast(queries)
        # few bytes and much work: a task for each shard
        dealt = indexed.repartition(max(work_parts(spark), shards), "length", "shard")
        return dealt.groupBy("length", "shard").applyInArrow(_searcher(held, k, dims, seed, point, own_shard), schema)

    shards = indexed.select("shard").distinct().count()
    for block in query_blocks(indexed.where(is_query), query_block):
        queries = [(r["row"], r["vec_id"], np.array(r["v"]), r["shard"], math.inf) for r in block]
        found = part(queries, True)
        if shards > 1:
            found = cut(found)
            kth = found.groupBy("query").agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
            bounds = {r["query"]: r["far"] for r in kth.collect()}  # one row a query of the block
            found = found.unionByName(part([(*q[:4], bounds.get(q[0], math.inf)) for q in queries], False))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
