"""Operator 8: exact top-k inner products by distributed histogram selection.

Each component x becomes floor(256 x). Every pass scores all rows against a
block of queries. A score falls into one of ``BINS`` bins of the query's current
range; the counts of all tasks are added up, and the bin that holds the k-th
highest score becomes the next range, until a bin is one score wide: that score
is the query's k-th value. A last pass keeps the scores from the k-th value on
and breaks ties by the smaller id. A task counts only bins that its own k
highest scores reach, and keeps at most k rows a query, since nothing else can
matter; so a vector that a third of all rows share costs no more than another.

The stated queries come in blocks of ``QUERY_BLOCK`` vectors, which bounds what
is broadcast; each block meets all rows. A query's candidates are all rows
of the same length but its own.

Scores are exact: products that might not fit in 64 bits are taken with whole numbers of any size.

Defined results: null vectors, empty vectors, vectors with a null or non-finite
component and rows with a null id take no part. A score beyond the range of a long counts as the
nearest long. Rows are told apart as rows: of several rows of one id each is a candidate, and each is a
query if its id is one, with all other rows as candidates. A query without candidates has no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import cut

BINS = 256
QUERY_BLOCK = 4096
ROWS = 1024
LOW, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Scores beyond this are one bin end of the histograms.
EDGE = (1 << 62) - 2


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def matrices(batch: pa.RecordBatch, vector: str = "v"):
    """(rows, matrix of whole numbers as doubles) for each length of vectors in the batch."""
    column = batch.column(vector)
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = np.nan_to_num(np.floor(column.values.to_numpy(zero_copy_only=False)))
    lens = np.diff(offsets)
    for d in np.unique(lens):
        rows = np.flatnonzero(lens == d)
        yield int(d), rows, flat[offsets[rows][:, None] + np.arange(d)]


def scaled(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, row (a number of its own) and v (the components times 256, not yet floored)."""
    vector = F.col(vector_col)
    v = F.transform(vector, lambda x: x.cast("double") * 256.0)
    read = rows.select(F.col(id_col).alias("vec_id"), F.when(usable(vector), v).alias("v"))
    return read.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).withColumn("row", F.monotonically_increasing_id())


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exact, as longs."""
    d = q.shape[1]
    q_most, r_most = np.abs(q).max(axis=1, initial=0), np.abs(rows).max(axis=1, initial=0)
    if q_most.max(initial=0) * r_most.max(initial=0) * d < 2.0**53:
        return (q @ rows.T).astype(np.int64)
    far = (2.0**62 / d) ** 0.5  # below it on both sides a sum stays below 2^62
    q_far, r_far = q_most >= far, r_most >= far
    out = np.where(q_far[:, None], 0, q).astype(np.int64) @ np.where(r_far[:, None], 0, rows).astype(np.int64).T

    def whole(a: np.ndarray) -> np.ndarray:
        return np.array([[int(x) for x in r] for r in a], object).reshape(a.shape)

    def fit(a: np.ndarray) -> np.ndarray:
        return np.minimum(np.maximum(a, -MOST), MOST).astype(np.int64)

    if q_far.any():
        out[q_far] = fit(whole(q[q_far]) @ whole(rows).T)
    if r_far.any():
        out[:, r_far] = fit(whole(q) @ whole(rows[r_far]).T)
    return out


class Queries:
    """A block of queries: rows, ids and vectors by length, with places in the block."""

    def __init__(self, rows: list[int], ids: list[int], vectors: list[list[float]]):
        self.plain = (rows, ids, vectors)
        self.rows, self.ids, self.by = np.array(rows, np.int64), np.array(ids, np.int64), {}
        for i, v in enumerate(vectors):
            self.by.setdefault(len(v), []).append(i)
        self.by = {d: (np.array(at), np.nan_to_num(np.floor(np.array([vectors[i] for i in at], np.float64)))) for d, at in self.by.items()}

    def scores(self, batch: pa.RecordBatch):
        """(places of queries, ids of rows, scores as queries x rows, own row marked) in blocks."""
        ids, numbers = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
        for d, rows, matrix in matrices(batch):
            if d not in self.by:
                continue
            places, q = self.by[d]
            for k in range(0, len(rows), ROWS):
                part = rows[k : k + ROWS]
                yield places, ids[part], products(q, matrix[k : k + ROWS]), self.rows[places][:, None] == numbers[part][None, :]


def _histogram(vectors: DataFrame, block, low: np.ndarray, high: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """q (place of the query), bin and n: counts of the scores in each query's range from low to high, in bins of the given width."""
    held = vectors.sparkSession.sparkContext.broadcast((block.plain, low, high, width))

    def run(batches):
        plain, low, high, width = held.value
        queries = Queries(*plain)
        counts = np.zeros((len(queries.ids), BINS), np.int64)
        for batch in batches:
            for places, _, s, own in queries.scores(batch):
                s = np.where(own, LOW, np.clip(s, -EDGE, EDGE))
                s = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, -k:]  # lower ones of these rows decide nothing
                b = (np.where(s == LOW, low[places][:, None] - 1, s) - low[places][:, None]) // width[places][:, None]
                q, j = np.nonzero((b >= 0) & (s < high[places][:, None]))
                np.add.at(counts, (places[q], b[q, j]), 1)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # scores in the higher bins
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "bin": pa.array(b, pa.int64()), "n": pa.array(counts[q, b], pa.int64())})

    return vectors.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth(vectors: DataFrame, block: Queries, bound: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th highest score; the least long if it has fewer candidates."""
    n = len(block.ids)
    low, high = -bound - 1, bound + 1
    width = np.maximum(1, -(-(high - low) // BINS))
    above, short = np.zeros(n, np.int64), np.zeros(n, bool)
    order = Window.partitionBy("q").orderBy(F.desc("bin"))
    while True:
        counts = _histogram(vectors, block, low, high, width, k).withColumn("upto", F.sum("n").over(order))
        need = vectors.sparkSession.createDataFrame([(int(i), int(k - above[i])) for i in range(n)], "q long, need long")
        hit = counts.join(need, "q").where("upto >= need and upto - n < need").select("q", "bin", (F.col("upto") - F.col("n")).alias("over")).collect()
        found = {r["q"]: (r["bin"], r["over"]) for r in hit}  # one row a query of the block
        for i in range(n):
            if i in found:
                low[i] += found[i][0] * width[i]
                high[i] = min(high[i], low[i] + width[i])
                above[i] += found[i][1]
            else:
                short[i], high[i] = True, low[i]  # all its candidates count: nothing to look for
        if (width[~short] == 1).all():
            return np.where(short | (low <= -EDGE), LOW, low)
        width = np.maximum(1, -(-width // BINS))


def _best(vectors: DataFrame, block: Queries, least: np.ndarray, k: int) -> DataFrame:
    """query (its row), query_id, vec_id and score of the scores from the k-th value on, at most k a task and query."""
    held = vectors.sparkSession.sparkContext.broadcast((block.plain, least))

    def run(batches):
        plain, least = held.value
        queries = Queries(*plain)
        best_q, best_v, best_s = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for places, ids, s, own in queries.scores(batch):
                q, j = np.nonzero((s >= least[places][:, None]) & ~own)
                best_q, best_v, best_s = (np.concatenate(x) for x in ((best_q, places[q]), (best_v, ids[j]), (best_s, s[q, j])))
                if len(best_q):
                    order = np.lexsort((best_v, -best_s, best_q))
                    best_q, best_v, best_s = best_q[order], best_v[order], best_s[order]
                    first = np.searchsorted(best_q, best_q)
                    kept = np.arange(len(best_q)) - first < k
                    best_q, best_v, best_s = best_q[kept], best_v[kept], best_s[kept]
        yield pa.RecordBatch.from_pydict({"query": pa.array(queries.rows[best_q], pa.int64()), "query_id": pa.array(queries.ids[best_q], pa.int64()), "vec_id": pa.array(best_v, pa.int64()), "score": pa.array(best_s, pa.int64())})

    return vectors.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def query_blocks(queries: DataFrame, block: int):
    """The queries (vec_id, row, ...) in ascending order of id and row, ``block`` rows at a time."""
    rest = queries
    while True:
        rows = rest.orderBy("vec_id", "row").limit(block).collect()  # at most a block
        if not rows:
            return
        yield rows
        if len(rows) < block:
            return
        last = rows[-1]
        rest = queries.where((F.col("vec_id") > last["vec_id"]) | ((F.col("vec_id") == last["vec_id"]) & (F.col("row") > last["row"])))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``is_query`` is a condition on column vec_id."""
    vectors = cut(scaled(rows, id_col, vector_col))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1.0) * (F.abs(x) + 1.0))
    reach = vectors.agg(F.max(norm).alias("m")).first()["m"] or 0.0
    out = None
    for block in query_blocks(vectors.where(is_query), query_block):
        queries = Queries([r["row"] for r in block], [r["vec_id"] for r in block], [r["v"] for r in block])
        # no score is larger than the product of the norms
        norms = [sum((abs(x) + 1.0) ** 2 if abs(x) < 1e150 else float("inf") for x in r["v"]) for r in block]
        bound = np.array([int(min(np.ceil(np.sqrt(n) * np.sqrt(reach) * (1 + 1e-9)) + 1, EDGE)) for n in norms], np.int64)
        part = _best(vectors, queries, _kth(vectors, queries, bound, k), k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
