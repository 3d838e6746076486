"""Approximate neighbours: recall against brute force, exact distances, the index."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from threadmill.llm import ann, queries


def plain(rows, k, every):
    used = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (q, v) in enumerate(used):
        if q % every == 0:
            near = sorted((math.dist(v, w), i) for m, (i, w) in enumerate(used) if m != n and len(w) == len(v))
            out[q] = near[:k]
    return out


def recall(got, want):
    found = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & {i for _, i in near}) for q, near in want.items())
    return found / max(1, sum(map(len, want.values())))


def test_query_recall_and_scores(spark):
    data = SMALL.replace("0.001", "0.1")
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = queries.op10_ann(spark, data).collect()
    want = plain(rows, 10, 100)
    assert recall(got, want) >= 0.9
    # the test stops the search: less than 60 % of the rows are verified
    assert sum({r["query_id"]: r["verified"] for r in got}.values()) < 0.6 * len(want) * len(rows)
    vectors = dict(rows)
    for q, near in want.items():
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(near) + 1))
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        assert all(r["score"] == pytest.approx(math.dist(vectors[q], vectors[r["vec_id"]]), rel=1e-12) for r in own)


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    data = (centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=500, query_block=7).collect()
    assert recall(got, plain(rows, 10, 100)) >= 0.9


def test_chi_square_test_spares_work():
    """On clustered points the search stops before it has verified all rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32)) * 4
    data = centres[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 32))
    image = data @ ann.directions(32, 8, 7)
    tree, ids, point = ann.KdTree(image), np.arange(6000), ann.chi_square_point(0.99, 8)
    seen = [ann.search(ids, data, image, tree, q, data[q], image[q], 10, point)[2] for q in range(20)]
    assert sum(seen) < 20 * 600
    # a bound from another shard spares the rest
    assert ann.search(ids, data, image, tree, -1, data[0] + 50, (data[0] + 50) @ ann.directions(32, 8, 7), 10, point, bound=1e-6)[2] == 0


def test_tree_gives_all_rows_nearest_box_first():
    points = np.random.default_rng(4).normal(size=(1000, 8))
    points[:300] = points[0]  # many equal points
    leaves = list(ann.KdTree(points).nearest_leaves(points[5]))
    assert sorted(i for _, rows in leaves for i in rows.tolist()) == list(range(1000))
    far = [f for f, _ in leaves]
    assert far == sorted(far)
    assert all(((points[rows] - points[5]) ** 2).sum(axis=1).min() >= f - 1e-9 for f, rows in leaves)


def test_copies_in_many_leaves_rank_by_id(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(1500, 16))
    data[rng.permutation(1500)[:600]] = data[0]  # more copies than a leaf holds
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    same = [i for i, v in rows if v == rows[0][1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (2000, 400):
        got = ann.nearest(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows).collect()
        for q in (i for i in same if i % 10 == 0):
            own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert own == [(n + 1, i, 0.0) for n, i in enumerate([i for i in same if i != q][:10])]
        assert recall(got, plain(rows, 10, 10)) >= 0.9


def test_search_passes_leaves_on_the_bound():
    data = np.random.default_rng(6).normal(size=(3000, 8))
    data[::3] = data[0]
    wide = ann.directions(8, 8, 7)
    image, ids = data @ wide, np.arange(3000)
    found, far, _ = ann.search(ids, data, image, ann.KdTree(image), 0, data[0], data[0] @ wide, 10, ann.chi_square_point(0.99, 8), ann.rounding(data[0], wide))
    assert found.tolist() == list(range(3, 33, 3)) and not far.any()


def test_first_copies():
    vectors = np.array([[1.0, 0.0], [2.0, 0.0], [1.0, -0.0], [1.0, 0.0], [2.0, 0.0]])
    assert ann.first_copies(np.array([9, 1, 3, 5, 2]), vectors, 2).tolist() == [1, 2, 3, 4]


def test_chi_square():
    # median and 99 % point of the law with 8 degrees of freedom, from tables
    assert ann.chi_square(7.344, 8) == pytest.approx(0.5, abs=1e-3)
    assert ann.chi_square_point(0.99, 8) == pytest.approx(20.09, abs=0.01)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [
        (0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.1, 0.1]), (3, None), (4, []), (5, [None, 1.0]), (6, [nan, 1.0]), (8, [0.0, 0.0]), (None, [1.0, 1.0]),
        (11, [1.0]), (12, [2.0]), (13, [-1.0, 3.0]), (14, [1.0, 2.0, 3.0]), (2, [0.2, 0.0]), (2, [0.2, 0.0]), (16, [1e20, -1e20]), (17, [0.5, -0.25]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 2 == 0, 3).collect())
    used = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    due = []
    for n, (q, v) in enumerate(used):
        near = sorted((math.dist(v, w), i) for m, (i, w) in enumerate(used) if m != n and len(w) == len(v))
        due += [(q, r + 1, i) for r, (_, i) in enumerate(near[:3]) if q % 2 == 0]
    assert got == sorted(due)  # id 2 has three rows: each is a query, and a candidate of all others
    assert ann.nearest(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0
