"""Exact top-k against brute force."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from threadmill.llm import queries, topk
from tools.check_oracle import duck, rows_of


def plain(rows, k, every):
    """rows: (vec_id, vector). Whole numbers of any size; scores beyond a long count as the nearest one."""
    used = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, most = [], 2**63 - 1
    for n, (q, v) in enumerate(used):
        if q % every == 0:
            scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, w)))), i) for m, (i, w) in enumerate(used) if m != n and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=2, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % every == 0, k, **more).collect()))


def test_query_against_sql(spark):
    df = queries.op8_exact_topk(spark, SMALL)
    cur = duck(SMALL).execute(queries.ORACLES["op8_exact_topk"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.1, 0.1]), (3, None), (4, []), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1e30, 1.0]), (None, [1.0, 1.0]),
        (10, [0.0, 0.0]), (11, [1.0]), (12, [2.0]), (13, [-1.0, 3.0]), (14, [1.0, 2.0, 3.0]), (2, [0.2, 0.0]), (2, [0.2, 0.0]), (16, [1000.0, -1000.0]),
    ]
    assert run(spark, rows) == plain(rows, 5, 2)


@pytest.mark.parametrize("query_block", [3, 4096])
def test_many_ties(spark, query_block):
    """A vector that most rows share."""
    rows = [(i, [0.25, 0.5] if i % 5 else [0.01 * i, -0.02 * i]) for i in range(400)]
    assert run(spark, rows, 7, 40, query_block=query_block) == plain(rows, 7, 40)


def test_few_candidates_and_none(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


def test_large_components_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [300000.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (3, [4.0, 0.0])]
    assert [r[2] for r in run(spark, rows, 4) if r[0] == 0] == [1, 3, 3, 2]
    assert run(spark, rows, 4) == plain(rows, 4, 2)


def test_scores_of_any_size(spark):
    import random

    rnd = random.Random(3)
    rows = [(i % 40, [rnd.choice([-1, 1]) * 2.0 ** rnd.uniform(-4, top) for _ in range(3)]) for i, top in enumerate([3, 20, 30, 60, 120] * 12)]
    rows += [(50, [1e38, -1e38, 1.0]), (52, [3e38, 3e38, 3e38]), (54, [-3e38, 1.0, 0.0])]
    rows = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]  # the column holds floats
    assert run(spark, rows, 5) == plain(rows, 5, 2)
    assert run(spark, rows, 3, query_block=4) == plain(rows, 3, 2)
