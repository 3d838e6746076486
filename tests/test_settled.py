"""Samples settled by few candidates get what the votes of all partners give them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.operators import model as M
from threadmill.plans import q_model as Q
from threadmill.plans.catalog import load_all

from .conftest import SMALL


def _made(spark):
    rnd = random.Random(11)
    corpus = [[2, *(5 + int(80 * rnd.random() ** 4) for _ in range(rnd.randint(1, 20))), 3, 0, 0] for _ in range(150)]
    rows = [(k, x, len(x) - 2, sorted(rnd.sample(range(1, len(x) - 3), min(3, len(x) - 4)))) for k, x in enumerate(corpus) if len(x) > 4]
    df = spark.createDataFrame(rows, "k long, x array<int>, length int, positions array<int>")
    return df.withColumn("targets", F.array_distinct(F.transform("positions", lambda p: F.get("x", p)))), corpus


def test_neighbours_are_counted_within_rows_and_lengths(spark):
    df, corpus = _made(spark)
    due = {}
    for x in corpus:
        real = x[:-2]
        for d in (1, 2):
            for a, b in zip(real, real[d:]):
                if a > 4 and b > 4 and len(x) > 4:
                    for v, t in ((a, b), (b, a)):
                        due[v, t] = due.get((v, t), 0) + 1
    odd = spark.createDataFrame([(-1, None, 3, []), (-2, [9], 1, []), (-3, [9, 7], None, [])], "k long, x array<int>, length int, positions array<int>")
    for held in (1, 10**6):
        got = M.associations(df.drop("targets").unionByName(odd).repartition(3), held=held).collect()
        assert {(r["v"], r["t"]): r["n"] for r in got} == due and len(got) == len(due)


@pytest.mark.parametrize("head", [2, 8, 128])
def test_settled_samples_equal_all_votes(spark, head):
    df, _ = _made(spark)
    assoc, freq = M.associations(df), M.id_log_probs(df)
    due = {r["k"]: r["predicted"] for r in M.masked_predictor(df, assoc, freq, ["k"], head=0).collect()}
    got = {r["k"]: r["predicted"] for r in M.masked_predictor(df, assoc, freq, ["k"], head=head, slice_pairs=100, task_votes=500).collect()}
    assert got == due and len(due) == df.count()


def test_large_head_settles_and_small_one_does_not(spark):
    df, _ = _made(spark)
    near = F.transform(F.col("targets"), lambda t: t)
    tie = (np.zeros(0, np.int64), np.zeros(0, np.int32))
    of = lambda head: df.select(M.settled(near, F.lit(1), M.associations(df), tie, head).alias("p")).where("p is not null").count()
    assert of(128) == df.where(F.size("targets") > 0).count() and of(0) == 0


def test_votes_are_not_counted_again_for_the_rank(spark):
    load_all()
    plan = Q.masked_eval(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "ArrowEvalPython" not in plan
