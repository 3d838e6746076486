"""Votes for masked tokens against a plain sum over all partners."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadmill.operators import model as M


@pytest.mark.parametrize("tiling", [{}, {"slice_pairs": 50, "task_votes": 300}])
def test_every_partner_votes(spark, tiling):
    rnd = random.Random(4)
    corpus = [[2, *(5 + int(60 * rnd.random() ** 3) for _ in range(rnd.randint(2, 14))), 3] for _ in range(120)]
    freq = Counter(i for x in corpus for i in x if i > 4)
    logp = {i: math.log(n) for i, n in freq.items() if i % 7}  # some candidates have no frequency
    pairs = Counter()
    for x in corpus:
        for i, a in enumerate(x):
            for b in x[i + 1 : i + 3]:
                if a > 4 and b > 4:
                    pairs[a, b] += 1
                    pairs[b, a] += 1
    samples = [(k, f"d{k % 3}", x, len(x), sorted(rnd.sample(range(1, len(x) - 1), min(2, len(x) - 2)))) for k, x in enumerate(corpus)]
    due = {}
    most = 2
    fill = sorted(logp, key=lambda i: (-logp[i], i))[:most]
    for k, d, x, n, pos in samples:
        votes = Counter({i: 0 for i in fill})
        for p in pos:
            for q in (p - 2, p - 1, p + 1, p + 2):
                if 0 <= q < n and q not in pos and x[q] > 4:
                    votes.update({b: c for (a, b), c in pairs.items() if a == x[q]})
        k_targets = len({x[p] for p in pos})
        due[k, d] = sorted(votes, key=lambda i: (-votes[i], -logp.get(i, -math.inf), i))[:k_targets]
    df = spark.createDataFrame(samples, "k long, d string, x array<int>, length int, positions array<int>")
    df = df.withColumn("targets", F.array_distinct(F.transform("positions", lambda p: F.get("x", p))))
    assoc = M.associations(spark.createDataFrame([(x, len(x)) for x in corpus], "x array<int>, length int"))
    assert {(r["v"], r["t"]): r["n"] for r in assoc.collect()} == pairs
    rows = M.masked_predictor(df, assoc, spark.createDataFrame(list(logp.items()), "id int, logp double"), ["k", "d"], **tiling).collect()
    assert {(r["k"], r["d"]): r["predicted"] for r in rows} == due
