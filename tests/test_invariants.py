"""Invariants of the randomised operators and the rank helpers."""

from pyspark.sql import functions as F

from threadmill.functions import hashing as H
from threadmill.functions.ranking import hash_rank, ordered_rank
from threadmill.operators import encode as X
from threadmill.operators import labels as L
from threadmill.operators import sentences as S
from tests.conftest import SMALL


def test_hash_rank_dense_and_partitioning_free(spark):
    df = spark.range(0, 5000).withColumn("c", F.col("id") % 3).withColumn("o", H.shuffle_key("id", seed=1))
    r1 = hash_rank(df, "o", ["c"], tie_cols=["id"]).select("id", "rank")
    r2 = hash_rank(df.repartition(7), "o", ["c"], tie_cols=["id"]).select("id", "rank")
    a = {r["id"]: r["rank"] for r in r1.collect()}
    assert a == {r["id"]: r["rank"] for r in r2.collect()}
    per = df.join(r1, "id").groupBy("c").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"), F.countDistinct("rank").alias("d"))
    for r in per.collect():
        assert r["lo"] == 1 and r["hi"] == r["n"] == r["d"]


def test_ordered_rank(spark):
    df = spark.range(10, 3000, 7)
    got = [r["rank"] for r in ordered_rank(df, "id").orderBy("id").collect()]
    assert got == list(range(1, len(got) + 1))


def test_balance_and_split_sizes(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 10 < 3).cast("int").alias("claim"))
    b = L.balance_classes(df, "claim", ("id",), seed=1)
    counts = {r["claim"]: r["count"] for r in b.groupBy("claim").count().collect()}
    assert counts == {0: 300, 1: 300}
    s = L.ordered_split(b, ("id",), seed=1)
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": 480, "test": 78, "val": 42}


def test_negative_pairs_invariants(spark):
    data = [(i, [[f"d{i}s{j}w{k}" for k in range(3)] for j in range(2 + i % 3)]) for i in range(40)]
    docs = spark.createDataFrame(data, "id long, sentences array<array<string>>").withColumn("delim", F.lit("."))
    pos = S.adjacent_pairs(docs, ["id"])
    neg = S.negative_pairs(docs, pos, ["id"], seed=3)
    assert pos.count() == neg.count()
    for r in neg.collect():
        a_doc = r["A"][0].split("s")[0]
        b_doc = r["B"][0].split("s")[0]
        assert a_doc != b_doc


def test_mask_positions_counts(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(range(0, 65))], "id long, length int")
    pos = df.select("length", X.mask_positions(F.col("length"), ["id"], "s").alias("p")).collect()
    for r in pos:
        n, p = r["length"], r["p"]
        assert len(p) == int(0.15 * n)
        assert len(set(p)) == len(p)
        assert all(1 <= i <= n - 2 for i in p)


def test_mask_share(spark):
    df = spark.range(0, 4000).select("id", F.array_repeat(F.lit(7), 64).alias("x"), F.lit(64).alias("length"))
    d = df.withColumn("p", X.mask_positions(F.col("length"), ["id"], "s"))
    d = d.withColumn("m", X.mask_corrupt("x", "p", ["id"], "s", 30000))
    ex = d.select(F.explode(F.arrays_zip("x", "m")).alias("z")).where(F.col("z.m") != F.col("z.x"))
    n_mask = ex.where(F.col("z.m") == 4).count()
    total = d.select(F.sum(F.size("p"))).collect()[0][0]
    assert 0.77 < n_mask / total < 0.83


def test_views_load(spark):
    from threadmill.sources import views as V

    assert V.posts(spark, SMALL).count() > 0
    assert V.topics(spark, SMALL).count() > 0
