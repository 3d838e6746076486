"""Class balancing and splits by cut points against full ranks."""

import pytest
from pyspark.sql import functions as F

from threadmill.functions import hashing as H
from threadmill.functions.ranking import hash_rank, nth_keys
from threadmill.operators import labels as L


def rows(spark, n, classes=3):
    df = spark.range(n).select(F.col("id"), (F.col("id") * F.col("id") % classes).cast("int").alias("claim"))
    return df.withColumn("text", F.concat(F.lit("some text "), "id"))


def test_nth_keys_are_the_keys_at_those_ranks(spark):
    d = rows(spark, 700).withColumn("o", H.shuffle_key("id", seed=5))
    got = nth_keys(d, "o", [F.lit(1), F.lit(17), F.lit(0), F.lit(701)], ["claim"], ["id"], bucket_digits=1).collect()
    ranked = hash_rank(d, "o", ["claim"], "r", ["id"]).where("r in (1, 17)").collect()
    assert sorted((r["claim"], (1, 17)[r["nth"]], r["key"]["id"]) for r in got) == sorted((r["claim"], r["r"], r["id"]) for r in ranked)


@pytest.mark.parametrize("n", [0, 1, 2, 15, 500])
def test_balance_equals_ranks(spark, n):
    d = rows(spark, n)
    got = L.balance_classes(d, key_cols=["id"], seed=3, unique_keys=True)
    assert got.columns == d.columns
    ranked = L.shuffle(d, ["id"], seed="balance:3", rank_col="r", partition_cols=["claim"])
    sizes = [r["count"] for r in d.groupBy("claim").count().collect()]
    want = ranked.where(F.col("r") <= min(sizes, default=0)).select(*d.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("n", [0, 1, 2, 10, 333])
def test_split_equals_ranks(spark, n):
    d = rows(spark, n)
    with_rank = L.ordered_split(d, ["id"], seed=9)
    without = L.ordered_split(d, ["id"], seed=9, rank_col=None)
    assert without.columns == [*d.columns, "split"]
    assert sorted(map(tuple, without.collect())) == sorted(map(tuple, with_rank.drop("rank").collect()))


def test_texts_are_not_shuffled(spark, tmp_path):
    rows(spark, 200).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    for out in (L.balance_classes(d, key_cols=["id"], unique_keys=True), L.ordered_split(d, ["id"], rank_col=None)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        below = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
        assert below and "text" in plan
        assert not any("text" in line for line in below)
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert sum("text:string" in line for line in scans) == 1
