"""A micro-batch writes its own rows; versions of a bucket are merged when there are many, or when one is small."""

import os

from pyspark.sql import functions as F

from threadmill.operators import store as S
from threadmill.plans import q_stream as Q
from threadmill.session import scratch_path
from threadmill.streaming import collector as P
from threadmill.streaming import keyed_store as K
from tests.conftest import SMALL


def _batch(spark, ids, batch):
    return spark.createDataFrame([(i, f"{i} of {batch}", batch) for i in ids], "id long, text string, batch long")


def _merge(rows):
    return S.store_upsert(rows.limit(0), rows, "batch", ["bucket", "id"])


def _written(spark, store, version):
    return spark.read.parquet(f"{store}/data/version={version}").count()


def test_a_batch_moves_its_own_rows_only(spark):
    store = scratch_path(spark, "t-keyed")
    want = {}
    for batch, ids in enumerate((range(40), range(0, 40, 2), [1, 1, None, 50], [None, 3])):
        K.merge_batch(_batch(spark, ids, batch), batch, store, "id", _merge, buckets=2, small=0)
        want |= {i: f"{i} of {batch}" for i in ids}
        assert _written(spark, store, batch) == len(set(ids))  # not the 40 rows of the buckets that they fall in
        got = [(r["id"], r["text"]) for r in P.read_store(spark, store).collect()]
        assert len(got) == len(want) and dict(got) == want
        narrow = P.read_store(spark, store, ["text", "id"])
        assert narrow.columns == ["text", "id"] and {(r["id"], r["text"]) for r in narrow.collect()} == set(want.items())
    assert max(map(len, K.versions(spark, store).values())) > 1


def test_many_versions_are_merged(spark):
    store = scratch_path(spark, "t-keyed")
    for batch in range(5):
        K.merge_batch(_batch(spark, range(batch, 20), batch), batch, store, "id", _merge, buckets=2, runs=2, small=0)
        assert max(map(len, K.versions(spark, store).values())) <= 2
    assert {r["id"]: r["text"] for r in P.read_store(spark, store).collect()} == {i: f"{i} of {min(i, 4)}" for i in range(20)}
    assert K.drop_old_versions(spark, store) > 0
    assert P.read_store(spark, store).count() == 20


def test_added_counts_over_versions(spark):
    counts = scratch_path(spark, "t-keyed")
    for batch in range(3):
        rows = spark.range(10).select(F.col("id").cast("string").alias("digest"), F.lit(2).cast("long").alias("n"))
        K.merge_batch(rows, batch, counts, "digest", P._added, buckets=2, small=0)
    assert max(map(len, K.versions(spark, counts).values())) == 3
    assert [r["n"] for r in P.read_counts(spark, counts).collect()] == [6] * 10


def test_a_micro_batch_has_work_for_all_cores(spark):
    src, _ = Q.post_files(spark, SMALL)
    assert Q.per_batch(spark) >= spark.sparkContext.defaultParallelism
    files = [f for f in os.listdir(src.removeprefix("file:")) if f.endswith(".parquet")]
    assert len(files) > 2 * Q.per_batch(spark)
