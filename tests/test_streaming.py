"""Streams equal the batch result, and a re-run from the checkpoint adds nothing."""

import pytest

from threadmill.operators import clean as C
from threadmill.session import scratch_path
from threadmill.sources import views as V
from threadmill.streaming import collector as P
from threadmill.streaming import keyed_store as K
from tests.conftest import SMALL


def _files(spark, copies=1):
    src = scratch_path(spark, "t-files")
    p = V.posts(spark, SMALL)
    for _ in range(copies):
        p.repartition(3, "id").write.mode("append").parquet(src)
    return src, spark.read.parquet(src).schema


def test_ingest_rerun_adds_nothing(spark):
    src, schema = _files(spark)
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    P.run_available(P.stream_ingest(spark, src, schema), out, ck)
    n1 = spark.read.parquet(out).count()
    P.run_available(P.stream_ingest(spark, src, schema), out, ck)
    assert spark.read.parquet(out).count() == n1 == V.posts(spark, SMALL).count()


def _post_batches(spark, *batches):
    """One file a batch, in the order of arrival: (id, text, counters)."""
    src = scratch_path(spark, "t-batches")
    for rows in batches:
        df = spark.createDataFrame(rows, "id string, text string, public_metrics map<string,bigint>")
        df.coalesce(1).write.mode("append").parquet(src)
    return src, spark.read.parquet(src).schema


BATCHES = (
    [("a", "one", {"like": 1}), ("b", "two", None), ("c", "one", {})],
    [("a", "three", {"like": 2}), ("d", "four", {"x": 1}), (None, None, {})],
    [("e", "two", {"like": 3}), ("a", "five", {"like": 2, "reply": 9}), ("a", "five", {"like": 1})],
    [("f", None, {})],
)
STORE = {("a", "five"), ("b", "two"), ("c", "one"), ("d", "four"), (None, None), ("e", "two"), ("f", None)}


def _stored(spark, store):
    return [(r["id"], r["text"]) for r in P.read_store(spark, store).collect()]


def test_upsert_over_batches_with_maps_and_a_rerun(spark):
    src, schema = _post_batches(spark, *BATCHES)
    store, ck = scratch_path(spark, "t-store"), scratch_path(spark, "t-sck")
    for _ in range(2):
        P.stream_upsert(P.stream_ingest(spark, src, schema, files_per_trigger=1), store, ck, buckets=4)
        rows = _stored(spark, store)
        assert len(rows) == len(STORE) and set(rows) == STORE
    assert spark.read.parquet(f"{store}/manifest").select("batch").distinct().count() == len(BATCHES)
    plan = P.read_store(spark, store)._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert K.drop_old_versions(spark, store) > 0
    assert set(_stored(spark, store)) == STORE


def test_a_batch_that_dies_before_its_manifest_is_replayed(spark, monkeypatch):
    src, schema = _post_batches(spark, *BATCHES)
    store, ck = scratch_path(spark, "t-store"), scratch_path(spark, "t-sck")
    real = K._write_manifest

    def dies(spark, path, batch_id, now):
        if batch_id == 2:
            raise RuntimeError("lost")
        real(spark, path, batch_id, now)

    stream = lambda: P.stream_ingest(spark, src, schema, files_per_trigger=1)
    monkeypatch.setattr(K, "_write_manifest", dies)
    with pytest.raises(Exception, match="lost"):
        P.stream_upsert(stream(), store, ck, buckets=2)
    assert {t for i, t in _stored(spark, store) if i == "a"} == {"three"}  # readers see the last whole batch
    monkeypatch.setattr(K, "_write_manifest", real)
    P.stream_upsert(stream(), store, ck, buckets=2)
    rows = _stored(spark, store)
    assert len(rows) == len(STORE) and set(rows) == STORE


def test_text_counts_over_batches(spark):
    src, schema = _post_batches(spark, *BATCHES)
    counts, ck = scratch_path(spark, "t-counts"), scratch_path(spark, "t-cck")
    for _ in range(2):
        P.stream_repeated_text(P.stream_ingest(spark, src, schema, files_per_trigger=1), counts, ck, buckets=4)
        table = P.read_counts(spark, counts)
        assert sorted(r["n"] for r in table.collect()) == [1, 1, 2, 2, 2, 2]  # three, four; one, two, five, null
        left = P.unique_text_posts(spark.read.parquet(src), table)
        assert {r["text"] for r in left.collect()} == {"three", "four"}


def test_frontier_asks_once_over_batches(spark):
    src = scratch_path(spark, "t-frontier")
    batches = [[(1, "en"), (2, "en"), (3, "de")], [(1, "en"), (4, "en"), (3, "en")], [(2, "en"), (4, "en"), (9, "en"), (1, "en")]]
    for rows in batches:
        spark.createDataFrame(rows, "conversation_id long, lang string").coalesce(1).write.mode("append").parquet(src)
    completed, out, ck = (scratch_path(spark, n) for n in ("t-done", "t-fr", "t-fck"))
    spark.createDataFrame([(9,)], "conversation_id long").write.parquet(completed)
    for _ in range(2):
        P.stream_frontier(P.stream_ingest(spark, src, spark.read.parquet(src).schema, files_per_trigger=1), completed, out, ck)
        got = [(r["conversation_id"], r["batch"]) for r in spark.read.parquet(out).collect()]
        assert sorted(got) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_dedup_id_over_batches(spark):
    src = scratch_path(spark, "t-dedup")
    for rows in ([(1, "2024-01-01"), (2, "2024-01-02")], [(2, "2024-01-03"), (1, "2024-01-01"), (3, "2024-01-03")], [(3, "2024-01-04"), (4, "2024-01-05")]):
        df = spark.createDataFrame(rows, "id long, day string").selectExpr("id", "cast(day as timestamp_ntz) as created_at")
        df.coalesce(1).write.mode("append").parquet(src)
    out = scratch_path(spark, "t-dd")
    stream = P.stream_ingest(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    P.run_available(P.stream_dedup_id(stream, "30 days"), out, scratch_path(spark, "t-ddc"))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_repeated_text_stream_equals_batch(spark):
    src, schema = _files(spark)
    counts, ck = scratch_path(spark, "t-counts"), scratch_path(spark, "t-cck")
    P.stream_repeated_text(P.stream_ingest(spark, src, schema), counts, ck)
    got = P.unique_text_posts(spark.read.parquet(src), P.read_counts(spark, counts)).select("id")
    want = C.drop_repeated_text(V.posts(spark, SMALL)).select("id")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
