"""Registered queries: streams over post files equal the batch results.

Each query writes the posts view as several files, drains a stream over
them in a few micro-batches with ``availableNow`` and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill import oracle as O
from threadmill.plans.catalog import register
from threadmill.plans.q_clean import POST_OUT_SQL, TS_FMT_DUCK, post_out, ts_str
from threadmill.session import scratch_path
from threadmill.sources import views as V
from threadmill.streaming import collector as P

#: Micro-batches that the files of a view make, and files that one takes at least.
BATCHES, PER_BATCH = 3, 2


def per_batch(spark):
    """Files of a micro-batch: work for all cores, also where a file is too small to be split."""
    return max(PER_BATCH, 2 * spark.sparkContext.defaultParallelism)


def arriving(spark, src, schema):
    return P.stream_ingest(spark, src, schema, files_per_trigger=per_batch(spark))


def post_files(spark, sf, *more):
    """The posts view written as parquet files for ``BATCHES`` micro-batches, then each of the
    ``more`` functions of it as further, later files."""
    src = scratch_path(spark, "post-files")
    p = V.posts(spark, sf)
    for f in (lambda x: x, *more):
        f(p).repartition(BATCHES * per_batch(spark), "id").write.mode("append").parquet(src)
    return src, spark.read.parquet(src).schema


@register("stream_ingest", f"WITH {O.POSTS} SELECT {POST_OUT_SQL} FROM posts")
def q_ingest(spark, sf):
    src, schema = post_files(spark, sf)
    out = scratch_path(spark, "ingest-out")
    P.run_available(arriving(spark, src, schema), out, scratch_path(spark, "ingest-ckpt"))
    return post_out(spark.read.parquet(out))


def _later(p):
    """A second, newer copy of every other post with other counters."""
    return p.where("id % 2 = 0").withColumns({
        "created_at": F.col("created_at") + F.expr("INTERVAL '1' DAY"), "like_count": F.col("like_count") + 100})


@register("stream_upsert", f"""WITH {O.POSTS} SELECT id, CASE WHEN id % 2 = 0 THEN like_count + 100 ELSE like_count END AS like_count,
strftime(CASE WHEN id % 2 = 0 THEN created_at + INTERVAL '1' DAY ELSE created_at END, '{TS_FMT_DUCK}') AS created_at FROM posts""")
def q_upsert(spark, sf):
    src, schema = post_files(spark, sf, _later)
    store = scratch_path(spark, "store")
    P.stream_upsert(arriving(spark, src, schema), store, scratch_path(spark, "store-ckpt"))
    return P.read_store(spark, store, ["id", "like_count", "created_at"]).select("id", "like_count", ts_str())


@register("stream_clean", f"""WITH {O.POSTS}, m AS (SELECT id, lang, {O.mask_text_sql('text')} AS text FROM posts WHERE text <> '')
SELECT id, {O.replace_emoji_sql('text')} AS text FROM m WHERE lang = 'en'""")
def q_stream_clean(spark, sf):
    src, schema = post_files(spark, sf)
    out = scratch_path(spark, "clean-out")
    P.run_available(P.stream_clean(arriving(spark, src, schema)), out, scratch_path(spark, "clean-ckpt"))
    return spark.read.parquet(out).select("id", "text")


@register("stream_dedup_id", f"WITH {O.POSTS} SELECT id, text FROM posts")
def q_dedup(spark, sf):
    src, schema = post_files(spark, sf, lambda p: p)
    out = scratch_path(spark, "dedup-out")
    P.run_available(P.stream_dedup_id(arriving(spark, src, schema), "30 days"), out, scratch_path(spark, "dedup-ckpt"))
    return spark.read.parquet(out).select("id", "text")


@register("stream_repeated_text", f"""WITH {O.POSTS} SELECT {POST_OUT_SQL} FROM posts
WHERE text NOT IN (SELECT text FROM posts GROUP BY text HAVING count(*) > 1)""")
def q_repeated(spark, sf):
    src, schema = post_files(spark, sf)
    counts = scratch_path(spark, "text-counts")
    P.stream_repeated_text(arriving(spark, src, schema), counts, scratch_path(spark, "counts-ckpt"))
    posts = spark.read.parquet(src)
    return post_out(P.unique_text_posts(posts, P.read_counts(spark, counts)))


@register("stream_frontier", f"""WITH {O.POSTS}, {O.COMPLETED} SELECT DISTINCT conversation_id FROM posts
WHERE lang = 'en' AND conversation_id NOT IN (SELECT conversation_id FROM completed)""")
def q_frontier(spark, sf):
    src, schema = post_files(spark, sf)
    out = scratch_path(spark, "frontier")
    completed = scratch_path(spark, "completed")
    V.completed_conversations(V.posts(spark, sf)).write.parquet(completed)
    P.stream_frontier(arriving(spark, src, schema), completed, out, scratch_path(spark, "frontier-ckpt"))
    return spark.read.parquet(out).select("conversation_id")
