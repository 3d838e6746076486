"""Streams of posts.

Posts arrive as files in a folder. Every sink is idempotent per micro-batch
(a batch writes its own partition or version, overwritten on replay), and progress is
kept in the checkpoint location, so a restarted or lost executor repeats
work but never duplicates it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators import clean as C
from threadmill.operators import store as S
from threadmill.streaming import keyed_store as K


def stream_ingest(spark: SparkSession, src: str, schema, files_per_trigger: int | None = None, bytes_per_trigger: int | None = 10 << 30,
                  fmt: str = "parquet") -> DataFrame:
    """Posts arriving in pages (files), appended. A micro-batch takes new
    files up to a number of bytes (one file at least), or up to a number of files if that is asked for."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.load(src)


def run_available(stream: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Drain everything available now into a file sink and stop."""
    q = (stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink_path))
    q.awaitTermination()


def _drain(stream: DataFrame, write, checkpoint: str) -> None:
    """Give every micro-batch of what is available now to ``write`` and stop."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_upsert(stream: DataFrame, store_path: str, checkpoint: str, buckets: int = 64) -> None:
    """Every micro-batch is merged into a store by post id; the latest batch
    wins (B15). A batch writes its own posts; overwritten ones go when their bucket's versions are merged."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        K.merge_batch(rows, batch_id, store_path, "id", lambda r: S.store_upsert(r.limit(0), r, "batch", ["bucket", "id"]), buckets)

    _drain(stream, write, checkpoint)


def read_store(spark: SparkSession, store_path: str, columns: list[str] | None = None) -> DataFrame:
    """The upserted store: one row per id, from the latest batch; with ``columns`` no others are read."""

    def latest(rows: DataFrame) -> DataFrame:
        # a version has an id once, and no two versions of a bucket have posts of one batch
        rest = [c for c in columns or rows.columns if c not in ("bucket", "id", "batch")]
        one = rows.groupBy("bucket", "id").agg(F.max_by(F.struct("batch", *rest), "batch").alias("_row"))
        return one.select("bucket", "id", "_row.*")

    posts = K.read(spark, store_path, latest)
    return posts.select(*columns) if columns else posts.drop("batch")


def compact_store(spark: SparkSession, store_path: str, compacted_path: str) -> DataFrame:
    """The store as one table without overwritten rows, in a new folder (the
    stream may go on writing to the old one)."""
    read_store(spark, store_path).write.parquet(compacted_path)
    return spark.read.parquet(compacted_path)


def stream_clean(stream: DataFrame, lang: str = "en") -> DataFrame:
    """The stateless cleaning steps (C2-C8, C11) on a stream. Repeated
    text removal is not append-safe and lives in ``stream_repeated_text``."""
    d = C.drop_empty(stream)
    d = d.withColumn("text", C.mask_text("text"))
    d = C.lang_filter(d, lang)
    return C.replace_emoji(d, "text")


def stream_dedup_id(stream: DataFrame, delay: str, time_col: str = "created_at") -> DataFrame:
    """Each post id once. The state holds the ids of the last ``delay`` of
    event time, so the caller chooses how much it may grow."""
    # watermarks need a zoned timestamp; the posts carry timestamp_ntz
    s = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return s.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["id"])


def text_digest(text="text"):
    """128 bits that stand for a text; a null text has a digest of its own."""
    c = F.col(text) if isinstance(text, str) else text
    return F.md5(F.coalesce(F.concat(F.lit("+"), c), F.lit("-")))


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("bucket", "digest").agg(F.sum("n").alias("n"))


def stream_repeated_text(stream: DataFrame, counts_path: str, checkpoint: str, buckets: int = 64) -> None:
    """P5: copies per text digest, added up in a table by digest. There is no
    state to expire: however late a copy comes, its digest's row is there. The table holds a digest and a count
    per distinct text, never the text."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(text_digest().alias("digest")).agg(F.count(F.lit(1)).alias("n"))
        K.merge_batch(counts, batch_id, counts_path, "digest", _added, buckets)

    _drain(stream, write, checkpoint)


def read_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    """(digest, n) of all texts so far."""
    return K.read(spark, counts_path, _added)


def unique_text_posts(posts: DataFrame, counts: DataFrame) -> DataFrame:
    """Batch view of P5: posts whose text was seen exactly once so far."""
    once = counts.where(F.col("n") == 1).select("digest")
    return posts.withColumn("digest", text_digest()).join(once, "digest", "left_semi").drop("digest")


def stream_frontier(stream: DataFrame, completed_path: str, frontier_path: str, checkpoint: str, lang: str = "en",
                    forget: str | None = None, time_col: str = "created_at") -> None:
    """Conversations of English posts not yet expanded, each once. The keyed
    state remembers which conversations have been asked for over all micro-batches, or over
    the last ``forget`` of event time, after which a conversation that is still open may be asked for again.

    ``completed_path`` holds the table of completed conversations; it is read
    anew for each micro-batch, so later completions count."""
    asked = stream.where(F.col("lang") == lang)
    if forget is None:
        asked = asked.select("conversation_id").dropDuplicates(["conversation_id"])
    else:
        asked = asked.select("conversation_id", F.col(time_col).cast("timestamp").alias("_at")).withWatermark("_at", forget)
        asked = asked.dropDuplicatesWithinWatermark(["conversation_id"]).select("conversation_id")

    def write(batch: DataFrame, batch_id: int) -> None:
        completed = batch.sparkSession.read.parquet(completed_path)
        todo = batch.join(completed, "conversation_id", "left_anti")
        # one folder per micro-batch: a replayed batch overwrites it
        todo.write.mode("overwrite").parquet(f"{frontier_path}/batch={batch_id}")

    _drain(asked, write, checkpoint)
