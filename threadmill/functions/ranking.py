"""Global ranks without a single-partition window.

``row_number() over (partition by class order by key)`` would put a whole
class - possibly a third of all rows - into one task.

``hash_rank``: the md5 order key is cut into 16^5 buckets by its first hex
digits (monotone in the key). Rows are numbered inside (class, bucket), and
the bucket counts give each bucket its offset: exact dense ranks 1..n per
class. 10^11 rows make buckets of about 10^5 rows.

``nth_keys``: where only the n-th row is asked for, the bucket counts tell in
which bucket it lies, and only that bucket's keys are sorted. Wide rows are
then compared with the key found and never move.

``ordered_rank``: a range sort deals any key out evenly, however it is
spread; the sorted table is written once, and the row counts of its
partitions give their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.session import materialize

BUCKET_DIGITS = 5


def hash_rank(
    df: DataFrame,
    order_col: str,
    partition_cols=(),
    rank_col: str = "rank",
    tie_cols=(),
    bucket_digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``rank_col`` = 1-based position of the row in (order_col, tie_cols)
    order within ``partition_cols``. ``order_col`` must be a lowercase hex
    string (md5). The offset table has one row per (class, bucket) in use;
    Spark broadcasts it only if it measures it as small.
    """
    pc = list(partition_cols)
    bucket = F.conv(F.substring(F.col(order_col), 1, bucket_digits), 16, 10).cast("int")
    d = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*pc, "_bkt").orderBy(F.col(order_col), *[F.col(c) for c in tie_cols])
    d = d.withColumn("_rn", F.row_number().over(w))
    counts = df.select(*pc, bucket.alias("_bkt")).groupBy(*pc, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*pc).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pc, "_bkt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    out = d.join(offsets, [*pc, "_bkt"])
    return out.withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("bigint")).drop("_bkt", "_rn", "_off")


def order_key(order_col: str, tie_cols=()) -> Column:
    """What ``nth_keys`` compares rows by."""
    return F.struct(order_col, *tie_cols)


def nth_keys(
    df: DataFrame,
    order_col: str,
    at: list[Column],
    partition_cols=(),
    tie_cols=(),
    bucket_digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """``partition_cols``, ``nth`` (index into ``at``) and ``key``: the order key of
    the at[nth]-th row (from 1) in (order_col, tie_cols) order of each partition.
    A place below 1 or beyond the last row gives no row. ``order_col`` as in
    ``hash_rank``; only keys are shuffled, and only one bucket of them is sorted."""
    pc = list(partition_cols)
    bucket = F.conv(F.substring(F.col(order_col), 1, bucket_digits), 16, 10).cast("int")
    narrow = df.select(*dict.fromkeys([*pc, order_col, *tie_cols])).withColumn("_bkt", bucket)
    counts = narrow.groupBy(*pc, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    upto = F.sum("_cnt").over(Window.partitionBy(*pc).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, 0))
    places = counts.withColumns({"_upto": upto, "_at": F.array(*[n.cast("bigint") for n in at])})
    hit = places.select(*pc, "_bkt", (F.col("_upto") - F.col("_cnt")).alias("_before"), "_upto", F.posexplode("_at").alias("nth", "_n"))
    hit = hit.where("_before < _n and _n <= _upto").select(*pc, "_bkt", "nth", (F.col("_n") - F.col("_before")).alias("_place"))
    inside = Window.partitionBy(*pc, "nth").orderBy(order_col, *tie_cols)
    found = narrow.join(hit, [*pc, "_bkt"]).withColumn("_rn", F.row_number().over(inside)).where("_rn = _place")
    return found.select(*pc, "nth", order_key(order_col, tie_cols).alias("key"))


def ordered_rank(df: DataFrame, order_col: str, rank_col: str = "rank", tie_cols=()) -> DataFrame:
    """Global 1-based rank by ``order_col`` and ``tie_cols`` (input order)."""
    row = F.monotonically_increasing_id()  # partition number, then the row's place in it
    d = materialize(df.orderBy(order_col, *tie_cols).withColumn("_row", row))
    part = F.shiftright("_row", 33)
    counts = d.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_cnt"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    out = d.withColumn("_part", part).join(offsets, "_part")
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(rank_col, (F.col("_off") + place + 1).cast("bigint")).drop("_row", "_part", "_off")
