"""Labelling, balancing and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions import hashing as H
from threadmill.functions import patterns as P
from threadmill.functions.ranking import hash_rank, nth_keys, order_key
from threadmill.session import bounded_broadcast

METRIC_COLUMNS = ["retweet_count", "reply_count", "like_count", "quote_count"]


def public_metrics(df: DataFrame) -> DataFrame:
    """Pack the counters into the post's ``public_metrics`` map."""
    pairs = [x for c in METRIC_COLUMNS for x in (F.lit(c), F.col(c).cast("bigint"))]
    return df.withColumn("public_metrics", F.create_map(*pairs))


def acknowledgments(metrics: Column | str = "public_metrics") -> Column:
    """Sum of all values of the metrics map."""
    m = F.col(metrics) if isinstance(metrics, str) else metrics
    return F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint")))


def ack_filter(df: DataFrame) -> DataFrame:
    """E2."""
    return df.where(F.col("acknowledgments") > 0)


def min_length_filter(df: DataFrame, col: str = "text", min_len: int = 50) -> DataFrame:
    """More than ``min_len`` code points."""
    return df.where(F.length(col) > min_len)


def shuffle(df: DataFrame, key_cols, seed=42, rank_col: str = "rank", partition_cols=()) -> DataFrame:
    """A repeatable random order, carried as a dense rank column."""
    d = df.withColumn("_ord", H.shuffle_key(*key_cols, seed=seed))
    return hash_rank(d, "_ord", partition_cols, rank_col, tie_cols=list(key_cols)).drop("_ord")


def union_labels(own: DataFrame, external: DataFrame) -> DataFrame:
    """Columns united, missing ones null, duplicates kept."""
    return own.unionByName(external, allowMissingColumns=True)


def drop_unlabelled(df: DataFrame, subset=("claim", "text")) -> DataFrame:
    """E7."""
    return df.na.drop(subset=list(subset))


def map_labels(col="claim", on_error: str = "raise") -> Column:
    """0/1 stay; y/yes/true/t -> 1, n/no/false/f -> 0 (any case); anything
    else raises naming the label (``on_error='null'`` gives null instead).
    Numbers arrive as strings after a union with a sheet, so '0'/'1' (and
    '0.0'/'1.0') count as the numeric labels."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.lower(c.cast("string"))
    # a missing label stays null (dropped by E7), so that the check holds
    # wherever the optimizer evaluates it
    mapped = F.when(s.isNull(), F.lit(None)).when(s.isin("1", "1.0"), 1).when(s.isin("0", "0.0"), 0)
    for k, v in P.LABEL_MAPPING.items():
        mapped = mapped.when(s == k, v)
    if on_error == "raise":
        err = F.raise_error(F.concat(F.lit('unrecognized claim label "'), s, F.lit('"')))
        mapped = mapped.otherwise(err.cast("int"))
    return mapped.cast("int")


def class_split(df: DataFrame, label: str = "claim"):
    """(positives, negatives)."""
    return df.where(F.col(label) == 1), df.where(F.col(label) == 0)


def class_counts(df: DataFrame, label: str = "claim") -> DataFrame:
    """Rows per class and the smallest class size on every row."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    smallest = c.agg(F.min("n")).scalar()
    return c.withColumn("min_n", smallest)


def balance_classes(df: DataFrame, label: str = "claim", key_cols=("id",), seed=42, unique_keys: bool = False) -> DataFrame:
    """Down-sample every class without replacement to the smallest
    class size. Exact sizes; the random choice is a hash order per class.
    With ``unique_keys`` (no two rows of a class agree in ``key_cols``) the order
    is cut at the key of its last row, and no row but the keys is shuffled.
    Rows without a label take no part in the result."""
    if not unique_keys:
        ranked = shuffle(df, key_cols, seed=f"balance:{seed}", rank_col="_crank", partition_cols=[label])
        sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        return ranked.where(F.col("_crank") <= sizes.agg(F.min("n")).scalar()).drop("_crank")
    keyed = df.withColumn("_ord", H.shuffle_key(*key_cols, seed=f"balance:{seed}"))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n")).scalar()
    last = nth_keys(keyed, "_ord", [smallest], [label], list(key_cols)).select(label, F.col("key").alias("_last"))
    kept = keyed.join(bounded_broadcast(last), label).where(order_key("_ord", list(key_cols)) <= F.col("_last"))
    return kept.select(*df.columns)


def rename_xy(df: DataFrame, label: str = "claim", text: str = "text") -> DataFrame:
    """E12."""
    return df.withColumnsRenamed({label: "y", text: "x"})


def ordered_split(df: DataFrame, key_cols=("id",), seed=42, train=P.TRAIN_CUT, test=P.TEST_CUT, rank_col: str | None = "rank") -> DataFrame:
    """Shuffle, then the first floor(.8n) rows are train, up to
    floor(.93n) test, the rest val. The position is kept as ``rank_col``;
    without one only the keys of the two cuts are looked up, and rows do not
    move; the keys must be unique then (rows equal in ``key_cols`` share a part)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    cut1 = F.floor(n * F.lit(float(train)))
    cut2 = F.floor(n * F.lit(float(test)))
    if rank_col is None:
        keyed = df.withColumn("_ord", H.shuffle_key(*key_cols, seed=f"order:{seed}"))
        cuts = nth_keys(keyed, "_ord", [cut1, cut2], (), list(key_cols))
        # a cut before the first row has no key: nothing is below it
        upto = lambda i: order_key("_ord", list(key_cols)) <= cuts.where(F.col("nth") == i).select("key").scalar()
        return keyed.withColumn("split", F.when(upto(0), "train").when(upto(1), "test").otherwise("val")).drop("_ord")
    ranked = shuffle(df, key_cols, seed=f"order:{seed}", rank_col=rank_col)
    split = F.when(F.col(rank_col) <= cut1, "train").when(F.col(rank_col) <= cut2, "test").otherwise("val")
    return ranked.withColumn("split", split)


def split_filter(df: DataFrame, split: str) -> DataFrame:
    """E15."""
    return df.where(F.col("split") == split)


def binarize_labels(col="y") -> Column:
    """E16: 'NoArgument' stays, everything else (null too) -> 'Argument'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.eqNullSafe(F.lit("NoArgument")), "NoArgument").otherwise("Argument")


def ordinal_fit(df: DataFrame, col: str = "y") -> DataFrame:
    """Sorted distinct categories -> 0..k-1 (category, idx).

    The distinct set is the label alphabet (a handful of classes), so the
    final numbering runs over a tiny table."""
    cats = df.select(F.col(col).alias("category")).where(F.col("category").isNotNull()).distinct()
    return cats.select("category", (F.row_number().over(Window.orderBy("category")) - 1).cast("int").alias("idx"))


def ordinal_transform(df: DataFrame, mapping: DataFrame, col: str = "y", out: str = "y") -> DataFrame:
    """Apply a fitted mapping; an unseen category raises."""
    m = bounded_broadcast(mapping.withColumnRenamed("category", "_cat"))
    j = df.join(m, df[col].eqNullSafe(m["_cat"]), "left")
    err = F.raise_error(F.concat(F.lit("unseen category: "), F.coalesce(F.col(col).cast("string"), F.lit("null"))))
    return j.withColumn(out, F.when(F.col("idx").isNotNull(), F.col("idx")).otherwise(err.cast("int"))).drop("_cat", "idx")


def class_cardinality(df: DataFrame, col: str = "y") -> DataFrame:
    """Number of distinct labels, a null counted as one more."""
    return df.agg(
        (F.count_distinct(col) + F.max(F.col(col).isNull().cast("int"))).cast("bigint").alias("n_classes")
    )
