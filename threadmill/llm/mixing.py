"""Operator 5: mixing sources to target weights.

Targets: the sources share ``share`` times all words in proportion to their
weights; a source stops at ``most`` times its own words and its excess goes to
the others by weight, until none is above.

Sampling after Efraimidis and Spirakis: each document draws an exponential key,
-ln(u) / quality, with u a hash of its id. Every complete epoch of a source
takes all of its documents. For the fractional rest the documents are sorted by
key and their sizes summed; a document is taken when more than half of it lies
within the budget, so a source misses its target by half a document at most.

No source is sorted in one task. Its key range is cut into ranges of about
``range_rows`` documents, the sizes of the ranges are summed first, and only
the ranges in which a budget ends are sorted. The draw depends on nothing but
the id and the seed, so a repeated run or a lost executor changes nothing.

Defined results: a null text or source counts as size 0 or as one source of its
own, last in order. Documents of size 0 are taken in complete epochs only, with
0 words. Repeated rows draw the same key and are ordered by size and by
a hash of the text, after which they are interchangeable: each is judged as a row of its own.
A quality that is null, not finite or not above 0 counts as 1. Other columns pass
through ``mix``; an input column named as an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: each word shrinks to one letter together with the
    white space around it; what may be left beside these letters is a text of white space only."""
    ones = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.length(F.regexp_replace(ones, r"[\x20\x09-\x0D]+", "")).cast("long")


def draw(key: Column, seed: int) -> Column:
    """Uniform in (0, 1): 48 bits of MD5, halfway between two steps."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def ranked_sources(sizes: DataFrame, weights) -> DataFrame:
    """Sources in code point order, null last, with the weights in turn. The
    ranks come from sorted ranges and their row counts, not from one task."""
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(sizes.repartitionByRange(parts, F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # one row a partition
    before, offsets = 0, []
    for part, count in counts:
        offsets.append((part, before))
        before += count
    if not offsets:
        return sizes.withColumn("weight", F.lit(0.0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    start = spark.createDataFrame(offsets, "part int, before long")
    turn = ((F.col("before") + F.col("inside")) % len(weights)).cast("int")
    table = F.array(*[F.lit(float(w)) for w in weights])
    return ranged.withColumn("inside", inside).join(F.broadcast(start), "part").select("source", "source_size", "source_rows", table[turn].alias("weight"))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target``. Each round fixes the sources that reached their limit
    and reshares the rest; only sums come to the driver."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    limit = F.col("source_size") * float(most)
    budget, unit, seen = share * total, 0.0, -1
    while True:
        held = F.lit(False) if seen < 0 else limit <= F.lit(unit) * F.col("weight")
        row = sources.agg(
            F.count(F.when(held, 1)).alias("n"),
            F.coalesce(F.sum(F.when(held, F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if row["n"] == seen or row["weight"] <= 0:
            break
        seen, unit = row["n"], (budget - most * row["full"]) / row["weight"]
    return sources.withColumn("target", F.least(limit, F.lit(float(unit)) * F.col("weight")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality: Column | None = None,
    ratings: DataFrame | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17, range_rows: int = 50_000,
) -> DataFrame:
    """Each row's key columns with its size, its source's size and target, and
    what the mix takes of it: id, source, size, source_size, target, epochs
    (times the document is taken) and taken (words). Column ``row_hash`` tells
    rows of one id apart. The quality of a document is the column ``quality``, or
    its weight in ``ratings`` (columns id and weight, one row an id)."""
    rows = docs.select(  # texts end here: what is joined and shuffled later is narrow
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        (quality if quality is not None else F.lit(1.0)).cast("double").alias("weight"),
        F.xxhash64(F.col(text_col)).alias("row_hash"),
    )
    if ratings is not None:
        rows = cut(rows.drop("weight")).join(ratings.select(F.col("id").alias("r_id"), "weight"), F.col("doc_id") == F.col("r_id"), "left").drop("r_id")
    good = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(F.lit(1.0))
    rows = cut(rows.withColumn("key", -F.log(draw(F.col("doc_id"), seed)) / good).drop("weight"))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sources = cut(targets(cut(ranked_sources(sources, weights)), share, most))
    epoch = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("epochs_all", epoch).withColumn("rest", F.col("target") - epoch * F.col("source_size"))

    # null-safe key of a source; 1 - exp(-key) spreads exponential keys evenly over the ranges
    joined = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranges = F.ceil(F.col("source_rows") / F.lit(float(range_rows)))
    joined = joined.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), ranges - 1).cast("long"))
    per_range = cut(joined.groupBy("source", "range").agg(F.sum("size").alias("range_size"), F.first("rest").alias("rest")))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_range = per_range.withColumn("before", before).select(
        F.col("source").alias("p_source"), F.col("range").alias("p_range"), "before",
        ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("range_size") >= F.col("rest"))).alias("ends"),
    )
    placed = joined.join(per_range, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range"))).drop("p_source", "p_range")
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.where("ends").withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    outside = placed.where("not ends")
    both = inside.unionByName(outside)
    extra = ((F.col("size") > 0) & (F.col("before") + F.col("size") / 2.0 < F.col("rest"))).cast("long")
    return (
        both.withColumn("epochs", F.col("epochs_all") + extra)
        .withColumn("taken", F.col("epochs") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "taken", "row_hash")
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """id and weight: 2 for documents labelled good, 0.5 for documents labelled
    bad; the best of several labels of a document counts."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    return marks.select("id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))
