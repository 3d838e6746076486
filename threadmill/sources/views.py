"""Fixture views: posts, users, topics and label sheet from the driver tables.

The driver's ``documents`` hold prose without links, tags or emoticons, so a
post is a document decorated by fixed rules of its length. Copies of a text
have equal length, so copies stay copies; only the link carries the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.sources.tables import table

POST_COLUMNS = [
    "id", "author_id", "conversation_id", "created_at", "lang", "country", "lon", "lat",
    "retweet_count", "reply_count", "like_count", "quote_count", "text",
]



def _mod_str(c: Column, m: int) -> Column:
    return (c % m).cast("string")


def posts_from_documents(docs: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    n = F.col("n_chars")
    metric = lambda m: F.when(d % 3 == 0, F.lit(0).cast("bigint")).otherwise(d % m)
    text = F.concat(
        F.when(n % 7 == 0, F.lit("RT ")).otherwise(F.lit("")),
        F.when(n % 3 == 0, F.concat(F.lit("@"), F.col("lang"), F.lit("_"), _mod_str(n, 11), F.lit(" "))).otherwise(F.lit("")),
        F.col("text"),
        F.when(n % 2 == 0, F.concat(F.lit(" #topic"), _mod_str(n, 9))).otherwise(F.lit("")),
        F.when(
            n % 5 == 0,
            F.concat(F.lit(" https://www.ex"), _mod_str(n, 13), F.lit(".com/p?q="), d.cast("string")),
        ).otherwise(F.lit("")),
        F.when(n % 4 == 0, F.lit(" :)")).when(n % 4 == 1, F.lit(" ;)")).when(n % 4 == 2, F.lit(" :p")).otherwise(F.lit("")),
    )
    return docs.select(
        d.alias("id"),
        (d % 37).alias("author_id"),
        (d - d % 5).alias("conversation_id"),
        # zone-free (timestamp_ntz), so rendering does not depend on the session time zone
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(d * 37 % 10007).cast("int"))).alias("created_at"),
        "lang",
        F.when(d % 4 == 0, "US").when(d % 4 == 1, "CA").when(d % 4 == 2, "MX").otherwise("GB").alias("country"),
        (d * 7 % 360 - 180).cast("double").alias("lon"),
        (d * 13 % 180 - 90).cast("double").alias("lat"),
        metric(11).alias("retweet_count"),
        metric(5).alias("reply_count"),
        metric(17).alias("like_count"),
        metric(2).alias("quote_count"),
        text.alias("text"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_from_documents(table(spark, sf_dir, "documents"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct authors with a user name."""
    p = posts(spark, sf_dir)
    return (
        p.select("author_id").distinct()
        .select(F.col("author_id").alias("id"), F.concat(F.lit("user_"), F.col("author_id").cast("string")).alias("username"))
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic-argument table (x, topic, y, split) keyed by document id."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("x"),
        F.concat(F.lit("about "), F.col("source")).alias("topic"),
        F.when(F.col("toxic") == 1, "Argument_against").when(F.col("quality") == 1, "Argument_for").otherwise("NoArgument").alias("y"),
        F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "test").otherwise("val").alias("split"),
    )


def label_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelling sheet as a person would return it: mixed spellings, gaps."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    m4 = F.col("doc_id") % 4
    yes = F.when(m4 == 0, "Y").when(m4 == 1, "yes").when(m4 == 2, "TRUE").otherwise("t")
    no = F.when(m4 == 0, "n").when(m4 == 1, "No").when(m4 == 2, "False").otherwise("F")
    claim = F.when(F.col("doc_id") % 9 == 8, F.lit(None).cast("string")).when(F.col("quality") == 1, yes).otherwise(no)
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("text"), claim.alias("claim"))


def completed_conversations(p: DataFrame) -> DataFrame:
    """The fixture's set of conversations already expanded."""
    return p.select("conversation_id").where(F.col("conversation_id") % 3 == 0).distinct()


def external_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label file of another team: tweet_id (string) and claim."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").cast("string").alias("tweet_id"), F.col("quality").cast("string").alias("claim"), F.col("toxic"))
