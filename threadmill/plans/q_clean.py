"""Registered queries: sources A1, cleaning C1-C14."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill import oracle as O
from threadmill.operators import clean as C
from threadmill.plans.catalog import register
from threadmill.session import scratch_path
from threadmill.sources import io as IO
from threadmill.sources import views as V

TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss"
TS_FMT_DUCK = "%Y-%m-%d %H:%M:%S"


def ts_str(col="created_at"):
    return F.date_format(col, TS_FMT_SPARK).alias(col)


def ts_sql(col="created_at"):
    return f"strftime({col}, '{TS_FMT_DUCK}') AS {col}"


POST_OUT = ["id", "author_id", "conversation_id", "lang", "text"]


def post_out(df):
    return df.select(*POST_OUT[:3], ts_str(), *POST_OUT[3:])


POST_OUT_SQL = "id, author_id, conversation_id, " + ts_sql() + ", lang, text"


@register("scan_posts", f"WITH {O.POSTS} SELECT {POST_OUT_SQL}, country, lon, lat, retweet_count, reply_count, like_count, quote_count FROM posts")
def scan_posts(spark, sf):
    path = scratch_path(spark, "saved-posts")
    V.posts(spark, sf).write.parquet(path)
    return IO.scan_posts(spark, path).select(
        "id", "author_id", "conversation_id", ts_str(), "lang", "text", "country", "lon", "lat",
        "retweet_count", "reply_count", "like_count", "quote_count")


@register("drop_repeated_text", f"""WITH {O.POSTS}
SELECT {POST_OUT_SQL} FROM posts
WHERE text NOT IN (SELECT text FROM posts GROUP BY text HAVING count(*) > 1)""")
def q_drop_repeated(spark, sf):
    return post_out(C.drop_repeated_text(V.posts(spark, sf)))


@register("lower_text", f"WITH {O.POSTS} SELECT id, lower(text) AS text FROM posts")
def q_lower(spark, sf):
    return V.posts(spark, sf).select("id", C.lower_text("text").alias("text"))


@register("mask_urls", f"WITH {O.POSTS} SELECT id, regexp_replace(text, {O.url_re()}, '[URL]', 'g') AS text FROM posts")
def q_mask_urls(spark, sf):
    return V.posts(spark, sf).select("id", C.mask_urls("text").alias("text"))


@register("mask_hashtags", f"WITH {O.POSTS} SELECT id, regexp_replace(text, {O.q(C.P.HASHTAG_PATTERN)}, '[TAG] \\1', 'g') AS text FROM posts")
def q_mask_hashtags(spark, sf):
    return V.posts(spark, sf).select("id", C.mask_hashtags("text").alias("text"))


@register("mask_retweet", f"""WITH {O.POSTS}, l AS (SELECT id, lower(text) AS t FROM posts)
SELECT id, CASE WHEN substr(t, 1, 2) = 'rt' THEN '[RT]' || substr(t, 3) ELSE t END AS text FROM l""")
def q_mask_retweet(spark, sf):
    return V.posts(spark, sf).select("id", C.mask_retweet(C.lower_text("text")).alias("text"))


@register("mask_mentions", f"WITH {O.POSTS} SELECT id, regexp_replace(text, {O.q(C.P.MENTION_PATTERN)}, '[MEN]', 'g') AS text FROM posts")
def q_mask_mentions(spark, sf):
    return V.posts(spark, sf).select("id", C.mask_mentions("text").alias("text"))


@register("lang_filter", f"WITH {O.POSTS} SELECT {POST_OUT_SQL} FROM posts WHERE lang = 'en'")
def q_lang(spark, sf):
    return post_out(C.lang_filter(V.posts(spark, sf)))


@register("drop_empty", f"""WITH {O.POSTS}, m AS (SELECT id, {O.mask_text_sql('text')} AS text FROM posts)
SELECT id, text FROM m WHERE text <> ''""")
def q_drop_empty(spark, sf):
    m = V.posts(spark, sf).select("id", C.mask_text("text").alias("text"))
    return C.drop_empty(m)


@register("replace_emoji", f"WITH {O.POSTS} SELECT id, {O.replace_emoji_sql('lower(text)')} AS text FROM posts")
def q_replace_emoji(spark, sf):
    return C.replace_emoji(V.posts(spark, sf).select("id", C.lower_text("text").alias("text")))


@register("strip_urls", f"WITH {O.TOPICS} SELECT id, regexp_replace(x, {O.url_re()}, '', 'g') AS x, topic, y, split FROM topics")
def q_strip_urls(spark, sf):
    return V.topics(spark, sf).withColumn("x", C.strip_urls("x"))


@register("flatten_newlines", f"WITH {O.POSTS} SELECT id, replace(text, chr(10), ' ') AS text FROM posts")
def q_flatten(spark, sf):
    return V.posts(spark, sf).select("id", C.flatten_newlines("text").alias("text"))


CLEAN_SQL_CTE = f"""{O.POSTS},
c1 AS (SELECT * FROM posts WHERE text NOT IN (SELECT text FROM posts GROUP BY text HAVING count(*) > 1)),
c6 AS (SELECT * REPLACE ({O.mask_text_sql('text')} AS text) FROM c1),
c7 AS (SELECT * FROM c6 WHERE lang = 'en'),
c1b AS (SELECT * FROM c7 WHERE text NOT IN (SELECT text FROM c7 GROUP BY text HAVING count(*) > 1)),
c8 AS (SELECT * FROM c1b WHERE text <> ''),
cleaned AS (SELECT * REPLACE ({O.replace_emoji_sql('text')} AS text) FROM c8)"""


@register("clean_posts", f"WITH {CLEAN_SQL_CTE} SELECT {POST_OUT_SQL} FROM cleaned")
def q_clean_posts(spark, sf):
    return post_out(C.clean_posts(V.posts(spark, sf)))
