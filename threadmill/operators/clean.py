"""Cleaning (C1-C13).

Order is part of the semantics: repeated-text removal, lower case, link, tag,
retweet and mention masks, language filter, repeated-text removal again,
empty-text filter, emoji descriptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions import emoji as E
from threadmill.functions import patterns as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def drop_repeated_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Remove every copy of a text seen more than once (nulls count as equal).

    One shuffle: rows are grouped by their text with a count and any one row,
    and groups of one are kept. Copies collapse before the shuffle, so a viral
    text sends one row per map task.
    """
    rest = [c for c in df.columns if c != text]
    one = df.groupBy(F.col(text)).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest) if rest else F.lit(True)).alias("_row")
    )
    kept = one.where(F.col("_n") == 1)
    return kept.select(*[F.col(text) if c == text else F.col("_row")[c].alias(c) for c in df.columns])


def lower_text(col="text") -> Column:
    """C2."""
    return F.lower(_c(col))


def mask_urls(col="text") -> Column:
    """Links -> [URL]. Each alternative begins with h or w: the look-ahead spares the others at all other places."""
    return F.regexp_replace(_c(col), "(?=[hw])" + P.URL_PATTERN, P.URL_TOKEN)


def mask_hashtags(col="text") -> Column:
    """C4: '#name' -> '[TAG] name'. One global pass equals the restart loop."""
    return F.regexp_replace(_c(col), P.HASHTAG_PATTERN, P.TAG_TOKEN + " $1")


def mask_retweet(col="text") -> Column:
    """A leading 'rt' (no word boundary) -> '[RT]'."""
    # an anchored replace references the input once (a CASE would copy the
    # whole mask chain into three branches)
    return F.regexp_replace(_c(col), "^rt", P.RT_TOKEN)


def mask_mentions(col="text") -> Column:
    """C6: '@name' -> '[MEN]'."""
    return F.regexp_replace(_c(col), P.MENTION_PATTERN, P.MEN_TOKEN)


def mask_text(col="text") -> Column:
    """C2-C6 in order."""
    return mask_mentions(mask_retweet(mask_hashtags(mask_urls(lower_text(col)))))


def lang_filter(df: DataFrame, lang: str = "en") -> DataFrame:
    """C7."""
    return df.where(F.col("lang") == lang)


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Text != '' (blank-only text stays)."""
    return df.where(F.col(text) != "")


def replace_emoji(df: DataFrame, col: str = "text", emoji_entries=None, emoticons=None) -> DataFrame:
    """C11: emoji and emoticons -> their descriptions, in dictionary order."""
    df = df.withColumn(col, E.replace_emoji(col, emoji_entries, []))
    marked = df.withColumn("_marks", E.emoticon_marks(col, emoticons))
    return marked.withColumn(col, E.replace_emoji(col, [], emoticons, "_marks")).drop("_marks")


def strip_urls(col="x") -> Column:
    """Links removed, case kept, null stays null."""
    return F.regexp_replace(_c(col), P.URL_PATTERN, "")


def flatten_newlines(col="text") -> Column:
    """C13: '\\n' -> ' '."""
    return F.replace(_c(col), F.lit("\n"), F.lit(" "))


def clean_posts(posts: DataFrame, lang: str = "en", emoji: bool = True, emoji_entries=None, emoticons=None) -> DataFrame:
    """C14: the whole cleaning chain, DataFrame -> DataFrame."""
    df = drop_repeated_text(posts)
    # C8 moved ahead of the masks: every mask puts a non-empty token in place
    # of a non-empty match, so the masked text is empty exactly when the raw
    # text is. The filter then runs on the raw column at the scan instead of
    # re-running the mask chain inside a pushed-down predicate.
    df = drop_empty(df)
    df = df.withColumn("text", mask_text("text"))
    df = lang_filter(df, lang)
    df = drop_repeated_text(df)
    if emoji:
        df = replace_emoji(df, "text", emoji_entries, emoticons)
    return df
