"""Post-store queries (B1-B16): the collector's API calls as set queries.

Reply threads are one level deep and keyed by ``conversation_id``; every
"fetch the replies" is an equi-join on it, "unless done" is an anti-join with
the completed set. A giant thread is a skewed join key: AQE splits it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, StructType, VariantType

from threadmill.session import bounded_broadcast, materialize

# ---- fixed values (must match the reference) ---------------------------------
# Field presets of the post and user objects.
TWEET_FIELDS_ALL_PUBLIC = [
    "attachments", "author_id", "context_annotations", "conversation_id", "created_at", "entities", "geo", "id",
    "in_reply_to_user_id", "lang", "possibly_sensitive", "public_metrics", "referenced_tweets", "reply_settings",
    "source", "text", "withheld",
]
TWEET_FIELDS_ALL = [
    "attachments", "author_id", "context_annotations", "conversation_id", "created_at", "entities", "geo", "id",
    "in_reply_to_user_id", "lang", "non_public_metrics", "organic_metrics", "possibly_sensitive", "promoted_metrics",
    "public_metrics", "referenced_tweets", "reply_settings", "source", "text", "withheld",
]
USER_FIELDS_ALL = [
    "id", "name", "username", "created_at", "description", "entities", "location", "pinned_tweet_id",
    "profile_image_url", "protected", "public_metrics", "url", "verified", "withheld",
]
MAX_SEARCH_RESULTS = 100
# ------------------------------------------------------------------------------



def newest_first():
    return [F.col("created_at").desc(), F.col("id").desc()]

# A search term matches whole words; '#' and '@' stay part of a word.
WORD_SPLIT = r"[^\p{L}\p{N}_#@]+"


def user_by_name(users: DataFrame, username: str, fields: Iterable[str] | None = None) -> DataFrame:
    """B1."""
    out = users.where(F.col("username") == username)
    return out.select(*fields) if fields else out


def recent_by_author(posts: DataFrame, count: int, author_ids: DataFrame | None = None) -> DataFrame:
    """B2: newest ``count`` posts per author.

    ``row_number() <= count`` is planned with a per-partition group limit
    before the shuffle, so an author with a third of all posts sends only
    ``count`` rows per map task."""
    p = posts if author_ids is None else posts.join(author_ids.select("author_id").distinct(), "author_id", "left_semi")
    w = Window.partitionBy("author_id").orderBy(*newest_first())
    return p.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count).drop("_rn")


def post_by_id(posts: DataFrame, ids) -> DataFrame:
    """One id, a list, or a DataFrame of ids (left-semi join)."""
    if isinstance(ids, DataFrame):
        return posts.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi")
    if isinstance(ids, (list, tuple, set)):
        return posts.where(F.col("id").isin(list(ids)))
    return posts.where(F.col("id") == ids)


def conversation_root(posts: DataFrame) -> DataFrame:
    """Each post with its thread's root post (left join on id)."""
    roots = posts.select(
        F.col("id").alias("root_id"), F.col("author_id").alias("root_author_id"), F.col("text").alias("root_text")
    )
    return posts.join(roots, posts["conversation_id"] == roots["root_id"], "left")


def split_words(text: Column) -> Column:
    return F.split(F.lower(text), WORD_SPLIT)


def _term_hit(words: Column, term: str) -> Column:
    t = term.lower()
    hit = F.array_contains(words, t)
    if not t.startswith(("#", "@")):
        hit = hit | F.array_contains(words, "#" + t)
    return hit


def search_predicate(all_of=(), any_of=(), none_of=(), countries=(), text: str = "text") -> Column:
    """Case-folded whole-word search: all terms, one of a group, none of the
    excluded ones, and an optional country clause."""
    w = split_words(F.col(text))
    cond = F.lit(True)
    for t in all_of:
        cond = cond & _term_hit(w, t)
    if any_of:
        anyc = F.lit(False)
        for t in any_of:
            anyc = anyc | _term_hit(w, t)
        cond = cond & anyc
    for t in none_of:
        cond = cond & ~_term_hit(w, t)
    if countries:
        cond = cond & F.col("country").isin(list(countries))
    return cond


def keyword_search(posts: DataFrame, all_of=(), any_of=(), none_of=(), countries=(), n: int | None = MAX_SEARCH_RESULTS) -> DataFrame:
    """Matches, newest first, at most ``n`` (the API's page cap);
    ``n=None`` returns every hit."""
    hits = posts.where(search_predicate(all_of, any_of, none_of, countries))
    return hits.orderBy(*newest_first()).limit(n) if n is not None else hits


def search_sentiment(posts: DataFrame, sentiment: str | None = None, **search) -> DataFrame:
    """The search with a wished sentiment. The argument is accepted and
    has no effect, as in the reference."""
    return keyword_search(posts, **search)


def country_filter(posts: DataFrame, countries) -> DataFrame:
    """B7."""
    return posts.where(F.col("country").isin(list(countries)))


def bbox_filter(posts: DataFrame, lon: float, lat: float, p1: float, p2: float, count: int) -> DataFrame:
    """Inside the box (lon, lat)-(p1, p2), newest ``count``."""
    inside = F.col("lon").between(min(lon, p1), max(lon, p1)) & F.col("lat").between(min(lat, p2), max(lat, p2))
    return posts.where(inside).orderBy(*newest_first()).limit(count)


def thread_replies(posts: DataFrame, conversation_ids: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """All posts of the requested conversations unless already complete."""
    want = conversation_ids.select("conversation_id").distinct()
    if completed is not None:
        want = want.join(completed.select("conversation_id"), "conversation_id", "left_anti")
    return posts.join(want, "conversation_id", "left_semi")


def search_with_replies(posts: DataFrame, completed: DataFrame | None = None, lang: str = "en", **search) -> DataFrame:
    """Every hit (any language) plus the threads of the English hits."""
    hits = keyword_search(posts, n=None, **search)
    convs = hits.where(F.col("lang") == lang).select("conversation_id")
    replies = thread_replies(posts, convs, completed)
    return hits.unionByName(replies).dropDuplicates(["id"])


def author_with_replies(posts: DataFrame, users: DataFrame, username: str, completed: DataFrame | None = None, count: int = MAX_SEARCH_RESULTS) -> DataFrame:
    """The user's newest posts and the threads of each (no language test)."""
    u = user_by_name(users, username).select(F.col("id").alias("author_id"))
    recent = recent_by_author(posts, count, u)
    replies = thread_replies(posts, recent.select("conversation_id"), completed)
    return recent.unionByName(replies).dropDuplicates(["id"])


def multi_seed_search(posts: DataFrame, seeds: DataFrame, completed: DataFrame | None = None,
                      users: DataFrame | None = None, usernames: DataFrame | None = None,
                      lang: str = "en", max_broadcast_seeds: int = 100_000, newest: int = MAX_SEARCH_RESULTS,
                      words: DataFrame | None = None) -> DataFrame:
    """B10 for every seed term and B11 for every user name, one store.

    Seeds are a table, joined to the exploded distinct words of each post (no
    per-seed loop). Seed and author lists are user input; they are broadcast
    only under a checked size. A user name reaches its ``newest`` posts. ``words`` (id, lang, conversation_id,
    term) stands in for the words of the posts where an index has them. Output: one row per reached post with the sorted seeds that
    reached it (``seeds``)."""
    sd = seeds.select(F.lower(F.col(seeds.columns[0])).alias("seed")).distinct()
    # a plain word also matches its hashtag
    terms = sd.select("seed", F.col("seed").alias("term")).unionByName(
        sd.where(~F.col("seed").rlike("^[#@]")).select("seed", F.concat(F.lit("#"), F.col("seed")).alias("term"))
    )
    terms = bounded_broadcast(terms, max_broadcast_seeds)
    if words is None:
        words = posts.select("id", "lang", "conversation_id", F.explode(F.array_distinct(split_words(F.col("text")))).alias("term"))
    # narrow rows that three later steps read: written once
    hits = materialize(words.join(terms, "term").select("id", "lang", "conversation_id", "seed"))
    reached = hits.select("id", "seed")
    convs = hits.where(F.col("lang") == lang).select("seed", "conversation_id")
    if users is not None and usernames is not None:
        names = usernames.select(F.col(usernames.columns[0]).alias("username")).distinct()
        authors = users.join(names, "username").select(F.col("id").alias("author_id"), F.concat(F.lit("@"), "username").alias("seed"))
        w = Window.partitionBy("author_id").orderBy(*newest_first())
        recent = (posts.select("id", "author_id", "conversation_id", "created_at").join(bounded_broadcast(authors, max_broadcast_seeds), "author_id")
                  .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= newest))
        recent = materialize(recent.select("id", "conversation_id", "seed"))
        reached = reached.unionByName(recent.select("id", "seed"))
        convs = convs.unionByName(recent.select("seed", "conversation_id"))
    convs = convs.distinct()
    if completed is not None:
        convs = convs.join(completed.select("conversation_id"), "conversation_id", "left_anti")
    replies = posts.select("id", "conversation_id").join(convs, "conversation_id").select("id", "seed")
    return reached.unionByName(replies).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("seed")), ",").alias("seeds"))


def mark_complete(store: DataFrame, completed: DataFrame, flag: str = "conversation_complete") -> DataFrame:
    """Flag every row of a completed conversation; create the flag false."""
    c = completed.select("conversation_id").distinct().withColumn("_hit", F.lit(True))
    base = store if flag in store.columns else store.withColumn(flag, F.lit(False))
    j = base.join(c, "conversation_id", "left")
    return j.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def conversation_done(store: DataFrame, flag: str = "conversation_complete") -> DataFrame:
    """Per conversation, whether any of its rows is flagged."""
    return store.groupBy("conversation_id").agg(F.bool_or(F.coalesce(F.col(flag), F.lit(False))).alias("done"))


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (MapType, VariantType, CalendarIntervalType))


def row_order(df: DataFrame, cols: Iterable[str]) -> list[Column]:
    """Columns that put rows in a total order whatever their types: maps and variants go by their JSON text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [F.col(c) if _orderable(kinds[c]) else F.to_json(F.struct(F.col(c))) for c in cols]


def store_upsert(store: DataFrame, batch: DataFrame, batch_col: str = "batch", key_cols=("id",)) -> DataFrame:
    """Add rows under their id; the latest batch wins. Within a batch the
    newest ``created_at`` wins, then the greatest row by its other columns in
    name order (columns of any type), so the winner never depends on the partitioning."""
    u = store.unionByName(batch, allowMissingColumns=True)
    first = [batch_col] + [c for c in ["created_at"] if c in u.columns]
    total = first + sorted(c for c in u.columns if c not in {*key_cols, *first})
    w = Window.partitionBy(*key_cols).orderBy(*[c.desc_nulls_last() for c in row_order(u, total)])
    return u.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def hydrate_labels(labels: DataFrame, posts: DataFrame, id_col: str = "tweet_id", prefix: str = "post_") -> DataFrame:
    """A label file keyed by post id, left-joined to the store. Posts not
    found keep nulls, also for an id that is no id of the store's type; overlapping columns of the store get ``prefix``."""
    lab = labels.withColumn("id", F.col(id_col).try_cast(posts.schema["id"].dataType)).drop(id_col)
    overlap = (set(lab.columns) & set(posts.columns)) - {"id"}
    p = posts.select(*[F.col(c).alias(prefix + c) if c in overlap else F.col(c) for c in posts.columns])
    return lab.join(p, "id", "left")


# Types of the preset fields; all others, nested ones too, come as JSON text.
FIELD_TYPES = {
    "id": "bigint", "author_id": "bigint", "conversation_id": "bigint", "in_reply_to_user_id": "bigint", "pinned_tweet_id": "bigint",
    "possibly_sensitive": "boolean", "protected": "boolean", "verified": "boolean",
    "public_metrics": "map<string,bigint>", "non_public_metrics": "map<string,bigint>", "organic_metrics": "map<string,bigint>",
    "promoted_metrics": "map<string,bigint>",
}


def project_fields(df: DataFrame, fields: Iterable[str], json_col: str | None = None) -> DataFrame:
    """Requested field list (a preset or any names) -> columns. With
    ``json_col`` the fields are read from its JSON objects; an absent field is
    null with the type of the field."""
    fields = list(fields)
    kind = lambda f: FIELD_TYPES.get(f, "string")
    if json_col is not None:
        parsed = F.from_json(F.col(json_col), ", ".join(f"`{f}` {kind(f)}" for f in fields))
        return df.select(parsed.alias("_p")).select(*[F.col("_p")[f].alias(f) for f in fields])
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast(kind(f)).alias(f) for f in fields])
