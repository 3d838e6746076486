"""Registered queries: post-store queries (B1-B16) and field projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill import oracle as O
from threadmill.operators import labels as L
from threadmill.operators import search_index as X
from threadmill.operators import store as S
from threadmill.plans.catalog import register
from threadmill.plans.q_clean import ts_sql, ts_str
from threadmill.session import scratch_path
from threadmill.sources import views as V

WORDS_SQL = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_#@]+')"


def hit_sql(term: str) -> str:
    t = term.lower()
    s = f"list_contains({WORDS_SQL}, {O.q(t)})"
    if not t.startswith(("#", "@")):
        s = f"({s} OR list_contains({WORDS_SQL}, {O.q('#' + t)}))"
    return s


def search_sql(all_of=(), any_of=(), none_of=(), countries=()) -> str:
    parts = [hit_sql(t) for t in all_of]
    if any_of:
        parts.append("(" + " OR ".join(hit_sql(t) for t in any_of) + ")")
    parts += [f"NOT {hit_sql(t)}" for t in none_of]
    if countries:
        parts.append("country IN (" + ", ".join(O.q(c) for c in countries) + ")")
    return " AND ".join(parts) or "TRUE"


SEARCH = dict(all_of=["the"], any_of=["#topic1", "#topic4", "topic7"], none_of=["with"], countries=["US", "MX", "CA"])
SEED_SEARCH = dict(any_of=["#topic3"])
SEEDS = ["#topic1", "topic6", "und"]
SEED_USERS = ["user_3", "user_11"]
BASE = f"{O.POSTS}, {O.USERS}, {O.COMPLETED}"


@register("user_by_name", f"WITH {BASE} SELECT id, username FROM users WHERE username = 'user_7'")
def q_user(spark, sf):
    return S.user_by_name(V.users(spark, sf), "user_7", ["id", "username"])


@register("recent_by_author", f"""WITH {BASE} SELECT id, author_id, {ts_sql()} FROM posts
QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY created_at DESC, id DESC) <= 5""")
def q_recent(spark, sf):
    return S.recent_by_author(V.posts(spark, sf), 5).select("id", "author_id", ts_str())


@register("post_by_id", f"WITH {BASE} SELECT id, text FROM posts WHERE id IN (SELECT doc_id FROM labels)")
def q_post_by_id(spark, sf):
    ids = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id")
    return S.post_by_id(V.posts(spark, sf), ids).select("id", "text")


@register("conversation_root", f"""WITH {BASE} SELECT p.id, r.id AS root_id, r.author_id AS root_author_id, r.text AS root_text
FROM posts p LEFT JOIN posts r ON p.conversation_id = r.id""")
def q_root(spark, sf):
    return S.conversation_root(V.posts(spark, sf)).select("id", "root_id", "root_author_id", "root_text")


@register("keyword_search", f"""WITH {BASE} SELECT id, {ts_sql()}, text FROM posts WHERE {search_sql(**SEARCH)}
ORDER BY created_at DESC, id DESC LIMIT 100""")
def q_search(spark, sf):
    return S.keyword_search(V.posts(spark, sf), n=100, **SEARCH).select("id", ts_str(), "text")


@register("country_filter", f"WITH {BASE} SELECT id, country FROM posts WHERE country IN ('US', 'MX')")
def q_country(spark, sf):
    return S.country_filter(V.posts(spark, sf), ["US", "MX"]).select("id", "country")


@register("bbox_filter", f"""WITH {BASE} SELECT id, lon, lat FROM posts WHERE lon BETWEEN -100 AND -60 AND lat BETWEEN -10 AND 40
ORDER BY created_at DESC, id DESC LIMIT 100""")
def q_bbox(spark, sf):
    return S.bbox_filter(V.posts(spark, sf), -100, -10, -60, 40, 100).select("id", "lon", "lat")


@register("thread_replies", f"""WITH {BASE} SELECT id, conversation_id FROM posts
WHERE conversation_id IN (SELECT conversation_id FROM posts WHERE lang = 'en')
  AND conversation_id NOT IN (SELECT conversation_id FROM completed)""")
def q_replies(spark, sf):
    p = V.posts(spark, sf)
    return S.thread_replies(p, p.where(F.col("lang") == "en"), V.completed_conversations(p)).select("id", "conversation_id")


@register("search_with_replies", f"""WITH {BASE}, hits AS (SELECT * FROM posts WHERE {search_sql(**SEED_SEARCH)})
SELECT id, conversation_id FROM hits
UNION
SELECT id, conversation_id FROM posts
WHERE conversation_id IN (SELECT conversation_id FROM hits WHERE lang = 'en')
  AND conversation_id NOT IN (SELECT conversation_id FROM completed)""")
def q_search_replies(spark, sf):
    p = V.posts(spark, sf)
    return S.search_with_replies(p, V.completed_conversations(p), **SEED_SEARCH).select("id", "conversation_id")


@register("author_with_replies", f"""WITH {BASE}, recent AS (SELECT * FROM posts WHERE author_id IN (SELECT id FROM users WHERE username = 'user_7')
  QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY created_at DESC, id DESC) <= 100)
SELECT id, conversation_id FROM recent
UNION
SELECT id, conversation_id FROM posts
WHERE conversation_id IN (SELECT conversation_id FROM recent)
  AND conversation_id NOT IN (SELECT conversation_id FROM completed)""")
def q_author_replies(spark, sf):
    p = V.posts(spark, sf)
    return S.author_with_replies(p, V.users(spark, sf), "user_7", V.completed_conversations(p)).select("id", "conversation_id")


def _seed_sql() -> str:
    rows = []
    for s in SEEDS:
        t = s.lower()
        rows.append(f"({O.q(t)}, {O.q(t)})")
        if not t.startswith(("#", "@")):
            rows.append(f"({O.q(t)}, {O.q('#' + t)})")
    return "terms(seed, term) AS (VALUES " + ", ".join(rows) + ")"


MULTI_SEED_SQL = f"""WITH {BASE}, {_seed_sql()},
words AS (SELECT DISTINCT id, lang, conversation_id, unnest({WORDS_SQL}) AS term FROM posts),
hits AS (SELECT w.id, w.lang, w.conversation_id, t.seed FROM words w JOIN terms t ON t.term = w.term),
convs AS (SELECT DISTINCT seed, conversation_id FROM hits WHERE lang = 'en'
          AND conversation_id NOT IN (SELECT conversation_id FROM completed)),
authors AS (SELECT id AS author_id, '@' || username AS seed FROM users WHERE username IN ({', '.join(O.q(u) for u in SEED_USERS)})),
recent AS (SELECT p.id, p.conversation_id, a.seed FROM posts p JOIN authors a ON a.author_id = p.author_id
           QUALIFY row_number() OVER (PARTITION BY p.author_id ORDER BY p.created_at DESC, p.id DESC) <= 100),
uconvs AS (SELECT DISTINCT seed, conversation_id FROM recent WHERE conversation_id NOT IN (SELECT conversation_id FROM completed)),
reached AS (
  SELECT id, seed FROM hits
  UNION ALL SELECT p.id, c.seed FROM posts p JOIN convs c ON c.conversation_id = p.conversation_id
  UNION ALL SELECT id, seed FROM recent
  UNION ALL SELECT p.id, c.seed FROM posts p JOIN uconvs c ON c.conversation_id = p.conversation_id)
SELECT id, array_to_string(list_sort(list_distinct(list(seed))), ',') AS seeds FROM reached GROUP BY id"""


@register("multi_seed_search", MULTI_SEED_SQL)
def q_multi_seed(spark, sf):
    p = V.posts(spark, sf)
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "seed string")
    names = spark.createDataFrame([(u,) for u in SEED_USERS], "username string")
    return S.multi_seed_search(p, seeds, V.completed_conversations(p), V.users(spark, sf), names)


def _index(spark, sf):
    return X.build_index(V.posts(spark, sf), scratch_path(spark, "index"), buckets=32, lanes=2)


@register("index_keyword_search", f"""WITH {BASE} SELECT id, {ts_sql()}, text FROM posts WHERE {search_sql(**SEARCH)}
ORDER BY created_at DESC, id DESC LIMIT 100""")
def q_index_search(spark, sf):
    return X.keyword_search(_index(spark, sf), V.posts(spark, sf), n=100, **SEARCH).select("id", ts_str(), "text")


@register("index_exclusion_search", f"""WITH {BASE} SELECT id, conversation_id FROM posts WHERE {search_sql(none_of=["the", "#topic3"])}""")
def q_index_exclusion(spark, sf):
    return X.find(_index(spark, sf), none_of=["the", "#topic3"]).select("id", "conversation_id")


@register("index_search_with_replies", f"""WITH {BASE}, hits AS (SELECT * FROM posts WHERE {search_sql(**SEED_SEARCH)})
SELECT id, conversation_id FROM hits
UNION
SELECT id, conversation_id FROM posts
WHERE conversation_id IN (SELECT conversation_id FROM hits WHERE lang = 'en')
  AND conversation_id NOT IN (SELECT conversation_id FROM completed)""")
def q_index_replies(spark, sf):
    return X.search_with_replies(_index(spark, sf), V.completed_conversations(V.posts(spark, sf)), **SEED_SEARCH)


@register("index_multi_seed_search", f"""WITH {BASE}, {_seed_sql()},
words AS (SELECT DISTINCT id, lang, conversation_id, unnest({WORDS_SQL}) AS term FROM posts),
hits AS (SELECT w.id, w.lang, w.conversation_id, t.seed FROM words w JOIN terms t ON t.term = w.term),
convs AS (SELECT DISTINCT seed, conversation_id FROM hits WHERE lang = 'en'
          AND conversation_id NOT IN (SELECT conversation_id FROM completed)),
reached AS (
  SELECT id, seed FROM hits
  UNION ALL SELECT p.id, c.seed FROM posts p JOIN convs c ON c.conversation_id = p.conversation_id)
SELECT id, array_to_string(list_sort(list_distinct(list(seed))), ',') AS seeds FROM reached GROUP BY id""")
def q_index_multi_seed(spark, sf):
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "seed string")
    return X.multi_seed_search(_index(spark, sf), seeds, V.completed_conversations(V.posts(spark, sf)))


MARK_SQL = f"""marked AS (SELECT p.*, (p.conversation_id IN (SELECT conversation_id FROM completed)) AS conversation_complete FROM posts p)"""


@register("mark_complete", f"WITH {BASE}, {MARK_SQL} SELECT id, conversation_id, conversation_complete FROM marked")
def q_mark(spark, sf):
    p = V.posts(spark, sf)
    return S.mark_complete(p, V.completed_conversations(p)).select("id", "conversation_id", "conversation_complete")


@register("conversation_done", f"WITH {BASE}, {MARK_SQL} SELECT conversation_id, bool_or(conversation_complete) AS done FROM marked GROUP BY conversation_id")
def q_done(spark, sf):
    p = V.posts(spark, sf)
    return S.conversation_done(S.mark_complete(p, V.completed_conversations(p)))


@register("store_upsert", f"""WITH {BASE}, u AS (
  SELECT id, like_count, 0 AS batch FROM posts
  UNION ALL SELECT id, like_count + 1 AS like_count, 1 AS batch FROM posts WHERE conversation_id IN (SELECT conversation_id FROM completed))
SELECT id, like_count, batch FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC) = 1""")
def q_upsert(spark, sf):
    p = V.posts(spark, sf)
    store = p.select("id", "like_count", F.lit(0).alias("batch"))
    refetched = p.join(V.completed_conversations(p), "conversation_id", "left_semi").select(
        "id", (F.col("like_count") + 1).alias("like_count"), F.lit(1).alias("batch"))
    return S.store_upsert(store, refetched)


@register("hydrate_labels", f"""WITH {BASE}, {O.EXTERNAL_LABELS}, {O.HYDRATED} SELECT id, claim, toxic, text, lang FROM hydrated""")
def q_hydrate(spark, sf):
    return S.hydrate_labels(V.external_labels(spark, sf), V.posts(spark, sf)).select("id", "claim", "toxic", "text", "lang")


@register("project_fields", f"""WITH {BASE} SELECT id, author_id, conversation_id, {ts_sql()}, lang, text, CAST(NULL AS VARCHAR) AS attachments,
'{{"lon":' || CAST(lon AS VARCHAR) || ',"lat":' || CAST(lat AS VARCHAR) || '}}' AS geo,
CAST(retweet_count + reply_count + like_count + quote_count AS BIGINT) AS acknowledgments FROM posts""")
def q_project_fields(spark, sf):
    """Rows as the API gives them (JSON), read with the preset of public fields."""
    p = L.public_metrics(V.posts(spark, sf)).withColumns({"created_at": ts_str(), "geo": F.struct("lon", "lat")})
    rows = p.select(F.to_json(F.struct("id", "author_id", "conversation_id", "created_at", "lang", "text", "geo", "public_metrics")).alias("json"))
    out = S.project_fields(rows, S.TWEET_FIELDS_ALL_PUBLIC, "json")
    return out.select("id", "author_id", "conversation_id", "created_at", "lang", "text", "attachments", "geo", L.acknowledgments().alias("acknowledgments"))


@register("search_sentiment", f"""WITH {BASE} SELECT id, {ts_sql()}, text FROM posts WHERE {search_sql(**SEARCH)}
ORDER BY created_at DESC, id DESC LIMIT 100""")
def q_search_sentiment(spark, sf):
    return S.search_sentiment(V.posts(spark, sf), "positive", n=100, **SEARCH).select("id", ts_str(), "text")
