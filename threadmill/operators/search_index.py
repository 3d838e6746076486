"""Word index of a post store: the searches B5, B10 and B12 without a read of every text.

``build_index`` writes one narrow row (posting) for each word of each post:
term, id, copy, created_at, country, lang, conversation_id. ``copy`` is the
XXH64 of the text, so rows that share an id keep their own words. Each post also
has a posting under ``WITH_TEXT`` or ``NO_TEXT``, which no search term can equal; searches
that only exclude, and threads, read these instead of the posts.

Postings lie in ``buckets`` folders by a hash of the term and are sorted by term,
so a search lists only the folders of its own terms and skips row groups inside them. A
word that most posts hold is dealt over ``lanes`` files by the id: no task writes
or reads a list alone. Choose ``buckets`` so that a folder is a few hundred MB.

Hits are one grouping of the terms' postings by post: every clause is a flag that
any posting can raise, so AND, OR and NOT need one shuffle of the listed posts,
however many terms there are. Results equal those of the searches that read texts
(``store.keyword_search``), also for null texts, repeated rows, null ids and empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators import store as S

#: Terms of the postings that stand for a whole post. Words hold no line break.
WITH_TEXT, NO_TEXT = "\n1", "\n0"
CARRIED = ["created_at", "country", "lang", "conversation_id"]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(posts: DataFrame) -> DataFrame:
    """One row for each distinct word of each post, and one for the post itself."""
    whole = F.array(F.when(F.col("text").isNull(), F.lit(NO_TEXT)).otherwise(F.lit(WITH_TEXT)))
    words = F.array_distinct(F.coalesce(S.split_words(F.col("text")), F.array().cast("array<string>")))
    # the copy is taken before the words are exploded: texts do not travel with the postings
    return posts.select(F.explode(F.concat(whole, words)).alias("term"), "id", F.xxhash64("text").alias("copy"), *CARRIED)


def _write(posts: DataFrame, path: str, buckets: int, lanes: int, mode: str) -> None:
    rows = postings(posts).withColumn("bucket", _bucket(F.col("term"), buckets))
    lane = F.pmod(F.xxhash64("id", "copy"), F.lit(lanes))
    rows = rows.repartition(min(buckets * lanes, 2000), "bucket", lane).sortWithinPartitions("bucket", "term")
    rows.write.mode(mode).partitionBy("bucket").parquet(f"{path}/{_folder(buckets)}")


def _folder(buckets: int) -> str:
    return f"postings-{buckets}"


def build_index(posts: DataFrame, path: str, buckets: int = 256, lanes: int = 8) -> SearchIndex:
    """Index all posts, in place of what lies there."""
    _write(posts, path, buckets, lanes, "overwrite")
    return SearchIndex(posts.sparkSession, path, buckets, posts.schema)


def extend_index(index: SearchIndex, posts: DataFrame, lanes: int = 8) -> SearchIndex:
    """Add new posts. Posts that are already in it do no harm: equal postings of a post fold
    into one hit, so a replayed batch changes no result. A post with a new text is a new copy;
    the old one is only found as long as the posts that are searched hold it."""
    _write(posts, index.path, index.buckets, lanes, "append")
    return index


class SearchIndex:
    """A written index: its path, number of buckets and the types of the posts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, schema):
        self.spark, self.path, self.buckets = spark, path, buckets
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.schema = "term string, copy bigint, bucket int, " + ", ".join(f"`{c}` {kinds[c]}" for c in ["id", *CARRIED])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{_folder(self.buckets)}")

    def lists(self, terms) -> DataFrame:
        """Postings of the terms. The buckets are constants of the plan: other folders are not listed."""
        terms = sorted(set(terms))
        if not terms:
            return self.rows().where(F.lit(False))
        mine = F.lit(False)
        for t in terms:
            mine = mine | (F.col("bucket") == _bucket(F.lit(t), self.buckets))
        return self.rows().where(mine & F.col("term").isin(terms))


def _forms(term: str) -> list[str]:
    """A plain word also finds its hashtag."""
    t = term.lower()
    return [] if t in (WITH_TEXT, NO_TEXT) else [t] if t.startswith(("#", "@")) else [t, "#" + t]


def find(index: SearchIndex, all_of=(), any_of=(), none_of=(), countries=()) -> DataFrame:
    """id, copy and the carried columns of every post that fits, one row each."""
    need = [_forms(t) for t in all_of] + ([[f for t in any_of for f in _forms(t)]] if any_of else [])
    bar = [f for t in none_of for f in _forms(t)]
    # only exclusions: all posts with a text, for a null text fits no exclusion; no terms at all: all posts
    whole = [] if need else [WITH_TEXT] if none_of else [WITH_TEXT, NO_TEXT]
    rows = index.lists([*whole, *bar, *(f for group in need for f in group)])
    if countries:
        rows = rows.where(F.col("country").isin(list(countries)))
    groups = need or [whole]
    has = lambda forms: F.bool_or(F.col("term").isin(forms) if forms else F.lit(False))
    flags = [has(g).alias(f"_need{i}") for i, g in enumerate(groups)] + [has(bar).alias("_bar")]
    hits = rows.groupBy("id", "copy", *CARRIED).agg(*flags)
    fits = ~F.col("_bar")
    for i in range(len(groups)):
        fits = fits & F.col(f"_need{i}")
    return hits.where(fits).select("id", "copy", *CARRIED)


def _rows_of(posts: DataFrame, hits: DataFrame) -> DataFrame:
    h = hits.select(F.col("id").alias("_hit_id"), F.col("copy").alias("_hit_copy"))
    return posts.join(h, F.col("id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_copy")), "left_semi")


def keyword_search(index: SearchIndex, posts: DataFrame, all_of=(), any_of=(), none_of=(), countries=(),
                   n: int | None = S.MAX_SEARCH_RESULTS) -> DataFrame:
    """As ``store.keyword_search``. The newest ``n`` are chosen on the narrow
    postings; then at most ``n`` keys meet the posts."""
    hits = find(index, all_of, any_of, none_of, countries)
    if n is None:
        return _rows_of(posts, hits)
    # n is the page size that the caller asks for, and so the bound of what is broadcast
    newest = hits.orderBy(*S.newest_first()).limit(n)
    newest = F.broadcast(newest) if n <= 100_000 else newest
    return _rows_of(posts, newest).orderBy(*S.newest_first()).limit(n)


def search_with_replies(index: SearchIndex, completed: DataFrame | None = None, lang: str = "en", **search) -> DataFrame:
    """Id and conversation_id of every hit and of the threads of the hits in ``lang``. No text is read."""
    hits = find(index, **search)
    threads = hits.where(F.col("lang") == lang).select("conversation_id")
    replies = S.thread_replies(index.lists([WITH_TEXT, NO_TEXT]), threads, completed)
    cols = ["id", "conversation_id"]
    return hits.select(*cols).unionByName(replies.select(*cols)).dropDuplicates(["id"])


def multi_seed_search(index: SearchIndex, seeds: DataFrame, completed: DataFrame | None = None, lang: str = "en", max_seeds: int = 100_000) -> DataFrame:
    """B12 for search terms: id and the sorted seeds that reached it, from the index alone.
    Up to ``max_seeds`` seeds (counted) only their buckets are read, else all."""
    sd = seeds.select(F.lower(F.col(seeds.columns[0])).alias("seed")).where(~F.col("seed").startswith("\n")).distinct()
    rows = index.rows()
    if sd.limit(max_seeds + 1).count() <= max_seeds:
        either = F.explode(F.array("seed", F.concat(F.lit("#"), F.col("seed"))))
        mine = [r["b"] for r in sd.select(either.alias("t")).select(_bucket(F.col("t"), index.buckets).alias("b")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(mine))
    words = rows.select("id", "lang", "conversation_id", "term")
    everything = index.lists([WITH_TEXT, NO_TEXT]).select("id", "conversation_id")
    return S.multi_seed_search(everything, sd, completed, lang=lang, max_broadcast_seeds=max_seeds, words=words)
