"""The word index answers every search as a read of all texts does."""

import datetime as dt
import random
import re

import pytest

from threadmill.operators import search_index as X
from threadmill.operators import store as S
from threadmill.session import scratch_path

SCHEMA = "id long, text string, lang string, country string, conversation_id long, created_at timestamp, extra map<string,string>"
WORDS = ["the", "Red", "#red", "@red", "bird", "BIRD", "a_b", "été", "#topic", "topic"]


def row(i, text, lang="en", country="US", conv=None, minute=None):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i if minute is None else minute)
    return (i, text, lang, country, conv if conv is not None else i, at, {"k": "v"})


@pytest.fixture(scope="module")
def posts(spark):
    draw = random.Random(5)
    rows = []
    for i in range(300):
        words = [draw.choice(WORDS) for _ in range(draw.randint(0, 6))] + ["common"] * (i % 3 == 0)
        rows.append(row(i, draw.choice([" ", ", ", "  - "]).join(words), draw.choice(["en", "fr", None]), draw.choice(["US", "MX", None]), draw.randint(0, 40), i % 50))
    rows += [row(400, None), row(401, ""), row(402, "  "), row(403, "the " * 20_000 + "end"), row(404, "\n0 \n1")]
    rows += [row(5, "another text of an id that is there"), row(405, "twice bird"), row(405, "twice bird"), row(None, "bird without id", minute=9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(spark, posts):
    return X.build_index(posts, scratch_path(spark, "test-index"), buckets=16, lanes=2)


def keys(df):
    return sorted(((r["id"], r["text"], r["created_at"]) for r in df.collect()), key=repr)


SEARCHES = [
    dict(all_of=["the"]), dict(all_of=["red", "bird"]), dict(any_of=["#red", "été"]), dict(all_of=["topic"], any_of=["a_b", "THE"], none_of=["@red"]),
    dict(none_of=["the"]), dict(none_of=["common"], countries=["US"]), dict(countries=["MX"]), dict(), dict(all_of=["nowhere"]),
    dict(all_of=["\n1"]), dict(any_of=["\n0", "\n1"]), dict(all_of=["common"], none_of=["common"]), dict(all_of=[""]), dict(all_of=["end"]),
]


@pytest.mark.parametrize("search", SEARCHES, ids=repr)
def test_equals_a_read_of_all_texts(posts, index, search):
    assert keys(X.keyword_search(index, posts, n=None, **search)) == keys(S.keyword_search(posts, n=None, **search))


def test_newest_n_is_cut_as_in_the_read(posts, index):
    for n in (0, 1, 7, 100):
        got = [r["created_at"] for r in X.keyword_search(index, posts, all_of=["the"], n=n).collect()]
        assert got == [r["created_at"] for r in S.keyword_search(posts, all_of=["the"], n=n).collect()]


def test_plain_python_count(posts, index):
    split = lambda t: set(re.split(r"[^\w#@]+", t.lower()))
    want = {r["id"] for r in posts.collect() if r["text"] is not None and {"bird", "#bird"} & split(r["text"]) and not {"the", "#the"} & split(r["text"])}
    assert {r["id"] for r in X.find(index, all_of=["bird"], none_of=["the"]).collect()} == want


def test_threads_and_seeds(spark, posts, index):
    done = spark.createDataFrame([(3,), (4,)], "conversation_id long")
    one = lambda df: {(r["id"]) for r in df.collect()}
    assert one(X.search_with_replies(index, done, any_of=["#topic"])) == one(S.search_with_replies(posts.drop("extra"), done, any_of=["#topic"]))
    seeds = spark.createDataFrame([("#red",), ("Bird",), ("common",), ("\n1",)], "s string")
    pairs = lambda df: sorted(map(tuple, df.select("id", "seeds").collect()), key=repr)
    want = pairs(S.multi_seed_search(posts, seeds, done))
    assert pairs(X.multi_seed_search(index, seeds, done)) == want
    assert pairs(X.multi_seed_search(index, seeds, done, max_seeds=1)) == want  # too many seeds: all buckets, a shuffled join


def test_a_search_lists_its_own_folders_only(index):
    hits = X.find(index, all_of=["bird"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    found = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S).group(1)
    assert "bucket" in found
    assert "In(term" in plan  # row groups without the terms are skipped
    files = {f for f in hits.inputFiles()}
    assert 0 < len({re.search(r"bucket=(\d+)", f).group(1) for f in index.lists(["bird", "#bird"]).inputFiles()}) <= 16
    assert files
    read = index.lists(["bird", "#bird"]).selectExpr("count(distinct bucket) b").first()["b"]
    assert read <= 2


def test_extending_twice_changes_no_result(spark, posts):
    path = scratch_path(spark, "test-index")
    first, later = posts.where("id < 100 or id is null"), posts.where("id >= 100")
    index = X.build_index(first, path, buckets=8, lanes=2)
    for _ in range(2):  # a replayed batch
        index = X.extend_index(index, later, lanes=2)
    for search in SEARCHES[:6]:
        assert keys(X.keyword_search(index, posts, n=None, **search)) == keys(S.keyword_search(posts, n=None, **search))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    index = X.build_index(none, scratch_path(spark, "test-index"), buckets=8)
    assert X.keyword_search(index, none, all_of=["the"]).count() == 0
    assert X.find(index, none_of=["the"]).count() == 0
