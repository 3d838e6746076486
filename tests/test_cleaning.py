"""Cleaning: hand-made cases."""

import re

from threadmill.functions import emoji as E
from threadmill.functions import patterns as P
from threadmill.operators import clean as C
from threadmill.sources import views as V
from tests.conftest import SMALL


def run(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["o"] for r in df.select("i", fn("text").alias("o")).orderBy("i").collect()]


def test_masks(spark):
    out = run(spark, ["#", "##a", "a@b.c", "rtx", "https://wwwfoo.com", "see www.ab.com now", "@bob\nhello x"], C.mask_text)
    assert out[0] == "[TAG] "
    assert out[1] == "[TAG] [TAG] a"
    assert out[2] == "a[MEN].c"
    assert out[3] == "[RT]x"
    assert out[4] == "https://wwwfoo.com"
    assert out[5] == "see [URL] now"
    assert out[6] == "[MEN] x"


def test_emoji_quirks(spark):
    df = spark.createDataFrame([(0, ":[URL]"), (1, "expect"), (2, ":-)"), (3, "hi :)"), (4, "a \U0001F600 b")], "i int, text string")
    out = [r["text"] for r in C.replace_emoji(df).orderBy("i").collect()]
    assert out[0] == "sad faceURL]"
    assert out[1] == "etongue faceect"
    assert out[2] == ":-)"
    assert out[3] == "hi happy face"
    assert out[4] == "a  grinning face  b"


def test_emoji_equals_sequential_pass(spark):
    """The fast path equals one literal replace per dictionary entry, in order."""
    import random

    rnd = random.Random(7)
    ents = E.unicode_emoji_entries() + E.emoticon_entries()
    alphabet = list("abcxpd:;()=-[]38 ") + ["‑", "\U0001F600", "☀", "\U0001F62E"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(300)]

    def slow(t):
        for k, v in ents:
            t = t.replace(k, v)
        return t

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["text"] for r in C.replace_emoji(df).orderBy("i").collect()]
    assert got == [slow(t) for t in texts]


def test_hashtags_are_named_at_each_sign(spark):
    """Each '#' starts a tag that ends at the next stop sign, and the sign itself is a stop sign: so the pieces between '#' follow their mark."""
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab #@.x") for _ in range(rnd.randint(0, 20))) for _ in range(300)]
    assert run(spark, texts, C.mask_hashtags) == ["[TAG] ".join(t.split("#")) for t in texts]


def test_url_pattern_re2_form_agrees(spark):
    import random

    import duckdb

    rnd = random.Random(11)
    pieces = ["http://", "https://", "www.", "ww", "w", "a", "b-", "9", ".", "com", "/x", " ", "-", "..", "x"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 8))) for _ in range(2000)]
    spark_out = run(spark, texts, C.mask_urls)
    con = duckdb.connect()
    duck = [r[0] for r in con.execute("SELECT regexp_replace(t, ?, '[URL]', 'g') FROM unnest(?) AS u(t)", [P.URL_PATTERN_RE2, texts]).fetchall()]
    py = [re.sub(P.URL_PATTERN, "[URL]", t) for t in texts]
    assert spark_out == py
    assert sorted(duck) == sorted(py)


def test_drop_repeated_removes_every_copy(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, text string")
    out = C.drop_repeated_text(df)
    assert out.columns == ["id", "text"] and [tuple(r) for r in out.collect()] == [(3, "b")]


def test_drop_repeated_viral_text(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 50 = 0, concat('t', id), 'viral') AS text", "if(id = 50, null, id) AS extra")
    got = {r["id"]: (r["text"], r["extra"]) for r in C.drop_repeated_text(df).collect()}
    assert got == {i: (f"t{i}", None if i == 50 else i) for i in range(0, 5000, 50)}


def test_clean_posts_scans_once(spark):
    plan = C.clean_posts(V.posts(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_emoji_sequences_and_dictionary(spark):
    flag, family, tone, star, check, box = "\U0001F1E9\U0001F1EA", "\U0001F468\u200d\U0001F469", "\U0001F44D\U0001F3FD", "\u2b50", "\u2713", "\u2610"
    rows = [f"a{flag}b", f"{family}", tone, star, check, box, "\u2764\ufe0f", "\u231a \u00a9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    got = [r["text"] for r in C.replace_emoji(df, emoticons=[]).orderBy("i").collect()]
    assert got[4:6] == [check, box]
    assert got[3] == " white medium star " and got[7] == " watch   copyright sign "
    assert got[0].startswith("a regional indicator") and got[2].count("emoji modifier") == 1
    assert got[6] == " heavy black heart " and got[1] == " man  woman "
    entries = [(flag, " germany "), ("\U0001F1E9", " d "), (family, " couple "), ("couple", "pair")]
    got = [r["text"] for r in C.replace_emoji(df, emoji_entries=entries, emoticons=[]).orderBy("i").collect()]
    assert got[0] == "a germany b" and got[1] == " pair " and got[2] == tone
    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(entries)], "ord int, k string, v string")
    assert [r["text"] for r in C.replace_emoji(df, emoji_entries=table, emoticons=[]).orderBy("i").collect()] == got


def test_drop_empty_before_masks_is_equivalent(spark):
    texts = ["", " ", "#", "@", "rt", "http://ab.cd"]
    masked = run(spark, texts, C.mask_text)
    assert [m == "" for m in masked] == [t == "" for t in texts]
