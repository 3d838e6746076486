"""Emoticons that cannot be in a text are not looked for, and the result is that of the whole chain of replaces."""

import random

from pyspark.sql import functions as F

from threadmill.functions import emoji as E
from threadmill.operators import clean as C

OWN = [("ab", "b:"), (":", "x"), ("x;", ""), (";", "ab"), ("^^", "^")]


def test_the_same_text_as_the_whole_chain(spark):
    draw = random.Random(3)
    keys = [k for k, _ in E.emoticon_entries()]
    texts = [None, "", "X3  >:3", "::)", ":‑)", "8)D:", *keys, *("".join(k) for k in zip(keys, keys[1:]))]
    texts += ["".join(draw.choices([*":;=8-)(>xdpDX3o^ ‑'", *keys, "word ", "[URL]", "😀"], k=draw.randrange(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for emoticons in (None, OWN, [("a", "a b"), ("b", "a")], []):
        got = {r["i"]: r["text"] for r in C.replace_emoji(df, emoji_entries=[], emoticons=emoticons).collect()}
        for i, want in enumerate(texts):
            for k, v in (E.emoticon_entries() if emoticons is None else emoticons) if want is not None else ():
                want = want.replace(k, v)
            assert got[i] == want, texts[i]


def test_few_emoticons_are_looked_for(spark):
    df = spark.createDataFrame([("plain words with no face",), ("one :)",)], "text string")
    assert [r["m"] for r in df.select(E.emoticon_marks("text").alias("m")).collect()] == ["", ":)"]
    plan = C.replace_emoji(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") <= 4  # the marks are made once, not once an emoticon
    assert C.replace_emoji(df).columns == ["text"]
