"""Packed sentences: the same tokens and the same merged sentences, made once."""

import random

from pyspark.sql import functions as F

from threadmill.functions import tokens as T
from threadmill.operators import sentences as S

TEXTS = ["", " ", ". ;", "a.b", " A  b\t\nc,,d. ", "Caf\u00e9 \u00c5l \u2026 x\u2019y", "x [SEP] y[sep]", "\u4e2d\u6587 ok", "e\u0301\u200b!", "\u0391\u03a3. b", "no\u00a0break", None]


def test_packed_tokens_are_the_tokens_with_one_blank_between(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for args in ((True, True, True), (False, False, False), (True, False, True)):
        rows = df.select(F.array_join(T.pretokenize(F.col("t"), *args), " ").alias("due"), T.packed_tokens(F.col("t"), *args).alias("got")).collect()
        assert [r["got"] for r in rows] == [r["due"] for r in rows]


def test_packed_sentences_merge_like_lists(spark):
    rnd = random.Random(3)
    docs = [(i, [["w%d" % rnd.randint(0, 9)] * rnd.choice([0, 1, 2, 5, 9]) for _ in range(rnd.randint(0, 9))]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(docs, "i int, s array<array<string>>").repartition(3)
    for least in (0, 1, 5):
        due = {r["i"]: [" ".join(x) for x in r["m"] or []] for r in df.select("i", S.merge_short_sentences(F.col("s"), least).alias("m")).collect()}
        got = {r["i"]: r["m"] for r in df.select("i", S.merge_packed(F.transform("s", S.pack), least).alias("m")).collect()}
        assert got == due


def _docs(spark):
    df = spark.createDataFrame([(1, "a b. c d. e f g"), (1, "x y. z"), (2, "a."), (3, " . ")], "id long, x string")
    pieces = S.split_sentences(df.repartition("id"), ["id"], "x", ["."])
    return S.documents_of_sentences(pieces, ["id"], "piece", 2, lambda p: T.packed_tokens(p), packed=True)


def _tokenised(df) -> int:
    """How often the plan holds the step that makes tokens."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") // _docs(df.sparkSession)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")


def test_adjacent_pairs_make_their_sentences_once(spark):
    pairs = S.adjacent_pairs(_docs(spark), ["id"])
    assert _tokenised(pairs) == 1
    got = {(r["id"], r["delim"], r["pno"]): (r["A"], r["B"]) for r in pairs.collect()}
    assert got == {(1, ".", 1): ("a b", "x y"), (1, ".", 2): ("x y", "c d z"), (1, ".", 3): ("c d z", "e f g")}


def test_documents_of_two_sentences_make_them_once(spark):
    docs = S.min_two_sentences(_docs(spark))
    assert _tokenised(docs) == 1
    assert [(r["id"], r["delim"], r["sentences"]) for r in docs.collect()] == [(1, ".", ["a b", "x y", "c d z", "e f g"])]
