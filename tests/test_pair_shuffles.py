"""What moves while sentence pairs are made and encoded."""

from pyspark.sql import functions as F

from threadmill.functions import patterns as P
from threadmill.operators import sentences as S
from threadmill.plans import encoders as EN
from threadmill.plans import q_model as Q
from threadmill.plans.catalog import load_all

from .conftest import SMALL

TEXT = "one two three. four five. six seven eight nine"


def _vocab(spark):
    words = [*P.SPECIAL_TOKENS, *TEXT.replace(".", " .").split()]
    return spark.createDataFrame(list(dict(zip(words, range(len(words)))).items()), "token string, id int")


def _docs(spark):
    df = spark.createDataFrame([(k, TEXT) for k in (1, 2, None)], "id long, x string")
    return EN.sentence_docs(df, ["id"], "x", _vocab(spark), min_length=1, repair=False)


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_encode_pairs_moves_texts_once_and_no_tokens(spark):
    docs = _docs(spark)
    assert _plan(docs, "executedPlan").count("Exchange hashpartitioning") == 1
    rows = {r["id"]: [[t["piece"] for t in s] for s in r["sentences"]] for r in docs.collect()}
    assert rows == dict.fromkeys((1, 2, None), [s.split() for s in TEXT.split(".")])


def test_encode_pairs_topic_looks_ids_up_once(spark):
    pairs = EN.encode_pairs(_docs(spark), ["id"], _vocab(spark))
    assert _plan(pairs).count("look_up") <= 2  # the step and the name of its column
    assert "Window" not in _plan(pairs)
    names = {r["id"]: r["token"] for r in _vocab(spark).collect()}
    rows = pairs.collect()
    assert len(rows) == 12 and sorted(r["rank"] for r in rows) == list(range(1, 13))
    for r in rows:
        n = len(r["tokens"])
        assert [names[i] for i in r["x"][:n]] == r["tokens"] and not any(r["x"][n:]) and sum(r["input_mask"]) == n


def test_pairs_for_the_classifier_are_kept_without_their_rank(spark):
    load_all()
    plan = _plan(Q.pair_rows(spark, SMALL).select("pid", "feats"))
    assert "rank" not in plan and "Join" not in plan


def test_truncated_pairs_rank_their_places_once(spark):
    docs = spark.createDataFrame([(k, ".", [f"{k} {i}" for i in range(4)]) for k in (1, 2, None)], "id long, delim string, sentences array<string>")
    pairs = S.pair_dataset(docs, ["id"])
    assert "Window" not in _plan(pairs)
    rows = pairs.collect()
    assert len(rows) == 18 and sorted(r["rank"] for r in rows) == list(range(1, 19))
    for r in rows:
        if r["y"]:
            assert (r["A"], r["B"]) == (f"{r['id']} {r['pno'] - 1}", f"{r['id']} {r['pno']}")
        else:
            assert r["A"].split()[0] != r["B"].split()[0]
