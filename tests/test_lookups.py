"""Tokens are looked up where their rows are, and pairs move packed sentences once."""

import random

from pyspark.sql import functions as F

from threadmill.operators import model as M
from threadmill.operators import sentences as S
from threadmill.operators import vocab as D
from threadmill.plans import encoders as EN

VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[URL]", "[RT]", "[TAG]", "[MEN]", "a", "b", "##b", "ab", "##ba", "abba"]


def vocab(spark):
    return spark.createDataFrame([(t, i) for i, t in enumerate(VOCAB)], "token string, id int")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ids_without_exploding(spark):
    rows = [(1, ["a", "no", "ab"]), (2, None), (3, []), (None, ["b"]), (4, ["a", "b"]), (4, ["a", "b"])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    got = D.tokens_to_ids(df, ["id"], "t", vocab(spark))
    assert {r["id"]: (r["t"], r["ids"]) for r in got.collect()} == {
        1: (["a", "no", "ab"], [9, 1, 12]), 2: (None, []), 3: ([], []), None: (["b"], [10]), 4: (["a", "b"], [9, 9, 10, 10])}
    assert "Generate" not in plan(got)
    one = D.tokens_to_ids(df.where("id < 4"), ["id"], "t", vocab(spark), unique=True)
    assert {r["id"]: r["ids"] for r in one.collect()} == {1: [9, 1, 12], 2: [], 3: []}
    assert "Aggregate" not in plan(one)


def test_pieces_without_exploding(spark):
    rows = [(1, "abba ab x"), (2, None), (3, ""), (4, "abbab " + "b" * 101), (5, "ba"), (5, "ba")]
    got = D.tokenize(spark.createDataFrame(rows, "id long, x string"), ["id"], "x", vocab(spark), ids="ids")
    assert {r["id"]: (r["tokens"], r["ids"]) for r in got.collect()} == {
        1: (["abba", "ab", "[UNK]"], [14, 12, 1]), 2: ([], []), 3: ([], []), 4: (["abba", "##b", "[UNK]"], [14, 11, 1]), 5: (["[UNK]", "[UNK]"], [1, 1])}
    assert "Generate" not in plan(got)


def test_long_sentences_are_looked_up_as_far_as_they_are_kept(spark):
    docs = spark.createDataFrame([(1, ".", [["a"] * n for n in (10, 62, 63, 5000)])], "id long, delim string, sentences array<array<string>>")
    rows = {r["sno"]: r for r in EN.masked_corpus(docs, ["id"], vocab(spark)).collect()}
    assert [rows[i]["length"] for i in range(4)] == [12, 64, 64, 64]
    assert [rows[i]["ids"][-1] for i in range(4)] == [3] * 4 and rows[3]["ids"] == [2] + [9] * 62 + [3]
    assert len(rows[3]["tokens"]) == 5002


def test_pairs_with_cut_sentences_encode_alike(spark):
    rnd = random.Random(5)
    data = [(i, ".", [[rnd.choice("ab") for _ in range(rnd.choice([10, 30, 31, 61, 62, 300]))] for _ in range(4)]) for i in range(12)]
    docs = spark.createDataFrame(data, "id long, delim string, sentences array<array<string>>")
    plain = S.pair_dataset(docs, ["id"], 42)
    due = {}
    for r in plain.collect():
        a, b = r["A"], r["B"]
        while len(a) + len(b) > 61:
            a, b = (a[:-1], b) if len(a) > len(b) else (a, b[:-1])
        due[r["id"], r["pno"], r["y"]] = (r["rank"], ["[CLS]", *a, "[SEP]", *b, "[SEP]"])
    got = EN.encode_pairs(docs, ["id"], vocab(spark), 42)
    assert {(r["id"], r["pno"], r["y"]): (r["rank"], r["tokens"]) for r in got.collect()} == due
    # sentences that are moved, as one string each
    assert len(due) == 12 * 3 * 2


def test_common_and_rare_tokens_score_alike(spark, monkeypatch):
    train = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["b", "c"]), (1, ["d", "b"])], "y int, tokens array<string>")
    test = spark.createDataFrame([(1, ["a", "c", "z"]), (2, []), (3, ["b", "b", "d"])], "id long, tokens array<string>")
    model = M.train_classifier(train)
    whole = {r["id"]: r["scores"] for r in M.score_classifier(model, test, ["id"]).collect()}
    monkeypatch.setattr(M, "COMMON_TOKENS", 1)
    part = {r["id"]: r["scores"] for r in M.score_classifier(model, test, ["id"]).collect()}
    assert whole.keys() == part.keys() == {1, 2, 3}
    assert all(abs(a - b) < 1e-12 for k in whole for a, b in zip(whole[k], part[k]))


def test_tiles_do_not_copy_the_pairs_for_each_block():
    pairs, samples = 10_000_000, 2_000_000
    slices, blocks = M.tile_counts(10**11, pairs, samples, 12, 2_000_000, 20_000_000)
    assert slices == 5 and blocks * pairs <= max(slices * samples, 12 * 2_000_000) + pairs
    assert M.tile_counts(0, 0, 0, 8, 50, 300) == (1, 8)


def test_tokens_are_made_after_the_pieces_met(spark):
    df = spark.createDataFrame([(1, "one two three. four five"), (1, "one two three. four five"), (2, None)], "id long, x string")
    pieces = S.split_sentences(df.repartition("id"), ["id"], "x", (".",))
    words = lambda p: F.split(F.trim(p), " ")
    late = S.documents_of_sentences(pieces, ["id"], "piece", 1, words)
    early = S.documents_of_sentences(pieces.withColumn("tokens", words(F.col("piece"))), ["id"], "tokens", 1)
    assert late.collect() == early.collect() and late.count() == 1
