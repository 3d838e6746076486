"""Rows of any type and ids of any kind."""

from pyspark.sql import functions as F

from threadmill.operators import sentences as S
from threadmill.operators import store as B


def test_upsert_with_map_struct_and_variant_columns(spark):
    rows = spark.range(6).selectExpr(
        "id % 2 as id", "id as batch", "map('like', id) as public_metrics", "named_struct('m', map(1, 1), 'k', 2) as geo", "parse_json('{\"a\": 1}') as raw")
    tie = rows.where("batch < 2").withColumn("public_metrics", F.expr("map('like', 7L)"))
    got = B.store_upsert(rows, tie.withColumn("batch", F.lit(5).cast("bigint"))).collect()
    assert {r["id"]: r["public_metrics"] for r in got} == {0: {"like": 7}, 1: {"like": 7}}


def test_labels_with_foreign_ids(spark):
    posts = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    labels = spark.createDataFrame([("1", "yes"), ("abc", "no"), (None, "no"), ("99", "no")], "tweet_id string, claim string")
    got = sorted((r["claim"], r["text"] or "") for r in B.hydrate_labels(labels, posts).collect())
    assert got == [("no", ""), ("no", ""), ("no", ""), ("yes", "x")]


def test_a_single_document_has_no_negatives(spark):
    docs = spark.createDataFrame([(1, ".", [["a"], ["b"], ["c"]])], "id long, delim string, sentences array<array<string>>")
    pos = S.adjacent_pairs(docs, ["id"])
    assert pos.count() == 2 and S.negative_pairs(docs, pos, ["id"]).collect() == []


def test_merge_plan_of_null_and_empty_documents(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [None, 12]), (3, [11, 12]), (4, [3])], "i int, l array<int>")
    got = {r["i"]: [tuple(x) for x in r["p"]] for r in df.select("i", S.merge_plan(F.col("l"), 10).alias("p")).collect()}
    assert got == {0: [], 1: [], 2: [(12, 0, 1)], 3: [(11, 0, 0), (12, 1, 1)], 4: []}


def test_pairs_of_documents_with_a_null_id_and_equal_sentences(spark):
    rows = [(None, ".", [["a"], ["b"], ["b"]]), (1, ".", [["c"], ["d"]]), (2, ".", [["e"]]), (3, ".", [])]
    docs = spark.createDataFrame(rows, "id long, delim string, sentences array<array<string>>")
    pairs = S.pair_dataset(docs, ["id"]).collect()
    assert sorted(r["rank"] for r in pairs) == [1, 2, 3, 4, 5, 6]
    true = sorted(((r["id"], r["pno"], r["A"], r["B"]) for r in pairs if r["y"] == 1), key=repr)
    assert true == sorted([(None, 1, ["a"], ["b"]), (None, 2, ["b"], ["b"]), (1, 1, ["c"], ["d"])], key=repr)
    assert all((r["A"][0] in "ab") != (r["B"][0] in "ab") for r in pairs if r["y"] == 0)
