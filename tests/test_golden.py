"""Golden cases on a hand-made vocabulary."""

import glob

import pytest
from pyspark.sql import functions as F

from threadmill.functions import patterns as P
from threadmill.functions import tokens as T
from threadmill.operators import encode as X
from threadmill.operators import labels as L
from threadmill.operators import store as St
from threadmill.operators import vocab as D
from threadmill.plans import encoders as EN
from threadmill.session import ensure_checkpoint_dir, scratch_path
from threadmill.sources import io as IO

WORDS = ["it", "'", "ll", "rain", "?", "dry", "all", "week", "my", "old", "bike", "needs", "two", "new", "tyres", "today",
         "buy", "milk", "and", "eggs", "rt", "men", "tag", "[", "]", ".", "url"]


def vocab(spark):
    toks = P.SPECIAL_TOKENS + WORDS
    return spark.createDataFrame([(t, i) for i, t in enumerate(toks)], "token string, id int")


def ids_of(tokens):
    toks = P.SPECIAL_TOKENS + WORDS
    return [toks.index(t) for t in tokens]


def tokens_of(spark, texts, repair=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, x string")
    out = D.tokenize(df, ["id"], "x", vocab(spark), repair=repair).orderBy("id").collect()
    return [r["tokens"] for r in out]


def padded(tokens, fill=0):
    return ids_of(tokens) + [fill] * (64 - len(tokens))


def test_words_and_marks_are_split(spark):
    assert tokens_of(spark, ["IT'll rain?", "dry  week"]) == [["it", "'", "ll", "rain", "?"], ["dry", "week"]]


def test_single_samples(spark):
    df = spark.createDataFrame([(7, "dry all week", "no"), (8, "It'll rain?", "yes")], "id long, x string, y string")
    rows = {r["id"]: r for r in EN.encode_claims(df, vocab(spark)).collect()}
    assert rows[7]["x"] == padded(["[CLS]", "dry", "all", "week", "[SEP]"])
    assert rows[8]["x"] == padded(["[CLS]", "it", "'", "ll", "rain", "?", "[SEP]"])
    assert rows[8]["input_mask"] == [1] * 7 + [0] * 57
    assert set(rows[8]["segment_ids"]) == {0} and len(rows[8]["segment_ids"]) == 64
    assert (rows[7]["y"], rows[8]["y"]) == (0, 1)  # categories in sorted order


def test_topic_samples(spark):
    long_topic = "milk " * 80
    df = spark.createDataFrame([(1, "dry all week", "rain?", "A"), (2, "buy eggs today", long_topic, "B")], "id long, x string, topic string, y string")
    rows = {r["id"]: r for r in EN.encode_claims(df, vocab(spark), mode="topic").collect()}
    assert rows[1]["x"] == padded(["[CLS]", "rain", "?", "[SEP]", "dry", "all", "week", "[SEP]"])
    assert rows[1]["segment_ids"] == [0] * 4 + [1] * 4 + [0] * 56
    # 64 places less three marks and the three tokens of x leave 58 for the topic
    assert rows[2]["x"] == ids_of(["[CLS]", *["milk"] * 58, "[SEP]", "buy", "eggs", "today", "[SEP]"])
    assert rows[2]["segment_ids"] == [0] * 60 + [1] * 4 and set(rows[2]["input_mask"]) == {1}


def test_masks_become_one_token(spark):
    df = spark.createDataFrame([(1, "[TAG] rain [MEN] [RT]", "1")], "id long, x string, y string")
    (r,) = EN.encode_claims(df, vocab(spark)).collect()
    assert r["x"] == padded(["[CLS]", "[TAG]", "rain", "[MEN]", "[RT]", "[SEP]"])


def test_url_is_not_repaired(spark):
    (t,) = tokens_of(spark, ["[URL] x"], repair=True)
    assert t[:3] == ["[", "url", "]"]


POST = "[RT] buy milk. my old bike needs two new tyres today [TAG]"
OTHER = "it'll rain all week. dry today"


def pieces_of(spark, texts, min_length):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, x string")
    return EN.sentence_docs(df, ["id"], "x", vocab(spark), (".",), min_length)


FIRST, SECOND = ["[RT]", "buy", "milk"], ["my", "old", "bike", "needs", "two", "new", "tyres", "today", "[TAG]"]


@pytest.mark.parametrize("min_length, expected", [(1, [FIRST, SECOND]), (4, [FIRST + SECOND]), (13, [])])
def test_short_sentences_merge(spark, min_length, expected):
    (d,) = pieces_of(spark, [POST], min_length).collect()
    assert [[t["piece"] for t in x] for x in d["sentences"]] == expected


def test_pairs_of_sentences(spark):
    docs = pieces_of(spark, [POST, OTHER], 1)
    pairs = EN.encode_pairs(docs, ["id"], vocab(spark))
    pos = {r["id"]: r["x"] for r in pairs.where(F.col("y") == 1).collect()}
    assert pos[0] == padded(["[CLS]", *FIRST, "[SEP]", *SECOND, "[SEP]"])
    assert pos[1] == padded(["[CLS]", "it", "'", "ll", "rain", "all", "week", "[SEP]", "dry", "today", "[SEP]"])
    (a, b) = pairs.where(F.col("y") == 0).collect()
    assert len(a["x"]) == len(b["x"]) == 64  # one negative for each positive


def test_all_lengths_64(spark):
    docs = pieces_of(spark, [POST, OTHER, "my. old. bike", "milk " * 300], 1)
    for r in EN.masked_corpus(docs, ["id"], vocab(spark)).collect():
        assert len(r["x"]) == len(r["input_mask"]) == len(r["segment_ids"]) == 64


def test_pretokenize_rules(spark):
    df = spark.createDataFrame([("Héllo, WORLD!\tx$y",)], "t string")
    (r,) = df.select(T.pretokenize(F.col("t"), True, True).alias("w")).collect()
    assert r["w"] == ["hello", ",", "world", "!", "x", "$", "y"]
    (r,) = df.select(T.pretokenize(F.col("t"), False, False).alias("w")).collect()
    assert r["w"] == ["Héllo", ",", "WORLD", "!", "x", "$", "y"]


def test_segments_and_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    (r,) = df.select(X.pad("ids").alias("p"), X.input_mask("ids").alias("m"), X.segment_ids(F.lit(2), F.lit(1)).alias("s")).collect()
    assert r["p"] == [1, 2, 3] + [0] * 61 and r["m"] == [1] * 3 + [0] * 61 and r["s"] == [0, 0, 1] + [0] * 61


def test_specials_stay_whole(spark):
    cases = {
        "a [MASK] b": ["a", "[MASK]", "b"], "x[SEP]Y": ["x", "[SEP]", "y"], "[mask]": ["[", "mask", "]"], "[CLS][PAD][UNK]": ["[CLS]", "[PAD]", "[UNK]"],
        "a\ufffdb": ["ab"], "a\u2028b": ["a", "b"], "\u0419 \ud55c": ["\u0438", "\ud55c"], "a\ue000b": ["ab"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", T.pretokenize(F.col("t"), True, True).alias("w")).collect():
        assert r["w"] == cases[r["t"]], r["t"]


def test_unknown_or_spaced_labels_raise(spark):
    for bad in (" yes ", "maybe"):
        with pytest.raises(Exception, match="unrecognized claim label"):
            spark.createDataFrame([(bad,)], "claim string").select(L.map_labels("claim")).collect()
    rows = spark.createDataFrame([("YES",), ("f",), ("1",), (None,)], "claim string").select(L.map_labels("claim").alias("y")).collect()
    assert [r["y"] for r in rows] == [1, 0, 1, None]


def test_claims_use_the_mapping_given(spark):
    train = spark.createDataFrame([("0",), ("1",)], "y string")
    df = spark.createDataFrame([(1, "all dry", "1"), (2, None, "1")], "id long, x string, y string")
    (r,) = EN.encode_claims(df, vocab(spark), mapping=L.ordinal_fit(train, "y")).collect()
    assert r["id"] == 1 and r["y"] == 1
    other = spark.createDataFrame([(1, "all dry", "2")], "id long, x string, y string")
    with pytest.raises(Exception, match="unseen category"):
        EN.encode_claims(other, vocab(spark), mapping=L.ordinal_fit(train, "y")).collect()


def test_upsert_winner_does_not_depend_on_partitions(spark):
    rows = [(i % 10, i % 3, f"t{i}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, like_count long, text string, batch int")
    results = {tuple(sorted(map(tuple, St.store_upsert(df.limit(0), df.repartition(n)).collect()))) for n in (1, 3, 7)}
    assert len(results) == 1


def test_sheets_keep_line_breaks_over_many_files(spark):
    texts = ["a\nb", "a\\nb", "\\", "\\\n", "c\r\nd", '"q", x', "nul\0l", "", " s "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(4)
    path = scratch_path(spark, "t-sheet")
    IO.write_sheet(df, path)
    assert len(glob.glob(path.replace("file:", "") + "/part-*.csv")) > 1
    got = {r["id"]: r["text"] for r in IO.scan_sheet(spark, path).collect()}
    assert {k: v or "" for k, v in got.items()} == dict(enumerate(texts))


def test_checkpoint_folder_is_needed_on_a_cluster():
    class Sc:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Sc(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
