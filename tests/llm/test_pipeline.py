"""The pipeline's stages, each judged on its own input."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_simhash import fingerprint, groups
from tests.llm.test_mixing import plain_mix
from threadmill.llm import queries

NAMES = ["language_id", "near_dedup", "secret_scan", "mixing", "bpe"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        got = stage(spark, docs, SMALL)
        if name != "bpe":
            assert got.columns == docs.columns
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


def test_clean_documents_stay(stages):
    assert sorted(map(tuple, stages[1])) == sorted(map(tuple, stages[0]))


def test_one_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1])
    member = groups([fingerprint(t) for _, t in rows])
    first = {}
    for (d, _), m in zip(rows, member):
        first.setdefault(m, d)
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(first.values())


def test_secrets_are_masked_and_nothing_else_changes(stages):
    import re

    before = {r["doc_id"]: r for r in stages[2]}
    assert len(stages[3]) == len(before)
    for r in stages[3]:
        assert r["text"] == re.sub(r"(?i)(token = \")[0-9a-f]{40}", r"\1[SECRET]", before[r["doc_id"]]["text"])
        assert r["lang"] == before[r["doc_id"]]["lang"]


def test_documents_repeat_as_the_mix_takes_them(spark, stages):
    quality = {r["doc_id"]: 2.0 if r["quality"] == 1 else 0.5 for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = [(r["doc_id"], r["source"], r["text"], quality.get(r["doc_id"], 1.0)) for r in stages[3]]
    want = sorted(d for d, size, _, _, taken in plain_mix(rows) for _ in range(taken // size if size else 0))
    assert sorted(r["doc_id"] for r in stages[4] if r["text"]) == want


def test_ids_and_texts_of_the_mix(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert sorted(r["doc_id"] for r in stages[5]) == sorted(r["doc_id"] for r in stages[4])
    for r in stages[5]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_run_gives_the_last_stage(spark, stages):
    got = queries.pipeline(spark, SMALL)
    assert sorted((r["doc_id"], r["ids"]) for r in got.collect()) == sorted((r["doc_id"], r["ids"]) for r in stages[5])


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the and of that", None, None, None), (2, "the and of that", None, None, None), (3, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    train = spark.read.parquet(f"{SMALL}/documents.parquet").select(docs.columns)
    both = docs.unionByName(train)
    kept = corpus_pipeline.language_id(spark, both, SMALL)
    assert kept.count() == train.count() + 2
    assert corpus_pipeline.near_dedup(spark, docs, SMALL).count() == 3  # the empty texts (ids null and 1), the words, the numbers
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SMALL).count() == 0
    assert corpus_pipeline.mix(spark, docs, SMALL).columns == docs.columns
    assert corpus_pipeline.encode(spark, docs, SMALL).count() == 5


def test_clashing_columns_pass_through(spark):
    """Extra columns named as helper columns keep their values through all stages but the last."""
    names = ["lang_pred", "rejected", "id_none", "text_hash", "nth", "s_key", "s_flags", "m_id", "m_epochs", "score", "ids", "size"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_near_duplicates_with_columns_of_any_type(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    docs = docs.withColumns({"m": F.expr("map('a', doc_id)"), "s": F.expr("named_struct('m', map(1, array(2)))"), "v": F.parse_json(F.lit('{"a": [1]}'))})
    docs = docs.unionByName(docs.withColumn("m", F.expr("map('b', 1L)")))
    got = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert got.columns == docs.columns
    plain = corpus_pipeline.near_dedup(spark, docs.drop("m", "s", "v"), SMALL)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in plain.collect())
