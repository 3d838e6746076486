"""The queries of this package: operator, its production parameters, its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import ann, bpe, filteraudit, hmm, langid, linerules, mixing, oracles, secretscan, simhash, spelling, tokenfiles, topk, urlfilter
from threadmill.llm.common import cut, documents
from threadmill.sources.tables import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, radius=2).select("doc_id", "fingerprint", "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return judged.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = mixing.label_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(documents(spark, sf_dir), ratings=ratings).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.findings(documents(spark, sf_dir))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir), folds=7, fold=2)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(cut(filteraudit.mask_cells(documents(spark, sf_dir), table(spark, sf_dir, "labels"))))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.noisy_words(documents(spark, sf_dir)))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judge(documents(spark, sf_dir)).drop("host", "clean_text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_url_filter, op3_simhash, op4_language_id, op5_mixing, op6_token_files, op7_secret_scan, op8_exact_topk, op9_lm_scoring, op10_ann,
              op11_filter_audit, op12_spelling, op13_quality_rules, pipeline)
}

ORACLES: dict[str, str] = oracles.ORACLES
