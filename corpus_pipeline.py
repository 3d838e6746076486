"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Language identification drops what it rejects; SimHash keeps the document with
the smallest id of each group; the secret scan masks
secrets; mixing repeats or leaves out documents to the sources' target weights;
BPE encodes and decodes what remains. Each stage works on all its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm import bpe, langid, mixing, secretscan, simhash
from threadmill.llm.common import fresh
from threadmill.operators.store import row_order
from threadmill.session import scratch_path
from threadmill.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the identifier does not reject. Columns of documents."""
    lang, score, rejected = fresh(docs, "lang_pred", "lang_score", "rejected")
    judged = langid.identify(docs, langid.train(docs), lang_pred=lang, score=score, rejected=rejected)
    return judged.where(~F.col(rejected)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id (an
    id before none, then by a hash of the text). Of rows that agree in id and text
    the first by their other columns, of any type, stays."""
    found = simhash.near_duplicates(docs, shingle=3, radius=2)
    none, number, text_hash, nth = fresh(docs, "id_none", "id_number", "text_hash", "nth")
    key = {none: F.col("doc_id").isNull(), number: F.coalesce("doc_id", F.lit(0))}
    first = found.select("root", *[c.alias(n) for n, c in key.items()], F.col("text_hash").alias(text_hash))
    first = first.groupBy("root").agg(F.min(F.struct(none, number, text_hash)).alias("one"))
    kept = first.select("one.*")
    # narrow decisions; the documents move once, by the key of the window and the join
    rows = docs.withColumns({**key, text_hash: F.xxhash64("text")})
    one = Window.partitionBy(none, number, text_hash).orderBy(*row_order(docs, [c for c in docs.columns if c not in ("doc_id", "text")]))
    rows = rows.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1)
    return rows.join(kept, [none, number, text_hash], "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secretscan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs, ratings=mixing.label_weights(table(spark, sf_dir, "labels"))).where("epochs > 0")
    m_id, m_source, m_hash, m_epochs, nth = fresh(docs, "m_id", "m_source", "m_hash", "m_epochs", "nth")
    # rows that agree in id, source and text take part as often as the one of them that is taken most
    taken = taken.groupBy(F.col("doc_id").alias(m_id), F.col("source").alias(m_source), F.col("row_hash").alias(m_hash)).agg(F.max("epochs").alias(m_epochs))
    on = F.col("doc_id").eqNullSafe(F.col(m_id)) & F.col("source").eqNullSafe(F.col(m_source)) & (F.xxhash64("text") == F.col(m_hash))
    return docs.join(taken, on).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(m_epochs).cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of each document of the mix."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_decode(docs.select("doc_id", "source", "text"), path).drop("text")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix), ("bpe", encode)]

#: SQL cannot express the models of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
