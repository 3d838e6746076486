"""Registered queries: files written and read back (A2-A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill import oracle as O
from threadmill.operators import labels as L
from threadmill.plans.catalog import register
from threadmill.plans.q_clean import CLEAN_SQL_CTE
from threadmill.plans.q_labels import SHEET_EXPORT_CTE, sheet_export
from threadmill.plans.q_model import METRICS_SQL, SQL_NB, metrics_table, nb_predictions
from threadmill.plans.q_vocab import VOCAB_CTE, cleaned, posts_vocab
from threadmill.session import scratch_path
from threadmill.sources import io as IO
from threadmill.sources import views as V


@register("scan_delimited", f"WITH {O.EXTERNAL_LABELS} SELECT tweet_id, claim, toxic FROM external_labels")
def q_scan_delimited(spark, sf):
    path = scratch_path(spark, "labels-tsv")
    IO.write_delimited(V.external_labels(spark, sf), path)
    return IO.scan_delimited(spark, path, "tweet_id string, claim string, toxic int")


@register("scan_sheet", f"WITH {O.LABEL_SHEET} SELECT id, text, claim FROM label_sheet")
def q_scan_sheet(spark, sf):
    path = scratch_path(spark, "sheet")
    IO.write_sheet(V.label_sheet(spark, sf), path)
    return IO.scan_sheet(spark, path).select("id", "text", "claim")


@register("sink_posts", f"WITH {O.POSTS} SELECT id, lang, text FROM posts")
def q_sink_posts(spark, sf):
    path = scratch_path(spark, "posts")
    IO.sink_table(V.posts(spark, sf).select("id", "lang", "text"), path, ["lang"])
    return spark.read.parquet(path).select("id", "lang", "text")


@register("sink_label_sheet", f"WITH {SHEET_EXPORT_CTE} SELECT id, text FROM sheet")
def q_sink_sheet(spark, sf):
    path = scratch_path(spark, "label-sheet")
    IO.sink_label_sheet(sheet_export(spark, sf), path)
    return IO.scan_sheet(spark, path).select("id", "text")


@register("sink_corpus_text", f"WITH {CLEAN_SQL_CTE} SELECT regexp_replace(text, '[\\n\\r]', ' ', 'g') AS value FROM cleaned")
def q_sink_text(spark, sf):
    path = scratch_path(spark, "corpus")
    IO.sink_corpus_text(cleaned(spark, sf), path)
    return spark.read.text(path)


@register("sink_vocab", f"WITH {VOCAB_CTE} SELECT token, id FROM vocab")
def q_sink_vocab(spark, sf):
    path = scratch_path(spark, "vocab")
    IO.sink_vocab(posts_vocab(spark, sf), path)
    return IO.scan_vocab(spark, path)


@register("sink_predictions", f"WITH {SQL_NB} SELECT te.id, te.y, p.prediction, array_to_string(te.tokens, ' ') AS tokens FROM te JOIN nb_pred1 p ON p.id = te.id")
def q_sink_pred(spark, sf):
    path = scratch_path(spark, "predictions")
    p = nb_predictions(spark, sf)
    IO.sink_predictions(p.select("id", "y", F.array_join("tokens", " ").alias("tokens")), p.select("id", "prediction"), ["id"], path)
    return spark.read.parquet(path).select("id", "y", "prediction", "tokens")


@register("sink_metrics", f"""WITH {SQL_NB}, {METRICS_SQL}
SELECT run, metric, step, round(value, 6) AS value FROM metrics
UNION ALL SELECT run || '-again', metric, step, round(value, 6) FROM metrics""")
def q_sink_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    m = metrics_table(spark, sf)
    IO.sink_metrics(m, path)
    IO.sink_metrics(m.withColumn("run", F.concat("run", F.lit("-again"))), path)
    return spark.read.parquet(path).select("run", "metric", "step", F.round("value", 6).alias("value"))


@register("encoder_store", f"""WITH {O.TOPICS} SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT y AS category FROM topics WHERE y IS NOT NULL AND split = 'train')""")
def q_encoder_store(spark, sf):
    path = scratch_path(spark, "encoder")
    t = V.topics(spark, sf)
    fit = lambda: L.ordinal_fit(L.split_filter(t, "train"), "y")
    IO.load_or_fit_encoder(spark, path, fit)          # absent: fitted and stored
    return IO.load_or_fit_encoder(spark, path, fit)   # present: reused
