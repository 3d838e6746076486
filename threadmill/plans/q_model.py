"""Registered queries: count-based models (G1-G7) and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill import oracle as O
from threadmill.functions import tokens as T
from threadmill.functions.ranking import hash_rank, ordered_rank
from threadmill.functions import hashing as HS
from threadmill.operators import evaluate as EV
from threadmill.operators import labels as L
from threadmill.operators import model as M
from threadmill.operators import sentences as S
from threadmill.plans.catalog import register
from threadmill.session import materialize, written
from threadmill.plans.q_encode import SEED, SQL_DOCS, PT, masked_sql, topic_docs, topic_packed, topic_vocab
from threadmill.sources import views as V

R = 4  # decimals of log-scores compared against the oracle


def topic_tokens(spark, sf):
    t = V.topics(spark, sf)
    m = L.ordinal_fit(t, "y")
    t = L.ordinal_transform(t, m, "y", "y")
    return t.select("id", "split", "y", T.pretokenize(F.col("x"), True, True, True).alias("tokens"))


def nb_predictions(spark, sf):
    t = materialize(topic_tokens(spark, sf))
    model = M.train_classifier(L.split_filter(t, "train"), "tokens", "y")
    model = M.NaiveBayes(materialize(model.token_counts), materialize(model.classes))
    test = t.where(F.col("split") != "train")
    s = M.score_classifier(model, test, ["id"], "tokens")
    s = s.withColumn("probs", M.softmax_scores("scores")).withColumn("prediction", M.argmax_class("probs"))
    return ordered_rank(s, "id")


SQL_TT = f"""{O.TOPICS},
ymap AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT y AS category FROM topics WHERE y IS NOT NULL)),
tt AS (SELECT t.id, t.split, m.idx AS y, {PT('x')} AS tokens FROM topics t JOIN ymap m ON m.category = t.y)"""


def nb_sql(train: str, test: str, feats: str = "tokens") -> str:
    """CTEs nb_tc (token, y, cnt), nb_params (y, prior, logden), nb_scores (id, y, score)."""
    return f"""nb_ex AS (SELECT y, unnest({feats}) AS token FROM {train}),
nb_tc AS (SELECT token, y, count(*) AS cnt FROM nb_ex GROUP BY token, y),
nb_cls AS (SELECT y, n_docs, coalesce(n_tokens, 0) AS n_tokens FROM (SELECT y, count(*) AS n_docs FROM {train} GROUP BY y)
           LEFT JOIN (SELECT y, count(*) AS n_tokens FROM nb_ex GROUP BY y) USING (y)),
nb_params AS (SELECT y, ln(n_docs / (SELECT sum(n_docs) FROM nb_cls)) AS prior,
              ln(n_tokens + (SELECT count(DISTINCT token) FROM nb_ex)) AS logden FROM nb_cls),
nb_tex AS (SELECT id, unnest({feats}) AS token FROM {test}),
nb_known AS (SELECT id, token FROM nb_tex WHERE token IN (SELECT token FROM nb_tc)),
nb_nv AS (SELECT id, count(*) AS nv FROM nb_known GROUP BY id),
nb_s AS (SELECT k.id, c.y, sum(ln(c.cnt + 1)) AS s FROM nb_known k JOIN nb_tc c ON c.token = k.token GROUP BY k.id, c.y),
nb_scores AS (SELECT te.id, p.y, p.prior + coalesce(s.s, 0) - coalesce(nv.nv, 0) * p.logden AS score
              FROM {test} te CROSS JOIN nb_params p LEFT JOIN nb_s s ON s.id = te.id AND s.y = p.y LEFT JOIN nb_nv nv ON nv.id = te.id),
nb_mx AS (SELECT id, y, score, max(score) OVER (PARTITION BY id) AS mx FROM nb_scores),
nb_probs AS (SELECT id, y, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY id) AS p FROM nb_mx),
nb_pred1 AS (SELECT id, min(y) AS prediction FROM (SELECT id, y, p, max(p) OVER (PARTITION BY id) AS mp FROM nb_probs) WHERE p = mp GROUP BY id)"""


SQL_NB = f"""{SQL_TT}, tr AS (SELECT * FROM tt WHERE split = 'train'), te AS (SELECT * FROM tt WHERE split <> 'train'), {nb_sql('tr', 'te')},
preds AS (SELECT te.id, te.y, p.prediction, row_number() OVER (ORDER BY te.id) AS rank FROM te JOIN nb_pred1 p ON p.id = te.id)"""


def long_scores(df, col, name):
    return df.select("id", F.posexplode(col).alias("y", name)).select("id", F.col("y").cast("int").alias("y"), F.round(name, R).alias(name))


@register("train_classifier", f"WITH {SQL_NB} SELECT token, CAST(y AS INTEGER) AS y, cnt FROM nb_tc")
def q_train(spark, sf):
    t = topic_tokens(spark, sf)
    model = M.train_classifier(L.split_filter(t, "train"), "tokens", "y")
    return model.token_counts.select("token", F.explode("counts").alias("y", "cnt"))


@register("score_classifier", f"WITH {SQL_NB} SELECT id, CAST(y AS INTEGER) AS y, round(score, {R}) AS score FROM nb_scores")
def q_score(spark, sf):
    return long_scores(nb_predictions(spark, sf), "scores", "score")


@register("softmax_scores", f"WITH {SQL_NB} SELECT id, CAST(y AS INTEGER) AS y, round(p, {R}) AS p FROM nb_probs")
def q_softmax(spark, sf):
    return long_scores(nb_predictions(spark, sf), "probs", "p")


@register("argmax_class", f"WITH {SQL_NB} SELECT id, y, prediction FROM preds")
def q_argmax(spark, sf):
    return nb_predictions(spark, sf).select("id", "y", "prediction")


@register("batch_accuracy", f"WITH {SQL_NB} SELECT round(avg(a), 6) AS accuracy FROM (SELECT floor((rank - 1) / 16) AS b, avg(CAST(y = prediction AS DOUBLE)) AS a FROM preds GROUP BY b)")
def q_batch_acc(spark, sf):
    return EV.batch_accuracy(nb_predictions(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


@register("f1_micro", f"WITH {SQL_NB} SELECT round(avg(CAST(y = prediction AS DOUBLE)), 6) AS f1_micro FROM preds")
def q_f1_micro(spark, sf):
    return EV.f1_micro(nb_predictions(spark, sf)).select(F.round("f1_micro", 6).alias("f1_micro"))


@register("confusion_matrix", f"WITH {SQL_NB} SELECT y AS target, prediction, count(*) AS n FROM preds GROUP BY y, prediction")
def q_confusion(spark, sf):
    return EV.confusion_matrix(nb_predictions(spark, sf))


@register("f1_macro", f"""WITH {SQL_NB},
cls AS (SELECT y AS c FROM preds UNION SELECT prediction FROM preds),
per AS (SELECT c, (SELECT count(*) FROM preds WHERE y = c AND prediction = c) AS tp,
               (SELECT count(*) FROM preds WHERE y = c) AS nt, (SELECT count(*) FROM preds WHERE prediction = c) AS np FROM cls)
SELECT round(avg(CASE WHEN nt + np > 0 THEN 2.0 * tp / (nt + np) ELSE 0.0 END), 6) AS f1_macro FROM per""")
def q_f1_macro(spark, sf):
    return EV.f1_macro(nb_predictions(spark, sf)).select(F.round("f1_macro", 6).alias("f1_macro"))


@register("cross_entropy", f"""WITH {SQL_NB},
ce AS (SELECT id, ln(sum(exp(p))) - max(CASE WHEN y = (SELECT y FROM te WHERE te.id = nb_probs.id) THEN p END) AS l FROM nb_probs GROUP BY id)
SELECT round(avg(l), 6) AS cross_entropy FROM ce""")
def q_ce(spark, sf):
    return EV.cross_entropy(nb_predictions(spark, sf), "probs", "y").select(F.round("cross_entropy", 6).alias("cross_entropy"))


METRICS_SQL = f"""metrics AS (SELECT 'nb' AS run, 'batch_accuracy' AS metric, CAST(b + 1 AS BIGINT) AS step, a AS value
  FROM (SELECT floor((rank - 1) / 16) AS b, avg(CAST(y = prediction AS DOUBLE)) AS a FROM preds GROUP BY b))"""


def metrics_table(spark, sf):
    p = nb_predictions(spark, sf)
    b = p.select(F.floor((F.col("rank") - 1) / 16).alias("b"), (F.col("y") == F.col("prediction")).cast("double").alias("h"))
    return b.groupBy("b").agg(F.avg("h").alias("value")).select(
        F.lit("nb").alias("run"), F.lit("batch_accuracy").alias("metric"), (F.col("b") + 1).cast("bigint").alias("step"), "value")


@register("metric_history", f"""WITH {SQL_NB}, {METRICS_SQL},
d AS (SELECT *, value - lag(value) OVER (PARTITION BY run, metric ORDER BY step) AS delta FROM metrics)
SELECT run, metric, count(*) AS n_steps, arg_max(step, (value, -step)) AS best_step, round(max(value), 6) AS best_value,
       round(arg_max(value, step), 6) AS last_value, round(arg_max(delta, step), 6) AS last_delta FROM d GROUP BY run, metric""")
def q_history(spark, sf):
    h = EV.metric_history(metrics_table(spark, sf))
    return h.select("run", "metric", "n_steps", "best_step", *[F.round(c, 6).alias(c) for c in ["best_value", "last_value", "last_delta"]])


@register("head_rows", f"WITH {O.TOPICS} SELECT id FROM topics ORDER BY id LIMIT 256")
def q_head(spark, sf):
    return EV.head_rows(V.topics(spark, sf), ["id"]).select("id")


@register("sample_rows", f"WITH {O.TOPICS} SELECT id FROM topics ORDER BY {O.md5_key(['id'], SEED)}, id LIMIT 256")
def q_sample(spark, sf):
    return EV.sample_rows(V.topics(spark, sf), ["id"], 256, SEED).select("id")


# ---- pair classifier (G5) ----------------------------------------------------------
def pair_rows(spark, sf):
    # training, its vocabulary size, the class table and scoring all read the pairs
    p = S.pair_dataset(topic_packed(spark, sf), ["id"], SEED)
    # both sentences in one column: neighbours hold each sentence twice in a row, which compresses to one
    p = written(p.select("id", "delim", "pno", "y", F.array("A", "B").alias("_p")), "pairs")
    p = p.select("id", "delim", "pno", "y", *[S.unpack(F.element_at("_p", i + 1)).alias(c) for i, c in enumerate("AB")])
    p = p.withColumn("feats", M.pair_features("A", "B"))
    return p.withColumn("pid", F.concat_ws(":", F.col("id").cast("string"), "delim", F.col("pno").cast("string"), F.col("y").cast("string")))


PAIR_SQL = f"""{SQL_DOCS},
pf AS (SELECT id AS doc_id, concat_ws(':', CAST(id AS VARCHAR), delim, CAST(pno AS VARCHAR), CAST(y AS VARCHAR)) AS id, y,
  list_concat(list_transform(A, lambda t: 'a:' || t), list_transform(B, lambda t: 'b:' || t), list_transform(list_intersect(A, B), lambda t: 's:' || t)) AS feats FROM pairs),
ptr AS (SELECT * FROM pf WHERE doc_id % 10 < 8), pte AS (SELECT * FROM pf WHERE doc_id % 10 >= 8), {nb_sql('ptr', 'pte', 'feats')}"""


@register("pair_classifier", f"WITH {PAIR_SQL} SELECT p.id, t.y, p.prediction FROM nb_pred1 p JOIN pte t ON t.id = p.id")
def q_pair_clf(spark, sf):
    p = pair_rows(spark, sf)
    train = p.where(F.col("id") % 10 < 8)
    test = p.where(F.col("id") % 10 >= 8).select(F.col("pid").alias("id"), "y", "feats")
    model = M.train_classifier(train, "feats", "y")
    model = M.NaiveBayes(materialize(model.token_counts), materialize(model.classes))
    s = M.score_classifier(model, test, ["id"], "feats")
    return s.select("id", "y", M.argmax_class(M.softmax_scores("scores")).alias("prediction"))


# ---- masked tokens (G6, H5, H6, H10) -------------------------------------------
MASK_SQL = masked_sql(0)[len("WITH "):].split("\nSELECT id, delim, sno, length")[0]
LP_SQL = """idf AS (SELECT id AS tid, count(*) AS n FROM (SELECT unnest(list_slice(x, 1, length)) AS id FROM m2) WHERE id NOT IN (0, 1, 2, 3, 4) GROUP BY id),
lp AS (SELECT tid AS id, ln(n) - ln((SELECT sum(n) FROM idf)) AS logp FROM idf)"""
G6_SQL = f"""{MASK_SQL},
{LP_SQL},
near2 AS (SELECT unnest(list_filter(flatten(list_transform(range(1, length + 1), lambda i: list_transform(range(1, 3), lambda d:
            CASE WHEN i + d <= length THEN {{'v': x[i], 't': x[i + d]}} END))), lambda p: p IS NOT NULL)) AS p FROM m2),
co1 AS (SELECT p.v AS v, p.t AS t, count(*) AS n FROM near2 WHERE p.v > 4 AND p.t > 4 GROUP BY p.v, p.t),
co AS (SELECT v, t, sum(n) AS n FROM (SELECT v, t, n FROM co1 UNION ALL SELECT t AS v, v AS t, n FROM co1) GROUP BY v, t),
ctx AS (SELECT id, delim, sno, unnest(list_filter(flatten(list_transform(positions, lambda p: list_transform([-2, -1, 1, 2], lambda d:
          CASE WHEN p + d >= 0 AND p + d < length AND NOT list_contains(positions, p + d) THEN x[p + d + 1] END))), lambda z: z > 4)) AS v FROM m4),
votes AS (SELECT c.id, c.delim, c.sno, co.t AS tid, sum(co.n) AS votes FROM ctx c JOIN co ON co.v = c.v GROUP BY c.id, c.delim, c.sno, co.t),
fill AS (SELECT m4.id, m4.delim, m4.sno, f.id AS tid, 0 AS votes FROM m4, (SELECT id FROM lp ORDER BY logp DESC, id LIMIT (SELECT max(len(targets)) FROM m4)) f),
cand AS (SELECT id, delim, sno, tid, max(votes) AS votes FROM (SELECT * FROM votes UNION ALL SELECT * FROM fill) GROUP BY id, delim, sno, tid),
best AS (SELECT c.id, c.delim, c.sno, list(c.tid ORDER BY c.votes DESC, lp.logp DESC NULLS LAST, c.tid) AS ids FROM cand c LEFT JOIN lp ON lp.id = c.tid GROUP BY c.id, c.delim, c.sno),
pr AS (SELECT m4.*, list_slice(coalesce(best.ids, []), 1, len(targets)) AS predicted FROM m4 LEFT JOIN best ON best.id = m4.id AND best.delim = m4.delim AND best.sno = m4.sno),
ov AS (SELECT id, delim, sno, predicted, CASE WHEN len(targets) > 0 THEN len(list_intersect(targets, predicted)) / len(targets) END AS overlap,
       row_number() OVER (ORDER BY {O.md5_key(['id', 'delim', 'sno'], f'eval:{SEED}')}, id, delim, sno) AS rank FROM pr)"""


def masked_samples(spark, sf, head: int | None = None):
    """Masked samples of epoch 0, the corpus they come from and the vocabulary's
    size, each built once. ``head``: only the samples of the first topics in input order (H7)."""
    from threadmill.operators.encode import pad
    from threadmill.plans.encoders import encode_masked, masked_corpus

    vocab = topic_vocab(spark, sf)
    keys = ["id", "delim", "sno"]
    # kept narrow: ids without padding, no tokens
    corpus = written(masked_corpus(topic_docs(spark, sf), ["id"], vocab).select(*keys, "length", "ids"), "masked-corpus")
    n = vocab.count()
    part = corpus
    if head is not None:
        part = corpus.join(EV.head_rows(V.topics(spark, sf), ["id"], head).select("id"), "id", "left_semi")
    samples = encode_masked(part.withColumn("x", pad("ids")), ["id"], n, SEED, 0)
    return written(samples.select(*keys, "length", "ids", "positions", "targets"), "masked-samples"), corpus, n


def masked_eval(spark, sf, head: int | None = None):
    """Masked samples with their predicted ids, the overlap and a random evaluation order."""
    m, corpus, _ = masked_samples(spark, sf, head)
    keys = ["id", "delim", "sno"]
    m = M.masked_predictor(m, M.associations(corpus, "ids"), materialize(M.id_log_probs(corpus, "ids")), keys, "ids")
    m = EV.masked_topk_overlap(m, "targets", "predicted")
    # the rank reads its rows twice: the votes are counted once
    m = written(m.select(*keys, "predicted", "overlap"), "masked-overlap")
    m = m.withColumn("_o", HS.shuffle_key(*keys, seed=f"eval:{SEED}"))
    return hash_rank(m, "_o", rank_col="rank", tie_cols=keys).drop("_o")


@register("masked_predictor", f"WITH {G6_SQL} SELECT id, delim, sno, array_to_string(predicted, ' ') AS predicted FROM ov")
def q_masked_pred(spark, sf):
    m = masked_eval(spark, sf)
    return m.select("id", "delim", "sno", F.array_join(F.col("predicted").cast("array<string>"), " ").alias("predicted"))


@register("masked_topk_overlap", f"WITH {G6_SQL} SELECT id, delim, sno, round(overlap, 6) AS overlap FROM ov")
def q_topk_overlap(spark, sf):
    m = masked_eval(spark, sf)
    return m.select("id", "delim", "sno", F.round("overlap", 6).alias("overlap"))


@register("masked_accuracy", f"WITH {G6_SQL} SELECT round(avg(a), 6) AS accuracy FROM (SELECT floor((rank - 1) / 16) AS b, avg(overlap) AS a FROM ov GROUP BY b)")
def q_masked_acc(spark, sf):
    m = masked_eval(spark, sf)
    return EV.masked_accuracy(m).select(F.round("accuracy", 6).alias("accuracy"))


@register("masked_accuracy_head", f"""WITH {G6_SQL},
hov AS (SELECT overlap, row_number() OVER (ORDER BY rank) AS rank FROM ov WHERE id IN (SELECT id FROM topics ORDER BY id LIMIT 256))
SELECT round(avg(a), 6) AS accuracy FROM (SELECT floor((rank - 1) / 16) AS b, avg(overlap) AS a FROM hov GROUP BY b)""")
def q_masked_acc_head(spark, sf):
    """The masked evaluation on the first 256 rows, as one job."""
    m = masked_eval(spark, sf, head=256)
    return EV.masked_accuracy(m).select(F.round("accuracy", 6).alias("accuracy"))


@register("bce_loss", f"""WITH {MASK_SQL},
{LP_SQL},
pp AS (SELECT id, exp(logp) AS p FROM lp),
negall AS (SELECT sum(-greatest(ln(1 - p), -100)) AS s FROM pp),
ex AS (SELECT m4.id AS sid, m4.delim, m4.sno, unnest(targets) AS tid FROM m4),
corr AS (SELECT sid, delim, sno, sum(-greatest(ln(coalesce(pp.p, 0)), -100) + greatest(ln(1 - coalesce(pp.p, 0)), -100)) AS c
         FROM ex LEFT JOIN pp ON pp.id = ex.tid GROUP BY sid, delim, sno),
per AS (SELECT ((SELECT s FROM negall) + coalesce(corr.c, 0)) / (SELECT count(*) FROM vocab) AS l
        FROM m4 LEFT JOIN corr ON corr.sid = m4.id AND corr.delim = m4.delim AND corr.sno = m4.sno)
SELECT round(avg(l), 6) AS bce FROM per""")
def q_bce(spark, sf):
    m, corpus, v = masked_samples(spark, sf)
    lp = M.id_log_probs(corpus, "ids")
    return EV.bce_loss(m, lp, v, "targets", ["id", "delim", "sno"]).select(F.round("bce", 6).alias("bce"))


@register("batch_predict", f"WITH {SQL_NB} SELECT id, prediction FROM preds")
def q_batch_predict(spark, sf):
    """A user's model through the Python door: here a tiny 'model' object
    that turns class scores into a label, loaded once per task."""
    import numpy as np

    def load_model():
        return {"labels": None}

    def predict(model, pdf):
        import pandas as pd

        s = np.stack(pdf["scores"].to_numpy())
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "prediction": s.argmax(axis=1).astype("int32")})

    p = nb_predictions(spark, sf).select("id", "scores")
    return M.batch_predict(p, load_model, predict, "id long, prediction int", batch_size=16)
