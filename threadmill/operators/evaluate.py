"""Evaluation (H1-H11): metrics as aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions import hashing as H
from threadmill.functions import patterns as P


def batch_accuracy(pred: DataFrame, rank: str = "rank", t: str = "y", p: str = "prediction", size: int = P.BATCH_SIZE) -> DataFrame:
    """H1: mean of per-batch accuracies (a short last batch weighs as much)."""
    b = pred.select(F.floor((F.col(rank) - 1) / size).alias("_b"), (F.col(t) == F.col(p)).cast("double").alias("_hit"))
    return b.groupBy("_b").agg(F.avg("_hit").alias("_acc")).agg(F.avg("_acc").alias("accuracy"))


def f1_micro(pred: DataFrame, t: str = "y", p: str = "prediction") -> DataFrame:
    """H2: for single-label data, the overall accuracy."""
    return pred.agg(F.avg((F.col(t) == F.col(p)).cast("double")).alias("f1_micro"))


def confusion_matrix(pred: DataFrame, t: str = "y", p: str = "prediction") -> DataFrame:
    """H4: (target, prediction, n)."""
    return pred.groupBy(F.col(t).alias("target"), F.col(p).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def f1_macro(pred: DataFrame, t: str = "y", p: str = "prediction") -> DataFrame:
    """H3: unweighted mean of class F1 over the classes seen in targets or
    predictions; class F1 = 2tp / (2tp + fp + fn)."""
    cm = confusion_matrix(pred, t, p)
    tp = cm.where(F.col("target") == F.col("prediction")).select(F.col("target").alias("c"), F.col("n").alias("tp"))
    tgt = cm.groupBy(F.col("target").alias("c")).agg(F.sum("n").alias("nt"))
    prd = cm.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("np"))
    per = tgt.join(prd, "c", "full_outer").join(tp, "c", "left").fillna(0, ["nt", "np", "tp"])
    f1 = (2 * F.col("tp")) / (F.col("nt") + F.col("np"))
    per = per.withColumn("f1", F.when(F.col("nt") + F.col("np") > 0, f1).otherwise(F.lit(0.0)))
    return per.agg(F.avg("f1").alias("f1_macro"))


def masked_topk_overlap(samples: DataFrame, targets: str = "targets", predicted: str = "predicted") -> DataFrame:
    """H5 per sample: share of the k target ids among the k best predicted
    ids, k = number of targets; k = 0 -> null."""
    k = F.size(targets)
    top = F.slice(predicted, 1, k)
    return samples.withColumn(
        "overlap", F.when(k > 0, F.size(F.array_intersect(targets, top)) / k).otherwise(F.lit(None).cast("double")))


def masked_accuracy(samples: DataFrame, rank: str = "rank", size: int = P.BATCH_SIZE) -> DataFrame:
    """H6: mean overlap per batch, then mean over batches."""
    b = samples.select(F.floor((F.col(rank) - 1) / size).alias("_b"), "overlap")
    return b.groupBy("_b").agg(F.avg("overlap").alias("_a")).agg(F.avg("_a").alias("accuracy"))


def head_rows(df: DataFrame, order_cols, n: int = 256) -> DataFrame:
    """H7: first ``n`` rows in input order (a top-n, no full sort)."""
    return df.orderBy(*order_cols).limit(n)


def sample_rows(df: DataFrame, key_cols, n: int = 256, seed=42) -> DataFrame:
    """H8: ``n`` rows in a repeatable random order (top-n by hash)."""
    return df.withColumn("_o", H.shuffle_key(*key_cols, seed=seed)).orderBy("_o", *key_cols).limit(n).drop("_o")


def cross_entropy(df: DataFrame, probs: str = "probs", y: str = "y") -> DataFrame:
    """H9: mean of -log softmax(out)[y], where ``out`` is already a
    probability vector (the reference applies softmax twice)."""
    p = F.col(probs)
    # the maximum enters through one binding: once per row, not once per element
    lse = F.element_at(F.transform(F.array(F.array_max(p)), lambda m: F.log(F.aggregate(p, F.lit(0.0), lambda a, x: a + F.exp(x - m))) + m), 1)
    loss = lse - F.element_at(p, F.col(y).cast("int") + 1)
    return df.agg(F.avg(loss).alias("cross_entropy"))


def bce_loss(samples: DataFrame, id_log_probs: DataFrame, vocab_size: int, targets: str = "targets", key_cols=("id",)) -> DataFrame:
    """Mean over samples of the mean over V of binary cross-entropy
    between a probability vector over ids and the multi-hot target, without
    dense vectors: one constant sum over all ids plus a correction on each
    sample's target ids. Logs are clamped at -100."""
    lp = id_log_probs.select(F.col("id").alias("_tid"), F.exp("logp").alias("p"))
    clamp = lambda c: F.greatest(c, F.lit(-100.0))
    neg_all = lp.agg(F.sum(-clamp(F.log(1 - F.col("p"))))).scalar()
    keys = list(key_cols)
    ex = samples.select(*keys, F.explode(targets).alias("_tid"))
    corr = ex.join(lp, "_tid", "left").fillna(0.0, ["p"]).groupBy(*keys).agg(
        F.sum(-clamp(F.log(F.col("p"))) + clamp(F.log(1 - F.col("p")))).alias("_c"))
    per = samples.select(*keys).join(corr, keys, "left").select(((F.lit(neg_all) + F.coalesce(F.col("_c"), F.lit(0.0))) / vocab_size).alias("_l"))
    return per.agg(F.avg("_l").alias("bce"))


def metric_history(metrics: DataFrame) -> DataFrame:
    """Per (run, metric): steps, best step (largest value), last value,
    and the last change."""
    w = Window.partitionBy("run", "metric").orderBy("step")
    d = metrics.withColumn("_delta", F.col("value") - F.lag("value").over(w))
    return d.groupBy("run", "metric").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max_by("step", F.struct("value", -F.col("step"))).alias("best_step"),
        F.max("value").alias("best_value"),
        F.max_by("value", "step").alias("last_value"),
        F.max_by("_delta", "step").alias("last_delta"),
    )
