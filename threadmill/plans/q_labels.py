"""Registered queries: labelling, balancing, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill import oracle as O
from threadmill.operators import clean as C
from threadmill.operators import labels as L
from threadmill.operators import store as S
from threadmill.plans.catalog import register
from threadmill.session import materialize
from threadmill.plans.q_clean import CLEAN_SQL_CTE
from threadmill.sources import views as V

SEED = 42


def labelled_union(spark, sf, own=None):
    """E6 input: own sheet + external labels hydrated from the post store."""
    own = (own if own is not None else V.label_sheet(spark, sf)).withColumn("source", F.lit("own"))
    ext = S.hydrate_labels(V.external_labels(spark, sf), V.posts(spark, sf))
    ext = ext.select("id", "text", "claim", "toxic", F.lit("external").alias("source"))
    return L.union_labels(own, ext)


def mapped_labels(spark, sf, own=None):
    """Labelled rows with mapped labels, materialised: balancing reads them
    three times (ranks, bucket counts, class sizes)."""
    d = L.drop_unlabelled(labelled_union(spark, sf, own))
    return materialize(d.withColumn("claim", L.map_labels("claim")))


def balanced(spark, sf, own=None):
    return materialize(L.balance_classes(mapped_labels(spark, sf, own), "claim", ("source", "id"), seed=SEED, unique_keys=True))


def split_table(spark, sf, own=None, rank_col="rank"):
    b = L.rename_xy(balanced(spark, sf, own), "claim", "text")
    return L.ordered_split(b, ("source", "id"), seed=SEED, rank_col=rank_col)


ACK_SQL = "CAST(retweet_count + reply_count + like_count + quote_count AS BIGINT)"


@register("acknowledgments", f"WITH {O.POSTS} SELECT id, {ACK_SQL} AS acknowledgments FROM posts")
def q_ack(spark, sf):
    p = L.public_metrics(V.posts(spark, sf))
    return p.select("id", L.acknowledgments("public_metrics").alias("acknowledgments"))


@register("ack_filter", f"WITH {O.POSTS} SELECT id, {ACK_SQL} AS acknowledgments FROM posts WHERE {ACK_SQL} > 0")
def q_ack_filter(spark, sf):
    p = L.public_metrics(V.posts(spark, sf)).withColumn("acknowledgments", L.acknowledgments())
    return L.ack_filter(p).select("id", "acknowledgments")


@register("min_length_filter", f"WITH {O.POSTS} SELECT id, CAST(length(text) AS INTEGER) AS n FROM posts WHERE length(text) > 50")
def q_min_len(spark, sf):
    return L.min_length_filter(V.posts(spark, sf)).select("id", F.length("text").alias("n"))


@register("shuffle", f"WITH {O.POSTS} SELECT id, row_number() OVER (ORDER BY {O.md5_key(['id'], SEED)}, id) AS rank FROM posts")
def q_shuffle(spark, sf):
    return L.shuffle(V.posts(spark, sf), ["id"], seed=SEED).select("id", "rank")


def sheet_export(spark, sf):
    """Cleaned posts with acknowledgments and length, shuffled, text only."""
    # the length filter and the rank read the cleaned text: it is made once
    c = L.public_metrics(materialize(C.clean_posts(V.posts(spark, sf))))
    c = L.ack_filter(c.withColumn("acknowledgments", L.acknowledgments()))
    c = L.min_length_filter(c)
    return L.shuffle(c.select("id", "text"), ["id"], seed=SEED)


SHEET_EXPORT_CTE = f"""{CLEAN_SQL_CTE},
sheet AS (SELECT id, text, row_number() OVER (ORDER BY {O.md5_key(['id'], SEED)}, id) AS rank
          FROM cleaned WHERE {ACK_SQL} > 0 AND length(text) > 50)"""


@register("project_text", f"WITH {SHEET_EXPORT_CTE} SELECT id, text, rank FROM sheet")
def q_project_text(spark, sf):
    return sheet_export(spark, sf).select("id", "text", "rank")


@register("union_labels", f"WITH {O.POSTS}, {O.LABEL_SHEET}, {O.EXTERNAL_LABELS}, {O.HYDRATED}, {O.UNION_LABELS} SELECT * FROM union_labels")
def q_union(spark, sf):
    return labelled_union(spark, sf)


@register("drop_unlabelled", f"WITH {O.POSTS}, {O.LABEL_SHEET}, {O.EXTERNAL_LABELS}, {O.HYDRATED}, {O.UNION_LABELS} SELECT id, source, claim FROM union_labels WHERE claim IS NOT NULL AND text IS NOT NULL")
def q_drop_unlabelled(spark, sf):
    return L.drop_unlabelled(labelled_union(spark, sf)).select("id", "source", "claim")


@register("map_labels", f"WITH {O.label_chain_ctes(SEED)} SELECT id, source, claim FROM mapped")
def q_map_labels(spark, sf):
    return mapped_labels(spark, sf).select("id", "source", "claim")


@register("class_split", f"WITH {O.label_chain_ctes(SEED)} SELECT id, source, CASE WHEN claim = 1 THEN 'claims' ELSE 'non_claims' END AS part FROM mapped WHERE claim IN (0, 1)")
def q_class_split(spark, sf):
    pos, neg = L.class_split(mapped_labels(spark, sf))
    return pos.select("id", "source", F.lit("claims").alias("part")).unionByName(
        neg.select("id", "source", F.lit("non_claims").alias("part")))


@register("class_counts", f"""WITH {O.label_chain_ctes(SEED)}, c AS (SELECT claim, count(*) AS n FROM mapped GROUP BY claim)
SELECT claim, n, (SELECT min(n) FROM c) AS min_n FROM c""")
def q_class_counts(spark, sf):
    return L.class_counts(mapped_labels(spark, sf))


@register("balance_classes", f"WITH {O.label_chain_ctes(SEED)} SELECT id, source, claim FROM balanced")
def q_balance(spark, sf):
    return balanced(spark, sf).select("id", "source", "claim")


@register("rename_xy", f"WITH {O.label_chain_ctes(SEED)} SELECT id, source, x, y FROM renamed")
def q_rename(spark, sf):
    return L.rename_xy(balanced(spark, sf)).select("id", "source", "x", "y")


@register("ordered_split", f"WITH {O.label_chain_ctes(SEED)} SELECT id, source, y, rank, split FROM split_rows")
def q_ordered_split(spark, sf):
    return split_table(spark, sf).select("id", "source", "y", "rank", "split")


@register("tag_and_union", f"WITH {O.label_chain_ctes(SEED)} SELECT split, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_claims FROM split_rows GROUP BY split")
def q_tag_union(spark, sf):
    return split_table(spark, sf, rank_col=None).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("n_claims"))


@register("label_pipeline", f"""WITH {SHEET_EXPORT_CTE}, {O.LABEL_SHEET},
own_sheet AS (SELECT s.id, s.text, l.claim FROM sheet s JOIN label_sheet l ON l.id = s.id),
{O.label_chain_ctes(SEED, with_posts=False, own='own_sheet')} SELECT id, source, x, y, split, rank FROM split_rows""")
def q_label_pipeline(spark, sf):
    """E20 end to end: the exported sheet (E1-E5), labelled by people, united
    with the external labels, mapped, balanced and split (E6-E14)."""
    sheet = sheet_export(spark, sf).select("id", "text")
    own = sheet.join(V.label_sheet(spark, sf).select("id", "claim"), "id")
    return split_table(spark, sf, own).select("id", "source", "x", "y", "split", "rank")


@register("split_filter", f"WITH {O.TOPICS} SELECT * FROM topics WHERE split = 'train'")
def q_split_filter(spark, sf):
    return L.split_filter(V.topics(spark, sf), "train")


BIN_SQL = "CASE WHEN y IS NOT DISTINCT FROM 'NoArgument' THEN 'NoArgument' ELSE 'Argument' END"


@register("binarize_labels", f"WITH {O.TOPICS} SELECT id, {BIN_SQL} AS y FROM topics")
def q_binarize(spark, sf):
    return V.topics(spark, sf).select("id", L.binarize_labels("y").alias("y"))


@register("ordinal_fit", f"""WITH {O.TOPICS} SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT y AS category FROM topics WHERE y IS NOT NULL)""")
def q_ordinal_fit(spark, sf):
    return L.ordinal_fit(V.topics(spark, sf), "y")


@register("ordinal_transform", f"""WITH {O.TOPICS}, m AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT y AS category FROM topics WHERE y IS NOT NULL AND split = 'train'))
SELECT t.id, m.idx AS y FROM topics t JOIN m ON m.category = t.y""")
def q_ordinal_transform(spark, sf):
    t = V.topics(spark, sf)
    m = L.ordinal_fit(L.split_filter(t, "train"), "y")
    return L.ordinal_transform(t, m, "y").select("id", "y")


@register("class_cardinality", f"WITH {O.TOPICS} SELECT CAST(count(DISTINCT y) + max(CAST(y IS NULL AS INTEGER)) AS BIGINT) AS n_classes FROM topics")
def q_class_card(spark, sf):
    return L.class_cardinality(V.topics(spark, sf), "y")
