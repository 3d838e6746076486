"""Registered queries: tokens and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill import oracle as O
from threadmill.functions import tokens as T
from threadmill.operators import clean as C
from threadmill.operators import vocab as D
from threadmill.plans.catalog import register
from threadmill.session import materialize
from threadmill.plans.q_clean import CLEAN_SQL_CTE
from threadmill.sources import views as V


def cleaned(spark, sf):
    """The cleaned corpus, materialised once: vocabulary training, word
    extraction and tokenisation all read it."""
    return materialize(C.clean_posts(V.posts(spark, sf)))


def posts_vocab(spark, sf, corpus=None):
    """Vocabulary of the cleaned corpus (bounded by the vocabulary size),
    materialised so its scalar statistics do not re-run the corpus."""
    corpus = corpus if corpus is not None else cleaned(spark, sf)
    return materialize(D.vocab_by_frequency(D.word_counts(corpus, "text")))


def joined(col):
    return F.array_join(F.col(col).cast("array<string>"), " ").alias(col)


VOCAB_CTE = f"{CLEAN_SQL_CTE}, {O.vocab_ctes('cleaned', 'text')}"


@register("pretokenize", f"WITH {O.TOPICS} SELECT id, array_to_string({O.pretokenize_sql('x', True, True, True)}, ' ') AS tokens FROM topics")
def q_pretokenize(spark, sf):
    return V.topics(spark, sf).select("id", F.array_join(T.pretokenize(F.col("x"), True, True, True), " ").alias("tokens"))


@register("word_counts", f"WITH {VOCAB_CTE} SELECT word, count FROM word_counts_all WHERE count >= 2")
def q_word_counts(spark, sf):
    return D.word_counts(cleaned(spark, sf), "text", min_count=2)


@register("alphabet", f"WITH {VOCAB_CTE} SELECT ch, count, rank FROM alpha")
def q_alphabet(spark, sf):
    return D.alphabet(D.word_counts(cleaned(spark, sf), "text"))


@register("build_vocab", f"WITH {VOCAB_CTE} SELECT token, id FROM vocab")
def q_vocab(spark, sf):
    return posts_vocab(spark, sf)


WP_WORDS = f"""wp_src AS (SELECT DISTINCT unnest({O.pretokenize_sql('text', True, True, True)}) AS word FROM cleaned)"""


@register("wordpiece", f"""WITH {VOCAB_CTE}, {WP_WORDS}, {O.wordpiece_ctes('wp_src')}
SELECT word, array_to_string(pieces, ' ') AS pieces, array_to_string(piece_ids, ' ') AS piece_ids FROM wp""")
def q_wordpiece(spark, sf):
    c = cleaned(spark, sf)
    words = c.select(F.explode(T.pretokenize(F.col("text"), True, True, True)).alias("word")).distinct()
    wp = D.wordpiece_table(words, posts_vocab(spark, sf, c))
    return wp.select("word", joined("pieces"), joined("piece_ids"))


TOK_CTE = f"""{VOCAB_CTE}, {O.tokenize_ctes('tok', 'cleaned', ['id'], 'text')}, {O.wordpiece_ctes('tok_words')},
{O.tokenize_join_cte('tok', 'cleaned', ['id'])}"""


@register("repair_specials", f"WITH {TOK_CTE} SELECT id, array_to_string({O.repair_sql('tokens')}, ' ') AS tokens FROM tok")
def q_repair(spark, sf):
    c = cleaned(spark, sf)
    t = D.tokenize(c, ["id"], "text", posts_vocab(spark, sf, c), repair=True)
    return t.select("id", joined("tokens"))


@register("tokens_to_ids", f"""WITH {TOK_CTE},
rep AS (SELECT id, {O.repair_sql('tokens')} AS toks FROM tok),
ex AS (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM rep),
lk AS (SELECT ex.id, list(coalesce(v.id, 1) ORDER BY ex.pos) AS ids FROM ex LEFT JOIN vocab v ON v.token = ex.token GROUP BY ex.id)
SELECT rep.id, array_to_string(coalesce(lk.ids, []::INTEGER[]), ' ') AS ids FROM rep LEFT JOIN lk ON lk.id = rep.id""")
def q_ids(spark, sf):
    c = cleaned(spark, sf)
    t = D.tokenize(c, ["id"], "text", posts_vocab(spark, sf, c), ids="ids", repair=True)
    return t.select("id", joined("ids"))


PAIR_SQL = f"""WITH {VOCAB_CTE},
syms AS (SELECT word, count, list_transform(regexp_extract_all(word, '(?s).'), lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END) AS s FROM word_counts_all),
pr AS (SELECT s[i] AS l, s[i + 1] AS r, count FROM (SELECT s, count, unnest(range(1, len(s))) AS i FROM syms WHERE len(s) > 1))
SELECT l, r, CAST(sum(count) AS BIGINT) AS count FROM pr GROUP BY l, r HAVING sum(count) >= 2"""


@register("pair_counts", PAIR_SQL)
def q_pair_counts(spark, sf):
    return D.pair_counts(D.word_symbols(D.word_counts(cleaned(spark, sf), "text")), min_frequency=2)


@register("learn_merges")
def q_learn_merges(spark, sf):
    """Rows-only (a greedy loop that SQL cannot run in reasonable time), at the operator's full size; tested against a plain loop."""
    return D.learn_merges(materialize(D.word_counts(cleaned(spark, sf), "text")))


@register("build_vocab_merges")
def q_build_vocab_merges(spark, sf):
    """Rows-only: D5 in its merge form - specials, alphabet, then the pieces
    learned by ``learn_merges``."""
    counts = materialize(D.word_counts(cleaned(spark, sf), "text"))
    return D.build_vocab(counts, D.learn_merges(counts))
